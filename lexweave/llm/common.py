"""What the operators share: tables, names, row-wise functions and word shingles."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexweave.scratch import materialize, release, written_so_far  # noqa: F401  for the operators

#: Words are runs of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
WORDS_IN_SHINGLE = 5
SIMILARITY = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}" in taken:
        name += "_"
    return f"_{name}"


def rowwise(df: DataFrame, key: str, text: str, fields: str, start: Callable[[], Callable[[list], list]], name: str | None = None) -> DataFrame:
    """key (called `name`, if given) and `fields` of each row. start() is called once for a task; what it returns gets the texts of
    a batch and returns the columns. Keys stay in Arrow, so nulls and large integers come through."""
    schema = T.StructType([T.StructField(name or key, df.schema[key].dataType), *T.StructType.fromDDL(fields)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = start()
        for b in batches:
            columns = made(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow.field(0).type), *[pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:])]], schema=arrow)

    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


class WordHashes(dict):
    """64-bit hash of each word, remembered for the words met so far. It forgets all when it has
    grown to `most` words, so that memory stays bounded."""

    def __init__(self, most: int = 300_000):
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def words_of(text: str | None) -> list[str]:
    """str.split() would also split at other white space; texts that have any are split by hand."""
    if not text:
        return []
    if text.isascii():
        plain = not any(c in text for c in "\x1c\x1d\x1e\x1f")
    else:
        plain = _OTHER_SPACE.search(text) is None
    return text.split() if plain else [w for w in text.translate(_TO_SPACE).split(" ") if w]


#: White space for str.split() that is none here.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_TO_SPACE = {c: " " for c in range(9, 14)}
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(31))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def shingles(words: list[str], hashes: WordHashes, size: int = WORDS_IN_SHINGLE) -> np.ndarray:
    """Hashes of all runs of `size` words in order; a text with fewer words is one shingle, one without words has none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    size = min(size, n)
    h = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        h = mixed(h * _MIX[2] + w[i : n - size + 1 + i])
    return h


def groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """From batches sorted by `keys`, each group whole: what a cut between two batches splits is joined again.
    Only the group at hand is held."""
    rest: list[pd.DataFrame] = []
    last = None
    for b in batches:
        if not len(b):
            continue
        k = b[keys].to_numpy()
        cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        edges = [0, *cut.tolist(), len(b)]
        for lo, hi in zip(edges, edges[1:]):
            now = tuple(k[lo])
            if rest and now != last:
                yield rest[0] if len(rest) == 1 else pd.concat(rest, ignore_index=True)
                rest = []
            rest.append(b.iloc[lo:hi])
            last = now
    if rest:
        yield rest[0] if len(rest) == 1 else pd.concat(rest, ignore_index=True)
