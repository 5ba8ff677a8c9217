"""Sharding along a Hilbert curve.

Several metadata columns are quantised, the cell of each row gets its index on the Hilbert curve
of that many dimensions, rows are sorted by the index, and the run is cut into shards of equal
row counts. Rows near each other in all the columns fall into the same shard, so that the minimum
and maximum of any of the columns prunes shards.

Columns are quantised by rank: the cuts between the cells are exact quantiles of their values, whole texts, fractions and dates
alike, so that a value that a third of the rows share fills one cell of its own. Such a cell is cut like any other: rows
within it follow the order of `key`.

Defined results: nulls sort first in every dimension; a null text has size 8 and the checksum of
the empty text; very long texts are counted whole; rows alike in all columns are interchangeable; an empty table gives no rows. Other
columns are not touched by assign() and pass through write_shards(); it replaces columns
of the input named shard or slot.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import fresh_name, materialize

SHARDS = 24
#: Bits of each dimension.
BITS = 4


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of the cells, an array of shape (dimensions, rows) with values under
    2**bits: the coordinates are turned, bit by bit from the top, into the curve's own frame, then their
    bits are interleaved. (J. Skilling, Programming the Hilbert curve, 2004.)"""
    x = cells.astype(np.int64).copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        for d in range(dims):
            on = (x[d] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(on, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> b) & 1, (1 << b) - 1, 0)
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | ((x[d] >> b) & 1)
    return out


def cuts(df: DataFrame, name: str, cells: int) -> list:
    """The values that end a cell, in order, so that cells hold about equal numbers of the rows whose `name` isn't null; exact, for any type that can be sorted.

    The different values are counted and sorted across partitions. The driver sees a number for each partition, and the cuts."""
    spark = df.sparkSession
    counted = df.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count("*").alias("n"))
    ordered = materialize(counted.repartitionByRange("v").sortWithinPartitions("v").withColumn("p", F.spark_partition_id()))
    sums = sorted(ordered.groupBy("p").agg(F.sum("n")).collect())
    total, starts = 0, []
    for p, n in sums:
        starts.append((p, total))
        total += n
    before = ordered.join(F.broadcast(spark.createDataFrame(starts, "p int, start long")), "p")
    upto = F.col("start") + F.sum("n").over(Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ends = before.select("v", "n", upto.alias("upto")).filter(f"upto * {cells} div {max(total, 1)} > (upto - n) * {cells} div {max(total, 1)} AND upto < {total}")
    return [r.v for r in ends.orderBy("v").select("v").collect()]


def cell(name: str, found: list, cells: int) -> Column:
    """The cell of a value, spread over the whole range if there are fewer cuts, so that each column counts alike; null is in the first."""
    if not found:
        return F.lit(0)
    below = F.size(F.filter(F.array(*[F.lit(c) for c in found]), lambda c: c < F.col(name)))
    return F.coalesce(F.floor(F.when(F.col(name).isNotNull(), below) * cells / (len(found) + 1)).cast("int"), F.lit(0))


def assign(df: DataFrame, key: str, dimensions: list[str], text: str = "text", shards: int = SHARDS, bits: int = BITS, carry: str | None = None) -> DataFrame:
    """A row for each row of df: key, size, text_crc32, the dimensions' values (dim_0, ...), hilbert, shard, slot; and the column `carry`, if given, as `carried`.

    The texts are read once and only their size and checksum travel on. What is sorted, across
    partitions by range, is this narrow table; the position of a row is that of its partition's
    start plus its place there. The driver sees one count for each partition.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    names = [f"dim_{i}" for i in range(len(dimensions))]
    more = [] if carry is None else [F.col(f"`{carry}`").alias("carried")]
    narrow = df.select(
        F.col(f"`{key}`").alias("key"),
        (F.octet_length(t) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.encode(t, "utf-8")).alias("text_crc32"),
        *[F.col(f"`{d}`").alias(n) for d, n in zip(dimensions, names)],
        *more,
    )
    narrow = materialize(narrow)
    found = [cuts(narrow, n, 1 << bits) for n in names]

    @F.pandas_udf("long")
    def index(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy(np.int64) for c in cells]), bits))

    placed = narrow.withColumn("hilbert", index(*[cell(n, c, 1 << bits) for n, c in zip(names, found)]))
    order = ["hilbert", "key", "text_crc32", "size"]
    sorted_ = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    # An id is the number of its partition and the place in it. The table is written, since a second
    # evaluation might cut the ranges elsewhere.
    sorted_ = materialize(sorted_.withColumn("id", F.monotonically_increasing_id()))
    part = F.shiftright("id", 33)
    counts = sorted(sorted_.groupBy(part.cast("int").alias("p")).count().collect())
    total, starts = 0, []
    for p, n in counts:
        starts.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts, "p int, start long")
    at = F.col("start") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    out = sorted_.withColumn("p", part.cast("int")).join(F.broadcast(offsets), "p").withColumn("at", at)
    shard = F.expr(f"at * {shards}L div {max(total, 1)}L")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    out = out.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("at") - first).cast("long"))
    return out.select("key", "size", "text_crc32", *names, "hilbert", "shard", "slot", *(["carried"] if carry else []))


def write_shards(df: DataFrame, key: str, dimensions: list[str], path: str, text: str = "text", shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Write df as Parquet files of one folder a shard, each sorted by slot, and return the shards' index:
    rows, bytes, and least and greatest value of each dimension. Rows without a key, and rows alike in key, are rows of their own."""
    row = fresh_name(df, "row")
    numbered = materialize(df.withColumn(row, F.monotonically_increasing_id()))
    placed = materialize(assign(numbered, key, dimensions, text, shards, bits, carry=row))
    own = [c for c in numbered.columns if c not in ("shard", "slot")]
    rows = numbered.select(*[f"`{c}`" for c in own]).join(placed.select(F.col("carried").alias(row), "shard", "slot"), row)
    rows.drop(row).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    names = [c for c in placed.columns if c.startswith("dim_")]
    stats = [f(n).alias(f"{f.__name__}_{d}") for n, d in zip(names, dimensions) for f in (F.min, F.max)]
    return placed.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"), *stats)
