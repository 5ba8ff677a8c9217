"""Entities: phrase matching, labels, ids, batches, deduplication."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexweave.functions import text as T
from lexweave.functions import vocabulary as V
from lexweave.scratch import even_tasks


def _one_per(df: DataFrame, keys: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    # One row goes on from each group and task, so a hot group is no larger than another.
    return df.groupBy(*keys).agg(pick(F.struct(*rest)).alias("_row")).select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def first_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each group of equal keys by `order`."""
    return _one_per(df, keys, lambda row: F.min_by(row, order))


def last_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return _one_per(df, keys, lambda row: F.max_by(row, order))


def numbered(df: DataFrame, prefix: str, within: list[str], order: list, name: str = "id") -> DataFrame:
    """Sequential ids e1, e2, ... within each group."""
    return df.withColumn(name, F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy(*within).orderBy(*order)).cast("string")))


def batched(df: DataFrame, size: int, within: list[str], order: list) -> DataFrame:
    """The number, from 0, of each row's batch of `size` within its group."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1) / size).cast("long"))


#: Words are runs of letters, digits, underscores and hyphens.
WORD = r"[\p{L}\p{N}_-]+"


def _words(docs: DataFrame, key: str, text: str, ahead: int) -> DataFrame:
    """key, pos, word, start and end (e0) of each word, with `ahead` following words and their ends (w1, e1, ...). The documents are dealt out by key once, and
    all that follows stays in that order."""
    found, gaps = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), F.split(F.col(text), WORD)
    rows = docs.select(key, text).repartition(key).select(key, F.posexplode(F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("word"))).alias("pos", "z"))
    rows = rows.select(key, "pos", F.col("z.word").alias("word"), F.length("z.gap").alias("gap"), F.length("z.word").alias("size"))
    order = Window.partitionBy(key).orderBy("pos")
    rows = rows.withColumn("e0", F.sum(F.col("gap") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    later = [f(c, k).over(order).alias(f"{n}{k}") for k in range(1, ahead + 1) for f, c, n in ((F.lead, "word", "w"), (F.lead, "e0", "e"))]
    return rows.select(key, "pos", "word", (F.col("e0") - F.col("size")).alias("start"), "e0", *later)


def phrase_table(spark) -> DataFrame:
    """The engine's own phrases: phrase, label."""
    return spark.createDataFrame([(p, label) for label, ps in V.PHRASES.items() for p in ps], "phrase string, label string")


def _listed(phrases: DataFrame, most: int) -> list | None:
    """The phrases that have words, as rows (phrase, label, run, len: its words, and their number), or None if they are more than `most`."""
    words = F.regexp_extract_all("phrase", F.lit(WORD), F.lit(0))
    known = phrases.select("phrase", "label", words.alias("_w")).filter("size(_w) > 0").select("phrase", "label", F.array_join("_w", " ").alias("run"), F.size("_w").alias("len"))
    rows = known.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def finder(runs: list[tuple[str, int]], chunk: int = 1_000_000, bits: int = 22):
    """find(texts): the number of each text with mentions of the phrases of these runs of words (run, number of words), and its mentions as (words, place of the first word,
    number of the phrase, start, end), in no order.

    Texts are read together, about `chunk` characters at a time, by operations on all their characters: words get hashes, and places whose first words (three, or as many as a
    phrase has) have the hash of no phrase are ruled out. What is left is compared as it is written."""
    one = np.uint64(1)
    step = 0x9E3779B97F4A7C15
    back = pow(step, -1, 1 << 64)
    # As WORD in the JVM: letters, digits and the like, underscores, hyphens.
    is_word = np.array([chr(c).isalnum() or chr(c) in "_-" for c in range(1 << 16)])
    powers = [np.ones(1, "uint64"), np.ones(1, "uint64")]

    def mixed(h):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))

    def words_of(joined: str):
        """Starts, ends and hashes of the words."""
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        inside = is_word[np.minimum(codes, 0xFFFF)]
        far = np.flatnonzero(codes > 0xFFFF)
        if len(far):
            inside[far] = [joined[i].isalnum() for i in far]
        edges = np.diff(inside.astype("int8"), prepend=0, append=0)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        if len(powers[0]) <= len(codes):
            for i, x in enumerate((step, back)):
                powers[i] = np.cumprod(np.r_[one, np.full(len(codes), x, "uint64")])
        sums = np.cumsum(np.r_[np.uint64(0), codes.astype("uint64") * powers[0][: len(codes)]])
        return starts, ends, mixed((sums[ends] - sums[starts]) * powers[1][starts])

    def lead_hash(h, n: int):
        """Hashes of each n words in a row."""
        out = h[: len(h) - n + 1]
        for k in range(1, n):
            out = mixed(out * np.uint64(3) + h[k : len(h) - n + 1 + k])
        return out >> np.uint64(64 - bits)

    tables: dict = {}
    for k, (run, n) in enumerate(runs):
        tables.setdefault(min(n, 3), {}).setdefault(n, {}).setdefault(run, []).append(k)
    marks = {}
    for lead, by_length in tables.items():
        marks[lead] = np.zeros(1 << bits, "bool")
        firsts = {" ".join(run.split(" ", lead)[:lead]) for table in by_length.values() for run in table}
        _, _, h = words_of("\n".join(firsts))
        if len(h):
            marks[lead][lead_hash(h, lead)[::lead]] = True

    def together(numbers: list[int], texts: list[str]) -> Iterator[tuple[int, list]]:
        joined = "\n".join(texts)
        starts, ends, h = words_of(joined)
        begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
        doc = np.searchsorted(begins, starts, "right") - 1
        places = {lead: at[doc[at] == doc[at + lead - 1]] for lead in tables if len(h) >= lead for at in [np.flatnonzero(marks[lead][lead_hash(h, lead)])]}
        if not any(len(at) for at in places.values()):
            return
        firsts, begins, doc, starts, ends = (x.tolist() for x in (np.searchsorted(doc, np.arange(len(texts))), begins, doc, starts, ends))
        last, found = len(doc) - 1, {}
        for lead, at in places.items():
            for n, table in tables[lead].items():
                for i in at.tolist():
                    j = i + n - 1
                    d = doc[i]
                    if j <= last and doc[j] == d:
                        known = table.get(joined[starts[i] : ends[i]] if n == 1 else " ".join([joined[x:y] for x, y in zip(starts[i : j + 1], ends[i : j + 1])]))
                        if known:
                            begin = begins[d]
                            found.setdefault(d, []).extend([(n, i - firsts[d], k, starts[i] - begin, ends[j] - begin) for k in known])
        for d in sorted(found):
            yield numbers[d], found[d]

    def find(texts: list[str | None]) -> Iterator[tuple[int, list]]:
        numbers, held, size = [], [], 0
        for i, t in enumerate(texts):
            if t:
                numbers.append(i)
                held.append(t)
                size += len(t)
                if size >= chunk:
                    yield from together(numbers, held)
                    numbers, held, size = [], [], 0
        if held:
            yield from together(numbers, held)

    return find


def without_overlaps(found: list[tuple], order: list) -> list[tuple]:
    """The mentions that finder() gives which are left if the longest go first, of equals the first in the text, then the first of `order` (by number of the phrase)."""
    if len(found) == 1:
        return found
    used, left = set(), []
    for _, _, _, hit in sorted([(-h[0], h[1], order[h[2]], h) for h in found]):
        if hit[0] == 1:
            if hit[1] not in used:
                used.add(hit[1])
                left.append(hit)
        else:
            places = range(hit[1], hit[1] + hit[0])
            if used.isdisjoint(places):
                used.update(places)
                left.append(hit)
    return left


_HITS = "array<struct<pos:int,len:int,phrase:string,label:string,start:bigint,end:bigint>>"


def mentioned(docs: DataFrame, phrases: DataFrame, key: str = "doc_id", text: str = "text", apart: bool = False, broadcast_rows: int = 200_000) -> DataFrame:
    """key, text and hits of the documents that mention phrases (phrase, label): all mentions, or, if they are to stand apart, those without overlaps. hits: see phrase_hits().

    The documents are dealt out by key once and each is read in its own row, where nothing but the mentions is made of it. With more phrases than `broadcast_rows` the mentions
    are joined by shuffle and brought together by key."""
    listed = _listed(phrases, broadcast_rows)
    rows = docs.select(F.col(key), F.col(text).alias("text")).repartition(even_tasks(docs.sparkSession), key)
    if listed is None:
        hits = _joined_hits(docs, phrases, key, text).groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("len")).alias("neg_len"), "pos", "phrase", "label", "start", "end"))).alias("hits"))
        if apart:
            none = F.array().cast("array<struct<neg_len:int,pos:int,phrase:string,label:string,start:bigint,end:bigint>>")
            taken = F.aggregate("hits", none, lambda out, h: F.when(F.exists(out, lambda o: (o["pos"] < h["pos"] - h["neg_len"]) & (h["pos"] < o["pos"] - o["neg_len"])), out).otherwise(F.concat(out, F.array(h))))
            hits = hits.withColumn("hits", taken)
        hits = hits.withColumn("hits", F.transform("hits", lambda h: F.struct(h["pos"].alias("pos"), (-h["neg_len"]).alias("len"), h["phrase"].alias("phrase"), h["label"].alias("label"), h["start"].alias("start"), h["end"].alias("end"))))
        return rows.join(hits, key)
    schema = StructType([rows.schema[key], *StructType.fromDDL(f"text string, hits {_HITS}")])
    arrow = to_arrow_schema(schema)
    item = arrow.field(2).type.value_type
    shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in listed])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        find, order = finder([(r, n) for _, _, r, n in known]), [(p, label or "") for p, label, _, _ in known]
        for b in batches:
            places, ends, flat = [], [0], []
            for i, found in find(b.column(1).to_pylist()):
                flat += without_overlaps(found, order) if apart else found
                places.append(i)
                ends.append(len(flat))
            chosen = b.take(pa.array(places, "int64"))
            columns = [[h[1] for h in flat], [h[0] for h in flat], [known[h[2]][0] for h in flat], [known[h[2]][1] for h in flat], [h[3] for h in flat], [h[4] for h in flat]]
            values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, item)], fields=list(item))
            lists = pa.ListArray.from_arrays(pa.array(ends, "int32"), values).cast(arrow.field(2).type)
            yield pa.RecordBatch.from_arrays([chosen.column(0).cast(arrow.field(0).type), chosen.column(1).cast(arrow.field(1).type), lists], schema=arrow)

    return rows.mapInArrow(run, schema)


def _joined_hits(docs: DataFrame, phrases: DataFrame, key: str, text: str) -> DataFrame:
    """As phrase_hits(), for more phrases than a task is to hold. Keys are unique. Words that start no phrase are left out first, then runs of the lengths that phrases have are joined by
    equality."""
    words = F.regexp_extract_all("phrase", F.lit(WORD), F.lit(0))
    known = phrases.select("phrase", "label", words.alias("_w")).filter("size(_w) > 0")
    lengths = known.agg(F.array_sort(F.collect_set(F.size("_w"))).alias("lengths")).first().lengths or [1]
    known = known.select("phrase", "label", F.array_join("_w", " ").alias("_run"), F.col("_w")[0].alias("word"))
    tokens = _words(docs, key, text, lengths[-1] - 1).join(known.select("word").distinct(), "word", "left_semi")

    def run(n: int) -> Column:
        text_ = F.concat_ws(" ", "word", *[f"w{k}" for k in range(1, n)])
        return F.struct(F.lit(n).alias("len"), F.when(F.col(f"e{n - 1}").isNotNull(), text_).alias("_run"), F.col(f"e{n - 1}").alias("end"))

    each = tokens.select(key, "pos", "start", F.inline(F.array(*[run(n) for n in lengths])))
    return each.join(known.drop("word"), "_run").select(key, "pos", "len", "phrase", "label", "start", "end")


def phrase_hits(docs: DataFrame, phrases: DataFrame, key: str = "doc_id", text: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """All mentions of phrases (phrase, label), which may overlap: key, pos (of the first word), len (words), phrase, label, start, end (characters).

    A mention is a run of the phrase's words, whatever stands between them. Keys are unique."""
    return mentioned(docs, phrases, key, text, False, broadcast_rows).select(key, F.inline("hits"))


def dictionary_match(docs: DataFrame, phrases: DataFrame | None = None, key: str = "doc_id", text: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """Mentions without overlaps, as phrase_hits(): the longest go first, of equals the first in the text. phrases: the engine's own, if not given."""
    phrases = phrase_table(docs.sparkSession) if phrases is None else phrases
    return mentioned(docs, phrases, key, text, True, broadcast_rows).select(key, F.inline("hits"))


def labelled(entities: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """Classes and confidences from labels; entities with an unknown label go, unless they are to be kept without a class."""
    rows = entities.withColumn("class", T.mapped(F.col("label"), V.LABELS))
    return (rows if keep_unknown else rows.filter(F.col("class").isNotNull())).withColumn("confidence", T.label_confidence(F.col("label")))


def normalized_distinct(entities: DataFrame, key: str = "doc_id", lemmas: Column | None = None) -> DataFrame:
    """Entities (ord, text, class, label, ...) with normalised texts, the first of each (text, class, label), numbered e1, e2, ... again.
    Punctuation stays; what has no text then goes. lemmas: see text.normal_form()."""
    rows = entities.withColumn("text", T.normal_form(F.col("text"), lemmas)).filter("text <> ''")
    return numbered(first_per(rows, [key, "text", "class", "label"], "ord"), "e", [key], ["ord"])


def greedy_dedup(entities: DataFrame, key: str = "doc_id", threshold: float = 0.85) -> DataFrame:
    """Entities (ord, id, text, class, lemma) with canonical_id and canonical_text.

    In order: a known (class, lemma) is that entity; otherwise the first canonical one of the class whose
    current text is similar enough; otherwise a new one. A match shortens the canonical text if its own is shorter, so
    that later comparisons depend on it: a document's entities are handled together, and no more than one
    document's at a time."""
    schema = f"{key} {entities.schema[key].dataType.simpleString()}, ord int, id string, canonical_id string, canonical_text string"

    def alike(a: str, b: str) -> bool:
        """As the ratio says; two bounds above it, by lengths and by letters, spare most comparisons."""
        both = len(a) + len(b)
        if both and 2 * min(len(a), len(b)) < threshold * both:
            return False
        m = SequenceMatcher(None, a, b)
        return m.quick_ratio() >= threshold and m.ratio() >= threshold

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        canon: list[dict] = []
        known: dict = {}
        to: list[dict] = []
        for text, kind, lemma, id_ in zip(rows["text"], rows["class"], rows["lemma"], rows["id"]):
            hit = known.get((kind, lemma))
            if hit is None:
                hit = next((c for c in canon if c["class"] == kind and alike(c["text"].lower(), text.lower())), None)
            if hit is None:
                hit = {"id": id_, "text": text, "class": kind}
                canon.append(hit)
                known[kind, lemma] = hit
            elif len(text) < len(hit["text"]):
                hit["text"] = text
            to.append(hit)
        return pd.DataFrame({key: rows[key], "ord": rows["ord"], "id": rows["id"], "canonical_id": [c["id"] for c in to], "canonical_text": [c["text"] for c in to]})

    return entities.groupBy(key).applyInPandas(run, schema)


def class_histogram(entities: DataFrame, by: list[str]) -> DataFrame:
    return entities.groupBy(*by).agg(F.count("*").alias("n"))


def in_sentence(sentences: DataFrame, entities: DataFrame, key: str = "doc_id", lemmas: bool = False) -> DataFrame:
    """Sentences (key, sent_ord, sentence) with the entities (key, ord, text) whose text they hold, by case-free substring
    or, if asked for, by lemmatised substring. The document is the join's key, so this never is a nested loop over the corpus."""
    # What is compared is made once for each sentence and each entity, not for each pair.
    plain = lambda df, c, n: df.withColumns({f"_{n}": F.lower(c), **({f"_{n}_lemmas": T.lemmatized(F.col(c))} if lemmas else {})})
    hit = F.contains("_s", "_e")
    if lemmas:
        hit = hit | F.contains("_s_lemmas", "_e_lemmas")
    found = plain(sentences, "sentence", "s").join(plain(entities, "text", "e"), key).filter(hit)
    return found.drop("_s", "_e", "_s_lemmas", "_e_lemmas")


def by_span(sentences: DataFrame, entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sentences (sent_start, sent_end) with the entities that start in them."""
    return sentences.join(entities, key).filter("sent_start <= start AND start < sent_end")


def annotate(df: DataFrame, recognise, schema: str) -> DataFrame:
    """A pluggable recogniser: a function from an iterator of data frames to another, run in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from recognise(batches)

    return df.mapInPandas(run, schema)
