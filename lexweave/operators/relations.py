"""Relations: pairs of entities in a sentence, their relations, and validation of the triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.functions import vocabulary as V
from lexweave.operators import entities as E


def sentence_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, sent_ord, sentence, sent_start, sent_end (characters).

    The white space between sentences is split off by the same rule, so offsets are running sums of lengths
    rather than searches."""
    parts = F.split(F.col(text), r"(?U)(?<=[.!?])(?=\s)")
    rows = docs.select(key, text).repartition(key).select(key, F.posexplode(parts).alias("sent_ord", "part"))
    before = F.coalesce(F.sum(F.length("part")).over(Window.partitionBy(key).orderBy("sent_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # All but the first part start with the white space.
    lead = F.when(F.col("sent_ord") > 0, F.length("part") - F.length(F.regexp_replace("part", r"(?U)^\s+", ""))).otherwise(0)
    rows = rows.withColumn("sent_start", (before + lead).cast("long")).withColumn("sentence", F.when(F.col("sent_ord") > 0, F.regexp_replace("part", r"(?U)^\s+", "")).otherwise(F.col("part")))
    return rows.select(key, "sent_ord", "sentence", "sent_start", (F.col("sent_start") + F.length("sentence")).alias("sent_end"))


def pairs(members: DataFrame, within: list[str], order: str = "ord") -> DataFrame:
    """All pairs a, b of a group's members with a before b; members are structs of the other columns."""
    rest = [c for c in members.columns if c not in within]
    a = members.select(*within, F.struct(*rest).alias("a"))
    b = members.select(*within, F.struct(*rest).alias("b"))
    return a.join(b, within).filter(F.col(f"a.{order}") < F.col(f"b.{order}"))


def directed(found: DataFrame) -> DataFrame:
    """Pairs in the direction that their classes allow, with the allowed relations; forward goes first, others go.

    The table of class pairs has nine rows."""
    spark = found.sparkSession
    table = spark.createDataFrame(V.DIRECTED, "s string, o string, allowed array<string>")
    forward = F.broadcast(table.select(F.col("s").alias("fs"), F.col("o").alias("fo"), F.col("allowed").alias("f_allowed")))
    back = F.broadcast(table.select(F.col("s").alias("bs"), F.col("o").alias("bo"), F.col("allowed").alias("b_allowed")))
    rows = found.join(forward, (F.col("a.class") == F.col("fs")) & (F.col("b.class") == F.col("fo")), "left").join(back, (F.col("b.class") == F.col("bs")) & (F.col("a.class") == F.col("bo")), "left")
    swap = F.col("f_allowed").isNull()
    rows = rows.filter(F.col("f_allowed").isNotNull() | F.col("b_allowed").isNotNull())
    kept = [c for c in found.columns if c not in ("a", "b")]
    return rows.select(*kept, F.when(swap, F.col("b")).otherwise(F.col("a")).alias("subject"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("object"), F.coalesce("f_allowed", "b_allowed").alias("allowed"), swap.alias("swapped"))


def rule_relations(docs: DataFrame, entities: DataFrame, key: str = "doc_id", text: str = "text", patterns: list | None = None, defaults: list | None = None) -> DataFrame:
    """Relations between entities (ord, id, text, class, start, end) of the same sentence.

    Pairs in order whose spans don't overlap; the relation is that of the pattern between them, or else their
    classes' default. Numbered r1, r2, ... in order of sentence and pair."""
    members = E.by_span(sentence_spans(docs, key, text), entities, key)
    each = F.array_sort(F.collect_list(F.struct("ord", "id", F.col("text").alias("name"), "class", "start", "end")))
    # A sentence's entities come together, so that its pairs need no join; the text between two is cut from the sentence.
    groups = members.groupBy(key, "sent_ord").agg(F.first("sentence").alias("sentence"), F.first("sent_start").alias("sent_start"), each.alias("m")).filter("size(m) > 1")
    firsts = groups.select(key, "sent_ord", "sentence", "sent_start", "m", F.explode("m").alias("a"))
    found = firsts.select(key, "sent_ord", "sentence", "sent_start", "a", F.explode(F.filter("m", lambda b: (b["ord"] > F.col("a.ord")) & (F.col("a.end") <= b["start"]))).alias("b"))
    between = F.expr("substring(sentence, int(a.end - sent_start) + 1, int(b.start - a.end))")
    table = docs.sparkSession.createDataFrame(V.PAIR_DEFAULT if defaults is None else defaults, "s string, o string, default string")
    found = found.join(F.broadcast(table), (F.col("a.class") == F.col("s")) & (F.col("b.class") == F.col("o")), "left")
    found = found.withColumn("relation", F.coalesce(T.between_relation(between, patterns), "default")).filter(F.col("relation").isNotNull())
    found = E.numbered(found, "r", [key], ["sent_ord", "a.ord", "b.ord"])
    found = found.withColumn("ord", F.expr("int(substring(id, 2))"))
    return found.select(key, "ord", "id", F.col("a.id").alias("subject_id"), F.col("a.name").alias("subject_text"), "relation", F.col("b.id").alias("object_id"), F.col("b.name").alias("object_text"), F.lit(0.65).alias("confidence"), T.strip(F.col("sentence")).alias("evidence"))


def resolved_again(relations: DataFrame, entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """Relations with the ids of the entities that have their texts now, the last of several; others keep theirs."""
    names = entities.groupBy(key, "text").agg(F.max_by("id", "ord").alias("_id"))
    out = relations
    for side in ("subject", "object"):
        n = names.select(key, F.col("text").alias(f"{side}_text"), F.col("_id").alias(f"_{side}"))
        out = out.join(n, [key, f"{side}_text"], "left").withColumn(f"{side}_id", F.coalesce(f"_{side}", f"{side}_id")).drop(f"_{side}")
    return out.select(*relations.columns)


def distinct_texts(relations: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first of each (subject text, relation, object text); ids stay as they are."""
    return E.first_per(relations, [key, "subject_text", "relation", "object_text"], "ord")


def kept_by_model(relations: DataFrame, least: float = 0.55) -> DataFrame:
    """Answers with an allowed relation and enough confidence."""
    return relations.filter((F.col("relation") != "no_relation") & F.array_contains("allowed", F.col("relation")) & (F.col("confidence") >= least))


def structural(relations: DataFrame) -> DataFrame:
    """Known relations between texts that differ. Domain and range are not checked, and the texts are compared, not
    canonical ids, so loops that come from merging entities stay."""
    return relations.filter(F.col("relation").isin(V.RELATIONS) & (F.lower("subject_text") != F.lower("object_text")))


def validated(entities: DataFrame, relations: DataFrame, key: str = "doc_id") -> DataFrame:
    """Triples after merging of entities: ids by the greedy deduplication, structural filter, first of each
    (subject id, relation, object id)."""
    same = E.greedy_dedup(entities, key)
    s = same.select(key, F.col("id").alias("subject_id"), F.col("canonical_id").alias("cs"), F.col("canonical_text").alias("ts"))
    o = same.select(key, F.col("id").alias("object_id"), F.col("canonical_id").alias("co"), F.col("canonical_text").alias("to"))
    rows = relations.join(s, [key, "subject_id"], "left").join(o, [key, "object_id"], "left")
    rows = rows.withColumn("subject_id", F.coalesce("cs", "subject_id")).withColumn("object_id", F.coalesce("co", "object_id"))
    rows = E.first_per(structural(rows), [key, "subject_id", "relation", "object_id"], "ord")
    return rows.select(key, "ord", F.coalesce("ts", "subject_text").alias("subject"), "relation", F.coalesce("to", "object_text").alias("object"), "confidence", "evidence")
