"""Model calls as a pluggable step: prompts in, raw replies out, parsed and checked within the JVM.

A backend is a function from a list of prompts to a list of replies. It runs in mapInPandas with retries inside the
partition; what fails is kept as a row with an error and never fails the job. replay() answers from recorded replies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import entities as E
from lexweave.operators import relations as R
from lexweave.operators import terms as terms_

TERMS = "struct<terms:array<struct<text:string,context:string,confidence:string,reason:string>>>"
ENTITIES = "struct<entities:array<struct<text:string,class:string,confidence:string,comment:string>>>"
RELATIONS = "array<struct<relation:string,confidence:string,evidence:string>>"


def call(prompts: DataFrame, backend: Callable[[list[str]], list[str]], attempts: int = 3) -> DataFrame:
    """prompts with columns `reply` and `error`, one of which is null. Each row is tried up to `attempts` times."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            replies, errors = [], []
            for prompt in b["prompt"]:
                reply = error = None
                for _ in range(attempts):
                    try:
                        reply, error = backend([prompt])[0], None
                        break
                    except Exception as e:  # what a backend raises is its own
                        error = f"{type(e).__name__}: {e}"
                replies.append(reply)
                errors.append(error)
            yield b.assign(reply=replies, error=errors)

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
    return prompts.mapInPandas(run, f"{columns}, reply string, error string")


def replay(prompts: DataFrame, recorded: DataFrame, on: list[str]) -> DataFrame:
    """As call(), with replies (on, reply) that were recorded; others are errors."""
    rows = prompts.join(recorded, on, "left")
    return rows.withColumn("error", F.when(F.col("reply").isNull(), "no recorded reply"))


def parsed(reply: F.Column, schema: str) -> F.Column:
    """A reply's JSON, or null if it is malformed: without fences, with stray backslashes doubled."""
    return F.from_json(T.repaired_escapes(T.without_fences(reply)), schema)


#: Terms in a prompt for classes, pairs in one for relations, characters of context that go along.
TERMS_IN_BATCH, PAIRS_IN_BATCH, CONTEXT = 15, 20, 120


def term_prompts(docs: DataFrame, key: str = "doc_id", longest: int = 12000) -> DataFrame:
    """A prompt (key, part, prompt) for each chunk of each document's text."""
    rows = docs.select(key, "type", "product", F.posexplode(terms_.packed(F.col("text"), longest)).alias("part", "_body"))
    return rows.select(key, "part", F.concat_ws("\n", F.concat(F.lit("type: "), "type"), F.concat(F.lit("product: "), "product"), "_body").alias("prompt"))


def class_batches(merged: DataFrame, key: str = "doc_id", size: int = TERMS_IN_BATCH) -> DataFrame:
    """Merged terms in their order, in batches: key, batch, ord, text, context."""
    rows = merged.select(key, F.col("position").alias("ord"), "text", "context")
    return E.batched(rows, size, [key], ["ord"]).select(key, F.col("batch").cast("int").alias("batch"), "ord", "text", "context")


def class_prompts(docs: DataFrame, batches: DataFrame, key: str = "doc_id") -> DataFrame:
    """A prompt (key, part, prompt) for each batch of terms: numbered, each with the start of its context."""
    items = F.array_sort(F.collect_list(F.struct("ord", "text", F.substring(F.coalesce("context", F.lit("")), 1, CONTEXT).alias("context"))))
    rows = batches.groupBy(key, F.col("batch").alias("part")).agg(items.alias("_i")).join(docs.select(key, "type", "product"), key)
    lines = T.prompt_lines(F.col("_i"), 'термин: "%s"\n   контекст: "%s"', "text", "context")
    return rows.select(key, "part", F.concat_ws("\n", F.concat(F.lit("type: "), "type"), F.concat(F.lit("product: "), "product"), lines).alias("prompt"))


def relation_pairs(docs: DataFrame, entities: DataFrame, key: str = "doc_id", size: int = PAIRS_IN_BATCH) -> DataFrame:
    """Directed pairs of entities (ord, id, text, class) that stand in the same sentence of the legal splitter, by text or by lemma, in batches of one sentence each:
    key, part, pos, sentence, subject_id, subject_text, subject_class, object_id, object_text, object_class, allowed."""
    sentences = docs.select(key, F.posexplode(T.legal_sentences(F.col("text"))).alias("sent_ord", "sentence"))
    members = E.in_sentence(sentences, entities.select(key, "ord", "id", "text", "class"), key, lemmas=True)
    found = R.directed(R.pairs(members, [key, "sent_ord", "sentence"]))
    order = Window.partitionBy(key, "sent_ord").orderBy(F.least("subject.ord", "object.ord"), F.greatest("subject.ord", "object.ord"))
    found = found.withColumn("_n", F.row_number().over(order) - 1)
    # Batches are numbered through the document: those of a sentence follow those of the one before.
    found = found.withColumn("part", (F.col("sent_ord") * 100_000 + F.floor(F.col("_n") / size)).cast("int")).withColumn("pos", (F.col("_n") % size).cast("int"))
    sides = [F.col(f"{s}.{c}").alias(f"{s}_{n}") for s in ("subject", "object") for c, n in (("id", "id"), ("text", "text"), ("class", "class"))]
    return found.select(key, "part", "pos", "sentence", *sides, "allowed")


def pair_prompts(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """A prompt (key, part, prompt) for each batch of pairs: the sentence, then the pairs with what is allowed."""
    allowed = F.concat(F.lit("["), F.array_join(F.concat("allowed", F.array(F.lit("no_relation"))), ", "), F.lit("]"))
    items = F.array_sort(F.collect_list(F.struct("pos", "subject_text", "subject_class", "object_text", "object_class", allowed.alias("allowed"))))
    rows = pairs.groupBy(key, "part").agg(F.first("sentence").alias("_s"), items.alias("_i"))
    lines = T.prompt_lines(F.col("_i"), "«%s» (%s) → «%s» (%s)  allowed: %s", "subject_text", "subject_class", "object_text", "object_class", "allowed")
    return rows.select(key, "part", F.concat_ws("\n", "_s", lines).alias("prompt"))


def document_prompts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """A prompt (key, part 0, prompt) for each whole document."""
    return docs.select(key, F.lit(0).alias("part"), F.concat_ws("\n", F.concat(F.lit("id: "), F.col(key).cast("string")), F.concat(F.lit("type: "), "type"), F.concat(F.lit("product: "), "product"), "text").alias("prompt"))


def document_records(docs: DataFrame, replies: DataFrame, annotator: str, key: str = "doc_id") -> DataFrame:
    """A record of each whole-document annotation: id, status, error and the record as JSON. A reply without an object, and a failed call, is an
    error, whose record holds neither type, product, source nor annotation."""
    rows = docs.join(replies.select(key, "reply", "error"), key, "left")
    body = T.whole_fences(F.col("reply"))
    fine = F.col("error").isNull() & F.coalesce(F.get_json_object(body, "$").startswith("{"), F.lit(False))
    error = F.when(~fine, F.coalesce("error", F.when(F.col("reply").isNull(), "no reply").otherwise("JSONDecodeError")))
    field = lambda n, c: F.concat(F.lit(f'"{n}":'), T.json_text(F.col(c)))
    now = F.concat(F.lit('"timestamp":"'), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('"'))
    rows = rows.withColumn("error", error).withColumn("_by", F.lit(annotator))
    good = F.concat_ws(",", field("id", key), field("doc_type", "type"), field("product", "product"), field("source", "source"), field("text", "text"), field("annotator", "_by"), now, F.concat(F.lit('"annotation":'), F.get_json_object(body, "$")), F.lit('"status":"ok"'))
    bad = F.concat_ws(",", field("id", key), field("text", "text"), field("annotator", "_by"), now, F.lit('"status":"error"'), field("error", "error"))
    status = F.when(F.col("error").isNull(), "ok").otherwise("error")
    return rows.select(F.col(key).cast("string").alias("id"), status.alias("status"), "error", F.concat(F.lit("{"), F.when(status == "ok", good).otherwise(bad), F.lit("}")).alias("annotation"))


def confidence(c: F.Column, default: float) -> F.Column:
    """Numbers come quoted or not; what is no number is the default."""
    return F.coalesce(c.try_cast("double"), F.lit(default))


def terms(replies: DataFrame, key: str = "doc_id") -> DataFrame:
    """Terms of replies to chunks (key, chunk, reply); malformed chunks give none."""
    rows = replies.select(key, "chunk", F.posexplode(parsed(F.col("reply"), TERMS)["terms"]).alias("pos", "t"))
    return rows.select(key, "chunk", "pos", F.col("t.text").alias("text"), F.coalesce("t.context", F.lit("")).alias("context"), confidence(F.col("t.confidence"), 0.7).alias("score"), F.lit("llm").alias("source"))


def classified(replies: DataFrame, batch_terms: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Entities of replies (key, batch, reply), with the context of the batch's term of the same text (the last of several),
    and the documents that have a malformed batch, which lose all their entities."""
    rows = replies.withColumn("e", parsed(F.col("reply"), ENTITIES)["entities"])
    bad = rows.filter("e IS NULL").select(key).distinct()
    good = rows.join(bad, key, "left_anti").select(key, "batch", F.posexplode("e").alias("pos", "e"))
    contexts = batch_terms.withColumn("k", F.lower("text")).groupBy(key, "batch", "k").agg(F.max_by("context", "ord").alias("context"))
    good = good.withColumn("k", F.lower("e.text")).join(contexts, [key, "batch", "k"], "left")
    return good.select(key, "batch", "pos", F.col("e.text").alias("text"), F.col("e.class").alias("class"), F.coalesce("context", F.lit("")).alias("context"), confidence(F.col("e.confidence"), 0.7).alias("confidence"), F.coalesce("e.comment", F.lit("")).alias("comment")), bad


def aligned(pairs: DataFrame, replies: DataFrame, batch: list[str]) -> DataFrame:
    """Pairs (batch, pos from 0, ...) with the answer at their place in the batch's reply: missing answers and malformed or missing
    replies are no_relation, surplus answers are dropped."""
    answers = replies.select(*batch, F.posexplode(parsed(F.col("reply"), RELATIONS)).alias("pos", "r"))
    rows = pairs.join(answers, [*batch, "pos"], "left")
    return rows.select(*pairs.columns, F.coalesce("r.relation", F.lit("no_relation")).alias("relation"), confidence(F.col("r.confidence"), 0.0).alias("confidence"), F.coalesce("r.evidence", F.lit("")).alias("evidence"))
