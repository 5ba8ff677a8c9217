"""End to end: documents in, an evaluated graph out. Both runs only chain the other operators. Tables that several steps need are written to the
scratch folder once.

Documents have id columns doc_id, type, product and text; ids are unique.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexweave.functions import text as T
from lexweave.functions import vocabulary as V
from lexweave.operators import annotate as A
from lexweave.operators import entities as E
from lexweave.operators import graph as G
from lexweave.operators import matching as M
from lexweave.operators import metrics as S
from lexweave.operators import relations as R
from lexweave.operators import terms
from lexweave.scratch import materialize


@dataclass
class Result:
    """Entities and relations of the documents, the graph, and documents with an error."""

    docs: DataFrame
    entities: DataFrame
    relations: DataFrame
    graph: DataFrame
    errors: DataFrame | None = None


def rules(docs: DataFrame, phrases: DataFrame | None = None, recognise: Callable[[DataFrame], DataFrame] | None = None, lemmas: Column | None = None, key: str = "doc_id", listed_phrases: int = 200_000) -> Result:
    """The rule run: phrases and, if given, a recogniser's entities (key, phrase, label, start, end); classes by label; normalised and distinct; relations within
    sentences; distinct relations; the graph.

    A recogniser's entities that touch a phrase go, as phrases come first. Without a recogniser and lemmas, and with no more than `listed_phrases` phrases, a document is read in
    its own row; both ways give the same."""
    if recognise is None and lemmas is None:
        found = _read_by_rules(docs, E.phrase_table(docs.sparkSession) if phrases is None else phrases, key, listed_phrases)
        if found is not None:
            return found
    found = E.dictionary_match(docs, phrases, key).select(key, F.col("phrase").alias("text"), "label", "start", "end")
    if recognise is not None:
        more = recognise(docs).select(key, F.col("phrase").alias("text"), "label", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
        taken = found.select(key, F.col("start").alias("_s"), F.col("end").alias("_e"))
        more = more.join(taken, (more[key] == taken[key]) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")), "left_anti")
        found = found.unionByName(more)
    found = E.numbered(found, "", [key], ["start"], "ord").withColumn("ord", F.col("ord").cast("int"))
    entities = E.normalized_distinct(E.labelled(found), key, lemmas)
    entities = materialize(entities.withColumn("ord", F.expr("int(substring(id, 2))")))
    relations = materialize(R.distinct_texts(R.rule_relations(docs, entities, key), key))
    typed = entities.join(docs.select(key, F.col("type").alias("doc_type")), key)
    return Result(docs, entities, relations, _rule_graph(typed, relations))


def _rule_graph(typed: DataFrame, relations: DataFrame) -> DataFrame:
    """The graph of entities with doc_type and of relations, whose texts are those of their entities."""
    texts = relations.select(F.col("subject_text").alias("subject"), "relation", F.col("object_text").alias("object"), "evidence")
    return G.accumulated(G.base(typed.sparkSession), G.entity_triples(typed), G.relation_triples(texts))


def _rule_reader(known: list[tuple]):
    """read(texts, types): the places of the texts that rows come from, and the rows by column, an entity's or a relation's each (see _read_by_rules())."""
    find, order = E.finder([(r, r.count(" ") + 1) for _, _, _, r, _ in known]), [(p, label or "", k) for k, (p, label, _, _, _) in enumerate(known)]
    white = "".join(T.WHITE)
    cut = re.compile(f"(?<=[.!?])(?=[{re.escape(white)}])").split
    patterns, defaults = [(re.compile(f"(?i){p}").search, r) for p, r in V.BETWEEN], {(s, o): r for s, o, r in V.PAIR_DEFAULT}
    between: dict = {}

    def relation_of(text: str) -> str | None:
        if len(between) >= 100_000:
            between.clear()
        between[text] = found = next((r for search, r in patterns if search(text)), None)
        return found

    def read(texts: list[str | None], types: list) -> tuple[list, list]:
        places, rows = [], []
        for i, hits in find(texts):
            text, kind_of_text, entities, seen = texts[i], types[i], [], set()
            taken = E.without_overlaps(hits, order)
            for start, end, k in sorted([(h[3], h[4], h[2]) for h in taken]):
                _, label, name, _, kind = known[k]
                if kind is not None and name and (name, kind, label) not in seen:
                    seen.add((name, kind, label))
                    entities.append((name, kind, start, end))
                    rows.append((kind_of_text, None, len(entities), name, kind, label, start, end, None, None, None, None))
            if len(entities) > 1:
                at, e, n, triples, many = 0, 0, 0, set(), len(entities)
                for j, part in enumerate(cut(text)):
                    sentence = part.lstrip(white) if j else part
                    at += len(part)
                    begin = at - len(sentence)
                    while e < many and entities[e][2] < begin:
                        e += 1
                    first = e
                    while e < many and entities[e][2] < at:
                        e += 1
                    if e - first < 2:
                        continue
                    evidence = sentence.strip(white)
                    for x in range(first, e - 1):
                        name1, kind1, _, end1 = entities[x]
                        for y in range(x + 1, e):
                            name2, kind2, start2, _ = entities[y]
                            words = text[end1:start2]
                            relation = (between[words] if words in between else relation_of(words)) or defaults.get((kind1, kind2))
                            if relation is not None:
                                n += 1
                                if (name1, relation, name2) not in triples:
                                    triples.add((name1, relation, name2))
                                    rows.append((kind_of_text, relation, n, name1, None, None, None, None, x + 1, y + 1, name2, evidence))
            places += [i] * (len(rows) - len(places))
        return places, list(zip(*rows)) if rows else [()] * 12

    return read


def _read_by_rules(docs: DataFrame, phrases: DataFrame, key: str, most: int) -> Result | None:
    """The rule run with each document read in its own row: its mentions, distinct entities, sentences, pairs and distinct relations. Both are written together, once; nothing else
    is made of a document, and nothing is brought together by key but the documents. None if there are more phrases than `most`."""
    listed = E.labelled(phrases.select("phrase", "label", T.normal_form(F.col("phrase")).alias("name"), F.array_join(F.regexp_extract_all("phrase", F.lit(E.WORD), F.lit(0)), " ").alias("run")), keep_unknown=True)
    listed = listed.filter("run <> ''").select("phrase", "label", "name", "run", "class").limit(most + 1).collect()
    if len(listed) > most:
        return None
    rows = docs.select(F.col(key), F.col("text").alias("text"), F.col("type").alias("type")).repartition(key)
    fields = "doc_type string, relation string, ord int, text string, class string, label string, start bigint, end bigint, first int, second int, object_text string, evidence string"
    schema = StructType([rows.schema[key], *StructType.fromDDL(fields)])
    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in listed])
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _rule_reader(shared.value)
        for b in batches:
            places, columns = read(b.column(1).to_pylist(), b.column(2).to_pylist())
            keys = b.column(0).take(pa.array(places, "int64")).cast(arrow.field(0).type)
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(x, f.type) for x, f in zip(columns, list(arrow)[1:])]], schema=arrow)

    found = materialize(rows.mapInArrow(run, schema))
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    typed = found.filter("relation IS NULL")
    entities = typed.select(key, "text", "label", "start", "end", "ord", "class", T.label_confidence(F.col("label")).alias("confidence"), name("e", "ord").alias("id"))
    relations = found.filter("relation IS NOT NULL").select(key, "ord", name("r", "ord").alias("id"), name("e", "first").alias("subject_id"), F.col("text").alias("subject_text"), "relation", name("e", "second").alias("object_id"), "object_text", F.lit(0.65).alias("confidence"), "evidence")
    return Result(docs, entities, relations, _rule_graph(typed, relations))


def agents(docs: DataFrame, extract: Callable[[DataFrame], DataFrame], classify: Callable[[DataFrame], DataFrame], relate: Callable[[DataFrame], DataFrame], key: str = "doc_id") -> Result:
    """The five-step run with model calls: terms, classes, relations, validation, integration.

    Each of the functions takes prompts (key, part, prompt; see annotate) and returns them with `reply` and `error`, as call() and replay() do. What
    fails in one step leaves a document without that step's results and is in `errors` (key, step, error); it never stops the others."""
    # Replies are written, so that a model is called once.
    chunks = materialize(extract(A.term_prompts(docs, key)))
    ranked = materialize(terms.tfidf(docs, key)).select(key, "rank", "ngram", "score")
    statistical = terms.with_contexts(docs, ranked, key).join(ranked, [key, "rank", "ngram"]).select(key, F.col("rank").cast("long").alias("ord"), F.col("ngram").alias("text"), "context", "score", F.lit("statistical").alias("source"))
    said = A.terms(chunks.withColumnRenamed("part", "chunk"), key).select(key, (F.lit(1_000_000) + F.col("chunk") * 10_000 + F.col("pos")).cast("long").alias("ord"), "text", "context", "score", "source")
    merged = materialize(terms.merge(statistical.unionByName(said), key))
    batches = A.class_batches(merged, key=key)
    replies = materialize(classify(A.class_prompts(docs, batches, key)))
    entities, bad = A.classified(replies.withColumnRenamed("part", "batch"), batches, key)
    entities = E.numbered(entities, "e", [key], ["batch", "pos"]).withColumn("ord", F.expr("int(substring(id, 2))")).withColumn("lemma", T.lemmatized(F.col("text")))
    pairs = A.relation_pairs(docs, entities, key)
    answers = materialize(relate(A.pair_prompts(pairs, key)))
    aligned = A.aligned(pairs.withColumnRenamed("part", "batch"), answers.withColumnRenamed("part", "batch"), [key, "batch"])
    kept = R.kept_by_model(aligned)
    kept = E.numbered(kept, "r", [key], ["batch", "pos"]).withColumn("ord", F.expr("int(substring(id, 2))"))
    triples = R.validated(entities, kept.select(key, "ord", "subject_id", "subject_text", "relation", "object_id", "object_text", "confidence", "evidence"), key)
    typed = entities.join(docs.select(key, F.col("type").alias("doc_type")), key)
    graph = G.accumulated(G.base(docs.sparkSession, agent=True), G.entity_triples(typed, agent=True), G.relation_triples(triples, evidence=True), G.close_matches(entities))
    failed = [df.filter("error IS NOT NULL").select(key, F.lit(step).alias("step"), "error") for df, step in ((chunks, "terms"), (replies, "classes"), (answers, "relations"))]
    errors = failed[0].unionByName(failed[1]).unionByName(failed[2]).unionByName(bad.select(key, F.lit("classes").alias("step"), F.lit("a malformed batch").alias("error"))).distinct()
    return Result(docs, entities, triples, graph, errors)


def evaluated(entities: DataFrame, relations: DataFrame, gold_entities: DataFrame, gold_relations: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Counts and ratings by document and level (entity_partial, entity_strict, relation), and the same over all. Documents without gold
    entities or relations of their own aren't judged. The counts are written to the scratch folder, as both results need them.

    Tables: key, ord, text, class; and key, ord, subject_text, relation, object_text."""
    each = materialize(M.all_levels(gold_entities, entities, gold_relations, relations, key))
    return S.scored(each.select(key, "tp", "fp", "fn", "level")), S.micro(each, ["level"])
