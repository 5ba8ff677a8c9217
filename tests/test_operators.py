"""Entities, relations, graph, annotators."""

import json

from pyspark.sql import functions as F

from lexweave.operators import annotate as A
from lexweave.operators import entities as E
from lexweave.operators import graph as G
from lexweave.operators import relations as R


def test_phrases_longest_first_without_overlaps(spark):
    docs = spark.createDataFrame([(1, "Банк России выдаёт ипотечный кредит, кредит"), (2, None)], "doc_id int, text string")
    phrases = spark.createDataFrame([("Банк", "FIN_ACTOR"), ("Банк России", "FIN_ACTOR"), ("ипотечный кредит", "FIN_PRODUCT"), ("кредит", "FIN_PRODUCT"), ("выдаёт", "X")], "phrase string, label string")
    for limit in (0, 100):  # by shuffle and by broadcast
        found = E.dictionary_match(docs, phrases, broadcast_rows=limit)
        got = sorted((r.pos, r.phrase) for r in found.collect())
        assert got == [(0, "Банк России"), (2, "выдаёт"), (3, "ипотечный кредит"), (5, "кредит")]
    kinds = {r.phrase: (r["class"], r.confidence) for r in E.labelled(found).collect()}
    assert kinds["Банк России"] == ("Actor", 0.85) and "выдаёт" not in kinds


def test_distinct_entities_are_numbered_again(spark):
    rows = spark.createDataFrame([(1, 0, "Кредит", "FinancialProduct", "L"), (1, 1, "кредит", "FinancialProduct", "L"), (1, 2, "Банк", "Actor", "L")], "doc_id int, ord int, text string, class string, label string")
    assert [(r.id, r.text) for r in E.normalized_distinct(rows).orderBy("ord").collect()] == [("e1", "кредит"), ("e2", "банк")]


def test_greedy_dedup_shrinks_the_canonical_text(spark):
    rows = spark.createDataFrame([(1, 0, "e1", "заёмщика", "Actor", "a"), (1, 1, "e2", "заёмщик", "Actor", "b"), (1, 2, "e3", "заёмщик", "Process", "b"), (1, 3, "e4", "ЗАЁМЩИКА", "Actor", "a")], "doc_id int, ord int, id string, text string, class string, lemma string")
    got = {r.id: (r.canonical_id, r.canonical_text) for r in E.greedy_dedup(rows).collect()}
    assert got == {"e1": ("e1", "заёмщик"), "e2": ("e1", "заёмщик"), "e3": ("e3", "заёмщик"), "e4": ("e1", "заёмщик")}


def test_rule_relations(spark):
    text = "Банк предоставляет кредит. Ставка и 5%. Кредит."
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    ents = [("Банк", "Actor"), ("кредит", "FinancialProduct"), ("Ставка", "ProductAttribute"), ("5%", "Metric"), ("Кредит", "FinancialProduct")]
    rows = [(1, i, f"e{i}", t, c, text.index(t), text.index(t) + len(t)) for i, (t, c) in enumerate(ents, 1)]
    found = R.rule_relations(docs, spark.createDataFrame(rows, "doc_id int, ord int, id string, text string, class string, start int, end int"))
    got = [(r.id, r.subject_text, r.relation, r.object_text, r.evidence) for r in found.orderBy("ord").collect()]
    assert got == [("r1", "Банк", "issuedBy", "кредит", "Банк предоставляет кредит."), ("r2", "Ставка", "hasValue", "5%", "Ставка и 5%.")]


def test_directed_pairs(spark):
    rows = spark.createDataFrame([(1, 1, "a", "Actor"), (1, 2, "p", "FinancialProduct"), (1, 3, "b", "Actor")], "doc_id int, ord int, text string, class string")
    got = {(r.subject.text, r.object.text, tuple(r.allowed), r.swapped) for r in R.directed(R.pairs(rows, ["doc_id"])).collect()}
    assert got == {("p", "a", ("issuedBy", "regulatedBy"), True), ("p", "b", ("issuedBy", "regulatedBy"), False)}


def test_validation(spark):
    ents = spark.createDataFrame([(1, 1, "e1", "Банк", "Actor", "банк"), (1, 2, "e2", "банк", "Actor", "банк"), (1, 3, "e3", "кредит", "FinancialProduct", "кредит"), (1, 4, "e4", "кредиты", "FinancialProduct", "кредиты")], "doc_id int, ord int, id string, text string, class string, lemma string")
    rels = spark.createDataFrame(
        [(1, 1, "e3", "кредит", "issuedBy", "e1", "Банк", 0.9, "x"), (1, 2, "e3", "кредит", "issuedBy", "e2", "банк", 0.9, "y"), (1, 3, "e1", "Банк", "involves", "e2", "банк", 0.9, "z"), (1, 4, "e3", "кредит", "subClassOf", "e4", "кредиты", 0.9, "w"), (1, 5, "e3", "кредит", "likes", "e1", "Банк", 0.9, "v")],
        "doc_id int, ord int, subject_id string, subject_text string, relation string, object_id string, object_text string, confidence double, evidence string",
    )
    got = [(r.subject, r.relation, r.object) for r in R.validated(ents, rels).orderBy("ord").collect()]
    # A loop by text is rejected, one that merging makes stays.
    assert got == [("кредит", "issuedBy", "Банк"), ("кредит", "subClassOf", "кредит")]


def test_confidence_border(spark):
    rows = spark.createDataFrame([("issuedBy", ["issuedBy"], 0.55), ("issuedBy", ["issuedBy"], 0.5499), ("no_relation", ["issuedBy"], 1.0), ("requires", ["issuedBy"], 1.0)], "relation string, allowed array<string>, confidence double")
    assert R.kept_by_model(rows).count() == 1


def test_graph(spark):
    base = G.base(spark)
    assert base.count() == base.distinct().count() and G.base(spark, agent=True).count() - base.count() == 6
    ents = spark.createDataFrame([("Ипотечный кредит", "FinancialProduct", "credit", 0.91234), ("Банк", "Actor", "credit", 0.8)], "text string, class string, doc_type string, confidence double")
    got = {(r.s, r.p, r.o) for r in G.entity_triples(ents, agent=True).collect()}
    assert ("fin:IpotechnyyKredit", "rdfs:subClassOf", "fin:CreditProduct") in got and ("fin:Bank", "rdf:type", "fin:Actor") in got and ("fin:IpotechnyyKredit", "fin:confidence", "0.912") in got
    assert {(r.s, r.o) for r in G.close_matches(ents).collect()} == {("fin:IpotechnyyKredit", "fibo:LOAN/ResidentialMortgageLoan"), ("fin:Bank", "fibo:FBC/Bank")}
    rels = spark.createDataFrame([("кредит", "issuedBy", "Банк", "текст"), ("кредит", "issuedBy", "ПИФ", "другой")], "subject string, relation string, object string, evidence string")
    nodes = {r.s for r in G.relation_triples(rels, evidence=True).collect() if r.p == "rdfs:comment"}
    assert nodes == {"fin:ev_Kredit_issuedBy"}
    s = G.stats(G.accumulated(base, G.entity_triples(ents), G.entity_triples(ents))).first()
    assert (s.classes, s.properties, s.instances) == (13, 7, 1)


def test_replies(spark):
    replies = spark.createDataFrame([(1, 0, '```json\n{"terms": [{"text": "a", "confidence": "0.5"}, {"text": "b"}]}\n```'), (1, 1, "no json")], "doc_id int, chunk int, reply string")
    assert [(r.text, r.score) for r in A.terms(replies).orderBy("pos").collect()] == [("a", 0.5), ("b", 0.7)]
    pairs = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 0, 2), (1, 1, 0)], "doc_id int, batch int, pos int")
    said = spark.createDataFrame([(1, 0, json.dumps([{"relation": "requires", "confidence": 0.9}, {"relation": "involves", "confidence": "x"}])), (1, 1, json.dumps([{"relation": "requires"}] * 3))], "doc_id int, batch int, reply string")
    got = [(r.batch, r.pos, r.relation, r.confidence) for r in A.aligned(pairs, said, ["doc_id", "batch"]).orderBy("batch", "pos").collect()]
    assert got == [(0, 0, "requires", 0.9), (0, 1, "involves", 0.0), (0, 2, "no_relation", 0.0), (1, 0, "requires", 0.0)]


def test_a_bad_batch_costs_the_document_its_entities(spark):
    good = json.dumps({"entities": [{"text": "Ставка", "class": "ProductAttribute"}]})
    replies = spark.createDataFrame([(1, 0, good), (1, 1, "?"), (2, 0, good)], "doc_id int, batch int, reply string")
    context = spark.createDataFrame([(2, 0, 0, "ставка", "x"), (2, 0, 1, "Ставка", "y")], "doc_id int, batch int, ord int, text string, context string")
    found, bad = A.classified(replies, context)
    assert [(r.doc_id, r.context) for r in found.collect()] == [(2, "y")] and [r.doc_id for r in bad.collect()] == [1]


def test_calls_are_retried_and_errors_kept(spark):
    def backend(prompts):
        if prompts[0] == "bad":
            raise ValueError("no")
        return [prompts[0].upper()]

    rows = spark.createDataFrame([(1, "ok"), (2, "bad")], "id int, prompt string")
    got = {r.id: (r.reply, r.error) for r in A.call(rows, backend).collect()}
    assert got == {1: ("OK", None), 2: (None, "ValueError: no")}
    recorded = spark.createDataFrame([("ok", "R")], "prompt string, reply string")
    assert {r.id: r.reply for r in A.replay(rows, recorded, ["prompt"]).collect()} == {1: "R", 2: None}


def test_batches_and_ids(spark):
    rows = spark.range(35).withColumn("d", F.lit(1))
    got = [r.batch for r in E.batched(rows, 15, ["d"], ["id"]).orderBy("id").collect()]
    assert got == [0] * 15 + [1] * 15 + [2] * 5
