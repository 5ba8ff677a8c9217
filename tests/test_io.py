"""Sources, sinks and the stream of files."""

import json
import re
from xml.etree import ElementTree

from pyspark.sql import functions as F

from lexweave.operators import graph as G
from lexweave.sources import readers, sinks
from lexweave.streaming import incremental


def test_manifest(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# x\n\na|b\nu | n | страховой | done\nv|n|t\nparser/local/x.pdf|m|кредитный_договор\n")
    good, bad = readers.manifest(readers.read_manifest(spark, str(tmp_path / "urls.txt")))
    assert [(r.url, r.name, r.doc_type) for r in good.orderBy("line_no").collect()] == [("u", "n", "страховой"), ("v", "n", "t"), ("parser/local/x.pdf", "m", "кредитный_договор")]
    assert bad.count() == 1
    assert {r.name: r.type for r in readers.type_lookup(good).collect()} == {"n": "t", "m": "credit"}


def test_corpus(spark, tmp_path):
    parsed = tmp_path / "parsed"
    parsed.mkdir()
    (parsed / "b.txt").write_text("[SOURCE] x\n[PATH] y\n[TYPE] z\n" + "─" * 60 + "\n\nтело\n")
    (parsed / "a.txt").write_text("[SOURCE] x\nбез черты\n")
    (parsed / "empty.txt").write_text("")
    (parsed / "g.txt").write_text("из файла\n" + "-" * 10 + "\ngold")
    gold = {"documents": [{"id": "g", "title": "G", "source": "g.txt", "entities": [{"id": "e1", "text": "банк", "class": "Actor"}]}, {"id": "h", "text": "own", "type": "card"}]}
    (tmp_path / "gold.json").write_text(json.dumps(gold, ensure_ascii=False, indent=1))
    texts = readers.read_parsed(spark, str(parsed))
    types = spark.createDataFrame([("g", "credit"), ("b", "deposit")], "name string, type string")
    filled = readers.filled_gold(readers.read_gold(spark, str(tmp_path / "gold.json")), types, texts)
    out = readers.corpus(filled, texts, types).orderBy("doc_ord").collect()
    assert [(r.id, r.type, r.text) for r in out] == [("g", "credit", "gold"), ("h", "card", "own"), ("a", "unknown", "без черты"), ("b", "deposit", "тело")]
    assert [r.id for r in readers.corpus(filled, texts, types, ["b"]).collect()] == ["b"]


def test_decoding(spark):
    rows = spark.createDataFrame([("é".encode(), None), ("Банк".encode("cp1251"), "ISO-8859-1"), ("Банк".encode("cp1251"), "windows-1251"), ("é".encode(), "utf-8"), (None, None)], "raw binary, declared string")
    assert [r.t for r in rows.select(readers.decoded(F.col("raw"), F.col("declared")).alias("t")).collect()] == ["é", "Банк", "Банк", "é", None]


def test_pdf_files_go_through_the_given_extractor(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\ftwo")
    got = readers.read_pdf(spark, str(tmp_path / "a.pdf"), lambda b: b.decode().split("\f")).first()
    assert got.text == "one\n\ntwo"


def test_texts_are_routed(spark, tmp_path):
    rows = spark.createDataFrame([("s", "p", "t", "a\nb"), ("s", "p", "t", "x"), ("s", "p", "t", " ")], "source string, path string, type string, text string")
    counts = {r.status: r.n for r in sinks.write_texts(rows, str(tmp_path / "out"), 2).collect()}
    assert counts == {"ok": 1, "short": 1, "empty": 1}
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["status=ok", "status=short"]


LINE = re.compile(r'<([^<>"{}|^`\\\x00-\x20]+)> <([^<>"{}|^`\\\x00-\x20]+)> (?:<([^<>"{}|^`\\\x00-\x20]+)>|"((?:[^"\\\n\r]|\\.)*)"(?:@([a-z]+))?) \.')


def parsed(line):
    s, p, o, text, lang = LINE.fullmatch(line).groups()
    return s, p, o if text is None else re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r", "t": "\t"}.get(m[1], m[1]), text), lang


def test_graph_files(spark):
    label = 'q"\\\n\t\r<&>\\n'
    graph = spark.createDataFrame([("fin:A", "rdfs:label", label, "literal", "ru"), ("fin:A", "rdf:type", "owl:Class", "uri", None), ("fin:" + "B" * 2000, "fin:confidence", "0.9", "literal", None)], G.SCHEMA)
    fin = "http://example.org/finance#"
    assert {parsed(r.value) for r in sinks.n_triples(graph).collect()} == {
        (fin + "A", "http://www.w3.org/2000/01/rdf-schema#label", label, "ru"),
        (fin + "A", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/2002/07/owl#Class", None),
        (fin + "B" * 2000, fin + "confidence", "0.9", None),
    }
    assert any(r.value.startswith("fin:A rdf:type owl:Class ;\n") for r in sinks.turtle(graph).collect())
    spaces = " ".join(f'xmlns:{k}="{v}"' for k, v in sinks.PREFIXES.items())
    root = ElementTree.fromstring(f"<rdf:RDF {spaces}>" + "".join(r.value for r in sinks.rdf_xml(graph).collect()) + "</rdf:RDF>")
    rdf = sinks.PREFIXES["rdf"]
    found = {d.get(f"{{{rdf}}}about"): d for d in root}
    assert set(found) == {fin + "A", fin + "B" * 2000}
    assert found[fin + "A"].find(f"{{{rdf}}}type").get(f"{{{rdf}}}resource") == "http://www.w3.org/2002/07/owl#Class"
    odd = spark.createDataFrame([('fin:"A', "rdf:type", "owl:Class", "uri", None), ('fin:"A', 'fin:"p', label, "literal", "ru")], G.SCHEMA)
    ld = json.loads(sinks.json_ld(odd).first().value)
    assert ld["@id"] == 'fin:"A' and ld["rdf:type"] == [{"@id": "owl:Class"}] and ld['fin:"p'] == [{"@value": label, "@language": "ru"}]


def test_annotations_and_reviews(spark, tmp_path):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    ents = spark.createDataFrame([(1, 2, "e2", "b", "Actor", 0.8), (1, 1, "e1", "a", "Actor", 0.8)], "doc_id int, ord int, id string, text string, class string, confidence double")
    rels = spark.createDataFrame([(1, 1, "r1", "e1", "a", "involves", "e2", "b", 0.65, "a b")], "doc_id int, ord int, id string, subject_id string, subject_text string, relation string, object_id string, object_text string, confidence double, evidence string")
    triples = spark.createDataFrame([(1, 1, "a", "involves", "b")], "doc_id int, ord int, subject string, relation string, object string")
    got = {r.doc_id: json.loads(r.annotation) for r in sinks.annotations(docs, ents, rels, triples).collect()}
    assert [e["id"] for e in got[1]["entities"]] == ["e1", "e2"] and got[1]["entities"][0]["start"] is None and got[1]["ontology_triples"] == ["a :involves :b"]
    assert json.loads(sinks.review_template(ents, rels).first().review)["entities_review"][0]["correct"] is None
    records = spark.createDataFrame([("1", "ok", "{}"), ("2", "error", None)], "id string, status string, annotation string")
    s = sinks.write_annotated(records, str(tmp_path / "a")).first()
    assert (s.total, s.ok, s.errors) == (2, 1, 1)
    per = spark.createDataFrame([("d", "partial", 1, 2)], "doc_id string, level string, tp int, fp int")
    out = {r.name: json.loads(r.value) for r in sinks.metrics_json(per, per.drop("doc_id")).collect()}
    assert out == {"d": {"partial": {"tp": 1, "fp": 2}}, "overall": {"partial": {"tp": 1, "fp": 2}}}


def test_records_take_one_folder(spark, tmp_path):
    records = spark.createDataFrame([(str(i), "ok", json.dumps({"id": str(i)})) for i in range(50)], "id string, status string, annotation string").coalesce(2)
    sinks.write_annotated(records, str(tmp_path / "a"), "m")
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == ["annotations", "summary"]
    meta = json.loads(spark.read.text(str(tmp_path / "a" / "summary")).first().value)["meta"]
    assert (meta["model"], meta["total"], meta["ok"], meta["errors"]) == ("m", 50, 50, 0)
    assert len([p for p in (tmp_path / "a" / "annotations").iterdir() if p.name.startswith("part")]) == 2


def test_nothing_there(spark, tmp_path):
    """Sources without files are empty."""
    assert readers.read_parsed(spark, str(tmp_path / "no")).count() == 0
    assert readers.read_gold(spark, str(tmp_path / "gold.json")).count() == 0
    assert readers.read_annotations(spark, str(tmp_path / "*_annotation.json")).count() == 0
    assert readers.read_reviews(spark, str(tmp_path / "reviews")).count() == 0


def test_reviews_last_wins(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text('{"doc_id": "1", "notes": "old"}\n{"doc_id": "1", "notes": "new"}\n{"doc_id": "2", "overall_score": 3}\n')
    assert {r.doc_id: (r.notes, r.overall_score) for r in readers.read_reviews(spark, str(tmp_path / "r")).collect()} == {"1": ("new", None), "2": (None, 3)}
    reviews = spark.createDataFrame([("x",)], "review string")
    sinks.write_reviews(reviews, str(tmp_path / "r"))
    assert sorted(p.name for p in (tmp_path / "r").iterdir()) == ["a.json"]


def test_inline_corpus(spark):
    got = readers.inline_corpus(spark, [{"id": "a", "text": "t"}]).first()
    assert (got.id, got.type, got.text) == ("a", "", "t")


def test_short_list(spark):
    rows = spark.createDataFrame([("u", "out/a.txt", "t", "x\ny"), ("v", "out/b.txt", "t", "")], "source string, path string, type string, text string")
    assert [r.value.split("  |  ")[:2] for r in sinks.short_list(rows, 5).collect()] == [["a.txt", "2 строк"]]


def test_annotation_files(spark, tmp_path):
    (tmp_path / "d1_annotation.json").write_text('{"a": 1}')
    assert [(r.id, r.value) for r in readers.read_annotations(spark, str(tmp_path / "*_annotation.json")).collect()] == [("d1", '{"a": 1}')]


def test_stream_adds_new_triples_only(spark, tmp_path):
    source, graph = str(tmp_path / "in"), str(tmp_path / "graph")
    rows = lambda names: spark.createDataFrame([(n, "Actor", "credit") for n in names], "text string, class string, doc_type string")
    for names, total in ((["a"], 2), (["a", "b"], 4)):
        rows(names).coalesce(1).write.mode("append").parquet(source)
        incremental.accumulate(spark, source, rows(["x"]).schema, G.entity_triples, graph, str(tmp_path / "cp")).awaitTermination(120)
        assert spark.read.parquet(graph).count() == total
