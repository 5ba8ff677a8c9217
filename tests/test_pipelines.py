"""The runs from end to end against plain Python."""

import json
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lexweave.__main__ import main
from lexweave.functions import vocabulary as V
from lexweave.operators import annotate as A
from lexweave.operators import entities as E
from lexweave.operators import metrics as S
from lexweave.operators import pipelines as P
from lexweave.operators import relations as R
from lexweave.plans import queries, registry
from lexweave.scratch import written_so_far
from lexweave.sources import readers, sinks
from tests.conftest import SMALL

TEXTS = {
    1: "Банк России регулирует вклад. Заёмщик выбирает ипотечный кредит, а кредитор выдаёт   кредитная\nкарта! Договор вклада и вклад. Вклад является депозит.",
    2: "Здесь процентная ставка составляет штраф, пеня и надбавка. Страховщик: ОСАГО, КАСКО, полис КАСКО. договор договор договор",
    3: "",
    4: None,
    5: "Ничего.",
    6: "при досрочном погашении договор банковского вклада договор вклада начисление процентов грейс-период. Центральный банк Российской Федерации осуществляет надзор за управляющая компания",
}
PHRASES = [(p, label) for label, ps in V.PHRASES.items() for p in ps]


def plain_entities(text):
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[\w-]+", text or "")]
    hits = []
    for p, label in PHRASES:
        run = re.findall(r"[\w-]+", p)
        hits += [(len(run), i, p, label, words[i][0], words[i + len(run) - 1][1]) for i in range(len(words)) if [w[2] for w in words[i : i + len(run)]] == run]
    taken = []
    for h in sorted(hits, key=lambda h: (-h[0], h[1])):
        if all(h[1] + h[0] <= t[1] or t[1] + t[0] <= h[1] for t in taken):
            taken.append(h)
    out, seen = [], set()
    for _, _, p, label, start, end in sorted(taken, key=lambda h: h[1]):
        key = p.lower(), V.LABELS[label], label
        if key not in seen:
            seen.add(key)
            out.append({"id": f"e{len(out) + 1}", "text": key[0], "class": key[1], "start": start, "end": end})
    return out


def plain_relations(text, ents):
    out, n, seen, at = [], 0, set(), 0
    for s in re.split(r"(?<=[.!?])\s+", text or ""):
        lo = (text or "").find(s, at)
        at = lo + len(s)
        inside = [e for e in ents if lo <= e["start"] < at]
        for i, a in enumerate(inside):
            for b in inside[i + 1 :]:
                if a["end"] > b["start"]:
                    continue
                between = text[a["end"] : b["start"]]
                r = next((r for p, r in V.BETWEEN if re.search(p, between, re.I)), None) or {(x, y): z for x, y, z in V.PAIR_DEFAULT}.get((a["class"], b["class"]))
                if r:
                    n += 1
                    if (a["text"], r, b["text"]) not in seen:
                        seen.add((a["text"], r, b["text"]))
                        out.append((f"r{n}", a["text"], r, b["text"], s.strip()))
    return out


@pytest.fixture(scope="module")
def run(spark):
    docs = spark.createDataFrame([(k, "deposit", "вклад", t) for k, t in TEXTS.items()], "doc_id int, type string, product string, text string")
    return P.rules(docs)


def test_rule_run(run):
    ents = {k: plain_entities(t) for k, t in TEXTS.items()}
    got = sorted((r.doc_id, r.id, r.text, r["class"], r.start, r.end) for r in run.entities.collect())
    assert got == sorted((k, e["id"], e["text"], e["class"], e["start"], e["end"]) for k, es in ents.items() for e in es) and len(got) > 20
    rels = sorted((r.doc_id, r.id, r.subject_text, r.relation, r.object_text, r.evidence) for r in run.relations.collect())
    assert rels == sorted((k, *r) for k, es in ents.items() for r in plain_relations(TEXTS[k], es)) and len({r[3] for r in rels}) >= 3
    triples = {(r.s, r.p, r.o) for r in run.graph.collect()}
    assert ("fin:Vklad", "rdfs:subClassOf", "fin:DepositProduct") in triples and ("fin:BankRossii", "rdf:type", "fin:Actor") in triples


def test_annotation_file_of_rules(run):
    again = R.resolved_again(run.relations, run.entities)
    rows = {r.doc_id: json.loads(r.annotation) for r in sinks.gold_format(run.docs, run.entities, again).collect()}
    assert rows[3]["entities"] == [] and rows[1]["title"] == "вклад" and rows[1]["source"] == "1.txt"
    ids = {e["text"]: e["id"] for e in rows[2]["entities"]}
    assert rows[2]["relations"] and all(r["subject"] in ids.values() and r["object"] in ids.values() for r in rows[2]["relations"])
    assert sinks.results_name([7]) == "7.json" and sinks.results_name([1, 2]) == "results.json"


def test_ids_are_those_of_the_last_entity_of_a_text(spark):
    ents = spark.createDataFrame([(1, 1, "e1", "ставка"), (1, 2, "e2", "ставка")], "doc_id int, ord int, id string, text string")
    rels = spark.createDataFrame([(1, 1, "e1", "ставка", "e9", "нет")], "doc_id int, ord int, subject_id string, subject_text string, object_id string, object_text string")
    r = R.resolved_again(rels, ents).first()
    assert (r.subject_id, r.object_id) == ("e2", "e9")


def rating(tp, fp, fn):
    p, r = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
    return (tp, fp, fn, p, r, 2 * p * r / (p + r) if p + r else 0.0)


def normal(t):
    t = t.lower().strip()
    return V.SYNONYMS.get(t, t)


def plain_counts(level, gold, pred):
    """Counts of one document by the definition, one prediction after the other."""
    used, tp = set(), 0
    for p in pred:
        if level == "relation":
            hit = next((i for i, g in enumerate(gold) if i not in used and g[1] == p[1] and all(SequenceMatcher(None, normal(g[k]), normal(p[k])).ratio() >= 0.75 for k in (0, 2))), None)
            ok = hit is not None
        else:
            best, hit = 0.0, None
            for i, g in enumerate(gold):
                r = SequenceMatcher(None, normal(g[0]), normal(p[0])).ratio()
                if i not in used and r >= 0.85 and r > best:
                    best, hit = r, i
            ok = hit is not None and (level == "entity_partial" or gold[hit][1] == p[1])
        if ok:
            used.add(hit)
            tp += 1
    return tp, len(pred) - tp, len(gold) - tp


def test_evaluation(spark):
    """The registered evaluation, over the smallest tables, against one loop over everything."""
    found = P.rules(queries.rule_documents(spark, SMALL))
    gold_e, gold_r = queries._gold_of_rules(spark, SMALL, found)
    def lists(df, *names):
        out: dict = {}
        for r in df.orderBy("doc_id", "ord").collect():
            out.setdefault(r.doc_id, []).append(tuple(r[n] for n in names))
        return out

    ge, gr = lists(gold_e, "text", "class"), lists(gold_r, "subject_text", "relation", "object_text")
    pe, pr = lists(found.entities, "text", "class"), lists(found.relations, "subject_text", "relation", "object_text")
    want = {}
    for level, g, p in (("entity_partial", ge, pe), ("entity_strict", ge, pe), ("relation", gr, pr)):
        total = [0, 0, 0]
        for k in p:
            if k in ge or k in gr:
                total = [a + b for a, b in zip(total, plain_counts(level, g.get(k, []), p[k]))]
        want[level] = rating(*total)
    got = {r.level: (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) for r in registry.queries()["rule_pipeline_eval"](spark, SMALL).collect()}
    assert got.keys() == want.keys()
    for level in want:
        assert got[level] == pytest.approx(want[level]), level
    assert 0 < want["entity_strict"][5] < want["entity_partial"][5] < 1


def test_agent_run(spark):
    """Five steps with answers made by rule, one of which fails for one document."""
    text = "Банк выдаёт ипотечный кредит. Ставка составляет 5% годовых. Банк России регулирует банк."
    docs = spark.createDataFrame([("a", "credit", "ипотека", text), ("b", "credit", "x", "Сбой кредит банк.")], "doc_id string, type string, product string, text string")

    def extract(prompts):
        return A.call(prompts, lambda ps: [json.dumps({"terms": [{"text": t, "context": "c", "confidence": 0.9} for t in ("Банк", "ипотечный кредит", "Ставка") if t in ps[0]]})])

    def classify(prompts):
        kinds = {"банк": "Actor", "ипотечный кредит": "FinancialProduct", "ставка": "ProductAttribute"}

        def answer(ps):
            if "Сбой" in ps[0] or "сбой" in ps[0]:
                raise ValueError("no answer")
            assert re.search(r'1\. термин: ".+"\n   контекст: ".{0,120}"', ps[0])
            terms = re.findall(r'термин: "(.+?)"', ps[0])
            return [json.dumps({"entities": [{"text": t, "class": kinds[t.lower()], "confidence": 0.8} for t in terms if t.lower() in kinds]})]

        return A.call(prompts, answer, attempts=2)

    def relate(prompts):
        def answer(ps):
            lines = re.findall(r"«(.+?)» \((\w+)\) → «(.+?)» \((\w+)\)  allowed: \[(.+?)\]", ps[0])
            return [json.dumps([{"relation": a.split(", ")[0], "confidence": 0.9, "evidence": "e"} for *_, a in lines])]

        return A.call(prompts, answer)

    out = P.agents(docs, extract, classify, relate)
    kinds = {(r.doc_id, r.text.lower(), r["class"]) for r in out.entities.collect()}
    assert {("a", "банк", "Actor"), ("a", "ипотечный кредит", "FinancialProduct")} <= kinds and not any(k[0] == "b" for k in kinds)
    assert ("a", "ипотечный кредит", "issuedBy", "банк") in {(r.doc_id, r.subject.lower(), r.relation, r.object.lower()) for r in out.relations.collect()}
    assert {(r.doc_id, r.step) for r in out.errors.collect()} == {("b", "classes")}
    triples = {(r.s, r.p, r.o) for r in out.graph.collect()}
    assert ("fin:IpotechnyyKredit", "fin:issuedBy", "fin:Bank") in triples and ("fin:Bank", "skos:closeMatch", "fibo:FBC/Bank") in triples
    assert any(p == "fin:about" for _, p, _ in triples)


def test_whole_documents(spark):
    docs = spark.createDataFrame([("a", "credit", "p", "s.txt", 'т"1'), ("b", None, "p", "s.txt", "t"), ("c", "x", "p", "s", "t")], "doc_id string, type string, product string, source string, text string")
    assert [r.part for r in A.document_prompts(docs).collect()] == [0, 0, 0]
    replies = spark.createDataFrame([("a", '```json\n{"entities": [{"text": "x"}]}\n```', None), ("b", "no json", None)], "doc_id string, reply string, error string")
    rows = {r.id: r for r in A.document_records(docs, replies, "llm:m").collect()}
    a = json.loads(rows["a"].annotation)
    assert a["text"] == 'т"1' and a["annotation"] == {"entities": [{"text": "x"}]} and a["status"] == "ok" and a["annotator"] == "llm:m" and a["doc_type"] == "credit"
    b = json.loads(rows["b"].annotation)
    assert b["status"] == "error" and b["error"] == "JSONDecodeError" and "annotation" not in b and rows["c"].error == "no reply"


def test_pairs_come_in_batches_of_a_sentence(spark):
    ents = [("a", i, f"e{i}", t, c) for i, (t, c) in enumerate([*[(f"банк{k}", "Actor") for k in range(8)], *[(f"вклад{k}", "FinancialProduct") for k in range(5)]])]
    docs = spark.createDataFrame([("a", " ".join(e[3] for e in ents) + ". Второе банк0 вклад0.")], "doc_id string, text string")
    pairs = A.relation_pairs(docs, spark.createDataFrame(ents, "doc_id string, ord int, id string, text string, class string"))
    sizes = {}
    for r in pairs.collect():
        sizes.setdefault(r.part, []).append(r.pos)
    # 40 pairs of a bank and a deposit and 10 of two deposits in the first sentence, one in the second.
    assert sorted(len(v) for v in sizes.values()) == [1, 10, 20, 20] and all(sorted(v) == list(range(len(v))) for v in sizes.values())


def test_offsets_of_mentions(spark):
    docs = spark.createDataFrame([(1, "  a, b--c a\tb 🙂 a b"), (2, "a"), (3, "")], "doc_id int, text string")
    phrases = spark.createDataFrame([("a b", "X"), ("a", "Y"), ("a b--c a b", "Z"), ("?!", "W")], "phrase string, label string")
    for limit in (0, 10):
        got = sorted((r.doc_id, r.phrase, r.pos, r.start, r.end) for r in E.phrase_hits(docs, phrases, broadcast_rows=limit).collect())
        assert got == [(1, "a", 0, 2, 3), (1, "a", 2, 10, 11), (1, "a", 4, 16, 17), (1, "a b", 2, 10, 13), (1, "a b", 4, 16, 19), (1, "a b--c a b", 0, 2, 13), (2, "a", 0, 0, 1)]


def test_defaults(spark):
    rows = spark.createDataFrame([("x",), ("y",), (None,)], "k string")
    got = readers.with_default(rows, spark.createDataFrame([("x", "known")], "k string, type string"), "k", "type")
    assert sorted((str(r.k), r.type) for r in got.collect()) == [("None", "unknown"), ("x", "known"), ("y", "unknown")]
    assert got.filter(F.col("type").isNull()).count() == 0


def test_command_line(spark, tmp_path):
    texts = tmp_path / "texts"
    texts.mkdir()
    (texts / "d1.txt").write_text("[SOURCE] x\n" + "-" * 20 + "\n" + TEXTS[1])
    (texts / "d2.txt").write_text(TEXTS[2])
    (tmp_path / "urls.txt").write_text("u | d1 | депозитный_продукт\n")
    gold = {"documents": [{"id": "d1", "title": "D", "source": "d1.txt", "entities": [{"id": "e1", "text": "Банк России", "class": "Actor"}, {"id": "e2", "text": "вклад", "class": "FinancialProduct"}], "relations": [{"id": "r1", "subject": "e1", "relation": "issuedBy", "object": "e2"}]}]}
    (tmp_path / "gold.json").write_text(json.dumps(gold, ensure_ascii=False))
    main(["--parsed", str(texts), "--manifest", str(tmp_path / "urls.txt"), "--gold", str(tmp_path / "gold.json"), "--out", str(tmp_path / "out"), "--eval", "--quiet"], spark)
    records = {r["id"]: r for r in (json.loads(x.value) for x in spark.read.text(str(tmp_path / "out" / "results.json")).collect())}
    assert records.keys() == {"d1", "d2"} and records["d1"]["entities"][0]["text"] == "банк россии"
    overall = [m for m in (json.loads(x.value) for x in spark.read.text(str(tmp_path / "out" / "eval.json")).collect())]
    assert len(overall) == 2 and all(m["entity_partial"]["tp"] == 2 and m["entity_partial"]["fn"] == 0 and m["relation"]["tp"] == 1 for m in overall)
    main(["--parsed", str(texts), "--out", str(tmp_path / "one"), "--doc", "d2", "--quiet"], spark)
    assert sorted(p.name for p in (tmp_path / "one").iterdir()) == ["d2.json", "ontology.owl", "ontology.ttl"]


def test_fetching(spark):
    def get(url):
        if "bad" in url:
            raise OSError("no route")
        if url.endswith("doc"):
            return b"one\ftwo", "application/pdf"
        return "<main>".encode() + "".join(f"<p>строка {i}</p>" for i in range(7)).encode("cp1251") + b"</main>", "text/html; charset=windows-1251"

    entries = spark.createDataFrame([("http://a/bad", "n 1", "t"), ("http://a/doc", "n/2", "t"), ("http://a/page", "n3", "t")], "url string, name string, doc_type string")
    got = {r.name: r for r in readers.fetched(entries, get, lambda b: b.decode().split("\f"), 5).collect()}
    assert (got["n_1"].status, got["n_1"].error, got["n_1"].text) == ("error", "OSError: no route", None)
    assert (got["n_2"].kind, got["n_2"].text, got["n_2"].status) == ("pdf", "one\n\ntwo", "short")
    assert (got["n3"].kind, got["n3"].status) == ("web", "ok") and got["n3"].text.startswith("строка 0\n")


def test_ratings_as_reports_show_them(spark):
    rows = spark.createDataFrame([(1, 15, 15), (8, 209, 53), (0, 0, 0)], "tp long, fp long, fn long")
    got = [(r.precision, r.recall, r.f1) for r in S.rounded(S.scored(rows)).collect()]
    assert got == [(0.062, 0.062, 0.062), (0.037, 0.131, 0.058), (0.0, 0.0, 0.0)]


def test_both_ways_of_the_rule_run_are_the_same(spark):
    """documents read in their own rows, against the way by joins and windows; the first writes one table and makes no join."""
    rng = random.Random(5)
    pieces = ["Банк России", "банк", "предоставляет", "является", "ипотечный кредит", "ИПОТЕКА", "ипотека", "Договор", "договор", "вклада", "вклад", "ПИФ", "и", "штраф", "при", ".", "! ", "?\n", "\x1f", " ", ", ", "-", "🙂"]
    texts = [None, "", *[" ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 60))) for _ in range(150)], *TEXTS.values()]
    docs = spark.createDataFrame([(i, "credit", "", t) for i, t in enumerate(texts)], "doc_id int, type string, product string, text string")
    began = written_so_far()
    one, two = P.rules(docs), None
    assert written_so_far() == began + 1
    assert not any(w in one.relations._jdf.queryExecution().executedPlan().toString() for w in ("Join", "Window"))
    two = P.rules(docs, listed_phrases=0)
    for name in ("entities", "relations", "graph"):
        a, b = getattr(one, name), getattr(two, name)
        assert set(a.columns) == set(b.columns)
        rows = sorted(map(repr, (tuple(r) for r in a.collect())))
        assert rows and rows == sorted(map(repr, (tuple(r) for r in b.select(a.columns).collect())))


def test_mentions_are_found_without_shuffling_words(spark):
    """F14 to F17: no window and no join over words; the same mentions, apart or not, as by joins."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["a", "b", "a-b", "c,", "🙂", "ж.", "\n"]) for _ in range(rng.randrange(40)))) for i in range(60)] + [(99, None)], "doc_id int, text string")
    phrases = spark.createDataFrame([("a", "X"), ("a b", "X"), ("a, b", "Y"), ("c ж a-b", "Z"), ("b a b c ж", None), ("?", "W"), ("b", "X"), ("b", "X")], "phrase string, label string")
    for found in (E.phrase_hits, E.dictionary_match):
        rows = found(docs, phrases)
        assert not any(w in rows._jdf.queryExecution().executedPlan().toString() for w in ("Join", "Window"))
        want = sorted(map(repr, (tuple(r) for r in found(docs, phrases, broadcast_rows=0).collect())))
        assert want and sorted(map(repr, (tuple(r) for r in rows.collect()))) == want
