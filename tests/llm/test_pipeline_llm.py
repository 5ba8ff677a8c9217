"""Each stage against plain Python on its own input, and the whole."""

import hashlib
import os
import struct
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from lexweave.llm import mixing, pii, quality
from lexweave.llm.common import table
from tests.conftest import SMALL
from tests.llm.conftest import TEXTS
from tests.llm.test_neardup_llm import brute
from tests.llm.test_quality_llm import plain

STAGE = dict(corpus_pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(10_000 + i, t, None if i % 2 else "en", None, None) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    return table(spark, SMALL, "documents").unionByName(odd).cache()


def rows(df):
    return sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()), key=str)


def test_stages_are_those_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "pii", "mixing", "encoding"]


def test_quality(spark, docs):
    out = STAGE["quality"](spark, docs, SMALL)
    assert out.columns == COLUMNS
    kept = {r[0]: r for r in rows(out)}
    for r in docs.collect():
        assert (r.doc_id in kept) == plain(r.text)[-1]
        if r.doc_id in kept:
            _, text, lang, source, n = kept[r.doc_id]
            assert (lang, source, n) == (r.lang, r.source, len(text)) and set(text.split("\n")) <= set(r.text.split("\n"))
    assert 0 < len(kept) < docs.count()


def test_near_duplicates(spark, docs):
    out = STAGE["near_duplicates"](spark, docs, SMALL)
    assert out.columns == COLUMNS
    want = [k for k, c, _ in brute([(r.doc_id, r.text) for r in docs.collect()]) if k == c]
    assert sorted(r[0] for r in rows(out)) == sorted(want)
    assert set(rows(out)) <= set(rows(docs))


def test_pii(spark, docs):
    out = STAGE["pii"](spark, docs, SMALL)
    assert out.columns == COLUMNS
    seen = Counter((s[1], v, h) for r in docs.collect() for s, v, h in pii.candidates(r.text or ""))
    weights = pii.train(sorted((k, v, h, n) for (k, v, h), n in seen.items()))
    want = []
    for r in docs.collect():
        t = r.text if r.text is None else pii.masked(r.text, pii.spans(r.text, weights)[1])
        want.append((r.doc_id, t, r.lang, r.source, None if t is None else len(t)))
    assert rows(out) == sorted(want, key=str)


def test_mixing(spark, docs):
    out = STAGE["mixing"](spark, docs, SMALL)
    assert out.columns == COLUMNS
    # The same in numpy: likelihoods, targets, rates.
    all_ = docs.collect()
    model = mixing.classifier(docs, table(spark, SMALL, "labels")).astype(np.float32)
    slots = mixing.Slots()
    found = [mixing.features(r.text, slots) for r in all_]
    n, p = np.array([k for k, _ in found], float), np.array([mixing.probabilities(model, at) for _, at in found], float)
    target = (n @ p) * [corpus_pipeline.WANTED[d] for d in mixing.DOMAINS]
    rates = np.ones(len(n))
    for _ in range(60):
        on = rates > 0
        gram = (n[on, None] * p[on]).T @ p[on]
        rates = np.maximum(0, rates - p @ np.linalg.lstsq(gram + 1e-9 * gram.max() * np.eye(3), (n * rates) @ p - target, rcond=None)[0])
    # Each document as often as the rate rounded down or up; over all as many as the rates add up to, but for one of each stratum and partition.
    copies = Counter(r[0] for r in rows(out))
    assert all(abs(copies[d.doc_id] - r) < 1 for d, r in zip(all_, rates))
    strata = {(int(np.argmax(q)), int(k).bit_length()) for k, q in zip(n, p)}
    assert abs(sum(copies.values()) - rates.sum()) < len(strata) * docs.rdd.getNumPartitions()
    assert set(rows(out)) <= set(rows(docs))


def test_encoding(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in STAGE["encoding"](spark, docs, SMALL).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert got[r.doc_id].ids == ids and got[r.doc_id].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_clashing_names(spark, docs):
    """Extra columns named like those that stages make pass through with their values."""
    names = ["_n", "_key", "_digest", "_copies", "_copy", "_row", "kept", "cleaned", "n_words", "class", "labels", "p", "spans", "_text", "key", "digest"]
    some = docs.filter("doc_id < 40 OR doc_id >= 10000").selectExpr("*", *[f"concat('{n} ', coalesce(doc_id, 0)) AS `{n}`" for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, some, SMALL)
        assert out.columns == some.columns, name
        assert all(r[n] == f"{n} {r.doc_id}" for r in out.collect() for n in names), name
    assert STAGE["encoding"](spark, some, SMALL).count() == some.count()


def test_scratch_is_removed(spark):
    """After a run one stage's output is left, and that goes with the session."""
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    corpus_pipeline.run(spark, SMALL).count()
    assert len([f for f in set(os.listdir(folder)) - before if not f.startswith(".")]) == 1


def test_empty_documents(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), SMALL).count() == 0


def test_whole(spark):
    out = corpus_pipeline.run(spark, SMALL)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    judged = {r.doc_id: r.kept for r in quality.line_first(table(spark, SMALL, "documents")).collect()}
    assert ids and all(judged[i] for i in ids) and len(ids) < len(judged)
