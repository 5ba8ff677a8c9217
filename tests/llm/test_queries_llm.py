"""The queries opN_ themselves: their columns, types and values against independent plain versions, over the smallest tables."""

import hashlib
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__
from lexweave.llm import lm, mixing, queries
from lexweave.llm.common import table
from tests.conftest import SMALL
from tests.llm.test_fingerprints_llm import likeness, units
from tests.llm.test_licenses_llm import brute as license_brute
from tests.llm.test_models_llm import plain_score, plain_url
from tests.llm.test_neardup_llm import brute
from tests.llm.test_quality_llm import plain as plain_quality
from lexweave.llm import urls


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}


def run(spark, name, types):
    df = __spark_entry__.queries()[name](spark, SMALL)
    assert dict(df.dtypes).items() >= dict(x.split(":") for x in types.split()).items()
    return df.collect()


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_every_operator_has_its_query():
    names = list(queries.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 11)) and {*names, "pipeline"} <= set(__spark_entry__.queries())


def test_op1(spark, docs):
    """The rates against a dense projected gradient in numpy from the same likelihoods, run until nothing moves."""
    rows = sorted(run(spark, "op1_soft_membership_mix", "doc_id:bigint n_tokens:bigint rate:double"), key=lambda r: r.doc_id)
    n = np.array([len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id] or "")) for r in rows], float)
    assert [r.n_tokens for r in rows] == n.tolist()
    p = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in rows])
    assert np.allclose(p.sum(axis=1), 1)
    target = np.array([queries.MIX[d] for d in mixing.DOMAINS]) * n.sum()
    rate = np.array([r.rate for r in rows])
    assert (rate >= 0).all()
    got = ((rate * n) @ p - target) / target.max()
    # Plain gradient steps, in the space in which rows are scaled by their lengths, can't come nearer.
    x = np.ones(len(n))
    step = 1 / np.linalg.norm((n[:, None] * p).T @ p, 2)
    for _ in range(20_000):
        x = np.maximum(0, x - step * (p @ ((x * n) @ p - target)))
    best = ((x * n) @ p - target) / target.max()
    assert np.abs(got).max() <= np.abs(best).max() + 1e-4


def test_op2(spark, docs):
    """Base spans by the contract's patterns, one character after the other; added ones don't touch them."""
    rows = run(spark, "op2_weak_supervision_pii", "doc_id:bigint n_email:bigint n_ip:bigint n_card:bigint n_phone:bigint base_sha256:string spans:string")
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(d := re.sub(r"\D", "", s)) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub(r"\D", "", s)) <= 15),
    )
    assert {r.doc_id for r in rows} == docs.keys()
    total = 0
    for r in rows:
        base = [(m.start(), i, m.end()) for i, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, docs[r.doc_id] or "") if ok(m[0])]
        text = [f"{kinds[k][0]}:{s}:{e}" for s, k, e in sorted(base)]
        assert r.base_sha256 == sha(",".join(text)) and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in base) for i in range(4))
        spans = [x for x in r.spans.split(",") if x]
        more = [(int(s), int(e)) for k, s, e in (x.split(":") for x in spans if x not in text)]
        assert set(text) <= set(spans) and all(e <= s or t <= b for b, e in more for s, _, t in base)
        total += len(base)
    assert total > 20


def test_op3(spark, docs):
    rows = run(spark, "op3_lsh_forest_join", "doc_id:bigint class_id:bigint n_links:bigint n_copies:bigint")
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in rows), key=str) == brute(list(docs.items()))


def test_op4(spark, docs):
    rows = run(spark, "op4_hilbert_shards", "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int")
    assert {(r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in rows} == {(k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "rows", None) for k, t in docs.items()}
    by: dict = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert by.keys() <= set(range(24)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    n = [len(by.get(s, ())) for s in range(24)]
    assert max(n) - min(n) <= 1


def test_op5(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = run(spark, "op5_prefix_table", "doc_id:bigint n_tokens:bigint ids_sha256:string decoded_sha256:string")
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), sha(library.decode(ids)))


def test_op6(spark, docs):
    rows = run(spark, "op6_masked_likelihood", "doc_id:bigint n_tokens:bigint log_likelihood:double mean_log_likelihood:double")
    want = {r.doc_id: r for r in lm.score(table(spark, SMALL, "documents").repartition(3)).collect()}
    assert len(rows) == len(docs)
    for r in rows:
        assert r.n_tokens == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id] or "")) and r.log_likelihood == pytest.approx(want[r.doc_id].log_likelihood, rel=1e-3)
        assert r.mean_log_likelihood == (pytest.approx(r.log_likelihood / r.n_tokens) if r.n_tokens else None)


def test_op7(spark, docs):
    rows = run(spark, "op7_lookup_sketch", "doc_id:bigint n_chars:bigint edited_sha256:string fingerprint:string edited_fingerprint:string near_edited:double near_next:double")
    order = sorted(docs, reverse=True)
    got, prints = {r.doc_id: r for r in rows}, {}
    assert got.keys() == docs.keys()
    for i, k in enumerate(order):
        t, n, r = docs[k] or "", docs[order[(i + 1) % len(order)]] or "", got[k]
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        assert (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) == (len(t), sha(e), likeness(units(t), units(e)), likeness(units(t), units(n)))
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint


def test_op8(spark, docs):
    rows = run(spark, "op8_license_scan", "doc_id:bigint license:string containment:double")
    found: dict = {}
    for r in rows:
        found.setdefault(r.doc_id, set()).add(r.license)
    for k, t in docs.items():
        assert license_brute(t).keys() <= found.get(k, set()) <= license_brute(t, stretch=3).keys(), k


def test_op9(spark):
    rows = {r.page_id: r for r in run(spark, "op9_url_filter", "page_id:bigint host:string path:string rule:string verdict:string")}
    pages = table(spark, SMALL, "pages").collect()
    w = urls.train(urls.labelled())
    assert len(rows) == len(pages)
    for p in pages:
        host, path, verdict, rule = plain_url(p.url)
        r = rows[p.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if (host or path) and plain_score(w, host, path) >= 0.5 else "allow"))


def test_op10(spark, docs):
    rows = run(spark, "op10_line_first", "doc_id:bigint n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint base_failed:boolean kept:boolean")
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in rows} == {k: plain_quality(t) for k, t in docs.items()}
