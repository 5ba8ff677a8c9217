"""Sketches against sets of paragraphs."""

import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from lexweave.llm import fingerprints as P


def units(t):
    out, run = set(), ()
    for w in re.split(r"[\x20\x09-\x0D]+", t):
        if w:
            run += (w,)
            if xxhash.xxh64_intdigest(w.encode(), 42) % P.PARAGRAPH == 0:
                out.add(run)
                run = ()
    return frozenset(out | {run} if run else out)


def likeness(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def check(rows, got):
    """rows: (key, text) in the documents' order."""
    left = {}
    for r in got:
        left.setdefault(r.doc_id, []).append(r)
    prints = {}
    for i, (k, t) in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        want = (len(t), hashlib.sha256(e.encode()).hexdigest(), likeness(units(t), units(e)), likeness(units(t), units(n)))
        hit = [r for r in left[k] if (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) == want]
        assert hit, (k, want, left[k])
        left[k].remove(hit[0])
        assert prints.setdefault(t, hit[0].fingerprint) == hit[0].fingerprint
        assert prints.setdefault(e, hit[0].edited_fingerprint) == hit[0].edited_fingerprint
    assert not any(left.values())


def test_as_sets(spark, odd):
    more = [(200 + i, " ".join(f"Sentence {j} of {i // 2}." for j in range(i * 7))) for i in range(20)] + [(300, "a\nb\nc\nd\n" * 5), (301, "one. two. three. four."), (302, "é. ü. ñ. ß. 🙂.")]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.select("*", F.xxhash64(F.coalesce("text", F.lit(""))).alias("x")).orderBy(F.desc_nulls_last("doc_id"), "x").collect()]
    for buckets in (2, 9, 40):
        check(rows, P.versions(docs, buckets=buckets).collect())


def test_few_documents(spark, none):
    one = spark.createDataFrame([(5, "a b c d e f")], "doc_id long, text string")
    check([(5, "a b c d e f")], P.versions(one).collect())
    nulls = spark.createDataFrame([(None, "x y")], "doc_id long, text string")
    check([(None, "x y")], P.versions(nulls).collect())
    assert P.versions(none).count() == 0 and P.fingerprint(none).count() == 0


def test_native_plan(odd):
    plan = P.versions(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_peeling_fails_on_too_much_and_larger_sketches_help(spark):
    rows = spark.createDataFrame([([i * 7919 + j * 104729 for j in range(60)], [i * 7919 + j * 104729 for j in range(0, 90, 3)]) for i in range(1, 4)], "a array<long>, b array<long>")
    rows = rows.selectExpr("transform(a, x -> xxhash64(x)) a", "transform(b, x -> xxhash64(x)) b")
    small = P.peel(P.subtract(P.sketch("a", 4), P.sketch("b", 4)), 4)
    large = P.peel(P.subtract(P.sketch("a", 64), P.sketch("b", 64)), 64)
    for r in rows.selectExpr(f"{small} s", f"{large} l", f"{P.group_difference('a', 'b')} g", "size(array_except(a, b)) x", "size(array_except(b, a)) y").collect():
        assert r.s is None and tuple(r.g) == (r.x, r.y) and (r.l is None or tuple(r.l) == (r.x, r.y))


def test_fingerprint_column(odd):
    out = P.fingerprint(odd, out="key")
    assert sorted(out.columns) == sorted(odd.columns)
    same = [r.key for r in out.filter("text = 'one'").collect()]
    assert len(same) == 3 and len(set(same)) == 1


def test_a_line_less_never_changes_the_units(spark):
    lines = [" ".join(f"w{i}x{j}" for j in range(15)) for i in range(12)]
    docs = spark.createDataFrame([(n, "\n".join(lines[:n])) for n in range(2, 13)], "doc_id long, text string")
    near = {r.doc_id: r.near_next for r in P.versions(docs).collect()}
    # A line is two runs and more, of which the last goes on into the next line.
    assert all(near[n] == likeness(units("\n".join(lines[:n])), units("\n".join(lines[: n - 1]))) > (n - 2) / n - 0.1 for n in range(3, 13))


def test_keys(spark):
    with pytest.raises(ValueError, match="integer"):
        P.versions(spark.createDataFrame([("a", "x")], "doc_id string, text string"))
    ints = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id int, text string")
    out = P.versions(ints, buckets=30)
    assert dict(out.dtypes)["doc_id"] == "int" and sorted(r.doc_id for r in out.collect()) == list(range(50))
