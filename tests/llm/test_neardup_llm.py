"""The join against brute force over all pairs."""

import random
import re

import numpy as np

from lexweave.llm import neardup as N
from lexweave.llm.common import WordHashes, shingles, words_of


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        k = min(5, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    links, root = [0] * len(rows), list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least: dict = {}
    for i, (k, _) in enumerate(rows):
        t = top(i)
        if k is not None:
            least[t] = min(least.get(t, k), k)
    return sorted(((k, least.get(top(i)), links[i]) for i, (k, _) in enumerate(rows)), key=str)


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(25):
        w = [word() for _ in range(120)]
        texts.append(" ".join(w))
        for _ in range(rng.randrange(4)):
            v = list(w)
            for _ in range(rng.randrange(5)):
                v[rng.randrange(120)] = word()
            texts.append(" ".join(v))
    base = [word() for _ in range(100)]
    # A large group of near copies, dealt out over several blocks, and a large group of exact ones.
    for i in range(320):
        v = list(base)
        v[i % 100] = word()
        texts.append(" ".join(v))
    return texts + [texts[0]] * 200


def test_as_brute_force(spark, odd, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 64)
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(1000 + i, t) for i, t in enumerate(corpus())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r["class"], r.n_links) for r in N.join(docs).collect()), key=str)
    assert got == brute(rows)


def test_one_of_each_class_stays(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    docs = spark.createDataFrame([(3, a, 1), (1, a + " x", 2), (2, b, 3), (4, None, 4), (5, "", 5)], "doc_id long, text string, digest int")
    out = N.keep_one(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 4]
    again = docs.unionByName(docs)
    assert sorted(r.doc_id for r in N.keep_one(again).collect()) == [1, 2, 4]


def test_empty_table(none):
    assert N.join(none).count() == 0 and N.keep_one(none).count() == 0


def test_shortening_reaches_the_recall_at_the_least_cost():
    rng = np.random.default_rng(2)
    lost = N.miss(0.8)
    sizes = np.sort(rng.integers(1, 5000, (200, N.TREES, 3)), axis=2)[:, :, ::-1].astype(float)
    sizes[:50] = 1
    sizes[50, :, 0], sizes[50, :, 1:] = 10, 1
    sizes[51, :3], sizes[51, 3:] = 10**7, 1
    depths = N.shortened(sizes, 0.8, N.RECALL)
    assert (lost[depths].sum(axis=1) <= np.log(1 - N.RECALL)).all()
    # Sparse nodes: as short as can be. Crowded nodes of a few trees stay deep, which the others make up for.
    assert (depths[:50] == N.SHORTEST).all()
    assert (depths[51, 3:] == N.SHORTEST).all()
    crowded = sizes[51].copy()
    crowded[:3] = [10**7, 10**5, 1000]
    assert (N.shortened(crowded[None], 0.8, N.RECALL)[0, :3] == N.DEPTH).all()
    # Alike in all trees: as deep as the recall allows, that is, shallower than full depth.
    same = np.tile(np.array([3000.0, 2000.0, 1000.0]), (1, N.TREES, 1))
    assert N.SHORTEST < N.shortened(same, 0.8, N.RECALL).mean() < N.DEPTH


def test_pairs_meet_once_and_as_often_as_the_depths_say():
    rng = np.random.default_rng(4)
    own = rng.integers(0, 2, (60, 5, 4)).astype(np.uint64)
    label = sum(own[:, :, d] << np.uint64(16 * (3 - d)) for d in range(4)).astype(np.int64)
    depths = rng.integers(2, 5, (60, 5)).astype(np.int8)
    every = np.arange(60)
    met = np.zeros((60, 60), int)
    for t in range(5):
        for d in range(2, 5):
            for node in {tuple(v) for v in own[:, t, :d].tolist()}:
                below = np.array([i for i in every if tuple(own[i, t, :d]) == node and depths[i, t] >= d])
                if len(below):
                    met[np.ix_(below, below)] += N.first_meetings(label, depths, t, d, below, below)
    for i in every:
        for j in range(i):
            want = any((own[i, t, : min(depths[i, t], depths[j, t])] == own[j, t, : min(depths[i, t], depths[j, t])]).all() for t in range(5))
            assert met[i, j] == met[j, i] == want


def test_recall_of_planted_pairs(spark):
    """Recall against brute force of the pairs of every fiftieth document, most of them near the threshold."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for i in range(0, 3000, 3):
        w = [word() for _ in range(100)]
        for k in range(3):
            v = list(w)
            for at in rng.sample(range(0, 100, 6), 2 * k):
                v[at] = word()
            rows.append((i + k, " ".join(v)))
    got = {r.doc_id: r.n_links for r in N.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    asked = [(k, t) for k, t in rows if k % 50 == 0]
    want = {k: 0 for k, _ in asked}
    every = [(k, set(shingles(t.split(), WordHashes()).tolist())) for k, t in rows]
    for k, t in asked:
        a = set(shingles(t.split(), WordHashes()).tolist())
        want[k] = sum(len(a & b) >= 0.8 * len(a | b) for j, b in every if j != k)
    assert sum(want.values()) >= 40 and all(got[k] == n for k, n in want.items())


def test_large_nodes_are_dealt_out(spark, monkeypatch):
    """Several blocks of queries and of others, by depths that differ within nodes."""
    monkeypatch.setattr(N, "BLOCK", 8)
    real = N.shortened
    monkeypatch.setattr(N, "shortened", lambda sizes, s, r: np.where(np.arange(len(sizes))[:, None] % 3 > 0, real(sizes, s, r), 2).astype(np.int8))
    rows = [(i, t) for i, t in enumerate(corpus())]
    got = sorted(((r.doc_id, r["class"], r.n_links) for r in N.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)


def test_both_ways_of_verification_agree():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(30)]
    every = np.array([(i, j) for i in range(30) for j in range(i)])
    one_by_one = np.concatenate([N.linked(sets, every[i : i + 20], 0.4) for i in range(0, len(every), 20)])
    assert (N.linked(sets, every, 0.4) == one_by_one).all() and 0 < one_by_one.sum() < len(every)


def test_words_and_shingles():
    text = "a\x1cb c d\x0be  f\n"
    assert words_of(text) == re.findall(r"[^\x20\x09-\x0D]+", text)
    assert len(shingles("a b c d e f".split(), WordHashes())) == 2 and len(shingles(["a"], WordHashes())) == 1 and len(shingles([], WordHashes())) == 0


def test_components(spark):
    """A path in ascending order, one in another order, a star and a pair: one root each, in few rounds."""
    path = [(f"a{i:04d}", f"a{i + 1:04d}") for i in range(1000)]
    mixed_ = [(f"b{i * 7919 % 101:03d}", f"b{(i + 1) * 7919 % 101:03d}") for i in range(100)]
    star = [("c050", f"c{i:03d}") for i in range(100) if i != 50]
    edges = spark.createDataFrame([*path, *mixed_, *star, ("d1", "d0")], "u string, v string")
    roots: dict = {}
    for r in N.components(edges).collect():
        roots.setdefault(r.u[0], set()).add(r.root)
    assert {k: len(v) for k, v in roots.items()} == {"a": 1, "b": 1, "c": 1, "d": 1} and len(set.union(*roots.values())) == 4


def test_clashing_names(spark):
    a = " ".join(f"a{i}" for i in range(50))
    names = ["_key", "_KEY_", "_want", "_digest", "_text", "_n", "class", "labels", "key", "tree"]
    docs = spark.createDataFrame([(3, a, *["x"] * 10), (1, a + " x", *["x"] * 10)], ["doc_id", "text", *names])
    out = N.keep_one(docs)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [1]
    assert [r.doc_id for r in N.keep_one(docs.unionByName(docs)).collect()] == [1]
