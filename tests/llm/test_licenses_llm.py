import random

import numpy as np
import pytest

from lexweave.llm import licenses as L
from lexweave.llm.common import words_of


def brute(text, least=0.8, stretch=1.0):
    """The best share of each template's shingles in any stretch of so many times its length."""
    hashes = L.PlainWords()
    words = L.hashed(words_of(text), hashes)
    out = {}
    for name, t in L.TEMPLATES.items():
        tw = L.hashed(words_of(t), hashes)
        size = min(5, len(tw))
        want, have = set(L.runs(tw, size).tolist()), L.runs(words, size).tolist()
        best = max((len(want & set(have[i : i + int(stretch * len(want))])) for i in range(len(have))), default=0) / len(want)
        if best >= least:
            out[name] = best
    return out


def found(text):
    words = L.hashed(words_of(text), L.PlainWords())
    return {name: share for name, share, _, _ in L.matches([words], L.classes(L.TEMPLATES, 0.8, 0.999), 0.8)[0]}


def test_templates_anywhere_in_a_text():
    rng = random.Random(2)
    filler = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    for name, t in L.TEMPLATES.items():
        for _ in range(12):
            text = " ".join(filler(rng.randrange(90)) + t.upper().split() + filler(rng.randrange(90)))
            # What stands together is found, and what is found stands near enough (one license can hold most of another, with a clause between).
            assert found(text).get(name) == 1.0 and brute(text).keys() <= found(text).keys() <= brute(text, stretch=3).keys()


def test_damaged_templates():
    rng = random.Random(4)
    missed = total = 0
    for name in ("GPL-3.0-notice", "MIT-text", "Apache-2.0-header"):
        for _ in range(60):
            words = L.TEMPLATES[name].split()
            words[rng.randrange(len(words))] = "changed"
            text = " ".join([f"f{rng.randrange(10**6)}" for _ in range(rng.randrange(200))] + words + ["end"] * 3)
            want = brute(text)
            total += name in want
            missed += name in want and name not in found(text)
    assert total > 60 and missed <= 1


def test_bands_reach_the_chance():
    for c in L.classes(L.TEMPLATES, 0.8, 0.999):
        m = min(len(h) for _, h in c.templates)
        there = max(1.0, 0.8 * m - (c.step - 1))
        j = there / (m + c.window - there)
        assert 1 - (1 - j) ** c.bands >= 0.999


def test_minima_of_windows():
    x = np.random.default_rng(0).integers(0, 1000, 77).astype(np.uint64)
    for window, step in ((1, 1), (4, 1), (16, 2), (32, 4)):
        low = L.window_minima(x, window, step)
        assert [int(v) for v in low] == [int(x[i : i + window].min()) for i in range(0, 77, step)]


def test_operator(spark, odd, none):
    text = "Some words first. Released under the MIT License. All rights reserved. " + "and more words " * 10
    docs = odd.unionByName(spark.createDataFrame([(60, text, "x", 1, "k", 0.5), (61, "released\nUNDER the (mit) license", "x", 1, "k", 0.5)], odd.schema))
    got = {(r.doc_id, r.license): (r.containment, r.start_word, r.end_word) for r in L.scan(docs).collect()}
    assert got == {(60, "MIT"): (1.0, 3, 8), (60, "all-rights-reserved"): (1.0, 8, 11), (61, "MIT"): (1.0, 0, 5)}
    assert L.scan(none).count() == 0
    with pytest.raises(ValueError):
        L.scan(docs, {"x": " "})
