"""Line-first rules against plain Python."""

import re

from lexweave.llm import quality as Q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen: dict = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    repeats = len({j for i, w in enumerate(windows) if seen[w] > 1 for j in (i, i + 1, i + 2)})
    lost = sum(len(x) for x in lines if sum(x.count(c) for c in "#*$%&|<>!") > Q.MAX_MARKS * len(x) or x.count("|") >= Q.MIN_BARS or (re.search(Q.BOILERPLATE, x) and len(x) - len(re.sub(Q.BOILERPLATE, "", x)) >= Q.MIN_BOILERPLATE * len(x)))
    failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeats, failed, not failed and lost <= Q.MAX_LOST * sum(map(len, lines))


def test_as_defined(spark, odd):
    extra = ["a b c a b c d\nx | y | z | w\nAll rights reserved.\n\nx | y | z | w\n" + " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(70)) + "\nv1 v2 v3 v4", " ".join(f"r{i % 30}" for i in range(100)),
             "Click here to sign up, log in and accept cookies. " * 9 + "\n" + " ".join(f"u{i}" for i in range(60)), " ".join(f"t{i}" for i in range(90)) + " click here " + " ".join(f"q{i}" for i in range(60))]
    docs = odd.select("doc_id", "text", "kept").unionByName(spark.createDataFrame([(100 + i, t, "k") for i, t in enumerate(extra)], "doc_id long, text string, kept string"))
    got = Q.line_first(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == plain(r.text), r.doc_id
    cleaned = {r.doc_id: r.cleaned for r in got}
    assert cleaned[0] is None and cleaned[100].split("\n")[0] == "a b c a b c d" and "|" not in cleaned[100] and "rights" not in cleaned[100]


def test_empty_table_and_plan(none):
    out = Q.line_first(none)
    assert out.count() == 0 and set(Q.RESULTS) <= set(out.columns)
    plan = out._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan
