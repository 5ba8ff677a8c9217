"""Quality rules: line-first cleaning, in DataFrame functions only.

Each line is tried against rules on punctuation, navigation and boilerplate. Lines that fail are
taken out, and a document that would lose too much of its text is rejected. Beside this stand the
base counts of a document (words, symbols, repeated lines and windows).

Defined results: a null or empty text has no words, fails the base rules and has a null or empty
cleaned text. Very long texts are judged whole. Repeated rows and ties are judged row by row. An empty table gives no rows. Other columns pass through; a column
of the input named like one of the results is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_chars", "n_line_chars", "cleaned"]

#: A line fails if symbols and exclamation marks make up more than this part of it.
MAX_MARKS = 0.1
#: A line with at least as many separators is navigation or a table.
MIN_BARS = 3
#: A line fails if boilerplate phrases make up at least this part of it.
MIN_BOILERPLATE = 0.1
BOILERPLATE = "(?i)(accept (all )?cookies|cookie policy|privacy policy|terms of (use|service)|all rights reserved|click here|sign up|log in|subscribe now|enable javascript|back to top|share this)"
#: A document is rejected if more than this part of its characters stands in failing lines.
MAX_LOST = 0.5

#: Up to so many different repeated windows are looked up one by one; more are found by sorting.
FEW = 16


def line_first(docs: DataFrame, text: str = "text", max_lost: float = MAX_LOST, max_marks: float = MAX_MARKS, clean: bool = True) -> DataFrame:
    """The input's columns and RESULTS (without `cleaned`, if not asked for). One expression over each row, without a shuffle.

    Values that are needed more than once are bound as lambda variables (an array of one element),
    and the generator at the top keeps the optimizer from evaluating the whole again for each
    result. Repeated windows are found by their 64-bit hashes: most texts have no more than a few, and
    only others are sorted as (hash, position).
    """
    t = f"coalesce(`{text}`, '')"

    def let(name: str, value: str, body: str) -> str:
        return f"transform(array({value}), {name} -> {body})[0]"

    # x: a line, whether it has a word, its symbols and its exclamation marks
    fails = f"(x.s + x.b > {max_marks} * length(x.l) OR length(x.l) - length(replace(x.l, '|', '')) >= {MIN_BARS} OR (rlike(x.l, '{BOILERPLATE}') AND length(x.l) - length(regexp_replace(x.l, '{BOILERPLATE}', '')) >= {MIN_BOILERPLATE} * length(x.l)))"
    seen = f"transform(split({t}, '\n'), l -> named_struct('l', l, 'w', rlike(l, '[^\\\\x20\\\\x09-\\\\x0D]'), 's', regexp_count(l, '[#*$%&|<>]'), 'b', length(l) - length(replace(l, '!', ''))))"
    # y: a line, whether it has a word, its symbols, and whether it fails
    judged = f"transform({seen}, x -> named_struct('l', x.l, 'w', x.w, 's', x.s, 'f', x.w AND {fails}))"
    # h: hashes of windows; d: those that occur at least twice; p: positions of such windows
    sorted_ = "array_sort(transform(h, (x, i) -> struct(x AS h, i AS i)))"
    many = let("s", sorted_, "sort_array(transform(filter(s, (x, k) -> coalesce(get(s, k - 1).h = x.h, false) OR coalesce(get(s, k + 1).h = x.h, false)), x -> x.i))")
    few = "filter(sequence(0, size(h) - 1), i -> array_contains(d, h[i]))"
    covered = let("p", f"IF(size(d) <= {FEW}, {few}, {many})", "aggregate(p, struct(0 AS e, 0L AS c), (a, i) -> struct(i + 3 AS e, a.c + i + 3 - greatest(a.e, i) AS c)).c")
    twice = let("s", "sort_array(h)", "array_distinct(filter(s, (x, k) -> coalesce(get(s, k - 1) = x, false)))")
    repeats = let("h", "transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))", f"IF(size(array_distinct(h)) = size(h), 0L, {let('d', twice, covered)})")
    words = let("w", f"array_remove(split({t}, '[\\\\x20\\\\x09-\\\\x0D]+'), '')", f"named_struct('n', size(w), 'c', aggregate(w, 0L, (a, v) -> a + length(v)), 'r', IF(size(w) < 3, 0L, {repeats}))")
    lines = let("y", judged, f"""named_struct(
        's', aggregate(y, 0L, (a, x) -> a + x.s),
        'd', {let("r", "transform(filter(y, x -> x.w), x -> x.l)", "size(r) - size(array_distinct(r))")},
        'a', aggregate(y, 0L, (a, x) -> IF(x.w, a + length(x.l), a)),
        'lost', aggregate(y, 0L, (a, x) -> IF(x.f, a + length(x.l), a)),
        'cleaned', {"array_join(transform(filter(y, x -> NOT x.f), x -> x.l), chr(10))" if clean else "NULL"})""")
    base = "q.n < 50 OR 100 * q.r > 50 * q.n"
    results = let("q", words, let("j", lines, f"""named_struct(
        'n_words', bigint(q.n), 'word_chars', q.c, 'n_symbols', j.s, 'n_dup_lines', bigint(j.d), 'n_repeat_words', q.r,
        'base_failed', {base}, 'kept', NOT ({base}) AND j.lost <= {max_lost} * j.a,
        'n_lost_chars', j.lost, 'n_line_chars', j.a{f", 'cleaned', IF(`{text}` IS NULL, NULL, j.cleaned)" if clean else ""})"""))
    kept = [f"`{c}`" for c in docs.columns if c not in RESULTS]
    return docs.selectExpr(*kept, f"inline_outer(array({results}))")


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM dup) GROUP BY rid),
ln AS (SELECT rid, l, length(l) AS c, length(l) - length(translate(l, '#*$%&|<>!', '')) AS marks,
              length(l) - length(replace(l, '|', '')) AS bars, len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) AS nw
       FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d)),
lines AS (SELECT rid, count(*) - count(DISTINCT l) AS n_dup, sum(c) AS all_chars,
                 sum(CASE WHEN marks > {MAX_MARKS} * c OR bars >= {MIN_BARS} OR (c - length(regexp_replace(l, '{BOILERPLATE}', '', 'g')) >= {MIN_BOILERPLATE} * c) THEN c ELSE 0 END) AS lost
          FROM ln WHERE nw > 0 GROUP BY rid),
base AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
                CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
                CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
                CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
                coalesce(lost, 0) AS lost, coalesce(all_chars, 0) AS all_chars
         FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= {MAX_LOST} * all_chars AS kept
FROM base
"""
