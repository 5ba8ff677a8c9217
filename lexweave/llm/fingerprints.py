"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, in DataFrame functions only.

A text's paragraphs are runs of its words, whatever its length: a run ends with a word whose hash is divisible by
PARAGRAPH, or with the text. So the cuts depend on the words alone, a run has as many words on average, and an edit
changes the runs that it touches and no others. The set of the runs' 64-bit digests is what is sketched.

A sketch has three tables of cells; a digest goes into one cell of each, which keeps the
number, the xor of the digests, and the xor of their check values. The difference of two sketches, cell by
cell, is the sketch of the two sets' difference. It is peeled: a cell with one digest (its check value
shows that) gives that digest away, which is then taken out of its cells in all tables, until nothing is left.

The fingerprint is the sketch with 4 cells a table, for any text. When the difference of two fingerprints
can't be peeled, larger sketches are tried: first the digests are dealt to as many groups as keep the
differences of each small, with a sketch of 4 cells a table for each group, then groups that
fail are tried again with 8, 32 and 1024 cells a table. (Beyond that, the sets themselves are subtracted; with
a few digests in a group this has no practical chance to happen.) Groups are dealt in four steps, so the work
for n digests grows as n to the power 1.25, and the result is exact: the number of digests on either side.

The likeness of two texts is that of Jaccard, from the sizes and the peeled differences; of two empty sets it is 1.

Defined results: a null text is as the empty one, whose set is empty; very long texts are sketched whole. Documents
follow each other by descending key, the first after the last; null keys come last, rows with the same key by their
text. The key must be an integer. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = 4
#: Words of a paragraph on average, a power of two.
PARAGRAPH = 8
RETRIES = (4, 8, 32, 1024)
#: Digests of both sides in a group, about.
IN_GROUP = 3
#: Rounds of peeling; each takes out all digests that are alone in a cell.
ROUNDS = 8
#: Steps in which digests are dealt to groups.
STEPS = 4


def let(name: str, value: str, body: str) -> str:
    """SQL that evaluates `value` once, for a body that uses it often."""
    return f"transform(array({value}), {name} -> {body})[0]"


def digests(text: str) -> str:
    """The set of a text's paragraph digests, an array of longs."""
    words = f"array_remove(split({text}, '[\\\\x20\\\\x09-\\\\x0D]+'), '')"
    ends = f"filter(sequence(1, size(w)), i -> i = size(w) OR (xxhash64(w[i - 1]) & {PARAGRAPH - 1}) = 0)"
    runs = let("e", ends, "array_distinct(transform(e, (x, i) -> xxhash64(IF(i = 0, slice(w, 1, x), slice(w, e[i - 1] + 1, x - e[i - 1])))))")
    return let("w", words, f"IF(size(w) = 0, cast(array() AS array<bigint>), {runs})")


def place(k: str, cells: int, c: int | str) -> str:
    """Whether digest k goes into cell c of 3 * cells: its place in each table comes from bits of its own."""
    if isinstance(c, int):
        return f"(shiftrightunsigned({k}, {12 * (c // cells)}) & {cells - 1}L) = {c % cells}L"
    return f"(shiftrightunsigned({k}, int(12 * ({c} div {cells}))) & {cells - 1}) = {c} % {cells}"


def each_cell(cells: int, body) -> str:
    """An array of body(c) for each of 3 * cells cells; a few cells are written out, so that nothing but the digests is computed with."""
    if cells <= 2 * CELLS:
        return f"array({', '.join(body(c) for c in range(3 * cells))})"
    return f"transform(sequence(0, {3 * cells - 1}), c -> {body('c')})"


EMPTY = "named_struct('n', 0, 'x', 0L, 'h', 0)"


def sketch(keys: str, cells: int) -> str:
    """The cells of a set."""
    return each_cell(cells, lambda c: f"aggregate(filter({keys}, k -> {place('k', cells, c)}), {EMPTY}, (z, k) -> named_struct('n', z.n + 1, 'x', z.x ^ k, 'h', z.h ^ hash(k)))")


def difference_sketch(a: str, b: str, cells: int) -> str:
    """The sketch of a less the sketch of b: b's digests are subtracted from the cells straight away."""

    def cell(c) -> str:
        there = f"aggregate(filter({a}, k -> {place('k', cells, c)}), {EMPTY}, (z, k) -> named_struct('n', z.n + 1, 'x', z.x ^ k, 'h', z.h ^ hash(k)))"
        return f"aggregate(filter({b}, k -> {place('k', cells, c)}), {there}, (z, k) -> named_struct('n', z.n - 1, 'x', z.x ^ k, 'h', z.h ^ hash(k)))"

    return each_cell(cells, cell)


def peel(difference: str, cells: int) -> str:
    """(a, b): the numbers of digests on either side of a difference of sketches; null if it can't be peeled.

    If the digests that are alone in some cell add up to the whole of the first table - number, digests and check values -
    they are all there are, and no cell needs to be changed; otherwise they are taken out in rounds."""

    def alone(c: str) -> str:
        return f"array_distinct(transform(filter({c}, z -> abs(z.n) = 1 AND hash(z.x) = z.h), z -> named_struct('n', z.n, 'x', z.x)))"

    def counts(of: str, sign: str) -> str:
        return f"size(filter({of}, k -> k.n {sign} 0))"

    none = EMPTY
    whole = f"aggregate(slice(m, 1, {cells}), {none}, (y, z) -> named_struct('n', y.n + z.n, 'x', y.x ^ z.x, 'h', y.h ^ z.h))"
    summed = f"aggregate(o, {none}, (y, k) -> named_struct('n', y.n + k.n, 'x', y.x ^ k.x, 'h', y.h ^ hash(k.x)))"
    out = f"transform(t.c, (z, c) -> aggregate(filter(o, k -> {place('k.x', cells, 'c')}), z, (y, k) -> named_struct('n', y.n - k.n, 'x', y.x ^ k.x, 'h', y.h ^ hash(k.x))))"
    round_ = let("o", alone("t.c"), f"IF(size(o) = 0, t, named_struct('c', {out}, 'a', t.a + {counts('o', '>')}, 'b', t.b + {counts('o', '<')}))")
    rounds = f"aggregate(sequence(1, {ROUNDS}), named_struct('c', m, 'a', 0, 'b', 0), (t, r) -> {round_})"
    slow = let("e", rounds, "IF(exists(e.c, z -> z.n != 0 OR z.x != 0L OR z.h != 0), NULL, named_struct('a', e.a, 'b', e.b))")
    quick = let("o", alone("m"), f"IF(size(o) = 0, IF(exists(m, z -> z.n != 0 OR z.x != 0L OR z.h != 0), NULL, named_struct('a', 0, 'b', 0)), IF({whole} = {summed}, named_struct('a', {counts('o', '>')}, 'b', {counts('o', '<')}), {slow}))")
    return let("m", difference, quick)


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (p, q) -> named_struct('n', p.n - q.n, 'x', p.x ^ q.x, 'h', p.h ^ q.h))"


def group_difference(a: str, b: str) -> str:
    """(a, b) for the sets of a group, by larger sketches one after the other."""
    tries = [peel(difference_sketch(a, b, n), n) for n in RETRIES]
    exact = f"named_struct('a', size(array_except({a}, {b})), 'b', size(array_except({b}, {a})))"
    return f"coalesce({', '.join(tries)}, {exact})"


def difference(a: str, b: str, fa: str, fb: str) -> str:
    """(a, b) for two sets with their fingerprints' cells: by these, or by sketches of groups.

    Groups go by a digest's top bits, in STEPS steps, each of which deals every group of the one before to about as many."""
    total = "(s, d) -> named_struct('a', s.a + d.a, 'b', s.b + d.b)"
    none = "named_struct('a', 0, 'b', 0)"

    def dealt(of: tuple[str, str], name: str, low: str, mask: str) -> str:
        """The digests of both sets of `of` whose bits from `low` on, under `mask`, are `name`."""
        return "named_struct({})".format(", ".join(f"'{x}', filter({y}, k -> (shiftrightunsigned(k, {low}) & {mask}) = {name})" for x, y in zip("ab", of)))

    def steps(of: tuple[str, str], level: int) -> str:
        """The sum over the groups, of which the last STEPS - level steps are still to be dealt."""
        if level == STEPS:
            return group_difference(*of)
        i, f, low, mask = (f"{x}{level}" for x in ("i", "f", "low", "mask"))
        inner = let(f, dealt(of, i, low, mask), steps((f"{f}.a", f"{f}.b"), level + 1))
        groups = f"aggregate(transform(sequence(0L, {mask}), {i} -> {inner}), {none}, {total})"
        bits = f"int(w * {level + 1} div {STEPS} - w * {level} div {STEPS})"
        return let(low, f"36 + int(w * {level} div {STEPS})", let(mask, f"shiftleft(1L, {bits}) - 1", groups))

    bits = f"least(26, greatest(0, int(ceil(log2((size({a}) + size({b}) + 1) / {IN_GROUP}.0D)))))"
    return f"coalesce({peel(subtract(fa, fb), CELLS)}, {let('w', bits, steps((a, b), 0))})"


def likeness(a: str, b: str, d: str) -> str:
    return f"IF(size({a}) = 0 AND size({b}) = 0, 1.0D, double(size({a}) - {d}.a) / double(size({a}) + {d}.b))"


def written(cells: str, keys: str) -> str:
    """A sketch as text: the size of the set, then count, digests and check values of each cell in hexadecimal."""
    return f"concat(hex(size({keys})), ':', array_join(transform({cells}, z -> concat(hex(z.n), '.', hex(z.x), '.', hex(z.h))), ','))"


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of `text` in a column `out`, which replaces one of that name."""
    keys = digests(f"coalesce(`{text}`, '')")
    made = let("a", keys, written(sketch("a", CELLS), "a"))
    return docs.select(*[f"`{c}`" for c in docs.columns if c != out], F.expr(made).alias(out))


def with_next(docs: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """_key, _text and _next, the text of the document that follows by descending key, with the sets and sketches of both
    (_own and _other: k, f), which are made once for a text.

    Quantiles of the keys, some of the keys themselves, bound buckets of about equal numbers of rows; the row
    that a bucket needs from the one below is that with the bound as key, and goes to both. So each text is moved
    once and no task gets more than its buckets.
    """
    kind = docs.schema[key].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError(f"the key {key} must be an integer")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    found = rows.agg(F.percentile_approx("_key", [i / buckets for i in range(1, buckets)], 20 * buckets).alias("q"), F.max("_key").alias("top")).first()
    bounds, top = sorted(set(found.q or [])), found.top
    if bounds and bounds[-1] == top:
        bounds.pop()
    # Bucket i holds the keys up to bound i and over bound i - 1. Its own rows are no ghosts; the row of bound i
    # comes into bucket i + 1 as the last there, and the row with the greatest key into the lowest.
    # A key's bucket is looked up in two steps, each over about the root of the number of bounds.
    step = max(1, math.isqrt(len(bounds)))
    runs = [bounds[i : i + step] for i in range(0, len(bounds), step)]

    def longs(of: list[int]) -> str:
        return "array(" + ",".join(f"{b}L" for b in of) + ")" if of else "cast(array() AS array<bigint>)"

    at = f"size(filter({longs([r[-1] for r in runs])}, b -> b < _key))"
    rest = f"coalesce(get(array({','.join(map(longs, runs))}), r), cast(array() AS array<bigint>))" if runs else longs([])
    place = let("r", at, let("v", rest, f"named_struct('b', least(r * {step}, {len(bounds)}) + size(filter(v, b -> b < _key)), 'bound', array_contains(v, _key))"))
    own = "named_struct('b', p.b, 'g', 0)"
    ghosts = f"array(IF(p.bound, named_struct('b', p.b + 1, 'g', 1), NULL), IF(_key = {top if top is not None else 'NULL'}, named_struct('b', 0, 'g', 2), NULL), IF(_key IS NULL AND {str(top is None).lower()}, named_struct('b', 0, 'g', 2), NULL))"
    placed = f"IF(_key IS NULL, named_struct('b', 0, 'bound', false), {place})"
    dealt = rows.selectExpr("_key", "_text", "inline(" + let("p", placed, f"concat(array({own}), filter({ghosts}, v -> v IS NOT NULL))") + ")")
    # By descending key, nulls last, then ghosts: first that of the bound, then that of the greatest key.
    order = Window.partitionBy("b").orderBy("g", F.col("_key").desc_nulls_last(), F.xxhash64("_text"), "_text")
    made = let("a", digests("_text"), f"named_struct('k', a, 'f', {sketch('a', CELLS)})")
    # Dealt out first, so that texts move and not what is made of them.
    dealt = dealt.repartition("b").withColumn("_own", F.expr(made))
    dealt = dealt.withColumn("_next", F.lead("_text").over(order)).withColumn("_other", F.lead("_own").over(order)).filter("g = 0")
    return dealt.select("_key", "_text", F.coalesce("_next", "_text").alias("_next"), "_own", F.coalesce("_other", "_own").alias("_other"))


def versions(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and the numbers of
    paragraphs that differ, for each document, its edited text and the next document.

    The edited text has the last half of the characters replaced by the first as many of the next document's text.
    """
    if buckets is None:
        buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs, key, text, buckets).selectExpr("*", "length(_text) AS _n")
    rows = rows.selectExpr("_key", "_n", "_own", "_other", "concat(substring(_text, 1, _n - _n div 2), substring(_next, 1, _n div 2)) AS _edited")
    # The names must not be those that the parts use for themselves.
    keys = f"'a', _own.k, 'b', {digests('_edited')}, 'c', _other.k"
    sketches = f"'a', _own.f, 'b', {sketch('sets.b', CELLS)}, 'c', _other.f"
    differ = ", ".join(f"'{n}', {difference('sets.a', f'sets.{n}', 'made.a', f'made.{n}')}" for n in "bc")
    result = f"""named_struct('fingerprint', {written('made.a', 'sets.a')}, 'edited_fingerprint', {written('made.b', 'sets.b')},
        'near_edited', {likeness('sets.a', 'sets.b', 'differ.b')}, 'near_next', {likeness('sets.a', 'sets.c', 'differ.c')},
        'n_removed', differ.b.a, 'n_added', differ.b.b)"""
    made = let("sets", f"named_struct({keys})", let("made", f"named_struct({sketches})", let("differ", f"named_struct({differ})", result)))
    return rows.selectExpr(f"cast(_key AS {docs.schema[key].dataType.simpleString()}) AS `{key}`", "bigint(_n) AS n_chars", "sha2(_edited, 256) AS edited_sha256", f"inline_outer(array({made}))")
