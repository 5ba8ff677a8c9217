"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Documents are sets of shingles of five words. Each of TREES trees labels a set with DEPTH min-hash values of 16 bits; the label,
an integer, sorts as the trie of its values does, and two sets match in a tree as deep as their labels share a prefix. A trie
is held as the table of its nodes - tree, depth, prefix, number of sets below -, made from the labels sorted by tree; nodes with a single set are left out.

Each set starts with its matched prefixes at full depth in all trees. They are shortened, those first that bring the fewest further candidates for
what they add to the chance of a meeting, until a pair at the threshold is missed with a chance of 1 - recall at most. So a
set in a crowded node, such as one with a common passage, stays deep in that tree and makes up for it in others, and a set whose nodes are
sparse goes as short as SHORTEST for nothing. The candidates of a set are those in its nodes at these depths. A pair is handled in the first tree in which either set meets
the other so, and its similarity is then computed from the whole sets.

Equal sets are one class with one representative throughout, so copies cost nothing. The links of
a document are the other documents, copies included, whose similarity reaches the threshold; its
class is its component under links, named by the least key in it. Nothing emits the pairs of a
group: a task hands on the number of links of each member and a spanning forest. A node of more than
BLOCK members is dealt out as pairs of blocks.

Defined results: a text of one to four words is one shingle; a text without words, or null, has
the empty set, and empty sets equal one another only. Very long texts are hashed whole, a slab at a time. Ties: of rows alike in key and set keep_one() leaves one. Rows with the same key are documents of their
own; a class without any key that isn't null is named null. An empty table gives no rows. Other columns are not read by join() and
pass through keep_one(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import SIMILARITY, WordHashes, fresh_name, groups, materialize, mixed, rowwise, shingles, words_of

TREES = 24
#: Values of a label: four of 16 bits fill an integer.
DEPTH, BITS = 4, 16
#: No prefix is shortened beyond this depth; it must reach the recall in all trees together.
SHORTEST = 2
#: Of pairs right at the threshold, so many are met at least; above it the chance is still better.
RECALL = 1 - 1e-7
#: Members of a node that a task holds at once are at most twice so many.
BLOCK = 512
#: Shingles handled at once when min-hashing and counting common ones; bounds memory for long texts.
SLAB = 1024


def labels(h: np.ndarray, seeds: tuple[np.ndarray, np.ndarray], trees: int) -> np.ndarray:
    """The trees' labels of a set of shingle hashes: 16 bits of each min-hash value, the first the highest."""
    add, times = seeds
    x = (h >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(add), np.uint32(2**32 - 1))
    for i in range(0, len(x), SLAB):
        part = x[None, i : i + SLAB] ^ add[:, None]
        part *= times[:, None]
        least = np.minimum(least, part.min(axis=1))
    values = (mixed(least.astype(np.uint64)) >> np.uint64(64 - BITS)).reshape(trees, DEPTH)
    out = np.zeros(trees, np.uint64)
    for d in range(DEPTH):
        out = (out << np.uint64(BITS)) | values[:, d]
    return out


def seeds_for(trees: int) -> tuple[np.ndarray, np.ndarray]:
    s = mixed(np.arange(1, 2 * trees * DEPTH + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    s = (s >> np.uint64(32)).astype(np.uint32)
    return s[::2], s[1::2] | np.uint32(1)


def signatures(docs: DataFrame, key: str, text: str, trees: int) -> DataFrame:
    """key, digest (of the shingle set) and the trees' labels of each document."""
    seeds = seeds_for(trees)

    def start():
        hashes = WordHashes()

        def run(texts: list) -> list:
            digests, found = [], []
            for t in texts:
                h = np.unique(shingles(words_of(t), hashes))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                found.append(labels(h, seeds, trees).astype(np.int64) if len(h) else None)
            return [digests, found]

        return run

    return rowwise(docs, key, text, "digest binary, labels array<long>", start, "key")


def miss(similarity: float) -> np.ndarray:
    """Logarithm of the chance that a pair of this similarity doesn't share a prefix of 0, 1, ... DEPTH values in a tree."""
    return np.log(np.maximum(1 - similarity ** np.arange(DEPTH + 1.0), 1e-300))


def shortened(sizes: np.ndarray, similarity: float, recall: float) -> np.ndarray:
    """The depths to which prefixes are shortened, for an array (sets, trees, DEPTH + 1 - SHORTEST) of the sizes of their nodes at
    depths SHORTEST to DEPTH.

    A price for a missed chance is raised step by step, and each tree goes to the depth at which the node's size and that price together are
    the least, until the chance of a miss over all trees is small enough. What that leaves over is spent on going deeper again, in those
    trees first where it saves most."""
    lost = miss(similarity)[SHORTEST:]
    goal = np.log(1 - recall)
    others = np.maximum(sizes - 1.0, 0.0)
    out = np.zeros(sizes.shape[:2], np.int64)
    open_ = np.arange(len(sizes))
    for price in np.append(0.0, 2.0 ** np.arange(-4, 44)):
        # Of depths that cost the same, the shorter one.
        best = np.argmin(others[open_] + price * (lost - lost[0]), axis=2)
        enough = lost[best].sum(axis=1) <= goal
        out[open_[enough]] = best[enough]
        open_ = open_[~enough]
        if not len(open_):
            break
    every = np.arange(len(sizes))
    now = np.take_along_axis(others, out[:, :, None], 2)[:, :, 0]
    order = np.argsort(others[:, :, -1] - now, axis=1, kind="stable")
    left = goal - lost[out].sum(axis=1)
    for tree in order.T:
        for d in range(len(lost) - 1, 0, -1):
            at, more = out[every, tree], lost[d] - lost[out[every, tree]]
            deeper = (d > at) & (more <= left) & (others[every, tree, d] < others[every, tree, at])
            left = np.where(deeper, left - more, left)
            out[every, tree] = np.where(deeper, d, at)
    return (out + SHORTEST).astype(np.int8)


def first_meetings(own: np.ndarray, depths: np.ndarray, tree: int, depth: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Which pairs of a node meet here and have not met in an earlier tree: a matrix of rows by columns, given as places among the members,
    whose labels and depths these are. Two sets meet in a tree if their labels share a prefix of the shorter one's depth."""
    x = own.view(np.uint64)
    out = np.empty((len(rows), len(cols)), bool)
    step = max(1, 500_000 // max(1, len(cols) * max(1, tree)))
    for lo in range(0, len(rows), step):
        r = rows[lo : lo + step]
        here = np.minimum(depths[r, tree][:, None], depths[cols, tree][None, :]) == depth
        if tree:
            least = np.minimum(depths[r, None, :tree], depths[None, cols, :tree])
            differ = (x[r, None, :tree] ^ x[None, cols, :tree]) >> ((DEPTH - least.astype(np.uint64)) * np.uint64(BITS))
            here &= (differ != 0).all(axis=2)
        out[lo : lo + step] = here
    return out


def linked(sets: list[np.ndarray], pairs: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the pairs (an array of two columns) reach the similarity, exactly. Few pairs are intersected one by
    one; for many, common shingles are counted by products of slabs of the incidence matrix."""
    sizes = np.array([len(s) for s in sets])
    if len(pairs) <= 2 * len(sets):
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs])
    else:
        all_ = np.concatenate(sets)
        values, column = np.unique(all_, return_inverse=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for lo in range(0, len(values), SLAB):
            i, j = np.searchsorted(column, [lo, lo + SLAB])
            slab = np.zeros((len(sets), min(SLAB, len(values) - lo)), np.float32)
            slab[row[i:j], column[i:j] - lo] = 1
            both += slab @ slab.T
        common = both[pairs[:, 0], pairs[:, 1]].astype(np.int64)
    return common >= similarity * (sizes[pairs[:, 0]] + sizes[pairs[:, 1]] - common) - 1e-9


def nodes(reps: DataFrame, trees: int, similarity: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """First: tree, depth, node (the prefix), digest, query, queries, others. These are the nodes to which sets are shortened: each such set, a query,
    and the others below, which stay deeper in this tree, with the numbers of both. Second: digest and depths, a byte for each tree."""
    if miss(similarity)[SHORTEST] * trees > np.log(1 - recall):
        raise ValueError("so high a recall at so low a similarity needs more trees")
    entries = reps.select("digest", F.posexplode("labels").alias("tree", "label"))
    prefix = [F.shiftrightunsigned("label", BITS * (DEPTH - d)) for d in range(SHORTEST, DEPTH + 1)]
    top = entries.groupBy("tree", prefix[0].alias("p")).agg(F.count("*").alias("m")).filter("m > 1")
    near = entries.withColumn("p", prefix[0]).join(top, ["tree", "p"])
    near = materialize(near.select("digest", "tree", "label", F.col("m").alias("m0")))
    # The sizes of the deeper nodes, of what is left.
    sized = near
    below = near.groupBy("tree", "label").agg(F.count("*").alias("m"))
    for i in range(1, len(prefix)):
        found = below.groupBy("tree", prefix[i].alias("p")).agg(F.sum("m").alias(f"m{i}"))
        sized = sized.withColumn("p", prefix[i]).join(found, ["tree", "p"]).drop("p")
    names = [f"m{i}" for i in range(len(prefix))]
    # A flat array of (tree, sizes) for each set, with as many entries as there are trees at most.
    each = sized.groupBy("digest").agg(F.flatten(F.collect_list(F.array(F.col("tree").cast("long"), *names))).alias("at"))

    @F.pandas_udf("binary")
    def chosen(at: pd.Series) -> pd.Series:
        sizes = np.ones((len(at), trees, len(names)))
        for k, found in enumerate(at):
            found = np.asarray(found, np.int64).reshape(-1, 1 + len(names))
            sizes[k, found[:, 0]] = found[:, 1:]
        return pd.Series([d.tobytes() for d in shortened(sizes, similarity, recall)])

    depths = materialize(each.select("digest", chosen("at").alias("depths")))
    entries = near.select("digest", "tree", "label").join(depths, "digest")
    depth = F.conv(F.hex(F.substring("depths", F.col("tree") + 1, 1)), 16, 10).cast("int")
    entries = entries.withColumn("end", depth).withColumn("depth", F.explode(F.sequence(F.lit(SHORTEST), depth)))
    at = F.expr(f"shiftrightunsigned(label, {BITS} * ({DEPTH} - depth))")
    entries = materialize(entries.select("tree", "depth", at.alias("node"), (F.col("depth") == F.col("end")).alias("query"), "digest"))
    asked = F.count_if("query")
    used = entries.groupBy("tree", "depth", "node").agg(asked.alias("queries"), (F.count("*") - asked).alias("others")).filter("queries > 0 AND queries + others > 1")
    return entries.join(used, ["tree", "depth", "node"]), depths


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """key, digest, class, n_links and n_copies of each document.

    Shuffles: the signatures once by digest and once by node, members of nodes that hold a new
    pair, and the texts of the representatives in those. A cluster's size bounds no task.
    """
    signed = materialize(signatures(docs, key, text, trees))
    # One representative for each set; its labels are those of any member.
    reps = signed.filter("labels IS NOT NULL").groupBy("digest").agg(F.count("*").alias("n"), F.first("labels").alias("labels"))
    reps = materialize(reps)
    members, depths = nodes(reps, trees, similarity, recall)

    # A node's queries meet each other and the others. Small nodes are one task (kind 0); else blocks of queries meet in pairs (kind 0: a member
    # of block i goes to all (i, j) and (j, i), once each), and with each block of the others (kind 1). So others aren't paired among themselves.
    small = f"(queries + others <= {BLOCK})"
    members = members.selectExpr("tree", "depth", "node", "digest", f"query OR {small} AS query", f"IF({small}, 1, int(ceil(queries / {BLOCK}))) AS kq", f"IF({small}, 0, int(ceil(others / {BLOCK}))) AS ko")
    members = members.selectExpr("*", "int(pmod(xxhash64(digest), IF(query, kq, ko))) AS i")
    pairs_ = "transform(sequence(0, kq - 1), j -> named_struct('kind', 0, 'a', least(i, j), 'b', greatest(i, j)))"
    across = "transform(sequence(0, ko - 1), j -> named_struct('kind', 1, 'a', i, 'b', j))"
    tasks = f"IF(query, IF(ko = 0, {pairs_}, concat({pairs_}, {across})), transform(sequence(0, kq - 1), j -> named_struct('kind', 1, 'a', j, 'b', i)))"
    task = ["tree", "depth", "node", "kind", "a", "b"]
    dealt = members.selectExpr("tree", "depth", "node", "query", "i", "digest", f"inline({tasks})")
    dealt = dealt.join(depths.join(reps.select("digest", "labels"), "digest"), "digest").repartition(*task).sortWithinPartitions(*task)

    def meetings(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, cols, same = sides(g)
        depths = np.frombuffer(b"".join(g["depths"]), np.int8).reshape(len(g), -1)
        found = first_meetings(np.stack(g["labels"].to_numpy()), depths, int(g["tree"].iat[0]), int(g["depth"].iat[0]), rows, cols)
        return rows, cols, np.triu(found, 1) if same else found

    def new_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Members with a pair that meets here first."""
        out, held = [], 0
        for g in groups(batches, task):
            rows, cols, fresh = meetings(g)
            hit = np.union1d(rows[fresh.any(axis=1)], cols[fresh.any(axis=0)])
            if len(hit):
                out.append(g.iloc[hit])
                held += len(hit)
            if held > 5000:
                yield pd.concat(out, ignore_index=True)
                out, held = [], 0
        if out:
            yield pd.concat(out, ignore_index=True)

    fields = "tree int, depth int, node long, kind int, a int, b int, i int, query boolean, digest binary, labels array<long>, depths binary"
    fresh = materialize(dealt.select(*task, "i", "query", "digest", "labels", "depths").mapInPandas(new_members, fields))
    # The text of one document of each set that is needed stands for its set.
    # All documents of a set are candidates for that; the least key is taken, for the same text each time.
    wanted = fresh.select("digest").distinct()
    chosen = signed.groupBy("digest").agg(F.min("key").alias("key"), F.count("*").alias("n")).join(wanted, "digest")
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    texts = set_texts(texts, chosen)
    full = fresh.join(texts, "digest").repartition(*task).sortWithinPartitions(*task)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        out, held = [], 0
        for g in groups(batches, task):
            rows, cols, new = meetings(g)
            x, y = np.nonzero(new)
            pairs = np.stack([rows[x], cols[y]], axis=1)
            if not len(pairs):
                continue
            sets = [np.unique(shingles(words_of(t), hashes)) for t in g["text"]]
            pairs = pairs[linked(sets, pairs, similarity)]
            if not len(pairs):
                continue
            n, digests = g["n"].to_numpy(), g["digest"].to_numpy()
            links = np.bincount(pairs[:, 0], n[pairs[:, 1]], len(g)) + np.bincount(pairs[:, 1], n[pairs[:, 0]], len(g))
            at = np.flatnonzero(links)
            roots = forest(pairs, len(g))
            out.append(pd.DataFrame({"digest": digests[at], "links": links[at].astype(np.int64), "root": digests[roots[at]]}))
            held += len(at)
            if held > 5000:
                yield pd.concat(out, ignore_index=True)
                out, held = [], 0
        if out:
            yield pd.concat(out, ignore_index=True)

    found = materialize(full.select(*task, "i", "query", "digest", "labels", "depths", "n", "text").mapInPandas(verify, "digest binary, links long, root binary"))
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    component = components(found.select(F.col("digest").alias("u"), F.col("root").alias("v")).filter("u <> v").distinct())
    # What has no link to another text is left out above: a class of its own.
    sets = signed.groupBy("digest").agg(F.min("key").alias("least"), F.count("*").alias("copies"))
    sets = sets.join(links, "digest", "left").join(component.withColumnRenamed("u", "digest"), "digest", "left")
    sets = materialize(sets.withColumn("root", F.coalesce("root", "digest")))
    named = sets.filter("links IS NOT NULL").groupBy("root").agg(F.min("least").alias("class"))
    sets = sets.join(named, "root", "left").select("digest", F.when(F.col("links").isNull(), F.col("least")).otherwise(F.col("class")).alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    return signed.select("key", "digest").join(sets, "digest").select(F.col("key").alias(key), "digest", "class", "n_links", "n_copies")


def sides(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """The members' places on either side of a task, or twice all of one block."""
    a, b, i, query = g["a"].iat[0], g["b"].iat[0], g["i"].to_numpy(), g["query"].to_numpy(bool)
    if g["kind"].iat[0]:
        return np.flatnonzero(query), np.flatnonzero(~query), False
    if a == b:
        every = np.arange(len(g))
        return every, every, True
    return np.flatnonzero(i == a), np.flatnonzero(i == b), False


def forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """The root of each of n members under the pairs."""
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in pairs.tolist():
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return np.array([top(x) for x in range(n)])


def set_texts(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """digest, n and text for chosen (digest, key, n). Keys can repeat with other texts, so a digest's text is
    looked for among all rows of its key."""
    same = F.pandas_udf(_same_set, "boolean")
    hits = texts.join(chosen, texts["key"].eqNullSafe(chosen["key"])).select("digest", "n", "text")
    # The check takes values of both sides, or else it would be moved below the join, onto all texts.
    hits = hits.filter(same("text", "digest"))
    return hits.groupBy("digest").agg(F.first("n").alias("n"), F.first("text").alias("text"))


def _same_set(text: pd.Series, digest: pd.Series) -> pd.Series:
    return _digests(text) == digest


def _digests(text: pd.Series) -> pd.Series:
    hashes = WordHashes()
    return text.map(lambda t: xxhash.xxh3_128_digest(np.unique(shingles(words_of(t), hashes)).tobytes()))


def components(edges: DataFrame) -> DataFrame:
    """u and root, a vertex of its component, of each vertex of the edges (u, v).

    Every vertex points to its least neighbour. A path along such pointers can only come back to where it was two steps before, so each tree of
    pointers has one pair of vertices that point to each other; the lesser becomes its root. Pointers are doubled until all
    show roots, the trees are shrunk to these, and the edges between them are handled in the same way, until there are none. A tree has two vertices at least,
    so each round at least halves the number of vertices that still have edges: n vertices take at most log2(n) rounds, of at most log2(n) + 1 doublings each.
    Only counts reach the driver.
    """
    edges = materialize(edges.select("u", "v").union(edges.select("v", "u")).filter("u <> v").distinct())
    vertices = None
    while True:
        # Written, so that a hot vertex is a key of plain exchanges, which can be split.
        least = materialize(edges.groupBy("u").agg(F.min("v").alias("p")))
        back = least.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        roots = least.join(back, "p", "left").select("u", F.when((F.col("pp") == F.col("u")) & (F.col("u") < F.col("p")), F.col("u")).otherwise(F.col("p")).alias("root"))
        roots = materialize(roots)
        while True:
            jump = roots.select(F.col("u").alias("root"), F.col("root").alias("next"))
            jumped = materialize(roots.join(jump, "root").select("u", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            roots = jumped.select("u", "root")
            if jumped.filter("moved").isEmpty():
                break
        if vertices is None:
            vertices = roots
        else:
            step = roots.select(F.col("u").alias("root"), F.col("root").alias("next"))
            vertices = materialize(vertices.join(step, "root", "left").select("u", F.coalesce("next", "root").alias("root")))
        a, b = roots.select("u", F.col("root").alias("x")), roots.select(F.col("u").alias("v"), F.col("root").alias("y"))
        edges = materialize(edges.join(a, "u").join(b, "v").filter("x <> y").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct())
        if edges.isEmpty():
            return vertices


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs without the near duplicates: of each class the document with the least key stays, of rows alike in key and set one."""
    found = join(docs, key, text, similarity)
    own, want, mine = (fresh_name(docs, n) for n in ("key", "want", "digest"))
    keep = found.filter(F.col(f"`{key}`").eqNullSafe(F.col("class")))
    same = F.col(f"`{key}`").eqNullSafe(F.col(own))
    if found.groupBy(f"`{key}`").count().filter("count > 1").isEmpty():
        return docs.join(keep.select(F.col(f"`{key}`").alias(own)), same if not found.filter(F.col(f"`{key}`").isNull()).isEmpty() else F.col(f"`{key}`") == F.col(own), "left_semi")
    # Keys repeat: rows are told apart by their sets too, which means hashing the texts once more.
    keys = keep.select(F.col(f"`{key}`").alias(own), F.col("digest").alias(want)).distinct()
    told = docs.withColumn(mine, F.pandas_udf(_digests, "binary")(F.col(f"`{text}`")))
    told = told.join(keys, same & (F.col(mine) == F.col(want)), "left_semi")
    return told.dropDuplicates([key, mine]).drop(mine)
