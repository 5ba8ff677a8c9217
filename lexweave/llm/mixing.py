"""Mixing by soft membership.

A softmax classifier on hashed words, trained from the table of labels, gives each document a
likelihood for each domain. Nonnegative rates of the documents are then fitted so that the
expected tokens of each domain, the sum of rate * tokens * likelihood, match the targets in the
least squares: projected gradient steps from rates of one, each scaled by the documents' lengths and
by the inverse of the domains' Gram matrix. A step needs the domains' totals alone, so a pass over a narrow table
of likelihoods sends a few numbers to the driver, and a document's rate follows from the
steps' vectors without being stored in between.

The classifier learns from at most MAX_TRAIN labelled documents, those with the least hash of
their key. Everything else covers all documents.

take() turns rates into whole copies whose expectation is the rate.

Defined results: a null or empty text has no tokens; it has the likelihoods of a text without words and
its rate follows from them like any other. Rows with the same key are documents of their own. Labelled keys
that are null or not in the table are passed over. Without labels every domain is equally likely; with some, a domain without any has no
likelihood, so its target moves no document. A domain with no
tokens at all can't reach a target; the fit then comes as near as the others allow. Very long texts count whole. An empty table gives no rows. Other
columns, whatever their names, pass through take().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import WordHashes, materialize, rowwise, words_of

#: Domains and what a label row (quality, toxic) belongs to.
DOMAINS = ("good", "low", "toxic")
#: Labelled documents that the classifier learns from at most.
MAX_TRAIN = 6000
BITS = 16
#: Steps of the fit at most, and the relative error of the totals at which it ends.
STEPS, CLOSE = 40, 1e-6


def domain_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    return F.when(F.col(toxic) == 1, 2).when(F.col(quality) == 1, 0).otherwise(1)


class Slots(WordHashes):
    """Place of each word, in lower case and without punctuation around it, among the features."""

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.lower().strip(".,;:!?\"'()").encode("utf-8", "surrogatepass")) >> (64 - BITS)
        return h


#: Beyond words: five signs of style, each in four steps.
STYLE = 20
WIDTH = (1 << BITS) + STYLE + 1


def features(text: str | None, slots: Slots) -> tuple[int, np.ndarray]:
    """Number of words and the places of the ones."""
    words = words_of(text)
    n = len(words)
    if not n:
        return 0, np.array([WIDTH - 1])
    different = set(words)
    at = np.fromiter(map(slots.__getitem__, different), np.int64, len(different))
    marks = sum(text.count(c) for c in "#*$%&|<>!") / n
    style = (marks, len(different) / n, n / 400, sum(map(str.isupper, different)) / len(different), (text.count("\n") + 1) * 20 / n)
    cuts = ((0.01, 0.1, 0.5), (0.2, 0.5, 0.8), (0.125, 0.5, 2), (0.02, 0.2, 0.6), (0.3, 1, 4))
    more = [(1 << BITS) + 4 * i + sum(v > c for c in cs) for i, (v, cs) in enumerate(zip(style, cuts))]
    return n, np.concatenate([np.unique(at), more, [WIDTH - 1]])


def probabilities(weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    z = weights[at].sum(axis=0)
    z = np.exp(z - z.max())
    return z / z.sum()


def telling(rows: list[np.ndarray], y: np.ndarray, classes: int) -> np.ndarray:
    """The features that differ most between the classes, by chi-square: a third as many as there are rows, a hundred at least;
    with signs of style and the constant. Words that stand in one document only would be learnt by heart."""
    column = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n = np.bincount(column, minlength=WIDTH).astype(float)
    chi = np.zeros(WIDTH)
    for k in range(classes):
        share = (y == k).mean()
        expected = n * share
        off = (np.bincount(column, weights=(y == k)[row], minlength=WIDTH) - expected) ** 2
        chi = np.maximum(chi, off / np.maximum(expected, 1e-9) + off / np.maximum(n * (1 - share), 1e-9))
    keep = np.zeros(WIDTH, bool)
    keep[np.argsort(-chi, kind="stable")[: max(100, len(rows) // 3)]] = True
    keep[-1 - STYLE :] = True
    return keep


def train(rows: list[np.ndarray], y: np.ndarray, classes: int, steps: int = 150, rate: float = 0.3, decay: float = 2e-4) -> np.ndarray:
    """Softmax regression by Adagrad on sparse rows of ones, with the features that tell the classes apart."""
    w, square = np.zeros((WIDTH, classes)), np.full((WIDTH, classes), 1e-8)
    if not rows:
        return w
    keep = telling(rows, y, classes)
    rows = [r[keep[r]] for r in rows]
    column = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    used, column = np.unique(column, return_inverse=True)
    target = np.eye(classes)[y] / len(rows)
    v, s = w[used], square[used]
    for _ in range(steps):
        z = np.stack([np.bincount(row, v[column, k], len(rows)) for k in range(classes)], axis=1)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p = p / p.sum(axis=1, keepdims=True) / len(rows) - target
        g = np.stack([np.bincount(column, p[row, k], len(used)) for k in range(classes)], axis=1) + decay * v
        s += g * g
        v = v - rate * g / np.sqrt(s)
    w[used] = v
    return w


def calibrated(rows: list[np.ndarray], y: np.ndarray, classes: int) -> np.ndarray:
    """Weights that give likelihoods as sure as they are right: all are divided by the number under which three quarters of
    the rows predict the fourth best."""
    w = train(rows, y, classes)
    held = np.arange(len(rows)) % 4 == 3
    if held.sum() < 20:
        return w
    part = train([r for r, h in zip(rows, held) if not h], y[~held], classes)
    z = np.stack([part[r].sum(axis=0) for r, h in zip(rows, held) if h])

    def loss(t: float) -> float:
        x = z / t
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(x)), y[held]]).mean())

    return w / min((1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0, 24.0, 32.0), key=loss)


def classifier(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = MAX_TRAIN) -> np.ndarray:
    """The weights. The texts of the chosen documents become places of ones before they go to the driver."""
    labelled = labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    chosen = labelled.select(F.col(key).alias("_k"), domain_of().alias("_y")).orderBy(F.xxhash64("_k"), "_k", "_y").limit(most)
    picked = docs.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_t")).join(chosen, "_k").select(F.struct("_k", "_y").alias("_id"), "_t")

    def start():
        slots = Slots()
        return lambda texts: [[features(t, slots)[1].tolist() for t in texts]]

    ready = rowwise(picked.select(F.col("_id._k").alias("k"), F.col("_id._y").alias("y"), F.col("_t")).withColumn("ky", F.concat_ws(":", F.col("k").cast("string"), F.col("y").cast("string"))), "ky", "_t", "at array<int>", start)
    found = sorted((r.ky, r["at"]) for r in ready.collect())
    y = np.array([int(k.rsplit(":", 1)[1]) for k, _ in found], int)
    w = calibrated([np.array(a, np.int64) for _, a in found], y, len(DOMAINS))
    if len(y):
        # The constant rules out domains that no label shows; what else they got is left over from the start of the training.
        w[-1, np.setdiff1d(np.arange(len(DOMAINS)), y)] = -1e3
    return w


def likelihoods(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens and p (an array in the order of DOMAINS) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def start():
        slots, w = Slots(), shared.value

        def run(texts: list) -> list:
            rows = [features(t, slots) for t in texts]
            return [[n for n, _ in rows], [probabilities(w, at).astype(float).tolist() for _, at in rows]]

        return run

    return rowwise(docs, key, text, "n_tokens long, p array<double>", start)


def rate_of(steps: list[list[float]], p: str = "p") -> Column:
    """A document's rate after the steps."""
    if not steps:
        return F.lit(1.0)
    vectors = "array(" + ",".join("array(" + ",".join(f"{x!r}D" for x in s) + ")" for s in steps) + ")"
    return F.expr(f"aggregate({vectors}, 1.0D, (r, g) -> greatest(0.0D, r - aggregate(zip_with({p}, g, (a, b) -> a * b), 0.0D, (s, x) -> s + x)))")


def fit(table: DataFrame, targets: np.ndarray, steps: int = STEPS, close: float = CLOSE) -> tuple[list[list[float]], np.ndarray]:
    """The steps' vectors for a table with n_tokens and p, and the totals they reach. Each step is one aggregation."""
    k = len(targets)
    done: list[list[float]] = []
    best, damp = None, 1.0
    scale = max(float(np.abs(targets).max()), 1e-300)
    for _ in range(steps + 1):
        rated = table.select("n_tokens", "p", rate_of(done).alias("r"))
        sums = [F.sum(F.col("n_tokens") * F.col("r") * F.col("p")[i]).alias(f"s{i}") for i in range(k)]
        gram = [F.sum(F.when(F.col("r") > 0, F.col("n_tokens") * F.col("p")[i] * F.col("p")[j]).otherwise(0.0)).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]
        row = rated.agg(*sums, *gram).first()
        total = np.array([row[f"s{i}"] or 0.0 for i in range(k)])
        error = float(np.abs(total - targets).max())
        if best is not None and error > best[0] * (1 - 1e-9):
            damp /= 2
            if damp < 0.05:
                break
            done = [*best[1], [damp * x for x in best[3]]]
            continue
        m = np.array([[row[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        step = np.linalg.lstsq(m + 1e-9 * max(m.max(), 1e-300) * np.eye(k), total - targets, rcond=None)[0].tolist()
        best = (error, list(done), total, step)
        if error <= close * scale:
            break
        done = [*done, [damp * x for x in step]]
    return best[1], best[2]


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], tokens: float | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, p_<domain> and rate of each document. weights: each domain's share of the `tokens` wanted (as many
    as there are, if not given)."""
    model = classifier(docs, labels, key, text)
    table = materialize(likelihoods(docs, model, key, text))
    if tokens is None:
        tokens = float(table.agg(F.sum("n_tokens")).first()[0] or 0)
    share = np.array([weights.get(d, 0.0) for d in DOMAINS])
    steps, _ = fit(table, share / share.sum() * tokens)
    return table.select(F.col(f"`{key}`"), "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], rate_of(steps).alias("rate"))


def fitted_factors(docs: DataFrame, labels: DataFrame, wanted: dict[str, float], key: str, text: str) -> tuple[np.ndarray, list[list[float]], DataFrame]:
    """The classifier's weights, the steps of the fit, and the table of likelihoods, with targets as multiples of the tokens
    that each domain is expected to have now, however few these are."""
    model = classifier(docs, labels, key, text)
    table = materialize(likelihoods(docs, model, key, text))
    row = table.agg(*[F.sum(F.col("n_tokens") * F.col("p")[i]).alias(d) for i, d in enumerate(DOMAINS)]).first()
    now = np.array([row[d] or 0.0 for d in DOMAINS])
    steps, _ = fit(table, np.array([wanted.get(d, 1.0) for d in DOMAINS]) * now)
    return model, steps, table


def factors(docs: DataFrame, labels: DataFrame, wanted: dict[str, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """As mix(), with targets as multiples of the tokens that each domain is expected to have now."""
    _, steps, table = fitted_factors(docs, labels, wanted, key, text)
    return table.select(F.col(f"`{key}`"), "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], rate_of(steps).alias("rate"))


class Rounding:
    """Whole copies for rates. Documents come one after the other; along each stratum (most likely domain, magnitude of the length) the
    rates are summed up from a random start below one, and a document gets as many copies as there are whole numbers between the sums before and after it.
    So its expected copies are its rate exactly, and the copies of a stratum differ from the sum of its rates by less than one."""

    def __init__(self, seed: str):
        self.seed = seed
        self.sums: dict[tuple[int, int], float] = {}

    def copies(self, rate: float, n: int, p: np.ndarray) -> int:
        stratum = int(np.argmax(p)), n.bit_length()
        if stratum not in self.sums:
            self.sums[stratum] = xxhash.xxh64_intdigest(f"{self.seed}:{stratum}") / 2**64
        total = self.sums[stratum] + rate
        whole = int(total)
        self.sums[stratum] = total - whole
        return whole


def rates(p: np.ndarray, steps: list[list[float]]) -> np.ndarray:
    """As rate_of(), for an array (documents, domains)."""
    r = np.ones(len(p))
    for g in steps:
        r = np.maximum(0.0, r - p @ np.array(g))
    return r


def take(docs: DataFrame, labels: DataFrame, wanted: dict[str, float], key: str = "doc_id", text: str = "text", seed: str = "mix") -> DataFrame:
    """docs with each document as often as its rate says, in expectation (see Rounding), with targets as in factors().

    The rate is found from a row's own text, so rows with the same key are documents of their own. The texts are read once more for
    that; nothing is joined or shuffled. Which documents of a stratum stay follows from the order of the rows and the partitions."""
    model, steps, _ = fitted_factors(docs, labels, wanted, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(model.astype(np.float32))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, w = Slots(), shared.value
        rounding = Rounding(f"{seed}:{TaskContext.get().partitionId()}")
        for b in batches:
            rows = [features(t, slots) for t in b.column(at).to_pylist()]
            if not rows:
                continue
            p = np.stack([probabilities(w, ones) for _, ones in rows]).astype(float)
            rate, times = rates(p, steps), [0] * len(rows)
            # Those of a batch by length, so that the copies have the lengths of what they stand for.
            for i in sorted(range(len(rows)), key=lambda i: rows[i][0]):
                times[i] = rounding.copies(rate[i], rows[i][0], p[i])
            while any(times):
                yield b.take(pa.array(np.flatnonzero(times)))
                times = [max(0, k - 1) for k in times]

    return docs.mapInArrow(run, docs.schema)
