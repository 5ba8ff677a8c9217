"""Personal data by weak supervision.

Base spans (email, ip, card, phone) come from fixed patterns and always stay. Wider patterns
propose candidates of further kinds. Labelers - regexes, gazetteers and context words - vote on each
candidate, for, against or not at all. The counts of all vote patterns over the whole corpus go
into an expectation-maximisation of Dawid and Skene's kind, which estimates how reliable each labeler is and how
likely each pattern is personal data; these likelihoods are the soft labels from which the
final span classifier, a logistic regression on votes and shape, learns. Spans it accepts are added.

What the driver sees is one count for each (kind, votes, shape), a few thousand at most by their
definition, however large the corpus is.

Defined results: a null text is as the empty one and has no spans. Offsets are code points, ends
exclusive. Very long texts are searched whole. Ties: of proposals that start at the same place the longest counts, then the first kind. Repeated rows
are treated alike; extra columns, whatever their names, pass through redact(), which replaces
`text` and, if there, `n_chars`. Without any candidate in the table nothing is added; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm.common import rowwise

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "name", "phone_local", "secret", "ssn")
KINDS = (*BASE, *EXTRA)

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_EMAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A digit before a match would be part of it, so looking back changes no match; it saves starting at each digit of a long run.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Wide proposals for the further kinds; group 1, if any, is the span.
WIDE = {
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "phone_local": re.compile(r"(?<![\w+)(-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![\w-])"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
}
ASSIGNED = re.compile(r"(?i)\b(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?([^\s\"']{6,}+)")
CLOUD_KEY = re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b")
LONG = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}+(?![A-Za-z0-9+/_-])")
NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Señor|Señora|[Nn]ame:|[Cc]ontact:|[A-Z][a-z]+)\.? ((?:[A-Z][a-z]{1,20})(?: [A-Z][a-z]{1,20}){0,2})")

#: Gazetteers: titles and introductions, and given names common in the four languages. Fixed values.
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Señor", "Señora", "Name:", "name:", "Contact:", "contact:")
GIVEN = frozenset("James John Robert Michael William David Richard Joseph Thomas Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Maria Peter Paul Hans Klaus Jürgen Ursula Jean Pierre Michel Marie Sophie Juan José Carlos Carmen Lucía".split())
_HEADS = re.compile("(?:" + "|".join([*TITLES, *sorted(GIVEN)]) + r")\.? [A-Z]")
CONTEXT = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "credit", "paid"), "phone": ("phone", "call", "tel", "fax"),
    "iban": ("iban", "account", "bank", "konto"), "name": TITLES, "phone_local": ("phone", "call", "tel", "fax"), "secret": ("token", "password", "key", "secret", "pwd"), "ssn": ("ssn", "social", "security"),
}
#: Order of the votes. Each is 1 for, -1 against, 0 no opinion.
LABELERS = ("form", "checksum", "gazetteer", "context", "mix", "neighbour")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, sorted by start and then kind."""
    out = []
    at, low = text.find("@"), 0
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _EMAIL_LEFT:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            low = m.end()
        at = text.find("@", max(at + 1, low))
    if _DIGIT.search(text):
        for m in IP.finditer(text):
            if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 40 and 14 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(digits_of(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def extra_candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Wide proposals that don't touch a base span or an earlier proposal."""
    found = []
    if _DIGIT.search(text):
        for kind, pattern in WIDE.items():
            found += [(m.start(), KINDS.index(kind), m.end()) for m in pattern.finditer(text)]
        found += [(m.start(), KINDS.index("secret"), m.end()) for m in LONG.finditer(text) if _DIGIT.search(m.group())]
    if "=" in text or ":" in text:
        found += [(m.start(1), KINDS.index("secret"), m.end(1)) for m in ASSIGNED.finditer(text)]
    if "AKIA" in text or "ASIA" in text:
        found += [(m.start(), KINDS.index("secret"), m.end()) for m in CLOUD_KEY.finditer(text)]
    if _HEADS.search(text):
        for m in NAME.finditer(text):
            head = text[m.start() : m.start(1)].rstrip(" .")
            if head in TITLES:
                found.append((m.start(1), KINDS.index("name"), m.end(1)))
            elif head in GIVEN:
                found.append((m.start(), KINDS.index("name"), m.end(1)))
    out, free = [], 0
    taken = sorted((s, e) for s, _, e in base)
    i = 0
    for s, k, e in sorted(found, key=lambda x: (x[0], -x[2], x[1])):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if s >= free and not (i < len(taken) and taken[i][0] < e):
            out.append((s, k, e))
            free = e
    return out


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(text: str, span: tuple[int, int, int], others: list[int]) -> tuple[int, ...]:
    """The labelers' votes; others: starts of the base spans, sorted."""
    start, k, end = span
    kind, s = KINDS[k], text[start:end]
    before = text[max(0, start - 32) : start]
    form = checksum = gazetteer = mix = 0
    if kind == "iban":
        checksum, form = (1 if iban_ok(s) else -1), (1 if s[:2].isalpha() else -1)
    elif kind == "ssn":
        form = -1 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else 1
    elif kind == "phone_local":
        form = 1 if s.startswith("(") or len({c for c in s if not c.isdigit()}) == 1 else -1
    elif kind == "secret":
        form = 1 if CLOUD_KEY.fullmatch(s) or re.fullmatch(r"[0-9a-f]{16,}|[A-Za-z0-9+/_=-]{20,}", s) else -1 if s.isalpha() else 0
        mix = 1 if entropy(s) >= 3.2 and _DIGIT.search(s) else -1 if entropy(s) < 2.5 else 0
    elif kind == "name":
        first = s.split(" ")[0]
        gazetteer = 1 if first in GIVEN else 0
        form = 1 if " " in s else 0
    elif kind == "card":
        checksum, form = 1, (1 if len(digits_of(s)) in (15, 16) else 0)
    elif kind == "ip":
        form = 1 if not s.startswith("0.") else -1
    elif kind == "phone":
        form = 1 if len(digits_of(s)) >= 11 else 0
    else:
        form = 1 if s.rsplit(".", 1)[-1].isalpha() else -1
    low = before.lower() if kind != "name" else before
    context = 1 if any(w in low for w in CONTEXT[kind]) else 0
    i = int(np.searchsorted(others, start)) if others else 0
    near = any(o != start and abs(o - start) < 80 for o in others[max(0, i - 1) : i + 2])
    return form, checksum, gazetteer, context, mix, 1 if near else 0


def shape(text: str, span: tuple[int, int, int]) -> int:
    """One of 36: length, share of digits and presence of capitals, coarsely."""
    s = text[span[0] : span[2]]
    share = sum("0" <= c <= "9" for c in s) / len(s)
    return min(5, len(s) // 8) * 6 + (0 if share == 0 else 1 if share < 0.5 else 2) * 2 + any("A" <= c <= "Z" for c in s)


def candidates(text: str) -> list[tuple[tuple[int, int, int], tuple[int, ...], int]]:
    """All spans of a text, base ones first, with votes and shape."""
    base = base_spans(text)
    starts = [s for s, _, _ in base]
    return [(x, votes(text, x, starts), shape(text, x)) for x in [*base, *extra_candidates(text, base)]]


def expectation_maximisation(rows: list[tuple[int, tuple[int, ...], int]], rounds: int = 60) -> np.ndarray:
    """Of (kind, votes, count) rows: how likely each is personal data. Labelers vote independently of each
    other given the truth; the share of true ones is each kind's own. Counts are smoothed."""
    kinds = np.array([r[0] for r in rows])
    v = np.array([r[1] for r in rows]) + 1
    n = np.array([r[2] for r in rows], float)
    # The start: the majority of the votes, leaning to yes, as the patterns that propose candidates are labelers too.
    # Base spans are personal data by definition.
    sure = kinds < len(BASE)
    p = np.where(sure, 1.0, 1 / (1 + np.exp(-(v - 1).sum(axis=1) - 0.5)))
    for _ in range(rounds):
        like = np.zeros((2, len(rows)))
        for y, w in enumerate((n * (1 - p), n * p)):
            for j in range(v.shape[1]):
                # A labeler is taken to be better than chance before any count is seen.
                prior = np.array([20.0, 20.0, 2.0]) if y == 0 else np.array([1.0, 2.0, 3.0])
                table = np.bincount(v[:, j], weights=w, minlength=3) + prior
                like[y] += np.log(table / table.sum())[v[:, j]]
        share = np.array([(np.sum((n * p)[kinds == k]) + 1) / (np.sum(n[kinds == k]) + 2) for k in range(len(KINDS))])[kinds]
        odds = np.log(share / (1 - share)) + like[1] - like[0]
        p = np.where(sure, 1.0, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
    return p


def features(kind: int, vote: tuple[int, ...], form: int) -> list[int]:
    """Places of the ones in the classifier's input."""
    return [0, 1 + kind, *(10 + 3 * j + x + 1 for j, x in enumerate(vote)), 10 + 3 * len(vote) + form]


WIDTH = 10 + 3 * len(LABELERS) + 36


def train(rows: list[tuple[int, tuple[int, ...], int, int]], steps: int = 400, rate: float = 0.5) -> np.ndarray:
    """Weights of the span classifier from (kind, votes, shape, count) rows with the likelihoods of the
    expectation-maximisation as soft labels. Rows weigh by the logarithm of their count."""
    pattern: Counter = Counter()
    for k, v, _, n in rows:
        pattern[k, v] += n
    keys = sorted(pattern)
    soft = dict(zip(keys, expectation_maximisation([(*k, pattern[k]) for k in keys])))
    x = np.zeros((len(rows), WIDTH))
    for i, (k, v, s, _) in enumerate(rows):
        x[i, features(k, v, s)] = 1
    y = np.array([soft[k, v] for k, v, _, _ in rows])
    w = np.log1p(np.array([r[3] for r in rows], float))
    w /= w.sum()
    out, square = np.zeros(WIDTH), np.full(WIDTH, 1e-8)
    for _ in range(steps):
        g = x.T @ (w * (1 / (1 + np.exp(-np.clip(x @ out, -30, 30))) - y)) + 1e-4 * out
        square += g * g
        out -= rate * g / np.sqrt(square)
    return out


def fit(docs: DataFrame, text: str = "text") -> np.ndarray | None:
    """The classifier's weights from all texts; None if there is no candidate."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for t in b["_text"]:
                for span, v, s in candidates(t or ""):
                    seen[span[1], v, s] += 1
        yield pd.DataFrame([(k, ",".join(map(str, v)), s, n) for (k, v, s), n in seen.items()], columns=["kind", "votes", "shape", "n"])

    rows = docs.select(F.col(f"`{text}`").alias("_text")).mapInPandas(count, "kind int, votes string, shape int, n long")
    rows = rows.groupBy("kind", "votes", "shape").agg(F.sum("n").alias("n")).collect()
    if not rows:
        return None
    return train(sorted((r.kind, tuple(map(int, r.votes.split(","))), r["shape"], r.n) for r in rows))


def spans(text: str, weights: np.ndarray | None, threshold: float = 0.5) -> tuple[list, list]:
    """Base spans, and all spans, of a text."""
    all_ = candidates(text)
    base = [x for x, _, _ in all_ if x[1] < len(BASE)]
    least = math.log(threshold / (1 - threshold))
    more = [x for x, v, s in all_ if x[1] >= len(BASE) and weights is not None and sum(weights[i] for i in features(x[1], v, s)) >= least]
    return base, sorted(base + more)


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone (base), n_extra, base_sha256, spans of each row."""
    weights = fit(docs, text)

    def start():
        def run(texts: list) -> list:
            rows = []
            for t in texts:
                base, found = spans(t or "", weights, threshold)
                n = Counter(k for _, k, _ in base)
                rows.append((*(n[i] for i in range(len(BASE))), len(found) - len(base), hashlib.sha256(written(base).encode()).hexdigest(), written(found)))
            return list(zip(*rows)) or [()] * 7

        return run

    return rowwise(docs, key, text, "n_email long, n_ip long, n_card long, n_phone long, n_extra long, base_sha256 string, spans string", start)


def masked(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first, in angle brackets."""
    out, at, i = [], 0, 0
    while i < len(found):
        s, k, e = found[i]
        i += 1
        while i < len(found) and found[i][0] < e:
            e = max(e, found[i][2])
            i += 1
        out += [text[at:s], f"<{KINDS[k]}>"]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with all spans in `text` masked, and n_chars, if it is there, counted anew. Null texts stay null."""
    weights = fit(docs, text)

    @F.pandas_udf(T.StringType())
    def mask(column: pd.Series) -> pd.Series:
        return column.map(lambda t: t if t is None else masked(t, spans(t, weights, threshold)[1]))

    out = docs.withColumn(text, mask(F.col(f"`{text}`")))
    return out.withColumn("n_chars", F.length(f"`{text}`").cast("long")) if "n_chars" in docs.columns and text != "n_chars" else out
