"""Scalar functions as Column expressions, all within the JVM.

Java's regular expressions are made Unicode-aware where the definition needs it: (?U) for white space and word
characters, (?iu) for letters of any alphabet without case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions import vocabulary as V

TOKEN = "[а-яёА-ЯЁa-zA-Z]+"
#: White space as (?U)\\s has it; Python's \\s has four control characters more.
WHITE = tuple("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") + tuple(chr(c) for c in range(0x2000, 0x200B))


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def mapped(c: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """The value of a small dictionary, or the default."""
    found = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]
    return found if default is None else F.coalesce(found, default)


def normalize(c: Column) -> Column:
    """Lower case, stripped, and abbreviations in full."""
    t = strip(F.lower(c))
    return mapped(t, V.SYNONYMS, t)


def tokens(c: Column, pattern: str = TOKEN) -> Column:
    """Words of over two letters that are no stopwords, in order."""
    found = F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(V.STOPWORDS))


def ngrams(tokens_: Column, n: int) -> Column:
    """All runs of n tokens, joined by blanks; none if there are fewer."""
    if n == 1:
        return tokens_
    runs = F.transform(F.sequence(F.lit(0), F.size(tokens_) - F.lit(n)), lambda i: F.concat_ws(" ", *[tokens_[i + k] for k in range(n)]))
    return F.when(F.size(tokens_) >= n, runs).otherwise(F.array().cast("array<string>"))


def sentences(c: Column) -> Column:
    """Cut at white space after a full stop, exclamation or question mark."""
    return F.split(c, r"(?U)(?<=[.!?])\s+")


def _legal_parts(c: Column) -> Column:
    masked = F.regexp_replace(c, r"(?U)(\d)\.(\d)", "$1·$2")
    masked = F.regexp_replace(masked, rf"(?iU)\b({'|'.join(V.ABBREVIATIONS)})\.", "$1·")
    return F.split(masked, r"(?U)(?<=[.!?])\s+(?=[А-ЯA-ZЁ\d])")


def _legal_text(part: Column) -> Column:
    return strip(F.replace(part, F.lit("·"), F.lit(".")))


def legal_sentences(c: Column) -> Column:
    """Sentences of legal texts: stops within numbers and after listed abbreviations don't count, and a
    sentence starts with a capital or a digit. A middle dot in the text comes out as a full stop."""
    return F.filter(F.transform(_legal_parts(c), _legal_text), lambda p: p != "")


def legal_spans(c: Column) -> Column:
    """Structs (sentence, start, end) of legal_sentences(). A sentence is looked for behind the end of the one before, and stands
    right there if it isn't found (a middle dot that became a full stop)."""
    none = F.array().cast("array<struct<sentence:string,start:int,end:int>>")
    first = F.struct(none.alias("done"), F.lit(0).alias("at"))

    def add(state: Column, part: Column) -> Column:
        s = _legal_text(part)
        found = F.call_function("locate", s, c, state["at"] + 1) - 1
        start = F.when(found >= 0, found).otherwise(state["at"]).cast("int")
        span = F.struct(s.alias("sentence"), start.alias("start"), (start + F.length(s)).cast("int").alias("end"))
        blank = F.struct(state["done"].alias("done"), (state["at"] + F.length(part) + 1).cast("int").alias("at"))
        return F.when(s == "", blank).otherwise(F.struct(F.concat(state["done"], F.array(span)).alias("done"), span["end"].alias("at")))

    return F.aggregate(_legal_parts(c), first, add, lambda s: s["done"])


def clean_text(c: Column) -> Column:
    """Lines without trailing white space, at most one blank line in a row, stripped."""
    lines = F.regexp_replace(c, r"(?Um)[^\S\n]+$", "")
    return strip(F.regexp_replace(lines, "\n{3,}", "\n\n"))


def safe_filename(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, r"(?U)[^\w\-]", "_"), 1, 80)


def slugify(c: Column) -> Column:
    """Latin letters and digits, words capitalised and joined; never empty."""
    t = F.lower(c)
    for letter, latin in V.LATIN_MANY.items():
        t = F.replace(t, F.lit(letter), F.lit(latin))
    t = F.translate(t, V.LATIN_ONE[0] + V.LATIN_NONE, V.LATIN_ONE[1])
    t = F.regexp_replace(t, r"(?U)[^a-z0-9\s]", "")
    t = F.regexp_replace(F.initcap(F.regexp_replace(t, r"(?U)\s+", " ")), " ", "")
    return F.when(t == "", "Unknown").otherwise(t)


def uri(c: Column, namespace: str = "fin:") -> Column:
    return F.concat(F.lit(namespace), slugify(c))


def lemmatized(c: Column, lemmas: Column | None = None) -> Column:
    """Words in their normal forms, joined by blanks. lemmas: a map from words; other words, or all without one, stay."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0))
    return F.array_join(words if lemmas is None else F.transform(words, lambda w: F.coalesce(lemmas[w], w)), " ")


def normal_form(c: Column, lemmas: Column | None = None) -> Column:
    """Words in their normal forms, with everything between them kept; stripped. lemmas: a map from words in lower case; without one,
    the text in lower case."""
    if lemmas is None:
        return strip(F.lower(c))
    pieces = F.regexp_extract_all(c, F.lit(r"(?U)\w+|[^\w\s]+|\s+"), F.lit(0))
    return strip(F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\p{L}"), F.coalesce(lemmas[F.lower(p)], F.lower(p))).otherwise(p)), ""))


def whole_fences(c: Column) -> Column:
    """The other way to take code fences off a reply: its first line goes, and its last if that is nothing but a fence."""
    t = strip(c)
    return F.when(t.startswith("```"), strip(F.regexp_replace(F.regexp_replace(t, r"^[^\n]*(\n|$)", ""), r"(^|\n)```$", ""))).otherwise(t)


def without_fences(c: Column) -> Column:
    """What stands in a reply's code fences, without a language mark."""
    t = strip(c)
    return F.when(t.startswith("```"), strip(F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n?", ""), r"(?s)\n?```.*$", ""))).otherwise(t)


def json_text(c: Column) -> Column:
    """A value as a JSON string, null if it is missing."""
    whole = F.to_json(F.struct(c.cast("string").alias("v")))
    return F.when(c.isNull(), "null").otherwise(whole.substr(F.lit(6), F.length(whole) - 6))


def repaired_escapes(c: Column) -> Column:
    """Backslashes that start no JSON escape are doubled."""
    return F.regexp_replace(c, r'\\(?!["\\/bfnrtu])', r"\\\\")


def between_relation(c: Column, patterns: list[tuple[str, str]] | None = None) -> Column:
    """The relation of the first pattern found in the text between two entities, or null."""
    patterns = V.BETWEEN if patterns is None else patterns
    return F.coalesce(*[F.when(c.rlike(f"(?iu){p}"), F.lit(r)) for p, r in patterns])


def label_confidence(c: Column) -> Column:
    return F.when(c.startswith("FIN_"), 0.85).otherwise(0.7)


def boosted(c: Column) -> Column:
    return F.least(c * 1.3, F.lit(1.0))


def evidence_id(subject: Column, relation: Column) -> Column:
    """The object is no part of it, so evidence for several objects comes together."""
    return F.concat(F.lit("fin:ev_"), slugify(subject), F.lit("_"), relation)


def triple_text(s: Column, r: Column, o: Column) -> Column:
    return F.format_string("%s :%s :%s", s, r, o)


def garbage_ratio(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit("�"), F.lit("")))) / F.greatest(F.length(c), F.lit(1))


def line_count(c: Column) -> Column:
    return F.size(F.split(c, "\n"))


def prompt_lines(items: Column, template: str, *fields: str) -> Column:
    """An array of structs as numbered lines for a prompt."""
    return F.array_join(F.transform(items, lambda x, i: F.format_string("%d. " + template, (i + 1).cast("int"), *[x[f] for f in fields])), "\n")


def page_text(c: Column) -> Column:
    """The text of a page's main part, if it is marked as such (main or article) and has five lines or more; otherwise that of the whole page."""
    main = F.regexp_extract(c, r"(?is)<(main|article)\b[^>]*>(.*)</\1>", 2)
    found = html_text(main)
    return F.when((main != "") & (F.size(F.split(found, "\n")) >= 5), found).otherwise(html_text(c))


def html_text(c: Column) -> Column:
    """The text of a page: without scripts, styles and page furniture, a line for each run between tags."""
    furniture = ["script", "style", "nav", "footer", "header", "aside", "noscript", "iframe"]
    t = reduce(lambda x, tag: F.regexp_replace(x, rf"(?is)<{tag}\b.*?</{tag}>", ""), furniture, c)
    t = F.regexp_replace(t, r"(?s)<!--.*?-->|<[^>]*>", "\n")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return clean_text(t)


def url_kind(url: Column, content_type: Column | None = None) -> Column:
    """local_pdf, pdf or web. A missing content type counts as web."""
    pdf = F.lower(url).endswith(".pdf")
    if content_type is not None:
        pdf = pdf | F.coalesce(F.contains(F.lower(content_type), F.lit("pdf")), F.lit(False))
    return F.when(url.startswith("parser/local/"), "local_pdf").when(pdf, "pdf").otherwise("web")


def route(text: Column, threshold: int = 50) -> Column:
    """empty, short (fewer lines than the threshold) or ok."""
    t = F.coalesce(strip(text), F.lit(""))
    return F.when(t == "", "empty").when(line_count(text) < threshold, "short").otherwise("ok")


def header(source: Column, path: Column, kind: Column) -> Column:
    return F.concat(F.lit("[SOURCE] "), source, F.lit("\n[PATH] "), path, F.lit("\n[TYPE] "), kind, F.lit("\n" + "─" * 60 + "\n\n"))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1, unrounded; 0 where nothing is counted."""
    tp, fp, fn = (x.cast("double") for x in (tp, fp, fn))
    p = F.when(tp + fp > 0, tp / F.nullif(tp + fp, F.lit(0.0))).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / F.nullif(tp + fn, F.lit(0.0))).otherwise(0.0)
    f = F.when(p + r > 0, F.lit(2.0) * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(0.0)
    return [p.alias("precision"), r.alias("recall"), f.alias("f1")]
