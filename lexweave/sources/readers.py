"""Sources: manifests, parsed texts, gold annotations, web pages, PDF files."""

from __future__ import annotations

import unicodedata
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.functions import vocabulary as V
from lexweave.operators.entities import last_per

ENTITY = "struct<id:string,text:string,class:string,start:int,confidence:double,comment:string>"
RELATION = "struct<id:string,subject:string,subject_text:string,relation:string,object:string,object_text:string,confidence:double,evidence:string>"
GOLD = f"struct<documents:array<struct<id:string,title:string,source:string,type:string,text:string,entities:array<{ENTITY}>,relations:array<{RELATION}>>>>"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """value and path of text files; none if nothing is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    if not found:
        return spark.createDataFrame([], "value string, path string")
    return spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("path"))


def inline_corpus(spark: SparkSession, docs: list[dict]) -> DataFrame:
    """Documents given in the program: id, type, product, source and text; what is missing is empty."""
    fields = ("id", "type", "product", "source", "text")
    return spark.createDataFrame([tuple(str(d.get(f, "")) for f in fields) for d in docs], ", ".join(f"{f} string" for f in fields))


def with_default(df: DataFrame, table: DataFrame, on: str, value: str, default: str = "unknown") -> DataFrame:
    """df with the value that a table (`on`, `value`) has for it, or the default. The table's keys are unique."""
    return df.join(table.select(on, value), on, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def manifest(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (line_no, url, name, doc_type) of lines (line_no, value), and the lines with too few fields.
    Blank lines and comments are skipped, fields after the third ignored."""
    rows = lines.withColumn("value", T.strip(F.col("value"))).filter("value <> '' AND NOT startswith(value, '#')")
    rows = rows.withColumn("f", F.transform(F.split("value", r"\|"), T.strip))
    good = rows.filter("size(f) >= 3").select("line_no", F.col("f")[0].alias("url"), F.col("f")[1].alias("name"), F.col("f")[2].alias("doc_type"))
    return good, rows.filter("size(f) < 3").select("line_no", "value")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines of a manifest, a small text file read whole."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def type_lookup(entries: DataFrame) -> DataFrame:
    """name and short type; of entries with the same name the last counts."""
    return last_per(entries, ["name"], "line_no").select("name", T.mapped(F.col("doc_type"), V.DOC_TYPES, F.col("doc_type")).alias("type"))


def parsed_body(raw: F.Column) -> F.Column:
    """What follows the first rule of ten or more dashes, or else the lines that are no header; stripped."""
    after = F.regexp_extract(raw, r"(?s)[-─]{10,}(.*)$", 1)
    lines = F.array_join(F.filter(F.split(raw, "\n"), lambda x: ~x.rlike(r"^\[(SOURCE|PATH|TYPE)\]")), "\n")
    return T.strip(F.when(raw.rlike("[-─]{10,}"), after).otherwise(lines))


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    """id (the file's name without extension), text and source of parsed text files; none if there are none."""
    rows = whole_files(spark, path)
    name = F.url_decode(F.regexp_extract("path", r"([^/]+)$", 1))
    return rows.select(F.regexp_replace(name, r"\.txt$", "").alias("id"), parsed_body(F.col("value")).alias("text"), name.alias("source"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold documents in order; none if the file isn't there."""
    whole = whole_files(spark, path).select(F.from_json("value", GOLD).alias("g"))
    return whole.select(F.posexplode("g.documents").alias("doc_ord", "d")).select("doc_ord", "d.*")


def filled_gold(gold: DataFrame, types: DataFrame, parsed: DataFrame) -> DataFrame:
    """Gold documents with the manifest's type and the parsed file's text where they have none."""
    t = types.select(F.col("name").alias("id"), F.col("type").alias("_type"))
    p = parsed.select("source", F.col("text").alias("_text"))
    rows = gold.join(t, "id", "left").join(p, "source", "left")
    kind = F.coalesce(F.nullif("type", F.lit("")), "_type", F.lit("unknown"))
    return rows.withColumn("type", kind).withColumn("text", F.coalesce(F.nullif("text", F.lit("")), "_text", F.lit(""))).drop("_type", "_text")


def corpus(gold: DataFrame, parsed: DataFrame, types: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Gold documents, then parsed ones that are not among them and have text, by name. doc_ord is (0 or 1, order or name) as one text."""
    g = gold.select("id", "type", F.col("title").alias("product"), "source", "text", F.format_string("0:%09d", "doc_ord").alias("doc_ord"))
    p = with_default(parsed.join(gold.select("id"), "id", "left_anti").filter("text <> ''"), types.select(F.col("name").alias("id"), "type"), "id", "type")
    p = p.select("id", "type", F.replace("id", F.lit("_"), F.lit(" ")).alias("product"), "source", "text", F.concat(F.lit("1:"), "source").alias("doc_ord"))
    out = g.unionByName(p)
    return out.filter(F.col("id").isin(ids)) if ids else out


def pages(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """df with kind (see url_kind), text and status of fetched pages."""
    return df.withColumn("kind", T.url_kind(F.col(url))).withColumn("page_text", T.page_text(F.col(html))).withColumn("status", T.route(F.col("page_text")))


def decoded(raw: F.Column, declared: F.Column, detect: Callable[[bytes], str] | None = None) -> F.Column:
    """Text of bytes: the first of the declared encoding (unless a mere default), a detected one, utf-8, cp1251 and latin-1 that
    decodes with under 1 % replacement characters; normalised (NFC)."""

    @F.pandas_udf("string")
    def run(data: pd.Series, said: pd.Series) -> pd.Series:
        out = []
        for b, s in zip(data, said):
            names = [s] if s and s.lower() not in ("iso-8859-1", "latin-1", "windows-1252", "ascii") else []
            for name in [*names, *([detect(b)] if detect and b is not None else []), "utf-8", "cp1251", "latin-1"]:
                try:
                    t = None if b is None else b.decode(name)
                except (UnicodeDecodeError, LookupError):
                    continue
                if t is None or t.count("�") / max(len(t), 1) < 0.01:
                    out.append(t if t is None else unicodedata.normalize("NFC", t))
                    break
        return pd.Series(out, dtype=object)

    return run(raw, declared)


def over_network(url: str) -> tuple[bytes, str]:
    """Bytes and content type of a url."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=30) as r:
        return r.read(), r.headers.get("Content-Type", "")


def fetched(entries: DataFrame, get: Callable[[str], tuple[bytes, str]] = over_network, extract: Callable[[bytes], list[str]] | None = None, threshold: int = 50) -> DataFrame:
    """Manifest entries (url, name, doc_type) with kind, text, status (ok, short, empty, error) and error.

    get() runs on the executors, a row at a time, and what it raises is kept as the row's error; with extract() PDF files are read, by the url's ending or the
    content type, and pages otherwise, by their main part."""
    local = entries.withColumn("name", T.safe_filename(T.strip(F.col("name"))))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in local.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url in b["url"]:
                raw = said = pages = error = None
                try:
                    raw, said = get(url)
                    if extract is not None and (url.lower().endswith(".pdf") or "pdf" in (said or "").lower()):
                        pages = "\n\n".join(t for t in extract(raw) if t)
                except Exception as e:  # what get() raises is its own
                    error = f"{type(e).__name__}: {e}"
                rows.append((raw, said, pages, error))
            yield b.assign(**{n: [r[i] for r in rows] for i, n in enumerate(("_raw", "_said", "_pdf", "error"))})

    got = local.mapInPandas(run, f"{schema}, _raw binary, _said string, _pdf string, error string")
    declared = F.regexp_extract(F.lower(F.coalesce("_said", F.lit(""))), r"charset=([\w-]+)", 1)
    kind = T.url_kind(F.col("url"), F.col("_said"))
    text = T.clean_text(F.coalesce("_pdf", T.page_text(decoded(F.col("_raw"), declared))))
    rows = got.withColumn("kind", kind).withColumn("text", F.when(F.col("error").isNull(), text))
    return rows.withColumn("status", F.when(F.col("error").isNotNull(), "error").otherwise(T.route(F.col("text"), threshold))).drop("_raw", "_said", "_pdf")


def read_pdf(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """path and text of PDF files, by a function from a file's bytes to its pages' texts, which is not part of this
    engine. Pages are joined by a blank line; a file without text is empty. Files that aren't there fail the read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": ["\n\n".join(t for t in extract(c) if t) for c in b["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """id and annotation text of {id}_annotation.json files; none if there are none."""
    rows = whole_files(spark, path)
    return rows.select(F.url_decode(F.regexp_extract("path", r"([^/]+)_annotation\.json$", 1)).alias("id"), "value").filter("id <> ''").orderBy("id")


REVIEW = """struct<doc_id:string,reviewer:string,entities_review:array<struct<ord:int,text:string,class:string,correct:boolean,correct_class:string,comment:string>>,
missing_entities:array<string>,relations_review:array<struct<ord:int,subject_text:string,relation:string,object_text:string,correct:boolean,comment:string>>,overall_score:int,notes:string>"""


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Reviews, a line of JSON each, of those of the same document the last by file and line; none if there are none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at):
        return spark.createDataFrame([], "doc_id string, review string").select("doc_id", F.from_json("review", REVIEW).alias("r")).select("r.*")
    lines = spark.read.text(path).select("value", F.struct(F.input_file_name().alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("_at"))
    rows = lines.select(F.from_json("value", REVIEW).alias("r"), "_at").filter("r.doc_id IS NOT NULL").withColumn("_id", F.col("r.doc_id"))
    return last_per(rows, ["_id"], "_at").select("r.*")
