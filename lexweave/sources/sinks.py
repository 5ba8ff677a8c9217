"""Sinks: routed texts, annotations, graphs, metrics, review templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lexweave.functions import text as T


def write_texts(df: DataFrame, path: str, threshold: int = 50) -> DataFrame:
    """Texts (source, path, type, text) under a header, in a folder for each status; empty ones aren't written. Returns counts by status,
    which are observed while the texts are written."""
    routed = df.withColumn("status", T.route(F.col("text"), threshold))
    seen = Observation()
    routed = routed.observe(seen, *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "short", "empty")])
    body = F.concat(T.header(F.col("source"), F.col("path"), F.col("type")), F.col("text"))
    routed.select(body.alias("value"), "status").filter("status <> 'empty'").write.partitionBy("status").option("lineSep", "\n\x1e\n").text(path)
    return df.sparkSession.createDataFrame([(s, n) for s, n in seen.get.items() if n], "status string, n long")


def short_list(df: DataFrame, threshold: int = 50) -> DataFrame:
    """A line for each short text (source, path, type, text): name, lines, size and source."""
    t = F.col("text")
    size = F.octet_length(F.concat(T.header(F.col("source"), F.col("path"), F.col("type")), t)) / 1024
    line = F.format_string("%s  |  %d строк  |  %.1f KB  |  %s", F.regexp_extract("path", r"([^/]+)$", 1), T.line_count(t), size, F.col("source"))
    return df.filter(T.route(t, threshold) == "short").select(line.alias("value"))


def status_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("status").agg(F.count("*").alias("n"))


def annotations(docs: DataFrame, entities: DataFrame, relations: DataFrame, triples: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """key and the document's annotation as JSON, with entities and relations in order and triples as text."""
    e = entities.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "id", "text", "class", "confidence"))).alias("e"))
    r = relations.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "id", "subject_id", "subject_text", "relation", "object_id", "object_text", "confidence", "evidence"))).alias("r"))
    out = docs.select(key).join(e, key, "left").join(r, key, "left")
    if triples is not None:
        t = triples.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", T.triple_text(F.col("subject"), F.col("relation"), F.col("object")).alias("t")))).alias("t"))
        out = out.join(t, key, "left")
    es = F.transform("e", lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"), x["class"].alias("class"), F.lit(None).cast("int").alias("start"), x["confidence"].alias("confidence")))
    rs = F.transform("r", lambda x: F.struct(x["id"].alias("id"), x["subject_id"].alias("subject"), x["subject_text"].alias("subject_text"), x["relation"].alias("relation"), x["object_id"].alias("object"), x["object_text"].alias("object_text"), x["confidence"].alias("confidence"), x["evidence"].alias("evidence")))
    ts = F.transform("t", lambda x: x["t"]) if triples is not None else F.array().cast("array<string>")
    found = F.struct(F.col(key).cast("string").alias("id"), es.alias("entities"), rs.alias("relations"), ts.alias("ontology_triples"))
    return out.select(key, F.to_json(found, {"ignoreNullFields": "false"}).alias("annotation"))


PREFIXES = {"fin": "http://example.org/finance#", "fibo": "https://spec.edmcouncil.org/fibo/ontology/", "owl": "http://www.w3.org/2002/07/owl#", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "skos": "http://www.w3.org/2004/02/skos/core#"}


def full_uri(c: Column) -> Column:
    """A name with its prefix written out."""
    known = [F.when(c.startswith(f"{k}:"), F.concat(F.lit(v), F.substr(c, F.lit(len(k) + 2)))) for k, v in PREFIXES.items()]
    return F.coalesce(*known, c)


def _quoted(c: Column) -> Column:
    for plain, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(plain), F.lit(written))
    return F.concat(F.lit('"'), c, F.lit('"'))


def _literal() -> Column:
    return F.concat(_quoted(F.col("o")), F.coalesce(F.concat(F.lit("@"), "lang"), F.lit("")))


def n_triples(graph: DataFrame) -> DataFrame:
    """A line of N-Triples for each triple: absolute names in angle brackets, literals escaped."""
    name = lambda c: F.concat(F.lit("<"), full_uri(F.col(c)), F.lit(">"))
    o = F.when(F.col("o_kind") == "uri", name("o")).otherwise(_literal())
    return graph.select(F.concat_ws(" ", name("s"), name("p"), o, F.lit(".")).alias("value"))


def turtle(graph: DataFrame) -> DataFrame:
    """A block for each subject, in order of s; the prefixes go before them."""
    o = F.when(F.col("o_kind") == "uri", F.col("o")).otherwise(_literal())
    rows = graph.distinct().withColumn("po", F.concat_ws(" ", "p", o))
    return rows.groupBy("s").agg(F.concat(F.first("s"), F.lit(" "), F.array_join(F.array_sort(F.collect_list("po")), " ;\n    "), F.lit(" .")).alias("value"))


def rdf_xml(graph: DataFrame) -> DataFrame:
    """An rdf:Description for each subject."""

    def esc(c: Column) -> Column:
        for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(plain), F.lit(written))
        return c

    one = F.when(F.col("o_kind") == "uri", F.concat(F.lit("<"), "p", F.lit(' rdf:resource="'), esc(full_uri(F.col("o"))), F.lit('"/>'))).otherwise(
        F.concat(F.lit("<"), "p", F.coalesce(F.concat(F.lit(' xml:lang="'), "lang", F.lit('"')), F.lit("")), F.lit(">"), esc(F.col("o")), F.lit("</"), "p", F.lit(">"))
    )
    rows = graph.distinct().withColumn("x", one).withColumn("about", esc(full_uri(F.col("s"))))
    return rows.groupBy("about").agg(F.concat(F.lit('<rdf:Description rdf:about="'), F.first("about"), F.lit('">\n  '), F.array_join(F.array_sort(F.collect_list("x")), "\n  "), F.lit("\n</rdf:Description>")).alias("value"))


def json_ld(graph: DataFrame) -> DataFrame:
    """A JSON object for each subject, with lists of values by property."""
    value = F.to_json(F.when(F.col("o_kind") == "uri", F.struct(F.col("o").alias("@id"), F.lit(None).cast("string").alias("@value"), F.lit(None).cast("string").alias("@language"))).otherwise(F.struct(F.lit(None).cast("string").alias("@id"), F.col("o").alias("@value"), F.col("lang").alias("@language"))))
    by_p = graph.distinct().withColumn("v", value).groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_list("v")), ",").alias("vs"))
    pair = F.concat(T.json_text(F.col("p")), F.lit(":["), "vs", F.lit("]"))
    return by_p.withColumn("x", pair).groupBy("s").agg(F.concat(F.lit('{"@id":'), T.json_text(F.first("s")), F.lit(","), F.array_join(F.array_sort(F.collect_list("x")), ","), F.lit("}")).alias("value"))


def metrics_json(per_doc: DataFrame, overall: DataFrame) -> DataFrame:
    """Metrics of documents (doc_id, level, ...) and overall (level, ...): a JSON line for each document, by level, and one
    named `overall`, so that no row grows with the corpus."""
    body = lambda df: F.struct(*[c for c in df.columns if c not in ("doc_id", "level")])
    levels = lambda df: F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", body(df).alias("m")))))).alias("value")
    docs = per_doc.groupBy(F.col("doc_id").cast("string").alias("name")).agg(levels(per_doc))
    return docs.unionByName(overall.groupBy(F.lit("overall").alias("name")).agg(levels(overall)))


def write_annotated(records: DataFrame, path: str, model: str = "") -> DataFrame:
    """Records (id, status, annotation): a line of JSON each in `path`/annotations, in as many files as there are tasks, and the summary in `path`/summary.
    Returns the summary's counts, observed while the records are written."""
    seen = Observation()
    counted = records.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("errors"))
    counted.select(F.col("annotation").alias("value")).filter("value IS NOT NULL").write.mode("overwrite").text(f"{path}/annotations")
    n = seen.get
    summary = records.sparkSession.createDataFrame([(n["total"], n["ok"], n["errors"])], "total long, ok long, errors long")
    meta = F.struct(F.lit(model).alias("model"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "total", "ok", "errors")
    summary.select(F.to_json(F.struct(meta.alias("meta"))).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/summary")
    return summary


def gold_format(docs: DataFrame, entities: DataFrame, relations: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and a document's annotation as a gold document in JSON: id, title (the product), source, entities, relations with ids, triples and notes."""
    e = entities.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", F.struct("id", "text", "class", "start", "confidence", F.lit("").alias("comment")).alias("v")))).alias("e"))
    sides = [F.col("subject_id").alias("subject"), "relation", F.col("object_id").alias("object")]
    r = relations.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", F.struct("id", *sides, "confidence", "evidence").alias("v")))).alias("r"))
    name = F.col(key).cast("string")
    values = lambda c: F.coalesce(F.transform(c, lambda x: x["v"]), F.array())
    body = F.struct(name.alias("id"), F.col("product").alias("title"), F.concat(name, F.lit(".txt")).alias("source"), values("e").alias("entities"), values("r").alias("relations"), F.array().cast("array<string>").alias("ontology_triples"), F.lit("").alias("annotation_notes"))
    rows = docs.select(key, "product").join(e, key, "left").join(r, key, "left")
    return rows.select(key, F.to_json(body, {"ignoreNullFields": "false"}).alias("annotation"))


def results_name(ids: list) -> str:
    """The file that results go to: that of the only document, or results.json."""
    return f"{ids[0]}.json" if len(ids) == 1 else "results.json"


def review_template(entities: DataFrame, relations: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and an empty review: a verdict to fill in for each entity and relation. See write_reviews()."""
    todo = [F.lit(None).cast("boolean").alias("correct"), F.lit(None).cast("string").alias("correct_class"), F.lit("").alias("comment")]
    e = entities.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "text", "class", *todo))).alias("entities_review"))
    r = relations.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "subject_text", "relation", "object_text", todo[0], todo[2]))).alias("relations_review"))
    body = F.struct(F.col(key).cast("string").alias("doc_id"), F.lit("").alias("reviewer"), "entities_review", F.array().cast("array<string>").alias("missing_entities"), "relations_review", F.lit(None).cast("int").alias("overall_score"), F.lit("").alias("notes"))
    return e.join(r, key, "left").select(key, F.to_json(body, {"ignoreNullFields": "false"}).alias("review"))


def write_reviews(reviews: DataFrame, path: str) -> None:
    """Write empty reviews; a folder that is there, and may hold verdicts, is left alone."""
    reviews.select(F.col("review").alias("value")).write.mode("ignore").text(path)


def report(df: DataFrame, rows: int = 50) -> None:
    """Print a table."""
    df.show(rows, truncate=False)
