"""The rule run from the command line: parsed texts in, annotations, graph and metrics out.

python -m lexweave --parsed "texts/*.txt" --out results [--manifest urls.txt] [--gold gold.json] [--doc ID ...] [--eval] [--quiet]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexweave.operators import graph as G
from lexweave.operators import matching as M
from lexweave.operators import metrics as S
from lexweave.operators import pipelines as P
from lexweave.operators import relations as R
from lexweave.sources import readers, sinks


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lexweave", description="Documents in, an evaluated knowledge graph out.")
    parser.add_argument("--parsed", required=True, help="parsed text files")
    parser.add_argument("--manifest", help="the manifest, for the documents' types")
    parser.add_argument("--gold", help="gold annotations")
    parser.add_argument("--out", required=True, help="folder for the results")
    parser.add_argument("--doc", nargs="*", help="ids of documents; all, if not given")
    parser.add_argument("--eval", action="store_true", help="rate the result by the gold annotations")
    parser.add_argument("--quiet", action="store_true")
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("lexweave").getOrCreate()

    parsed = readers.read_parsed(spark, a.parsed)
    types = readers.type_lookup(readers.manifest(readers.read_manifest(spark, a.manifest))[0]) if a.manifest else spark.createDataFrame([], "name string, type string")
    gold = readers.filled_gold(readers.read_gold(spark, a.gold), types, parsed) if a.gold else spark.createDataFrame([], "doc_ord int, id string, title string, source string, type string, text string")
    docs = readers.corpus(gold, parsed, types, a.doc or None).withColumnRenamed("id", "doc_id")
    found = P.rules(docs)
    records = sinks.gold_format(docs, found.entities, R.resolved_again(found.relations, found.entities))
    name = sinks.results_name([r.doc_id for r in docs.select("doc_id").limit(2).collect()])
    records.select(F.col("annotation").alias("value")).write.mode("overwrite").text(f"{a.out}/{name}")
    sinks.turtle(found.graph).select("value").write.mode("overwrite").text(f"{a.out}/ontology.ttl")
    sinks.rdf_xml(found.graph).select("value").write.mode("overwrite").text(f"{a.out}/ontology.owl")
    if not a.quiet:
        sinks.report(G.stats(found.graph))
    if a.eval:
        if not a.gold:
            parser.error("--eval needs --gold")
        rows = gold.select(F.col("id").alias("doc_id"), "entities", "relations")
        ents = rows.select("doc_id", F.posexplode("entities").alias("ord", "e")).select("doc_id", "ord", "e.id", "e.text", "e.class")
        rels = rows.select("doc_id", F.posexplode("relations").alias("ord", "r")).select("doc_id", "ord", "r.subject", "r.relation", "r.object", "r.subject_text", "r.object_text")
        rels = M.resolved_texts(rels, ents).select("doc_id", "ord", "subject_text", "relation", "object_text")
        each, overall = P.evaluated(found.entities.select("doc_id", "ord", "text", "class"), found.relations.select("doc_id", "ord", "subject_text", "relation", "object_text"), ents.drop("id"), rels)
        sinks.metrics_json(S.rounded(each), S.rounded(overall)).select("value").write.mode("overwrite").text(f"{a.out}/eval.json")
        if not a.quiet:
            sinks.report(S.rounded(overall))


if __name__ == "__main__":
    main()
