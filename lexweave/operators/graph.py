"""The ontology as a table of triples: s, p, o, whether o is a literal, and its language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.functions import vocabulary as V

SCHEMA = "s string, p string, o string, o_kind string, lang string"


def base(spark: SparkSession, agent: bool = False) -> DataFrame:
    """Classes, product subclasses and properties, as the rule graph has them or, with one property more and
    the ontology's own node, the agents' graph."""
    rows = [("fin:FinancialProductsOntology", "rdf:type", "owl:Ontology", "uri", None), ("fin:FinancialProductsOntology", "rdfs:label", "Онтология финансовых продуктов", "literal", "ru")] if agent else []
    for name, label in {**V.CLASSES, **V.SUBCLASSES}.items():
        rows += [(f"fin:{name}", "rdf:type", "owl:Class", "uri", None), (f"fin:{name}", "rdfs:label", label, "literal", "ru")]
    rows += [(f"fin:{name}", "rdfs:subClassOf", "fin:FinancialProduct", "uri", None) for name in V.SUBCLASSES]
    for name, domain, range_, label in V.PROPERTIES if agent else V.PROPERTIES[:-1]:
        rows += [(f"fin:{name}", "rdf:type", "owl:ObjectProperty", "uri", None), (f"fin:{name}", "rdfs:label", label, "literal", "ru")]
        rows += [(f"fin:{name}", p, f"fin:{c}", "uri", None) for p, c in (("rdfs:domain", domain), ("rdfs:range", range_)) if c]
    return spark.createDataFrame(rows, SCHEMA)


def _triple(s, p, o, kind: str = "uri", lang: str | None = None):
    lit = lambda x: F.lit(x) if x is None or isinstance(x, str) else x
    return F.struct(lit(s).alias("s"), lit(p).alias("p"), lit(o).alias("o"), F.lit(kind).alias("o_kind"), F.lit(lang).cast("string").alias("lang"))


def entity_triples(entities: DataFrame, agent: bool = False) -> DataFrame:
    """Of entities (text, class, doc_type and, for agents, confidence): a product is a class under its document type's
    parent, another entity an instance of its class."""
    # Equal entities of many documents are one before anything is made of them.
    entities = entities.select("text", "class", "doc_type", *(["confidence"] if agent else [])).distinct()
    name, product = T.uri(F.col("text")), F.col("class") == "FinancialProduct"
    parent = F.concat(F.lit("fin:"), T.mapped(F.col("doc_type"), V.PARENTS, F.lit("FinancialProduct")))
    found = [
        _triple(name, "rdf:type", F.when(product, F.lit("owl:Class")).otherwise(F.concat(F.lit("fin:"), F.col("class")))),
        _triple(name, "rdfs:label", F.col("text"), "literal", "ru"),
        F.when(product, _triple(name, "rdfs:subClassOf", parent)),
    ]
    if agent:
        found.append(_triple(name, "fin:confidence", F.round("confidence", 3).cast("string"), "literal"))
    return entities.select(F.explode(F.filter(F.array(*found), lambda t: t.isNotNull())).alias("t")).select("t.*").distinct()


def relation_triples(relations: DataFrame, evidence: bool = False) -> DataFrame:
    """Of triples (subject, relation, object, evidence) by text; with a node for the evidence, if asked for."""
    relations = relations.select("subject", "relation", "object", *(["evidence"] if evidence else [])).distinct()
    s, node = T.uri(F.col("subject")), T.evidence_id(F.col("subject"), F.col("relation"))
    found = [_triple(s, F.concat(F.lit("fin:"), F.col("relation")), T.uri(F.col("object")))]
    if evidence:
        has = F.coalesce(F.col("evidence"), F.lit("")) != ""
        found += [F.when(has, _triple(node, "rdf:type", "fin:Evidence")), F.when(has, _triple(node, "fin:about", s)), F.when(has, _triple(node, "rdfs:comment", F.substring("evidence", 1, 200), "literal", "ru"))]
    return relations.select(F.explode(F.filter(F.array(*found), lambda t: t.isNotNull())).alias("t")).select("t.*").distinct()


def close_matches(entities: DataFrame) -> DataFrame:
    """Links of entities to the external ontology, by their text without case. The table has twelve rows."""
    table = entities.sparkSession.createDataFrame(list(V.FIBO.items()), "label string, path string")
    hits = entities.select(F.lower("text").alias("label"), "text").join(F.broadcast(table), "label")
    return hits.select(_triple(T.uri(F.col("text")), "skos:closeMatch", F.concat(F.lit("fibo:"), F.col("path"))).alias("t")).select("t.*").distinct()


def accumulated(*parts: DataFrame) -> DataFrame:
    """The set union of graphs."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def stats(triples: DataFrame) -> DataFrame:
    """Triples, classes, properties, and instances: subjects with a type of this ontology. (Counting instances only when the graph
    holds no class at all, as a graph-wide test would, is not imitated.)"""
    kind = (F.col("p") == "rdf:type")
    return triples.distinct().agg(
        F.count("*").alias("triples"),
        F.count_if(kind & (F.col("o") == "owl:Class")).alias("classes"),
        F.count_if(kind & (F.col("o") == "owl:ObjectProperty")).alias("properties"),
        F.count_if(kind & F.col("o").startswith("fin:")).alias("instances"),
    )


def resolved(relations: DataFrame, entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """Relations whose two ids are entities, with their texts as subject and object."""
    s = entities.select(key, F.col("id").alias("subject_id"), F.col("text").alias("subject"))
    o = entities.select(key, F.col("id").alias("object_id"), F.col("text").alias("object"))
    return relations.join(s, [key, "subject_id"]).join(o, [key, "object_id"])
