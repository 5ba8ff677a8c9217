"""From raw documents to encoded training data, stage by stage.

Each stage is one of the operators of lexweave.llm, takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next stage's docs. All but the last return the columns
of documents:

1. quality: documents that the line rules reject go, and lines that fail are cut out of the others;
2. near_duplicates: one document of each class of near duplicates stays, that with the least doc_id;
3. pii: spans with personal data are masked;
4. mixing: each document stays as often as its rate says in expectation; the good domain keeps its tokens, others are cut;
5. encoding: token ids of each document, with their digests and the decoded text's.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import mixing, neardup, pieces, pii, quality
from lexweave.llm.common import materialize, release, table, written_so_far

#: Tokens that each domain should have, as multiples of what it is expected to have.
WANTED = {"good": 1.0, "low": 0.5, "toxic": 0.3}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without the lines that fail; n_chars is counted anew.

    Null, empty and short texts (under 50 words) are rejected; very long ones are judged whole; repeated rows each alike. An empty
    table stays empty. Extra columns pass through, whatever their names."""
    # The row goes along as one value, as columns of its own may be named like results.
    judged = quality.line_first(docs.select("text", F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"))).filter("kept")
    changed = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    return judged.select(*[changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the least doc_id.

    Null and empty texts are a class of their own; of rows alike in doc_id and words one stays; very long texts count whole. An empty
    table stays empty. Extra columns pass through, whatever their names."""
    return neardup.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data masked; n_chars is counted anew. The labelers' weights are learnt from these documents.

    A null text stays null, an empty one empty; very long texts are searched whole; repeated rows are masked alike. An empty table stays
    empty. Extra columns pass through, whatever their names."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says in expectation, so that the domains' expected tokens are WANTED times what they were.

    Null and empty texts have no tokens and the rate of a text without words; rows alike in doc_id are documents of their own; labels for
    none of the documents are passed over. An empty table stays empty. Extra columns pass through, whatever their names."""
    return mixing.take(docs, table(spark, sf_dir, "labels"), WANTED)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each document.

    A null text is encoded as the empty one; very long texts whole; repeated rows alike. An empty table gives no rows. Extra
    columns are not read."""
    return pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=True).drop("decoded")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]
#: Several stages run models and hashes that SQL doesn't have; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents. What a stage wrote for itself, and its input, are removed once its result is written."""
    docs, began = table(spark, sf_dir, "documents"), written_so_far()
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        release(spark, began, keep=[docs])
    return STAGES[-1][1](spark, docs, sf_dir)
