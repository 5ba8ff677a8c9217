"""Extension: documents as a stream of files; each micro-batch goes through the same transformations and adds
its new triples to a graph on storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def accumulate(spark: SparkSession, source: str, schema: StructType, transform: Callable[[DataFrame], DataFrame], graph: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Start a query over Parquet files that appear in `source`. transform() maps documents to triples; those that
    the graph doesn't have yet are appended, each batch in a folder of its own, so that a batch that is run again replaces its own.

    Triples lie in buckets by a hash of their subject, and a batch is compared with the buckets that it touches only."""

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        found = transform(batch).distinct()
        columns = found.columns
        found = found.withColumn("bucket", F.pmod(F.xxhash64("s"), F.lit(buckets)).cast("int"))
        at = session._jvm.org.apache.hadoop.fs.Path(f"{graph}/batch=*/bucket=*")
        if at.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).globStatus(at):
            touched = [r.bucket for r in found.select("bucket").distinct().collect()]  # no more than there are buckets
            known = session.read.option("basePath", graph).schema(f"{batch_schema(found)}, batch int").parquet(graph).filter(F.col("bucket").isin(touched) & (F.col("batch") != number))
            same = [found[c].eqNullSafe(known[c]) for c in columns]
            found = found.join(known, [found["bucket"] == known["bucket"], *same], "left_anti")
        found.write.mode("overwrite").partitionBy("bucket").parquet(f"{graph}/batch={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
