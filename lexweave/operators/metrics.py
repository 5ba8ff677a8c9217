"""Metrics over counts of true and false positives and misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as T


def scored(counts: DataFrame) -> DataFrame:
    """counts with precision, recall and f1, not rounded."""
    return counts.select("*", *T.prf(F.col("tp"), F.col("fp"), F.col("fn")))


def rounded(rated: DataFrame, digits: int = 3) -> DataFrame:
    """Ratings as reports show them; ties go to the even digit."""
    return rated.withColumns({c: F.bround(c, digits) for c in ("precision", "recall", "f1")})


def micro(counts: DataFrame, by: list[str]) -> DataFrame:
    """Counts summed over the documents first, then rated."""
    return scored(counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def tallied(rows: DataFrame, by: list[str], gold: Column, predicted: Column) -> DataFrame:
    """True and false positives and misses of two yes-no columns, by group."""
    return rows.groupBy(*by).agg(F.count_if(gold & predicted).alias("tp"), F.count_if(~gold & predicted).alias("fp"), F.count_if(gold & ~predicted).alias("fn"))


def active(per_class: DataFrame) -> DataFrame:
    return per_class.filter("tp + fp + fn > 0")


def compared(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both, left-only and right-only rows by key, and whether the values of both differ (two missing values don't). Later rows replace earlier ones
    before; tables have `ord`."""
    side = lambda df, name: df.groupBy(*keys).agg(F.max_by(F.struct(F.col(value).alias("v")), "ord").alias(name))
    rows = side(left, "l").join(side(right, "r"), keys, "full_outer")
    where = F.when(F.col("r").isNull(), "left_only").when(F.col("l").isNull(), "right_only").otherwise("both")
    rows = rows.select(*keys, F.col("l.v").alias("left_value"), F.col("r.v").alias("right_value"), where.alias("where"))
    return rows.withColumn("mismatch", (F.col("where") == "both") & ~F.col("left_value").eqNullSafe(F.col("right_value")))
