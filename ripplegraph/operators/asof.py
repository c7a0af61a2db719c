"""As-of joins: for each asked place of a key the measured points on either side, and values between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written


def bracketed(asks: DataFrame, points: DataFrame, keys: list[str], at: str, value: str, partitions: int = 32) -> DataFrame:
    """asks with below and above, structs (at, value) of the nearest points of the same keys at or below and above; null where none is.

    Asks and points are dealt together by ranges of (keys, at), so a key with most rows is shared out. Within a range a window
    looks either way; where the nearest point lies in another range it is carried from that range's first or last point of
    the key. Of points at one place any one counts, so these should be summarised before.
    """
    point = F.struct(F.col(at).cast("double").alias("at"), F.col(value).cast("double").alias("value"))
    extra = [c for c in asks.columns if c not in (*keys, at)]
    left = asks.select(*keys, F.col(at).cast("double").alias("_at"), F.lit(1).alias("_ask"), F.struct(*(F.col(c) for c in extra), F.lit(0).alias("_")).alias("_rest"), F.lit(None).cast("struct<at: double, value: double>").alias("_point"))
    right = points.filter(F.col(at).isNotNull()).select(*keys, F.col(at).cast("double").alias("_at"), F.lit(0).alias("_ask"), F.lit(None).cast(left.schema["_rest"].dataType).alias("_rest"), point.alias("_point"))
    dealt = written(left.unionByName(right).repartitionByRange(partitions, *keys, "_at", "_ask").withColumn("_range", F.spark_partition_id()), "asof")
    here = W.partitionBy("_range", *keys).orderBy("_at", "_ask")
    found = dealt.withColumn("_below", F.last("_point", True).over(here.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("_above", F.first("_point", True).over(here.rowsBetween(W.currentRow, W.unboundedFollowing)))
    ends = dealt.groupBy("_range", *keys).agg(F.min("_point").alias("first"), F.max("_point").alias("last"))
    across = W.partitionBy(*keys).orderBy("_range")  # a row for each range that the key has rows in
    ends = ends.select("_range", *keys, F.last("last", True).over(across.rowsBetween(W.unboundedPreceding, -1)).alias("before"), F.first("first", True).over(across.rowsBetween(1, W.unboundedFollowing)).alias("after"))
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"e.{c}")) for c in ("_range", *keys)]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    got = found.filter("_ask = 1").alias("f").join(ends.alias("e"), condition)
    return got.select(*(F.col(f"f.{c}").alias(c) for c in keys), F.col("f._at").alias(at), *(F.col(f"f._rest.{c}").alias(c) for c in extra), F.coalesce("f._below", "e.before").alias("below"), F.coalesce("f._above", "e.after").alias("above"))


def log_linear(at: Column, below: Column, above: Column) -> Column:
    """The value at a place between two points (at, value), linear in the logarithm of the place; null outside, and at places that have no logarithm."""
    exact = below["at"] == at
    share = F.try_divide(F.ln(at) - F.ln(below["at"]), F.ln(above["at"]) - F.ln(below["at"]))
    return F.when(exact, below["value"]).otherwise(below["value"] + share * (above["value"] - below["value"]))


def estimates(scenarios: DataFrame, measured: DataFrame, keys: list[str], budget: float, rate: str = "rate", value: str = "value", partitions: int = 32) -> DataFrame:
    """scenarios with estimate and decision: run if the interpolated value is within the budget, skip if not, unknown outside the measured rates."""
    got = bracketed(scenarios, measured, keys, rate, value, partitions)
    estimate = log_linear(F.col(rate), F.col("below"), F.col("above"))
    decision = F.when(estimate.isNull(), "unknown").when(estimate <= budget, "run").otherwise("skip")
    return got.withColumn("estimate", estimate).withColumn("decision", decision).drop("below", "above")
