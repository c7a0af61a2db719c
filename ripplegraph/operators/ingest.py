"""From raw rows to known rows, edges, class means, region counts and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from ..sources.adapters import MISSING_REGIONS

P = [f"p{i}" for i in range(6)]


def missing_to_null(label: Column, missing=MISSING_REGIONS) -> Column:
    return F.when(~label.isin(*missing), label)


def label_counts(rows: DataFrame, label: str, weight: str | None = None, labels=MISSING_REGIONS) -> DataFrame:
    """One row per label (also those that do not occur): label, n, the number of rows or the sum of a weight."""
    w = F.col(weight) if weight else F.lit(1)
    sums = rows.agg(*(F.coalesce(F.sum(F.when(F.col(label) == x, w)), F.lit(0)).cast("long").alias(x) for x in labels))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(x).alias("label"), F.col(x).alias("n")) for x in labels))).alias("r")).select("r.*")


def dense_index(df: DataFrame, column: str, out: str = "idx", partitions: int = 64) -> DataFrame:
    """Distinct values in ascending order with their position from 0.

    Ranges are numbered by themselves and shifted by the sizes of the ranges before, so no task holds all values.
    """
    ranges = written(df.select(column).filter(F.col(column).isNotNull()).distinct().repartitionByRange(partitions, column).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    shift = sizes.select("range", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    place = F.row_number().over(W.partitionBy("range").orderBy(column)) - 1 + F.col("shift")
    return ranges.join(shift, "range").select(column, place.cast("long").alias(out))


def lookup(values: DataFrame, column: str, nodes: DataFrame, strict: bool = False) -> DataFrame:
    """values with found, whether the column's value is a known node. strict: raise at the first unknown one."""
    got = values.join(nodes.select(F.col("id").alias(column), F.lit(True).alias("found")), column, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    if strict:
        got = got.withColumn("found", F.when(F.col("found"), True).otherwise(F.raise_error(F.concat(F.lit("unknown id: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))))
    return got


def with_ends(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows with src_known and dst_known. The planner broadcasts the nodes where they are small enough."""
    a = nodes.select(F.col("id").alias("src"), F.lit(True).alias("src_known"))
    b = nodes.select(F.col("id").alias("dst"), F.lit(True).alias("dst_known"))
    return rows.join(a, "src", "left").join(b, "dst", "left").na.fill(False, ["src_known", "dst_known"])


def known_rows(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows between known nodes with a positive weight; missing regions are null."""
    keep = rows.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return weighted_rows(keep)


def weighted_rows(rows: DataFrame) -> DataFrame:
    """Rows with a positive weight; missing regions are null."""
    return rows.filter("weight > 0").withColumn("region", missing_to_null(F.col("region")))


def dealt(known: DataFrame, many: int = 500_000) -> DataFrame:
    """The rows of a written table by edge, in tasks of about `many` rows.

    Most rows are an edge of their own, so tables of partial sums of a file or of what adaptive execution puts together grow with its
    size; here they hold no more than the rows of a task.
    """
    tasks = max(known.sparkSession.sparkContext.defaultParallelism, -(-known.count() // many))  # reads file footers only
    return known.repartition(tasks, "src", "dst")


def edges(known: DataFrame) -> DataFrame:
    return known.groupBy("src", "dst").agg(F.sum("weight").cast("long").alias("weight"))


def simple_graph(edge: DataFrame, least: int = 1) -> DataFrame:
    """Edges of at least this weight without self-loops."""
    return edge.filter((F.col("weight") >= least) & (F.col("src") != F.col("dst")))


def predicted(table: DataFrame | None = None) -> Column:
    """Whether a row has a prediction: none of its six probabilities is NaN or null."""
    ok = F.lit(True)
    for p in P:
        ok = ok & F.col(p).isNotNull() & ~F.isnan(p)
    return ok


def class_means(known: DataFrame) -> DataFrame:
    """Of each edge: the weighted means of the six probabilities over its predicted rows, as bytes (rint(255 p)); zeros without any."""
    w = F.when(predicted(), F.col("weight"))
    quantized = [F.coalesce(F.rint(F.sum(w * F.col(p)) / F.sum(w) * 255), F.lit(0)).cast("int").alias(f"q{i}") for i, p in enumerate(P)]
    return known.groupBy("src", "dst").agg(F.sum("weight").cast("long").alias("weight"), *quantized)


def dominant_class(q: DataFrame, fallback: Column | None = None) -> Column:
    """Position of the first largest of q0..q5; the fallback where all are 0."""
    a = F.array(*(F.col(f"q{i}") for i in range(6)))
    return F.when(F.array_max(a) > 0, (F.array_position(a, F.array_max(a)) - 1).cast("int")).otherwise(fallback if fallback is not None else F.lit(None).cast("int"))


def row_quality(known: DataFrame) -> DataFrame:
    """One row of counters on the predictions of rows."""
    some = F.lit(False)
    total = F.lit(0.0)
    outside = F.lit(False)
    for p in P:
        bad = F.col(p).isNull() | F.isnan(p)
        some = some | bad
        total = total + F.col(p)
        outside = outside | (~bad & ((F.col(p) < 0) | (F.col(p) > 1)))
    none = F.lit(True)
    for p in P:
        none = none & (F.col(p).isNull() | F.isnan(p))
    n = lambda c: F.count_if(c).cast("long")
    return known.agg(n(none).alias("rows_unpredicted"), n(some & ~none).alias("rows_partly_nan"), n(outside).alias("rows_outside"), n(predicted() & (F.abs(total - 1) > 0.01)).alias("rows_sum_off"), F.coalesce(F.sum(F.when(none, F.col("weight"))), F.lit(0)).cast("long").alias("weight_unpredicted"))


def class_quality(known: DataFrame) -> DataFrame:
    """One row of counters on the predictions of rows and of edges."""
    n = lambda c: F.count_if(c).cast("long")
    per_edge = dealt(known.select("src", "dst", predicted().alias("ok"))).groupBy("src", "dst").agg(F.count_if("ok").alias("good"), F.count(F.lit(1)).alias("all"))
    by_edge = per_edge.agg(n(F.col("good") == 0).alias("edges_unpredicted"), n((F.col("good") > 0) & (F.col("good") < F.col("all"))).alias("edges_partly_predicted"))
    return row_quality(known).crossJoin(by_edge)  # one row with one row


def observations(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row on what ingest drops and keeps; nothing is dropped silently."""
    n = lambda c: F.count_if(c).cast("long")
    ok = F.col("src_known") & F.col("dst_known") & (F.col("weight") > 0)
    return with_ends(rows, nodes).agg(
        F.count(F.lit(1)).alias("rows"),
        n(~F.col("src_known")).alias("src_unknown"),
        n(~F.col("dst_known")).alias("dst_unknown"),
        n(F.col("weight") <= 0).alias("no_weight"),
        n(ok).alias("kept"),
        n(~ok).alias("dropped"),
        F.coalesce(F.sum(F.when(ok, F.col("weight"))), F.lit(0)).cast("long").alias("kept_weight"),
        n(F.col("region") == MISSING_REGIONS[0]).alias("region_unasgd"),
        n(F.col("region") == MISSING_REGIONS[1]).alias("region_none"),
        F.count_distinct(F.when(ok, missing_to_null(F.col("region")))).alias("regions"),
    )


def edge_stats(edge: DataFrame, at_least: int = 5) -> DataFrame:
    return edge.agg(
        F.count(F.lit(1)).alias("edges"),
        F.sum("weight").cast("long").alias("weight"),
        F.count_if(F.col("src") == F.col("dst")).cast("long").alias("self_loops"),
        F.max("weight").alias("max_weight"),
        F.count_if(F.col("weight") >= at_least).cast("long").alias("edges_at_least"),
    )


def duplicate_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """One row: how many rows repeat another's keys."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("repeats"))


def independent_totals(rows: DataFrame, at_least: int = 5) -> DataFrame:
    """The store's totals derived anew from raw rows by another plan."""
    pairs = rows.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    strong = pairs.filter(F.col("weight") >= at_least)
    ends = strong.select("src").union(strong.select("dst")).agg(F.count_distinct("src").alias("nodes_at_least"))
    return pairs.agg(F.sum("n").cast("long").alias("rows"), F.count(F.lit(1)).alias("pairs"), F.sum("weight").cast("long").alias("weight"), F.count_if(F.col("weight") >= at_least).cast("long").alias("pairs_at_least"), F.count_if(F.col("src") == F.col("dst")).cast("long").alias("self_pairs")).crossJoin(ends)


def region_counts(rows: DataFrame, side: str, numbered: bool = False) -> DataFrame:
    """Weight per node and region on one side (src or dst), with ends that are unknown at the other; numbered: and the number of rows."""
    number = [F.count(F.lit(1)).alias("rows")] if numbered else []
    return rows.groupBy(F.col(side).alias("id"), missing_to_null(F.col("region")).alias("region")).agg(F.sum("weight").cast("long").alias("n"), *number)


def home_region(src_counts: DataFrame, dst_counts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of each node the region with the largest count on the source side, else on the other side.

    The missing region is a candidate; of equal regions the missing one, then the alphabetically first wins.
    """

    def best(counts: DataFrame, name: str) -> DataFrame:
        w = W.partitionBy("id").orderBy(F.col("n").desc(), F.col("region").asc_nulls_first())
        return counts.withColumn("r", F.row_number().over(w)).filter("r = 1").select("id", F.col("region").alias(name))

    got = nodes.select("id").join(best(src_counts, "a"), "id", "left").join(best(dst_counts, "b"), "id", "left")
    return got.select("id", F.coalesce("a", "b").alias("home"))


def numeric_text_id(text: Column) -> Column:
    """An id written as 123 or 123.0; a real fraction raises, empty text is null."""
    return F.regexp_replace(F.nullif(text, F.lit("")), r"\.0+$", "").cast("long")


def last_annotation(annotations: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last in order, with how often the key occurs."""
    w = W.partitionBy(key)
    return annotations.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy(F.col(order).desc()))).filter("r = 1").drop("r")


def reverse_slots(edge: DataFrame, partitions: int = 64) -> DataFrame:
    """Position of each edge when edges are ordered by (dst, src): the transposed order."""
    ranges = written(edge.select("src", "dst").repartitionByRange(partitions, "dst", "src").withColumn("range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    shift = sizes.select("range", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    place = F.row_number().over(W.partitionBy("range").orderBy("dst", "src")) - 1 + F.col("shift")
    return ranges.join(shift, "range").select("src", "dst", place.cast("long").alias("slot"))


def row_offsets(edge: DataFrame) -> DataFrame:
    """Number of each source's edges and of all edges of smaller sources (the offsets of a row-compressed layout)."""
    degree = edge.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    blocks = degree.withColumn("block", F.floor(F.col("src") / 4096))
    above = blocks.groupBy("block").agg(F.sum("degree").alias("n")).select("block", F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.sum("degree").over(W.partitionBy("block").orderBy("src").rowsBetween(W.unboundedPreceding, W.currentRow))
    return blocks.join(above, "block").select("src", "degree", (within - F.col("degree") + F.col("before")).cast("long").alias("offset"))
