"""Statistics of a simple directed weighted graph given as edges (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written


def degrees(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """In and out degree and weight of every node, 0 where it has none."""
    out = edge.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"), F.sum("weight").alias("out_weight"))
    into = edge.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"), F.sum("weight").alias("in_weight"))
    got = nodes.select("id").join(out, "id", "left").join(into, "id", "left")
    return got.select("id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("out_degree", "in_degree", "out_weight", "in_weight")))


def value_counts(values: DataFrame, column: str) -> DataFrame:
    """(v, n): each distinct value and how often it occurs; all distribution measures below work on this."""
    return values.groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")).filter("v IS NOT NULL")


def _cumulative(counts: DataFrame, descending: bool = False, block: int = 1 << 12) -> DataFrame:
    """Distinct values with n_upto and sum_upto, over all values up to and with this one (from the top if descending).

    Values are cut into ranges, whose totals are summed first.
    """
    parts = written(counts.repartitionByRange(32, F.col("v").desc() if descending else F.col("v")).withColumn("range", F.spark_partition_id()), "values")
    totals = parts.groupBy("range").agg(F.sum("n").alias("rn"), F.sum(F.col("v") * F.col("n")).alias("rs"))
    past = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("range", F.coalesce(F.sum("rn").over(past), F.lit(0)).alias("n0"), F.coalesce(F.sum("rs").over(past), F.lit(0.0)).alias("s0"))
    own = W.partitionBy("range").orderBy(F.col("v").desc() if descending else F.col("v")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return parts.join(totals, "range").select("v", "n", (F.sum("n").over(own) + F.col("n0")).alias("n_upto"), (F.sum(F.col("v") * F.col("n")).over(own) + F.col("s0")).alias("sum_upto"))


def gini(values: DataFrame, column: str) -> DataFrame:
    """One row: the Gini coefficient, 0 if the total is 0."""
    c = _cumulative(value_counts(values, column))
    # The ranks of n equal values that end at n_upto sum to n * (n_upto - (n - 1) / 2).
    ranked = F.sum(F.col("v") * F.col("n") * (F.col("n_upto") - (F.col("n") - 1) / 2))
    n, total = F.sum("n"), F.sum(F.col("v") * F.col("n"))
    return c.agg(F.when(total == 0, F.lit(0.0)).otherwise(2 * ranked / F.nullif(n * total, F.lit(0.0)) - (n + 1) / n).alias("gini"))


def top_share(values: DataFrame, column: str, fraction: float = 0.01) -> DataFrame:
    """One row: the share of the total that the largest max(1, round(fraction n)) values hold (half to even)."""
    c = _cumulative(value_counts(values, column), descending=True)
    size = c.agg(F.sum("n").alias("all_n"), F.sum(F.col("v") * F.col("n")).alias("total")).select("total", F.greatest(F.lit(1), F.bround(F.col("all_n") * fraction)).alias("k"))
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.col("k") - (F.col("n_upto") - F.col("n"))))
    return c.crossJoin(F.broadcast(size)).agg(F.coalesce(F.sum(taken * F.col("v")) / F.nullif(F.max("total"), F.lit(0.0)), F.lit(0.0)).alias("share"))


def summary(values: DataFrame, column: str) -> DataFrame:
    """One row: mean, std (population), median, p90, p99, max, zeros."""
    v = F.col(column).cast("double")
    q = F.percentile(v, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    got = values.agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), q.alias("q"), F.max(v).alias("max"), F.count_if(v == 0).cast("long").alias("zeros"))
    return got.select("mean", "std", F.col("q")[0].alias("median"), F.col("q")[1].alias("p90"), F.col("q")[2].alias("p99"), "max", "zeros")


def average_ranks(values: DataFrame, column: str, out: str) -> DataFrame:
    """(v, rank): of each distinct value the mean rank of its occurrences."""
    return _cumulative(value_counts(values, column)).select(F.col("v").alias(column), (F.col("n_upto") - (F.col("n") - 1) / 2).alias(out))


def correlations(values: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Pearson's and Spearman's correlation (average ranks for ties)."""
    x = values.select(F.col(a).cast("double").alias(a), F.col(b).cast("double").alias(b))
    ranked = x.join(average_ranks(x, a, "ra"), a).join(average_ranks(x, b, "rb"), b)
    return ranked.agg(F.corr(a, b).alias("pearson"), F.corr("ra", "rb").alias("spearman"))


def reciprocity(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: edges, mutual edges and their share, density, its ratio, the expectation for the degrees, nodes with a mutual partner."""
    back = edge.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    mutual = edge.select("src", "dst").join(back, ["src", "dst"], "left_semi")
    d = degrees(edge, nodes).agg(F.count(F.lit(1)).alias("n"), F.sum("out_degree").alias("m"), F.sum(F.col("in_degree") * F.col("out_degree")).cast("double").alias("s"))
    got = mutual.agg(F.count(F.lit(1)).alias("mutual"), F.count_distinct("src").alias("with_partner")).crossJoin(d)
    m, density = F.nullif(F.col("m"), F.lit(0)), F.col("m") / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0))
    return got.select(F.col("m").alias("edges"), "mutual", (F.col("mutual") / m).alias("reciprocity"), density.alias("density"), (F.col("mutual") / m / F.nullif(density, F.lit(0.0))).alias("ratio"), (F.col("s") * F.col("s") / F.pow(m.cast("double"), F.lit(3))).alias("expected"), "with_partner")


def undirected(edge: DataFrame) -> DataFrame:
    """(lo, hi, weight): connected pairs with both directions' weights summed."""
    return edge.filter("src <> dst").groupBy(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).agg(F.sum("weight").cast("long").alias("weight"))


def both_ways(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, u, v) for both directions of undirected pairs."""
    return pairs.select(*by, F.explode(F.array(F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")), F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")))).alias("p")).select(*by, "p.*")


def wedges(pairs: DataFrame) -> DataFrame:
    d = both_ways(pairs).groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    return d.agg(F.coalesce(F.sum(F.expr("d * (d - 1) div 2")), F.lit(0)).cast("long").alias("wedges"))


def rich_club(edge: DataFrame, nodes: DataFrame, ks: list[int], by: tuple[str, ...] = ()) -> DataFrame:
    """Of each k (of each key): nodes of a total degree above k, edges among them, and their density (null for less than two nodes).

    Both counts are suffix sums of histograms by degree, so neither depends on the number of ks. With key columns `by` the
    edges are many graphs on the same nodes.
    """
    some = edge.select(*by, F.explode(F.array("src", "dst")).alias("id")).groupBy(*by, "id").agg(F.count(F.lit(1)).alias("d"))
    whole = nodes.select("id") if not by else edge.select(*by).distinct().crossJoin(nodes.select("id"))
    deg = whole.join(some, [*by, "id"], "left").na.fill(0, ["d"])
    at = lambda c, d: deg.select(*by, F.col("id").alias(c), F.col("d").alias(d))
    lower = edge.join(at("src", "a"), [*by, "src"]).join(at("dst", "b"), [*by, "dst"]).groupBy(*by, F.least("a", "b").alias("d")).agg(F.count(F.lit(1)).alias("e"), F.lit(0).cast("long").alias("n"))
    hist = lower.select(*by, "d", "e", "n").union(deg.groupBy(*by, "d").agg(F.lit(0).cast("long").alias("e"), F.count(F.lit(1)).alias("n")))
    asked = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.col("d").alias("d")) for k in sorted(set(ks)))))
    # every degree's bin goes to the ks below it; bins are few (distinct degrees), so are the ks
    binned = hist.groupBy(*by, "d").agg(F.sum("e").alias("e"), F.sum("n").alias("n"))
    got = binned.select(*by, asked.alias("q"), "e", "n").groupBy(*by, "q.k").agg(F.sum(F.when(F.col("q.d") > F.col("q.k"), F.col("n")).otherwise(0)).cast("long").alias("nodes"), F.sum(F.when(F.col("q.d") > F.col("q.k"), F.col("e")).otherwise(0)).cast("long").alias("edges"))
    return got.select(*by, "k", "nodes", "edges", F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).alias("phi"))


def rich_club_regime(curve: DataFrame, above: float = 1.01, least: int = 10) -> DataFrame:
    """One row on a normalised curve (k, value, nodes): first and last k above the bound, nodes above the first, whether all between
    are above (false if none is), largest and smallest value with their k and nodes, and the first k after the largest
    value whose value is below 1. Only points with at least `least` nodes count; of equal values the first k does."""
    c = curve.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("nodes") >= least))
    hit, point = F.col("value") > above, F.struct(F.col("k"), F.col("value"), F.col("nodes"))
    first = F.min(F.when(hit, F.struct("k", "nodes"))).alias("first")
    # the points of a curve are as many as the ks that were asked for, so a list of them is short
    ends = c.agg(first, F.max(F.when(hit, F.col("k"))).alias("last_k"), F.max_by(point, F.struct("value", F.negative("k"))).alias("most"), F.min_by(point, F.struct("value", "k")).alias("fewest"), F.array_sort(F.collect_list(point)).alias("points"))
    inside = F.filter("points", lambda x: x["k"].between(F.col("first.k"), F.col("last_k")))
    below = F.filter("points", lambda x: (x["k"] > F.col("most.k")) & (x["value"] < 1))
    return ends.select(
        F.col("first.k").alias("first_k"), F.col("first.nodes").alias("first_nodes"), "last_k",
        F.coalesce(F.col("first").isNotNull() & F.forall(inside, lambda x: x["value"] > above), F.lit(False)).alias("contiguous"),
        F.col("most.value").alias("top"), F.col("most.k").alias("top_k"), F.col("most.nodes").alias("top_nodes"),
        F.col("fewest.value").alias("low"), F.col("fewest.k").alias("low_k"), F.col("fewest.nodes").alias("low_nodes"),
        F.when(F.size(below) > 0, below[0]["k"]).alias("below_one_k"),
    )


def histogram(values: DataFrame, column: str, bounds: list[int]) -> DataFrame:
    """Counts in bins that start at the given ascending integers; the last one is open. Labels: a, a-b, >=z."""
    v, label, order = F.col(column), F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, lo in enumerate(bounds):
        hi = bounds[i + 1] - 1 if i + 1 < len(bounds) else None
        name = f">={lo}" if hi is None else str(lo) if hi == lo else f"{lo}-{hi}"
        label, order = F.when(v >= lo, F.lit(name)).otherwise(label), F.when(v >= lo, F.lit(i)).otherwise(order)
    return values.select(label.alias("bin"), order.alias("place")).filter("bin IS NOT NULL").groupBy("place", "bin").agg(F.count(F.lit(1)).alias("n"))


def group_matrix(edge: DataFrame, groups: DataFrame, label: str) -> DataFrame:
    """Weight and edges between groups of nodes: a_group, b_group, weight, edges. Nodes without a group are group null."""
    at = lambda c, g: groups.select(F.col("id").alias(c), F.col(label).alias(g))
    return edge.join(at("src", "a_group"), "src", "left").join(at("dst", "b_group"), "dst", "left").groupBy("a_group", "b_group").agg(F.sum("weight").cast("long").alias("weight"), F.count(F.lit(1)).alias("edges"))


def marginals(matrix: DataFrame) -> DataFrame:
    """One row per group: sent, received and own weight, and the weight with others."""
    long = matrix.select(F.explode(F.array(F.struct(F.col("a_group").alias("g"), F.col("weight").alias("sent"), F.lit(0).cast("long").alias("received"), F.when(F.col("a_group").eqNullSafe(F.col("b_group")), F.col("weight")).otherwise(0).alias("own")), F.struct(F.col("b_group").alias("g"), F.lit(0).cast("long").alias("sent"), F.col("weight").alias("received"), F.lit(0).cast("long").alias("own")))).alias("x")).select("x.*")
    return long.groupBy("g").agg(*(F.sum(c).cast("long").alias(c) for c in ("sent", "received", "own"))).withColumn("with_others", F.col("sent") + F.col("received") - 2 * F.col("own"))


def top_nodes(measure: DataFrame, by: str, k: int) -> DataFrame:
    """The k nodes with the largest value; of equal ones those with the larger id."""
    return measure.orderBy(F.col(by).desc(), F.col("id").desc()).limit(k)


def top_partners(edge: DataFrame, side: str, k: int) -> DataFrame:
    """Of each node its k strongest partners on one side; of equal ones those with the larger id."""
    other = "dst" if side == "src" else "src"
    w = W.partitionBy(side).orderBy(F.col("weight").desc(), F.col(other).desc())
    return edge.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select(F.col(side).alias("id"), F.col(other).alias("partner"), "weight", "place")


def contingency(labels: DataFrame, a: str, b: str) -> DataFrame:
    return labels.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def partition_agreement(labels: DataFrame, a: str, b: str) -> DataFrame:
    """One row: normalised mutual information (arithmetic mean of entropies) and adjusted Rand index of two partitions."""
    t = written(contingency(labels, a, b), "contingency")
    rows, cols = t.groupBy(a).agg(F.sum("n").alias("na")), t.groupBy(b).agg(F.sum("n").alias("nb"))
    total = t.agg(F.sum("n").cast("double").alias("t"))
    pairs = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    entropy = lambda c: -F.sum(F.col(c) / F.col("t") * F.ln(F.col(c) / F.col("t")))
    ha = rows.crossJoin(F.broadcast(total)).agg(entropy("na").alias("ha"), pairs("na").alias("pa"))
    hb = cols.crossJoin(F.broadcast(total)).agg(entropy("nb").alias("hb"), pairs("nb").alias("pb"))
    rows, cols = rows.withColumnRenamed(a, "_a"), cols.withColumnRenamed(b, "_b")
    joint = t.join(rows, F.col(a).eqNullSafe(F.col("_a"))).join(cols, F.col(b).eqNullSafe(F.col("_b"))).crossJoin(F.broadcast(total))
    mi = joint.agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"), pairs("n").alias("pn"), F.max("t").alias("t"))
    got = mi.crossJoin(ha).crossJoin(hb)
    chance = F.col("pa") * F.col("pb") / (F.col("t") * (F.col("t") - 1) / 2)
    return got.select(F.when(F.col("ha") + F.col("hb") == 0, 1.0).otherwise(2 * F.col("mi") / (F.col("ha") + F.col("hb"))).alias("nmi"), F.when((F.col("pa") + F.col("pb")) / 2 == chance, 1.0).otherwise((F.col("pn") - chance) / ((F.col("pa") + F.col("pb")) / 2 - chance)).alias("ari"))


def modularity(pairs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """One row: the weighted modularity of a partition of an undirected graph (lo, hi, weight)."""
    at = lambda c, g: labels.select(F.col("id").alias(c), F.col(label).alias(g))
    named = pairs.join(at("lo", "a"), "lo").join(at("hi", "b"), "hi").select("a", "b", F.col("weight").cast("double").alias("w"))
    long = named.select(F.explode(F.array(F.struct(F.col("a").alias("g"), F.col("w").alias("d"), F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0).alias("own")), F.struct(F.col("b").alias("g"), F.col("w").alias("d"), F.lit(0.0).alias("own")))).alias("x")).select("x.*")
    per = long.groupBy("g").agg(F.sum("d").alias("d"), F.sum("own").alias("own"))
    total = per.agg((F.sum("d") / 2).alias("m"))
    return per.crossJoin(F.broadcast(total)).agg(F.sum(F.col("own") / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), F.lit(2))).alias("modularity"))


def class_medians(measure: DataFrame, groups: DataFrame, label: str, columns: list[str]) -> DataFrame:
    return measure.join(groups.select("id", label), "id").groupBy(label).agg(F.count(F.lit(1)).alias("nodes"), *(F.median(c).alias(c) for c in columns))


def jaccard(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: the Jaccard similarity of two sets of values."""
    both = a.select(column).distinct().withColumn("a", F.lit(1)).join(b.select(column).distinct().withColumn("b", F.lit(1)), column, "full")
    return both.agg((F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("jaccard"))


def ccdf(values: DataFrame, column: str) -> DataFrame:
    """Of each distinct positive value the share of positive values that are at least as large."""
    pos = value_counts(values.filter(F.col(column) > 0), column)
    total = pos.agg(F.sum("n").alias("t"))
    return _cumulative(pos, descending=True).crossJoin(F.broadcast(total)).select("v", "n", (F.col("n_upto") / F.col("t")).alias("share"))


def lookup_node(edge: DataFrame, nodes: DataFrame, homes: DataFrame, node: int, k: int) -> DataFrame:
    """One row on a node: annotations, home, degrees, strongest partners either way as arrays of (partner, weight)."""
    own = edge.filter((F.col("src") == node) | (F.col("dst") == node))
    got = own.agg(F.count_if(F.col("src") == node).alias("out_degree"), F.count_if(F.col("dst") == node).alias("in_degree"), F.sum(F.when(F.col("src") == node, F.col("weight"))).alias("out_weight"), F.sum(F.when(F.col("dst") == node, F.col("weight"))).alias("in_weight"))
    to = top_partners(own.filter(F.col("src") == node), "src", k).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "partner", "weight"))), lambda x: F.concat_ws(":", x["partner"], x["weight"])), ",").alias("targets"))
    by = top_partners(own.filter(F.col("dst") == node), "dst", k).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "partner", "weight"))), lambda x: F.concat_ws(":", x["partner"], x["weight"])), ",").alias("sources"))
    return nodes.filter(F.col("id") == node).join(homes, "id", "left").crossJoin(got).crossJoin(to).crossJoin(by)
