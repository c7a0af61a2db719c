"""Report, figure and experiment queries on derived tables."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import functions as F

from ..operators import dynamics as D
from ..operators import ingest as I
from ..operators import nulls as N
from ..operators import paths as P
from ..operators import stats as S
from ..operators import warehouse as H
from ..session import ship, written
from ..sources import adapters as A
from ..sources.adapters import EVENTS_SQL, NODES_SQL
from .dynamics import PAIRED_SQL, PARAMS, RUNS_SQL, SEEDS, _samples, _sweep, runs
from .graph import COUNT_SQL, PAIRS_SQL, events, graph, homes, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("SELECT count(*) AS n, count(CASE WHEN p_size > 5 THEN p_brand END) AS cell_type, count(CASE WHEN p_size > 40 THEN p_size END) AS size FROM part")
def p10_presence(spark, sf):
    part = A.read(spark, sf, "part")
    return part.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("p_size") > 5, F.col("p_brand"))).alias("cell_type"), F.count(F.when(F.col("p_size") > 40, F.col("p_size"))).alias("size"))


@query("SELECT p_partkey AS id, [1, 1, -1, 1, -1, 1][p_partkey % 6 + 1] AS sign FROM part")
def p14_signs(spark, sf):
    sign = F.create_map(*(F.lit(x) for k, v in D.SIGNS.items() for x in (k, v)))
    return A.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), sign[(F.col("p_partkey") % 6).cast("int")].alias("sign"))


@query("""SELECT p_partkey AS id, sha256('{"p_partkey":' || p_partkey || ',"p_type":"' || p_type || '"}') AS digest FROM part""")
def p16_config_digest(spark, sf):
    return A.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), H.config_digest("p_type", "p_partkey").alias("digest"))


@query(f"WITH {NODES_SQL} SELECT sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS digest FROM nodes WHERE super_class = 'PROMO'")
def a24_list_digest(spark, sf):
    return H.list_digest(A.part_nodes(spark, sf).filter("super_class = 'PROMO'"), "id")


SERIES_SQL = f"""n AS (SELECT count(DISTINCT user_id) AS n FROM events), series AS (SELECT event_type AS run, CAST(event_id // 200 AS INT) AS t, CASE WHEN event_type = 'view' AND event_id // 200 > 30 THEN 0 ELSE count(*) END AS pulses, CAST(3 * count(*) AS BIGINT) AS arrivals FROM events GROUP BY event_type, event_id // 200)"""


def series(spark, sf):
    e = A.read(spark, sf, "events")
    t = F.expr("event_id div 200")
    got = e.groupBy(F.col("event_type").alias("run"), t.cast("int").alias("t")).agg(F.count(F.lit(1)).alias("c"))
    return got.select("run", "t", F.when((F.col("run") == "view") & (F.col("t") > 30), 0).otherwise(F.col("c")).alias("pulses"), (3 * F.col("c")).alias("arrivals"), F.when(F.col("t") < 30, F.floor(F.col("c") / F.length("run")).cast("long")).otherwise(0).alias("external"))


def users(spark, sf):
    return A.read(spark, sf, "events").select("user_id").distinct().count()


OFF = 30
_LAST = "CASE WHEN steps > 30 THEN greatest((steps - 30) // 3, 1) ELSE 0 END"
_TAIL = f"t >= steps - {_LAST}"


@query(f"WITH {SERIES_SQL}, s AS (SELECT *, max(t) OVER (PARTITION BY run) + 1 AS steps FROM series WHERE run <> 'click' OR t < 41) SELECT run, round(avg(pulses) FILTER (t < 30), 6) AS on, round(coalesce(avg(pulses) FILTER ({_TAIL}), 0), 6) AS late, min(t) FILTER (t >= 30 AND pulses = 0) AS first_silent, CAST(sum(pulses) AS BIGINT) AS pulses FROM s GROUP BY run".replace(" AS on,", ' AS "on",'))
def w9_off_window(spark, sf):
    """One of the runs ends earlier than the others."""
    return rounded(H.off_window(series(spark, sf).filter("run <> 'click' OR t < 41"), OFF))


@query(f"""WITH {SERIES_SQL}, s AS (SELECT *, max(t) OVER (PARTITION BY run) + 1 AS steps FROM series) SELECT run, steps, CAST(sum(pulses) AS BIGINT) AS pulses, CAST(sum(arrivals) AS BIGINT) AS arrivals,
round(sum(pulses) * 1000.0 / (n * steps), 6) AS hz, round(sum(arrivals) / greatest(sum(pulses), 1), 6) AS per_pulse, round(sum(pulses * least(2, steps - 1 - t)) / (n * steps), 6) AS occupancy, round(sum(pulses) / (n * steps), 6) AS per_slot, round(max(pulses) / n, 6) AS largest_step FROM s, n GROUP BY run, steps, n""")
def l13_w12_occupancy(spark, sf):
    return rounded(D.run_summary(series(spark, sf), users(spark, sf), PARAMS))


@query(f"""WITH {SERIES_SQL}, s AS (SELECT *, max(t) OVER (PARTITION BY run) + 1 AS steps FROM series),
m AS (SELECT run, coalesce(sum(pulses) FILTER (t < 30), 0) / (n * 30) AS a, coalesce(sum(pulses) FILTER (t >= 30 AND {_TAIL}), 0) / (n * greatest(max({_LAST}), 1)) AS l,
coalesce(sum(pulses) FILTER (t < 30), 0) / greatest(coalesce(sum(arrivals // 3 // length(run)) FILTER (t < 30), 0), 1) AS x FROM s, n GROUP BY run, n)
SELECT run, round(a, 6) AS rate_on, round(l, 6) AS rate_late, round(x, 6) AS amplification, CASE WHEN a >= 0.5 / 3 OR l >= 0.1 / 3 THEN 'SATURATED' WHEN x < 1.05 AND l = 0 THEN 'DEAD' ELSE 'STABLE' END AS regime, l > 0 AS self_sustained FROM m""")
def l14_regimes(spark, sf):
    return rounded(D.regimes(series(spark, sf), users(spark, sf), OFF, PARAMS))


@query(f"WITH {SERIES_SQL} SELECT length(run) AS key, t, median(pulses) AS median, min(pulses) AS least, max(pulses) AS largest FROM series GROUP BY 1, 2")
def f15_step_spread(spark, sf):
    return H.step_spread(series(spark, sf).withColumn("key", F.length("run")), "key")


@query(f"WITH {PAIRED_SQL} SELECT subgraph, round(arg_max(rate, median), 6) AS rate, round(max(median), 6) AS median FROM ratio GROUP BY 1")
def x26_best_ratio(spark, sf):
    return rounded(H.best_ratio(H.paired(runs(spark, sf), "wall", "a", "b")))


@query(f"WITH {RUNS_SQL} SELECT subgraph, round(rate, 6) AS rate, mode, median(wall) AS median, min(wall) AS least, max(wall) AS largest, count(*) AS n FROM runs GROUP BY ALL")
def f8_f9_f10_cells(spark, sf):
    return rounded(H.cell_statistics(runs(spark, sf), ["subgraph", "rate", "mode"], "wall"))


@query(f"WITH {RUNS_SQL}, c AS (SELECT subgraph, mode, median(wall) AS m FROM runs GROUP BY 1, 2) SELECT mode, round(exp(avg(ln(m))), 4) AS geometric_mean FROM c GROUP BY 1")
def x19_geometric_means(spark, sf):
    cells = H.cell_statistics(runs(spark, sf), ["subgraph", "mode"], "wall")
    return rounded(H.geometric_mean(cells, ["mode"], "median"), 4)


@query("SELECT o_orderpriority AS kind, count(*) AS comparisons, count(*) FILTER (o_custkey % 9 = 0) AS identical, max(o_totalprice) AS largest FROM orders GROUP BY 1")
def x29_equivalence_summary(spark, sf):
    o = A.read(spark, sf, "orders").select(F.col("o_orderpriority").alias("kind"), (F.col("o_custkey") % 9).alias("different"), F.col("o_totalprice").alias("gap"))
    return H.equivalence_summary(o, "kind")


@query(f"""WITH {COUNT_SQL}, r AS (SELECT home AS region, id FROM home WHERE home IN ('NATION_1', 'NATION_2', 'NATION_4')), c AS (SELECT region, count(*) AS nodes FROM r GROUP BY 1)
SELECT region, nodes, (SELECT count(*) FROM g JOIN r a ON src = a.id JOIN r b ON dst = b.id WHERE a.region = c.region AND b.region = c.region) AS edges FROM c""")
def g22_region_subgraphs(spark, sf):
    r = homes(spark, sf).filter("home IN ('NATION_1', 'NATION_2', 'NATION_4')").select(F.col("home").alias("region"), "id")
    m = S.group_matrix(graph(spark, sf), r, "region").filter("a_group = b_group").select(F.col("a_group").alias("region"), "edges")
    return r.groupBy("region").agg(F.count(F.lit(1)).alias("nodes")).join(m, "region", "left").select("region", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))


@query()
def g22_expanded_subgraph(spark, sf):
    ship(spark)
    edge = graph(spark, sf)
    chosen = written(P.expand(edge, 77, 100), "expansion")
    ids = chosen.select("id")
    inside = edge.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return inside.agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight")).crossJoin(H.list_digest(ids, "id"))


def _bottlenecks(spark, sf):
    edge, nodes = events(spark, sf)
    return P.bottlenecks(edge.filter("weight >= 2"), nodes, 64, 11), nodes


@query()
def g27_bottlenecks(spark, sf):
    """Each node's betweenness from either sample of sources and on average."""
    return rounded(_bottlenecks(spark, sf)[0][0], 4)


@query()
def g27_bottleneck_agreement(spark, sf):
    return rounded(_bottlenecks(spark, sf)[0][1], 4)


@query()
def g27_bottleneck_shares(spark, sf):
    """Which event type users have most of: its share among the top percent of bottlenecks and among all users."""
    from pyspark.sql import Window as W

    (values, _), nodes = _bottlenecks(spark, sf)
    counts = A.read(spark, sf, "events").groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    most = counts.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.col("n").desc(), "label"))).filter("r = 1").select("id", "label")
    return rounded(P.shares_at_the_top(values, "betweenness", nodes.join(most, "id", "left").select("id", "label")), 6)


@query(f"WITH {EVENTS_SQL}, s AS (SELECT src % 3 AS sample, src % 4 AS name, count(*) AS v FROM e GROUP BY 1, 2), r AS (SELECT src % 4 AS name, count(*) AS v FROM e GROUP BY 1) SELECT name, round(log2(r.v / avg(s.v)), 6) AS log_ratio FROM r JOIN s USING (name) GROUP BY name, r.v")
def f4_log_ratios(spark, sf):
    e, _ = events(spark, sf)
    samples = e.groupBy((F.col("src") % 3).alias("sample"), (F.col("src") % 4).alias("name")).agg(F.count(F.lit(1)).alias("value"))
    real = e.groupBy((F.col("src") % 4).alias("name")).agg(F.count(F.lit(1)).alias("value"))
    return rounded(N.null_summary(real, samples).select("name", F.log2("ratio").alias("log_ratio")))


@query(f"WITH {NODES_SQL} SELECT super_class, n, row_number() OVER (ORDER BY n DESC, super_class) AS place FROM (SELECT super_class, count(*) AS n FROM nodes GROUP BY 1) QUALIFY place <= 20")
def f7_largest_groups(spark, sf):
    from pyspark.sql import Window as W

    sizes = A.part_nodes(spark, sf).groupBy("super_class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "super_class").limit(20)
    return sizes.withColumn("place", F.row_number().over(W.orderBy(F.col("n").desc(), "super_class")))


@query()
def x3_sensitivity(spark, sf):
    """Every variant of the parameters on one network: pulses, and the regime."""
    ship(spark)
    edge, nodes = events(spark, sf)
    idx = I.dense_index(nodes, "id", "idx", 4)
    at = lambda c, o: idx.select(F.col("id").alias(c), F.col("idx").alias(o))
    e = written(edge.join(at("src", "a"), "src").join(at("dst", "b"), "dst").select("a", "b", "weight"), "edges")
    n, out, params = nodes.count(), None, {}
    for k, (name, change) in enumerate(H.SENSITIVITY.items()):
        p = PARAMS.with_(**{x: v for x, v in change.items() if x in asdict(PARAMS)})
        w = D.transform(F.col("weight"), change.get("how", "log1p")) * 0.1
        configs = spark.createDataFrame([(k, 1.0, 0.02, 1)], "run long, gain double, rate double, seed long")
        s = D.kernel(spark, e.select(F.col("a").alias("src"), F.col("b").alias("dst"), w.alias("w")), configs, n, 60, p, 20)
        out = s if out is None else out.unionByName(s)
        params[k] = name, p
    series, out = written(out, "series"), None  # all runs side by side
    for k, (name, p) in params.items():
        row = D.regimes(series.filter(F.col("run") == k), n, 40, p).select(F.lit(name).alias("variant"), "rate_on", "rate_late", "amplification", "regime")
        out = row if out is None else out.unionByName(row)
    return out


@query()
def x4_null_controls(spark, sf):
    """The same dynamics on the graph and its two rewirings."""
    ship(spark)
    edge, nodes = events(spark, sf)
    idx = I.dense_index(nodes, "id", "idx", 4)
    at = lambda c, o: idx.select(F.col("id").alias(c), F.col("idx").alias(o))
    null = lambda model: N.reassign_weights(edge, _samples(spark, sf, model, SEEDS).filter("sample = 1"), 1)
    n, out = nodes.count(), None
    for name, g in (("real", edge), ("degree_preserving", null("degree")), ("reciprocity_preserving", null("reciprocity"))):
        net = g.join(at("src", "a"), "src").join(at("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), (F.col("weight") * 0.05).alias("w"))
        configs = spark.createDataFrame([(s, 1.0, 0.02, s) for s in (1, 2)], "run long, gain double, rate double, seed long")
        s = D.kernel(spark, net, configs, n, 60, PARAMS, 20).withColumn("topology", F.lit(name))
        out = s if out is None else out.unionByName(s)
    series, out = written(out, "series"), None  # all runs side by side
    for name in ("real", "degree_preserving", "reciprocity_preserving"):
        row = D.run_summary(series.filter(F.col("topology") == name), n, PARAMS).withColumn("topology", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return rounded(out)


@query(f"""WITH {PAIRS_SQL}, d AS (SELECT count(*) AS d FROM (SELECT lo AS u FROM pairs UNION ALL SELECT hi FROM pairs) GROUP BY u), w AS (SELECT CAST(sum(d * (d - 1) // 2) AS BIGINT) AS wedges FROM d)
SELECT step, wedges, round(wedges * 1.5 / rate, 6) AS estimate_s, CASE WHEN wedges * 1.5 / rate <= 60 THEN 'run' ELSE 'skip' END AS decision FROM w CROSS JOIN (VALUES ('clustering', 4e6), ('triads', 2e5)) t(step, rate)""")
def x23_cost_gate(spark, sf):
    """What each wedge-bound step of the whole graph would take at given throughputs, and whether it runs within a minute."""
    from ..analysis import cost_gate

    rates = spark.createDataFrame([("clustering", 4e6), ("triads", 2e5)], "step string, wedges_per_s double")
    return rounded(cost_gate(S.wedges(S.undirected(graph(spark, sf))), rates, 60.0))


@query()
def x23_calibrated_gate(spark, sf):
    """The same with throughputs measured now."""
    from ..analysis import calibrate, cost_gate

    return cost_gate(S.wedges(S.undirected(graph(spark, sf))), calibrate(spark), 600.0)


@query()
def x1_regimes_by_gain(spark, sf):
    configs, s, n, off = _sweep(spark, sf)
    points = configs.join(D.regimes(s, n, off, PARAMS), "run").withColumn("subgraph", F.lit("events"))
    return H.regimes_by_gain(points)
