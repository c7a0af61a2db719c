"""Null model, dynamics and run record queries with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import uniform32_sql
from ..operators import asof as J
from ..operators import communities as C
from ..operators import dynamics as D
from ..operators import ingest as I
from ..operators import nulls as N
from ..operators import paths as P
from ..operators import stats as S
from ..operators import warehouse as H
from ..session import ship, written
from ..sources import adapters as A
from ..sources.adapters import EVENTS_SQL
from ..sources.cache import prepared
from .graph import KS, MEANS_SQL, events, graph, known, rounded

#: Samples of each null model.
SEEDS = [1, 2, 3]

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# -- null models: what they must keep, checked against the input graph ---------------------------------------------

DEG = f"{EVENTS_SQL}, n AS (SELECT DISTINCT user_id AS id FROM events), d AS (SELECT id, (SELECT count(*) FROM e WHERE src = id) AS out_degree, (SELECT count(*) FROM e WHERE dst = id) AS in_degree FROM n)"


def _kept_degrees(rewired, nodes):
    both = rewired.select("sample").distinct().crossJoin(nodes)
    out = rewired.groupBy("sample", F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("o"))
    into = rewired.groupBy("sample", F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("i"))
    return both.join(out, ["sample", "id"], "left").join(into, ["sample", "id"], "left").select("sample", "id", F.coalesce("o", F.lit(0)).alias("out_degree"), F.coalesce("i", F.lit(0)).alias("in_degree"))


def _samples(spark, sf, model, seeds):
    """Samples of a null model of the event graph, prepared once."""
    edge, nodes = events(spark, sf)
    return prepared(spark, f"null-{model}", [f"{sf}/events.parquet"], {"seeds": seeds}, lambda: N.null_model(model, edge, nodes, seeds))


@query(f"WITH {DEG} SELECT s AS sample, d.* FROM d CROSS JOIN (VALUES (1), (2), (3)) t(s)")
def g15_degree_preserving(spark, sf):
    _, nodes = events(spark, sf)
    return _kept_degrees(_samples(spark, sf, "degree", SEEDS).distinct().filter("src <> dst"), nodes)


@query(f"WITH {EVENTS_SQL}, k AS (SELECT count(*) AS mutual FROM e a WHERE EXISTS (SELECT 1 FROM e b WHERE b.src = a.dst AND b.dst = a.src)) SELECT s AS sample, k.mutual FROM k CROSS JOIN (VALUES (1), (2), (3)) t(s)")
def g16_reciprocity_preserving(spark, sf):
    r = _samples(spark, sf, "reciprocity", SEEDS)
    back = r.select("sample", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return r.join(back, ["sample", "src", "dst"], "left_semi").groupBy("sample").agg(F.count(F.lit(1)).alias("mutual"))


@query(f"WITH {EVENTS_SQL}, w AS (SELECT src, weight, count(*) AS n FROM e GROUP BY ALL) SELECT s AS sample, w.* FROM w CROSS JOIN (VALUES (1), (2), (3)) t(s)")
def g17_reassigned_weights(spark, sf):
    edge, _ = events(spark, sf)
    new = N.reassign_weights(edge, _samples(spark, sf, "degree", SEEDS), 3)
    return new.groupBy("sample", "src", "weight").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EVENTS_SQL} SELECT s AS sample, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM e) AS distinct_edges, 0 AS loops FROM (VALUES (1), (2), (3)) t(s)")
def g14_random_graph(spark, sf):
    g = _samples(spark, sf, "random", SEEDS)
    return g.groupBy("sample").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src", "dst").alias("distinct_edges"), F.count_if(F.col("src") == F.col("dst")).alias("loops"))


@query(f"""WITH {EVENTS_SQL}, k AS (SELECT unnest(['degree', 'reciprocity', 'random']) AS model, count(*) AS edges FROM e)
SELECT model, s AS sample, CASE WHEN model <> 'reciprocity' THEN edges END AS edges, 0 AS loops, 0 AS repeats FROM k CROSS JOIN (VALUES (1), (2), (3)) t(s)""")
def g18_null_models(spark, sf):
    """Every null model by its name. The reciprocity model may leave out some edges of a dense graph, so their number is not compared."""
    out = None
    for model in ("degree", "reciprocity", "random"):
        one = F.count(F.lit(1))
        kept = F.lit(None).cast("long") if model == "reciprocity" else one
        g = _samples(spark, sf, model, SEEDS).groupBy("sample").agg(kept.alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("loops"), (one - F.count_distinct("src", "dst")).alias("repeats"))
        out = g.withColumn("model", F.lit(model)) if out is None else out.unionByName(g.withColumn("model", F.lit(model)))
    return out


def strong_communities(spark, sf):
    pairs = S.undirected(graph(spark, sf, 25))
    return prepared(spark, "communities", [f"{sf}/{t}.parquet" for t in ("lineitem", "supplier", "nation", "part")], {"least": 25}, lambda: C.communities(pairs, passes=2))


@query()
def g12_communities(spark, sf):
    return strong_communities(spark, sf)


@query()
def g28_community_report(spark, sf):
    """Modularity of the communities, of a rewired graph's, and of two partitions by annotation; sizes, and agreement with the annotations."""
    edge = graph(spark, sf, 25)
    pairs = written(S.undirected(edge), "pairs")
    found = strong_communities(spark, sf)
    ends = found.select("id")
    named = A.part_nodes(spark, sf).join(ends, "id").select("id", F.col("super_class"), F.col("cell_type"))
    null = N.degree_preserving(edge, [1], attempts=3).select("src", "dst", F.lit(1).alias("weight"))
    flat = pairs.select("lo", "hi", F.lit(1).alias("weight"))
    null_pairs = written(S.undirected(null).select("lo", "hi", F.lit(1).alias("weight")), "pairs")
    one = lambda name, df, c: df.select(F.lit(name).alias("name"), F.col(c).cast("double").alias("value"))
    sizes = found.groupBy("community").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("communities"), F.max("n").alias("largest"))
    parts = [
        one("modularity", S.modularity(pairs, found, "community"), "modularity"),
        one("modularity, unweighted", S.modularity(flat, C.communities(flat, passes=1), "community"), "modularity"),
        one("modularity, rewired", S.modularity(null_pairs, C.communities(null_pairs, passes=1), "community"), "modularity"),
        one("communities", sizes, "communities"), one("largest", sizes, "largest"),
    ]
    for c in ("super_class", "cell_type"):
        both = found.join(named, "id")
        agree = written(S.partition_agreement(both, "community", c), "agreement")
        parts += [one(f"modularity of {c}", S.modularity(pairs, named.withColumn(c, F.coalesce(c, F.lit("(none)"))), c), "modularity"), one(f"nmi with {c}", agree, "nmi"), one(f"ari with {c}", agree, "ari")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out)


@query()
def g28_community_composition(spark, sf):
    """The fifteen largest communities with their commonest classes and types."""
    found, nodes = strong_communities(spark, sf), A.part_nodes(spark, sf)
    parts = [C.composition(found, nodes.select("id", F.col(c).alias("label")), c) for c in ("super_class", "cell_type")]
    return rounded(parts[0].unionByName(parts[1]))


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT src % 3 AS sample, src % 2 AS name, count(*) AS value FROM e GROUP BY 1, 2), r AS (SELECT src % 2 AS name, count(*) AS v FROM e GROUP BY 1)
SELECT name, v AS real, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS spread, round(v / avg(value), 6) AS ratio, round((v - avg(value)) / stddev_samp(value), 6) AS z FROM r JOIN s USING (name) GROUP BY name, v""")
def g29_null_summary(spark, sf):
    """The summary's arithmetic alone, on groups of the real edges; g29_null_ensemble has null models."""
    e, _ = events(spark, sf)
    samples = e.groupBy((F.col("src") % 3).alias("sample"), (F.col("src") % 2).alias("name")).agg(F.count(F.lit(1)).alias("value"))
    real = e.groupBy((F.col("src") % 2).alias("name")).agg(F.count(F.lit(1)).alias("value"))
    return rounded(N.null_summary(real, samples))


def _real(edge):
    return edge.select(F.lit(0).cast("long").alias("sample"), "src", "dst")


def _measured(spark, sf, model, seeds=SEEDS):
    """(sample, name, value) of the samples of a model with these seeds, or of the real graph as sample 0."""
    edge, nodes = events(spark, sf)
    given = _real(edge) if model == "real" else _samples(spark, sf, model, SEEDS).filter(F.col("sample").isin(seeds))
    return prepared(spark, f"measures-{model}", [f"{sf}/events.parquet"], {"seeds": seeds, "ks": KS}, lambda: N.measures(given, nodes, KS))


@query()
def g29_null_ensemble(spark, sf):
    """Reciprocity, transitivity and every triad class of the event graph against its degree-preserving samples."""
    keep = "name NOT LIKE 'rich:%'"
    return rounded(N.null_summary(_measured(spark, sf, "real").filter(keep), _measured(spark, sf, "degree").filter(keep)))


@query()
def f4_motif_log_ratios(spark, sf):
    """Triads of two dyads at least: log2 of the real number over the mean of each ensemble, with the z value; null where a mean is 0."""
    out = None
    for model in ("degree", "random"):
        real = _measured(spark, sf, "real").filter("name LIKE 'triad:%' AND name NOT IN ('triad:003', 'triad:012', 'triad:102')")
        got = N.null_summary(real, _measured(spark, sf, model)).select(F.substring_index("name", ":", -1).alias("triad"), F.lit(model).alias("model"), "real", "mean", F.when(F.col("ratio") > 0, F.log2("ratio")).alias("log_ratio"), "z")
        out = got if out is None else out.unionByName(got)
    return rounded(out)


@query()
def f5_normalised_rich_club(spark, sf):
    """(k, nodes, phi, phi_null, normalised): the rich-club curve over the mean of the degree-preserving samples."""
    edge, nodes = events(spark, sf)
    return rounded(N.normalised_rich_club(S.rich_club(edge, nodes, KS), _measured(spark, sf, "degree")))


@query()
def g11_normalised_regime(spark, sf):
    edge, nodes = events(spark, sf)
    curve = N.normalised_rich_club(S.rich_club(edge, nodes, KS), _measured(spark, sf, "degree"))
    return rounded(S.rich_club_regime(curve.select("k", F.col("normalised").alias("value"), "nodes")))


@query()
def g30_small_world(spark, sf):
    """Clustering against a random graph over mean path length against it, both computed from the event graph."""
    edge, nodes = events(spark, sf)
    drawn = _samples(spark, sf, "random", SEEDS).filter("sample = 1").select("src", "dst")
    c = [written(_measured(spark, sf, m, s).filter(f"name = 'transitivity' AND sample = {k}").select("value"), "clustering") for m, k, s in (("real", 0, SEEDS), ("random", 1, [1]))]  # of one sample
    length = [written(P.mean_length(g, nodes), "length") for g in (edge, drawn)]
    row = c[0].toDF("c").crossJoin(c[1].toDF("cr")).crossJoin(length[0].toDF("l")).crossJoin(length[1].toDF("lr"))  # one row each
    return rounded(row.select("c", "cr", "l", "lr", N.small_world(F.col("c"), F.col("cr"), F.col("l"), F.col("lr")).alias("s")))


# -- networks and dynamics -----------------------------------------------------------------------------------------

NET_SQL = f"""{MEANS_SQL}, k AS MATERIALIZED (SELECT src, dst, weight, CASE greatest(q0, q1, q2, q3, q4, q5) WHEN 0 THEN NULL WHEN q0 THEN 0 WHEN q1 THEN 1 WHEN q2 THEN 2 WHEN q3 THEN 3 WHEN q4 THEN 4 ELSE 5 END AS class FROM q),
f AS MATERIALIZED (SELECT *, ln(1 + weight) AS f FROM k), m AS (SELECT avg(f) AS norm FROM f),
net AS (SELECT src, dst, CASE WHEN class IN (2, 4) THEN -1 ELSE 1 END * 2.0 * f / norm AS w FROM f, m WHERE src <> dst AND class IS NOT NULL)"""


def network(spark, sf):
    q = I.class_means(I.dealt(known(spark, sf)))
    return D.build_network(q.withColumn("class", I.dominant_class(q)), "log1p", 2.0)


@query(f"WITH {NET_SQL} SELECT src, dst, round(w, 6) AS w FROM net")
def l2_l3_network(spark, sf):
    return rounded(network(spark, sf))


@query(f"WITH {NET_SQL} SELECT count(*) AS kept, count(*) FILTER (w > 0) AS excitatory, count(*) FILTER (w < 0) AS inhibitory, round(avg(abs(w)), 6) AS mean_abs, round(max(abs(w)), 6) AS max_abs, (SELECT count(*) FROM k WHERE src <> dst) AS edges, (SELECT count(*) FROM k WHERE src <> dst) - count(*) AS removed FROM net")
def a25_network_meta(spark, sf):
    q = I.class_means(I.dealt(known(spark, sf)))
    edge = q.withColumn("class", I.dominant_class(q))
    return rounded(D.network_meta(edge, D.build_network(edge, "log1p", 2.0)))


@query("SELECT p_partkey AS id, round(sqrt(p_size), 6) AS a, round(ln(1 + p_size), 6) AS b, CAST(least(p_size, 20) AS DOUBLE) AS c, CAST(p_size AS DOUBLE) AS d FROM part")
def p13_transforms(spark, sf):
    w = F.col("p_size")
    return rounded(A.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), D.transform(w, "sqrt").alias("a"), D.transform(w, "log1p").alias("b"), D.transform(w, "clipped", 20).alias("c"), D.transform(w, "linear").alias("d")))


def _stimulus_sql(name: str, steps: int, rate: float, seed: int, where: str = "true") -> str:
    return f"{name} AS (SELECT CAST(t AS INT) AS t, id FROM (SELECT unnest(range({steps})) AS t) CROSS JOIN n WHERE {where} AND {uniform32_sql(seed, 't', 'id')} < {int(rate * 2**32)})"


USERS = "n AS (SELECT DISTINCT user_id AS id FROM events)"


@query(f"WITH {USERS}, {_stimulus_sql('x', 40, 0.05, 3)} SELECT * FROM x")
def l4_stimulus_poisson(spark, sf):
    return D.stimulus(events(spark, sf)[1], 40, 0.05, 3)


@query(f"WITH {USERS}, {_stimulus_sql('x', 40, 0.2, 3, 't % 10 < 3 AND t < 30')} SELECT * FROM x")
def l4_stimulus_burst(spark, sf):
    return D.stimulus(events(spark, sf)[1], 40, 0.2, 3, "burst", 10, 3, on_steps=30)


@query(f"WITH {USERS}, x AS (SELECT CAST(t AS INT) AS t, id, row_number() OVER (PARTITION BY t ORDER BY {uniform32_sql(3, 't', 'id')}, id) AS k FROM (SELECT unnest(range(0, 40, 10)) AS t) CROSS JOIN n) SELECT t, id FROM x WHERE k <= round_even(0.2 * (SELECT count(*) FROM n), 0)")
def l4_stimulus_pulse(spark, sf):
    return D.stimulus(events(spark, sf)[1], 40, 0.2, 3, "pulse", 10)


def _drawn(what: str) -> str:
    return uniform32_sql(3, f"'{what}'", "id")


@query(f"""WITH {USERS}, e AS (SELECT id FROM n QUALIFY row_number() OVER (ORDER BY {_drawn("e")}, id) <= round_even(0.5 * (SELECT count(*) FROM n), 0)), m AS (SELECT id FROM e QUALIFY row_number() OVER (ORDER BY {_drawn("m")}, id) <= 30)
SELECT CAST(t AS INT) AS t, id FROM (SELECT unnest(range(40)) AS t) JOIN m ON t % 10 = {_drawn("o")} % 4""")
def l4_stimulus_pattern(spark, sf):
    return D.stimulus(events(spark, sf)[1], 40, 0.2, 3, "sparse_pattern", 10, 4, fraction=0.5, members=30)


PARAMS = D.Params(refractory=2, delay=1, input_weight=2.0)
STEPS = 6


def _event_network(spark, sf):
    edge, nodes = events(spark, sf)
    w = F.when((F.col("src") + F.col("dst")) % 5 == 0, -1).otherwise(1) * F.col("weight") * 40_000_000
    return edge.select("src", "dst", w.cast("long").alias("w")), nodes, D.stimulus(nodes, STEPS, 0.15, 5)


def _unrolled_sql(final: str) -> str:
    """The six steps written out as common table expressions."""
    p = PARAMS
    parts = [EVENTS_SQL, USERS, _stimulus_sql("stim", STEPS, 0.15, 5), "net AS (SELECT src, dst, CASE WHEN (src + dst) % 5 = 0 THEN -1 ELSE 1 END * weight * 40000000 AS w FROM e)", f"s0 AS (SELECT id, CAST(0 AS DOUBLE) AS v, {D.NEVER} AS last FROM n)"]
    for t in range(STEPS):
        syn = f"LEFT JOIN (SELECT dst AS id, CAST(sum(w) AS DOUBLE) / 1000000000 AS syn FROM s{t} JOIN net ON src = id WHERE last = {t - 1} GROUP BY dst) y USING (id)" if t else "LEFT JOIN (SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS DOUBLE) AS syn) y USING (id)"
        parts.append(f"h{t} AS (SELECT id, last, {t} - last <= {p.refractory} AS held, v * {p.alpha!r} + coalesce(syn, 0) + coalesce(ext, 0) AS u FROM s{t} {syn} LEFT JOIN (SELECT id, CAST({p.input_weight} AS DOUBLE) AS ext FROM stim WHERE t = {t}) z USING (id))")
        parts.append(f"s{t + 1} AS MATERIALIZED (SELECT id, CASE WHEN held OR u >= {p.theta} THEN {p.reset} ELSE u END AS v, CASE WHEN NOT held AND u >= {p.theta} THEN {t} ELSE last END AS last FROM h{t})")
    return f"WITH {', '.join(parts)} {final}"


RASTER_SQL = _unrolled_sql(" UNION ALL ".join(f"SELECT {t} AS t, id FROM s{t + 1} WHERE last = {t}" for t in range(STEPS)))
FINAL_SQL = _unrolled_sql(f"SELECT id, round(v, 6) AS v, last FROM s{STEPS}")


@query(RASTER_SQL)
def l5_j8_dense_raster(spark, sf):
    return D.dense_steps(*_event_network(spark, sf), PARAMS, STEPS)[0]


@query(FINAL_SQL)
def l5_dense_final(spark, sf):
    return rounded(D.dense_steps(*_event_network(spark, sf), PARAMS, STEPS)[1])


@query(RASTER_SQL)
def l6_j9_event_raster(spark, sf):
    return D.event_steps(*_event_network(spark, sf), PARAMS, STEPS)[0]


@query(FINAL_SQL)
def l6_event_final(spark, sf):
    return rounded(D.event_steps(*_event_network(spark, sf), PARAMS, STEPS)[1])


@query(_unrolled_sql(f"SELECT count(*) AS pulses, CAST(sum((SELECT count(*) FROM net WHERE src = id)) AS BIGINT) AS deliveries FROM ({' UNION ALL '.join(f'SELECT id FROM s{t + 1} WHERE last = {t}' for t in range(STEPS))})"))
def l11_counters(spark, sf):
    net, nodes, given = _event_network(spark, sf)
    raster, _ = D.dense_steps(net, nodes, given, PARAMS, STEPS)
    degree = net.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    return raster.join(degree, "id", "left").agg(F.count(F.lit(1)).alias("pulses"), F.sum(F.coalesce("d", F.lit(0))).cast("long").alias("deliveries"))


@query(_unrolled_sql(f"SELECT count(*) AS pulses_a, count(*) AS pulses_b, 0 AS different, CAST(NULL AS INT) AS first_step FROM ({' UNION ALL '.join(f'SELECT id FROM s{t + 1} WHERE last = {t}' for t in range(STEPS))})"))
def l15_l16_equivalence(spark, sf):
    given = _event_network(spark, sf)
    return D.raster_difference(D.dense_steps(*given, PARAMS, STEPS)[0], D.event_steps(*given, PARAMS, STEPS)[0])


def _sweep(spark, sf, steps: int = 120, off: int = 60):
    """Runs over gains and seeds on the event network: (configs, series, nodes, steps with input)."""
    ship(spark)
    edge, nodes = events(spark, sf)
    idx = I.dense_index(nodes, "id", "idx", 4)
    at = lambda c, o: idx.select(F.col("id").alias(c), F.col("idx").alias(o))
    net = edge.join(at("src", "a"), "src").join(at("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), (F.col("weight") * 0.05).alias("w"))
    gains = [round(0.01 * 10 ** (i / 3), 6) for i in range(10)]
    rows = [(k, g, 0.02, s) for k, (g, s) in enumerate((g, s) for g in gains for s in (1, 2))]
    configs = spark.createDataFrame(rows, "run long, gain double, rate double, seed long")
    return configs, written(D.kernel(spark, net, configs, nodes.count(), steps, PARAMS, off), "series"), nodes.count(), steps - off


@query()
def l13_x6_run_summary(spark, sf):
    configs, series, n, _ = _sweep(spark, sf)
    return rounded(configs.join(D.run_summary(series, n, PARAMS), "run"))


@query()
def l14_x1_calibration(spark, sf):
    configs, series, n, off = _sweep(spark, sf)
    points = configs.join(D.regimes(series, n, off, PARAMS), "run").withColumn("subgraph", F.lit("events"))
    return rounded(H.stable_range(points))


@query()
def x32_off_window(spark, sf):
    configs, series, n, off = _sweep(spark, sf)
    return rounded(configs.join(H.off_probe(series, off, n, PARAMS.dt), "run"))


# -- run records: orders stand in for runs --------------------------------------------------------------------------

RUNS_SQL = """runs AS (SELECT o_orderkey AS run, o_orderpriority AS subgraph, pow(10.0, -CAST(o_custkey % 4 AS DOUBLE)) AS rate, o_orderkey % 3 AS seed,
CASE WHEN (o_orderkey // 3) % 2 = 0 THEN 'a' ELSE 'b' END AS mode, o_totalprice * CASE WHEN (o_orderkey // 3) % 2 = 0 THEN 1.0 + (o_custkey % 4) / 10.0 ELSE 1.15 END AS wall FROM orders)"""


def runs(spark, sf):
    o = A.read(spark, sf, "orders")
    k = (F.col("o_custkey") % 4).cast("double")
    mode = F.when(F.expr("(o_orderkey div 3) % 2 = 0"), "a").otherwise("b")
    return o.select(F.col("o_orderkey").alias("run"), F.col("o_orderpriority").alias("subgraph"), F.pow(F.lit(10.0), -k).alias("rate"), (F.col("o_orderkey") % 3).alias("seed"), mode.alias("mode"), (F.col("o_totalprice") * F.when(mode == "a", 1.0 + k / 10.0).otherwise(1.15)).alias("wall"))


PAIRED_SQL = f"""{RUNS_SQL}, cell AS (SELECT subgraph, rate, seed, median(wall) FILTER (mode = 'a') AS a, median(wall) FILTER (mode = 'b') AS b FROM runs GROUP BY 1, 2, 3),
ratio AS (SELECT subgraph, rate, count(*) AS pairs, median(a / b) AS median, min(a / b) AS least, max(a / b) AS largest, median(a) / median(b) AS of_medians FROM cell WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2)"""


@query(f"WITH {PAIRED_SQL} SELECT subgraph, round(rate, 6) AS rate, pairs, round(median, 6) AS median, round(least, 6) AS least, round(largest, 6) AS largest, round(of_medians, 6) AS of_medians FROM ratio")
def x11_x13_j10_paired(spark, sf):
    return rounded(H.paired(runs(spark, sf), "wall", "a", "b"))


CLASS_SQL = f"{PAIRED_SQL}, o AS (SELECT *, CASE WHEN median >= 1.25 AND least > 1.05 THEN 'A' WHEN median <= 0.8 AND largest < 0.95 THEN 'C' ELSE 'B' END AS class, abs(median - 1) >= 0.05 AND NOT (least <= 1 AND largest >= 1) AS significant FROM ratio)"


@query(f"WITH {CLASS_SQL} SELECT subgraph, round(rate, 6) AS rate, class, significant FROM o")
def x14_outcome(spark, sf):
    return rounded(H.significant(H.outcome(H.paired(runs(spark, sf), "wall", "a", "b"))).select("subgraph", "rate", "class", "significant"))


@query(f"WITH {CLASS_SQL}, c AS (SELECT count(*) FILTER (class = 'A') AS a, count(*) FILTER (class = 'B') AS b, count(*) FILTER (class = 'C') AS c, count(*) AS n FROM o) SELECT a, b, c, CASE WHEN 2 * a > n THEN 'A' WHEN 2 * b > n THEN 'B' WHEN 2 * c > n THEN 'C' END AS class FROM c")
def x14_majority(spark, sf):
    return H.majority(H.outcome(H.paired(runs(spark, sf), "wall", "a", "b")))


@query(f"""WITH {PAIRED_SQL}, l AS (SELECT subgraph, rate, median, lead(rate) OVER w AS rate2, lead(median) OVER w AS median2 FROM ratio WINDOW w AS (PARTITION BY subgraph ORDER BY rate)),
x AS (SELECT *, ln(median) / (ln(median) - ln(median2)) AS f FROM l WHERE rate2 IS NOT NULL AND (median > 1) <> (median2 > 1)),
h AS (SELECT subgraph, count(*) AS turns, arg_min(exp(ln(rate) + f * (ln(rate2) - ln(rate))), rate) AS rate, min(rate) AS low, arg_min(rate2, rate) AS high, arg_min(median > 1, rate) AS faster_below FROM x GROUP BY 1),
s AS (SELECT subgraph, count(*) AS n, count(*) FILTER (median > 1) AS above, max(median) AS best, min(median) AS worst FROM ratio WHERE median IS NOT NULL GROUP BY 1)
SELECT subgraph, CASE WHEN above = 0 THEN 'slower everywhere' WHEN above = n THEN 'faster everywhere' WHEN turns = 1 THEN 'crossover' ELSE 'multiple crossings' END AS status, round(rate, 6) AS rate, round(low, 6) AS low, round(high, 6) AS high, faster_below,
round(CASE WHEN above = 0 THEN best WHEN above = n THEN worst END, 6) AS nearest FROM s LEFT JOIN h USING (subgraph)""")
def x12_w11_crossover(spark, sf):
    return rounded(H.crossover(H.paired(runs(spark, sf), "wall", "a", "b")))


POINTS_SQL = "points AS (SELECT p_type AS subgraph, p_size / 10.0 AS gain, p_partkey % 3 AS seed, CASE WHEN (p_size * 7 + p_partkey // 1000) % 11 < 2 THEN 'DEAD' ELSE 'STABLE' END AS regime FROM part)"


def points(spark, sf):
    regime = F.when((F.col("p_size") * 7 + F.expr("p_partkey div 1000")) % 11 < 2, "DEAD").otherwise("STABLE")
    return A.read(spark, sf, "part").select(F.col("p_type").alias("subgraph"), (F.col("p_size") / 10.0).alias("gain"), (F.col("p_partkey") % 3).alias("seed"), regime.alias("regime"))


@query(f"""WITH {POINTS_SQL}, g AS (SELECT subgraph, gain, bool_and(regime = 'STABLE') AS ok, row_number() OVER (PARTITION BY subgraph ORDER BY gain) AS k FROM points GROUP BY 1, 2),
i AS (SELECT *, k - row_number() OVER (PARTITION BY subgraph ORDER BY gain) AS isl FROM g WHERE ok), r AS (SELECT subgraph, isl, min(gain) AS low, max(gain) AS high, count(*) AS n FROM i GROUP BY 1, 2)
SELECT subgraph, low, high, n, round(sqrt(low * high), 6) AS baseline FROM r QUALIFY row_number() OVER (PARTITION BY subgraph ORDER BY n DESC, low) = 1""")
def w10_stable_range(spark, sf):
    return rounded(H.stable_range(points(spark, sf)))


@query(f"WITH {POINTS_SQL} SELECT subgraph, gain, CASE WHEN count(DISTINCT regime) = 1 THEN min(regime) ELSE 'seeds disagree' END AS regime, string_agg(DISTINCT regime, ',' ORDER BY regime) AS regimes FROM points GROUP BY 1, 2")
def f11_x28_regimes_by_gain(spark, sf):
    return H.regimes_by_gain(points(spark, sf))


@query(f"WITH {RUNS_SQL} SELECT subgraph, mode, median(wall) AS median, min(wall) AS least, max(wall) AS largest, count(*) AS n FROM runs GROUP BY 1, 2")
def a22_cell_statistics(spark, sf):
    return H.cell_statistics(runs(spark, sf), ["subgraph", "mode"], "wall")


@query(f"WITH {RUNS_SQL}, c AS (SELECT mode AS variant, subgraph, median(wall) AS m FROM runs GROUP BY 1, 2) SELECT arg_min(variant, g) AS variant FROM (SELECT variant, exp(avg(ln(m))) AS g FROM c GROUP BY 1)")
def x30_selected_variant(spark, sf):
    cells = H.cell_statistics(runs(spark, sf).withColumnRenamed("mode", "variant"), ["variant", "subgraph"], "wall")
    return H.selected_variant(cells, "a")


@query(f"WITH {RUNS_SQL} SELECT run, concat_ws('_', subgraph, mode, seed) AS experiment_id FROM runs WHERE run % 7 <> 0")
def x8_s9_pending(spark, sf):
    r = runs(spark, sf)
    done = r.filter("run % 7 = 0").select("run")
    return H.pending(r.withColumn("experiment_id", H.experiment_id("subgraph", "mode", "seed")), done, "run").select("run", "experiment_id")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 'missing' WHEN p_partkey % 10 = 1 THEN 'changed' ELSE 'new' END AS state FROM part WHERE p_partkey % 10 < 2 OR p_partkey % 10 = 9""")
def j11_x22_difference(spark, sf):
    part = A.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.md5("p_name").alias("digest"))
    now = part.filter("id % 10 <> 0").withColumn("digest", F.when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.col("digest")))
    return H.table_difference(part.filter("id % 10 <> 9"), now, "id", "digest")


@query("WITH g AS (SELECT p_type AS subgraph, p_size AS gain, p_partkey AS run FROM part), b AS (SELECT p_type AS subgraph, min(p_size) AS baseline FROM part GROUP BY 1) SELECT g.* FROM g JOIN b USING (subgraph) WHERE gain = baseline")
def x25_at_baseline(spark, sf):
    p = A.read(spark, sf, "part").select(F.col("p_type").alias("subgraph"), F.col("p_size").alias("gain"), F.col("p_partkey").alias("run"))
    return H.at_baseline(p, p.groupBy("subgraph").agg((F.min("gain") * (1 + 1e-12)).alias("baseline")))


@query()
def x15_cost_model(spark, sf):
    o = A.read(spark, sf, "lineitem").select(F.lit(1.0).alias("base"), F.col("l_quantity").alias("n"), (F.col("l_linenumber") * F.col("l_linenumber")).alias("e"), (3.0 + 2.0 * F.col("l_quantity") + 0.5 * F.pow("l_linenumber", F.lit(2))).alias("wall"))
    w = H.cost_model(o, ["base", "n", "e"], "wall")
    return rounded(spark.createDataFrame([tuple(w)], "base double, n double, e double").crossJoin(H.model_errors(o, ["base", "n", "e"], "wall", w)))


BUDGET = 160_000.0


@query(f"""WITH {RUNS_SQL}, p AS (SELECT subgraph, mode, rate, median(wall) AS value FROM runs GROUP BY ALL),
s AS (SELECT DISTINCT o_orderpriority AS subgraph, CASE WHEN (o_orderkey // 3) % 2 = 0 THEN 'a' ELSE 'b' END AS mode, exp(-CAST(o_orderkey % 80 AS DOUBLE) / 10) AS rate FROM orders),
j AS (SELECT s.subgraph, s.mode, s.rate, max(p.rate) FILTER (p.rate <= s.rate) AS r1, arg_max(value, p.rate) FILTER (p.rate <= s.rate) AS v1, min(p.rate) FILTER (p.rate > s.rate) AS r2, arg_min(value, p.rate) FILTER (p.rate > s.rate) AS v2 FROM s JOIN p USING (subgraph, mode) GROUP BY ALL),
e AS (SELECT subgraph, mode, rate, CASE WHEN r1 = rate THEN v1 ELSE v1 + (ln(rate) - ln(r1)) / (ln(r2) - ln(r1)) * (v2 - v1) END AS estimate FROM j)
SELECT subgraph, mode, round(rate, 6) AS rate, round(estimate, 2) AS estimate, CASE WHEN estimate IS NULL THEN 'unknown' WHEN estimate <= {BUDGET} THEN 'run' ELSE 'skip' END AS decision FROM e""")
def x16_interpolated(spark, sf):
    """Scenarios at rates between the measured ones: the interpolated cost, and whether it is within the budget."""
    measured = H.cell_statistics(runs(spark, sf), ["subgraph", "mode", "rate"], "wall").select("subgraph", "mode", "rate", F.col("median").alias("value"))
    mode = F.when(F.expr("(o_orderkey div 3) % 2 = 0"), "a").otherwise("b")
    scenarios = A.read(spark, sf, "orders").select(F.col("o_orderpriority").alias("subgraph"), mode.alias("mode"), F.exp(-(F.col("o_orderkey") % 80).cast("double") / 10).alias("rate")).distinct()
    got = J.estimates(scenarios, measured, ["subgraph", "mode"], BUDGET)
    return got.select("subgraph", "mode", F.round("rate", 6).alias("rate"), F.round("estimate", 2).alias("estimate"), "decision")


@query("SELECT o_orderkey AS run, o_orderpriority AS phase, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders")
def f13_f16_shares(spark, sf):
    o = A.read(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderpriority").alias("phase"), "o_custkey", F.col("o_totalprice").alias("seconds"))
    return rounded(H.shares(o, ["o_custkey"]).select("run", "phase", "share"))


@query(f"""WITH {MEANS_SQL}, d AS (SELECT dst - coalesce(lag(dst) OVER (PARTITION BY src ORDER BY dst), 0) AS gap FROM edges)
SELECT CAST(sum(CASE WHEN gap < 128 THEN 1 WHEN gap < 16384 THEN 2 WHEN gap < 2097152 THEN 3 ELSE 4 END) AS BIGINT) AS delta_bytes, 4 * count(*) AS plain_bytes FROM d""")
def p19_delta_size(spark, sf):
    return H.delta_size(I.edges(I.dealt(known(spark, sf))))


@query(f"WITH {MEANS_SQL} SELECT count(*) FILTER (weight > 255) AS saturated, round(max(abs(least(weight, 255) / weight - 1)), 6) AS byte_error, round(max(abs(pow(2, round_even(log2(weight) * 8, 0) / 8) / weight - 1)), 6) AS octave_error FROM edges")
def p18_weight_codes(spark, sf):
    return rounded(H.weight_codes(I.edges(I.dealt(known(spark, sf)))))


@query(f"""WITH {MEANS_SQL}, c AS (SELECT (SELECT count(*) FROM nodes) AS n, count(*) AS m, CASE WHEN max(weight) < 256 THEN 1 WHEN max(weight) < 65536 THEN 2 ELSE 4 END AS w FROM edges),
s AS (SELECT unnest(['pairs of 64 bits', 'pairs of 32 bits', 'rows', 'rows and columns']) AS "case", unnest([m * 24, m * (8 + w), (n + 1) * 8 + m * (4 + w), 2 * (n + 1) * 8 + m * (12 + w)]) AS bytes, m FROM c)
SELECT "case", CAST(bytes AS BIGINT) AS bytes, round(bytes / m, 6) AS per_edge FROM s""")
def x20_representation_sizes(spark, sf):
    return rounded(H.representation_sizes(I.edges(I.dealt(known(spark, sf))), A.part_nodes(spark, sf)))
