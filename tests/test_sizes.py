"""What once stopped at a size: long lists, many slots, large graphs, and networks on the driver."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.operators import dynamics, ingest, paths, warehouse
from ripplegraph.plans.dynamics import g30_small_world
from ripplegraph.plans.graph import events
from ripplegraph.sources import adapters


def test_list_digest_of_any_length(spark):
    for n in (0, 1, 120_000):
        got = warehouse.list_digest(spark.range(n).select((F.lit(n) - F.col("id")).alias("v")), "v").collect()
        assert [r["digest"] for r in got] == [hashlib.sha256(",".join(map(str, range(1, n + 1))).encode()).hexdigest()]
    assert warehouse.list_digest(spark.createDataFrame([(2,), (None,), (1,)], "v long"), "v").first()["digest"] == hashlib.sha256(b"1,2").hexdigest()


def test_run_summary_with_more_slots_than_an_int_holds(spark):
    series = spark.createDataFrame([("a", 29_999, 3, 9, 0), ("a", 0, 5, 1, 2)], "run string, t int, pulses long, arrivals long, external long")
    got = dynamics.run_summary(series, 90_000, dynamics.Params()).first()
    assert (got["steps"], round(got["per_slot"] * 2.7e9)) == (30_000, 8)
    assert dynamics.regimes(series, 90_000, 30, dynamics.Params()).first()["regime"] == "STABLE"


def test_expansion_fetches_links_of_few_nodes(spark, monkeypatch):
    """No more edges than allowed once were needed; the order equals that of one aggregate a step, however few are fetched ahead."""
    rng = random.Random(8)
    edges = list({(a, b): (a, b, rng.randint(1, 5)) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(400))}.values())
    edge = spark.createDataFrame(edges, "src long, dst long, weight long")
    want = [r["id"] for r in paths.expand_declaratively(edge, 3, 20).orderBy("place").collect()]
    for ahead in (1, 64):
        assert [r["id"] for r in paths.expand(edge, 3, 20, ahead).orderBy("place").collect()] == want
    assert "most_edges" not in paths.expand.__code__.co_varnames


def test_kernel_leaves_the_network_to_spark(spark, monkeypatch):
    def refused(self):
        raise AssertionError("a network on the driver")

    monkeypatch.setattr(DataFrame, "toPandas", refused)
    rng = random.Random(9)
    edges = [(rng.randrange(30), rng.randrange(30), 0.3 * rng.random()) for _ in range(200)]
    configs = spark.createDataFrame([(k, 1.0 + k, 0.1, k) for k in range(3)], "run long, gain double, rate double, seed long")
    p = dynamics.Params()
    for some in (edges, []):
        got = {(r["run"], r["t"]): (r["pulses"], r["external"]) for r in dynamics.kernel(spark, spark.createDataFrame(some, "src long, dst long, w double"), configs, 30, 20, p, 5).collect()}
        src, dst, w = (np.array([e[i] for e in sorted(some)], t) for i, t in enumerate((np.int64, np.int64, float)))
        for k in range(3):
            times, targets = np.nonzero(np.random.default_rng([k, 17]).random((15, 30)) < 0.1)
            pulses, _, _ = dynamics.simulate(src, dst, w * (1.0 + k), 30, times, targets, p, 20)
            assert [got[k, t] for t in range(20)] == [(len(x), int((times == t).sum())) for t, x in enumerate(pulses)]


@pytest.mark.parametrize("held", [10**6, 50])
def test_kernel_refuses_no_size(spark, held):
    """Above 20,000,000 edges it raised an error; now columns above a bound lie in a file, in chunks and pieces of any size, with the same runs."""
    rng = np.random.default_rng(4)
    src, dst = (x.astype(np.int64) for x in np.unique(rng.integers(0, 40, (500, 2)), axis=0).T)
    w = rng.random(len(src)) * 0.4
    network = spark.createDataFrame(list(zip(src.tolist(), dst.tolist(), w.tolist())), "src long, dst long, w double").repartition(3)
    configs = spark.createDataFrame([(k, 0.5 + k, 0.1, k) for k in range(5)], "run long, gain double, rate double, seed long")
    p = dynamics.Params(delay=2)
    got = {(r["run"], r["t"]): r for r in dynamics.kernel(spark, network, configs, 40, 20, p, 5, held=held).collect()}
    assert len(got) == 100
    for k in range(5):
        times, targets = np.nonzero(np.random.default_rng([k, 17]).random((15, 40)) < 0.1)
        pulses, _, _ = dynamics.simulate(src, dst, w * (0.5 + k), 40, times, targets, p, 20)
        reached = [0, 0, *(len(set(dst[np.isin(src, x)])) for x in pulses)]
        arrivals = [int(np.isin(src, x).sum()) for x in pulses]
        assert [got[k, t]["pulses"] for t in range(20)] == [len(x) for x in pulses]
        assert [(got[k, t]["arrivals"], got[k, t]["targets"]) for t in range(20)] == list(zip(arrivals, reached[:20]))


def test_edges_of_many_nodes_in_pieces():
    first, nodes = np.array([0, 3, 3, 8, 9]), np.array([0, 1, 2, 3])
    for most in (1, 4, 100):
        got = list(dynamics._pieces(first, nodes, most))
        assert np.concatenate(got).tolist() == list(range(9)) and all(len(x) <= max(most, 5) for x in got)


def test_known_rows_are_paired_after_unknown_parts_left(spark):
    """The nodes are joined to lines, not to the longer list of pairs; the rows are the same."""
    sf = "/root/testdata/sf0.001"
    nodes = adapters.part_nodes(spark, sf)
    got = ingest.weighted_rows(adapters.coorder_rows(spark, sf, nodes))
    want = ingest.known_rows(adapters.coorder_rows(spark, sf), nodes)
    key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert key(got) == key(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Join LeftSemi")  # an operator stands above its inputs


def test_edges_are_summed_in_tasks_of_bounded_rows(spark):
    """The number of tasks grows with the rows, also under adaptive execution; before, a task took whatever one file or 64 MB held."""
    rows = spark.range(20_000).select((F.col("id") % 9_000).alias("src"), (F.col("id") % 7).alias("dst"), F.lit(2).alias("weight"), *(F.lit(1.0 if i else float("nan")).alias(f"p{i}") for i in range(6)))
    spread = ingest.dealt(rows, 500)
    sizes = [r["n"] for r in spread.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) >= 35 and max(sizes) < 1_500
    assert sorted(map(tuple, ingest.edges(spread).collect())) == sorted(map(tuple, ingest.edges(rows).collect()))
    assert "REPARTITION_BY_NUM" in ingest.class_quality(rows)._jdf.queryExecution().executedPlan().toString()


def test_long_paths_cost_no_jobs(spark, monkeypatch):
    """A search once took three jobs a step, and betweenness a plan that grew with every step; on 600 steps neither came to an end."""
    n, made = 600, []
    real = paths.written
    monkeypatch.setattr(paths, "written", lambda df, name: made.append(name) or real(df, name))
    edge = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1).alias("weight"))
    nodes = spark.range(n + 1)
    start = spark.range(0, n, 5)
    levels, _ = paths.search_levels(edge, start)
    assert levels.agg(F.max("hops"), F.sum(F.bit_count("bits"))).first() == (n, sum(n + 1 - s for s in range(0, n, 5)))
    hops = [h for s in range(0, n, 5) for h in range(1, n + 1 - s)]
    assert paths.mean_length(edge, start).first()["mean"] == sum(hops) / len(hops)
    got = {r["id"]: r["betweenness"] for r in paths.betweenness(edge, nodes, start).collect()}
    assert got == {v: pytest.approx((n - v) * len(range(0, min(v, n), 5)) * (n + 1) / len(range(0, n, 5))) for v in range(n + 1)}
    assert len(made) < 12


def test_searches_in_tasks_and_by_joins_agree(spark):
    """Above the bound of arcs every step is a join; hubs, loops, cycles, nodes without arcs and sources outside the graph on either way."""
    rng = random.Random(4)
    edges = {(a, b) for a, b in ((rng.randrange(70), rng.randrange(70)) for _ in range(150))} | {(0, v) for v in range(70)} | {(v, v + 1) for v in range(70, 78)}
    edge = spark.createDataFrame(sorted(edges), "src long, dst long")
    nodes = spark.createDataFrame([(v,) for v in [*range(85), -3, 2**40]], "id long")
    start = spark.createDataFrame([(v,) for v in [*range(1, 80), 84, 2**40]], "id long")
    listed = lambda df: sorted(map(tuple, df.collect()))
    (a, i), (b, j) = (paths.search_levels(edge, start, most_arcs=most) for most in (paths.MOST_ARCS, 0))
    assert listed(a.select(b.columns)) == listed(b) and listed(i) == listed(j)
    assert paths.mean_length(edge, start).first()["mean"] == paths.path_summary((b, j)).first()["mean"]
    part = start.filter("id > 66")
    a, b = (dict(map(tuple, paths.betweenness(edge, nodes, part, most).collect())) for most in (paths.MOST_ARCS, 0))
    assert a == {k: pytest.approx(v) for k, v in b.items()} and len(a) == 87 and max(a.values()) > 0
    none = start.filter("false")
    assert paths.mean_length(edge, none).first()["mean"] is None
    assert {r["betweenness"] for r in paths.betweenness(edge, nodes, none).collect()} == {0.0}
    assert listed(paths.search_levels(edge.filter("false"), start)[0].select("id", "hops")) == sorted((r["id"], 0) for r in start.collect())


def test_mean_length_in_many_groups_and_from_files(spark):
    """Groups of one word, tasks with several of them, and arcs in files give the same mean; sources without arcs count nothing."""
    rng = random.Random(6)
    edges = sorted({(rng.randrange(600), rng.randrange(600)) for _ in range(1500)})
    out, total, pairs = {}, 0, 0
    for a, b in edges:
        out.setdefault(a, []).append(b)
    for s in range(620):
        far, level = {s: 0}, [s]
        while level:
            level = [b for a in level for b in out.get(a, []) if b not in far and not far.update({b: far[a] + 1})]
        total, pairs = total + sum(far.values()), pairs + len(far) - 1
    edge = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    for cells, held in ((8_000_000, None), (1, 100)):
        assert paths.mean_length(edge, spark.range(620), cells, held).first()["mean"] == total / pairs


def test_small_world_searches_from_every_node(spark):
    """Only every third node was a source."""
    sf = "/root/testdata/sf0.01"
    edge, nodes = events(spark, sf)
    want = paths.path_summary(paths.search_levels(edge, nodes)).first()["mean"]
    assert g30_small_world(spark, sf).first()["l"] == pytest.approx(want, abs=1e-6)


def test_steps_in_bits_in_small_pieces():
    """A hub's arcs that are cut into pieces meet again."""
    src, dst = np.array([1, 2, 3, 4, 0, 0], np.int32), np.array([0, 0, 0, 0, 5, 6], np.int32)
    start = np.zeros((7, 2), np.uint64)
    for k in range(1, 5):
        start[k, k % 2] |= np.uint64(1 << k)
    want = [(h, list(v), b.tolist()) for h, v, b in paths._steps_in_bits(src, dst, start)]
    assert want[1] == (1, [0], [[20, 10]]) and want[2][1] == [5, 6]
    for piece in (1, 4):
        assert [(h, list(v), b.tolist()) for h, v, b in paths._steps_in_bits(src, dst, start, piece)] == want
