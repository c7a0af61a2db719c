"""Ingest, statistics, paths, null models and dynamics on small graphs with known or brute-force answers."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplegraph.operators import checks, communities, dynamics, ingest, motifs, paths, stats, warehouse
from ripplegraph.sources import files

NAN = float("nan")
KINDS = ["ach", "gaba", "glut", "oct", "ser", "da"]
# Nine rows with planted faults: source, target, region, weight, class.
ROWS = [(0, 1, "AL_L", 3, "gaba"), (0, 1, "LH_L", 7, "ach"), (0, 1, "SMP_L", 5, None), (1, 0, "LH_L", 2, "gaba"), (2, 2, "MB_CA_L", 4, "glut"), (3, 4, "FB", 12, None), (4, 5, "UNASGD", 1, "oct"), (5, 3, "FB", 5, "gaba"), (99, 3, "FB", 9, "ach")]


@pytest.fixture(scope="module")
def toy(spark):
    p = lambda k: [NAN] * 6 if k is None else [0.8 if x == k else 0.04 for x in KINDS]
    rows = spark.createDataFrame([(a, b, r, w, *p(k)) for a, b, r, w, k in ROWS], "src long, dst long, region string, weight long, p0 double, p1 double, p2 double, p3 double, p4 double, p5 double")
    return rows, spark.createDataFrame([(i,) for i in range(6)], "id long")


def random_graph(spark, n, p, seed):
    rng = random.Random(seed)
    edges = [(a, b, rng.randint(1, 8)) for a in range(n) for b in range(n) if a != b and rng.random() < p]
    return edges, spark.createDataFrame(edges or [], "src long, dst long, weight long"), spark.createDataFrame([(i,) for i in range(n)], "id long")


def test_ingest(toy):
    rows, nodes = toy
    o = ingest.observations(rows, nodes).first()
    assert (o["rows"], o["src_unknown"], o["dropped"], o["region_unasgd"], o["region_none"], o["regions"]) == (9, 1, 1, 1, 0, 5)
    known = ingest.known_rows(rows, nodes)
    edge = {(r["src"], r["dst"]): r["weight"] for r in ingest.edges(known).collect()}
    assert edge == {(0, 1): 15, (1, 0): 2, (2, 2): 4, (3, 4): 12, (4, 5): 1, (5, 3): 5}
    q = {(r["src"], r["dst"]): r for r in ingest.class_means(known).collect()}
    assert q[0, 1]["q1"] == round((0.8 * 3 + 0.04 * 7) / 10 * 255) and sum(q[3, 4][f"q{i}"] for i in range(6)) == 0
    c = ingest.class_quality(known).first()
    assert (c["rows_unpredicted"], c["weight_unpredicted"], c["edges_unpredicted"], c["edges_partly_predicted"]) == (2, 17, 1, 1)
    assert ingest.simple_graph(ingest.edges(known), 5).count() == 3
    t = ingest.independent_totals(rows).first()
    assert (t["rows"], t["pairs"], t["weight"], t["pairs_at_least"], t["nodes_at_least"], t["self_pairs"]) == (9, 7, 48, 4, 6, 1)
    assert [(r["id"], r["idx"]) for r in ingest.dense_index(nodes, "id").orderBy("id").collect()] == [(i, i) for i in range(6)]
    with pytest.raises(Exception, match="unknown id"):
        ingest.lookup(rows.select("src"), "src", nodes, strict=True).collect()


def test_checks_find_planted_faults(spark, toy):
    rows, nodes = toy
    ann = spark.createDataFrame([(i, "a", None) for i in range(5)], "id long, super_class string, cell_type string")
    found = checks.observed(rows, nodes, ann)
    expected = spark.createDataFrame([("B1", 7.0), ("C2", 0.0), ("D1", 7.0), ("G1", 1.0), ("E3", 0.0), ("E5", 0.0)], "id string, expected double")
    status = {r["id"]: r["status"] for r in checks.report(found, expected).collect()}
    assert [status[k] for k in ("B1", "C2", "D1", "G1", "E3", "E5", "C1")] == ["FAIL", "FAIL", "FAIL", "WARN", "PASS", "PASS", "INFO"]
    assert set(status) == set(checks.CHECKS) - {"A1"}


def test_statistics_by_brute_force(spark):
    edges, edge, nodes = random_graph(spark, 24, 0.2, 1)
    arcs = {(a, b) for a, b, _ in edges}
    r = stats.reciprocity(edge, nodes).first()
    mutual = sum((b, a) in arcs for a, b in arcs)
    assert (r["edges"], r["mutual"]) == (len(arcs), mutual) and abs(r["density"] - len(arcs) / (24 * 23)) < 1e-12
    d = {r["id"]: r for r in stats.degrees(edge, nodes).collect()}
    w = sorted(x["in_weight"] for x in d.values())
    g = 2 * sum((i + 1) * v for i, v in enumerate(w)) / (24 * sum(w)) - 25 / 24
    assert abs(stats.gini(stats.degrees(edge, nodes), "in_weight").first()["gini"] - g) < 1e-12
    phi = {x["k"]: x["phi"] for x in stats.rich_club(edge, nodes, [3, 8, 100]).collect()}
    deg = {i: d[i]["in_degree"] + d[i]["out_degree"] for i in d}
    rich = [i for i in deg if deg[i] > 8]
    assert abs(phi[8] - sum(a in rich and b in rich for a, b in arcs) / (len(rich) * (len(rich) - 1))) < 1e-12 and phi[100] is None
    empty = edge.limit(0)
    assert stats.reciprocity(empty, nodes).first()["reciprocity"] is None


def test_motifs_by_brute_force(spark):
    edges, edge, nodes = random_graph(spark, 14, 0.25, 2)
    arcs = {(a, b) for a, b, _ in edges}
    near = {frozenset(e) for e in arcs}
    tri = [t for t in itertools.combinations(range(14), 3) if all(frozenset(p) in near for p in itertools.combinations(t, 2))]
    c = motifs.clustering(stats.undirected(edge), nodes).first()
    assert c["triangles"] == len(tri)
    census = {r["triad"]: r["n"] for r in motifs.triad_census(edge, nodes).collect()}
    assert sum(census.values()) == math.comb(14, 3) and len(census) == 16

    def name(es):
        """By the definition: mutual, one-way and missing dyads, and a letter where that leaves a choice."""
        ways = {(a, b) for a, b in es if (b, a) not in es}
        paired = {a for a, b in es if (b, a) in es}
        mutual = (len(es) - len(ways)) // 2
        code = f"{mutual}{len(ways)}{3 - mutual - len(ways)}"
        sent, received = {a for a, _ in ways}, {b for _, b in ways}
        if code in ("021", "120"):
            return code + ("D" if len(sent) == 1 else "U" if len(received) == 1 else "C")
        if code == "030":
            return code + ("C" if len(sent) == 3 else "T")
        if code == "111":
            return code + ("D" if received <= paired else "U")
        return code

    want = dict.fromkeys(motifs.TRIADS, 0)
    for t in itertools.combinations(range(14), 3):
        want[name({(a, b) for a, b in itertools.permutations(t, 2) if (a, b) in arcs})] += 1
    assert census == want


def test_paths_by_brute_force(spark):
    edges, edge, nodes = random_graph(spark, 16, 0.1, 3)
    far = {(a, a): 0 for a in range(16)} | {(a, b): 1 for a, b, _ in edges}
    for k, a, b in itertools.product(range(16), repeat=3):
        if (a, k) in far and (k, b) in far and far[a, k] + far[k, b] < far.get((a, b), 99):
            far[a, b] = far[a, k] + far[k, b]
    assert {(r["source"], r["id"]): r["hops"] for r in paths.distances(edge, nodes).collect()} == far
    strong = {r["id"]: r["component"] for r in paths.strong_components(edge, nodes).collect()}
    assert strong == {a: min(b for b in range(16) if (a, b) in far and (b, a) in far) for a in range(16)}
    count = {(a, a): 1.0 for a in range(16)}
    for s in range(16):
        for v in sorted((v for v in range(16) if far.get((s, v), 0) > 0), key=lambda v: far[s, v]):
            count[s, v] = sum(count[s, u] for u, w, _ in edges if w == v and (s, u) in far and far[s, u] == far[s, v] - 1)
    want = {v: sum(count[s, v] * count[v, t] / count[s, t] for s in range(16) for t in range(16) if len({s, v, t}) == 3 and (s, v) in far and (v, t) in far and far[s, v] + far[v, t] == far.get((s, t))) for v in range(16)}
    got = {r["id"]: r["betweenness"] for r in paths.betweenness(edge, nodes, nodes).collect()}
    assert all(abs(got[v] - want[v]) < 1e-9 for v in range(16))
    chain = spark.createDataFrame([(i, i + 1, 1) for i in range(60)], "src long, dst long, weight long")
    assert {r["component"] for r in paths.weak_components(chain, spark.range(62)).collect()} == {0, 61}
    with pytest.raises(Exception, match="ends after"):
        paths.expand(chain.filter("src < 3"), 0, 10).collect()


def test_communities_recover_blocks(spark):
    rng = random.Random(4)
    pairs = [(a, b, 1) for a in range(45) for b in range(a + 1, 45) if rng.random() < (0.6 if a // 15 == b // 15 else 0.03)]
    table = spark.createDataFrame(pairs, "lo long, hi long, weight long")
    got = {r["id"]: r["community"] for r in communities.communities(table).collect()}
    assert all(got[i] == 15 * (i // 15) for i in range(45))


def test_partition_agreement(spark):
    labels = spark.createDataFrame([(i, i // 10, i // 10) for i in range(30)], "id long, a long, b long")
    r = stats.partition_agreement(labels, "a", "b").first()
    assert abs(r["nmi"] - 1) < 1e-12 and abs(r["ari"] - 1) < 1e-12


def run_both(spark, n, net, given, p, steps):
    network = dynamics.fixed_point(spark.createDataFrame(net or [(0, 0, 0.0)], "src long, dst long, w double"))
    nodes, stim = spark.range(n), spark.createDataFrame(given, "t int, id long")
    out = []
    for f in (dynamics.dense_steps, dynamics.event_steps):
        raster, final = f(network, nodes, stim, p, steps)
        out.append((sorted((r["t"], r["id"]) for r in raster.collect()), {r["id"]: r["v"] for r in final.collect()}))
    assert out[0][0] == out[1][0] and all(abs(out[0][1][i] - out[1][1][i]) < 1e-9 for i in range(n))
    table = sorted(net)
    src, dst, w = (np.array([x[k] for x in table], float if k == 2 else np.int64) for k in range(3))
    pulses, v, _ = dynamics.simulate(src, dst, w, n, np.array([t for t, _ in given]), np.array([i for _, i in given]), p, steps)
    assert [(t, i) for t, x in enumerate(pulses) for i in x.tolist()] == out[0][0] and np.allclose(v, [out[0][1][i] for i in range(n)], atol=1e-8)
    return out[0]


def test_dynamics_fixtures(spark):
    p = dynamics.Params()
    raster, final = run_both(spark, 1, [], [(0, 0)], p.with_(input_weight=0.5), 11)
    assert raster == [] and abs(final[0] - 0.5 * math.exp(-10 / 20)) < 1e-9
    assert run_both(spark, 1, [], [(t, 0) for t in range(5)], p, 5)[0] == [(0, 0), (4, 0)]
    assert run_both(spark, 1, [], [(0, 0)], p.with_(input_weight=1.0), 2)[0] == [(0, 0)]
    assert run_both(spark, 2, [(0, 1, 1.5)], [(2, 0)], p.with_(delay=2), 6)[0] == [(2, 0), (4, 1)]
    both = run_both(spark, 4, [(0, 2, 0.7), (1, 2, -0.5), (3, 2, 0.7)], [(0, 0), (3, 0), (3, 3), (6, 0), (6, 1), (6, 3)], p.with_(refractory=2), 9)
    assert [x for x in both[0] if x[1] == 2] == [(4, 2)] and abs(both[1][2] - 0.9 * math.exp(-1 / 20)) < 1e-9
    with pytest.raises(ValueError):
        dynamics.Params(delay=0)


def test_records(spark, tmp_path):
    points = spark.createDataFrame([("x", g, s, "STABLE" if r == "S" else "DEAD") for g, rs in enumerate(["SS", "SD", "SS", "SS", "DD", "SS"]) for s, r in enumerate(rs)], "subgraph string, gain int, seed int, regime string")
    best = warehouse.stable_range(points).first()
    assert (best["low"], best["high"], best["n"]) == (2, 3, 2)
    runs = spark.createDataFrame([(1.0, float(n), float(e), 2.0 + 3.0 * n) for n, e in itertools.product(range(1, 6), range(1, 6))], "base double, n double, e double, wall double")
    assert np.allclose(warehouse.cost_model(runs, ["base", "n", "e"], "wall"), [2, 3, 0], atol=1e-6)
    sizes = spark.createDataFrame([(x,) for x in (0, 127, 128, 16383, 16384)], "v long").select(warehouse.varint_size(F.col("v")).alias("b")).collect()
    assert [r["b"] for r in sizes] == [1, 1, 2, 2, 3]
    (tmp_path / "f").write_bytes(b"hello\n")
    found = files.digests(spark, str(tmp_path / "f"))
    assert found.first()["blob_sha1"] == "ce013625030ba8dba906f756967f9e9ca394464a"
    want = spark.createDataFrame([("f", 7, None, None), ("g", None, None, None)], "name string, size long, md5 string, blob_sha1 string")
    assert {(r["name"], r["problem"]) for r in files.verified(found, want).collect()} == {("f", "size"), ("g", "missing")}
    assert files.parse_size("8GB") == 8 * 1024**3 and files.format_size(1536) == "1.5 KiB"


def test_readers(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.feather as feather

    feather.write_feather(pa.table({"a": [1, 2], "b": ["x", None], "c": [0.5, 1.5]}), str(tmp_path / "t.arrow"), compression="uncompressed")
    got = files.read_arrow(spark, str(tmp_path / "t.arrow"), "a long, b string").collect()
    assert [tuple(r) for r in got] == [(1, "x"), (2, None)]
    np.save(tmp_path / "ids.npy", np.array([5, 3], np.uint64))
    assert [r["id"] for r in files.read_npy(spark, str(tmp_path / "ids.npy")).collect()] == [5, 3]


def test_streaming_counts(spark, tmp_path):
    from ripplegraph.streaming.pulses import step_counts

    rows = spark.createDataFrame([(f"2024-01-01 00:00:0{i % 3}", i) for i in range(9)], "at string, id long").select(F.to_timestamp("at").alias("at"), "id")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = step_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["pulses"] for r in spark.table("counts").collect()) == sorted(r["pulses"] for r in step_counts(rows).collect()) == [3, 3, 3]


def test_entry_survives_without_the_corpus_package():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def whole_events(spark, least):
    from ripplegraph.plans import graph as plans

    edge, nodes = plans.events(spark, SMALL)
    return {(r["src"], r["dst"]) for r in edge.filter(f"weight >= {least}").collect()}, sorted(r["id"] for r in nodes.collect())


SMALL = "/root/testdata/sf0.01"


def test_triad_query_counts_the_whole_graph(spark):
    from ripplegraph.plans import structure

    arcs, nodes = whole_events(spark, 1)
    got = {r["triad"]: r["n"] for r in structure.g9_triad_census(spark, SMALL).collect()}
    mutual = sum((b, a) in arcs for a, b in arcs if a != b) // 2
    one_way = len({e for e in arcs if e[0] != e[1]}) - 2 * mutual
    kinds = {k: k[:3] for k in got}
    assert sum(got.values()) == math.comb(len(nodes), 3)
    assert sum(n * int(kinds[k][0]) for k, n in got.items()) == mutual * (len(nodes) - 2)
    assert sum(n * int(kinds[k][1]) for k, n in got.items()) == one_way * (len(nodes) - 2)


def test_component_queries_take_the_whole_graph(spark):
    from ripplegraph.plans import structure

    arcs, nodes = whole_events(spark, 2)

    def reach(start, step):
        seen, todo = {start}, [start]
        while todo:
            for v in step.get(todo.pop(), ()):
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        return seen

    forth, back, both = {}, {}, {}
    for a, b in arcs:
        forth.setdefault(a, set()).add(b)
        back.setdefault(b, set()).add(a)
        both.setdefault(a, set()).add(b)
        both.setdefault(b, set()).add(a)
    weak = {r["id"]: r["component"] for r in structure.g4_weak_components(spark, SMALL).collect()}
    assert weak == {a: min(reach(a, both)) for a in nodes}
    strong = {r["id"]: r["component"] for r in structure.g5_strong_components(spark, SMALL).collect()}
    assert strong == {a: min(reach(a, forth) & reach(a, back)) for a in nodes}
    assert structure.g4_component_report(spark, SMALL).first()["components"] == len(set(weak.values()))


def test_strict_lookup_takes_all_nodes(spark):
    from ripplegraph.plans import graph as plans
    from ripplegraph.sources import adapters

    got = {r["id"]: r["found"] for r in plans.p5_strict_lookup(spark, SMALL).collect()}
    assert got == {r["id"]: True for r in adapters.part_nodes(spark, SMALL).collect()}


def test_rich_club_regime(spark):
    # A curve whose description is known; the last point has too few nodes.
    rows = [(1, 1.0, 1000), (10, 1.005, 800), (20, 1.02, 500), (40, 1.03, 200), (80, 0.99, 60), (160, 0.6, 20), (320, 0.3, 5)]
    r = stats.rich_club_regime(spark.createDataFrame(rows, "k int, value double, nodes long")).first()
    assert (r["first_k"], r["first_nodes"], r["last_k"], r["top_k"], r["below_one_k"], r["low_k"], r["contiguous"]) == (20, 500, 40, 40, 80, 160, True)
    flat = stats.rich_club_regime(spark.createDataFrame([(1, 1.0, 50), (2, 0.9, 50)], "k int, value double, nodes long")).first()
    assert flat["first_k"] is None and flat["contiguous"] is False and flat["below_one_k"] == 2
    gap = stats.rich_club_regime(spark.createDataFrame([(1, 1.1, 50), (2, 0.9, 50), (3, 1.2, 50)], "k int, value double, nodes long")).first()
    assert gap["contiguous"] is False and gap["below_one_k"] is None
    assert stats.rich_club_regime(spark.createDataFrame([], "k int, value double, nodes long")).first()["contiguous"] is False


def test_regimes(spark):
    p = dynamics.Params(refractory=2)
    rows = [("all", t, 10 if t < 30 and t % 3 == 0 else 0, 10 if t < 30 else 0) for t in range(60)]
    rows += [("fed", t, int(t < 30), int(t < 30)) for t in range(60)]
    rows += [("grows", t, 2 if t < 30 and t % 2 else 0, int(t < 30 and t % 2)) for t in range(60)]
    rows += [("late", t, int(t % 10 == 9), 1) for t in range(60)] + [("runaway", t, 0 if t < 30 else 1, 0) for t in range(60)]
    got = {r["run"]: r for r in dynamics.regimes(spark.createDataFrame(rows, "run string, t int, pulses int, external long"), 10, 30, p).collect()}
    assert {k: r["regime"] for k, r in got.items()} == {"all": "SATURATED", "fed": "DEAD", "grows": "STABLE", "late": "STABLE", "runaway": "SATURATED"}
    assert got["grows"]["amplification"] == 2 and got["late"]["self_sustained"] and not got["fed"]["self_sustained"]
    one = dynamics.regimes(spark.createDataFrame([("x", t, int(t == 31), 0) for t in range(32)], "run string, t int, pulses int, external long"), 1, 30, p).first()
    assert one["rate_late"] == 1  # of two steps without input the last third is one


def test_stimulus_counts(spark):
    nodes = spark.range(101).withColumnRenamed("id", "id")
    pulse = dynamics.stimulus(nodes, 30, 0.3, 1, "pulse", 10, fraction=0.5).groupBy("t").count().collect()
    assert sorted(map(tuple, pulse)) == [(0, 15), (10, 15), (20, 15)]
    pattern = dynamics.stimulus(nodes, 40, 0.0, 2, "sparse_pattern", 20, 5, members=12).collect()
    assert len(pattern) == 24 and len({r["id"] for r in pattern}) == 12 and all(r["t"] % 20 < 5 for r in pattern)
    assert {(r["t"], r["id"]) for r in pattern if r["t"] >= 20} == {(r["t"] + 20, r["id"]) for r in pattern if r["t"] < 20}
    few = dynamics.stimulus(nodes, 50, 1.0, 3, "poisson", fraction=0.001, on_steps=7)
    assert few.select("id").distinct().count() == 1 and few.count() == 7


def test_outcomes_and_crossings(spark):
    rows = [("x", 0.1, 1.1, 1.06, 1.2), ("x", 1.0, 1.3, 1.04, 2.0), ("y", 0.1, 1.25, 1.06, 2.0), ("y", 1.0, 0.8, 0.5, 0.94)]
    got = warehouse.significant(warehouse.outcome(spark.createDataFrame(rows, "subgraph string, rate double, median double, least double, largest double")))
    assert [r["class"] for r in got.orderBy("subgraph", "rate").collect()] == ["B", "B", "A", "C"]
    assert [r["significant"] for r in got.orderBy("subgraph", "rate").collect()] == [True, True, True, True]
    assert tuple(warehouse.majority(got).first()) == (1, 2, 1, None)
    curves = {"down": [1.0, 0.9, 0.8], "up": [1.2, 1.1, 1.05], "one": [4.0, 0.25, 0.2], "two": [2.0, 0.5, 2.0]}
    points = spark.createDataFrame([(k, 10.0 ** (i - 3), v, float(i)) for k, vs in curves.items() for i, v in enumerate(vs)], "subgraph string, rate double, median double, events double")
    r = {x["subgraph"]: x for x in warehouse.crossover(points, linear=("events",)).collect()}
    assert r["down"]["status"] == "slower everywhere" and r["down"]["nearest"] == 1.0 and r["down"]["rate"] is None
    assert r["up"]["status"] == "faster everywhere" and r["up"]["nearest"] == 1.05
    assert r["one"]["status"] == "crossover" and r["one"]["rate"] == pytest.approx(10**-2.5) and r["one"]["faster_below"] and r["one"]["events"] == pytest.approx(0.5)
    assert r["two"]["status"] == "multiple crossings"


def test_checks_read_the_raw_rows_once(spark):
    """The raw rows may be a large join: every check reads them as written, none computes them anew."""
    from ripplegraph.operators import checks

    p = ", ".join(f"CAST({int(i == 0)} AS DOUBLE) AS p{i}" for i in range(6))
    rows = spark.sql(f"SELECT id % 7 AS src, id % 5 AS dst, 'A' AS region, id % 3 AS weight, {p} FROM range(50)")
    nodes = spark.createDataFrame([(i,) for i in range(5)], "id long")
    annotations = spark.createDataFrame([(1, "a", "b")], "id long, super_class string, cell_type string")
    got = checks.observed(rows, nodes, annotations)
    assert "Range (" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = {r["id"]: r["observed"] for r in got.collect()}
    raw = [(k % 7, k % 5, k % 3) for k in range(50)]
    assert found["C1"] == 50 and found["C2"] == sum(s > 4 for s, _, _ in raw) and found["C3"] == 0 and found["C4"] == sum(w == 0 for *_, w in raw)
    assert found["D2"] == sum(w for s, _, w in raw if s < 5) and found["D8"] == found["E3"] == found["F1f"] == 0


def test_checks_are_planned_one_by_one(spark):
    """One plan of all checks held the stages of every aggregate on the driver at once; now the result is a scan of their rows."""
    from ripplegraph.operators import checks

    p = ", ".join(f"CAST({int(i == 0)} AS DOUBLE) AS p{i}" for i in range(6))
    rows = spark.sql(f"SELECT id % 7 AS src, id % 5 AS dst, 'A' AS region, id % 3 AS weight, {p} FROM range(50)")
    annotations = spark.createDataFrame([(1, "a", "b")], "id long, super_class string, cell_type string")
    got = checks.observed(rows, spark.range(5), annotations, raw_digest=1)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Union" not in plan and "Join" not in plan
    found = [r["id"] for r in got.collect()]
    assert len(found) == len(set(found)) == len(checks.CHECKS)
