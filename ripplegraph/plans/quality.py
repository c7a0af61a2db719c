"""The checks on the co-order graph, and files through their readers and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as C
from ..session import written
from ..sources import adapters as A
from ..sources import arrow, files, store
from ..sources.adapters import NODES_SQL, RAW_SQL
from .graph import COUNT_SQL, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def annotations(spark, sf):
    return A.read(spark, sf, "part").filter("p_partkey % 50 <> 1").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("super_class"), F.when(F.col("p_size") > 5, F.col("p_brand")).alias("cell_type"))


_W = "(SELECT coalesce(sum(n), 0) FROM {side} WHERE {where})"


def _region_sql(name: str, side: str, table: str) -> str:
    ok = "id IN (SELECT id FROM nodes)"
    v = {"a": "true", "b": ok, "c": f"{ok} AND region IS NULL", "d": f"{ok} AND region IS NOT NULL"}
    rows = [f"SELECT '{name}{k}' AS id, CAST({_W.format(side=table, where=w)} AS DOUBLE) AS observed" for k, w in v.items()]
    rows.append(f"SELECT '{name}e', median(coalesce(held, 0) / a) FROM (SELECT id, sum(n) AS a FROM {table} WHERE {ok} GROUP BY id) LEFT JOIN (SELECT {side} AS id, sum(weight) AS held FROM edges GROUP BY 1) USING (id)")
    rows.append(f"SELECT '{name}f', 0")
    return " UNION ALL ".join(rows)


CHECK_SQL = f"""WITH {COUNT_SQL}, ann AS (SELECT p_partkey AS id, p_type AS super_class, CASE WHEN p_size > 5 THEN p_brand END AS cell_type FROM part WHERE p_partkey % 50 <> 1),
qq AS (SELECT src, dst, count(*) FILTER (predicted) AS good FROM known GROUP BY 1, 2),
o AS (
SELECT 'B1' AS id, CAST(count(*) AS DOUBLE) AS observed FROM nodes UNION ALL SELECT 'B2', count(DISTINCT id) FROM nodes
UNION ALL SELECT 'C1', count(*) FROM raw UNION ALL SELECT 'C2', count(*) FROM raw WHERE src NOT IN (SELECT id FROM nodes) UNION ALL SELECT 'C3', count(*) FROM raw WHERE dst NOT IN (SELECT id FROM nodes)
UNION ALL SELECT 'C4', count(*) FROM raw WHERE weight <= 0 UNION ALL SELECT 'C5', coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM raw GROUP BY src, dst, region)
UNION ALL SELECT 'C6', count(*) FROM raw WHERE region IN ('UNASGD', 'None') UNION ALL SELECT 'C7', count(DISTINCT region) FROM raw WHERE region NOT IN ('UNASGD', 'None')
UNION ALL SELECT 'C8', 0 UNION ALL SELECT 'C8b', count(*) FROM raw WHERE NOT predicted UNION ALL SELECT 'C9', 0
UNION ALL SELECT 'D1', count(*) FROM edges UNION ALL SELECT 'D2', sum(weight) FROM edges UNION ALL SELECT 'D3', count(*) FROM edges WHERE weight >= 5
UNION ALL SELECT 'D4', count(DISTINCT x) FROM (SELECT src AS x FROM edges WHERE weight >= 5 UNION ALL SELECT dst FROM edges WHERE weight >= 5)
UNION ALL SELECT 'D5', count(*) FROM edges WHERE src = dst UNION ALL SELECT 'D6', count(*) FROM nodes WHERE id NOT IN (SELECT src FROM edges) AND id NOT IN (SELECT dst FROM edges)
UNION ALL SELECT 'D7a', count(*) FROM nodes WHERE id NOT IN (SELECT src FROM edges) UNION ALL SELECT 'D7b', count(*) FROM nodes WHERE id NOT IN (SELECT dst FROM edges)
UNION ALL SELECT unnest(['D8', 'E1', 'E2', 'E3', 'E4', 'E5', 'E6']), 0 UNION ALL SELECT 'E6b', count(*) FROM qq WHERE good = 0
UNION ALL {_region_sql('F1', 'src', 'side_a')} UNION ALL {_region_sql('F2', 'dst', 'side_b')}
UNION ALL SELECT 'G1', count(*) FILTER (id IN (SELECT id FROM ann)) / count(*) FROM nodes UNION ALL SELECT 'H4', count(*) FILTER (id IN (SELECT id FROM ann)) / count(*) FROM nodes
UNION ALL SELECT 'G1b', count(*) FROM nodes WHERE id NOT IN (SELECT id FROM ann) UNION ALL SELECT 'G2', count(*) FROM ann WHERE id NOT IN (SELECT id FROM nodes)
UNION ALL SELECT 'G3', count(super_class) / count(*) FROM ann UNION ALL SELECT 'G4', count(cell_type) / count(*) FROM ann UNION ALL SELECT 'G5', count(DISTINCT super_class) FROM ann
UNION ALL SELECT 'H1', count(*) FROM ann UNION ALL SELECT 'H2', count(DISTINCT id) FROM ann UNION ALL SELECT 'H3', count(DISTINCT coalesce(cell_type, super_class)) FROM ann
UNION ALL SELECT 'I1', avg(weight) FROM edges UNION ALL SELECT 'I2', quantile_cont(weight, 0.99) FROM edges UNION ALL SELECT 'I3', max(weight) FROM edges)"""

EXPECTED = [("B1", 1960.0), ("C2", 0.0), ("C4", 0.0), ("D8", 0.0), ("E1", 0.0), ("G1", 1.0), ("C7", 23.0)]


def found(spark, sf):
    return C.observed(A.coorder_rows(spark, sf), A.part_nodes(spark, sf), annotations(spark, sf)).filter("id <> 'E7'")


@query(f"{CHECK_SQL} SELECT id, round(observed, 6) AS observed FROM o")
def checks_observed(spark, sf):
    return rounded(found(spark, sf))


EXPECT = ", ".join(f"('{k}', {v})" for k, v in EXPECTED)
REPORT_SQL = f"""{CHECK_SQL}, x AS (SELECT o.id, CASE WHEN e IS NULL THEN 'INFO' WHEN abs(observed - e) > 0 THEN CASE WHEN o.id = 'G1' THEN 'WARN' ELSE 'FAIL' END ELSE 'PASS' END AS status FROM o LEFT JOIN (VALUES {EXPECT}) t(id, e) ON o.id = t.id)"""


def checked(spark, sf):
    return C.report(found(spark, sf), spark.createDataFrame(EXPECTED, "id string, expected double"))


@query(f"{REPORT_SQL} SELECT id, status FROM x")
def checks_report(spark, sf):
    return checked(spark, sf).select("id", "status")


@query(f"{REPORT_SQL} SELECT status, count(*) AS n FROM x GROUP BY 1")
def a23_check_status(spark, sf):
    return C.status_counts(checked(spark, sf))


@query(f"{REPORT_SQL} SELECT CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' ELSE 'PASS' END AS overall FROM x")
def checks_overall(spark, sf):
    return C.overall(checked(spark, sf))


def _folder(spark, name):
    """A folder of its own for each call."""
    import uuid

    from ..session import scratch_dir

    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {NODES_SQL} SELECT id, super_class, cell_type, side, size FROM nodes")
def s5_s6_store_round_trip(spark, sf):
    """The second version of a store, opened with its digests verified."""
    path, nodes = _folder(spark, "store"), A.part_nodes(spark, sf)
    store.write_store({"nodes": nodes.filter("id % 2 = 0")}, path)
    store.write_store({"nodes": nodes}, path)
    return store.read_store(spark, path)["nodes"]


@query()
def a1_locked_inputs(spark, sf):
    """Check A1: each raw file that a store was made from, and whether it is the same now."""
    path = _folder(spark, "store")
    raw = [f"{sf}/{t}.parquet" for t in ("part", "lineitem", "supplier", "nation")]
    store.write_store({"nodes": A.part_nodes(spark, sf)}, path, store.listing_of(spark, raw))
    now = store.listing_of(spark, raw)
    return now.join(store.changed_inputs(now, path), "name", "left").select("name", F.coalesce("problem", F.lit("same")).alias("status"))


@query("SELECT name, problem FROM (VALUES ('part', 'new'), ('nation', 'size'), ('orders', 'missing')) t(name, problem)")
def s8_catalogue(spark, sf):
    """Tables as they are against a lock in which one is left out, one has another size and one is there too much."""
    path = _folder(spark, "catalogue")
    tables = [f"{sf}/{t}.parquet" for t in ("part", "nation", "region", "customer")]
    now = store.listing_of(spark, tables).groupBy(F.split("name", r"\.")[0].alias("name")).agg(F.sum("size").alias("size"), F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ","), 256).alias("sha256"))
    declared = now.filter("name <> 'part'").withColumn("size", F.when(F.col("name") == "nation", F.col("size") + 1).otherwise(F.col("size")))
    store.lock(declared.union(now.filter("name = 'part'").select(F.lit("orders"), "size", "sha256")), path)
    return store.match(now, store.locked(spark, path))


@query("SELECT p_partkey AS id, p_name AS name, p_retailprice / 2 AS half FROM part")
def s3_tsv_round_trip(spark, sf):
    path, part = _folder(spark, "tsv"), A.read(spark, sf, "part")
    part.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".0")).alias("id"), F.col("p_name").alias("name"), (F.col("p_retailprice") / 2).alias("half")).write.option("sep", "\t").option("header", True).csv(path)
    return files.read_tsv(spark, path, ("half",), ("id",))


@query(f"WITH {RAW_SQL} SELECT src, dst, weight FROM raw")
def s1_arrow_scan(spark, sf):
    """Raw rows written as Arrow files by many tasks, and three of their columns read by groups of record batches."""
    path = _folder(spark, "arrow")
    arrow.register(spark)
    A.coorder_rows(spark, sf).write.format(arrow.NAME).mode("append").save(path)
    return spark.read.format(arrow.NAME).schema("src long, dst long, weight long").load(path)


@query("SELECT o_orderkey AS run, o_orderpriority AS subgraph FROM orders WHERE o_orderkey % 3 < 2")
def s9_records(spark, sf):
    import uuid

    from ..session import scratch_dir

    path = f"{scratch_dir(spark)}/records-{uuid.uuid4().hex}"
    o = A.read(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderpriority").alias("subgraph"))
    files.append_records(o.filter("run % 3 = 0"), path)
    done = written(files.read_records(spark, path, "run long, subgraph string").select("run"), "done")
    files.append_records(o.filter("run % 3 < 2").join(done, "run", "left_anti"), path)
    return files.read_records(spark, path, "run long, subgraph string")


@query()
def s7_file_digests(spark, sf):
    return files.digests(spark, f"{sf}/region.parquet").select("name", "size", "md5", "sha256")


@query()
def s16_environment(spark, sf):
    return files.environment(spark)
