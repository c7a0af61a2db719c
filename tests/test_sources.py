"""Arrow files, versioned stores, catalogues, off windows and the command line."""

import hashlib
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ripplegraph import __main__ as command
from ripplegraph.analysis import Graph, calibrate
from ripplegraph.operators import asof, warehouse
from ripplegraph.sources import arrow, store

SF = "/root/testdata/sf0.001"


def test_arrow_files_are_read_by_record_batches_and_columns(spark, tmp_path):
    table = pa.table({"a": list(range(1000)), "b": [None if i % 7 == 0 else f"x{i}" for i in range(1000)], "c": [i / 2 for i in range(1000)]})
    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as sink, pa.ipc.new_file(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
        f.write_table(table, max_chunksize=50)
    arrow.register(spark)
    read = spark.read.format(arrow.NAME).option("batches", 3).schema("b string, a long").load(str(tmp_path / "t.arrow"))
    assert read.rdd.getNumPartitions() == 7  # twenty batches, three together
    assert sorted(map(tuple, read.collect()), key=lambda r: r[1]) == [(b, a) for a, b in zip(table["a"].to_pylist(), table["b"].to_pylist())]
    whole = spark.read.format(arrow.NAME).load(f"file://{tmp_path}/t.arrow")
    assert whole.dtypes == [("a", "bigint"), ("b", "string"), ("c", "double")] and whole.agg(F.sum("c")).first()[0] == sum(i / 2 for i in range(1000))
    with pytest.raises(Exception, match="has no column z"):
        spark.read.format(arrow.NAME).schema("z long").load(str(tmp_path / "t.arrow")).collect()


def test_arrow_files_written_by_tasks(spark, tmp_path):
    arrow.register(spark)
    path = str(tmp_path / "out")
    rows = spark.range(500).select("id", F.concat(F.lit("n"), "id").alias("name"), (F.col("id") % 3 == 0).alias("third"))
    rows.repartition(5).write.format(arrow.NAME).mode("append").save(path)
    assert len(list(Path(path).glob("*.arrow"))) == 5
    back = lambda: sorted(map(tuple, spark.read.format(arrow.NAME).load(path).collect()))
    assert back() == sorted(map(tuple, rows.collect()))
    rows.filter("id < 3").coalesce(1).write.format(arrow.NAME).mode("overwrite").save(path)
    assert back() == sorted(map(tuple, rows.filter("id < 3").collect()))
    bad = rows.select(F.when(F.col("id") == 499, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")).alias("id"), "name", "third").repartition(3)
    with pytest.raises(Exception, match="stop"):
        bad.write.format(arrow.NAME).mode("append").save(path)
    assert len(back()) == 3


def test_store_versions(spark, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(store.StoreError, match="no store"):
        store.read_store(spark, path)
    first = store.write_store({"a": spark.range(5), "b": spark.range(2).toDF("x")}, path)
    old = store.read_store(spark, path)
    second = store.write_store({"a": spark.range(9)}, path)
    assert first != second and sorted(store.read_store(spark, path)) == ["a"] and store.read_store(spark, path)["a"].count() == 9
    assert old["a"].count() == 5 and old["b"].count() == 2  # a reader of the version before goes on
    assert sorted(store.read_store(spark, path, ["b"])) == []


def test_write_that_breaks_off_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    store.write_store({"a": spark.range(5)}, path)
    with pytest.raises(Exception, match="stop"):
        store.write_store({"a": spark.range(7), "b": spark.range(1).select(F.raise_error(F.lit("stop")).cast("long").alias("x"))}, path)
    assert store.read_store(spark, path)["a"].count() == 5


def test_store_is_verified_on_open(spark, tmp_path):
    path = str(tmp_path / "s")
    version = store.write_store({"a": spark.range(50).repartition(3)}, path)
    files = sorted(Path(path, "versions", version, "tables", "a").glob("part-*"))
    assert store.problems(spark, path).isEmpty()
    data = bytearray(files[0].read_bytes())
    data[len(data) // 2] ^= 1
    files[0].write_bytes(bytes(data))
    files[1].rename(files[1].with_name("part-other.parquet"))
    for extra in files[0].parent.glob(".*.crc"):
        extra.unlink()
    found = {(r["name"].rsplit("/", 1)[-1], r["problem"]) for r in store.problems(spark, path).collect()}
    assert found == {(files[0].name, "digest"), (files[1].name, "missing"), ("part-other.parquet", "new")}
    with pytest.raises(store.StoreError, match="digest"):
        store.read_store(spark, path)
    with pytest.raises(store.StoreError, match="missing"):
        store.read_store(spark, path, verify="size")
    assert store.read_store(spark, path, verify="none")


def test_lock_and_inputs(spark, tmp_path):
    raw = str(tmp_path / "raw.parquet")
    spark.range(5).coalesce(1).write.parquet(raw)
    listed = store.listing_of(spark, [raw])
    store.write_store({"a": spark.range(1)}, str(tmp_path / "s"), listed)
    store.lock(listed, str(tmp_path / "lock"))
    assert store.changed_inputs(store.listing_of(spark, [raw]), str(tmp_path / "s")).isEmpty()
    spark.range(9).coalesce(1).write.mode("append").parquet(raw)
    now = store.listing_of(spark, [raw])
    assert [r["problem"] for r in store.changed_inputs(now, str(tmp_path / "s")).collect()] == ["new"]
    assert [r["problem"] for r in store.match(now, store.locked(spark, str(tmp_path / "lock"))).collect()] == ["new"]
    store.lock(now, str(tmp_path / "lock"))
    assert store.match(now, store.locked(spark, str(tmp_path / "lock"))).isEmpty()
    store.write_store({"a": spark.range(1)}, str(tmp_path / "s"))
    with pytest.raises(store.StoreError, match="without a listing"):
        store.changed_inputs(now, str(tmp_path / "s"))


def test_off_window_of_runs_of_unequal_length(spark):
    """A run of 40 steps with a pulse in each, beside one of 60 that fell silent."""
    rows = [("short", t, 1) for t in range(40)] + [("long", t, int(t < 35)) for t in range(60)]
    got = {r["run"]: r for r in warehouse.off_window(spark.createDataFrame(rows, "run string, t int, pulses long"), 30).collect()}
    assert (got["short"]["late"], got["short"]["first_silent"]) == (1.0, None)
    assert (got["long"]["late"], got["long"]["first_silent"], got["long"]["on"]) == (0.0, 35, 1.0)


def test_off_probe_has_rates_targets_and_the_gap(spark):
    """The gap was described and not made; rates in Hz and distinct targets were missing."""
    rows = [("a", t, 8 if t < 4 else int(t == 4), 3 * t) for t in range(10)]
    got = warehouse.off_probe(spark.createDataFrame(rows, "run string, t int, pulses long, targets long"), 4, 50, 0.5).first()
    assert (got["on"], got["late"], got["hz_on"], got["hz_late"]) == (8.0, 0.0, 320.0, 0.0)
    assert (got["first_silent"], got["silent_after"], got["pulses"], got["targets"], got["most_targets"]) == (5, 1, 33, 13.5, 27)
    assert got["gap"] == pytest.approx(max(abs(sum(r[2] for r in rows[: t + 1]) - 33 * (t + 1) / 10) for t in range(10)))


def test_commands(spark, tmp_path, capsys):
    out = str(tmp_path / "store")
    assert command.main(["queries"]) == 0 and "s1_arrow_scan" in capsys.readouterr().out
    assert command.main(["datasets", SF]) == 0 and "| lineitem | 1 |" in capsys.readouterr().out
    assert command.main(["ingest", SF, "--out", out]) == 0 and command.main(["verify", SF, "--out", out]) == 0
    assert store.read_store(spark, out)["nodes"].count() == 196
    capsys.readouterr()
    assert command.main(["analyze", SF, "--least", "20", "--most-wedges", "10", "--sources", "3"]) == 0
    said = capsys.readouterr().out
    assert "## paths" in said and "clustering: skipped" in said


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_as_of_join_brackets_every_ask(spark, partitions):
    """One key holds most rows; asks below, above, on and between points; a key without points; nulls."""
    import math
    import random

    rng = random.Random(2)
    points = [("hot" if i % 5 else "k", 2.0**-i, float(rng.randint(1, 99))) for i in range(60)]
    asks = [(rng.choice(["hot", "hot", "k", "none", None]), rng.choice([2.0 ** -rng.uniform(-2, 62), 2.0 ** -rng.randint(0, 59)]), i) for i in range(400)]
    got = asof.bracketed(spark.createDataFrame(asks, "key string, rate double, tag long"), spark.createDataFrame(points, "key string, rate double, value double"), ["key"], "rate", "value", partitions).collect()
    assert len(got) == len(asks)
    by_tag = {r["tag"]: r for r in got}
    for key, rate, tag in asks:
        mine = sorted((r, v) for k, r, v in points if k == key)
        below, above = [p for p in mine if p[0] <= rate], [p for p in mine if p[0] > rate]
        r = by_tag[tag]
        assert (r["key"], r["rate"]) == (key, rate)
        assert (tuple(r["below"]) if r["below"] else None) == (below[-1] if below else None)
        assert (tuple(r["above"]) if r["above"] else None) == (above[0] if above else None)
    est = {r["tag"]: r for r in asof.estimates(spark.createDataFrame([("hot", math.sqrt(2.0**-1 * 2.0**-2), 1), ("hot", 8.0, 2)], "key string, rate double, tag long"), spark.createDataFrame([("hot", 0.5, 10.0), ("hot", 0.25, 30.0)], "key string, rate double, value double"), ["key"], 15.0, partitions=partitions).collect()}
    assert est[1]["estimate"] == pytest.approx(20.0) and est[1]["decision"] == "skip" and est[2]["decision"] == "unknown"


def test_calibrated_cost_gate(spark):
    rates = calibrate(spark, 100, 400)
    assert {r["step"] for r in rates.collect()} == {"clustering", "triads"} and rates.filter("wedges_per_s <= 0").isEmpty()
    g = Graph(spark.createDataFrame([(0, 1, 1), (1, 2, 1), (2, 3, 1)], "src long, dst long, weight long"), spark.range(4))
    given = spark.createDataFrame([("clustering", 1.0), ("triads", 0.1)], "step string, wedges_per_s double")
    assert {tuple(r) for r in g.gate(given, 10.0).collect()} == {("clustering", 2, 3.0, "run"), ("triads", 2, 30.0, "skip")}


def test_a_large_file_is_digested_by_many_tasks(spark, tmp_path):
    """The digest does not depend on the cuts, and sees an exchanged pair of lines; before, one task read the file as one row."""
    import os
    import random

    lines = [random.Random(i).randbytes(900).replace(b"\n", b"x") for i in range(6_000)]
    (tmp_path / "a").mkdir()
    got, tasks, conf = [], [], "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(conf)
    try:
        for size, order in ((1 << 20, lines), (1 << 27, lines), (1 << 20, [lines[1], lines[0], *lines[2:]])):
            (tmp_path / "a" / "big").write_bytes(b"\n".join(order))
            (tmp_path / "a" / "small").write_bytes(b"x")
            spark.conf.set(conf, size)
            files = {r["name"]: r for r in store._listed(spark, str(tmp_path / "a"), lambda p: F.substring_index(p, "/", -1), True, 1 << 20).collect()}
            got.append(files["big"]["sha256"])
            assert files["big"]["size"] == os.path.getsize(tmp_path / "a" / "big") and files["small"]["sha256"] == hashlib.sha256(b"x").hexdigest()
            tasks.append(spark.read.option("lineSep", "\n").text(str(tmp_path / "a" / "big")).rdd.getNumPartitions())
    finally:
        spark.conf.set(conf, before)
    assert got[0] == got[1] != got[2] and got[0].startswith("lines-") and tasks[0] > tasks[1] >= 1
