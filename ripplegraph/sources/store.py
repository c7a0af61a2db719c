"""Versioned stores of tables, verified when they are opened, and catalogues of raw files with a lock.

A store is a folder: versions/ID/TABLE holds Parquet files, versions/ID/manifest a row for each file with its size and digest
and for each table its schema, and pointers/ a row for each version that was finished. A write makes a new version and then
appends its pointer, a single small file, as the last step; the highest pointer is the store. So readers see an old version or
a new one, never a part, and a write that breaks off changes nothing. Opening compares the files that are there with the
manifest, row against row in a full outer join, by digest (or, quickly, by size).
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Of the layout; a store of another format is refused.
FORMAT = 2
#: Bytes up to which a file is digested as a whole, by one task.
WHOLE = 1 << 27
#: Of the polynomial of the digests of a larger file's lines.
_PRIME = (1 << 521) - 1
_BASE = int.from_bytes(hashlib.sha512(b"ripplegraph lines").digest(), "big")
_POINTER = "number long, version string, format int, lock string"
_MANIFEST = "name string, size long, sha256 string"


class StoreError(Exception):
    """A store that is missing, of another format, or not what was written."""


def _line_sums(batches):
    """(name, start, n, sum) of each block of a file: its number of lines and the polynomial of their digests, in their order."""
    found: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        for name, start, line in zip(*(batch.column(c).to_pylist() for c in ("name", "start", "line")), strict=True):
            block = found.setdefault((name, start), [0, 0])
            block[0] += 1
            block[1] = (block[1] * _BASE + int.from_bytes(hashlib.sha256(line).digest(), "big")) % _PRIME
    rows = [(*k, n, f"{x:x}") for k, (n, x) in found.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["name", "start", "n", "sum"])


def _joined_sums(blocks: pa.Table) -> pa.Table:
    """The digest of a file from its blocks; it does not depend on where they are cut."""
    total = 0
    for b in sorted(blocks.to_pylist(), key=lambda b: b["start"]):
        total = (total * pow(_BASE, b["n"], _PRIME) + int(b["sum"], 16)) % _PRIME
    return pa.table({"name": blocks.column("name").slice(0, 1), "sha256": pa.array(["lines-" + hashlib.sha256(f"{total:x}".encode()).hexdigest()])})


def _listed(spark: SparkSession, path: str, name: Callable[[Column], Column], content: bool, whole: int = WHOLE) -> DataFrame:
    """(name, size, sha256) of the files under a path. A file above `whole` bytes is read by many tasks, in lines: SHA-256
    takes its input in order, so its digest is made of the lines' digests and begins with "lines-"."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = lambda df, digest: df.select(name(F.col("path")).alias("name"), F.col("length").alias("size"), digest.alias("sha256"))
    if not content:
        return named(files, F.lit(None).cast("string"))
    short, long = named(files.filter(F.col("length") <= whole), F.sha2("content", 256)), files.filter(F.col("length") > whole).select("path", "length")
    paths = [r["path"] for r in long.select("path").toLocalIterator()]  # a name for each large file
    if not paths:
        return short
    ship(spark)
    lines = spark.read.option("lineSep", "\n").text(paths).select(name(F.col("_metadata.file_path")).alias("name"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    sums = lines.mapInArrow(_line_sums, "name string, start long, n long, sum string").groupBy("name").applyInArrow(_joined_sums, "name string, sha256 string")
    return short.unionByName(named(long, F.lit(None).cast("string")).drop("sha256").join(sums, "name"))


def listing(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """(name, size, sha256) of the files under a folder; names are relative to it. Without content no file is read and sha256 is null."""
    return _listed(spark, path, lambda p: F.substring_index(p, f"/{path.rstrip('/').rsplit('/', 1)[-1]}/", -1), content)


def listing_of(spark: SparkSession, paths: list[str], content: bool = True) -> DataFrame:
    """(name, size, sha256) of the files of several tables; a table that is a folder gives TABLE/FILE."""
    out = None
    for path in paths:
        above = "/" + path.rstrip("/").rsplit("/", 1)[0].rsplit("/", 1)[-1] + "/"
        got = _listed(spark, path, lambda p, above=above: F.substring_index(p, above, -1), content)
        out = got if out is None else out.unionByName(got)
    return out


def match(found: DataFrame, declared: DataFrame) -> DataFrame:
    """(name, problem) where two listings (name, size, sha256) differ: missing, new, size or digest; what is null is not compared."""
    a = found.select("name", F.col("size").alias("size_a"), F.col("sha256").alias("sha_a"), F.lit(True).alias("a"))
    b = declared.select("name", F.col("size").alias("size_b"), F.col("sha256").alias("sha_b"), F.lit(True).alias("b"))
    problem = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "new").when(F.col("size_a") != F.col("size_b"), "size").when(F.col("sha_a") != F.col("sha_b"), "digest")
    return a.join(b, "name", "full").select("name", problem.alias("problem")).filter("problem IS NOT NULL")


def lock(files: DataFrame, path: str) -> None:
    """Writes the listing of raw files; it appears as a whole, under a new name, and the last one counts."""
    files.coalesce(1).write.json(f"{path}/lock-{uuid.uuid4().hex}")
    spark = files.sparkSession
    before = _pointers(spark, path)
    written = [p for p in _folders(spark, path) if p.startswith("lock-") and p not in before]
    number = len(before)
    spark.createDataFrame([(number + i, p, FORMAT, None) for i, p in enumerate(written)], _POINTER).coalesce(1).write.mode("append").json(f"{path}/pointers")


def locked(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, sha256) of the last lock."""
    return spark.read.schema(_MANIFEST).json(f"{path}/{_current(spark, path)['version']}")


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _folders(spark: SparkSession, path: str) -> list[str]:
    fs, p = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _pointers(spark: SparkSession, path: str) -> dict[str, dict]:
    if "pointers" not in _folders(spark, path):
        return {}
    rows = spark.read.schema(_POINTER).json(f"{path}/pointers").collect()  # a row for each version
    return {r["version"]: r.asDict() for r in sorted(rows, key=lambda r: (r["number"], r["version"]))}


def _current(spark: SparkSession, path: str) -> dict:
    have = _pointers(spark, path)
    if not have:
        raise StoreError(f"no store in {path}")
    last = list(have.values())[-1]
    if last["format"] != FORMAT:
        raise StoreError(f"{path} has format {last['format']}, not {FORMAT}")
    return last


def write_store(tables: dict[str, DataFrame], path: str, inputs: DataFrame | None = None) -> str:
    """Writes the tables as a new version, which becomes the store in the last step; returns its name.

    inputs: a listing of the raw files that it is made from, kept as the store's lock.
    """
    spark = next(iter(tables.values())).sparkSession
    before = _pointers(spark, path)
    version = uuid.uuid4().hex
    folder = f"{path}/versions/{version}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/tables/{name}")
    schemas = [(name, spark.read.parquet(f"{folder}/tables/{name}").schema.json()) for name in tables]
    spark.createDataFrame(schemas, "name string, schema string").coalesce(1).write.json(f"{folder}/schemas")
    listing(spark, f"{folder}/tables").filter("name NOT LIKE '%/\\\\_SUCCESS'").coalesce(1).write.json(f"{folder}/manifest")
    if inputs is not None:
        inputs.select("name", "size", "sha256").coalesce(1).write.json(f"{folder}/inputs")
    number = max((p["number"] for p in before.values()), default=-1) + 1
    spark.createDataFrame([(number, version, FORMAT, "inputs" if inputs is not None else None)], _POINTER).coalesce(1).write.mode("append").json(f"{path}/pointers")
    return version


def problems(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """(name, problem) of the store's files against its manifest."""
    folder = f"{path}/versions/{_current(spark, path)['version']}"
    found = listing(spark, f"{folder}/tables", content).filter("name NOT LIKE '%/\\\\_SUCCESS'")
    return match(found, spark.read.schema(_MANIFEST).json(f"{folder}/manifest"))


def changed_inputs(found: DataFrame, path: str) -> DataFrame:
    """(name, problem) of raw files, as listed now, against those that the store was made from (check A1)."""
    spark = found.sparkSession
    current = _current(spark, path)
    if current["lock"] is None:
        raise StoreError(f"{path} was written without a listing of its inputs")
    return match(found, spark.read.schema(_MANIFEST).json(f"{path}/versions/{current['version']}/{current['lock']}"))


def read_store(spark: SparkSession, path: str, only: list[str] | None = None, verify: str = "digest") -> dict[str, DataFrame]:
    """Tables of the store by name, lazily. verify: digest (reads every file once), size (lists files) or none."""
    current = _current(spark, path)
    if verify != "none":
        bad = problems(spark, path, verify == "digest").limit(20).collect()
        if bad:
            raise StoreError(f"{path}: " + ", ".join(f"{r['name']} {r['problem']}" for r in bad))
    folder = f"{path}/versions/{current['version']}"
    schemas = spark.read.schema("name string, schema string").json(f"{folder}/schemas").collect()  # a row for each table
    return {r["name"]: spark.read.schema(T.StructType.fromJson(json.loads(r["schema"]))).parquet(f"{folder}/tables/{r['name']}") for r in schemas if only is None or r["name"] in only}
