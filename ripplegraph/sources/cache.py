"""Prepared tables that are found again by a digest of their inputs and settings.

A prepared table lies in the application's shared folder under a name made of the digest of the input files (path, size, time of
change), the settings, and the version of the code that makes it. It is written beside its place and renamed into it
once complete, with a record of its number of rows and a check sum, so a run that breaks off leaves nothing that is taken
for a table, and of two that write at once one is kept.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_dir

#: To be raised when a table of a name is made in another way.
VERSION = 1


class ChangedTable(Exception):
    """A prepared table is not what was written."""


def inputs_digest(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the files under the paths by name, size and time of change; contents are not read, names are not collected."""
    out = []
    for path in sorted(paths):
        files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
        row = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("sum")).first()
        out.append([path, row["n"], row["size"], str(row["sum"])])
    return hashlib.sha256(json.dumps(out).encode()).hexdigest()


def checksum(df: DataFrame) -> DataFrame:
    """One row: the number of rows and a sum of their hashes, which does not depend on their order."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"))


def prepared(spark: SparkSession, name: str, inputs: list[str], settings: dict, build: Callable[[], DataFrame], verify: bool = False, folder: str | None = None) -> DataFrame:
    """The table that build() makes of the input files; it is built once for these files and settings.

    verify: compare the check sum of all rows with the record, and raise ChangedTable if it differs (else only the number of
    rows is compared, which reads file footers).
    """
    key = hashlib.sha256(json.dumps([VERSION, name, settings, inputs_digest(spark, inputs)], sort_keys=True).encode()).hexdigest()[:32]
    path = f"{folder or scratch_dir(spark)}/prepared-{name}-{key}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if not fs.exists(target):
        draft = f"{path}-draft-{uuid.uuid4().hex}"
        build().write.parquet(f"{draft}/rows")
        rows = spark.read.parquet(f"{draft}/rows")
        checksum(rows).withColumn("schema", F.lit(rows.schema.json())).coalesce(1).write.json(f"{draft}/record")
        fs.rename(jvm.org.apache.hadoop.fs.Path(draft), target)
    # Where another run was first, a file system may move the draft into its folder instead; what was there stays valid.
    record = spark.read.schema("n long, sum string, schema string").json(f"{path}/record").first()
    table = spark.read.schema(T.StructType.fromJson(json.loads(record["schema"]))).parquet(f"{path}/rows")
    if verify:
        found = checksum(table).first()
        if (found["n"], found["sum"]) != (record["n"], record["sum"]):
            raise ChangedTable(f"{path}: {found['n']} rows and sum {found['sum']} instead of {record['n']} and {record['sum']}")
    elif table.count() != record["n"]:
        raise ChangedTable(f"{path}: not the {record['n']} rows that were written")
    return table


def node_list(spark: SparkSession, name: str, inputs: list[str], settings: dict, build: Callable[[], DataFrame], folder: str | None = None) -> DataFrame:
    """A prepared list of nodes, verified row by row each time it is found again."""
    return prepared(spark, f"nodes-{name}", inputs, settings, build, verify=True, folder=folder)
