"""Session settings, the shared scratch folder and written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session as the tests and the benchmark use it; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ripplegraph")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("RIPPLE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster whose machines do not share this path, install the package or pass it with --py-files.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of this application's intermediate tables and checkpoints.

    The cluster names it in spark.checkpoint.dir. Only where nothing was named (that setting has a default
    value in Spark itself) and the master is local does this choose a temporary folder.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="ripplegraph-"))
    return context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write a table to the shared scratch folder and read it back.

    A lost executor costs nothing afterwards, and the reread table has a known size, so the planner can tell
    whether it may be broadcast.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
