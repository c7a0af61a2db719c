"""Counts of arriving pulses.

Pulses arrive as rows (at TIMESTAMP, id). A simulation step is a tumbling window of dt; pulses later than the watermark are
dropped, as nothing can be delivered to a step that is over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def step_counts(pulses: DataFrame, dt: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """(begin, pulses, nodes) of each step; works on a stream and on a table."""
    steps = pulses.withWatermark("at", late) if pulses.isStreaming else pulses
    got = steps.groupBy(F.window("at", dt)).agg(F.count(F.lit(1)).alias("pulses"), F.approx_count_distinct("id").alias("nodes") if pulses.isStreaming else F.count_distinct("id").alias("nodes"))
    return got.select(F.col("window.start").alias("begin"), "pulses", "nodes")


def deliveries(pulses: DataFrame, network: DataFrame, delay: str = "1 second") -> DataFrame:
    """(at, dst, w): what each pulse delivers and when; a stream-static join."""
    out = pulses.select((F.col("at") + F.expr(f"INTERVAL {delay}")).alias("at"), F.col("id").alias("src"))
    return out.join(network, "src").select("at", "dst", "w")
