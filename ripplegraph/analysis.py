"""The facade: one graph with its measures, and the report as a table."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import communities, ingest, motifs, nulls, paths, stats
from .session import written


@dataclass
class Graph:
    """A simple directed weighted graph: edges (src, dst, weight) and nodes (id, annotations)."""

    edges: DataFrame
    nodes: DataFrame
    log: list[tuple[str, str]] = field(default_factory=list)

    @staticmethod
    def from_rows(rows: DataFrame, nodes: DataFrame, least: int = 1) -> Graph:
        """From raw rows: known rows, summed to edges, of at least this weight, without self-loops; written once."""
        return Graph(written(ingest.simple_graph(ingest.edges(ingest.known_rows(rows, nodes)), least), "edges"), nodes)

    @cached_property
    def pairs(self) -> DataFrame:
        return written(stats.undirected(self.edges), "pairs")

    @cached_property
    def degrees(self) -> DataFrame:
        return written(stats.degrees(self.edges, self.nodes), "degrees")

    def subgraph(self, nodes: DataFrame) -> Graph:
        a, b = nodes.select(F.col("id").alias("src")), nodes.select(F.col("id").alias("dst"))
        return Graph(self.edges.join(a, "src", "left_semi").join(b, "dst", "left_semi"), nodes)

    def allowed(self, step: str, most_wedges: int) -> bool:
        """The cost gate: counts wedges first, and logs whether a step runs."""
        n = stats.wedges(self.pairs).first()["wedges"]
        ok = n <= most_wedges
        self.log.append((step, f"{'run' if ok else 'skipped'}: {n} wedges"))
        return ok

    def gate(self, rates: DataFrame, limit_s: float, safety: float = 1.5) -> DataFrame:
        """(step, wedges, estimate_s, decision) of steps with measured rates (step, wedges_per_s), see calibrate."""
        return cost_gate(stats.wedges(self.pairs), rates, limit_s, safety)

    def describe(self, sources: DataFrame | None = None, most_wedges: int = 10**11) -> dict[str, DataFrame]:
        """Tables of the report by name; steps that the cost gate skips are missing and in the log."""
        out = {
            "in_weight": stats.summary(self.degrees, "in_weight"),
            "correlations": stats.correlations(self.degrees, "in_degree", "out_degree"),
            "reciprocity": stats.reciprocity(self.edges, self.nodes),
            "components": paths.component_report(paths.weak_components(self.edges, self.nodes)),
            "hubs": stats.top_nodes(self.degrees, "in_weight", 20),
        }
        if self.allowed("clustering", most_wedges):
            out["clustering"] = motifs.clustering(self.pairs, self.nodes)
        if self.allowed("triads", most_wedges // 10):
            out["triads"] = motifs.triad_census(self.edges, self.nodes)
        if sources is not None:
            out["paths"] = paths.path_summary(paths.search_levels(self.edges, sources))
        return out

    def communities(self, seed: int = 1) -> DataFrame:
        return communities.communities(self.pairs, seed)

    def expand(self, seed: int, size: int) -> Graph:
        return self.subgraph(paths.expand(self.edges, seed, size).select("id"))


def cost_gate(wedges: DataFrame, rates: DataFrame, limit_s: float, safety: float = 1.5) -> DataFrame:
    """(step, wedges, estimate_s, decision): wedges over a step's measured throughput, times a margin of safety; run, or skip above the limit."""
    estimate = F.col("wedges") * safety / F.col("wedges_per_s")
    got = rates.select("step", "wedges_per_s").crossJoin(wedges).withColumn("estimate_s", estimate)  # one row of wedges
    return got.select("step", "wedges", "estimate_s", F.when(F.col("estimate_s") <= limit_s, "run").otherwise("skip").alias("decision"))


def calibrate(spark: SparkSession, nodes: int = 2_000, edges: int = 40_000, seed: int = 1) -> DataFrame:
    """(step, wedges, seconds, wedges_per_s): the throughput of the wedge-bound steps here and now, on a random graph of the given size."""
    some = spark.range(nodes).select("id", F.col("id").alias("idx"))
    drawn = written(nulls.erdos_renyi(some, edges, seed).withColumn("weight", F.lit(1).cast("long")), "calibration")
    pairs = written(stats.undirected(drawn), "calibration")
    n = stats.wedges(pairs).first()["wedges"]
    rows = []
    for step, table in (("clustering", motifs.clustering(pairs, some)), ("triads", motifs.triad_census(drawn, some))):
        begin = time.monotonic()
        table.collect()  # one row, or sixteen
        took = time.monotonic() - begin
        rows.append((step, n, took, n / took))
    return spark.createDataFrame(rows, "step string, wedges long, seconds double, wedges_per_s double")
