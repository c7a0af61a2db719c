"""python -m ripplegraph COMMAND DIR: datasets, ingest, verify, checks, analyze, node, sizes or a registered query on the tables of a folder."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .session import local_session, ship


def _tables(spark, folder: str) -> list[str]:
    """Paths of the Parquet tables of a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return [f"{folder}/{s.getPath().getName()}" for s in found if s.getPath().getName().endswith(".parquet")]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ripplegraph", description=__doc__)
    parser.add_argument("command", choices=["queries", "datasets", "ingest", "verify", "checks", "analyze", "node", "sizes", "query"])
    parser.add_argument("dir", nargs="?", default="/root/testdata/sf0.01")
    parser.add_argument("--name", help="of a query, for `query`")
    parser.add_argument("--out", help="folder of the store, for `ingest` and `verify`")
    parser.add_argument("--id", type=int, help="of a node, for `node`")
    parser.add_argument("--least", type=int, default=1, help="smallest weight of an edge")
    parser.add_argument("--top", type=int, default=5)
    parser.add_argument("--most-wedges", type=int, default=10**11, help="of a step of `analyze`; dearer ones are skipped and logged")
    parser.add_argument("--sources", type=int, default=0, help="sampled sources of path lengths, for `analyze`")
    a = parser.parse_args(argv)
    from . import plans
    from .analysis import Graph
    from .operators import checks, ingest, stats, warehouse
    from .plans import quality
    from .sources import adapters, files, store

    if a.command == "queries":
        print("\n".join(plans.queries()))
        return 0
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    rows, nodes = adapters.coorder_rows(spark, a.dir), adapters.part_nodes(spark, a.dir)
    if a.command == "ingest":
        known = ingest.known_rows(rows, nodes)
        raw = store.listing_of(spark, [f"{a.dir}/{t}.parquet" for t in ("lineitem", "supplier", "nation", "part")])
        print(store.write_store({"nodes": nodes, "edges": ingest.class_means(known), "observations": ingest.observations(rows, nodes)}, a.out, raw))
    elif a.command == "datasets":
        print(files.markdown(store.listing_of(spark, sorted(_tables(spark, a.dir)), content=False).groupBy(F.split("name", r"\.")[0].alias("table")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")).sort("table")))
    elif a.command == "verify":
        found = store.problems(spark, a.out)
        print(files.markdown(found))
        return int(not found.isEmpty())
    elif a.command == "checks":
        found = quality.checked(spark, a.dir)
        print(files.markdown(found))
        return int(checks.overall(found).first()["overall"] == "FAIL")
    elif a.command == "analyze":
        graph = Graph.from_rows(rows, nodes, a.least)
        chosen = nodes.orderBy(F.xxhash64("id")).limit(a.sources).select("id") if a.sources else None
        for name, table in graph.describe(chosen, a.most_wedges).items():
            print(f"## {name}\n\n{files.markdown(table)}")
        print("\n".join(": ".join(x) for x in graph.log))
    elif a.command == "node":
        graph = Graph.from_rows(rows, nodes, a.least)
        homes = ingest.home_region(ingest.region_counts(rows, "src"), ingest.region_counts(rows, "dst"), nodes)
        print(files.markdown(stats.lookup_node(graph.edges, nodes, homes, a.id, a.top)))
    elif a.command == "sizes":
        print(files.markdown(warehouse.representation_sizes(ingest.edges(ingest.known_rows(rows, nodes)), nodes)))
    else:
        print(files.markdown(plans.queries()[a.name](spark, a.dir)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
