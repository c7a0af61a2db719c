"""Keeps the graph of successive words of a growing corpus: nodes are words, an edge's weight says how often one follows the other.

python -m jobs.word_graph DOCUMENTS OUT CHECKPOINT [--config FILE]

DOCUMENTS are Parquet files (doc_id, text, lang) of a folder or a pattern. They are a file stream: each run takes the files
that no earlier run with this checkpoint took, and ends. A micro-batch of files becomes raw rows (batch, region, src,
dst, weight), one per pair of words and language, in a partition of OUT named by the batch's number. A batch that was
written but not committed comes again with the same number and files and overwrites its own partition, so a run
that was broken off at any place is repaired by the next. What was written before is neither read nor changed.

The graph is the sum over batches: rows() reads it back, edges() gives the library's simple graph.
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import config_of, defaults, log, log_to_stderr
from ripplegraph.operators import ingest
from ripplegraph.sources.adapters import MISSING_REGIONS

NAME = "word_graph"
READ = "doc_id BIGINT, text STRING, lang STRING"
WRITTEN = "src STRING, dst STRING, weight BIGINT, batch BIGINT, region STRING"
SHUFFLED = "spark.sql.shuffle.partitions"


def words(text: Column, letters_at_least: int = 1) -> Column:
    """The runs of letters of a text in lower case, in order; null and empty texts have none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), 0)
    return F.filter(found, lambda w: F.char_length(w) >= letters_at_least) if letters_at_least > 1 else found


def transitions(docs: DataFrame, letters_at_least: int = 1) -> DataFrame:
    """(region, src, dst, weight): how often a word follows another within a text, by language (missing: the missing region).

    Pairs are counted before they are shuffled, so frequent ones cost a row per task.
    """
    w = F.col("w")
    taken = docs.select(F.coalesce("lang", F.lit(MISSING_REGIONS[1])).alias("region"), words(F.col("text"), letters_at_least).alias("w")).filter(F.size("w") > 1)
    n = F.size(w) - 1
    pairs = taken.select("region", F.explode(F.arrays_zip(F.slice(w, F.lit(1), n).alias("src"), F.slice(w, F.lit(2), n).alias("dst"))).alias("p"))
    return pairs.groupBy("region", F.col("p.src").alias("src"), F.col("p.dst").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


def rows(spark: SparkSession, out: str, many: int = 500_000) -> DataFrame:
    """(region, src, dst, weight) summed over all batches in OUT.

    A pair is a row per batch, so sums within a scan would hold nearly all its rows; they go to tasks of about `many` rows first.
    """
    raw = spark.read.schema(WRITTEN).parquet(out)
    tasks = max(spark.sparkContext.defaultParallelism, -(-raw.count() // many))  # reads file footers only
    return raw.repartition(tasks, "region", "src", "dst").groupBy("region", "src", "dst").agg(F.sum("weight").alias("weight"))


def edges(spark: SparkSession, out: str, least: int = 1) -> DataFrame:
    """The library's simple graph over all languages: edges of at least this weight without self-loops."""
    return ingest.simple_graph(ingest.edges(rows(spark, out)), least)


def save(batch: DataFrame, number: int, out: str, config: dict) -> tuple[int, int]:
    """Writes one micro-batch into its own partition; returns the numbers of rows read and written.

    The number of tasks and files grows with the characters read, so that none holds more than some `characters_per_task` bring.
    """
    spark = batch.sparkSession
    size = batch.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("chars")).first()
    tasks = max(1, -(-size["chars"] // config["characters_per_task"]))
    parts = max(config["files_per_region"], -(-tasks // 2))
    usual = spark.conf.get(SHUFFLED)
    spark.conf.set(SHUFFLED, max(int(usual), tasks))
    try:
        texts = batch.repartition(tasks) if tasks > 1 else batch
        made = transitions(texts, config["letters_at_least"])
        spread = made.withColumn("batch", F.lit(number).cast("long")).withColumn("part", F.pmod(F.xxhash64("src", "dst"), F.lit(parts)))
        # A language is dealt over several tasks and files, as one of them may hold most rows.
        dealt = spread.repartition("region", "part").drop("part").select("src", "dst", "weight", "batch", "region")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "region").parquet(out)
    finally:
        spark.conf.set(SHUFFLED, usual)
    again = spark.read.schema(WRITTEN).parquet(out).filter(F.col("batch") == number)
    return size["n"], again.count()  # reads file footers only


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict | None = None) -> dict:
    """Takes all new files and returns what it did: batches, rows read, rows written."""
    config = defaults(NAME) | (config or {})
    done = {"batches": 0, "read": 0, "written": 0}

    def each(batch: DataFrame, number: int) -> None:
        read, made = save(batch, number, out, config)
        log(NAME).info("batch %d: read %d documents, wrote %d rows to %s/batch=%d", number, read, made, out, number)
        for key, n in (("batches", 1), ("read", read), ("written", made)):
            done[key] += n

    files = spark.readStream.schema(READ).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(documents)
    query = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    log(NAME).info("%s: %s", documents, ", ".join(f"{k} {n}" for k, n in done.items()) if done["batches"] else "nothing new")
    return done


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("documents")
    parser.add_argument("out")
    parser.add_argument("checkpoint")
    parser.add_argument("--config", help="a JSON file with settings that differ from jobs/word_graph.json")
    a = parser.parse_args(argv)
    log_to_stderr()
    spark = SparkSession.builder.appName(NAME).getOrCreate()
    try:
        run(spark, a.documents, a.out, a.checkpoint, config_of(spark, NAME, a.config))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
