"""The jobs: growing input in two runs, broken-off runs, reruns, gates, command lines. All on copies."""

import json
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import common, release, word_graph
from jobs.queries import job1_word_graph
from ripplegraph.operators import ingest
from ripplegraph.sources import adapters

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


def brute(rows):
    out = Counter()
    for _, text, lang in rows:
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        out.update((lang or "None", a, b) for a, b in zip(words, words[1:]))
    return {(*k, n) for k, n in out.items()}


def graph_rows(spark, out):
    return {(r["region"], r["src"], r["dst"], r["weight"]) for r in word_graph.rows(spark, out).collect()}


@pytest.fixture
def corpus(spark, tmp_path):
    """Adds files of documents to a folder, as a loader would."""

    class Corpus:
        path, out, checkpoint, rows = str(tmp_path / "documents"), str(tmp_path / "rows"), str(tmp_path / "checkpoint"), []

        def add(self, rows):
            self.rows = self.rows + rows
            spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, region string").coalesce(1).write.mode("append").parquet(self.path)

        def run(self, **config):
            return word_graph.run(spark, self.path, self.out, self.checkpoint, config)

    return Corpus()


FIRST = [(1, "The cat sat. The cat ran", "en"), (2, None, "en"), (3, "", None), (4, "alone", "en"), (5, "Über die  Brücke, über die", "de"), (5, "the cat", None)]
SECOND = [(6, "the cat the cat\nthe cat", "en"), (1, "The cat sat. The cat ran", "en"), (7, "la vie", "fr")]


def test_second_run_takes_only_new_files(spark, corpus):
    corpus.add(FIRST)
    assert corpus.run() == {"batches": 1, "read": 6, "written": len(brute(FIRST))}
    assert graph_rows(spark, corpus.out) == brute(FIRST)
    before = {p: p.stat().st_mtime_ns for p in Path(corpus.out).rglob("*.parquet")}
    corpus.add(SECOND)
    assert corpus.run() == {"batches": 1, "read": 3, "written": len(brute(SECOND))}
    assert graph_rows(spark, corpus.out) == brute(FIRST + SECOND)
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    assert corpus.run() == {"batches": 0, "read": 0, "written": 0}
    assert graph_rows(spark, corpus.out) == brute(FIRST + SECOND)


def test_several_batches_and_edges(spark, corpus):
    for row in FIRST + SECOND:
        corpus.add([row])
    assert corpus.run(files_per_batch=2)["batches"] == 5
    assert graph_rows(spark, corpus.out) == brute(FIRST + SECOND)
    got = {(r["src"], r["dst"], r["weight"]) for r in word_graph.edges(spark, corpus.out, 3).collect()}
    assert got == {("the", "cat", 8)}
    assert {p.name for p in Path(corpus.out).glob("batch=*")} <= {f"batch={i}" for i in range(5)}


def test_broken_off_run_is_repaired(spark, corpus, monkeypatch):
    """A batch that was written but not committed comes again and replaces its partition."""
    corpus.add(FIRST)
    corpus.run()
    corpus.add(SECOND)
    real = word_graph.save

    def breaks(*a):
        real(*a)
        raise RuntimeError("power cut")

    monkeypatch.setattr(word_graph, "save", breaks)
    with pytest.raises(Exception, match="power cut"):
        corpus.run()
    monkeypatch.undo()
    assert corpus.run()["read"] == 3
    assert graph_rows(spark, corpus.out) == brute(FIRST + SECOND)


def test_query_over_the_given_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    assert {(r["region"], r["src"], r["dst"], r["weight"]) for r in job1_word_graph(spark, SF).collect()} == brute(docs)


def test_config(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"letters_at_least": 4}))
    assert common.config_of(spark, "word_graph", str(tmp_path / "c.json")) == common.defaults("word_graph") | {"letters_at_least": 4}
    (tmp_path / "c.json").write_text('{"letter": 4}')
    with pytest.raises(ValueError, match="letter"):
        common.config_of(spark, "word_graph", str(tmp_path / "c.json"))


def all_rows(df):
    return sorted(map(tuple, df.collect()))


def test_release_is_the_same_after_a_second_run(spark, tmp_path):
    out = str(tmp_path / "release")
    first = release.run(spark, SF, out)
    edges, nodes = all_rows(release.edges(spark, out)), all_rows(release.nodes(spark, out))
    assert release.run(spark, SF, out) == first and first["status"] == "PASS"
    assert all_rows(release.edges(spark, out)) == edges and all_rows(release.nodes(spark, out)) == nodes
    assert (first["edges"], first["nodes"]) == (len(edges), len(nodes)) and first["read"] > first["kept"] > first["edges"] > 0
    means = ingest.class_means(ingest.known_rows(adapters.coorder_rows(spark, SF), adapters.part_nodes(spark, SF)))
    assert all_rows(release.edges(spark, out).drop("home").select(means.columns)) == all_rows(means)
    assert len(list(Path(out, "edges").glob("home=*"))) > 5


def test_release_with_a_failed_check_is_not_published(spark, tmp_path):
    out = str(tmp_path / "release")
    release.run(spark, SF, out)
    edges = all_rows(release.edges(spark, out))
    bad = {"expected": {"B1": 1}}
    with pytest.raises(release.ChecksFailed, match="B1"):
        release.run(spark, SF, out, bad)
    assert all_rows(release.edges(spark, out)) == edges
    assert [r["status"] for r in spark.read.json(f"{out}/checks").filter("id = 'B1'").collect()] == ["FAIL"]
    assert release.run(spark, SF, out, bad | {"publish_on_fail": True})["status"] == "FAIL"


def test_command_lines(spark, tmp_path):
    spark.createDataFrame(FIRST, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "d"))
    (tmp_path / "c.json").write_text('{"files_per_batch": 1}')
    call = lambda *a: subprocess.run([sys.executable, "-m", *a], cwd=ROOT, capture_output=True, text=True, timeout=300)
    done = call("jobs.word_graph", str(tmp_path / "d"), str(tmp_path / "o"), str(tmp_path / "k"), "--config", str(tmp_path / "c.json"))
    assert done.returncode == 0 and "read 6" in done.stderr, done.stderr[-2000:]
    assert graph_rows(spark, str(tmp_path / "o")) == brute(FIRST)
    (tmp_path / "r.json").write_text('{"expected": {"B1": 1}}')
    done = call("jobs.release", SF, str(tmp_path / "r"), "--config", str(tmp_path / "r.json"))
    assert done.returncode == 1 and "not published, failed: B1" in done.stderr, done.stderr[-2000:]


def test_tasks_of_a_batch_grow_with_its_text(spark, corpus, monkeypatch):
    """However much one file holds: before, a split of a file was counted in one task, and what was written was summed by split, too."""
    docs = [(i, " ".join(f"w{chr(97 + i % 26)}{chr(97 + k)}" for k in range(20)), "en") for i in range(80)]
    corpus.add(docs)
    seen, real = [], word_graph.transitions

    def watched(texts, letters):
        seen.append((texts.rdd.getNumPartitions(), int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        return real(texts, letters)

    monkeypatch.setattr(word_graph, "transitions", watched)
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    corpus.run(characters_per_task=200)
    assert min(seen[0]) >= 30 and spark.conf.get("spark.sql.shuffle.partitions") == usual
    assert graph_rows(spark, corpus.out) == brute(docs)
    spread = word_graph.rows(spark, corpus.out, 20)
    assert {(r["region"], r["src"], r["dst"], r["weight"]) for r in spread.collect()} == brute(docs)
    assert max(r["n"] for r in spread.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()) < 60
