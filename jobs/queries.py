"""The jobs as registered queries: each runs twice into one new folder and returns the whole output as it then stands."""

from __future__ import annotations

import uuid

from jobs import release, word_graph
from ripplegraph.plans.graph import COUNT_SQL, MEANS_SQL
from ripplegraph.session import scratch_dir


def job1_word_graph(spark, sf):
    """All documents through the stream; the second run finds nothing new."""
    folder = f"{scratch_dir(spark)}/job1_word_graph-{uuid.uuid4().hex}"
    for _ in range(2):
        word_graph.run(spark, f"{sf}/documents.parquet*", f"{folder}/rows", f"{folder}/checkpoint")
    return word_graph.rows(spark, f"{folder}/rows")


def job2_release(spark, sf):
    folder = f"{scratch_dir(spark)}/job2_release-{uuid.uuid4().hex}"
    for _ in range(2):
        release.run(spark, sf, folder)
    return release.edges(spark, folder)


QUERIES = {"job1_word_graph": job1_word_graph, "job2_release": job2_release}
SQL = {
    "job1_word_graph": r"""
WITH w AS (SELECT coalesce(lang, 'None') AS region, regexp_extract_all(lower(coalesce(text, '')), '\p{L}+') AS w FROM documents),
p AS (SELECT region, unnest(w[1:len(w) - 1]) AS src, unnest(w[2:]) AS dst FROM w WHERE len(w) > 1)
SELECT region, src, dst, count(*) AS weight FROM p GROUP BY ALL
""",
    "job2_release": f"WITH {MEANS_SQL}, {COUNT_SQL.removeprefix(COUNT_SQL[: COUNT_SQL.index('side_a AS')])} SELECT q.*, coalesce(home, 'None') AS home FROM q JOIN home ON src = id",
}
