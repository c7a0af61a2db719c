"""Connected components of an undirected edge table by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, written

#: Edges that are contracted at once within a task.
BUFFER = 200_000


def _stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Edges that connect what these edges connect: each node with the smallest one of its component."""
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(ids))
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = low < high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(label, high[open_], low[open_])
        while not (label[label] == label).all():
            label = label[label]
    leaf = np.flatnonzero(label < np.arange(len(ids)))
    return pa.record_batch([pa.array(ids[label[leaf]]), pa.array(ids[leaf])], ["u", "v"])


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    n = 0
    for batch in batches:
        held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]))
        n += batch.num_rows
        if n >= BUFFER:
            yield _stars(*np.concatenate(held, axis=1))
            held, n = [], 0
    if n:
        yield _stars(*np.concatenate(held, axis=1))


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (id, label) per node that has an edge to another node; label is the smallest id of its component.

    Every round replaces the edges of each task, in buffers of bounded size, by stars that connect the same nodes, hangs each
    node below its smallest neighbour, lets all pointers jump to the roots of the trees that this makes (the
    number of jumps is the logarithm of their depth), and contracts the trees. Null ends and self-loops are ignored. All state
    is in written tables; a hub's edges meet in partial aggregates only.
    """
    ship(edges.sparkSession)
    given = edges.select(F.least(a, b).cast("long").alias("u"), F.greatest(a, b).cast("long").alias("v"), F.col(a).isNull().alias("x"), F.col(b).isNull().alias("y")).filter("NOT x AND NOT y AND u < v")
    contract = lambda some: written(some.select("u", "v").mapInArrow(_contracted, "u long, v long").distinct(), "edges")
    current, labels = contract(given), None
    while not current.isEmpty():
        both = current.union(current.select("v", "u"))
        parents = written(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("label")), "parents")
        while True:
            above = parents.select(F.col("id").alias("label"), F.col("label").alias("root"))
            jumped = written(parents.join(above, "label").select("id", F.col("root").alias("label"), (F.col("root") != F.col("label")).alias("moved")), "parents")
            parents = jumped.select("id", "label")
            if jumped.filter("moved").isEmpty():
                break
        if labels is None:
            labels = parents
        else:
            step = parents.select(F.col("id").alias("label"), F.col("label").alias("next"))
            labels = written(labels.join(step, "label", "left").select("id", F.coalesce("next", "label").alias("label")), "labels")
        to = lambda c, out: parents.select(F.col("id").alias(c), F.col("label").alias(out))
        moved = current.join(to("u", "p"), "u").join(to("v", "q"), "v").select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v"))
        current = contract(moved.filter("u < v"))
    if labels is None:
        return current.select(F.col("u").alias("id"), F.col("v").alias("label"))
    return labels
