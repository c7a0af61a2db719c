"""Exact duplicate removal with a two-pass Bloom filter.

Pass one builds, for every partition, which positions of a bit table its row hashes set once and which more than
once, and merges these tables. Pass two looks every row up: where all positions of its hash were set at least
twice the text may be repeated, and only such rows are shuffled and compared by their full SHA-256. All other rows
are certainly unique and pass straight through.

The table has BITS_PER_ROW bits a row, between MIN_BITS and MAX_BITS, so the driver and the broadcast hold at most
MAX_BITS / 8 bytes (32 MB). With more than MAX_BITS / BITS_PER_ROW rows the share of rows that are shuffled
needlessly grows, towards all rows; the result is exact at every size, and what is shuffled is the digest and
the row's key only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .common import row_hash, table, text_or_empty

BITS_PER_ROW, MIN_BITS, MAX_BITS = 16, 1 << 16, 1 << 28
SHARD = 1 << 16  #: bits in a shard; positions in it fit 16 bits
DENSE = SHARD // 16  #: from so many positions on, a shard travels as a bit map
HELD = 1 << 20  #: hashes that a task puts into one local table

_PART = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("once", T.BinaryType()), T.StructField("more", T.BinaryType())])


def normalised(column: str = "text"):
    """The text with each run of ASCII white space as one space; null is the empty text."""
    return F.regexp_replace(text_or_empty(column), r"[\x20\x09-\x0D]+", " ")


def table_bits(rows: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << max(0, rows * BITS_PER_ROW - 1).bit_length()))


def positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each 64-bit hash, from different halves of it."""
    h = hashes.astype(np.int64).view(np.uint64)
    mask = np.uint64(bits - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def _packed(offsets: np.ndarray) -> bytes:
    if len(offsets) < DENSE:
        return offsets.astype("<u2").tobytes()
    full = np.zeros(SHARD, np.bool_)
    full[offsets] = True
    return np.packbits(full).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    full = np.zeros(SHARD, np.bool_)
    if len(data) == SHARD // 8:
        full[:] = np.unpackbits(np.frombuffer(data, np.uint8)).view(np.bool_)
    else:
        full[np.frombuffer(data, "<u2")] = True
    return full


def _local_tables(bits: int):
    def give(held: list[np.ndarray]) -> pa.RecordBatch:
        a, b = positions(np.concatenate(held), bits)
        both = np.sort(np.concatenate([a, b[b != a]]))
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        place, count = both[first], np.diff(np.append(first, len(both)))
        shard = place // SHARD
        cuts = np.flatnonzero(np.diff(shard)) + 1
        low = (place % SHARD).astype(np.uint16)
        once = [_packed(p) for p in np.split(low, cuts)]
        more = [_packed(p[n > 1]) for p, n in zip(np.split(low, cuts), np.split(count, cuts))]
        return pa.record_batch([pa.array(shard[np.append(0, cuts)], pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["shard", "once", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            n += batch.num_rows
            if n >= HELD:
                yield give(held)
                held, n = [], 0
        if n:
            yield give(held)

    return run


def _merged_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            once, more = held.setdefault(row["shard"], (np.zeros(SHARD, np.bool_), np.zeros(SHARD, np.bool_)))
            new = _unpacked(row["once"])
            more |= (once & new) | _unpacked(row["more"])
            once |= new
    for shard, (_, more) in held.items():
        yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([b""], pa.binary()), pa.array([np.packbits(more).tobytes()], pa.binary())], ["shard", "once", "more"])


def repeat_test(hashes: DataFrame, rows: int):
    """A test of numpy arrays of 64-bit hashes in tasks: false only for hashes that occur once in the one column of `hashes`."""
    bits = table_bits(rows)
    shards = bits // SHARD
    parts = hashes.mapInArrow(_local_tables(bits), _PART)
    merged = parts.repartition(min(shards, 256), "shard").mapInArrow(_merged_tables, _PART).select("shard", "more")
    repeated = np.zeros((shards, SHARD // 8), np.uint8)
    for shard, more in zip(*(c.to_pylist() for c in merged.toArrow().columns)):
        repeated[shard] = np.frombuffer(more, np.uint8)
    shared = hashes.sparkSession.sparkContext.broadcast(repeated.tobytes())

    def maybe_repeated(h: np.ndarray) -> np.ndarray:
        bit = np.frombuffer(shared.value, np.uint8)
        hit = np.ones(len(h), np.bool_)
        for p in positions(h, bits):
            hit &= (bit[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
        return hit

    return maybe_repeated


def repeat_filter(hashes: DataFrame, rows: int):
    """The same as a predicate on a 64-bit hash column."""
    test = repeat_test(hashes, rows)

    @F.arrow_udf("boolean")
    def maybe_repeated(h: pa.Array) -> pa.Array:
        return pa.array(test(h.to_numpy(zero_copy_only=False)))

    return maybe_repeated


def assign_groups(keys: DataFrame, rows: int, id_col: str = "doc_id") -> DataFrame:
    """Group membership of a materialised table (id, digest, row_key): adds keep_id, group_size and kept.

    Exactly one row of each group is kept: that with the smallest id (a null id is the largest), of equal ids
    that with the smallest row_key. The keys of a group meet in one partial aggregate, never as a list of rows.
    """
    h = F.xxhash64("digest")
    flag = repeat_filter(keys.select(h.alias("h")), rows)
    order = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("row_key").alias("key"))
    flagged = keys.withColumn("again", flag(h))
    lone = flagged.filter(~F.col("again")).select(id_col, "digest", "row_key", F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    again = flagged.filter("again").drop("again")
    # Written, so that the join's two sides are exchanges of their own and a hot group can be split.
    groups = written(again.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size")), "groups")
    met = again.join(groups, "digest").select(id_col, "digest", "row_key", F.col("first.id").alias("keep_id"), "group_size", (F.col("row_key") == F.col("first.key")).alias("kept"))
    return lone.unionByName(met)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after normalised(). Null texts are empty texts and equal each other.
    Of repeated rows with the same id exactly one is kept. An empty table gives an empty result.
    """
    keys = written(docs.select(F.col(id_col), F.unhex(F.sha2(normalised(text_col), 256)).alias("digest"), F.monotonically_increasing_id().alias("row_key")), "digests")
    out = assign_groups(keys, keys.count(), id_col)
    return out.select(id_col, "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without all but the first row of each text, with the columns of docs.

    The first row has the smallest id (a null id is the largest); of equal ids, the smallest hash of all its columns.
    Rows that the filter shows to be unique keep their place; only possibly repeated rows are shuffled.
    """
    work = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), row_hash(docs).alias("tie"), F.unhex(F.sha2(normalised(text_col), 256)).alias("digest"))
    keys = written(work.select("id", "tie", "digest"), "digests")
    flag = repeat_filter(keys.select(F.xxhash64("digest").alias("h")), keys.count())
    tested = work.withColumn("again", flag(F.xxhash64("digest")))
    order = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("tie").alias("tie"))
    groups = written(keys.filter(flag(F.xxhash64("digest"))).groupBy("digest").agg(F.min(order).alias("first")), "groups")
    again = tested.filter("again").join(groups, "digest").filter(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("tie") == F.col("first.tie")))
    # Rows that agree in text, id and hash are the same row several times.
    one = again.select("row", "digest").dropDuplicates(["digest"])
    return tested.filter(~F.col("again")).select("row.*").unionByName(one.select("row.*"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
