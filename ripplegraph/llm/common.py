"""Shared pieces of the corpus operators: table access, batches of bounded size, vectorised word hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Code points that one numpy pass holds at most, but for a single longer text.
CHUNK_CHARS = 400_000


#: Rows and bytes that a Python worker receives at once, but for a single longer row; a batch is held several times over.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Rows of a batch of the Parquet reader; whole texts are long, and a vector of them is one array.
SCAN_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Session settings that the operators' Python workers need: where the package is, and small batches."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", SCAN_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_hash(df: DataFrame):
    """A hash of all columns, but for those with maps, which have no order."""
    names = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*(F.col(f"`{n.replace('`', '``')}`") for n in names)) if names else F.lit(0).cast("long")


def remainder(doc_id, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Consecutive slices whose texts together stay under the limit (a longer text stands alone)."""
    begin = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield texts[begin:i]
            begin, total = i, 0
        total += len(t)
    if begin < len(texts):
        yield texts[begin:]


def code_points(texts: list[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array, each after one line feed, and a last line feed; and the position of each text's line feed."""
    joined = "\n" + "\n".join(texts) + "\n"
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if lower:
        low = joined.lower()
        if len(low) != len(joined):  # a letter whose lower case has two code points
            parts = [t.lower() for t in texts]
            low, sizes = "\n" + "\n".join(parts) + "\n", np.fromiter(map(len, parts), np.int64, len(parts))
        joined = low
    starts = np.zeros(len(texts), np.int64)
    np.cumsum(sizes[:-1] + 1, out=starts[1:])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), starts


@cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)


@cache
def digits() -> np.ndarray:
    return np.fromiter((chr(i).isdecimal() for i in range(0x110000)), np.bool_, 0x110000)


@cache
def spaces() -> np.ndarray:
    return np.fromiter((chr(i).isspace() for i in range(0x110000)), np.bool_, 0x110000)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x100000001B3)


@cache
def _powers(size: int) -> np.ndarray:
    out = np.full(size, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true values; the first and last value must be false."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edge[::2], edge[1::2]


def run_hashes(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the code points of each run (polynomial modulo 2^64, then scrambled)."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    length = end - begin
    total = np.concatenate(([0], np.cumsum(length)))
    within = np.arange(total[-1]) - np.repeat(total[:-1], length)
    values = codes[within + np.repeat(begin, length)].astype(np.uint64) + np.uint64(1)
    size = 1 << int(length.max() - 1).bit_length()
    values *= _powers(max(size, 64))[within]
    return mix(np.add.reduceat(values, total[:-1]))


def owner(begin: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The index of the text that each position belongs to."""
    return np.searchsorted(starts, begin, side="right") - 1
