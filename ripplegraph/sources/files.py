"""Files: readers, digests, and sinks of records.

Readers return DataFrames; formats that Spark does not read itself go through binaryFile and an Arrow function, so
that any file system Spark knows will do.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _decoded(files: DataFrame, schema: T.StructType | str, read) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from read(content.as_py())

    return files.select("content").mapInArrow(run, schema)


def read_arrow(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Arrow IPC (Feather) files as a table of the given columns (a DDL schema), one task per file, batch by batch."""
    schema = T._parse_datatype_string(columns)
    target = pa.schema([(f.name, {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string()}[f.dataType.simpleString()]) for f in schema])

    def read(content: bytes) -> Iterator[pa.RecordBatch]:
        with pa.ipc.open_file(io.BytesIO(content)) as f:
            for i in range(f.num_record_batches):
                yield from pa.Table.from_batches([f.get_batch(i)]).select(target.names).cast(target).to_batches()

    return _decoded(spark.read.format("binaryFile").load(path), schema, read)


def read_npy(spark: SparkSession, path: str, name: str = "id") -> DataFrame:
    """One-dimensional integer arrays in .npy files."""

    def read(content: bytes) -> Iterator[pa.RecordBatch]:
        import numpy as np

        yield pa.record_batch([pa.array(np.load(io.BytesIO(content), allow_pickle=False).astype(np.int64))], [name])

    return _decoded(spark.read.format("binaryFile").load(path), f"{name} long", read)


def read_tsv(spark: SparkSession, path: str, numeric: tuple[str, ...] = (), ids: tuple[str, ...] = ()) -> DataFrame:
    """Tab-separated text with a header and no quoting; empty fields are null. Numeric columns become doubles (NaN: null), ids long."""
    from ..operators.ingest import numeric_text_id

    raw = spark.read.option("sep", "\t").option("quote", "").option("header", True).csv(path)

    def typed(c: str):
        if c in numeric:
            v = F.col(c).cast("double")
            return F.when(~F.isnan(v), v).alias(c)
        return (numeric_text_id(F.col(c)) if c in ids else F.col(c)).alias(c)

    return raw.select(*map(typed, raw.columns))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, md5, blob_sha1, sha256) of files; blob_sha1 is the SHA-1 of a header with the size, a zero byte and the content."""
    files = spark.read.format("binaryFile").load(path)
    blob = F.concat(F.encode(F.concat(F.lit("blob "), F.col("length").cast("string")), "UTF-8"), F.lit(bytearray(b"\0")), F.col("content"))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.md5("content").alias("md5"), F.sha1(blob).alias("blob_sha1"), F.sha2("content", 256).alias("sha256"))


def verified(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, problem): expected (name, size, md5, blob_sha1; null: not known) against digests; missing, size, md5 or blob_sha1."""
    e = expected.select("name", F.col("size").alias("want_size"), F.col("md5").alias("want_md5"), F.col("blob_sha1").alias("want_blob"))
    differs = lambda a, b: F.col(a).isNotNull() & ~F.col(a).eqNullSafe(F.col(b))
    problem = F.when(F.col("size").isNull(), "missing").when(differs("want_size", "size"), "size").when(differs("want_md5", "md5"), "md5").when(differs("want_blob", "blob_sha1"), "blob_sha1")
    return e.join(found, "name", "left").select("name", problem.alias("problem")).filter("problem IS NOT NULL")


def append_records(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_csv(tables: list[DataFrame], path: str) -> None:
    """Tables as one CSV file whose header is the union of their columns; a report's size, so one file."""
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t, allowMissingColumns=True)
    whole.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A report's table as Markdown; it shows the first rows of a table and says so if there are more."""
    rows = df.limit(limit + 1).collect()
    cell = lambda v: "" if v is None else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else f"{v:.4g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:limit]]
    return "\n".join(lines + ["", f"(the first {limit} rows)"] * (len(rows) > limit)) + "\n"


def environment(spark: SparkSession) -> DataFrame:
    """(name, value) that a run depends on: versions and settings."""
    import platform

    rows = {"spark": spark.version, "python": platform.python_version(), "machine": platform.machine(), "pyarrow": pa.__version__, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}
    return spark.createDataFrame(sorted(rows.items()), "name string, value string")


def parse_size(text: str) -> int:
    """Bytes of a size such as 8GB, 512 MiB or 100."""
    import re

    m = re.fullmatch(r"\s*([0-9.]+)\s*([kmgt]?)(i?)b?\s*", text.lower())
    if not m:
        raise ValueError(f"no size: {text}")
    return int(float(m[1]) * (1024 if m[3] or m[2] else 1) ** ("kmgt".index(m[2]) + 1 if m[2] else 0))


def format_size(n: float) -> str:
    """Bytes in the largest of four units of which there is one at least."""
    power = max(0, min(3, (int(n).bit_length() - 1) // 10))
    return f"{n / 1024**power:.4g} {('B', 'KiB', 'MiB', 'GiB')[power]}"
