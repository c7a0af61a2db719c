"""Deterministic draws: hashes that Spark and DuckDB compute alike, uniform on [0, 2^32)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform32(seed: int, *parts: Column) -> Column:
    text = F.concat_ws("-", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform32_of(seed: str, *parts: Column | str) -> Column:
    """The same, of a seed in a column; names are columns."""
    text = F.concat_ws("-", F.col(seed).cast("string"), *((F.col(p) if isinstance(p, str) else p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform32_sql(seed: int, *parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('-', {seed}, {', '.join(parts)})), 1, 8))::BIGINT"
