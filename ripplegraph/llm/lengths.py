"""Exact histogram of encoded lengths with suffix sums.

Documents are aggregated by their number of tokens. From the suffix sums of this histogram any total follows
exactly: the tokens of all documents, what remains when texts are truncated at a context limit, how many texts
are cut, and every quantile. The histogram has one row per distinct length; its suffix sums are made in blocks of
lengths, so no task holds more than a block or the list of blocks.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from .common import table, text_or_empty

BLOCK = 1024
#: The encoder's matcher keeps a state for each white-space character of a run and gives up at a million of them.
LONG_RUN = 10_000
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LONG_RUN = re.compile(rf"(?<!{_SPACE}){_SPACE}{{{LONG_RUN},}}")  # only from the start of a run, so that shorter ones are read once


@lru_cache(2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("lengths", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def n_tokens(encoding, text: str) -> int:
    """Tokens of a text under a pattern with the alternatives \\s+(?!\\S) and \\s+ for runs of white space.

    There a run of two or more is a piece of its own, but for its last character where something else follows. So the text
    is cut around very long runs, and these are encoded as the pieces that they are.
    """
    total = at = 0
    if len(text) >= LONG_RUN:
        for m in _LONG_RUN.finditer(text):
            end = m.end() - (m.end() < len(text))
            total += len(encoding.encode_ordinary(text[at : m.start()])) + len(encoding._encode_single_piece(text[m.start() : end]))
            at = end
    return total + len(encoding.encode_ordinary(text[at:] if at else text))


def counter(spark: SparkSession, ranks_path: str, pattern: str):
    """A function of a text column: its number of tokens under a file of byte-pair ranks. Null counts as empty, 0.

    The pattern must end in \\s+(?!\\S)|\\s+, as those of the public byte-pair files do (see n_tokens).
    """
    if not pattern.endswith(r"|\s+(?!\S)|\s+"):
        raise ValueError("a pattern that treats white space in another way")
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        encoding = _encoding(ranks.value, pattern)
        return pa.array(np.fromiter((n_tokens(encoding, t.as_py() or "") for t in texts), np.int64, len(texts)))

    return count


def histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """One row per distinct length, with suffix sums.

    Columns: n_tokens; n_docs with that length; docs_at_least and tokens_at_least, over this and all greater lengths;
    truncated_total, the tokens that remain when every text is cut to n_tokens; share_shorter_or_equal. Null
    lengths are left out; an empty table gives no rows.
    """
    n = F.col("n_tokens")
    counted = lengths.select(F.col(column).cast("long").alias("n_tokens")).filter(n.isNotNull()).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    counted = written(counted.withColumn("block", F.floor(n / BLOCK).cast("long")), "histogram")
    within = W.partitionBy("block").orderBy(n.desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    above = W.orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1)
    blocks = counted.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(n * F.col("n_docs")).alias("tokens"))
    blocks = blocks.select("block", F.coalesce(F.sum("docs").over(above), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("tokens").over(above), F.lit(0)).alias("tokens_above"), F.sum("docs").over(W.partitionBy(F.lit(0))).alias("all_docs"), F.sum("tokens").over(W.partitionBy(F.lit(0))).alias("all_tokens"))
    out = counted.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(within) + F.col("docs_above")).alias("docs_at_least"),
        (F.sum(n * F.col("n_docs")).over(within) + F.col("tokens_above")).alias("tokens_at_least"),
        "all_docs",
        "all_tokens",
    )
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + n * F.col("docs_at_least")).alias("truncated_total"),
        (1 - (F.col("docs_at_least") - F.col("n_docs")) / F.col("all_docs")).alias("share_shorter_or_equal"),
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: texts longer than it, and the tokens that remain when texts are cut to it."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in sorted(set(limits))], "context_limit long")
    pairs = asked.join(F.broadcast(sums.agg(F.max("tokens_at_least").alias("total")))).join(sums, F.col("n_tokens") > F.col("context_limit"), "left")
    first = F.min(F.struct("n_tokens", "docs_at_least", "tokens_at_least")).alias("next")
    got = pairs.groupBy("context_limit", "total").agg(first)
    longer = F.coalesce(F.col("next.docs_at_least"), F.lit(0))
    return got.select("context_limit", longer.alias("longer_docs"), (F.col("total") - F.coalesce(F.col("next.tokens_at_least"), F.lit(0)) + F.col("context_limit") * longer).alias("truncated_total"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """For each share q: the smallest length that at least q of all texts do not exceed."""
    asked = sums.sparkSession.createDataFrame([(float(x),) for x in sorted(set(shares))], "q double")
    return asked.join(sums, F.col("share_shorter_or_equal") >= F.col("q") - 1e-12, "left").groupBy("q").agg(F.min("n_tokens").alias("n_tokens"))


def op9_token_lengths(spark: SparkSession, sf_dir: str, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    if ranks_path is None:
        import public_tokenizers

        ranks_path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    count = counter(spark, ranks_path, pattern)
    return histogram(table(spark, sf_dir, "documents").select(count(text_or_empty()).alias("n_tokens")))
