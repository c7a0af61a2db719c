"""Secret scanning with multipart credential linking, in DataFrame functions only.

Base spans (assign, access, hex) are found in the whole text and always reported. Parts of credentials that are weak
evidence alone (an account name or client id, a short or loosely named secret, an endpoint) are reported only when
complementary parts co-occur within a scope of SCOPE code points: an identifier or an endpoint needs a secret, a weak
secret needs an identifier or an endpoint.

One scan records, for every pattern, the lengths of the pieces between matches and of the matches. Their running
sums are the positions. The interval join of parts with their complements is a sweep: ordered by position, each
part meets the nearest complement before and after it, so a text with many parts never makes all pairs. Only texts
with any match are dealt out, by row and without their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from .common import table, text_or_empty

SCOPE = 200


def either_case(words: str) -> str:
    """A pattern for some words (separated by |) with each letter in either case."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() and c.isascii() else c for c in words)


_IS = r"""["']?\x20*[:=]\x20*["']?"""
PATTERNS = {  # kind: pattern, whose group 1 is the value where there is one
    "assign": f"(?:{either_case('password|passwd|secret|token|api_?key')}){_IS}([A-Za-z0-9+/_.=-]+)",
    "access": "(AKIA[A-Z0-9]+)",
    "hex": "([0-9a-f]{32,})",
    "identifier": f"(?:{either_case('client_?id|access_?key_?id|user_?name|user|login|account|tenant|app_?id')}){_IS}([A-Za-z0-9@._-]{{3,}})",
    "weak_secret": f"(?:{either_case('pass|pwd|private_?key|auth|credential|signature|bearer')}){_IS}([A-Za-z0-9+/_.=-]{{4,}})",
    # No group is repeated (the matcher would take a stack frame a time), and what stands before the colon is of bounded length.
    "endpoint": r"""([a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]+|[a-z0-9-]{1,63}\.[a-z0-9.-]{0,252}[a-z0-9-]:[0-9]{2,5})""",
}
#: Only texts that hold one of these are searched for the pattern; each is part of every match.
NEEDED = {"assign": None, "access": "AKIA", "hex": None, "identifier": None, "weak_secret": None, "endpoint": ":"}
KINDS = tuple(PATTERNS)
BASE = KINDS[:3]
#: What a match must have: code points of the whole match or of the value.
LEAST = {"assign": ("value", 8), "access": ("size", 16), "hex": ("size", 32)}


def _lengths(array):
    return F.transform(array, lambda s: F.length(s))


def _measured(kind: str):
    """The lengths of the pieces and matches of a pattern in the column text; null where there is no match."""
    text, pattern = F.col("text"), F.lit(PATTERNS[kind])
    parts = F.struct(
        F.lit(KINDS.index(kind)).alias("kind"),
        _lengths(F.split(text, PATTERNS[kind], -1)).alias("before"),
        _lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("size"),
        _lengths(F.regexp_extract_all(text, pattern, F.lit(1))).alias("value"),
    )
    there = text.rlike(PATTERNS[kind])
    if NEEDED[kind]:
        there = text.contains(NEEDED[kind]) & there
    return F.when(there, parts)


def _parts(found: DataFrame) -> DataFrame:
    """One row per match: row_key, kind, start, end (code points, end exclusive), value (its length)."""
    kinds = found.select("row_key", F.explode("found").alias("f")).select("row_key", "f.kind", F.arrays_zip("f.before", "f.size", "f.value").alias("z"))
    each = kinds.select("row_key", "kind", F.posexplode("z").alias("i", "m")).select("row_key", "kind", "i", "m.before", "m.size", "m.value").filter("size IS NOT NULL")
    upto = W.partitionBy("row_key", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("before") + F.col("size")).over(upto)
    return each.repartition("row_key").select("row_key", "kind", (end - F.col("size")).alias("start"), end.alias("end"), "size", "value")


def _linked(parts: DataFrame) -> DataFrame:
    """Base spans, and weak ones that have their complement in scope: row_key, kind, start, end."""
    at = {k: i for i, k in enumerate(KINDS)}
    kind = F.col("kind")
    least = F.lit(True)
    for k, (what, n) in LEAST.items():
        least = F.when(kind == at[k], F.col(what) >= n).otherwise(least)
    # A value assigned to a secret's name that is too short for the base is a weak secret.
    short = (kind == at["assign"]) & ~least & (F.col("value") >= 4)
    parts = parts.withColumn("kind", F.when(short, at["weak_secret"]).otherwise(kind)).filter(least | short)
    base = kind < len(BASE)
    order = W.partitionBy("row_key").orderBy("start", "kind", "end")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    covered = (F.coalesce(F.max(F.when(base, F.col("end"))).over(before), F.lit(0)) > F.col("start")) | (F.coalesce(F.min(F.when(base, F.col("start"))).over(after), F.col("end")) < F.col("end"))
    parts = parts.withColumn("covered", covered).filter(base | ~F.col("covered"))
    sides = {"i": kind.isin(at["identifier"], at["access"]), "s": kind.isin(at["assign"], at["hex"], at["weak_secret"]), "e": kind == at["endpoint"]}

    def near(side: str):
        last = F.max(F.when(sides[side], F.col("end"))).over(before)
        first = F.min(F.when(sides[side], F.col("start"))).over(after)
        return F.coalesce(last >= F.col("start") - SCOPE, F.lit(False)) | F.coalesce(first <= F.col("end") + SCOPE, F.lit(False))

    joined = parts.select("row_key", "kind", "start", "end", near("i").alias("near_i"), near("s").alias("near_s"), near("e").alias("near_e"))
    return joined.filter((kind < len(BASE)) | F.when(kind == at["weak_secret"], F.col("near_i") | F.col("near_e")).otherwise(F.col("near_s"))).select("row_key", "kind", "start", "end")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, and spans, an array of (start, kind_index, end, kind) ordered by start, then kind.

    Null texts count as empty and have no spans. Rows with equal ids are scanned apart.
    """
    work = docs.select(F.col(id_col), F.monotonically_increasing_id().alias("row_key"), text_or_empty(text_col).alias("text"))
    found = written(work.select(id_col, "row_key", F.array_compact(F.array(*map(_measured, KINDS))).alias("found")), "matches")
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    spans = _linked(_parts(found.filter(F.size("found") > 0))).select("row_key", F.struct("start", F.col("kind").alias("kind_index"), "end", name.alias("kind")).alias("s"))
    whole = spans.groupBy("row_key").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    empty = F.array().cast(whole.schema["spans"].dataType)
    with_any = found.filter(F.size("found") > 0).select(id_col, "row_key").join(whole, "row_key", "left").select(id_col, F.coalesce("spans", empty).alias("spans"))
    return found.filter(F.size("found") == 0).select(id_col, empty.alias("spans")).unionByName(with_any)


def _count(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind_index"] < len(BASE))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *(_count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
hit AS (
{' UNION ALL '.join(f"SELECT r, {i} AS kind, regexp_split_to_array(text, {_quoted(p)}) AS b, regexp_extract_all(text, {_quoted(p)}, 0) AS m, regexp_extract_all(text, {_quoted(p)}, 1) AS v FROM d WHERE regexp_matches(text, {_quoted(p)})" for i, p in enumerate(PATTERNS.values()))}
),
each AS (SELECT r, kind, b, m, v, unnest(range(1, len(m) + 1)) AS i FROM hit),
pos AS (
  SELECT r, kind, length(m[i]) AS size, length(v[i]) AS value,
         sum(length(b[i]) + length(m[i])) OVER (PARTITION BY r, kind ORDER BY i) AS e
  FROM each
),
kept AS (
  SELECT r, CASE WHEN kind = 0 AND value < 8 THEN 4 ELSE kind END AS kind, e - size AS s, e FROM pos
  WHERE CASE kind WHEN 0 THEN value >= 4 WHEN 1 THEN size >= 16 WHEN 2 THEN size >= 32 ELSE true END
),
-- the interval join, literally: base spans that overlap a weak part, and complements within the scope
free AS (
  SELECT k.* FROM kept k
  WHERE k.kind < 3 OR NOT EXISTS (SELECT 1 FROM kept b WHERE b.r = k.r AND b.kind < 3 AND b.s < k.e AND b.e > k.s)
),
span AS (
  SELECT k.* FROM free k
  WHERE k.kind < 3 OR EXISTS (
    SELECT 1 FROM free c
    WHERE c.r = k.r AND (c.s, c.kind, c.e) <> (k.s, k.kind, k.e)
      AND CASE WHEN k.kind = 4 THEN c.kind IN (1, 3, 5) ELSE c.kind IN (0, 2, 4) END
      AND ((c.e >= k.s - {SCOPE} AND c.s <= k.s) OR (c.s <= k.e + {SCOPE} AND c.s >= k.s)))
),
named AS (SELECT r, kind, s, ['{"', '".join(KINDS)}'][kind + 1] || ':' || s || ':' || e AS t FROM span),
agg AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(t, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(t, ',' ORDER BY s, kind) AS spans
  FROM named GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN agg USING (r)
"""
