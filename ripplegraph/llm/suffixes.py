"""Removal of long repeated byte strings by merging the Burrows-Wheeler transforms of shards.

A full transform of all bytes would need a refinement for each of `length` symbols of every suffix. So the transforms
are sampled: of the starts of strings of `length` bytes, those with the same anchor (the leftmost minimum of a hash of
short grams among the next WINDOW positions) are one group, and only suffixes that begin at anchors are sorted. An
anchor depends on nothing but the string, so equal strings have it at the same distance d, and both hold the CORE
bytes from it on, and d bytes before it.

1. Groups whose core occurs once drop out (Bloom filter as in exact dedup, then exact counts of 128-bit hashes).
2. Groups whose outer text, from the first start to the end of the last string, occurs again are repeated as a whole.
3. The others, and one group of each repeated outer text with the same core, are merged. Each shard (a stretch of texts
   in a task) sorts its own suffixes and hands them on in that order with the text before each anchor, which is the
   transform's column. The interleave of the shards starts with all suffixes of a core as one block, and each round
   refines the blocks by the next symbol (eight bytes); where a block breaks, the common prefix is known; a suffix alone
   in its block is done. The same on the columns, read backwards, gives the common left contexts. For each distance d
   the repeated intervals are the blocks of WINDOW - 1 - d further symbols; within them, members with a common left
   context of d bytes are equal strings.

A core with more than FAMILY different groups is not merged in one task: its distances are halved, which fixes more
context on either side, until a part is small enough or one distance is left, where equal strings are only counted.
Nothing is capped. The filter has at most 2^28 bits; far above 17 million groups it lets more groups through to the
exact counts, of a few bytes a group. Hashes of 128 bits stand for cores and outer texts; the rest is compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .common import mix, prepare, table, text_or_empty
from .dedup import repeat_test

LENGTH = 400
#: Bytes that are parsed at once; groups of a core, and groups of all cores, that a task merges at once.
CHUNK, FAMILY, MERGED = 1 << 19, 20_000, 40_000
#: Bytes of a text within which its spans are united at once.
BLOCK = 1 << 16

_LOW = np.uint64(0xFFFFFFFF)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@cache
def _bytes(seed: int) -> np.ndarray:
    """A random odd 64-bit number for each byte."""
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def widths(length: int) -> tuple[int, int]:
    """Positions among which an anchor is chosen, and bytes of the grams; both together fit into `length`."""
    return min(128, max(1, length // 3)), min(16, max(1, length // 4))


class _Prefix:
    """Hashes of substrings from sums over prefixes, modulo 2^64."""

    def __init__(self, data: np.ndarray, which: int):
        size = 1 << len(data).bit_length()
        self.inverse = _powers(pow(_BASES[which], -1, 1 << 64), size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_bytes(which + 1)[data] * _powers(_BASES[which], size)[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.inverse[begin]).view(np.int64)


def groups(data: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, last start and anchor of each group of the texts data[begin:end]."""
    window, gram = widths(length)
    h, size = _bytes(0)[data], 1
    while size < gram:
        step = min(size, gram - size)
        h = h[:-step] * np.uint64(_BASES[0]) + h[step:]
        size += step
    low = (mix(h) & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size < window:
        step = min(size, window - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    anchor = (low & _LOW).astype(np.int64)
    last = end - length
    has = last >= begin
    begin, last = begin[has], last[has]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[begin] += 1
    inside[last + 1] -= 1
    new = np.cumsum(inside, dtype=np.int8)[: len(anchor)].astype(np.bool_)
    new[1:] &= anchor[1:] != anchor[:-1]
    new[begin] = True
    first = np.flatnonzero(new)
    text = np.searchsorted(begin, first, "right") - 1
    return first, np.minimum(np.append(first[1:], len(data)) - 1, last[text]), anchor[first]


def _stretches(batches: Iterator[pa.RecordBatch], length: int):
    """Chunks of texts (key, text) of bounded size: bytes, starts, ends, keys, and each piece's offset in its text.

    A longer text comes in pieces that share no start of a string.
    """
    held: list[tuple[bytes, int, bytes]] = []
    size = 0

    def chunk():
        end = np.cumsum([len(p[2]) for p in held])
        begin = end - [len(p[2]) for p in held]
        return np.frombuffer(b"".join(p[2] for p in held), np.uint8), begin, end, [p[0] for p in held], np.array([p[1] for p in held], np.int64)

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            for at in range(0, len(text) - length + 1, CHUNK):
                held.append((key, at, text[at : at + CHUNK + length - 1]))
                size += len(held[-1][2])
                if size >= CHUNK:
                    yield chunk()
                    held, size = [], 0
    if held:
        yield chunk()


def _scan(length: int, wanted=None, columns: str = ""):
    """Groups with the hashes of cores and outer texts; `wanted` is a test of the core's hash (of the outer text's, with contexts)."""
    window, _ = widths(length)
    core = length - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (data, begin, end, keys, offset) in enumerate(_stretches(batches, length)):
            first, last, anchor = groups(data, begin, end, length)
            one, two = _Prefix(data, 0), _Prefix(data, 1)
            out = {"k": one.of(anchor, anchor + core)}
            if columns:
                out["o"] = one.of(first, last + length)
                keep = np.flatnonzero(wanted(out["o" if "left" in columns else "k"]))
                if "left" in columns and len(keep):  # one group of each outer text, in suffix order
                    keep = keep[np.unique(out["o"][keep], return_index=True)[1]]
                first, last, anchor = first[keep], last[keep], anchor[keep]
                out = {c: v[keep] for c, v in out.items()}
                out |= {"o2": two.of(first, last + length), "first": first, "last": last}
                text = np.searchsorted(begin, first, "right") - 1
                if "left" in columns:
                    raw = data.tobytes()
                    left = [raw[a:b] for a, b in zip(first.tolist(), anchor.tolist())]
                    right = [raw[a:b] for a, b in zip((anchor + core).tolist(), (last + length).tolist())]
                    out |= {"k2": two.of(anchor, anchor + core), "anchor": anchor}
                    order = np.array(sorted(range(len(keep)), key=lambda i: (out["k"][i], out["k2"][i], right[i])), np.int64)
                    shift = (offset - begin)[text[order]]
                    out = {c: v[order] + shift if c in ("first", "last", "anchor") else v[order] for c, v in out.items()}
                    shard = np.full(len(keep), (TaskContext.get().partitionId() << 32) + number)
                    out |= {"left": pa.array([left[i] for i in order], pa.binary()), "right": pa.array([right[i] for i in order], pa.binary()), "shard": shard, "place": np.arange(len(keep))}
                    text = text[order]
                else:
                    shift = (offset - begin)[text]
                    out |= {"first": first + shift, "last": last + shift}
                out["key"] = pa.array([keys[t] for t in text], pa.binary())
            names = [c.split()[0] for c in columns.split(", ")] if columns else ["k"]
            yield pa.record_batch([pa.array(out[c]) for c in names], names)

    return run


_GROUPS = "key binary, first long, last long, k long, o long, o2 long"
_SUFFIXES = "key binary, first long, last long, anchor long, k long, k2 long, o long, o2 long, left binary, right binary, shard long, place long"
_FAMILY = ["k", "k2", "lo", "hi", "before", "after"]


def interleave(strings: list[bytes], family: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings within families, and each one's common prefix with the one before (-1: another family; `width`: equal).

    The strings come shard by shard, each shard's in order; every round merges the shards' members of each block by
    the next eight bytes.
    """
    pad = -(-max(width, 1) // 8) * 8
    symbols = np.frombuffer(b"".join(s.ljust(pad, b"\0") for s in strings), ">u8").astype(np.uint64).reshape(len(strings), pad // 8)
    order = np.arange(len(strings))
    common = np.full(len(strings), width)
    common[0] = -1
    common[1:][family[1:] != family[:-1]] = -1
    for t in range(pad // 8):
        opens = common < width
        block = np.cumsum(opens)
        open_ = np.flatnonzero(~opens | ~np.append(opens[1:], True))  # a suffix alone in its block is done
        if not len(open_):
            break
        symbol, block = symbols[order[open_], t], block[open_]
        merged = np.lexsort((symbol, block))
        order[open_] = order[open_][merged]
        symbol = symbol[merged]
        differ = symbol[1:] ^ symbol[:-1]
        breaks = np.flatnonzero((differ != 0) & (block[1:] == block[:-1]))
        equal = sum((differ[breaks] < np.uint64(1 << 8 * k)).astype(np.int64) for k in range(1, 8))
        common[open_[breaks + 1]] = np.minimum(8 * t + equal, width - 1)
    return order, common


def repeated(family, lo, hi, low, high, left: list[bytes], right: list[bytes], window: int) -> np.ndarray:
    """For each suffix and distance, whether its string occurs again in its family; low and high bound its own distances."""
    by_right, right_common = interleave(right, family, window)
    by_left, left_common = interleave([s[::-1] for s in left], family, window)
    out = np.zeros((len(family), window), np.bool_)
    right_block, left_block = np.empty(len(family), np.int64), np.empty(len(family), np.int64)
    for d in range(int(lo.min()), int(hi.max())):
        here = np.flatnonzero((low <= d) & (d <= high) & (lo <= d) & (d < hi))
        right_block[by_right] = np.cumsum(right_common < window - 1 - d)
        left_block[by_left] = np.cumsum(left_common < d)
        both = right_block[here] * len(family) + left_block[here]
        order = np.argsort(both)
        same = both[order][1:] == both[order][:-1]
        out[here[order], d] = np.append(same, False) | np.insert(same, 0, False)[: len(here)]
    return out


def _merged(length: int):
    window, _ = widths(length)

    def give(rows: list[dict], family: list[int]) -> pa.RecordBatch:
        column = lambda c: np.array([r[c] for r in rows], np.int64)
        anchor, first, last = column("anchor"), column("first"), column("last")
        hit = repeated(np.array(family), column("lo"), column("hi"), anchor - last, anchor - first, [r["left"] for r in rows], [r["right"] for r in rows], window)
        hit &= (column("n") == 1)[:, None]  # the others are repeated as a whole
        edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, low = np.nonzero(edge == 1)
        high = np.nonzero(edge == -1)[1] - 1
        return pa.record_batch([pa.array([rows[i]["key"] for i in row], pa.binary()), pa.array(anchor[row] - high), pa.array(anchor[row] - low + length)], ["key", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        family: list[int] = []
        key = None
        for batch in batches:
            for r in batch.to_pylist():
                new = tuple(r[c] for c in _FAMILY)
                if new != key and len(rows) >= MERGED:
                    yield give(rows, family)
                    rows, family = [], []
                family.append(family[-1] + (new != key) if family else 0)
                key = new
                rows.append(r)
        if rows:
            yield give(rows, family)

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row's spans the runs that they cover together."""
    for batch in batches:
        lists = batch.column("spans")
        cuts = lists.offsets.to_numpy()
        flat = lists.values
        start, end = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
        row = np.repeat(np.arange(len(lists)), np.diff(cuts))
        start, end = start[cuts[0] : cuts[-1]], end[cuts[0] : cuts[-1]]
        order = np.lexsort((start, row))
        row, start, end = row[order], start[order], end[order]
        # The furthest end so far within the row: rows are lifted above each other, so one running maximum serves all.
        lift = row * (int(end.max(initial=0)) + 1)
        reach = np.maximum.accumulate(end + lift)
        new = np.append(True, (start + lift)[1:] > reach[:-1])[: len(start)] | np.append(True, row[1:] != row[:-1])[: len(start)]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        runs = pa.StructArray.from_arrays([pa.array(start[first]), pa.array((reach - lift)[last])], ["start", "end"])
        sizes = np.bincount(row[first], minlength=len(lists))
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        yield pa.record_batch([batch.column("key"), pa.ListArray.from_arrays(offsets, runs)], ["key", "spans"])


def repeated_spans(texts: DataFrame, length: int = LENGTH, limit: int = FAMILY) -> DataFrame:
    """(key, spans): for each text with a repeated string of `length` bytes, starts and ends of all such strings' stretches.

    texts: key (binary) and text, where equal keys mean equal texts. Spans are structs (start, end) in no order; within BLOCK
    bytes of a text they are maximal runs, so a text has one per `length` bytes and one per block at most.
    """
    window, _ = widths(length)
    cores = written(texts.mapInArrow(_scan(length), "k long"), "cores")
    test = repeat_test(cores, cores.count())
    found = written(texts.mapInArrow(_scan(length, test, _GROUPS), _GROUPS), "groups")
    counts = written(found.groupBy("k", "o", "o2").agg(F.count(F.lit(1)).alias("n")), "counts")
    whole = found.join(counts.filter("n > 1").select("o", "o2"), ["o", "o2"]).select("key", F.col("first").alias("start"), (F.col("last") + length).alias("end"))

    open_cores = written(counts.groupBy("k").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("n") == 1).alias("unsettled")).filter("members > 1 AND unsettled > 0").select("k", "members"), "open")
    wanted = written(counts.join(open_cores, "k").select("o", "o2", "n", "members"), "wanted")
    twice = wanted.select("o").union(wanted.select("o"))
    again = repeat_test(twice, wanted.count())
    rows = written(texts.mapInArrow(_scan(length, again, _SUFFIXES), _SUFFIXES), "suffixes")
    met = rows.join(wanted, ["o", "o2"])
    # Of a repeated outer text one group takes part; which one makes no difference.
    chosen = met.filter("n > 1").groupBy("o", "o2").agg(F.min(F.struct("shard", "place")).alias("at"))
    one = met.filter("n > 1").join(written(chosen, "chosen"), ["o", "o2"]).filter("shard = at.shard AND place = at.place").drop("at")
    none = F.lit(b"")
    suffixes = written(met.filter("n = 1").unionByName(one).select("*", F.lit(0).alias("lo"), F.lit(window).alias("hi"), none.alias("before"), none.alias("after")), "members")

    small, large, single = suffixes.filter(F.col("members") <= limit), suffixes.filter(F.col("members") > limit), None
    while not large.isEmpty():
        middle = F.expr("(lo + hi) div 2").cast("int")
        part = lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))
        halves = large.drop("members").withColumn("r", F.explode(F.array(part(F.col("lo"), middle), part(middle, F.col("hi"))))).withColumn("lo", F.col("r.lo")).withColumn("hi", F.col("r.hi")).drop("r")
        able = halves.filter("anchor - first >= lo AND anchor - last < hi AND lo < hi")
        fixed = written(able.withColumn("before", F.expr("substring(left, length(left) - lo + 1, lo)")).withColumn("after", F.substring("right", F.lit(1), window - F.col("hi"))), "halves")
        sizes = written(fixed.groupBy(*_FAMILY).agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "sizes")
        fixed = written(fixed.join(sizes, _FAMILY), "halves")
        alone = fixed.filter("hi - lo = 1 AND n = 1").select("key", (F.col("anchor") - F.col("lo")).alias("start"), (F.col("anchor") - F.col("lo") + length).alias("end"))
        single = alone if single is None else single.unionByName(alone)
        rest = fixed.filter("hi - lo > 1").select(*suffixes.columns)
        small, large = small.unionByName(rest.filter(F.col("members") <= limit)), rest.filter(F.col("members") > limit)

    merging = small.select("key", "first", "last", "anchor", "n", "left", "right", "shard", "place", *_FAMILY).repartition(*_FAMILY).sortWithinPartitions(*_FAMILY, "shard", "place")
    spans = whole.unionByName(merging.mapInArrow(_merged(length), "key binary, start long, end long"))
    if single is not None:
        spans = spans.unionByName(single)
    # Stretches are united block by block of a text, so that a text of one repeated letter is no list of all its positions.
    blocks = spans.groupBy("key", F.expr(f"start div {BLOCK}").alias("block")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    united = blocks.select("key", "spans").mapInArrow(_united, "key binary, spans array<struct<start: long, end: long>>")
    return written(united.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed = [], []
        for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
            runs: list[list[int]] = []
            for s in sorted((s["start"], s["end"]) for s in spans or []):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append(list(s))
            edges = [0, *(x for r in runs for x in r), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            removed.append([{"start": a, "end": b} for a, b in runs])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.record_batch([batch.column("id"), pa.array([len(t) for t in batch.column("text").cast(pa.binary()).to_pylist()], pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary())], ["id", "n_bytes", "removed", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", limit: int = FAMILY) -> DataFrame:
    """One row per row of docs: id, n_bytes, removed (maximal runs of UTF-8 bytes, end exclusive), kept (the remaining bytes).

    Removed is each byte that a string of `length` bytes covers which also starts anywhere else, in the same text or another
    (so the texts of repeated rows go as a whole, if they are that long). Null texts are empty. Ids may be null or repeated.
    """
    text = text_or_empty(text_col)
    keyed = docs.select(F.col(id_col).alias("id"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("key"), text.alias("text"))
    long_ones = keyed.filter(F.octet_length("text") >= length).select("key", "text")
    spans = repeated_spans(long_ones, length, limit)
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, removed array<struct<start: long, end: long>>, kept binary"
    return keyed.join(spans, "key", "left").select("id", "text", "spans").mapInArrow(_kept, schema).withColumnRenamed("id", id_col)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    got = remove_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return got.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
