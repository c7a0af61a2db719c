"""Near-duplicate detection with ProbMinHash signatures.

A text is a bag of shingles of five words (white-space separated, case and all), each weighted by how often it
occurs. The similarity of two bags is their probability Jaccard similarity, which for bags without repeated shingles is
the Jaccard similarity of the sets. In a signature each shingle is a Poisson process whose rate is its weight;
arrivals fall on one of COMPONENTS components each, and a component keeps the shingle that arrived first. A process
ends as soon as its next arrival is later than the latest first arrival of all components.

Signatures are cut into BANDS bands; documents that agree in a whole band are candidates (a pair of similarity 0.8
is missed with probability 2.6e-5). Candidates are verified exactly on the bags of both texts, and a class is a
connected component of verified links. No bucket is expanded into its pairs: a text's score is the number of texts it
meets in all its buckets, which is largest for the least edited text of a group. Each text is compared with the
highest scores it meets, which finds nearly all links at linear cost. What remains are pairs of different classes in the buckets that
still hold several. Those of them that can be similar have a shingle in common in the short tails of their rarest shingles; every
pair that this and the bounds of its similarity do not exclude is verified exactly, so no candidate pair of different classes
stays untested.

Null texts count as empty. Texts without words are in a class with equal texts only. Of rows with the same id the first is
the one with the smaller hash of all its columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected
from ..session import written
from .common import chunks, code_points, mix, owner, prepare, row_hash, run_hashes, runs, spaces, table, text_or_empty
from .dedup import repeat_filter

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
COMPONENTS = BANDS * ROWS
#: Code points whose signatures are made at once, but for a single longer text.
SIGNED_CHARS = 120_000
#: Texts with a common shingle that a block holds on average at most.
BLOCK_TEXTS = 512
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def bags(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, shingle hash and weight of each distinct shingle of each text.

    A text of fewer words is one shingle; one without any has none.
    """
    codes, starts = code_points(texts)
    begin, end = runs(~spaces()[codes])
    word, text = run_hashes(codes, begin, end), owner(begin, starts)
    count = np.bincount(text, minlength=len(texts)) if len(text) else np.zeros(len(texts), np.int64)
    first = np.cumsum(count) - count
    place = np.arange(len(word)) - first[text]
    use = np.flatnonzero((place <= count[text] - words) | ((place == 0) & (count[text] < words)))
    h = np.zeros(len(use), np.uint64)
    for k in range(words):
        there = place[use] + k < count[text[use]]
        h = h * GOLDEN + np.where(there, word[np.minimum(use + k, len(word) - 1)], 0)
    h = np.maximum(mix(h + np.uint64(1)), np.uint64(1))
    order = np.lexsort((h, text[use]))
    h, text = h[order], text[use][order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])))[: len(h)])
    return text[new], h[new], np.diff(np.append(new, len(h)))


def signatures(n_texts: int, text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, m: int = COMPONENTS) -> np.ndarray:
    """ProbMinHash signatures, n_texts x m; rows of texts without shingles are zero."""
    first = np.full(n_texts * m, np.inf)
    out = np.zeros(n_texts * m, np.uint64)
    h, d, rate = shingle, text, weight.astype(np.float64)
    t, state = np.zeros(len(h)), shingle.copy()
    while len(h):
        state = state + GOLDEN
        bits = mix(state)
        t = t - np.log(((bits >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / rate
        slot = d * m + (mix(bits) % np.uint64(m)).astype(np.int64)
        early = np.flatnonzero(t < first[slot])
        np.minimum.at(first, slot[early], t[early])
        won = early[first[slot[early]] == t[early]]
        out[slot[won]] = h[won]
        latest = first.reshape(n_texts, m).max(1)
        going = t < latest[d]
        h, d, rate, t, state = h[going], d[going], rate[going], t[going], state[going]
    return out.reshape(n_texts, m)


def band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        h = mix(h * GOLDEN + parts[:, :, k])
    return h


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The probability Jaccard similarity of two bags (sorted distinct shingles, weights); 0 if one is empty.

    With the shingles ordered by the ratio of their weights, the sum of the larger quotients in its definition is a
    prefix sum of one side plus a suffix sum of the other.
    """
    common, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    wa, wb = a[1][ia].astype(np.float64), b[1][ib].astype(np.float64)
    order = np.argsort(wb / wa, kind="stable")
    x, y = wa[order], wb[order]
    ratio = y / x
    last = np.searchsorted(ratio, ratio, side="right")
    upto = np.concatenate(([0.0], np.cumsum(x))) + (a[1].sum() - x.sum())  # shingles of a alone have ratio 0
    above = np.concatenate((np.cumsum(y[::-1])[::-1], [0.0])) + (b[1].sum() - y.sum())  # of b alone, infinite
    return float((1 / (upto[last] / x + above[last] / y)).sum())


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose last column is a text, with the text replaced by its band keys (none without words)."""
    for batch in batches:
        keys, sizes = [np.zeros(0, np.int64)], [0]
        for part in chunks(batch.column(batch.num_columns - 1).to_pylist(), SIGNED_CHARS):
            text, h, w = bags(part)
            key = band_keys(signatures(len(part), text, h, w)).view(np.int64)
            some = np.bincount(text, minlength=len(part)) > 0
            keys.append(key[some].ravel())
            sizes += (BANDS * some).tolist()
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(keys)))
        yield pa.record_batch([*batch.columns[:-1], lists], [*batch.schema.names[:-1], "bands"])


@F.arrow_udf(T.BinaryType())
def _bag(texts: pa.Array) -> pa.Array:
    """Sorted shingle hashes of 64 bits; then, if a shingle is repeated, a zero and the weights of all."""
    out, zero = [], np.zeros(1, np.uint64).tobytes()
    for part in chunks(texts.to_pylist()):
        text, h, w = bags(part)
        at = np.searchsorted(text, np.arange(len(part) + 1))
        out += [h[i:j].tobytes() + (zero + w[i:j].astype(np.uint64).tobytes() if (w[i:j] > 1).any() else b"") for i, j in zip(at, at[1:])]
    return pa.array(out, pa.binary())


def _unbag(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(data, np.uint64)
    half = len(both) // 2
    if len(both) % 2 and half and both[half] == 0:
        return both[:half], both[half + 1 :]
    return both, np.ones(len(both), np.uint64)


@F.arrow_udf(T.DoubleType())
def _similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([similarity(_unbag(x.as_py()), _unbag(y.as_py())) for x, y in zip(a, b)], pa.float64())


@F.arrow_udf(T.BinaryType())
def _sketch(bags: pa.Array) -> pa.Array:
    """A bag with its shingles cut to 16 bits: total weight, whether no weight is above 1, distinct values; then these
    and, if a value's summed weight is above 1, the sums of all."""
    out = []
    for data in bags:
        h, w = _unbag(data.as_py())
        cell, at = np.unique((h & np.uint64(0xFFFF)).astype(np.uint16), return_inverse=True)
        sums = np.bincount(at, weights=w.astype(np.float64), minlength=len(cell)).astype(np.uint32)
        out.append(np.array([w.sum(), w.max(initial=0) <= 1, len(cell)], np.uint32).tobytes() + cell.tobytes() + (sums.tobytes() if (sums > 1).any() else b""))
    return pa.array(out, pa.binary())


def _unsketch(data: bytes) -> tuple[int, bool, np.ndarray, np.ndarray]:
    total, unit, n = np.frombuffer(data, np.uint32, 3)
    sums = data[12 + 2 * n :]
    return int(total), bool(unit), np.frombuffer(data, np.uint16, n, 12), np.frombuffer(sums, np.uint32) if sums else np.ones(n, np.uint32)


def bounds(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Upper bounds of the similarities of two lists of sketches.

    Cutting shingles can only raise what two bags have in common. Of bags without repeated shingles that is a count c,
    and their similarity c / (a + b - c). Of others, no coupling of two draws agrees more often than the smaller
    shares add up to, and the probability Jaccard similarity is how often one coupling does.
    """
    parts = [_unsketch(x) for x in right]
    total, unit = np.array([x[0] for x in parts], np.float64), np.array([x[1] for x in parts], np.bool_)
    size = np.array([len(x[2]) for x in parts])
    cell, weight = np.concatenate([x[2] for x in parts]), np.concatenate([x[3] for x in parts]).astype(np.float64)
    begin, share = np.cumsum(size) - size, weight / np.repeat(total, size)
    out, own = np.zeros((len(left), len(right))), np.zeros(1 << 16)
    for i, data in enumerate(left):
        n, single, c, w = _unsketch(data)
        if not single or not unit.all():
            own[c] = w / n
            out[i] = np.add.reduceat(np.minimum(own[cell], share), begin)
        if single and unit.any():
            own[c] = w
            common = np.add.reduceat(np.minimum(own[cell], weight), begin)
            out[i] = np.where(unit, common / (n + total - common), out[i])
        own[c] = 0
    return out


@F.arrow_udf(T.DoubleType())
def _bound(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([float(bounds([x.as_py()], [y.as_py()])[0, 0]) for x, y in zip(a, b)], pa.float64())


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts (node, label, bag): a row (node, label, h, w, total, unit) per shingle, with its weight and the weight of all."""
    for batch in batches:
        node, label = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for k, data in enumerate(batch.column(2)):
            h, w = _unbag(data.as_py())
            columns = [np.full(len(h), node[k]), np.full(len(h), label[k]), h.view(np.int64), w.astype(np.float64), np.full(len(h), w.sum(), np.float64), np.full(len(h), w.max(initial=0) <= 1)]
            yield pa.record_batch([pa.array(c) for c in columns], ["node", "label", "h", "w", "total", "unit"])


def _pairs_of_members(threshold: float):
    """Of rows with the members (block, node, label, upto, total, unit) of two blocks i and j that have a shingle in common: the
    pairs of different classes, one of each block, that may be so similar if this is their rarest common shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                block, node, label, upto, total, unit = (members.values.field(k).to_numpy(zero_copy_only=False) for k in range(6))
                x, y = np.flatnonzero(block == i)[:, None], np.flatnonzero(block == j)[None, :]
                common = np.minimum(upto[x], upto[y])  # of bags without repeated shingles
                bound = np.where(unit[x] & unit[y], common / (total[x] + total[y] - common), 1 / (total[x] / upto[x] + total[y] / upto[y] - 1))
                near, far = np.nonzero((bound >= threshold - 1e-9) & (label[x] != label[y]) & ((i != j) | (node[x] < node[y])))
                a, b, score = x[near, 0], y[0, far], bound[near, far]
                a, b = np.where(node[a] < node[b], a, b), np.where(node[a] < node[b], b, a)
                yield pa.record_batch([pa.array(v) for v in (node[a], node[b], label[a], label[b], score)], ["a", "b", "label_a", "label_b", "score"])

    return run


def _tails(state: DataFrame, bag: DataFrame, threshold: float) -> DataFrame:
    """Of the texts of open buckets the shingles h by which they are compared: h, node, label, upto, total, unit, and the own block and
    each other block of the texts of h.

    Let c and d be the shares that the common shingles have in two bags; then their similarity is at most 1 / (1/c + 1/d - 1): in
    its definition the sum of quotients for a common shingle with shares p and q is at least 1/q + (1 - c)/p, and the sum of the
    inverses over all common shingles is largest where p/q is the same for all. Bags without repeated shingles give the
    Jaccard similarity by counts. Shingles are ordered by how many texts have them, those of one class only last of all.
    All common shingles of a pair come no later than the rarest one, so c and d are at most the shares of the
    shingles up to it (upto / total): it lies in the short tails where this share is at least the threshold. Only
    texts that have a shingle in their tails in common need be compared; most shingles have one block of texts.
    """
    members = written(state.select("node", "label").distinct(), "members")
    texts = bag.join(members, bag["id"] == members["node"]).select("node", "label", "bag")
    shingles = written(texts.mapInArrow(_shingles, "node long, label long, h long, w double, total double, unit boolean"), "shingles")
    classes = (F.min("label") < F.max("label")).alias("several")
    shared = written(shingles.groupBy("h").agg(F.count(F.lit(1)).alias("n"), classes).filter("several").select("h", "n"), "shared")
    upto = F.sum("w").over(W.partitionBy("node").orderBy(F.col("n").desc(), "h").rowsBetween(W.unboundedPreceding, W.currentRow))
    tail = written(shingles.join(shared, "h").withColumn("upto", upto).filter(F.col("upto") >= (threshold - 1e-9) * F.col("total")).drop("n", "w"), "tails")
    live = tail.groupBy("h").agg(F.count(F.lit(1)).alias("n"), classes, F.min(F.col("total") / F.col("upto")).alias("least")).filter("several")
    dealt = tail.join(live, "h").filter(F.col("total") / F.col("upto") + F.col("least") - 1 <= 1 / (threshold - 1e-9))
    blocks = F.ceil(F.col("n") / BLOCK_TEXTS).cast("int")
    return dealt.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))


def _rest(state: DataFrame, bag: DataFrame, threshold: float) -> DataFrame:
    """All pairs (a, b, label_a, label_b, score) of texts of different classes in open buckets that may be so similar, with an upper
    bound of the similarity: each two blocks of the texts that have a shingle in their tails in common are one row.
    """
    dealt = _tails(state, bag, threshold)
    at = dealt.select("h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.struct("block", "node", "label", "upto", "total", "unit").alias("member"))
    tasks = at.repartition("h", "i", "j").groupBy("h", "i", "j").agg(F.collect_list("member").alias("members")).filter(F.size("members") > 1)
    found = tasks.select("i", "j", "members").mapInArrow(_pairs_of_members(threshold), "a long, b long, label_a long, label_b long, score double")
    return found.groupBy("a", "b", "label_a", "label_b").agg(F.min("score").alias("score"))


def _not_excluded(pairs: DataFrame, bag: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, ...) whose sketches, a quarter of the bags, do not bound the similarity below the threshold."""
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sketch = written(bag.join(ends, "id", "left_semi").select("id", _sketch("bag").alias("sketch")), "sketches")
    at = lambda c: sketch.select(F.col("id").alias(c), F.col("sketch").alias(f"sketch_{c}"))
    return pairs.join(at("a"), "a").join(at("b"), "b").filter(_bound("sketch_a", "sketch_b") >= threshold - 1e-9).drop("sketch_a", "sketch_b")


def text_keys(text: str = "text"):
    """128 bits by which equal texts are recognised."""
    return [F.xxhash64(F.lit(17), text).alias("k1"), F.xxhash64(F.lit(71), text).alias("k2")]


def _verified(pairs: DataFrame, bag: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of at least this similarity, written, so that what follows needs no second Python worker in the same task."""
    right = pairs.join(bag.select(F.col("id").alias("b"), F.col("bag").alias("bag_b")), "b")
    both = right.join(bag.select(F.col("id").alias("a"), F.col("bag").alias("bag_a")), "a")
    return written(both.filter(_similarity("bag_a", "bag_b") >= threshold).select("a", "b"), "links")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Classes of near duplicates: (rows, nodes).

    rows: one per row of docs with id, k1, k2 (of its text) and row_key. nodes: one per distinct text with k1, k2,
    label (of its class), first (the class's first row: smallest id, nulls last, then smallest hash of its columns, then
    smallest row_key) and class_rows.
    """
    prepare(docs.sparkSession)
    work = docs.select(F.col(id_col).alias("id"), row_hash(docs).alias("tie"), text_or_empty(text_col).alias("text"))
    keyed = work.select("id", *text_keys(), F.monotonically_increasing_id().alias("row_key"), "tie", "text")
    schema = T.StructType([*keyed.drop("text").schema.fields, T.StructField("bands", T.ArrayType(T.LongType()))])
    rows = written(keyed.mapInArrow(_signed, schema), "signatures")
    order = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("tie").alias("tie"), F.col("row_key").alias("key"))
    nodes = written(rows.groupBy("k1", "k2").agg(F.min("row_key").alias("node"), F.min(order).alias("first"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands")), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("band"))
    # Written, so that a join's two sides are exchanges of their own and a hot bucket can be split.
    buckets = written(banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
    met = written(banded.join(buckets, "band"), "buckets")
    score = met.groupBy("node").agg(F.sum("size").alias("score"))
    met = written(met.join(score, "node").select("band", "node", F.struct(F.col("score"), (-F.col("node")).alias("order")).alias("rank")), "buckets")
    bag = _bags_of(work, nodes.join(met.select("node").distinct(), "node", "left_semi"))
    merge, state, tested = _first_merge(met, lambda pairs: _verified(pairs, bag, threshold))
    merges = [merge] if state.isEmpty() else [merge, *_last_merges(state, tested, bag, threshold)]
    named = nodes.withColumn("label", F.col("node"))
    for merge in merges:
        named = named.join(merge.select(F.col("id").alias("label"), F.col("label").alias("new")), "label", "left").withColumn("label", F.coalesce("new", "label")).drop("new")
    named = written(named.drop("bands"), "named")
    classes = written(named.groupBy("label").agg(F.min("first").alias("class_first"), F.sum("n").alias("class_rows")), "classes")
    return rows.drop("bands"), named.join(classes, "label").select("k1", "k2", "label", F.col("class_first").alias("first"), "class_rows")


def _first_merge(met: DataFrame, verified) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the members of buckets (band, node, rank): the merge (id, label) by the links of each text with the highest rank
    it meets, the buckets that hold several classes then, and the pairs (a, b) that were tested.

    verified takes pairs (a, b) and returns those that are links.
    """
    top = written(met.groupBy("band").agg(F.max("rank").alias("top")), "tops")
    first = met.join(top, "band").filter("rank <> top").groupBy("node").agg(F.max("top").alias("top"))
    tested = written(first.select(F.least("node", -F.col("top.order")).alias("a"), F.greatest("node", -F.col("top.order")).alias("b")).distinct(), "candidates")
    merge = connected(verified(tested))
    return merge, _open_buckets(met.select("band", "node", F.col("node").alias("label")), merge), tested


def _last_merges(state: DataFrame, tested: DataFrame, bag: DataFrame, threshold: float) -> list[DataFrame]:
    """The merges (id, label) by what was not tested at first: afterwards every candidate pair is in one class, tested or
    excluded by its bound.

    Of each two classes the pair of the highest bound is verified first. The pairs that are still in different classes then
    are all verified.
    """
    rest = written(_rest(state, bag, threshold).join(tested, ["a", "b"], "left_anti"), "candidates")
    todo = written(_not_excluded(rest, bag, threshold), "candidates")
    two = [F.least("label_a", "label_b").alias("low"), F.greatest("label_a", "label_b").alias("high")]
    best = written(todo.groupBy(*two).agg(F.max_by(F.struct("a", "b"), F.struct("score", "a", "b")).alias("pair")).select("pair.a", "pair.b"), "candidates")
    first = connected(_verified(best, bag, threshold).join(todo, ["a", "b"]).select("label_a", "label_b"), "label_a", "label_b")
    to = lambda c: first.select(F.col("id").alias(c), F.col("label").alias(f"new_{c[-1]}"))
    named = todo.join(best, ["a", "b"], "left_anti").join(to("label_a"), "label_a", "left").join(to("label_b"), "label_b", "left")
    named = named.select("a", "b", F.coalesce("new_a", "label_a").alias("label_a"), F.coalesce("new_b", "label_b").alias("label_b"))
    open_ = written(named.filter("label_a <> label_b"), "candidates")
    if open_.isEmpty():
        return [first]
    return [first, connected(_verified(open_, bag, threshold).join(open_, ["a", "b"]).select("label_a", "label_b"), "label_a", "label_b")]


def _bags_of(work: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, bag) of some distinct texts: a Bloom filter of their keys picks their rows, so that few texts are shuffled."""
    wanted = written(nodes.select("k1", "k2", "node"), "wanted")
    key = F.xxhash64("k1", "k2")
    hashes = wanted.select(key.alias("h"))
    flag = repeat_filter(hashes.union(hashes), 2 * wanted.count())
    found = work.select(*text_keys(), "text").filter(flag(key)).join(wanted, ["k1", "k2"])
    return written(found.groupBy("node").agg(F.first("text").alias("text")).select(F.col("node").alias("id"), _bag("text").alias("bag")), "bags")


def _open_buckets(state: DataFrame, merge: DataFrame) -> DataFrame:
    """The members of buckets (band, node, label) under merged labels: those of all buckets that hold several classes."""
    new = state.join(merge.select(F.col("id").alias("label"), F.col("label").alias("new")), "label", "left")
    named = written(new.select("band", "node", F.coalesce("new", "label").alias("label")), "named")
    live = written(named.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter(F.col("x") < F.col("y")).select("band"), "live")
    return written(named.join(live, "band"), "buckets")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, class_id (the smallest id in its class), class_size (rows), kept (true for one row of each class)."""
    rows, nodes = near_classes(docs, id_col, text_col)
    got = rows.join(nodes, ["k1", "k2"])
    return got.select(F.col("id").alias(id_col), F.col("first.id").alias("class_id"), F.col("class_rows").alias("class_size"), (F.col("row_key") == F.col("first.key")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without all but the first row of each class, with the columns of docs.

    A Bloom filter of the texts in classes of several rows lets all other rows pass without a shuffle.
    """
    _, nodes = near_classes(docs, id_col, text_col)
    grouped = written(nodes.filter("class_rows > 1").select("k1", "k2", F.col("first.id").alias("keep"), F.col("first.tie").alias("keep_tie"), "label"), "grouped")
    hashes = grouped.select(F.xxhash64("k1", "k2").alias("h"))
    flag = repeat_filter(hashes.union(hashes), 2 * grouped.count())
    work = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), row_hash(docs).alias("tie"), text_or_empty(text_col).alias("text")).select("row", "id", "tie", *text_keys())
    tested = work.withColumn("again", flag(F.xxhash64("k1", "k2")))
    maybe = tested.filter("again").drop("again").join(grouped, ["k1", "k2"], "left")
    alone = maybe.filter("label IS NULL").select("row")
    # Rows that agree in id and hash are the same row several times.
    one = maybe.filter(F.col("label").isNotNull() & F.col("id").eqNullSafe(F.col("keep")) & (F.col("tie") == F.col("keep_tie"))).dropDuplicates(["label"]).select("row")
    return tested.filter(~F.col("again")).select("row").unionByName(alone).unionByName(one).select("row.*")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
