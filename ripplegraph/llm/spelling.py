"""Spelling variants by two-dimensional range reporting.

Words with a common prefix are an interval of the vocabulary in forward order, words with a common suffix an interval in
reverse order. For each edit position of a word, the words that agree with it before and after that position are
the points of a rectangle: forward interval by reverse interval. A wavelet tree over the permutation of the two
orders reports them, all queries of a task level by level at once.

To share the work out, the positions [lo, hi) at which two words may differ are split: words that differ there agree
before lo and after hi, so they meet in the family with that prefix and suffix. A family of more than FAMILY words
is split at the middle of its positions, as often as needed; with one position left it holds a word per letter
at most. So no task holds more than its families, whatever prefix most words share, and every pair is found
once: a deletion within a run of equal letters counts at the run's first letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .common import prepare, table

#: Words of a family before its positions are split; code points of families that a task handles at once.
FAMILY, CHUNK = 20_000, 2_000_000
#: Words that a task counts before it hands them on.
HELD = 200_000

_RUN = re.compile("[A-Za-zÀ-ÿ]+")


def damaged(run: str, h: int, every: int) -> str:
    """The run without the code point h % length where `every` divides h."""
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def vocabulary(docs: DataFrame, least_length: int = 6, least_n: int = 5, every: int = 199) -> DataFrame:
    """(word, n) of the runs of letters in docs (doc_id, text), lower-cased in A-Z only, one in `every` damaged.

    A null text has no words; a null doc_id counts as the empty string in the hash.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        give = lambda: pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                begin = zlib.crc32(f"{key or ''}:".encode())
                low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                for run, n in Counter(_RUN.findall(low)).items():
                    if len(run) >= least_length:
                        h = zlib.crc32(run.encode(), begin)
                        word = run if h % every else damaged(run, h, every)
                        if len(word) >= least_length:
                            held[word] += n
                if len(held) >= HELD:
                    yield give()
                    held.clear()
        if held:
            yield give()

    runs = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).filter("text IS NOT NULL")
    return runs.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


class WaveletTree:
    """A permutation of 0 .. m-1, level by level: each level holds the ranks of one bit, zeros go before ones on the next."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.levels = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1
            self.levels.append((len(values) - int(one.sum()), np.concatenate(([0], np.cumsum(one)))))
            values = np.concatenate([values[one == 0], values[one == 1]])

    def report(self, x0, x1, y0, y1) -> tuple[np.ndarray, np.ndarray]:
        """(query, y) of every point with x0 <= x < x1 and y0 <= y < y1; arguments are arrays, one query each."""
        query, lo, hi, base = np.arange(len(x0)), x0, x1, np.zeros(len(x0), np.int64)
        for level, (zeros, rank) in enumerate(self.levels):
            width = 1 << (self.bits - 1 - level)
            a, b = rank[lo], rank[hi]
            query, lo, hi, base = (np.concatenate(p) for p in ((query, query), (lo - a, zeros + a), (hi - b, zeros + b), (base, base + width)))
            open_ = (lo < hi) & (base < y1[query]) & (base + width > y0[query])
            query, lo, hi, base = query[open_], lo[open_], hi[open_], base[open_]
        return query, base


class _Order:
    """Rows in lexicographic order within families, and the intervals of rows that share their first symbols."""

    def __init__(self, codes: np.ndarray, family: np.ndarray):
        self.row = np.lexsort((*codes.T[::-1], family))
        self.rank = np.empty(len(codes), np.int64)
        self.rank[self.row] = np.arange(len(codes))
        differ = codes[self.row[1:]] != codes[self.row[:-1]]
        self.common = np.where(differ.any(1), differ.argmax(1), codes.shape[1])
        self.common[family[self.row[1:]] != family[self.row[:-1]]] = -1

    def interval(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row, the first and (exclusive) last place of the rows that agree with it in `depth` symbols."""
        place = np.arange(len(self.row) + 1)
        cut = np.concatenate(([True], self.common < depth, [True]))
        first = np.maximum.accumulate(np.where(cut, place, 0))[:-1]
        last = np.minimum.accumulate(np.where(cut, place, len(self.row))[::-1])[::-1][1:]
        return first[self.rank], last[self.rank]


def near_pairs(words: list[str], family: np.ndarray, length: int, lo: int, hi: int, deletion: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of words of a family that differ at one position p, lo <= p < hi, each pair in both directions.

    Without deletion all words have `length` code points and one is replaced; otherwise words of length + 1 lose
    one and become words of `length`.
    """
    width = length + 1
    codes = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), width)
    size = np.fromiter(map(len, words), np.int64, len(words))
    from_end = size[:, None] - 1 - np.arange(width)[None, :]
    reverse = np.where(from_end >= 0, np.take_along_axis(codes, np.maximum(from_end, 0), 1), 0)
    forward, backward = _Order(codes, family), _Order(reverse, family)
    asks: list[list[np.ndarray]] = [[], [], [], [], []]
    for p in range(lo, hi):
        x0, x1 = forward.interval(p)
        y0, y1 = backward.interval(length - p if deletion else length - p - 1)
        ask = (x1 - x0 > 1) & (y1 - y0 > 1)
        if deletion:
            ask &= size == width
            if p:
                ask &= codes[:, p] != codes[:, p - 1]
        ask = np.flatnonzero(ask)
        for held, new in zip(asks, (ask, x0[ask], x1[ask], y0[ask], y1[ask])):
            held.append(new)
    asker, *box = map(np.concatenate, asks)
    query, y = WaveletTree(backward.rank[forward.row]).report(*box)
    i, j = asker[query], backward.row[y]
    if deletion:
        found = size[j] == length
        i, j = i[found], j[found]
        return np.concatenate([i, j]), np.concatenate([j, i])
    return i[i != j], j[i != j]


_KEY = ["deletion", "length", "lo", "hi", "prefix", "suffix"]


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the prefix before lo and the suffix after the positions [lo, hi) to rows (word, n, deletion, length, lo, hi)."""
    # A deletion at p < hi keeps what follows hi in the longer word, and so from hi - 1 on in the shorter one.
    end = F.col("hi") - F.when(F.col("deletion") & (F.char_length("word") == F.col("length")), 1).otherwise(0)
    return rows.withColumn("prefix", F.expr("substring(word, 1, lo)")).withColumn("suffix", F.substring("word", end + 1, F.char_length("word")))


def _families(words: DataFrame, limit: int) -> DataFrame:
    """Rows of words by family; a family of more than `limit` words is split at the middle of its positions."""
    size = F.char_length("word")
    roles = [(False, size), (True, size), (True, size - 1)]
    whole = F.array(*(F.struct(F.lit(d).alias("deletion"), n.alias("length"), F.lit(0).alias("lo"), (n + (1 if d else 0)).alias("hi")) for d, n in roles))
    rows = words.select("word", "n", F.explode(whole).alias("r")).select("word", "n", "r.*")

    def halved(some: DataFrame) -> DataFrame:
        middle = F.expr("(lo + hi) div 2").cast("int")
        part = lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))
        both = F.filter(F.array(part(F.col("lo"), middle), part(middle, F.col("hi"))), lambda r: r["lo"] < r["hi"])
        return _keyed(some.select("word", "n", "deletion", "length", F.explode(both).alias("r")).select("word", "n", "deletion", "length", "r.*"))

    open_, done = written(halved(rows), "families"), None
    while True:
        sizes = open_.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("size"))
        tagged = written(open_.join(written(sizes.filter("size > 1"), "sizes"), _KEY), "families")  # a word alone has no partner there
        small = tagged.filter((F.col("size") <= limit) | (F.col("hi") - F.col("lo") == 1)).drop("size")
        done = small if done is None else done.unionByName(small)
        large = tagged.filter((F.col("size") > limit) & (F.col("hi") - F.col("lo") > 1))
        if large.isEmpty():
            return done
        open_ = written(halved(large), "families")


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (word, near, near_n) of rows that come sorted by family; whole families are handled together."""
    words: list[str] = []
    counts: list[int] = []
    family: list[int] = []
    at, key, chars = None, None, 0

    def give():
        if len(words) > 1:
            deletion, length, lo, hi = at
            i, j = near_pairs(words, np.array(family), length, lo, hi, deletion)
            both, n = pa.array(words, pa.string()), pa.array(counts, pa.int64())
            for k in range(0, len(i), 100_000):
                a, b = pa.array(i[k : k + 100_000]), pa.array(j[k : k + 100_000])
                yield pa.record_batch([both.take(a), both.take(b), n.take(b)], ["word", "near", "near_n"])
        words.clear(), counts.clear(), family.clear()

    for batch in batches:
        for r in batch.to_pylist():
            now, new = (r["deletion"], r["length"], r["lo"], r["hi"]), (r["prefix"], r["suffix"])
            if now != at or (new != key and chars > CHUNK):
                yield from give()
                at, key, chars = now, None, 0
            family.append(family[-1] + (new != key) if family else 0)
            key = new
            words.append(r["word"])
            counts.append(r["n"])
            chars += len(r["word"])
    yield from give()


def variants(words: DataFrame, factor: int = 5, limit: int = FAMILY) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table (word, n) of distinct words.

    form is the near word of largest n (ties: the smallest in code-point order) if that n is at least factor times the
    word's; root follows the forms to the last. As n grows by the factor at each step, chains are short.
    """
    words = written(words, "words")
    rows = _families(words, limit).repartition(*_KEY).sortWithinPartitions(*_KEY)
    pairs = rows.mapInArrow(_reported, "word string, near string, near_n long")
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("form"))).alias("best"))
    form_n = -F.col("best.order")
    known = words.join(best, "word", "left").withColumn("good", F.coalesce(form_n >= F.col("n") * factor, F.lit(False)))
    found = written(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.expr("CASE WHEN good THEN best.form END").alias("form"), F.when(F.col("good"), form_n).alias("form_n")), "forms")
    root = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # pointer jumping
        root = written(root, "roots")
        after = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(root.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        root = step.select("word", "root")
        if step.filter("moved").isEmpty():
            break
    return found.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return variants(vocabulary(table(spark, sf_dir, "documents")))
