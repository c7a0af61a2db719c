"""Benchmark decontamination on canonical templates.

Texts become sequences of tokens in which numbers, names and units are typed placeholders. Windows of WINDOW
tokens of the benchmark items are hash-joined with those of the documents. Where windows of a document and an
item meet at the same offset, the values in their slots must be consistent: the same value of the item always
stands for the same value of the document, and different names for different names. So a question that was asked
with other numbers and names is found, and a chance resemblance of templates is not. A document is contaminated by
an item when so many consistent windows at one offset match that they span PASSAGE tokens, or all windows of a
shorter item. Consistent are all of them, or a run of neighbouring ones, or those that match with names as plain words
(all or a run), or those whose slots have the item's own values: an altered value elsewhere does not excuse a passage.

A token is a run of letters or of digits (with points and commas between digits); case and all other characters do
not matter. A number is a run of digits, a unit one of UNITS right after a number, a name a run of capitalised words
within a sentence (a word all in capitals is none): one placeholder, so that a name of two words can stand for one of one. As a
capital may have other reasons, the first word of a sentence is read as a name too, and each text is also read with names as plain words; either
reading may match. Windows with less than half plain words are no evidence in these readings. In a third one, of windows with
a number or unit, every token stands for itself, so that verbatim passages match whatever they consist of.

Words for small numbers (NUMBER_WORDS) are numbers too. An item of less than SHORTEST tokens has no windows: it contaminates a
text in which its tokens stand word for word from the start of a sentence to the end of one (SENTENCE_ENDS, or ends of the
text), whatever marks are between them.
Null texts match nothing, nor do items without a token.

A window that a text repeats m times and an item n times is one row of m and one of n places in the join. What is judged
are offsets with enough windows, the fullest first, until no other can have more. What repeats a template with ever other
values, none consistent, is judged at each of its offsets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .common import chunks, code_points, digits, letters, mix, prepare, run_hashes, table, text_or_empty

WINDOW, PASSAGE = 8, 13
SHORTEST = 5  #: tokens; shorter items must be met as whole sentences
SENTENCE_ENDS = ".!?\n"
KNOWN_SHAPES = 100  #: verdicts that are remembered at once
#: Window hashes (8 bytes each) that are broadcast at once at most; a larger benchmark is taken in several blocks.
BLOCK_WINDOWS = 2_000_000

# Units that may follow a number.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles g kg mg lb lbs pound pounds ounce ounces ton tons tonne tonnes "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "ml cl l liter liters litre litres gallon gallons percent dollar dollars cent cents euro euros usd eur gbp "
    "degree degrees c f k w kw mw v a hz khz mhz ghz b kb mb gb tb n j kj pa kpa mph kmh"
).split()

# Words that are numbers.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
).split()

WORD, NUMBER, NAME, UNIT = 0, 1, 2, 3
#: The kinds that are slots: with names (over words or runs of names), with names as plain words, and verbatim (over words).
READINGS = ((NUMBER, NAME, UNIT), (NUMBER, UNIT), ())

_SLOTS = "array<struct<k:int,v:bigint>>"
#: Per item, reading and window: its hash and its places in the item.
_ITEM = (
    "item_id bigint, item_key bigint, item_windows int, named boolean, windows int, template_windows int, template boolean, "
    f"h bigint, places array<struct<at:int,slots:{_SLOTS}>>, size int"
)
_FOUND = f"array<struct<h:bigint,spots:array<struct<pos:int,slots:{_SLOTS}>>>>"


@cache
def _folding() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of each code point (itself if that is no single one), and whether it is upper case."""
    low = np.arange(0x110000, dtype=np.uint32)
    upper = np.zeros(0x110000, np.bool_)
    for i in range(0x1F000):
        c = chr(i)
        if c != (x := c.lower()):
            upper[i] = c.isupper() or c.istitle()
            if len(x) == 1:
                low[i] = ord(x)
    return low, upper


@cache
def _hashes(words: tuple[str, ...]) -> np.ndarray:
    codes, starts = code_points(list(words))
    return np.sort(run_hashes(codes, starts + 1, starts + 1 + np.array([len(w) for w in words])))


_SLOT_HASH = mix(np.array([11, 12, 13, 14], np.uint64))


class Tokens:
    """A sequence of tokens of several texts: hashes, kinds, the text of each, whether it opens a sentence, and where each text begins."""

    def __init__(self, value: np.ndarray, kind: np.ndarray, text: np.ndarray, opens: np.ndarray, texts: int):
        self.value, self.kind, self.text, self.opens = value, kind, text, opens
        self.bounds = np.searchsorted(text, np.arange(texts + 1))

    def windows(self, size: int, slots: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which windows of this size within one text start that are evidence, and their hashes.

        Windows below SHORTEST are whole sentences, word for word.
        """
        n = len(self.value) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        free = np.isin(self.kind, slots)
        template = np.where(free, _SLOT_HASH[self.kind], self.value)
        at = self.text[:n] == self.text[size - 1 :]
        if size < SHORTEST:
            at &= self.opens[:n] & np.append(self.opens, True)[size:]
        elif slots:
            upto = np.concatenate(([0], np.cumsum(~free)))
            at &= 2 * (upto[size:] - upto[:-size]) >= size
        else:
            upto = np.concatenate(([0], np.cumsum((self.kind == NUMBER) | (self.kind == UNIT))))
            at &= upto[size:] > upto[:-size]
        at = np.flatnonzero(at)
        h = np.full(len(at), 2 * size + (NAME in slots), np.uint64)
        for k in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + template[at + k]
        return at, mix(h)

    def slots(self, at: int, size: int, kinds: tuple[int, ...]) -> list[dict]:
        return [{"k": int(self.kind[i]), "v": int(self.value[i].astype(np.int64))} for i in range(at, at + size) if self.kind[i] in kinds]


def tokens(texts: list[str]) -> tuple[Tokens, Tokens]:
    """The tokens of several texts, with each run of names within a sentence as one, and with all words apart."""
    codes, starts = code_points(texts)
    kind = letters()[codes].view(np.uint8) + 2 * digits()[codes].view(np.uint8)
    point = np.flatnonzero((codes == ord(".")) | (codes == ord(",")))
    kind[point[(kind[point - 1] == 2) & (kind[point + 1] == 2)]] = 2
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    begin = change[kind[change] != 0]
    end = change[kind[change - 1] != 0]
    low, upper = _folding()
    value = run_hashes(low[codes], begin, end)
    text = np.searchsorted(starts, begin, side="right") - 1
    what = np.where(kind[begin] == 2, NUMBER, WORD).astype(np.int8)
    joined, opens = np.zeros(len(begin), np.bool_), np.zeros(len(begin), np.bool_)
    if len(begin):
        what[upper[codes[begin]] & (end - begin > 1) & ~upper[codes[begin + 1]] & (what == WORD)] = NAME
        words = np.flatnonzero(what != NUMBER)
        what[words[np.isin(value[words], _hashes(tuple(NUMBER_WORDS)))]] = NUMBER
        after = np.concatenate(([False], (what[:-1] == NUMBER) & (text[1:] == text[:-1])))
        maybe = np.flatnonzero(after & (what != NUMBER))
        what[maybe[np.isin(value[maybe], _hashes(tuple(UNITS)))]] = UNIT
        breaks = np.concatenate(([0], np.cumsum(np.isin(codes, np.array([ord(x) for x in SENTENCE_ENDS], np.uint32)) & (kind == 0))))
        opens[0] = True
        opens[1:] = (text[1:] != text[:-1]) | (breaks[begin[1:]] != breaks[end[:-1]])
        joined[1:] = (what[1:] == NAME) & (what[:-1] == NAME) & ~opens[1:]
    first = np.flatnonzero(~joined)
    place = (np.arange(len(begin)) - np.repeat(first, np.diff(np.append(first, len(begin))))).astype(np.uint64)
    names = np.add.reduceat(np.where(place > 0, mix(value + place), value), first) if len(first) else value
    return Tokens(names, what[first], text[first], opens[first], len(texts)), Tokens(value, what, text, opens, len(texts))


def _item_windows(size: int):
    names = _arrow_items().names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                named, plain = tokens([text or ""])
                if not (own := min(size, len(plain.value))):
                    continue
                for t, readings in ((plain, READINGS[2:]),) if own < SHORTEST else ((named, READINGS[:1]), (plain, READINGS[1:])):
                    if len(t.value) < min(own, SHORTEST):
                        continue
                    width = min(own, len(t.value))
                    found: dict[tuple[bool, int], list] = {}
                    usable = set()
                    for kinds in readings:
                        for a, h in zip(*(v.view(np.int64).tolist() for v in t.windows(width, kinds))):
                            # Of verbatim windows the values are kept too, as each stands for itself.
                            found.setdefault((bool(kinds), h), []).append({"at": a, "slots": t.slots(a, width, kinds or READINGS[0])})
                            if kinds:
                                usable.add(a)
                    rows += [(item, key, len(plain.value) - own + 1, t is named, len(t.value) - width + 1, len(usable), template, h, places, width) for (template, h), places in found.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=_arrow_items())

    return run


def _slots() -> pa.DataType:
    return pa.list_(pa.struct([("k", pa.int32()), ("v", pa.int64())]))


def _arrow_items() -> pa.Schema:
    place = pa.list_(pa.struct([("at", pa.int32()), ("slots", _slots())]))
    return pa.schema([("item_id", pa.int64()), ("item_key", pa.int64()), ("item_windows", pa.int32()), ("named", pa.bool_()), ("windows", pa.int32()), ("template_windows", pa.int32()), ("template", pa.bool_()), ("h", pa.int64()), ("places", place), ("size", pa.int32())])


def _finder(spark: SparkSession, hashes: np.ndarray, sizes: list[int]):
    """A function of a text column: the windows of the text whose hash is among these, with all their places."""
    bits = np.zeros(1 << 21, np.bool_)
    bits[(hashes.view(np.uint64) & np.uint64((1 << 21) - 1)).astype(np.int64)] = True
    shared = spark.sparkContext.broadcast((np.sort(hashes), np.packbits(bits).tobytes()))

    spots = pa.list_(pa.struct([("pos", pa.int32()), ("slots", _slots())]))

    @F.arrow_udf(_FOUND)
    def find(texts: pa.Array) -> pa.Array:
        known, packed = shared.value
        maybe = np.unpackbits(np.frombuffer(packed, np.uint8)).view(np.bool_)
        out: list[list[dict]] = []
        for part in chunks([t or "" for t in texts.to_pylist()]):
            named, plain = tokens(part)
            found: list[dict[int, list]] = [{} for _ in part]
            for size in sizes:
                for t, kinds in ((plain, READINGS[2]),) if size < SHORTEST else ((named, READINGS[0]), (plain, READINGS[1]), (plain, READINGS[2])):
                    at, h = t.windows(size, kinds)
                    near = np.flatnonzero(maybe[(h & np.uint64((1 << 21) - 1)).astype(np.int64)])
                    signed = h[near].view(np.int64)
                    place = np.minimum(np.searchsorted(known, signed), len(known) - 1)
                    for i, x in zip(*(v[known[place] == signed].tolist() for v in (near, signed))):
                        a = int(at[i])
                        own = int(t.text[a])
                        found[own].setdefault(x, []).append({"pos": a - int(t.bounds[own]), "slots": t.slots(a, size, kinds)})
            out += [[{"h": h, "spots": places} for h, places in some.items()] for some in found]
        return pa.array(out, pa.list_(pa.struct([("h", pa.int64()), ("spots", spots)])))

    return find


def _runs(rows: list[tuple[int, list]]) -> tuple[int, bool]:
    """The longest run of neighbouring positions whose slots are consistent, and whether one has another value.

    rows: (position, [(kind, item's value, document's value)]) in order of position, with one or more a position.
    """
    forth: dict[tuple, dict] = {}  # what each value of the item stands for, and which names a name stands for
    crowded, best, other = 0, 0, False

    def count(bound: list, by: int) -> int:
        change = 0
        for k, i, d in bound:
            for key, value in [((k, i), d)] + ([((-1, d), i)] if k == NAME else []):
                held = forth.setdefault(key, {})
                change -= len(held) > 1
                held[value] = held.get(value, 0) + by
                if not held[value]:
                    del held[value]
                change += len(held) > 1
        return change

    merged: dict[int, list] = {}
    for at, bound in rows:
        merged.setdefault(at, []).extend(bound)
    places = sorted(merged)
    start = 0
    for end, at in enumerate(places):
        if end and at != places[end - 1] + 1:
            forth.clear()
            start, crowded = end, 0
        crowded += count(merged[at], 1)
        while crowded:
            crowded += count(merged[places[start]], -1)
            start += 1
        if end - start + 1 > best:
            best = end - start + 1
            other = any(i != d for p in places[start : end + 1] for _, i, d in merged[p])
    return best, other


def _consistent(rows: list[tuple[int, list]]) -> bool:
    bound = {x for _, pairs in rows for x in pairs}
    names = [x for x in bound if x[0] == NAME]
    return len({x[:2] for x in bound}) == len(bound) and len({x[2] for x in names}) == len(names)


def judged(rows: list[tuple[int, bool, list]], least: int, windows: int, template_windows: int) -> tuple[int, bool]:
    """The most consistent windows of an occurrence, and whether a slot there has another value; 0 if they are too few.

    rows: (position, whether the window is one of a template, [(kind, item's value, document's value)]).
    """
    plain = lambda some: [(at, t, [x for x in b if x[0] != NAME]) for at, t, b in some if not t or all(x[0] != NAME for x in b)]
    template = [r for r in rows if r[1]]
    best = (0, False)
    for some, need in ((rows, windows), (template, template_windows), (plain(rows), windows), (plain(template), template_windows)):
        need, pool = min(least, need), [(at, b) for at, _, b in some]
        if not pool:
            continue
        found = (len({at for at, _ in pool}), any(i != d for _, b in pool for _, i, d in b)) if _consistent(pool) else _runs(pool)
        if found[0] >= max(1, need) and found[0] > best[0]:
            best = found
    verbatim = [(at, t) for at, t, b in rows if all(i == d for _, i, d in b)]
    for some, need in ((verbatim, windows), ([x for x in verbatim if x[1]], template_windows)):
        n = len({at for at, _ in some})
        if n >= max(1, min(least, need)) and n > best[0]:
            best = (n, False)
    return best


def best_offset(met: list[dict], least: int, windows: int, template_windows: int) -> tuple[int, int, bool]:
    """The most consistent windows at one offset of a text to an item, the least such offset, and whether a slot has another value.

    met: the windows that both have: whether of a template, their places (at, slots) in the item and spots (pos, slots) in the
    text. Every offset that has enough windows is judged, unless it has fewer than the best one found, or its values are those
    of one judged before but for their names.
    """
    spots = [{s["pos"]: s["slots"] for s in m["spots"]} for m in met]
    positions = [np.fromiter(s, np.int64, len(s)) for s in spots]
    by_place: dict[int, list[tuple[int, list]]] = {}  # what the item has at each of its positions
    for k, m in enumerate(met):
        for p in m["places"]:
            by_place.setdefault(p["at"], []).append((k, p["slots"]))
    low = min(int(p.min()) for p in positions) - max(by_place)
    count = np.zeros(max(int(p.max()) for p in positions) - min(by_place) - low + 1, np.int32)
    joint: dict[tuple, np.ndarray] = {}
    for at, some in by_place.items():
        own = tuple(k for k, _ in some)
        if own not in joint:
            joint[own] = positions[own[0]] if len(own) == 1 else np.unique(np.concatenate([positions[k] for k in own]))
        count[joint[own] - (at + low)] += 1
    enough = np.flatnonzero(count >= max(1, min(least, windows, template_windows or windows)))
    best, known = (0, 0, False), {}
    for i in enough[np.argsort(-count[enough], kind="stable")].tolist():
        offset = i + low
        if (count[i], -offset) < (best[0], -best[1]):
            break
        rows = []
        for at, some in by_place.items():
            for k, own in some:
                if (slots := spots[k].get(at + offset)) is not None:
                    other = own if len(slots) < len(own) else slots  # fewer: a verbatim window
                    rows.append((at, met[k]["template"], [(a["k"], a["v"], b["v"]) for a, b in zip(own, other)]))
        labels: dict[int, int] = {}
        shape = tuple((at, template, *((labels.setdefault(d, len(labels)), i == d) for _, i, d in bound)) for at, template, bound in rows)
        if (verdict := known.get(shape)) is None:
            if len(known) == KNOWN_SHAPES:
                known.clear()
            verdict = known[shape] = judged(rows, least, windows, template_windows)
        matched, changed = verdict
        if (matched, -offset) > (best[0], -best[1]) and matched:
            best = (matched, offset, changed)
    return best


def _judge(least: int):
    @F.arrow_udf("struct<matched:int,first:int,other:boolean>")
    def judge(met: pa.Array, windows: pa.Array, template_windows: pa.Array) -> pa.Array:
        found = [best_offset(some.as_py(), least, n, m) for some, n, m in zip(met, windows.to_pylist(), template_windows.to_pylist())]
        return pa.array([dict(zip(("matched", "first", "other"), x)) for x in found], pa.struct([("matched", pa.int32()), ("first", pa.int32()), ("other", pa.bool_())]))

    return judge


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, passage: int = PASSAGE) -> DataFrame:
    """One row per document and benchmark item that contaminates it.

    Columns: doc_id; row_hash, of the document's id and text; item_id; matched_windows, the most consistent windows at
    one offset; item_windows, all of the item; reparameterised, whether a slot there has another value than in the item.
    Rows of the same id and text count once, among documents as among items.
    """
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item_key"), "text").filter("text IS NOT NULL").dropDuplicates(["item_id", "item_key"])
    sized = written(items.mapInArrow(_item_windows(window), _ITEM), "windows")
    blocks = max(1, -(-sized.count() // BLOCK_WINDOWS))
    sizes = [r["size"] for r in sized.select("size").distinct().collect()]  # at most `window` values
    work = docs.select("doc_id", F.xxhash64(F.col("doc_id"), F.col("text")).alias("row_hash"), text_or_empty().alias("text"))
    met = None
    for block in range(blocks):
        own = sized.filter(F.pmod("h", F.lit(blocks)) == block)
        hashes = own.select("h").distinct().toArrow()["h"].to_numpy()
        if not len(hashes):
            continue
        hits = work.select("doc_id", "row_hash", F.explode(_finder(spark, hashes, sizes)(F.col("text"))).alias("w")).select("doc_id", "row_hash", "w.h", "w.spots")
        part = hits.join(own.drop("size"), "h")
        met = part if met is None else met.unionByName(part)
    if met is None:
        return spark.createDataFrame([], T.StructType([docs.schema["doc_id"], T.StructField("row_hash", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("matched_windows", T.LongType()), T.StructField("item_windows", T.IntegerType()), T.StructField("reparameterised", T.BooleanType())]))
    # A group has no more places than the text and the item have windows, in at most three readings each.
    key = ["doc_id", "row_hash", "item_id", "item_key", "item_windows"]
    rows = F.collect_list(F.struct("template", "places", "spots")).alias("met")
    pairs = met.groupBy(*key, "named", "windows", "template_windows").agg(rows)
    judged = pairs.select(*key, _judge(max(1, passage - window + 1))("met", "windows", "template_windows").alias("found")).filter("found.matched > 0")
    best = F.max(F.struct(F.col("found.matched").cast("long").alias("matched_windows"), F.negative("found.first").alias("first"), F.col("found.other").alias("other")))
    return judged.groupBy(*key).agg(best.alias("best")).select("doc_id", "row_hash", "item_id", F.col("best.matched_windows").alias("matched_windows"), "item_windows", F.col("best.other").alias("reparameterised"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no benchmark item contaminates, with the columns of docs."""
    # Written, so that the planner knows its size before it decides whether the texts must be shuffled.
    bad = written(contaminated(docs, benchmark).select("row_hash").distinct(), "contaminated")
    work = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id"), F.col("text")).alias("row_hash"))
    return work.join(bad, "row_hash", "left_anti").select("row.*")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_hash")
