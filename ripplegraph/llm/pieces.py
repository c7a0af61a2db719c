"""Exact SentencePiece BPE encoding by backtracking, and decoding.

A sequence of vocabulary tokens is the BPE encoding of its text exactly when every pair of adjacent tokens is:
when merging the text of the two from single characters anew gives these two tokens again. So the encoder walks
from left to right: one pass of an Aho-Corasick automaton over the text has listed the longest match at each position; the
longest compatible prefix of it that is a token is taken, and where none fits the walk goes back to the last token and
shortens it. As the
encoding of a prefix is unique, a position from which no token fits can be no token boundary at all; a bit field
remembers such positions, so no position is tried twice.

Merges never cross a place between two characters that no token has side by side (in the usual vocabulary: before
a word mark after another character, between letters and other characters, around characters that no longer token
contains). Between such places the text is a sequence of independent segments, and those seen lately are looked up.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, table, text_or_empty

MARK = "▁"
WALK = 20_000  #: segments that walk together
RECENT, SEGMENTS = 120_000, 100_000  #: words and segments in half a table of results
SEEN_LENGTH = 48  #: the longest text whose result is held
PAIRS = 100_000  #: pairs of tokens held as text; the walk of many segments has a table of its own


class Vocabulary:
    """The pieces of a BPE model file whose normaliser is the identity; anything else is refused."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb2

        proto = pb2.ModelProto()
        proto.ParseFromString(model)
        kinds, norm = proto.SentencePiece, proto.normalizer_spec
        plain = norm.name == "identity" and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        if proto.trainer_spec.model_type != pb2.TrainerSpec.BPE or not plain or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with the identity normaliser and word marks as prefixes are supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = norm.add_dummy_prefix
        self.unknown_surface = proto.trainer_spec.unk_surface
        self.fallback = proto.trainer_spec.byte_fallback
        self.pieces = [p.piece for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.controls = [i for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL]
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        for number, piece in enumerate(sorted(vocabulary.ids)):
            if len(piece) > 1:  # tokens of one character are looked up
                self.automaton.add_word(piece, number)
        if len(self.automaton):
            self.automaton.make_automaton()
        long = [p for p in vocabulary.ids if len(p) > 1]
        joined = sorted({c for p in long for c in p} - {MARK})
        pairs = {(a, b) for p in long for a, b in zip(p, p[1:])}
        kinds = [[c for c in joined if c.isalpha()], [c for c in joined if not c.isalpha()]]
        self.split_at_space = not any(b == MARK != a for a, b in pairs)
        if any(MARK not in x and x[0].isalpha() != x[1].isalpha() for x in pairs):
            kinds = [joined]  # tokens mix letters with other characters
        if not self.split_at_space:
            kinds = [[*joined, MARK]]
        body = "|".join(f"[{''.join(map(re.escape, k))}]+" for k in kinds if k)
        alone = f"[^{''.join(map(re.escape, joined))}{MARK}]"
        self.segments = re.compile(f"{MARK}*(?:{body})|{MARK}+|{alone}" if self.split_at_space else f"{body}|{alone}")
        self.pair: dict[tuple[str | None, str], bool] = {}
        self.seen = _Recent(self.fresh, SEGMENTS)
        self.prefixes: dict[str, list[int]] = {}
        self.word = _Recent(self.word_ids, RECENT)
        self.tables = _Tables(self)
        self.surface = [p.replace(MARK, " ").encode() for p in vocabulary.pieces]
        for byte, i in vocabulary.bytes.items():
            self.surface[i] = bytes([byte])
        for i in vocabulary.controls:
            self.surface[i] = b""
        self.surface[vocabulary.unknown] = vocabulary.unknown_surface.encode()
        self.flat = np.frombuffer(b"".join(self.surface), np.uint8)
        self.size = np.array([len(x) for x in self.surface], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def merged(self, text: str) -> list[str]:
        """Plain BPE: merge the pair with the best score, the leftmost of equals, until none is in the vocabulary."""
        parts, score = list(text), self.v.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def agrees(self, left: str | None, right: str) -> bool:
        """Whether merging anew the text of both tokens gives these tokens."""
        return self.merged((left or "") + right) == ([left, right] if left else [right])

    def fits(self, left: str | None, right: str) -> bool:
        """As agrees(), with the answers held."""
        ok = self.pair.get((left, right))
        if ok is None:
            if len(self.pair) > PAIRS:
                self.pair.clear()
            ok = self.pair[left, right] = self.agrees(left, right)
        return ok

    def lengths(self, token: str) -> list[int]:
        """Lengths of the prefixes of a match that are tokens, in ascending order; one character always is a token."""
        ids = self.v.ids
        if len(self.prefixes) > 200_000:
            self.prefixes.clear()
        got = self.prefixes[token] = [k for k in range(1, len(token) + 1) if k == 1 or token[:k] in ids]
        return got

    def tokens(self, text: str) -> list[str]:
        """The BPE tokens of a text by backtracking."""
        size = len(text)
        if size < 2:
            return list(text)
        failed = bytearray(size // 8 + 1)
        out: list[str] = []
        tried: list[int] = []  # for each token so far, which of the options at its start it was
        pair, prefixes = self.pair, self.prefixes
        lengths = np.append(self.tables.length, 1)[self.tables.longest(text)].tolist()  # a character that is no token stands alone
        at, left, shorter, tried_here = 0, None, -1, False
        while at < size:
            match = text[at : at + lengths[at]]
            options = prefixes.get(match) or self.lengths(match)
            option = shorter if tried_here else len(options) - 1
            while option >= 0:
                end = at + options[option]
                if not failed[end >> 3] >> (end & 7) & 1:
                    token = text[at:end]
                    if pair.get((left, token)) or self.fits(left, token):
                        break
                option -= 1
            if option >= 0:
                tried.append(option)
                out.append(token)
                at, left, tried_here = end, token, False
            elif out:
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(out.pop())
                shorter, left, tried_here = tried.pop() - 1, out[-1] if out else None, True
            else:
                raise AssertionError("a text without an encoding")
        return out

    def walk(self, texts: list[str]) -> list[bytes]:
        """Ids of many short texts as 32-bit integers: the same walk as in tokens(), one step of all texts at a time.

        Only for texts all of whose characters are tokens.
        """
        t = self.tables
        joined = "".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        begin = ends - sizes
        total = len(joined)
        # No token holds the character in between, so no match crosses from one text into the next.
        longest = t.longest(t.between.join(texts) + t.between)[np.arange(total) + np.repeat(np.arange(len(texts)), sizes)]
        failed = np.zeros(total + 1, np.bool_)
        chosen = np.full(total, -1, np.int32)  # the token that starts here, if one does
        came = np.full(total + 1, -1, np.int64)  # the start of the token that ends here
        none = len(t.length)
        at, limit = begin.copy(), ends
        token = longest[at]
        left = np.full(len(texts), none, np.int64)
        live = np.flatnonzero(sizes > 0)
        while len(live):
            a, k, l = at[live], token[live], left[live]
            stuck = k < 0
            go = np.flatnonzero(~stuck)
            stop = a[go] + t.length[k[go]]
            free = ~failed[stop]
            fit = np.zeros(len(go), np.bool_)
            if free.any():
                fit[free] = t.fits(l[go[free]], k[go[free]])
            yes, no = go[fit], go[~fit]
            token[live[no]] = t.shorter[k[no]]
            i = live[yes]
            chosen[a[yes]] = k[yes]
            came[stop[fit]] = a[yes]
            at[i], left[i] = stop[fit], k[yes]
            inside = i[at[i] < limit[i]]
            token[inside] = longest[at[inside]]
            back = live[stuck]
            if len(back):
                failed[at[back]] = True
                before = came[at[back]]
                if (before < begin[back]).any():
                    raise AssertionError("a text without an encoding")
                token[back] = t.shorter[chosen[before]]
                chosen[before] = -1
                at[back] = before
                prior = np.where(before > begin[back], came[before], -1)
                left[back] = np.where(prior >= 0, chosen[np.maximum(prior, 0)], none)
            live = live[(at[live] < limit[live])]
        there = chosen >= 0
        ids = t.ids[chosen[there]].tobytes()
        upto = np.concatenate(([0], np.cumsum(there)))
        cut = 4 * upto[np.concatenate((begin, [total]))]
        return [ids[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def learn(self, texts: list[str]) -> None:
        """Encodes at once the segments of these texts that are not held yet, for encode() to look up."""
        if not self.split_at_space or not self.v.prefix:
            return
        words: set[str] = set()
        for text in texts:
            words.update(text.split(" "))
        new = self.word.absent(words)
        split = {w: self.segments.findall(MARK + w) for w in new if len(w) < SEEN_LENGTH}
        simple = self.tables.simple
        todo = [s for s in self.seen.absent({s for parts in split.values() for s in parts}) if simple(s)]
        for start in range(0, len(todo), WALK):
            part = todo[start : start + WALK]
            self.seen.add(dict(zip(part, self.walk(part))))
        ids = self.seen.__getitem__
        self.word.add({w: ids(parts[0]) if len(parts) == 1 else b"".join(map(ids, parts)) for w, parts in split.items()})

    def token_ids(self, token: str) -> list[int]:
        i = self.v.ids.get(token)
        if i is not None:
            return [i]
        if self.v.fallback:
            return [self.v.bytes[b] for b in token.encode()]
        return [self.v.unknown]

    def fresh(self, text: str) -> bytes:
        tokens = self.tokens(text)
        try:
            return array("i", map(self.v.ids.__getitem__, tokens)).tobytes()
        except KeyError:
            return array("i", [i for t in tokens for i in self.token_ids(t)]).tobytes()

    def word_ids(self, word: str) -> bytes:
        """Ids of a word after a space."""
        return b"".join(map(self.seen.__getitem__, self.segments.findall(MARK + word)))

    def encode(self, text: str) -> np.ndarray:
        """Ids as the sentencepiece library gives them, without begin and end."""
        if not text:
            return np.zeros(0, np.int32)
        if self.split_at_space and self.v.prefix and MARK not in text:
            words = text.split(" ")
            if "" not in words:
                return np.frombuffer(b"".join(map(self.word.__getitem__, words)), np.int32)
        text = (MARK if self.v.prefix else "") + text.replace(" ", MARK)
        return np.frombuffer(b"".join(map(self.seen.__getitem__, self.segments.findall(text))), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids as the sentencepiece library gives it."""
        return self.decode_all([ids])[0]

    def decode_all(self, lists: list[np.ndarray]) -> list[str]:
        """The texts of several lists of ids; the bytes of all tokens are gathered at once."""
        ids = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        size = self.size[ids]
        end = np.cumsum(size)
        data = self.flat[np.arange(end[-1] if len(end) else 0) + np.repeat(self.start[ids] - (end - size), size)].tobytes()
        cut = np.concatenate(([0], end))[np.concatenate(([0], np.cumsum([len(x) for x in lists])))].tolist()
        return [self._shown(own, data[a:b]) for own, a, b in zip(lists, cut, cut[1:])]

    def _shown(self, ids: np.ndarray, data: bytes) -> str:
        if self.v.prefix and data[:1] == b" " and self.v.pieces[self._first_shown(ids)].startswith(MARK):
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return _lenient(data)

    def _first_shown(self, ids: np.ndarray) -> int:
        return next((int(i) for i in ids if self.surface[i]), 0)


class _Recent(dict):
    """Results of a function by its argument. When too many are held, the older half goes, but for those asked for again."""

    def __init__(self, function, size: int):
        super().__init__()
        self.function, self.size, self.older = function, size, {}

    def __missing__(self, text: str) -> bytes:
        got = self.older.get(text)
        if got is None:
            got = self.function(text)
            if len(text) > SEEN_LENGTH:
                return got
        self.add({text: got})
        return got

    def add(self, results: dict[str, bytes]) -> None:
        if len(self) + len(results) > self.size:
            self.older = dict(self)
            self.clear()
        self.update(results)

    def absent(self, texts: set[str]) -> list[str]:
        """Those of these texts whose results are not held; results in the older half move to the newer one."""
        older, again, out = self.older, {}, []
        for text in texts:
            if text not in self:
                if text in older:
                    again[text] = older[text]
                else:
                    out.append(text)
        self.add(again)
        return out


class _Tables:
    """The vocabulary as arrays. Tokens are numbered by their place in the sorted list of pieces; -1 is none."""

    SLOTS = 1 << 20

    def __init__(self, e: Encoder):
        self.e = e
        self.text = sorted(e.v.ids)
        number = {p: i for i, p in enumerate(self.text)}
        self.ids = np.array([e.v.ids[p] for p in self.text], np.int32)
        self.length = np.array([len(p) for p in self.text], np.int64)
        self.shorter = np.array([next((number[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in number), -1) for p in self.text], np.int32)
        singles = {p for p in self.text if len(p) == 1}
        self.singles = re.compile(f"[{''.join(map(re.escape, sorted(singles)))}]*") if singles else None
        self.automaton = e.automaton
        # pairs known to fit or not, in a table with one place for each hash
        self.key = np.full(self.SLOTS, -1, np.int64)
        self.value = np.zeros(self.SLOTS, np.bool_)
        held = {c for p in self.text for c in p}
        self.single = np.full(0x110000, -1, np.int32)
        self.single[[ord(p) for p in self.text if len(p) == 1]] = [number[p] for p in self.text if len(p) == 1]
        self.between = next(c for c in map(chr, range(1, 0x110000)) if c not in held)

    def simple(self, text: str) -> bool:
        return self.singles is not None and self.singles.fullmatch(text) is not None

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def longest(self, text: str) -> np.ndarray:
        """The longest token that starts at each position (-1: none), from one pass of the automaton.

        It reports tokens by their ends, so of those with one start the last is the longest.
        """
        out = self.single[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        if len(self.automaton):
            flat = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64)
            end, token = flat[::2], flat[1::2]
            out[end + 1 - self.length[token]] = token
        return out

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether re-merging two tokens gives them again; left len(length) is no token."""
        key = left * (len(self.length) + 1) + right
        slot = self._hash(key)
        ok = self.value[slot]
        new = np.flatnonzero(self.key[slot] != key)
        if len(new):
            some, where = np.unique(key[new], return_inverse=True)
            base = len(self.length) + 1
            text = [*self.text, None]
            found = np.array([self.e.agrees(text[x // base], text[x % base]) for x in some.tolist()], np.bool_)
            ok[new] = found[where]
            slot = self._hash(some)
            self.key[slot], self.value[slot] = some, found
            again = self.key[slot] == some  # two new keys of one slot: the last one holds it
            self.value[slot[again]] = found[again]
        return ok


def _lenient(data: bytes) -> str:
    """UTF-8 with a replacement character for every byte that belongs to no valid character."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(2)
def encoder(model: bytes) -> Encoder:
    return Encoder(Vocabulary(model))


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "pieces") -> DataFrame:
    """docs with a struct column: ids (array of int), and decoded, the text that decoding these ids gives.

    The driver reads the model file; its bytes (below a megabyte) travel with the function. A null text counts
    as empty and has no ids. Memory on a worker is bounded by a batch and the tables of segments seen.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    Vocabulary(model.value)

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def run(texts: pa.Array) -> pa.Array:
        e = encoder(model.value)
        ids, decoded = [], []
        for part in chunks(texts.to_pylist(), 1_000_000):
            e.learn(part)
            found = list(map(e.encode, part))
            ids += found
            for i in range(0, len(found), 64):
                decoded += e.decode_all(found[i : i + 64])
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        sizes = np.cumsum([0, *map(len, ids)])
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat)), pa.array(decoded, pa.string())], ["ids", "decoded"])

    return docs.withColumn(out_col, run(text_or_empty(text_col)))


def digests(docs: DataFrame, out_col: str = "pieces") -> DataFrame:
    p = F.col(out_col)
    return docs.select(
        "doc_id",
        F.size(p["ids"]).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(p["ids"].cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(p["decoded"], 256).alias("decoded_sha256"),
    )


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode_decode(docs, model_path))
