"""Removal of repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ripplegraph.llm import suffixes


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i + 1 : i + length + 1] = True
        edge = np.flatnonzero(gone[1:] != gone[:-1])
        kept = bytes(np.frombuffer(d, np.uint8)[~gone[1:-1]])
        out.append((len(d), list(zip(edge[::2].tolist(), edge[1::2].tolist())), kept))
    return out


def got(spark, texts, length, limit=suffixes.FAMILY):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, key string").repartition(3)
    rows = sorted(suffixes.remove_repeats(docs, length, limit=limit).collect())
    return [(r["n_bytes"], [(s["start"], s["end"]) for s in r["removed"]], bytes(r["kept"])) for r in rows]


def mixture(rng, n, size, letters):
    """Texts of random letters with pieces of each other, altered copies, periodic stretches, exact copies and odd rows."""
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, size))) for _ in range(n)]
    for _ in range(2 * n):
        a, b = rng.choice(texts), rng.randrange(n)
        i, j = rng.randint(0, len(a)), rng.randint(0, len(texts[b]))
        piece = a[i : i + rng.randint(0, size)]
        if rng.random() < 0.4 and piece:
            k = rng.randrange(len(piece))
            piece = piece[:k] + rng.choice(letters) + piece[k + 1 :]
        texts[b] = texts[b][:j] + piece + texts[b][j:]
    return [*texts, None, "", texts[0], texts[0], letters[0] * 3 * size, "ab" * size, "ab" * size + "c", "\0" * size, "é漢\U0001f600" * (size // 3)]


@pytest.mark.parametrize("length,limit,letters", [(20, 20_000, "ab"), (20, 3, "ab"), (50, 20_000, "abcdé"), (50, 2, "abcdé"), (1, 20_000, "abc"), (2, 2, "abcd")])
def test_equals_brute_force(spark, length, limit, letters):
    texts = mixture(random.Random(length + limit), 40, 4 * length + 5, letters)
    assert got(spark, texts, length, limit) == brute(texts, length)


def test_strings_across_chunks(spark, monkeypatch):
    """A text longer than a chunk loses no string at the seams; families of one passage with many neighbours."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = word(900)
    texts = [word(rng.randint(0, 300)) + passage[rng.randint(0, 30) : 900 - rng.randint(0, 300)] + word(rng.randint(0, 300)) for _ in range(60)]
    long = word(suffixes.CHUNK - 600)
    texts += [long + passage + word(500_000), word(399), passage[:399], passage[100:500]]
    assert got(spark, texts, 400, 7) == brute(texts, 400)


def test_spans_are_united(spark, monkeypatch):
    """A text of one letter is a few runs, however many strings repeat in it, and blocks do not change the result."""
    monkeypatch.setattr(suffixes, "BLOCK", 1000)
    texts = ["z" * 30_000, "ab" * 5_000 + "c", "q" * 50, "xyz" + "z" * 500]
    docs = spark.createDataFrame([(str(i).encode(), t) for i, t in enumerate(texts)], "key binary, text string")
    spans = {bytes(r["key"]): r["spans"] for r in suffixes.repeated_spans(docs, 400).collect()}
    assert set(spans) == {b"0", b"1", b"3"} and len(spans[b"0"]) == 30
    assert got(spark, texts, 400) == brute(texts, 400)


def test_query(spark, tmp_path):
    rng = random.Random(4)
    texts = mixture(rng, 30, 1500, "abcdefgh ")
    rows = [(None if i == 3 else i // 2, t, "en", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, spans string, n_bytes int").write.parquet(str(tmp_path / "documents.parquet"))
    want = [(r[0], n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for r, (n, s, k) in zip(rows, brute(texts, 400))]
    found = [tuple(r) for r in suffixes.op12_suffix_dedup(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert Counter(found) == Counter(want) and sum(r[2] for r in found) > 10_000


def test_no_rows(spark):
    assert got(spark, [], 400) == []
