"""Spelling variants against brute force: vocabulary, near words, forms and roots."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ripplegraph.llm import spelling


def brute_vocabulary(rows, every=199):
    out = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute_variants(count, factor=5):
    form, out = {}, {}
    for w, n in count.items():
        near = [v for v in count if v != w and is_near(v, w)]
        best = min(near, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= factor * n else None
        out[w] = [len(near)]
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (w, form[w], root, count[w], out[w][0], count[form[w]] if form[w] is not None else None)
    return set(out.values())


def rows_of(df):
    return [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]


@pytest.mark.parametrize("limit", [3, 20_000])
def test_variants_equal_brute_force(spark, limit):
    """Small alphabets make many near words, runs of equal letters and chains; limit 3 splits families to the end."""
    rng = random.Random(5)
    count = {}
    while len(count) < 500:
        count["".join(rng.choice("aabé") for _ in range(rng.randint(6, 9)))] = int(5 ** rng.uniform(1, 7))
    count |= {"q" * 400: 7, "q" * 401: 90, "lonelyword": 5}
    got = rows_of(spelling.variants(spark.createDataFrame(list(count.items()), "word string, n long"), limit=limit))
    assert len(got) == len(count) and set(got) == brute_variants(count)


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).collect() == []
    assert rows_of(spelling.variants(spark.createDataFrame([("single", 9)], "word string, n long"))) == [("single", None, "single", 9, 0, None)]


def test_query_equals_brute_force(spark, tmp_path):
    """Nulls, empty and odd texts, repeated rows and ids, a clashing column."""
    rng = random.Random(2)
    base = ["garden", "gärten", "window", "ÀBCDEF", "shadow", "×÷×÷×÷", "morning"]
    texts = [" ".join(rng.choice(base).title() if rng.random() < 0.2 else rng.choice(base) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for k in range(60):
        texts[k] += " gardn windows, shadox; shadox1shadox morningg"
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(None, texts[1]), (7, None), (8, ""), (9, "x" * 50_000), (9, "漢 \U0001f600 ſgarden")]
    spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, word int").write.parquet(str(tmp_path / "documents.parquet"))
    expected = brute_variants(brute_vocabulary(rows))
    got = rows_of(spelling.op11_spelling_variants(spark, str(tmp_path)))
    assert len(expected) > 8 and len(got) == len(expected) and set(got) == expected


def test_wavelet_tree_reports_all_points():
    rng = np.random.default_rng(1)
    values = rng.permutation(77)
    x0, y0 = rng.integers(0, 77, 50), rng.integers(0, 77, 50)
    x1, y1 = np.minimum(77, x0 + rng.integers(0, 40, 50)), np.minimum(77, y0 + rng.integers(0, 40, 50))
    query, y = spelling.WaveletTree(values).report(x0, x1, y0, y1)
    want = {(q, int(v)) for q in range(50) for v in values[x0[q] : x1[q]] if y0[q] <= v < y1[q]}
    assert len(query) == len(want) and set(zip(query.tolist(), y.tolist())) == want
