"""Odd texts through every query: whole results, no crash, and base results that a plain scan gives too."""

import hashlib
import re

import pytest

import hostile
from ripplegraph.llm import lengths, queries

tokenizers = pytest.importorskip("public_tokenizers")
SIZE = 20_000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("hostile")
    texts = [None, "", *hostile.texts(SIZE), "clean words and nothing else"]
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, "u", p) for i, p in enumerate(hostile.pages(SIZE))], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen"), (2, "1 " * 20), (3, None), (4, "x" * 50_000), (5, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), texts


@pytest.mark.parametrize("name", [n for n in queries.queries() if n.startswith("op")])
def test_hostile(spark, folder, name):
    path, texts = folder
    got = queries.queries()[name](spark, path).collect()
    if name == "op4_html_text":
        assert len(got) == len(hostile.pages(SIZE)) and all(r["n_chars"] == len(r["text"]) for r in got)
    elif name == "op9_token_lengths":
        assert sum(r["n_docs"] for r in got) == len(texts)
    elif name not in ("op8_decontamination", "op11_spelling_variants"):
        assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    if name == "op3_exact_dedup":
        for r in got:
            assert r["text_sha256"] == hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", texts[r["doc_id"]] or "").encode()).hexdigest()


def test_token_counts_around_long_runs(monkeypatch):
    """With runs of three taken for very long ones, counts are the encoder's own."""
    import random

    with open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        encoding = lengths._encoding(f.read(), tokenizers.PATTERN)
    monkeypatch.setattr(lengths, "_LONG_RUN", re.compile(lengths._LONG_RUN.pattern.replace(str(lengths.LONG_RUN), "3")))
    monkeypatch.setattr(lengths, "LONG_RUN", 3)
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice(" \n\t　\xa0ab1'.,s\x1c") for _ in range(rng.randint(0, 30)))
        assert lengths.n_tokens(encoding, text) == len(encoding.encode_ordinary(text))
    monkeypatch.undo()
    for text in (" " * 1_000_000, "x" + "\n" * 1_000_000 + " y"):
        assert 0 < lengths.n_tokens(encoding, text) <= len(text)
