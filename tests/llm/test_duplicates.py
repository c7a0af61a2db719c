"""Exact and near deduplication, and the pipeline, against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ripplegraph.llm import dedup, neardup


def documents(spark, texts):
    rows = [(i, t, "en", "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, again string, digest string")


def test_exact_dedup(spark):
    texts = ["a  b", "a b", "a\n\tb", "ab", None, "", " ", "x" * 100_000, "x" * 100_000, "A b"]
    docs = documents(spark, texts).union(documents(spark, ["a b"])).union(documents(spark, ["z"]).withColumn("doc_id", F.lit(None).cast("long")))
    got = dedup.exact_dedup(docs).collect()
    assert len(got) == 12
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    for r in got:
        if r["doc_id"] is None:
            assert r["kept"] and r["group_size"] == 1
            continue
        same = [i for i, t in enumerate([*texts]) if norm(t) == norm(texts[r["doc_id"]])] + ([0] if norm(texts[r["doc_id"]]) == "a b" else [])
        assert r["keep_id"] == min(same) and r["group_size"] == len(same)
    assert sum(r["kept"] for r in got) == len({norm(t) for t in texts}) + 1
    kept = dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len({norm(t) for t in texts}) + 1
    assert dedup.exact_dedup(docs.limit(0)).count() == 0 and dedup.drop_duplicates(docs.limit(0)).count() == 0


def test_filter_never_misses_a_repeat(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(-(2**63), 2**63, 5000), np.repeat(rng.integers(-(2**63), 2**63, 50), 2)])
    table = spark.createDataFrame([(int(v),) for v in values], "h long").repartition(7)
    flagged = {r["h"] for r in table.filter(dedup.repeat_filter(table, 20)("h")).collect()}  # crowded: 2^16 bits for 5100 values
    repeated = set(values[5000:].tolist())
    assert repeated <= flagged
    few = table.filter(dedup.repeat_filter(table, len(values))("h")).distinct().count()
    assert few < 50 + 0.05 * len(values)


def brute_classes(texts):
    bags = []
    for t in texts:
        _, h, w = neardup.bags([t or ""])
        bags.append((h, w))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or neardup.similarity(bags[i], bags[j]) >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_near_duplicates(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for size in (1, 2, 3, 12, 25):
        base = [word() for _ in range(150)]
        for k in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 8])):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    texts += ["", "", "one two", "one two", "one two three", "q " * 3000, "q " * 3000 + "r"]
    got = {r["doc_id"]: r for r in neardup.near_duplicates(documents(spark, texts)).collect()}
    want = brute_classes(texts)
    assert [got[i]["class_id"] for i in range(len(texts))] == want
    assert sum(r["kept"] for r in got.values()) == len(set(want))
    kept = neardup.drop_near_duplicates(documents(spark, texts))
    assert {r["doc_id"] for r in kept.collect()} == set(want) and kept.columns == documents(spark, texts).columns


def test_near_duplicates_edges(spark):
    docs = documents(spark, [None, "", "a b c d e f g"]).union(documents(spark, [None, "", "a b c d e f g"])).withColumn("doc_id", F.when(F.col("text") == "", None).otherwise(F.col("doc_id")))
    got = neardup.near_duplicates(docs)
    assert got.count() == 6 and got.filter("kept").count() == 2
    assert neardup.drop_near_duplicates(docs).count() == 2
    assert neardup.near_duplicates(docs.limit(0)).count() == 0 and neardup.drop_near_duplicates(docs.limit(0)).count() == 0


def test_similarity_and_signatures():
    rng = np.random.default_rng(3)
    for _ in range(30):
        ids = np.arange(1, 40, dtype=np.uint64)
        wa, wb = rng.integers(0, 4, 39).astype(float), rng.integers(0, 4, 39).astype(float)
        a, b = (ids[wa > 0], wa[wa > 0].astype(np.uint64)), (ids[wb > 0], wb[wb > 0].astype(np.uint64))
        want = sum(1 / sum(max(wa[j] / wa[i], wb[j] / wb[i]) for j in range(39)) for i in range(39) if wa[i] and wb[i])
        assert abs(neardup.similarity(a, b) - want) < 1e-9
        text = np.concatenate([np.zeros(len(a[0]), np.int64), np.ones(len(b[0]), np.int64)])
        s = neardup.signatures(2, text, neardup.mix(np.concatenate([a[0], b[0]])), np.concatenate([a[1], b[1]]), 4000)
        assert abs((s[0] == s[1]).mean() - want) < 0.05


def test_pipeline_by_brute_force(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import sentencepiece
    import public_tokenizers

    import corpus_pipeline
    from ripplegraph.llm import decontam, quality

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    good = [" ".join(word() for _ in range(60)) for _ in range(20)]
    item = " ".join(word() for _ in range(20))
    texts = [*good, good[0], good[1].replace(" ", "  "), good[2] + " end", good[3] + " " + item, None, "", *(" ".join(["spam"] * 50) for _ in range(20))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 20), 0) for i in range(len(texts)) if i < 20 or i >= 26], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    weights = quality.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")).filter("crc32(cast(doc_id as string)) % 3 <> 1"))
    rows = [(i, t) for i, t in enumerate(texts) if quality.scores([t or ""], weights)[0] >= 0.5]
    seen, rest = set(), []
    for i, t in rows:
        n = re.sub("[\x20\x09-\x0d]+", " ", t or "")
        if n not in seen:
            seen.add(n)
            rest.append((i, t))
    classes = brute_classes([t for _, t in rest])
    rest = [r for k, r in enumerate(rest) if classes[k] == k]
    rest = [(i, t) for i, t in rest if item not in (t or "")]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted(got) == [i for i, _ in rest]
    assert all(got[i]["n_tokens"] == len(sp.encode(t or "")) for i, t in rest)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert decontam.WINDOW == 8 and corpus_pipeline.ORACLE_SQL is None


def bucket_rows(spark, buckets, score):
    rows = [(band, node, (score[node], -node)) for band, members in enumerate(buckets) for node in members]
    return spark.createDataFrame(rows, "band long, node long, rank struct<score:long,order:long>")


def merged(spark, merges, n):
    label = list(range(n))
    for merge in merges:
        new = {r["id"]: r["label"] for r in merge.collect()}
        label = [new.get(x, x) for x in label]
    return label


def bag_table(spark, sets):
    return spark.createDataFrame([(k, np.unique(np.array(sorted(x), np.uint64)).tobytes()) for k, x in enumerate(sets)], "id long, bag binary")


def test_buckets_that_only_a_later_link_makes_interesting(spark):
    h, t, s, x, y, z = range(6)
    # Links: t~s, s~x, s~y, y~z. y meets z only in a bucket whose top, x, is like neither.
    new = iter(range(1000, 2000))
    change = lambda base, begin: {v for v in base if not begin <= v < begin + 10} | {next(new) for _ in range(10)}
    base = set(range(1, 101))
    sets = [set(range(500, 600)), change(base, 1), base, change(base, 11), change(base, 21), None]
    sets[z] = change(sets[y], 31)
    table = bag_table(spark, sets)
    met = bucket_rows(spark, [(h, t, s, x, y), (t, s, x), (t, s, y), (x, y, z)], [100, 90, 80, 70, 60, 50])
    merge, state, tested = neardup._first_merge(met, lambda pairs: neardup._verified(pairs, table, 0.8))
    assert merged(spark, [merge, *neardup._last_merges(state, tested, table, 0.8)], 6) == [h, t, t, t, t, t]


def test_links_among_lower_classes_of_a_bucket(spark):
    """Many texts on one template, mutual similarity below the threshold, with near duplicates among them."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    template = [word() for _ in range(200)]
    texts = []
    for _ in range(60):
        w = list(template)
        for k in range(3):
            w[20 + 60 * k + rng.randrange(40)] = word()
        texts.append(" ".join(w))
    for k in range(0, 60, 3):
        w = texts[k].split()
        w[5] = word()
        texts.append(" ".join(w))
    bags = [neardup.bags([t])[1:] for t in texts]
    met = bucket_rows(spark, [range(80)], [80 - k for k in range(80)])
    table = spark.createDataFrame([(k, h.tobytes()) for k, (h, _) in enumerate(bags)], "id long, bag binary")
    want = brute_classes(texts)
    assert 20 < len(set(want)) < 80
    merge, state, tested = neardup._first_merge(met, lambda pairs: neardup._verified(pairs, table, 0.8))
    assert merged(spark, [merge], 80) != want  # the first links alone miss some
    assert merged(spark, [merge, *neardup._last_merges(state, tested, table, 0.8)], 80) == want
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(documents(spark, texts)).collect()}
    assert [got[k] for k in range(80)] == want


def test_texts_of_a_large_bucket_are_dealt_once(spark):
    """Rows grow with the texts of one bucket that are no near duplicates, not with its square."""
    rng, rows = np.random.default_rng(8), {}
    common = set(range(1, 31))
    for n in (600, 1200):
        sets = [common | set(rng.integers(1000, 2**40, 10).tolist()) | {2000 + k // 2} for k in range(n)]
        state = spark.createDataFrame([(1, k, k) for k in range(n)], "band long, node long, label long")
        rows[n] = neardup._tails(state, bag_table(spark, sets), 0.8).count()
    assert rows[1200] < 2.5 * rows[600] + 10
    base = [set(range(100 * k + 1, 100 * k + 91)) for k in range(5)]
    sets = [b | {10_000 + 5 * c + k} for k, b in enumerate(base) for c in range(200)]  # each set 200 times but for one element
    state = spark.createDataFrame([(1, k, k) for k in range(1000)], "band long, node long, label long")
    pairs = neardup._rest(state, bag_table(spark, sets), 0.8).select("a", "b").collect()
    assert len(pairs) == 5 * 200 * 199 // 2 and all(r["a"] // 200 == r["b"] // 200 for r in pairs)


def test_a_bound_by_shares_is_never_below_the_similarity():
    rng = np.random.default_rng(9)
    for most in (2, 5, 50) * 500:
        n = rng.integers(2, 12)
        a, b = rng.integers(0, most, n), rng.integers(0, most, n)
        if not ((both := (a > 0) & (b > 0)).any()):
            continue
        ids = np.arange(1, n + 1, dtype=np.uint64)
        got = neardup.similarity((ids[a > 0], a[a > 0]), (ids[b > 0], b[b > 0]))
        assert got <= 1 / (a.sum() / a[both].sum() + b.sum() / b[both].sum() - 1) + 1e-9


def test_a_bound_is_never_below_the_similarity():
    rng = np.random.default_rng(5)
    bags = []
    for k in range(40):
        h = np.unique(rng.integers(1, 60 if k < 20 else 2**63, 50).astype(np.uint64) << np.uint64(8 * (k % 2)))
        bags.append((h, np.ones(len(h), np.uint64) if k % 3 else rng.integers(1, 5, len(h)).astype(np.uint64)))
    data = [h.tobytes() + (b"" if (w == 1).all() else np.zeros(1, np.uint64).tobytes() + w.tobytes()) for h, w in bags]
    sketches = neardup._sketch.func(pa.array(data, pa.binary())).to_pylist()
    got = neardup.bounds(sketches, sketches)
    for i, a in enumerate(bags):
        for j, b in enumerate(bags):
            assert got[i, j] >= neardup.similarity(a, b) - 1e-9
        assert abs(got[i, i] - 1) < 1e-9
