"""Language identification of mixed documents.

Every word of a document is taken to come from one of the learned languages. A smoothed character trigram model
gives the likelihood of each word in each language, and expectation-maximisation estimates the proportions in
which the document mixes them. The language set is chosen by penalised likelihood: the languages are ordered
by their proportion under the full mixture, the likelihood of the best mixture of the first k of them is
compared for every k, and each language more costs PENALTY x log(words).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, code_points, letters, mix, remainder, table

BINS = 1 << 16
DOCS_PER_LANG = 1500  #: expected number of texts that a language is learned from
PENALTY = 1.0
FULL_STEPS, SET_STEPS = 12, 8

_COUNT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("kind", T.IntegerType()), T.StructField("bin", T.IntegerType()), T.StructField("n", T.LongType())])


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words (runs of letters, in lower case): hashed trigram and context of each position, the positions
    at which words start, and the text that each word belongs to. A word's end is a position too."""
    codes, starts = code_points(texts, lower=True)
    c = np.where(letters()[codes], codes, 0).astype(np.uint64)
    at = np.flatnonzero((c[1:] != 0) | (c[:-1] != 0)) + 1
    this, last = c[at], c[at - 1]
    before = np.where(last != 0, c[at - 2], 0)
    context = (before * np.uint64(0x9E3779B1)) ^ last
    gram = mix(context * np.uint64(0x85EBCA6B1F35) + this)
    first = np.flatnonzero(last == 0)
    doc = np.searchsorted(starts, at[first], side="right") - 1
    return (gram & np.uint64(BINS - 1)).astype(np.int64), (mix(context) & np.uint64(BINS - 1)).astype(np.int64), first, doc


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n = held.setdefault(lang, np.zeros((2, BINS), np.int64))
            if text:
                gram, context, _, _ = trigrams([text])
                n[0] += np.bincount(gram, minlength=BINS)
                n[1] += np.bincount(context, minlength=BINS)
    for lang, n in held.items():
        kind, bins = np.nonzero(n)
        yield pa.record_batch([pa.array([lang] * len(kind), pa.string()), pa.array(kind.astype(np.int32)), pa.array(bins.astype(np.int32)), pa.array(n[kind, bins])], ["lang", "kind", "bin", "n"])


class LanguageModel:
    """Log probabilities of hashed trigrams given their context, for each language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        """counts: languages x (trigrams, contexts) x bins."""
        self.langs = langs
        kinds = max(1, int((counts[:, 0].sum(0) > 0).sum())) if len(langs) else 1
        size = np.sqrt(kinds) + 1  # about as many letters as follow a context at most
        self.size, self.counts = size, counts.astype(np.float64)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """bins x languages: log(count + a) of trigrams, and log(count + a x size) of contexts."""
        a = 0.1
        return np.log(self.counts[:, 0].T + a).astype(np.float32), np.log(self.counts[:, 1].T + a * self.size).astype(np.float32)


def fit(docs: DataFrame, per_lang: int = DOCS_PER_LANG) -> LanguageModel:
    """Learn from the rows of docs (text, lang) with a lang and a text.

    Of each language about per_lang texts are used, chosen by a hash of the row: the whole texts of a sample whose
    expected size is bounded (copies of a text are drawn one by one). All languages of docs are learned, in alphabetical order.
    """
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], np.zeros((0, 2, BINS)))
    share = F.create_map(*(F.lit(x) for lang in langs for x in (lang, per_lang / sizes[lang])))
    chance = (F.xxhash64(*docs.columns).bitwiseAND(0x7FFFFFFF)) / float(1 << 31)
    some = rows.filter(chance < share[F.col("lang")]).select("lang", "text")
    counted = some.mapInArrow(_count, _COUNT).groupBy("lang", "kind", "bin").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), 2, BINS), np.int64)
    index = {lang: i for i, lang in enumerate(langs)}
    where = np.array([index[x] for x in counted["lang"].to_pylist()], np.int64)
    counts[where, counted["kind"].to_numpy(), counted["bin"].to_numpy()] = counted["n"].to_numpy()
    return LanguageModel(langs, counts)


def _mixture(p: np.ndarray, doc: np.ndarray, cuts: np.ndarray, n: np.ndarray, pi: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after some steps from pi, and the log-likelihood of each text under them (up to the words' scales)."""
    for _ in range(steps):
        r = p * pi[doc]
        r /= r.sum(1, keepdims=True)
        pi = np.add.reduceat(r, cuts, axis=0) / n[:, None]
    return pi, np.add.reduceat(np.log((p * pi[doc]).sum(1)), cuts)


def predict(texts: list[str], langs: list[str], gram_log: np.ndarray, context_log: np.ndarray, penalty: float = PENALTY) -> list[tuple[str, float, str]]:
    """(language, its proportion, all chosen languages with proportions) of each text; `und` without any letter."""
    out: list[tuple[str, float, str]] = [("und", 0.0, "")] * len(texts)
    gram, context, first, doc = trigrams(texts)
    if not len(first) or not langs:
        return out
    logs = np.add.reduceat(gram_log[gram] - context_log[context], first, axis=0).astype(np.float64)
    scale = logs.max(1, keepdims=True)
    p = np.maximum(np.exp(logs - scale), 1e-30)
    there, cuts, n = np.unique(doc, return_index=True, return_counts=True)
    local = np.repeat(np.arange(len(there)), n)
    k_all = len(langs)
    full, _ = _mixture(p, local, cuts, n, np.full((len(there), k_all), 1 / k_all), FULL_STEPS)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    best, best_pi = np.full(len(there), -np.inf), full
    for k in range(1, k_all + 1):
        start = np.where(rank < k, np.maximum(full, 1e-6), 0)
        start /= start.sum(1, keepdims=True)
        pi, like = _mixture(p, local, cuts, n, start, SET_STEPS if k > 1 else 0)
        value = like - penalty * (k - 1) * np.log(n + 1.0)
        better = value > best
        best = np.where(better, value, best)
        best_pi = np.where(better[:, None], pi, best_pi)
    top = best_pi.argmax(1)
    for i, d in enumerate(there):
        row = best_pi[i]
        parts = sorted(((float(row[j]), langs[j]) for j in np.flatnonzero(row > 0)), key=lambda x: (-x[0], x[1]))
        out[d] = (langs[top[i]], min(1.0, float(row[top[i]])), ",".join(f"{name}:{share:.4f}" for share, name in parts))
    return out


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", out_col: str = "language", penalty: float = PENALTY) -> DataFrame:
    """docs with a struct column: pred, score (the predicted language's proportion), mixture (lang:share, ...).

    Null texts and texts without letters are `und` with score 0 and an empty mixture. Ties go to the language
    that is first in the alphabet.
    """
    langs, tables = model.langs, docs.sparkSession.sparkContext.broadcast(model.tables())

    @F.arrow_udf("struct<pred:string,score:double,mixture:string>")
    def run(texts: pa.Array) -> pa.Array:
        gram_log, context_log = tables.value
        found = []
        for part in chunks([t or "" for t in texts.to_pylist()], 150_000):
            found += predict(part, langs, gram_log, context_log, penalty)
        pred, score, mixture = zip(*found) if found else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixture, pa.string())], ["pred", "score", "mixture"])

    return docs.withColumn(out_col, run(F.col(text_col).cast("string")))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    model = fit(docs.filter(remainder(F.col("doc_id"), 5) != 0))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), F.col("language.pred").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.mixture").alias("mixture"))
