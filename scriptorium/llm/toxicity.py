"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its distinct
words and their beginnings, hashed; a document's score is the noisy-or of its sentences' scores
beyond that of a quiet sentence q, one without any word that has a weight: 1 - prod((1 - p) / (1 - q)). Quiet sentences so add nothing,
however many there are. The weights are fitted to document labels alone: features that stand in toxic
documents significantly more often than chance would have it get a weight, by gradient steps on the
noisy-or's likelihood; the sentences that carry a document's score then follow.

Fitting takes at most MAX_TRAIN_DOCS labelled documents, those with the smallest hash of the
key; scoring reads every whole text.

Defined cases: null, empty and word-less texts have score zero and no sentences; a null key is
never held out; repeated documents each get a row; a key that is labelled twice takes the larger
label, null labels don't count; without labels of both kinds no word has a weight; no documents
give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import MEMO_WORDS, bounded, discard, hashed_sample, small_batches, stored, tidy

#: What lies between ends of sentences; it is a sentence if it has a word character. Each is looked for once, so a text costs its length.
PIECE, WORD = re.compile(r"[^.!?\n]+"), re.compile(r"\w")
EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»“”‘’…"
BUCKETS = 1 << 20
#: Labelled documents that a fit takes at most.
MAX_TRAIN_DOCS = 12_000
#: Lengths of the beginnings of words that are features beside the words.
BEGINNINGS = (4, 5, 6, 7)
#: Least log-probability (negated) that chance puts a feature into so many toxic documents.
SIGNIFICANCE = 5.0
STEPS, RATE, PENALTY = 250, 0.15, 2e-5
#: A toxic document counts so much in a fit; bounds of the log-odds of a quiet sentence.
TOXIC_WEIGHT, LEAST_BIAS, MOST_BIAS = 4.0, -12.0, -3.0
THRESHOLD = 0.7


class Model(NamedTuple):
    """bias, and weight by bucket: only words that matter."""

    bias: float
    weights: dict[int, float]


def buckets(word: str) -> list[int]:
    """Of a word and its beginnings."""
    import xxhash

    raw = xxhash.xxh32_intdigest
    own = [raw(word.encode("utf-8", "surrogatepass")) % BUCKETS]
    return own + [raw(f"{word[:k]}*".encode("utf-8", "surrogatepass")) % BUCKETS for k in BEGINNINGS if len(word) > k]


def sentences_of(text: str) -> Iterator[re.Match]:
    return (m for m in PIECE.finditer(text) if WORD.search(text, m.start(), m.end()))


def sentence_words(sentence: str) -> set[str]:
    return {s for w in sentence.lower().split() if (s := w.strip(EDGES))}


def significant(toxic: np.ndarray, all_: np.ndarray, rate: float) -> np.ndarray:
    """Whether features in ``all_`` documents, ``toxic`` of them toxic, are beyond chance (Chernoff's bound)."""
    share = toxic / all_
    with np.errstate(divide="ignore", invalid="ignore"):
        surprise = all_ * (share * np.log(share / rate) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - rate)), 0))
    return (share > rate) & (surprise >= SIGNIFICANCE)


def fit_mil(sentences: list[list[np.ndarray]], labels: np.ndarray, n_features: int) -> tuple[float, np.ndarray]:
    """bias and weights, none below zero; ``sentences``: of each document, the feature numbers of each of its sentences."""
    n_docs, positive = len(sentences), labels > 0
    flat = [s for d in sentences for s in d]
    doc_of = np.repeat(np.arange(n_docs), [len(d) for d in sentences])
    own = np.concatenate(flat).astype(np.int64) if flat else np.zeros(0, np.int64)
    sentence_of = np.repeat(np.arange(len(flat)), [len(s) for s in flat])
    w, b = np.zeros(n_features), -5.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(sentence_of, w[own], minlength=len(flat))
        p, quiet = 1 / (1 + np.exp(-np.clip(z, -30, 30))), 1 / (1 + np.exp(-b))
        none = np.exp(np.minimum(np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)) - np.log1p(-quiet), minlength=n_docs), 0))
        some = np.maximum(1 - none, 1e-6)
        pull = np.maximum(np.where(positive, -TOXIC_WEIGHT * none / some, 1.0), -1e3)[doc_of]
        gradient = np.append(np.bincount(own, (pull * p)[sentence_of], minlength=n_features), (pull * (p - quiet)).sum()) / n_docs
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        scale = RATE / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        move = scale * m / (1 - 0.9**step)
        w = np.maximum(w - move[:-1] - np.minimum(scale[:-1] * PENALTY, 1.0), 0)
        b = min(max(b - move[-1], LEAST_BIAS), MOST_BIAS)
    return float(b), w


def held_out(key: Column) -> Column:
    """Of three parts by CRC-32 of the key as text, the one that no fit may see."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", max_docs: int = MAX_TRAIN_DOCS) -> Model:
    """Learn from the labelled rows of ``docs`` that are not held out, at most ``max_docs`` of them."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max(label).alias("y"))
    labelled = docs.select(F.col(key), F.col(text).cast("string").alias("t")).join(bounded(known), key).select(key, "y", "t")
    sample = stored(hashed_sample(labelled, max_docs, key, "y", "t").select("y", "t"), "labelled")
    n, toxic = sample.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not toxic or toxic == n:
        discard(sample)
        return Model(-12.0, {})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, BUCKETS), np.int32)
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {b for s in sentences_of(t or "") for w in sentence_words(s[0]) for b in buckets(w)}
                at = np.fromiter(own, np.int64, len(own))
                both[0, at] += y
                both[1, at] += 1
        at = np.flatnonzero(both[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[0, at]), pa.array(both[1, at])], ["b", "toxic", "n"])
        at = np.flatnonzero((both[0] == 0) & (both[1] > 0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[0, at]), pa.array(both[1, at])], ["b", "toxic", "n"])

    spread = sample.mapInArrow(tidy(counted), "b long, toxic int, n int").groupBy("b").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    rows = spread.where(F.col("toxic") > F.col("n") * F.lit(toxic / n)).where("toxic > 2").orderBy("b").collect()  # at most BUCKETS
    at, k, m = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    chosen_buckets = at[significant(k, m, toxic / n)] if len(rows) else at
    number = {b: i for i, b in enumerate(chosen_buckets.tolist())}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[int]] = {}
        for batch in batches:
            if len(memo) > MEMO_WORDS:
                memo.clear()
            sizes, found = [], []
            for t in batch.column(1).to_pylist():
                own, count = [], []
                for s in sentences_of(t or ""):
                    for w in (words := sentence_words(s[0])):
                        if w not in memo:
                            memo[w] = [number[b] for b in buckets(w) if b in number]
                    features = [i for w in words for i in memo[w]]
                    own += features
                    count.append(len(features))
                sizes.append(np.array(count, "<u4").tobytes())
                found.append(np.array(own, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(sizes, pa.binary()), pa.array(found, pa.binary())], ["y", "sizes", "own"])

    taken = sample.mapInArrow(tidy(hashed), "y int, sizes binary, own binary").collect()
    discard(sample)
    taken.sort(key=lambda r: (bytes(r["sizes"]), bytes(r["own"]), r["y"]))  # the fit doesn't depend on the order of tasks
    sentences = [np.split(np.frombuffer(r["own"], "<u4"), np.cumsum(np.frombuffer(r["sizes"], "<u4"))[:-1].astype(int)) if r["sizes"] else [] for r in taken]
    bias, weights = fit_mil(sentences, np.array([r["y"] for r in taken]), len(number))
    return Model(bias, {b: float(weights[i]) for b, i in number.items() if weights[i]})


def _scorer(model: Model, least: float):
    """Of texts their scores, numbers of sentences and sentences of at least ``least``; it remembers words."""
    bias, weights = model
    memo: dict[str, float] = {}
    quiet = np.log1p(-1 / (1 + np.exp(-bias)))

    def weigh(words: set[str]) -> None:
        for w in words:
            if w not in memo:
                memo[w] = sum(weights.get(b, 0.0) for b in buckets(s)) if (s := w.strip(EDGES)) else 0.0

    def judge(texts: list[str | None]) -> tuple[list[float], list[int], list[list[dict]]]:
        if len(memo) > MEMO_WORDS:
            memo.clear()
        total, count, places = [], [], []
        for t in texts:
            t = t or ""
            words = set(t.lower().split())
            weigh(words)
            own, none, n = [], 0.0, 0
            # Without weights, and without a sentence that ends inside a word, all sentences are quiet.
            if any(map(memo.__getitem__, words)) or any("." in w[:-1] or "!" in w[:-1] or "?" in w[:-1] for w in words):
                for m in sentences_of(t):
                    n += 1
                    weigh(words := sentence_words(m[0]))
                    if z := sum(map(memo.__getitem__, words)):
                        p = float(1 / (1 + np.exp(-np.clip(z + bias, -500, 500))))
                        none += np.log1p(-min(p, 1 - 1e-12)) - quiet
                        if p >= least:
                            own.append({"from": m.start(), "to": m.end(), "score": p})
            else:
                n = sum(1 for _ in sentences_of(t))
            total.append(float(-np.expm1(min(none, 0.0))) + 0.0)  # no negative zero
            count.append(n)
            places.append(own)
        return total, count, places

    return judge


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """key, score, n_sentences, and sentences: array of from, to (code points), score for those of at least ``least``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _scorer(model, least)
        for batch in batches:
            total, count, places = judge(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.float64()), pa.array(count, pa.int64()), pa.array(places, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("score", pa.float64())])))], ["k", "score", "n_sentences", "sentences"])

    return rows.mapInArrow(tidy(scored), f"k {kind}, score double, n_sentences long, sentences array<struct<from:int,to:int,score:double>>").withColumnRenamed("k", key)


def toxicity_table(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """``op9``: key, held_out, score, predicted, and how many sentences offend."""
    found = score(docs, fit(docs, labels, key=key, **options), key=key)
    return found.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("sentences").alias("n_offending"))


def clean(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows that score under ``threshold``, all columns. Each row is judged by its own text, whatever its key."""
    model = fit(docs, labels, key=key, text=text, **options)

    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def judged(texts):
            judge = _scorer(model, 1.0)
            for own in texts:
                yield pa.array(judge(own.to_pylist())[0], pa.float64())

        yield from tidy(judged)(texts)

    return docs.where(F.arrow_udf(scored, "double")(F.col(text).cast("string")) < threshold)
