"""Quality classifier from weak labels.

Heuristic labellers vote good (+), bad (-) or abstain (0) on every document. Expectation-
maximisation over the counts of vote patterns, which cover the whole corpus and of which there are at most
3 ** labellers, estimates each labeller's accuracy on good and on bad documents and with them each
pattern's posterior. The posteriors label a bounded sample (MAX_TRAIN_DOCS documents, those with
the smallest hash of key, votes and features) on which a linear scorer over hashed word shapes and text statistics is
trained; every document is then scored from its whole text.

Defined cases: null, empty and blank texts get no votes, have no features and are rejected;
short texts get votes only from labellers that can judge them; repeated documents and null keys
each get a row, alike texts alike scores; no documents give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import MEMO_WORDS, discard, hashed_sample, small_batches, stored, tidy

DIM = 512
MAX_TRAIN_DOCS = 8000
ROUNDS, STEPS, RATE, DECAY = 60, 300, 0.1, 1e-4
THRESHOLD = 0.5
#: Where estimation starts: chances of a good vote on good documents, and on bad ones of a kind that a labeller doesn't look for.
FIRST_ON_GOOD, FIRST_ON_OTHER = 0.99, 0.95
#: What the start weighs against the votes on good documents, as a share of all documents; elsewhere it weighs two votes. With less, the good
#: class takes in the kind of bad documents that only one labeller sees.
START_SHARE = 0.1
SYMBOLS = "#$%&*@^~|<>{}[]=+_\\/"
NOT_SHAPE = re.compile(r"(.)\1+")


class Stats(NamedTuple):
    words: int
    symbols: float
    capitals: float
    repeated_lines: float
    exclamations: float
    distinct: float
    same_as_before: float
    mean_length: float
    closed_lines: float
    letters: float


def _kinds() -> np.ndarray:
    """Of each ASCII code: 0 letter, 1 digit, 2 symbol, 3 exclamation mark, 4 other punctuation, 5 white space or control. The last stands for all beyond ASCII."""
    table = np.zeros(128, np.uint8)
    for code in range(128):
        c = chr(code)
        table[code] = 5 if c.isspace() or code < 32 else 1 if c.isdigit() else 2 if c in SYMBOLS else 3 if c == "!" else 0 if c.isalpha() or code == 127 else 4
    return table


KINDS = _kinds()


def measure(text: str, words: list[str]) -> Stats:
    n = len(text)
    lines = [s for line in text.split("\n") if (s := line.strip())]
    seen = set(lines)
    codes, lower = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in (text, text.lower()))
    kinds = np.bincount(KINDS[np.minimum(codes, 127)], minlength=6)
    capitals = int((codes != lower).sum()) if len(codes) == len(lower) else sum(c.isupper() for c in text)
    return Stats(
        len(words),
        int(kinds[2]) / n,
        capitals / max(1, int(kinds[0])),
        1 - sum(map(len, seen)) / max(1, sum(map(len, lines))),
        int(kinds[3]) / n,
        len(set(words)) / len(words),
        sum(map(eq, words, words[1:])) / len(words),
        sum(map(len, words)) / len(words),
        sum(line[-1] in ".!?:;\"')" for line in lines) / len(lines),
        int(kinds[0]) / max(1, n - int(kinds[5])),
    )


def _band(x: float, good: float, bad: float) -> int:
    """+1 up to ``good``, -1 from ``bad`` on (or the other way round if good > bad)."""
    return (x <= good) - (x >= bad) if good < bad else (x >= good) - (x <= bad)


#: name -> (words a text must have to be judged, vote)
LABELLERS = {
    "symbols": (5, lambda s: _band(s.symbols, 0.02, 0.06)),
    "capitals": (10, lambda s: _band(s.capitals, 0.12, 0.35)),
    "repeated_lines": (10, lambda s: _band(s.repeated_lines, 0.15, 0.35)),
    "exclamations": (10, lambda s: _band(s.exclamations, 0.01, 0.05)),
    "distinct_words": (60, lambda s: _band(s.distinct, 0.35 if s.words < 800 else 0.2, 0.2 if s.words < 800 else 0.1)),
    "same_word_again": (20, lambda s: _band(s.same_as_before, 0.08, 0.25)),
    "word_length": (20, lambda s: 1 if 3.5 <= s.mean_length <= 7.5 else -1 if s.mean_length < 2 or s.mean_length > 12 else 0),
    "closed_lines": (20, lambda s: _band(s.closed_lines, 0.6, 0.2)),
    "letters": (10, lambda s: _band(s.letters, 0.85, 0.7)),
}


def votes(stats: Stats | None) -> str:
    """One character a labeller."""
    if stats is None:
        return "0" * len(LABELLERS)
    return "".join("0+-"[f(stats)] if stats.words >= least else "0" for least, f in LABELLERS.values())


def shape(word: str) -> str:
    """X upper, x lower, 9 digit, other characters themselves; runs count once, long shapes by their ends."""
    stem, tail = (word[:-1], word[-1]) if word[-1] in ".,;:!?" else (word, "")
    if stem.isalpha():
        return ("x" if stem.islower() else "X" if stem.isupper() else "Xx" if stem[1:].islower() else "xX") + tail
    s = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word[:32])
    s = NOT_SHAPE.sub(r"\1", s)
    return s if len(s) <= 6 else f"{s[:3]}~{s[-2:]}"


def _at(feature: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(feature.encode("utf-8", "surrogatepass")) % DIM


def features(stats: Stats | None, words: list[str], memo: dict[str, int]) -> bytes:
    """Hashed features as DIM bytes: square roots of shape shares, and binned statistics."""
    out = np.zeros(DIM)
    if stats is not None:
        for w in set(words):
            if w not in memo:
                memo[w] = _at("shape " + shape(w))
        counts = np.bincount(np.fromiter(map(memo.__getitem__, words), np.int64, len(words)), minlength=DIM)
        out += np.sqrt(counts / len(words)) * 200
        for name, value in zip(Stats._fields[1:], stats[1:]):
            out[_at(f"{name} {min(12, int(value * 12))}" if name != "mean_length" else f"length {min(15, int(value))}")] += 100
    return np.minimum(out, 255).astype(np.uint8).tobytes()


def _reader():
    """Of texts their votes, features, and whether there is any word; it remembers words."""
    memo: dict[str, int] = {}

    def read(texts: list[str | None]) -> tuple[list[str], list[bytes], list[bool]]:
        if len(memo) > MEMO_WORDS:
            memo.clear()
        voted, found, judged = [], [], []
        for t in texts:
            words = (t or "").split()
            stats = measure(t, words) if words else None
            voted.append(votes(stats))
            found.append(features(stats, words, memo))
            judged.append(bool(words))
        return voted, found, judged

    return read


def _scores(found: list[bytes], judged: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The scorer's probabilities; zero without words."""
    x = np.frombuffer(b"".join(found), np.uint8).reshape(-1, DIM)
    own, bias = weights[:-1] / 255.0, weights[-1]
    z = np.array([(row * own).sum() for row in x]) + bias if len(x) else np.zeros(0)
    return np.where(judged, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


def examine(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, votes, features, judged (whether there is any word), stored."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader()
        for batch in batches:
            voted, found, judged = read(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(voted), pa.array(found, pa.binary()), pa.array(judged)], ["k", "votes", "features", "judged"])

    return stored(rows.mapInArrow(tidy(seen), f"k {kind}, votes string, features binary, judged boolean").withColumnRenamed("k", key), "examined")


def estimate(patterns: dict[str, int]) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
    """Expectation-maximisation over the counts of vote patterns: pattern -> probability that its documents are good; by class (the
    first is good) and labeller the chance that a vote, if one is cast, is good; shares of the classes."""
    if not patterns:
        return {}, np.zeros((0, 0)), np.zeros(0)
    listed = sorted(patterns)
    vote = np.array([[(c == "+") - (c == "-") for c in p] for p in listed])
    count = np.array([patterns[p] for p in listed], float)
    up, down = (vote > 0).astype(float), (vote < 0).astype(float)
    n = vote.shape[1]
    # Class 0 is good. Documents are bad in different ways, so each labeller starts a bad class of its own.
    chance = np.full((n + 1, n), FIRST_ON_OTHER)
    chance[0] = FIRST_ON_GOOD
    chance[np.arange(1, n + 1), np.arange(n)] = 0.1
    prior, first = np.append(0.8, np.full(n, 0.2 / n)), chance.copy()
    weight = np.append(START_SHARE * count.sum(), np.full(n, 2.0))[:, None]
    for _ in range(ROUNDS):
        joint = np.log(prior) + (up[:, None, :] * np.log(chance)).sum(axis=2) + (down[:, None, :] * np.log(1 - chance)).sum(axis=2)
        q = np.exp(joint - joint.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        mass = count[:, None] * q
        ups, downs = (mass[:, :, None] * up[:, None, :]).sum(axis=0), (mass[:, :, None] * down[:, None, :]).sum(axis=0)
        chance = np.clip((ups + weight * first) / (ups + downs + weight), 0.01, 0.999)
        prior = np.maximum(mass.sum(axis=0), 0.5)
        prior /= prior.sum()
    return dict(zip(listed, q[:, 0].tolist())), chance, prior


def posteriors(patterns: dict[str, int]) -> dict[str, float]:
    """pattern -> probability that its documents are good."""
    return estimate(patterns)[0]


def fit_linear(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression on soft labels; the last weight is the bias."""
    x = np.hstack([x / 255.0, np.ones((len(x), 1))])
    w, m, v = np.zeros(x.shape[1]), 0.0, 0.0
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip((x * w).sum(axis=1), -30, 30)))
        g = ((p - y)[:, None] * x).mean(axis=0) + DECAY * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def fit(examined: DataFrame, *, key: str = "doc_id", max_docs: int = MAX_TRAIN_DOCS) -> tuple[dict[str, float], np.ndarray]:
    """Posterior of each vote pattern, and the scorer's weights; ``key`` may name a field of a column."""
    judged = examined.where("judged")
    counts = {r["votes"]: r["n"] for r in judged.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    good = posteriors(counts)
    sample = hashed_sample(judged.select(F.col(key).alias("k"), "votes", "features"), max_docs, "k", "votes", "features").collect()
    if not sample:
        return good, np.zeros(DIM + 1)
    x = np.frombuffer(b"".join(r["features"] for r in sample), np.uint8).reshape(-1, DIM).astype(np.float32)
    return good, fit_linear(x, np.array([good[r["votes"]] for r in sample]))


def assess(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, max_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """key, votes, posterior (of the votes), score (of the scorer), accepted."""
    examined = examine(docs, key=key, text=text)
    good, weights = fit(examined, key=key, max_docs=max_docs)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = batch.column(3).to_numpy(zero_copy_only=False)
            p = _scores(batch.column(2).to_pylist(), judged, weights)
            post = [good.get(v, 0.0) if j else 0.0 for v, j in zip(batch.column(1).to_pylist(), judged)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(post, pa.float64()), pa.array(p), pa.array(judged & (p >= threshold))], ["k", "votes", "posterior", "score", "accepted"])

    kind = examined.schema[key].dataType.simpleString()
    return examined.select(F.col(key).alias("k"), "votes", "features", "judged").mapInArrow(tidy(scored), f"k {kind}, votes string, posterior double, score double, accepted boolean").withColumnRenamed("k", key)


def clean(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, max_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """The accepted rows, all columns. Each row is judged by its own text, whatever its key."""
    examined = examine(docs, key=key, text=text)
    weights = fit(examined, key=key, max_docs=max_docs)[1]
    discard(examined)

    def accepted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def judged(texts):
            read = _reader()
            for own in texts:
                _, found, any_word = read(own.to_pylist())
                any_word = np.array(any_word, bool)
                yield pa.array(any_word & (_scores(found, any_word, weights) >= threshold), pa.bool_())

        yield from tidy(judged)(texts)

    return docs.where(F.arrow_udf(accepted, "boolean")(F.col(text).cast("string")))
