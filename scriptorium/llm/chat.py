"""Chat formatting: speaker roles by a hidden Markov model, then canonical turns.

A transcript is lines. Hidden states are role x (first line of a turn, later line of it). A line shows its
speaker marker (role named by it, an unknown name, or none) and its features (how long it is, how it
starts and ends, whether a blank line is before it). Transition and feature chances are counted with Spark on
turns whose roles are known, with add-one smoothing; the reliability of markers is a parameter. Viterbi
finds the likeliest states of each transcript, which give turns; ``render`` writes them in one form.

No text is lost: a marker that names a known role is cut from its turn and kept beside it, an unknown name stays in the text.

Defined cases: null, empty and blank transcripts have no turns; a transcript without any marker is
decoded from its features alone; text before the first turn's marker belongs to that decoding too; repeated
transcripts and null keys each get their rows; without known turns the chances are even; no
transcripts give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import bounded, small_batches, stored, tidy
from .toxicity import held_out

ROLES = ("system", "user", "assistant")
#: Names by which transcripts call the roles.
NAMES = {"system": "system sys instruction instructions context".split(), "user": "user human me you customer question q prompter".split(), "assistant": "assistant ai bot agent model gpt answer a response".split()}
_ROLE_OF = {name: i for i, role in enumerate(ROLES) for name in NAMES[role]}
MARKER = re.compile(r"^\s*(?:<\|(?:im_start\|>)?\s*(?P<a>\w+)(?:\|>)?|\[(?P<b>\w+)\]:?|#{1,4}\s*(?P<c>\w+)\s*:?$|\*{0,2}(?P<d>\w+)\*{0,2}\s*:\*{0,2}(?=\s|$)|(?P<e>\w+)>(?=\s|$))\s*")
#: Chance that a turn that begins with a marker names its own role; that a first line has one; that a later line looks like one.
RELIABLE, MARKED, STRAY = 0.97, 0.9, 0.02
#: Bins of the line features.
LENGTHS = (0, 20, 60, 120, 240, 480)
N_FEATURES = 6 * 3 * 2


class Model(NamedTuple):
    """Log-chances: first role, role after role, features by role, and of a turn's going on by role."""

    first: np.ndarray
    after: np.ndarray
    features: np.ndarray
    goes_on: np.ndarray


def marker(line: str) -> tuple[int, int]:
    """(role number, 3 for an unknown name, -1 for no marker; where the line's own text starts). Unknown names belong to the text."""
    m = MARKER.match(line)
    if not m:
        return -1, 0
    name = next(g for g in m.groups() if g).lower()
    if name not in _ROLE_OF:
        return (3 if m["d"] or m["a"] else -1), 0
    return _ROLE_OF[name], m.end()


def line_feature(text: str) -> int:
    """Number of the bin of a line without its marker: length, first character, question or not."""
    size = int(np.searchsorted(LENGTHS, len(text), "right")) - 1
    start = 0 if text[:1].isupper() else 1 if text[:1].isalpha() else 2
    return (size * 3 + start) * 2 + text.rstrip().endswith("?")


def line_feature_column(text: Column) -> Column:
    """The same in Spark."""
    size = sum((F.length(text) >= n).cast("int") for n in LENGTHS[1:])
    first = F.substring(text, 1, 1)
    start = F.when(first.rlike(r"^\p{Lu}"), 0).when(first.rlike(r"^\p{L}"), 1).otherwise(2)
    return (size * 3 + start) * 2 + text.rlike(r"\?\s*\z").cast("int")


def fit(turns: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Model:
    """Count on ``turns`` with known roles. The driver sees at most (roles x features) counts."""
    own = turns.where(F.col(role).isin(*ROLES)).select(F.col(key).alias("k"), F.col(turn).alias("n"), F.col(role).alias("r"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    number = {r: i for i, r in enumerate(ROLES)}
    later = own.select("k", (F.col("n") + 1).alias("n"), F.col("r").alias("before"))
    after, first, features = np.ones((3, 3)), np.ones(3), np.ones((3, N_FEATURES))
    for x in own.join(later, ["k", "n"]).groupBy("before", "r").agg(F.count(F.lit(1)).alias("c")).collect():
        after[number[x["before"]], number[x["r"]]] += x["c"]
    for x in own.where("n = 0").groupBy("r").agg(F.count(F.lit(1)).alias("c")).collect():
        first[number[x["r"]]] += x["c"]
    lines = own.select("r", F.posexplode(F.filter(F.split("t", "\n"), lambda s: ~s.rlike(r"(?U)^\s*$"))).alias("line", "s"))
    on = np.ones((3, 2))
    for x in lines.groupBy("r", line_feature_column(F.col("s")).alias("f"), (F.col("line") > 0).alias("later")).agg(F.count(F.lit(1)).alias("c")).collect():
        features[number[x["r"]], x["f"]] += x["c"]
        on[number[x["r"]], int(x["later"])] += x["c"]
    share = lambda m: np.log(m / m.sum(axis=-1, keepdims=True))
    # Of the lines of a role, those that are not a turn's first follow a line of the same turn.
    return Model(share(first), share(after), share(features), np.log(np.stack([on[:, 1], on[:, 0]], axis=1) / on.sum(axis=1, keepdims=True)))


def emissions(lines: list[str], model: Model) -> tuple[np.ndarray, list[int]]:
    """Log-chance of each line in each state (role x first, later), and where its own text starts."""
    out, starts = np.zeros((len(lines), 6)), []
    for i, line in enumerate(lines):
        named, start = marker(line)
        starts.append(start)
        shown = model.features[:, line_feature(line[start:])]
        for r in range(3):
            if named < 0:
                begins, goes = 1 - MARKED, 1 - STRAY
            elif named == 3:
                begins, goes = MARKED * (1 - RELIABLE) / 2, STRAY
            else:
                begins, goes = MARKED * (RELIABLE if named == r else (1 - RELIABLE) / 4), STRAY / 4
            out[i, 2 * r], out[i, 2 * r + 1] = np.log(begins) + shown[r], np.log(goes) + shown[r]
    return out, starts


def transitions(model: Model) -> np.ndarray:
    """Log-chance of the next state: a later line only after a line of its role."""
    out = np.full((6, 6), -np.inf)
    for a in range(3):
        for part in (0, 1):
            for b in range(3):
                out[2 * a + part, 2 * b] = model.goes_on[a, 1] + model.after[a, b]
            out[2 * a + part, 2 * a + 1] = model.goes_on[a, 0]
    return out


def viterbi(shown: np.ndarray, first: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Likeliest states; among equals the lowest numbers."""
    score, back = first + shown[0], np.zeros(shown.shape, np.int8)
    for i in range(1, len(shown)):
        through = score[:, None] + step
        back[i] = through.argmax(axis=0)
        score = through.max(axis=0) + shown[i]
    states = np.zeros(len(shown), np.int64)
    states[-1] = score.argmax()
    for i in range(len(shown) - 1, 0, -1):
        states[i - 1] = back[i, states[i]]
    return states


def turns_of(transcript: str | None, model: Model) -> list[tuple[str, str, str]]:
    """Turns: role, marker and body. Markers and bodies put together, with a line end between turns, are the transcript."""
    every = (transcript or "").split("\n")
    at = [i for i, x in enumerate(every) if x.strip()]
    if not at:
        return []
    shown, starts = emissions([every[i] for i in at], model)
    first = np.full(6, -np.inf)
    first[::2] = model.first
    turns: list[tuple[str, str, list[str]]] = []
    for i, end, start, state in zip(at, [*at[1:], len(every)], starts, viterbi(shown, first, transitions(model)).tolist()):
        if state % 2 == 0:
            before = "" if turns else "\n" * i  # blank lines before all turns go with the first marker
            turns.append((ROLES[state // 2], before + every[i][:start], [every[i][start:]]))
        else:
            turns[-1][2].append(every[i])
        turns[-1][2].extend(every[i + 1 : end])  # blank lines belong to the turn before them
    return [(role, mark, "\n".join(own)) for role, mark, own in turns]


def decode(transcript: str | None, model: Model) -> list[tuple[str, str]]:
    """Turns: role and text, without white space around it."""
    return [(role, body.strip()) for role, _, body in turns_of(transcript, model)]


def parse(transcripts: DataFrame, model: Model, *, key: str = "conv_id", text: str = "text") -> DataFrame:
    """key, turn, role, content, n_turns, marker, body: one row a recovered turn. ``content`` is the body without white space around it."""
    small_batches(transcripts.sparkSession)
    rows = transcripts.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, turn, role, marks, bodies, total = [], [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                turns = turns_of(t, model)
                at += [i] * len(turns)
                turn += range(len(turns))
                for own, by_turn in zip((role, marks, bodies), zip(*turns)):
                    own += by_turn
                total += [len(turns)] * len(turns)
            said = [pa.array(x, pa.string()) for x in (role, [b.strip() for b in bodies], marks, bodies)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(turn, pa.int64()), *said[:2], pa.array(total, pa.int64()), *said[2:]], ["k", "turn", "role", "content", "n_turns", "marker", "body"])

    return rows.mapInArrow(tidy(read), f"k {kind}, turn long, role string, content string, n_turns long, marker string, body string").withColumnRenamed("k", key)


def render(role: Column, content: Column) -> Column:
    """One turn in canonical form."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), content, F.lit("\n<|end|>\n"))


#: Turns of a conversation in one transcript: it bounds what is put together for one decoding.
TRANSCRIPT_TURNS = 64
#: Rows of one turn number from which they are transcripts of their own.
REPEATS = 16


def transcripts_of(turns: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Raw transcripts (key, part, text) from turns: five marker styles by the key's hash, and each seventh turn after the first, by hash, without its marker.

    A transcript has TRANSCRIPT_TURNS turn numbers, and a null number is 0. Rows of a turn number that recurs more than REPEATS times
    in its conversation are put together apart, TRANSCRIPT_TURNS to a transcript, so none grows without bound.
    """
    style = F.pmod(F.xxhash64(key), F.lit(5))
    title = F.initcap(F.col(role))
    head = (
        F.when((F.col(turn) > 0) & (F.pmod(F.xxhash64(key, turn), F.lit(7)) == 0), F.lit(""))
        .when(style == 0, F.concat(title, F.lit(": ")))
        .when(style == 1, F.concat(F.lit("<|"), F.col(role), F.lit("|>")))
        .when(style == 2, F.concat(F.lit("["), F.upper(F.col(role)), F.lit("] ")))
        .when(style == 3, F.concat(F.when(F.col(role) == "user", "Human").when(F.col(role) == "assistant", "AI").otherwise(title), F.lit(": ")))
        .otherwise(F.concat(F.lit("**"), title, F.lit("**: ")))
    )
    said = F.concat(F.coalesce(head, F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit("")))
    number = F.coalesce(F.col(turn).cast("long"), F.lit(0))
    own = turns.select(F.col(key).alias("k"), number.alias("t"), F.struct(F.col(turn).alias("n"), said.alias("s")).alias("x"), F.monotonically_increasing_id().alias("row"))
    often = stored(own.groupBy("k", "t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > REPEATS).select(F.col("k").alias("k2"), F.col("t").alias("t2"), "n"), "repeated-turns")
    dealt = own.join(bounded(often), F.col("k").eqNullSafe(F.col("k2")) & (F.col("t") == F.col("t2")), "left")
    piece = F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / TRANSCRIPT_TURNS))
    grouped = dealt.groupBy("k", F.floor(F.col("t") / TRANSCRIPT_TURNS).alias("part"), "t2", piece.alias("piece")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return grouped.select(F.col("k").alias(key), "part", F.array_join(F.transform("xs", lambda x: x["s"]), "\n").alias("text"))


def chat_table(turns: DataFrame, *, key: str = "conv_id") -> DataFrame:
    """``op2``: raw transcripts made of ``turns`` parsed back: key, part, turn, role, the rendered turn, its marker, and whether the model hasn't seen the conversation."""
    made = transcripts_of(turns, key=key).select(F.struct(key, "part").alias("id"), "text")
    found = parse(made, fit(turns.where(~held_out(F.col(key))), key=key), key="id")
    own = F.col(f"id.{key}")
    return found.select(own.alias(key), F.col("id.part").alias("part"), "turn", "role", "n_turns", render(F.col("role"), F.col("content")).alias("rendered"), "marker", held_out(own).alias("held_out"))
