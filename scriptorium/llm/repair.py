"""Repair of conversations whose turns don't alternate: the cheapest edits, found by A* over rows and roles.

Rows are numbered in their conversation and cut into blocks. In each block A* finds the cheapest edits between the states of a
conversation's grammar; the blocks of a conversation are then chained, and each row gets its edits. A block bounds what a search
holds, so a conversation may be of any length; one of a single block is one search.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored, tidy

BLANK_CLASS = r"[^\x20\x09-\x0D]"
#: Costs of edits, and of a truncated row that stays.
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a conversation that one search goes through.
BLOCK = 256
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a. Where a role's initial leads from each; where a conversation may end.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
#: The role that an edit gives in each state.
GIVEN = ("user", "user", "assistant", "user")
ROLES = {"user": "u", "assistant": "a"}
MUST_GO = "bd"


def damaged(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with planted faults, by crc32 of ``conv:turn`` modulo 20: dropped, emptied, without sentence ends, repeated, or said by the user. Nulls read as one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said(conv), F.lit(":"), said(turn)).cast("binary")) % 20
    own = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"), fate.alias("_fate")).where("_fate <> 0")
    text_ = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    made = own.select("conv_id", "turn", F.when(F.col("_fate") == 4, "user").otherwise(F.col("role")).alias("role"), text_.alias("text"), F.when(F.col("_fate") == 3, 2).otherwise(1).alias("_times"))
    return made.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_time")).drop("_time")


def judged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with n (place in the conversation, from 0), last (of the conversation), initial, fault and new_turn.

    Rows go by turn, nulls first, then by role and a digest of the text, so repeated rows stand side by side. A row's fault is blank,
    duplicate (role and text were there before) or truncated (its last character is no sentence's end), whichever comes first.
    """
    marked = rows.select("conv_id", "turn", "role", "text", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("_digest"))
    order = [F.asc_nulls_first("turn"), "role", "_digest", "_again"]
    whole, alike = Window.partitionBy("conv_id").orderBy(*order), Window.partitionBy("conv_id", "role", "_digest").orderBy(F.asc_nulls_first("turn"))
    cut = ~F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*+\z"))
    fault = F.when(~F.rlike("text", F.lit(BLANK_CLASS)), "b").when(F.col("_again"), "d").when(cut, "t").otherwise("-")
    again = marked.withColumn("_again", F.row_number().over(alike) > 1)
    new = F.col("turn").isNotNull() & ~F.coalesce(F.lag("turn").over(whole) == F.col("turn"), F.lit(False))
    return again.select("conv_id", "turn", "role", "text", (F.row_number().over(whole) - 1).cast("long").alias("n"), F.lead(F.lit(1)).over(whole).isNull().alias("last"), F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"), new.alias("new_turn"))


def search(rows: str, entry: int, final: bool) -> dict[int, tuple[int, str]]:
    """State -> (cost, audit): the cheapest edits of ``rows`` from state ``entry``, the least audit of the cheapest.

    ``rows`` has two characters a row, its fault and its role's initial. Nodes are rows done and a state. They leave the heap by cost
    plus what the rows ahead cost at least (deletions that must be, charges of truncated rows that deletion can't better), then by audit. A
    ``final`` block ends a conversation: turns may be put in behind it, and its first end is all that counts. In other blocks each state is an end, and
    no turn is put in behind the last row, so no audit begins another one.
    """
    n = len(rows) // 2
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if rows[2 * i] in MUST_GO else min(DELETE, TRUNCATED) if rows[2 * i] == "t" else 0)
    heap, done, ends = [(ahead[0], "", 0, entry)], set(), {}
    while heap:
        bound, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        cost = bound - ahead[i]
        if i == n and (not final or state in ENDS):
            ends[state] = cost, audit
            if final or len(ends) == len(STEP):
                break
        if i == n and not final:
            continue
        given = STEP[state][ROLES[GIVEN[state]]]
        moves = [(INSERT, "I", i, given)]
        if i < n:
            fault, initial = rows[2 * i], rows[2 * i + 1]
            moves.append((DELETE, "D", i + 1, state))
            if fault not in MUST_GO:
                charge = TRUNCATED if fault == "t" else 0
                moves.append((RELABEL + charge, "R", i + 1, given))
                if initial in STEP[state]:
                    moves.append((charge, "K", i + 1, STEP[state][initial]))
        for price, letter, j, to in moves:
            if (j, to) not in done:
                heapq.heappush(heap, (cost + price + ahead[j], audit + letter, j, to))
    return ends


def walked(rows: str, entry: int, audit: str) -> list[tuple[str, str]]:
    """For each row its edits and their roles' states: turns put in before it, then its own edit; what is put in behind the last row goes with it."""
    state, i, out, letters, states = entry, 0, [], "", ""
    for letter in audit:
        if letter != "D":
            state = STEP[state][rows[2 * i + 1]] if letter == "K" else STEP[state][ROLES[GIVEN[state]]]
        letters, states = letters + letter, states + str(state)
        if letter != "I":
            out.append((letters, states))
            letters, states, i = "", "", i + 1
    if letters:
        out[-1] = out[-1][0] + letters, out[-1][1] + states
    return out


_PATHS = "array<struct<entry: int, state: int, cost: bigint, audit: string>>"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for block, final, rows in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
            entries = range(len(STEP)) if block else (0,)
            found.append([{"entry": e, "state": s, "cost": c, "audit": a} for e in entries for s, (c, a) in search(rows, e, final).items()])
        kind = pa.list_(pa.struct([("entry", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "paths"])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks in order, of one conversation after another: the entry and audit of each block on the conversation's cheapest way.

    A state's way so far is known by its cost and its place among the others' audits: no audit of whole rows begins another
    one, so equal costs are decided by places, then by the block's own audit. Four pointers a block are held until its conversation ends.
    """

    def chosen(conv, backs: list, ends: dict) -> Iterator[tuple]:
        state = min(ends, key=lambda s: ends[s])
        for block in range(len(backs) - 1, -1, -1):
            yield conv, block, backs[block][state], state
            state = backs[block][state]

    out, ways, backs = [], {0: (0, 0)}, []
    for batch in batches:
        for conv, block, final, paths in zip(*(batch.column(k).to_pylist() for k in range(4))):
            best = {}
            for p in paths:
                if p["entry"] in ways:
                    cost, place = ways[p["entry"]]
                    way = cost + p["cost"], place, p["audit"], p["entry"]
                    best[p["state"]] = min(way, best.get(p["state"], way))
            backs.append({s: way[3] for s, way in best.items()})
            places = {s: i for i, s in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
            ways = {s: (way[0], places[s]) for s, way in best.items()}
            if final:
                out += chosen(conv, backs, ways)
                ways, backs = {0: (0, 0)}, []
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int32()))], ["conv_id", "block", "entry", "state"])
        out = []


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[{"edits": e, "states": s} for e, s in walked(*row)] for row in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
        kind = pa.list_(pa.struct([("edits", pa.string()), ("states", pa.string())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], ["conv_id", "block", "each"])


def edited(rows: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """``rows`` (``judged``) with edits, the letters of what happens before and to a row (I, K, R, D; I behind the last row), and states, a digit an edit."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    cells = rows.select("conv_id", (F.floor(F.col("n") / block)).alias("block"), "n", "last", F.concat("fault", F.when(F.col("initial") == "", " ").otherwise(F.col("initial"))).alias("cell"))
    # Characters beyond 16 bits are one character in Python, too; none of them is a role of the grammar.
    packed = cells.groupBy("conv_id", "block").agg(F.max("last").alias("final"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "cell"))), lambda x: x["cell"]), "").alias("cells"))
    solved = stored(packed.mapInArrow(tidy(_solve), f"conv_id {kind}, block long, final boolean, cells string, paths {_PATHS}"), "repair-blocks")
    ways = solved.select("conv_id", "block", "final", "paths").repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(tidy(_chain), f"conv_id {kind}, block long, entry int, state int")
    ways = ways.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "entry", "state")
    met = solved.join(ways, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")))
    way = F.get(F.filter("paths", lambda p: (p["entry"] == F.col("entry")) & (p["state"] == F.col("state"))), F.lit(0))
    walks = met.select("conv_id", "block", "cells", "entry", way["audit"].alias("audit")).mapInArrow(tidy(_walk), f"conv_id {kind}, block long, each array<struct<edits: string, states: string>>")
    each = walks.select(F.col("conv_id").alias("_c"), "block", F.posexplode("each").alias("k", "e")).select("_c", (F.col("block") * block + F.col("k")).alias("_n"), "e.edits", "e.states")
    return rows.join(each, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("n") == F.col("_n"))).drop("_c", "_n")


def _turns(edits: Column, states: Column, role: Column, text: Column) -> Column:
    """array<struct<edit, role, text>> of what a row becomes, deleted rows among it."""
    given = lambda s: F.when(s == "2", "user").otherwise("assistant")
    paired = F.zip_with(F.split(edits, ""), F.split(states, ""), lambda e, s: F.struct(e.alias("edit"), s.alias("state")))
    return F.transform(
        F.filter(paired, lambda p: p["edit"] != ""),
        lambda p: F.struct(p["edit"].alias("edit"), F.when(p["edit"].isin("K", "D"), role).otherwise(given(p["state"])).alias("role"), F.when(p["edit"] == "I", "").otherwise(text).alias("text")),
    )


def repaired(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """conv_id, n, k, edit, role, text: the turns of the repaired conversations, in order of n and k; deleted rows are left out.

    Null roles and texts read as one space. Roles that begin with no letter of the grammar, '' among them, can't be kept. Rows of a null
    conversation are one conversation. Repeated rows are duplicates. An empty table gives no rows; further columns don't count.
    """
    own = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    made = edited(stored(judged(own), "repair-rows"), block=block)
    return made.select("conv_id", "n", F.posexplode(_turns(F.col("edits"), F.col("states"), F.col("role"), F.col("text"))).alias("k", "t")).where("t.edit <> 'D'").select("conv_id", "n", "k", "t.edit", "t.role", "t.text")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """audit and repaired_sha256 of rows in order, of one conversation after another; a hash holds no more than its state."""
    conv = letters = None
    digest, any_, out = hashlib.sha256(), False, []
    started = False

    def close() -> None:
        if started:
            out.append((conv, "".join(letters), digest.hexdigest()))

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for own, edits, turns in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if not started or own != conv:
                close()
                conv, letters, digest, any_, started = own, [], hashlib.sha256(), False, True
            letters.append(edits)
            for line in turns:
                digest.update(b"\n" * any_ + line.encode())
                any_ = True
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kind), *(pa.array([r[k] for r in out], pa.string()) for k in (1, 2))], ["conv_id", "audit", "repaired_sha256"])
        out = []
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([out[0][0]], kind), pa.array([out[0][1]]), pa.array([out[0][2]])], ["conv_id", "audit", "repaired_sha256"])


def repair_table(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of ``rows``, damaged (``damaged``) and repaired.

    The cases of ``repaired`` hold. A conversation without a row after damage has zeros, an empty audit and the hash of the empty string. What a
    conversation's hash is made of passes through one task in order, one row at a time.
    """
    kind = rows.schema[conv].dataType.simpleString()
    after = stored(judged(damaged(rows, conv=conv, turn=turn, role=role, text=text)), "repair-rows")
    made = stored(edited(after, block=block).withColumn("_turns", _turns(F.col("edits"), F.col("states"), F.col("role"), F.col("text"))).select("conv_id", "n", "turn", "fault", "new_turn", "initial", "edits", F.transform(F.filter("_turns", lambda t: t["edit"] != "D"), lambda t: F.concat(t["role"], F.lit(":"), t["text"])).alias("lines")), "repair-edits")
    pair = F.concat(F.lag("initial").over(Window.partitionBy("conv_id").orderBy("n")), F.col("initial"))
    times = lambda letter: F.length("edits") - F.length(F.replace(F.col("edits"), F.lit(letter)))
    price = RELABEL * times("R") + DELETE * times("D") + INSERT * times("I") + F.when((F.col("fault") == "t") & ~F.contains("edits", F.lit("D")), TRUNCATED).otherwise(0)
    counted = made.withColumn("_illegal", F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False))).groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("new_turn"), F.lit(0)).cast("long").alias("gaps"),
        *(F.count_if(F.col("fault") == f).alias(name) for f, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))),
        F.count_if("_illegal").alias("illegal"),
        F.sum(price).cast("long").alias("cost"),
    )
    hashed = made.select("conv_id", "edits", "lines", "n").repartition("conv_id").sortWithinPartitions("conv_id", "n").select("conv_id", "edits", "lines").mapInArrow(tidy(_digests), f"conv_id {kind}, audit string, repaired_sha256 string")
    every = rows.select(F.col(conv).alias("conv_id")).distinct()
    met = every.join(counted.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left").join(hashed.withColumnRenamed("conv_id", "_h"), F.col("conv_id").eqNullSafe(F.col("_h")), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return met.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _oracle() -> str:
    """The same by dynamic programming: a row at a time, the best way to each state as struct of cost, audit and text so far."""
    step = lambda x, cost, letter, said="''": f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 't': {x}.t || {said}}}"
    put = lambda x, role: step(x, INSERT, "I", f"chr(10) || '{role}:'")
    gone = lambda x: step(x, DELETE, "D")
    again = lambda x, role: step(x, f"(CASE WHEN bad THEN 999999 WHEN fault = 't' THEN {RELABEL + TRUNCATED} ELSE {RELABEL} END)", "R", f"chr(10) || '{role}:' || text")
    kept = lambda x, initial: step(x, f"(CASE WHEN bad OR initial <> '{initial}' THEN 999999 WHEN fault = 't' THEN {TRUNCATED} ELSE 0 END)", "K", "chr(10) || role || ':' || text")
    least = lambda *ways: f"list_min([{', '.join(ways)}])"
    new = {
        "s0": gone("s0"),
        "s1": least(gone("s1"), kept("s0", "s")),
        "s2": least(gone("u"), again("s0", "user"), again("s1", "user"), again("a", "user"), kept("s0", "u"), kept("s1", "u"), kept("a", "u")),
        "s3": least(gone("a"), again("u", "assistant"), kept("u", "a")),
    }
    zero, never = "{'c': 0, 'a': '', 't': ''}", "{'c': 999999, 'a': '', 't': ''}"
    return rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
f AS (SELECT *, xor(list_reduce(flatten(list_transform(string_split(key, ''), lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS fate FROM k),
e AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM f WHERE fate <> 0),
o AS (SELECT *, sha256(text) AS h, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen FROM e),
r AS (SELECT conv_id, turn, role, text, left(role, 1) AS initial, row_number() OVER w - 1 AS n, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '-' END AS fault, lag(left(role, 1)) OVER w AS before
  FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, h, seen)),
i AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM r GROUP BY conv_id),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, {zero} AS s0, {never} AS s1, {never} AS s2, {never} AS s3 FROM i
  UNION ALL SELECT conv_id, n + 1, {new['s0']}, {new['s1']}, {new['s2']}, {new['s3']} FROM
  (SELECT d.*, r.role, r.text, r.initial, r.fault, r.fault IN ('b', 'd') AS bad, {least('d.s2', put('d.s0', 'user'), put('d.s1', 'user'), put('d.s3', 'user'))} AS u,
    {least('d.s3', put('d.s2', 'assistant'), put('(' + put('d.s0', 'user') + ')', 'assistant'), put('(' + put('d.s1', 'user') + ')', 'assistant'))} AS a FROM dp d JOIN r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.n = d.n)),
b AS (SELECT i.*, {least('s0', 's3', put('s2', 'assistant'), put('(' + put('s1', 'user') + ')', 'assistant'))} AS w FROM dp JOIN i ON i.conv_id IS NOT DISTINCT FROM dp.conv_id AND i.rows = dp.n)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(w.c, 0) AS BIGINT) AS cost, coalesce(w.a, '') AS audit, sha256(coalesce(w.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM q.conv_id"""


ORACLE = _oracle()
