import hashlib
import itertools
import re
from random import Random

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import repair

COLUMNS = "conv_id long, turn long, role string, text string"


def by_trying_all(rows):
    """(cost, audit, turns) of (fault, role, text) rows: all edits with at most one turn put in before each row and two behind the last."""
    best = None
    slots = [("", "I", "II")] * (len(rows) + 1)
    for letters in itertools.product("KRD", repeat=len(rows)):
        if any(f in "bd" and x != "D" for (f, *_), x in zip(rows, letters)):
            continue
        for put in itertools.product(*slots):
            audit = "".join(a + b for a, b in zip(put, (*letters, "")))
            cost = sum({"K": 0, "R": 3, "D": 4, "I": 3}[x] for x in audit) + sum(3 for (f, *_), x in zip(rows, letters) if f == "t" and x != "D")
            if best and (cost, audit) >= best[:2]:
                continue
            turns, k = [], 0
            for x in audit:
                if x != "I":
                    fault, role, text = rows[k]
                    k += 1
                wanted = "assistant" if turns and turns[-1][0][0] == "u" else "user"
                turns += {"K": [(role, text)], "D": [], "R": [(wanted, text)], "I": [(wanted, "")]}[x]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in turns)) and all(r for r, _ in turns):
                best = cost, audit, turns
    return best


def test_searches_find_the_cheapest_and_least(spark):
    random = Random(5)
    for _ in range(60):
        rows = [(random.choice("-----tbd"), random.choice(["user", "assistant", "system", "tool"]), f"t{i}") for i in range(random.randrange(1, 5))]
        cells = "".join(f + r[0] for f, r, _ in rows)
        cost, audit, turns = by_trying_all(rows)
        ends = repair.search(cells, 0, True)
        assert list(ends.values()) == [(cost, audit)]
        walk = repair.walked(cells, 0, audit)
        assert "".join(e for e, _ in walk) == audit and len(walk) == len(rows)


@pytest.mark.parametrize("block", [1, 2, 5])
def test_blocks_change_nothing(frame, block):
    random = Random(block)
    roles = ["user", "assistant", "system", "x", "", None]
    rows = [(c, t if random.random() > 0.1 else None, random.choice(roles), random.choice(["Yes.", "No", "", "Ok!", f"own {t}."])) for c in (1, 2, 3, None) for t in range(23)]
    docs = frame(rows, COLUMNS)
    whole, cut = (sorted(map(str, repair.repair_table(docs, block=b).collect())) for b in (256, block))
    assert whole == cut and len(whole) == 4
    turns = lambda b: sorted(map(str, repair.repaired(docs, block=b).collect()))
    assert turns(256) == turns(block)


def test_repaired_turns_alternate(spark, read):
    turns = repair.repaired(repair.damaged(read("conversations"))).collect()
    convs = {}
    for r in sorted(turns, key=lambda r: (r["conv_id"], r["n"], r["k"])):
        convs.setdefault(r["conv_id"], []).append(r)
    for own in convs.values():
        assert re.fullmatch("s?(ua)+", "".join(r["role"][0] for r in own))
        assert all(r["text"] == "" for r in own if r["edit"] == "I")
    table = {r["conv_id"]: r["repaired_sha256"] for r in repair.repair_table(read("conversations")).collect()}
    for conv, own in convs.items():
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in own).encode()).hexdigest() == table[conv]


def test_awkward_conversations(frame):
    rows = [(7, None, None, None), (7, 0, "user", "Hi."), (7, 0, "user", "Hi."), (7, 9, "assistant", "x" * 200_000), (None, None, "system", "S."), (8, 1, "", "?")]
    docs = frame(rows, COLUMNS).select("*", F.lit(1).alias("n"), F.lit("z").alias("fault"), F.lit("e").alias("edits"))
    found = {r["conv_id"]: r for r in repair.repair_table(docs).collect()}
    assert set(found) == {7, 8, None}
    assert repair.repair_table(docs.limit(0)).count() == 0 and repair.repaired(docs.limit(0)).count() == 0


def test_a_conversation_without_rows_has_zeros(frame):
    import zlib

    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = repair.repair_table(frame([(conv, 0, "user", "Hi.")], COLUMNS)).first()
    assert tuple(row) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
