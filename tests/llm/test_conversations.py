"""Repair of conversations against a plain program for one conversation."""

from __future__ import annotations

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest

from studylake.llm import conversations as c
from studylake.llm import queries

BLANKS = " \t\n\x0b\f\r"


def cheapest(rows):
    """(cost, audit) and repaired rows by trying every edit; rows: role, must go, truncated."""
    want = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, state, inserts):
        options = []
        if i == len(rows) and state in ("", "a"):
            options.append((0, "", ()))
        if inserts < 2:
            cost, audit, out = best(i, want[state], inserts + 1)
            options.append((cost + 2, "I" + audit, ((want[state], None), *out)))
        if i < len(rows):
            role, gone, cut = rows[i]
            cost, audit, out = best(i + 1, state, 0)
            options.append((cost + 3, "D" + audit, out))
            if not gone:
                cost, audit, out = best(i + 1, want[state], 0)
                options.append((cost + 2 + cut, "R" + audit, ((want[state], i), *out)))
                if role[:1] == want[state] or (role[:1] == "s" and state == ""):
                    cost, audit, out = best(i + 1, role[:1], 0)
                    options.append((cost + cut, "K" + audit, (("", i), *out)))
        return min(options, default=(10**9, "", ()), key=lambda o: o[:2])

    return best(0, "", 0)


def expected(rows):
    """The contract's columns for one conversation's rows after damage: (turn, role, text) in order."""
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(BLANKS)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    pairs = [(a[1][:1] or " ") + (b[1][:1] or " ") for a, b in zip(rows, rows[1:], strict=False)]
    cost, audit, out = cheapest(tuple((r, f in ("blank", "duplicate"), f == "truncated") for (_, r, _), f in zip(rows, faults, strict=True)))
    full = {"u": "user", "a": "assistant"}
    lines = [f"{full[r]}:" if i is None else f"{full.get(r) or rows[i][1]}:{rows[i][2]}" for r, i in out]
    counts = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost)
    return (*counts, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damaged(rows):
    """Rows (conv, turn, role, text) after the contract's damage, by conversation and turn."""
    out = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        mine = out.setdefault(conv, [])
        if k == 0:
            continue
        text = "" if k == 1 else "".join(x for x in text if x not in ".!?") if k == 2 else text
        mine += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for k, v in out.items()}


def as_tuples(df):
    names = (*c.COUNTS, "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[n] for n in names) for r in df.collect()}


def repaired(spark, rows, **how):
    ids = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return as_tuples(c.digest_repairs(c.repair(c.damage(ids), **how), ids))


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_tuples(queries.op13_conversation_repair(spark, folder)) == {k: expected(v) for k, v in damaged(rows).items()}


def _random_rows(rng, convs, longest):
    rows = []
    for conv in convs:
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "no", "Well!", "", " \n", None, f"text {rng.randrange(5)}.", f"cut {turn}", f"Line one.\nAnd {turn}?"])
            rows.append((conv, rng.choice([turn, turn, turn + 3 * turn // 4, None]) if rng.random() < 0.05 else turn, role, text))
    return rows


@pytest.mark.parametrize("piece_rows", [1, 3, c.PIECE_ROWS])
def test_pieces_of_any_length_agree(spark, piece_rows):
    """Conversations cut into pieces give what they give whole; one holds most of the rows."""
    rng = random.Random(piece_rows)
    rows = _random_rows(rng, [None, *range(40)], 12)
    rows += [(99, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Same.", "same", f"t{rng.randrange(40)}.", ""])) for t in range(300)]
    want = {}
    for conv, mine in damaged(rows).items():
        if len({t for t, _, _ in mine}) == len(mine) or conv == 99:
            want[conv] = expected(mine)
    got = repaired(spark, rows, piece_rows=piece_rows)
    assert set(got) == {r[0] for r in rows}
    assert {k: got[k] for k in want} == want


def test_numpy_walk_equals_every_edit_tried():
    rng = random.Random(5)
    convs = [[(rng.choice("suax"), rng.randrange(4)) for _ in range(rng.randrange(1, 10))] for _ in range(600)]
    found = c.Pieces([[r for r, _ in v] for v in convs], [[f for _, f in v] for v in convs])
    n = len(convs)
    walked = found.walk(np.tile(c.AT_END, (n, 1)), np.zeros(n, np.int64), np.ones(n, bool))
    for v, (edits, _, _, cost) in zip(convs, walked, strict=True):
        want = cheapest(tuple((r, f in c.GONE, f == c.CUT) for r, f in v))
        assert (cost, "".join("DIKR"[e] for e in edits)) == want[:2]


def test_defined_cases(spark):
    nothing = hashlib.sha256(b"").hexdigest()
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert c.digest_repairs(c.repair(empty), empty).count() == 0
    # Repeated rows of one turn, null turns first, a clashing further column.
    rows = [(1, 2, "user", "Hi."), (1, 2, "user", "Hi."), (1, None, "system", "Be brief."), (1, 3, "assistant", "Yes"), (2, None, None, None)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, piece long")
    got = as_tuples(c.digest_repairs(c.repair(df), df.unionByName(spark.createDataFrame([(3, None, None, None, 1)], df.schema))))
    assert got[1][:7] == (0, 0, 1, 1, 1, 4, "KKDK")
    assert got[1][7] == hashlib.sha256(b"system:Be brief.\nuser:Hi.\nassistant:Yes").hexdigest()
    assert got[2] == (0, 1, 0, 0, 0, 3, "D", nothing)
    assert got[3] == (0, 0, 0, 0, 0, 0, "", nothing)


def test_very_long_text(spark):
    text = "word " * 400_000 + "end."
    rows = [(1, 0, "user", text), (1, 1, "assistant", text)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = as_tuples(c.digest_repairs(c.repair(df), df))
    assert got[1] == (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(f"user:{text}\nassistant:{text}".encode()).hexdigest())
