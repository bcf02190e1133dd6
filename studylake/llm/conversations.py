"""Repair of damaged conversations by cheapest edits, as a time-major NumPy program.

A whole conversation's roles read ``(s?(ua)+)?``: perhaps a system row, then user and
assistant in turn.  Rows may be kept (0), given the role user or assistant (2) or
deleted (3), and empty rows of user or assistant may be put in anywhere (2).  Blank
rows and repeats of an earlier row must be deleted; a row whose text breaks off costs 1
if it stays.  Of the cheapest edits those whose initials (D, I, K, R) come first in
ASCII order are taken.  What is open after a prefix is one of four states (nothing yet,
after system, user, assistant), and each edit leads from a state to one state, so the
choice is a walk: backward costs for all states, then forward by the first letter that
keeps the cost.

Rows are dealt by ranges of (conversation, turn, ...) and sorted, and consecutive rows
of a conversation form pieces of ``piece_rows`` rows at most, so that a conversation of
a third of all rows is many pieces in many tasks.  In a task, pieces are bucketed by length
to powers of two, and a bucket is one tensor (time, state, conversation).  Pieces that
may have neighbours (cut ones, the first and last of a partition) take a way of small
steps more, exact at any length: repeats across pieces by the digests of their rows;
a (min, +) matrix of costs for each piece; the costs behind each piece as a scan over those;
the state that each of four starts ends in; the true start as a scan over those maps.
Both scans work on one partition's pieces at a time and then on one row a partition.

Defined cases: null roles and texts count as one space; null turns come first and
don't count in gaps; a null conv_id is a conversation; rows of one turn come by role, then
by a hash of the text, equal rows side by side; a role without a character or with another
initial is never kept; empty and very long texts are worked on whole; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, stage

BLANKS = " \t\n\x0b\f\r"
PIECE_ROWS = 2048
PIECE_CHARS = 4_000_000
#: States: nothing yet, after system, after user, after assistant.
NEXT = np.array([2, 2, 3, 2])
ROLE = ("", "system", "user", "assistant")
FAR = 1 << 40
#: What is still to pay where the conversation ends: nothing, two rows, one row, nothing.
AT_END = np.array([0, 4, 2, 0])
D, I, K, R = 0, 1, 2, 3  # edits in the order of their initials
GONE = (1, 2)  # faults whose rows must go: blank, duplicate
CUT = 3


def faults_of(roles: list[str], texts: list[str]) -> list[int]:
    """The first fault of each row: 0 none, 1 blank, 2 duplicate, 3 truncated."""
    seen, out = set(), []
    for role, text in zip(roles, texts, strict=True):
        body = text.rstrip(BLANKS)
        out.append(1 if not body else 2 if (role, text) in seen else 0 if body[-1] in ".!?" else CUT)
        seen.add((role, text))
    return out


def _initials(roles: list[str]) -> np.ndarray:
    """1 s, 2 u, 3 a, 0 any other."""
    return np.array(["?sua".index(r[0]) if r[:1] in ("s", "u", "a") else 0 for r in roles], np.int64)


def _keep(role: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The state after keeping a row, 0 if it can't be kept."""
    return np.where((role == NEXT[state]) | ((role == 1) & (state == 0)), role, 0)


def backward(role: np.ndarray, gone: np.ndarray, cut: np.ndarray, size: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Costs (time + 1, state, conversation) from each row on; rows are (time, conversation), ``behind`` the costs after the last."""
    steps, n = role.shape
    cost = np.empty((steps + 1, 4, n), np.int64)
    cost[steps] = behind
    states = np.arange(4)[:, None]
    for t in range(steps - 1, -1, -1):
        after = cost[t + 1]
        here = 3 + after
        stays = np.where(gone[t], FAR, cut[t])
        np.minimum(here, stays + 2 + after[NEXT], out=here)
        kept = _keep(role[t][None, :], states)
        np.minimum(here, np.where(kept > 0, stays + np.take_along_axis(after, kept, 0), FAR), out=here)
        user, assistant = np.minimum(here[2], 2 + here[3]), np.minimum(here[3], 2 + here[2])
        here[2], here[3] = user, assistant
        here[0], here[1] = np.minimum(here[0], 2 + user), np.minimum(here[1], 2 + user)
        cost[t] = np.where(t < size, here, after)
    return cost


def forward(cost: np.ndarray, role: np.ndarray, gone: np.ndarray, cut: np.ndarray, size: np.ndarray, start: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edits (step, conversation; -1 none), the states after them (same shape) and the state of each conversation at its end.

    Each step takes for every conversation the first letter whose edit keeps the cost.
    Where ``last`` holds, the rows that the end asks for are put in too.
    """
    steps, n = role.shape
    at, state, every = np.zeros(n, np.int64), start.copy(), np.arange(n)
    edits, states = [], []
    while True:
        inside = at < size
        busy = inside | (last & (AT_END[state] > 0))
        if not busy.any():
            shape = (0, n)
            return (np.stack(edits) if edits else np.zeros(shape, np.int8)), (np.stack(states) if states else np.zeros(shape, np.int64)), state
        row = np.minimum(at, max(steps - 1, 0))
        due, more = cost[at, state, every], cost[np.minimum(at + 1, steps), :, every]
        free = inside & ~gone[row, every]
        kept = np.where(free, _keep(role[row, every], state), 0)
        delete = inside & (3 + more[every, state] == due)
        insert = np.where(inside, 2 + cost[at, NEXT[state], every] == due, busy)
        keep = (kept > 0) & (cut[row, every] + more[every, kept] == due)
        edit = np.where(~busy, -1, np.where(delete, D, np.where(insert, I, np.where(keep, K, R))))
        state = np.where(edit == K, kept, np.where((edit == I) | (edit == R), NEXT[state], state))
        at = at + ((edit >= 0) & (edit != I))
        edits.append(edit.astype(np.int8))
        states.append(state)


def _buckets(sizes: list[int]) -> dict[int, list[int]]:
    """Places by length, padded to a power of two."""
    out: dict[int, list[int]] = {}
    for i, n in enumerate(sizes):
        out.setdefault(1 << max(n - 1, 0).bit_length() if n else 0, []).append(i)
    return out


def _tensor(values: list[np.ndarray], steps: int) -> np.ndarray:
    out = np.zeros((steps, len(values)), np.int64)
    for k, v in enumerate(values):
        out[: len(v), k] = v
    return out


class Pieces:
    """The pieces of a batch, by buckets of length."""

    def __init__(self, roles: list[list[str]], faults: list[list[int]]):
        self.roles = roles
        sizes = [len(r) for r in roles]
        self.groups = []
        for steps, places in _buckets(sizes).items():
            fault = _tensor([np.array(faults[i], np.int64) for i in places], steps)
            role = _tensor([_initials(roles[i]) for i in places], steps)
            self.groups.append((places, role, np.isin(fault, GONE), (fault == CUT).astype(np.int64), np.array([sizes[i] for i in places])))

    def matrices(self) -> np.ndarray:
        """(piece, from, to): the least cost from a state before the piece to one after it."""
        out = np.zeros((len(self.roles), 4, 4), np.int64)
        for places, *rows in self.groups:
            for to in range(4):
                out[places, :, to] = np.minimum(backward(*rows, np.where(np.arange(4) == to, 0, FAR)[:, None])[0].T, FAR)
        return out

    def walk(self, behind: np.ndarray, start: np.ndarray, last: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int, int]]:
        """For each piece: its edits, the states after them, its state at the end, its cost."""
        out: list = [None] * len(self.roles)
        for places, role, gone, cut, size in self.groups:
            cost = backward(role, gone, cut, size, behind[places].T)
            edits, states, end = forward(cost, role, gone, cut, size, start[places], last[places])
            before = cost[0][start[places], np.arange(len(places))]
            left = np.where(last[places], 0, behind[places, end])
            for k, i in enumerate(places):
                mine = edits[:, k] >= 0
                out[i] = (edits[mine, k], states[mine, k], int(end[k]), int(before[k] - left[k]))
        return out


def repaired(roles: list[str], texts: list[str], edits: np.ndarray, states: np.ndarray) -> list[tuple[str, str]]:
    """The rows that the edits leave."""
    out, at = [], 0
    for edit, state in zip(edits.tolist(), states.tolist(), strict=True):
        if edit == I:
            out.append((ROLE[state], ""))
            continue
        if edit != D:
            out.append((roles[at] if edit == K else ROLE[state], texts[at]))
        at += 1
    return out


def illegal_pairs(initials: str) -> int:
    return sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


ROWS = "array<struct<role: string, text: string>>"
#: Of a piece: the partition, its place, whether it is a conversation for certain, its turns and rows.
CUT_ROWS = "block bigint, piece bigint, whole boolean, low bigint, high bigint, turns bigint, roles array<string>, texts array<string>, faults array<int>"
#: Of a repaired piece: its turns, the first and last role's initials, its faults, cost, edits and rows.
FOUND = f"piece bigint, whole boolean, low bigint, high bigint, turns bigint, head string, tail string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired {ROWS}"


def _pieces(rows: DataFrame, piece_rows: int) -> DataFrame:
    """Consecutive rows of a conversation: conv_id, the partition (block), the piece's place and CUT_ROWS."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("text", "role"))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text, F.monotonically_increasing_id().alias("row"))
    # Texts themselves are no part of the order: Spark samples its keys on the driver.
    keys = ["conv_id", "turn", "role", F.xxhash64("text"), "row"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        number, conv, held, chars, first = 0, None, [], 0, True

        def emit(whole: bool) -> pa.RecordBatch:
            turns = [t for t, _, _ in held if t is not None]
            roles, texts = [r for _, r, _ in held], [x for _, _, x in held]
            one = [block, (block << 32) + number, whole, min(turns, default=None), max(turns, default=None), len(set(turns)), roles, texts, faults_of(roles, texts)]
            return pa.RecordBatch.from_arrays([pa.array([conv], kind)] + [pa.array([v], t) for v, t in zip(one, types, strict=True)], names)

        for batch in batches:
            for c, *row in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text")), strict=True):
                if held and (c != conv or len(held) >= piece_rows or chars > PIECE_CHARS):
                    yield emit(c != conv and not first)
                    first = c == conv
                    number, held, chars = number + 1, [], 0
                conv = c
                held.append(row)
                chars += len(row[2])
        if held:
            yield emit(False)

    kind = pa.int64() if rows.schema["conv_id"].dataType.simpleString() == "bigint" else pa.string()
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32())]
    names = _names(CUT_ROWS)
    return in_arrow(ordered, run, f"conv_id {_kind(rows)}, {CUT_ROWS}")


def _kind(rows: DataFrame) -> str:
    return rows.schema["conv_id"].dataType.simpleString()


def _names(schema: str) -> list[str]:
    """The columns of a piece's schema."""
    return ["conv_id", *[c.split()[0] for c in schema.split(", ") if ":" not in c.split()[0]]]


def _result(batch: pa.RecordBatch, pieces: Pieces, walked: list) -> pa.RecordBatch:
    texts, faults = batch.column("texts").to_pylist(), batch.column("faults").to_pylist()
    count = lambda k: pa.array([f.count(k) for f in faults], pa.int64())
    heads = ["".join(r[:1] or " " for r in rs) for rs in pieces.roles]
    rows = [[{"role": r, "text": x} for r, x in repaired(rs, ts, e, s)] for rs, ts, (e, s, _, _) in zip(pieces.roles, texts, walked, strict=True)]
    columns = [batch.column(c) for c in ("conv_id", "piece", "whole", "low", "high", "turns")]
    columns += [pa.array([h[:1] for h in heads]), pa.array([h[-1:] for h in heads]), count(1), count(2), count(3)]
    columns += [pa.array([illegal_pairs(h) for h in heads], pa.int64()), pa.array([c for *_, c in walked], pa.int64())]
    columns += [pa.array(["".join("DIKR"[k] for k in e.tolist()) for e, *_ in walked]), pa.array(rows, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
    return pa.RecordBatch.from_arrays(columns, _names(FOUND))


def _read(batch: pa.RecordBatch) -> Pieces:
    return Pieces(batch.column("roles").to_pylist(), batch.column("faults").to_pylist())


def _repair_whole(pieces: DataFrame) -> DataFrame:
    """Conversations that are one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            found = _read(batch)
            yield _result(batch, found, found.walk(np.tile(AT_END, (n, 1)), np.zeros(n, np.int64), np.ones(n, bool)))

    return in_arrow(pieces.drop("block"), run, f"conv_id {_kind(pieces)}, {FOUND}")


def _scan(rows: DataFrame, join: Callable[[np.ndarray, np.ndarray], np.ndarray], empty: np.ndarray, reverse: bool) -> DataFrame:
    """conv_id, piece, value: ``join`` of the values of all pieces before each one (behind it, if ``reverse``).

    In two levels, by an associative ``join``: pieces of one partition, then one row
    for each partition; no group holds more than those.
    """
    kind = _kind(rows)
    shape = empty.shape

    def values(frame: pd.DataFrame) -> list[np.ndarray]:
        return [np.array(v, np.int64).reshape(shape) for v in frame["value"]]

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        total = reduce(join, values(frame.sort_values("piece")))
        return pd.DataFrame({"conv_id": frame["conv_id"].iloc[:1], "block": frame["block"].iloc[:1], "value": [total.ravel().tolist()]})

    def run(frame: pd.DataFrame, first: np.ndarray) -> list[list[int]]:
        out, so_far = [], first
        for v in values(frame) if not reverse else values(frame)[::-1]:
            out.append(so_far.ravel().tolist())
            so_far = join(v, so_far) if reverse else join(so_far, v)
        return out[::-1] if reverse else out

    def over_blocks(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        return frame.assign(value=run(frame, empty))

    def over_pieces(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("piece")
        first = np.array(frame["outer"].iloc[0], np.int64).reshape(shape)
        return frame.assign(value=run(frame, first))[["conv_id", "piece", "value"]]

    by = ["conv_id", "block"]
    blocks = rows.groupBy(by).applyInPandas(fold, f"conv_id {kind}, block bigint, value array<bigint>")
    outer = blocks.groupBy("conv_id").applyInPandas(over_blocks, f"conv_id {kind}, block bigint, value array<bigint>")
    outer = outer.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.col("value").alias("outer"))
    both = rows.join(outer, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b")
    return both.groupBy(by).applyInPandas(over_pieces, f"conv_id {kind}, piece bigint, value array<bigint>")


def _min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), FAR)


def _across(pieces: DataFrame) -> DataFrame:
    """Pieces whose ``faults`` count repeats of rows in earlier pieces too."""
    row = F.posexplode(F.arrays_zip("roles", "texts", "faults")).alias("at", "r")
    rows = pieces.select("conv_id", "piece", row).filter(~F.col("r.faults").isin(*GONE))
    role, text = F.col("r.roles"), F.col("r.texts")
    rows = rows.select("conv_id", "piece", "at", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"))
    firsts = rows.groupBy("conv_id", "digest").agg(F.min("piece").alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first")
    again = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))).filter("piece > first")
    marks = again.groupBy("piece").agg(F.collect_set("at").alias("again"))  # as many as a piece has rows at most
    fault = F.transform("faults", lambda f, i: F.when(F.array_contains("again", i), 2).otherwise(f))
    return pieces.join(marks, "piece", "left").withColumn("faults", F.when(F.col("again").isNotNull(), fault).otherwise(F.col("faults"))).drop("again")


def _repair_pieces(pieces: DataFrame) -> DataFrame:
    """Conversations that may be several pieces: one row for each piece, as if repaired at once."""
    kind = _kind(pieces)
    pieces = stage(_across(pieces), "conversations-marked")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _read(batch).matrices().reshape(-1, 16)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("conv_id", "block", "piece")] + [pa.array(found.tolist(), pa.list_(pa.int64()))], ["conv_id", "block", "piece", "value"])

    narrow = pieces.select("conv_id", "block", "piece", "roles", "faults")
    costs = in_arrow(narrow, matrices, f"conv_id {kind}, block bigint, piece bigint, value array<bigint>")
    one = np.where(np.eye(4, dtype=bool), 0, FAR)
    behind = stage(_scan(stage(costs, "conversations-costs"), _min_plus, one, True).select("piece", F.col("value").alias("behind")), "conversations-behind")

    def walk(batch: pa.RecordBatch, starts: np.ndarray) -> tuple[Pieces, list]:
        matrix = np.array(batch.column("behind").to_pylist(), np.int64).reshape(-1, 4, 4)
        found = _read(batch)
        last = (matrix == one).all((1, 2))  # nothing behind it
        return found, found.walk((matrix + AT_END[None, None, :]).min(2), starts, last)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            to = np.array([[end for _, _, end, _ in walk(batch, np.full(n, s))[1]] for s in range(4)], np.int64).reshape(4, n).T
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("conv_id", "block", "piece")] + [pa.array(to.tolist(), pa.list_(pa.int64()))], ["conv_id", "block", "piece", "value"])

    maps = stage(in_arrow(narrow.join(behind, "piece"), ends, f"conv_id {kind}, block bigint, piece bigint, value array<bigint>"), "conversations-ends")
    start = _scan(maps, lambda a, b: b[a], np.arange(4), False).select("piece", F.col("value")[0].alias("start"))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _result(batch, *walk(batch, np.array(batch.column("start").to_pylist(), np.int64)))

    return in_arrow(pieces.drop("block").join(behind, "piece").join(start, "piece"), final, f"conv_id {kind}, {FOUND}")


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Pieces of repaired conversations, in order by ``piece``: conv_id and FOUND.

    ``audit`` and ``repaired`` are the edits and rows of the piece; ``whole`` says that
    it is all of its conversation.
    """
    pieces = stage(_pieces(rows, piece_rows), "conversations-pieces")
    return stage(_repair_whole(pieces.filter("whole")).unionByName(_repair_pieces(pieces.filter("NOT whole"))), "conversations-repaired")


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in, by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row,
    1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes it the user's.  Nulls count as one space."""
    or_blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(or_blank("conv_id"), F.lit(":"), or_blank("turn"))) % 20
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    marked = rows.select("conv_id", "turn", or_blank("role").alias("role"), or_blank("text").alias("text"), k.alias("k")).filter("k <> 0")
    marked = marked.withColumn("copy", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return marked.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def digest_repairs(found: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each conv_id of ``ids``: counts of faults, edits and a digest of the repaired rows.

    Pieces of one conversation are read in order as a stream, whose hash goes on from
    one to the next; a task holds one piece.
    """
    line = F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    zero = F.lit(0).cast("long")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), zero)
    columns = [F.col(c) for c in COUNTS[1:]]
    whole = found.filter("whole").select("conv_id", gaps.alias("gaps"), *columns, "audit", F.sha2(F.array_join(line, "\n"), 256).alias("repaired_sha256"))
    kind = _kind(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, open_, sums, audit, sha, empty, turns, tail = None, False, [], [], None, True, None, ""

        def emit() -> pa.RecordBatch:
            low, high, distinct = turns
            gap = 0 if low is None else high - low + 1 - distinct
            values = [pa.array([conv], arrow)] + [pa.array([v], pa.int64()) for v in (gap, *sums)] + [pa.array(["".join(audit)]), pa.array([sha.hexdigest()])]
            return pa.RecordBatch.from_arrays(values, ["conv_id", *COUNTS, "audit", "repaired_sha256"])

        for batch in batches:
            for row in batch.to_pylist():
                if not open_ or row["conv_id"] != conv:
                    if open_:
                        yield emit()
                    conv, open_, sums, audit, sha, empty, turns, tail = row["conv_id"], True, [0] * 5, [], hashlib.sha256(), True, (None, None, 0), ""
                sums = [a + row[c] for a, c in zip(sums, COUNTS[1:], strict=True)]
                sums[3] += illegal_pairs(tail + row["head"]) if tail else 0
                tail = row["tail"]
                if row["low"] is not None:
                    low, high, distinct = turns
                    turns = (row["low"] if low is None else low, row["high"], distinct + row["turns"] - (high == row["low"]))
                audit.append(row["audit"])
                if row["n"]:
                    sha.update((row["body"] if empty else "\n" + row["body"]).encode())
                    empty = False
        if open_:
            yield emit()

    arrow = pa.int64() if kind == "bigint" else pa.string()
    parts = found.filter("NOT whole").select("conv_id", "piece", "low", "high", "turns", "head", "tail", *columns, "audit", F.size("repaired").alias("n"), F.array_join(line, "\n").alias("body"))
    types = ", ".join(f"{c} bigint" for c in COUNTS)
    cut = in_arrow(parts.repartition("conv_id").sortWithinPartitions("conv_id", "piece"), run, f"conv_id {kind}, {types}, audit string, repaired_sha256 string")
    every = ids.select("conv_id").distinct().withColumnRenamed("conv_id", "id")
    joined = every.join(whole.unionByName(cut), F.col("id").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(
        F.col("id").alias("conv_id"), *[F.coalesce(c, zero).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
