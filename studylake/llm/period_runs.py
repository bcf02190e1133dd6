"""Periodic runs of words, found on a harmonic grid.

A run is a stretch of consecutive words with smallest period q and a length of at
least ``max(least, 2 * q)`` that no neighbouring word extends.  A stretch of period p
and length 2p or more has p consecutive positions i whose word equals word i + p,
so one of them is a multiple of p: it is enough to compare words jp and (j + 1)p for
every p, some n ln n comparisons for n words.  Periods are taken in octaves, from
small to large, all texts of a pass at once.  Grid points that lie in a run found
before whose period divides p are skipped.  The words beside the surviving ones are
compared in chunks that double, to both sides and no further than p (the next grid
point takes over there), and a point leaves as soon as the equal words around it
can't make up a run.  Neighbouring points of one stretch are put together.

A stretch of period p and length 2p or more whose smallest period is q has q | p
and is the run of q itself, so of equal stretches the smallest period is kept.

Words are numbered by an exact dictionary; nothing is told apart by a hash.  Every
document is worked on in one pass over its words; a pass holds about
``WORDS_PER_PASS`` words (one document at least) and ``POINTS`` grid points.

Defined cases: a null or empty text has no words and no run; very long texts are
worked on whole; equal stretches count once; runs that overlap all count; rows that
repeat a doc_id or text each get their row; a null doc_id keeps its row (and is never
altered by ``repeat_tails``); an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, passes, texts_of

LEAST = 12
WORDS_PER_PASS = 200_000
POINTS = 1_000_000
CHUNK = 8


def _grid(low: int, high: int, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, position) of the grid points of periods low..high-1, in parts of about POINTS."""
    texts = np.flatnonzero(size >= 2 * low)
    tops = np.minimum(high - 1, size[texts] // 2)
    periods = tops - low + 1
    text = np.repeat(texts, periods)
    p = np.arange(periods.sum()) - np.repeat(np.cumsum(periods) - periods, periods) + low
    points = (size[text] - 1) // p  # positions 0, p, 2p, ... whose partner is inside the text
    ends = np.cumsum(points)
    start = 0
    while start < len(p):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + POINTS, side="right")))
        n = points[start:stop]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        period = np.repeat(p[start:stop], n)
        yield np.repeat(text[start:stop], n), period, step * period
        start = stop


def _stretch(word: np.ndarray, at: np.ndarray, p: np.ndarray, back: np.ndarray, ahead: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, ...]:
    """For points whose words are equal: kept points, equal words before and after each.

    ``back`` and ``ahead`` bound how far to look.  Points that can't reach ``need``
    equal words in a row are dropped as soon as that is known.
    """
    kept = np.arange(len(at))
    sides = [np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)]
    open_, room = [back > 0, ahead > 0], [back, ahead]
    chunk = CHUNK
    while True:
        for k, sign in enumerate((-1, 1)):
            todo = np.flatnonzero(open_[k])
            for a in range(0, len(todo), max(1, POINTS // chunk)):
                some = todo[a : a + max(1, POINTS // chunk)]
                step = sides[k][some, None] + np.arange(1, chunk + 1)
                inside = step <= room[k][some, None]
                first = at[some, None] + sign * np.where(inside, step, 0)
                equal = inside & (word[first] == word[first + p[some, None]])
                run = np.where(equal.all(1), chunk, equal.argmin(1))
                sides[k][some] += run
                open_[k][some] = (run == chunk) & (sides[k][some] < room[k][some])
        alive = open_[0] | open_[1] | (sides[0] + sides[1] + 1 >= need)
        if not alive.all():
            kept, at, p, need = kept[alive], at[alive], p[alive], need[alive]
            sides, open_, room = ([x[alive] for x in group] for group in (sides, open_, room))
        if not (open_[0].any() or open_[1].any()):
            return kept, sides[0], sides[1]
        chunk *= 2


def runs_of(words: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period.

    ``words`` holds the word numbers of all texts, ``sizes`` the words of each.
    """
    first = np.cumsum(sizes) - sizes
    reach = np.full(len(words), -1)  # end of a run that holds the word, and that run's period
    period_at = np.ones(len(words), np.int64)
    found = []
    low = 1
    while len(sizes) and 2 * low <= sizes.max():
        fresh = []
        for text, p, step in _grid(low, 2 * low, np.where(sizes >= least, sizes, 0)):
            at = first[text] + step
            same = words[at] == words[at + p]
            text, p, step, at = text[same], p[same], step[same], at[same]
            known = (reach[at] > at + p) & (p % period_at[at] == 0)
            text, p, step, at = text[~known], p[~known], step[~known], at[~known]
            need = np.maximum(p, least - p)
            # One step beyond p shows that the next grid point belongs to the same stretch; short periods need more.
            room = np.maximum(p, need)
            kept, before, after = _stretch(words, at, p, np.minimum(step, room), np.minimum(sizes[text] - 1 - p - step, room), need)
            if not len(kept):
                continue
            text, p, step = text[kept], p[kept], step[kept]
            left, right = step - before, step + after
            # Points are sorted by text, period and position; stretches of one period either overlap or are apart.
            new = np.ones(len(kept), bool)
            new[1:] = (text[1:] != text[:-1]) | (p[1:] != p[:-1]) | (left[1:] > right[:-1] + 1)
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(kept)) - 1
            fresh.append(np.stack([text[head], left[head], right[tail] + 1 + p[head] - left[head], p[head]], 1))
        for text, start, length, p in np.concatenate(fresh) if fresh else ():
            a = first[text] + start
            inside = slice(a, a + length)
            further = reach[inside] < a + length
            reach[inside][further] = a + length
            period_at[inside][further] = p
        found += fresh
        low *= 2
    rows = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    rows = rows[rows[:, 2] >= np.maximum(least, 2 * rows[:, 3])]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    if len(rows):  # of equal stretches the smallest period
        rows = rows[np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(1))]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def repeats(runs: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` words lie in a run after its first period; ``runs``: start, length, period."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and period),
    collapsed (the words that are no repeats, joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in passes([len(t) // 4 for t in texts], WORDS_PER_PASS):
                split = [t.encode("utf-8", "surrogatepass").split() for t in texts[a:b]]  # at the six white spaces of ASCII
                sizes = np.array([len(w) for w in split], np.int64)
                number: dict[bytes, int] = {}
                words = np.fromiter((number.setdefault(w, len(number)) for ws in split for w in ws), np.int64, int(sizes.sum()))
                rows = runs_of(words, sizes, least)
                cuts = np.searchsorted(rows[:, 0], np.arange(len(split) + 1))
                collapsed = []
                for k, ws in enumerate(split):
                    mine = rows[cuts[k] : cuts[k + 1], 1:]
                    if len(mine):
                        keep = ~repeats(mine, len(ws))
                        ws = [w for w, x in zip(ws, keep, strict=True) if x]
                    collapsed.append(b" ".join(ws).decode("utf-8", "surrogatepass"))
                parts = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(sizes), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), parts), pa.array(collapsed, pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return in_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, schema)


def repeat_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the documents end in a repeated stretch.

    With h the crc32 of the doc_id and n words, where h % 10 = 0 the words from
    a = h / 10 % n on repeat their first p = 1 + (n - a) / (3 + h / 10 % 8).
    """
    h, text = F.crc32(F.col("doc_id").cast("string")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    g = F.floor(h / 10)

    def altered(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        whole = F.flatten(F.array_repeat(F.slice(w, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a.cast("int")), whole), F.lit(1), n), " ")

    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    marked = docs.select("doc_id", text.alias("text"), F.when(h % 10 == 0, words).alias("w"))
    return marked.select("doc_id", F.when(F.size("w") > 0, altered(F.col("w"))).otherwise(F.col("text")).alias("text"))


def digest_runs(found: DataFrame) -> DataFrame:
    """One row per document: the number of runs, the longest of them, digests of all runs and of the rest."""
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), 1)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    per = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, longest).alias("top"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("top.l")
    return per.select(
        "doc_id", "n_runs", F.col("top.s").alias("start"), length.alias("length"), F.col("top.p").alias("period"),
        F.floor(F.lit(1000) * length / F.col("top.p")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
