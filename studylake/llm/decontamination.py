"""Benchmark passages in documents, by SimHash windows and multi-index blocks.

For every item of n words, windows of n words of a document (the whole of a
shorter one) are fingerprinted (64-bit SimHash over their word shingles).  The
64 bits are cut into five blocks of 13 or 12; two fingerprints within the radius of
19 differ in at most three bits of some block, so looking up each block's value and
its neighbours of up to three flips (377 of 8,192) in that block's directory of
items finds every item within the radius.  A window only asks the directories of
the items of its own length, about one in five of which it meets.  Each item
within the radius is verified exactly: similarity of the two shingle multisets, the sum of
smaller over the sum of larger counts.

A window without a single shingle of an item has similarity 0 to it, so only
windows around shared shingles are fingerprinted; that skips no pair.  A window
of similarity 0.8 is 9.7 bits away on average, with a deviation of 2.9: the radius
misses some 4 in 10,000 of those, and fewer of closer ones.

Items are handled in blocks of at most ``block_items``; a block's result is written and
its broadcast released before the next block is read, which bounds driver and
broadcast whatever the benchmark's size.  Where there is more than one block, one
pass over the documents keeps those that hold a shingle of any item (by a bitmap of
``GATE_BITS`` bits, which can only keep too many), and the blocks read these alone.

Defined cases: a null or empty text holds nothing; a very long text is searched
whole; an item without words is never found; an item of fewer words than a shingle
is one shingle; of equally similar windows the first counts; rows that repeat a
doc_id or an item_id give one row for a pair, the best; ids may be of any type;
empty tables give empty results; further columns are ignored (``drop_leaks``
passes them on).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import shingle_hashes, text_words, word_hashes
from .common import drop, in_arrow, passes, stage, texts_of
from .simhash_dedup import majority

SHINGLE = 5
SIMILARITY = 0.8
FLIPS = 3
#: Blocks as (first bit, bits).
BLOCKS = [(13 * b, min(13, 64 - 13 * b)) for b in range(5)]
RADIUS = len(BLOCKS) * (FLIPS + 1) - 1
#: Windows looked up at once.
LOOKED_UP = 512
_GATE = 1 << 20
#: Of the bitmap of all items' shingles, where there is more than one block of items.
GATE_BITS = 1 << 28
_CHOICES = [np.array([sum(1 << b for b in chosen) for n in range(FLIPS + 1) for chosen in combinations(range(bits), n)], np.int64) for _, bits in BLOCKS]


def shingles(words: list[str], size: int = SHINGLE) -> Counter:
    """The multiset of word runs; the whole sequence if it is shorter."""
    return Counter(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else Counter()


def similarity(a: Counter, b: Counter) -> float:
    """Sum of the smaller over the sum of the larger counts."""
    low = sum((a & b).values())
    return low / max(1, sum(a.values()) + sum(b.values()) - low)


class ItemBlock:
    """A bounded set of items with their shingles, fingerprints and block tables."""

    def __init__(self, items: list[tuple], size: int, radius: int):
        if not 0 <= radius <= RADIUS:
            raise ValueError(f"radius is 0 to {RADIUS}: the blocks guarantee no more")
        self.size, self.radius = size, radius
        self.ids, self.words = [], []
        for name, text in items:
            if words := text_words(text or ""):
                self.ids.append(name)
                self.words.append(words)
        self.bags = [shingles(w, size) for w in self.words]
        prints, of = [], {}
        for i, words in enumerate(self.words):
            hashes = self.item_hashes(words)
            prints.append(majority(hashes))
            for h in hashes.tolist():
                of.setdefault(h, set()).add(len(words))
        self.prints = np.array(prints, np.uint64)
        self.known = np.array(sorted(of), np.uint64)
        self.lengths = [sorted(of[h]) for h in self.known.tolist()]
        self.gate = np.zeros(_GATE, bool)
        self.gate[(self.known & np.uint64(_GATE - 1)).astype(np.int64)] = True
        self.short = sorted({len(w) for w in self.words if len(w) < size})
        self.counts = np.array([len(w) for w in self.words], np.int64)
        self.index()

    def index(self) -> None:
        """By length, a directory for each block of bits: items sorted by its value, and where each value's items begin."""
        self.directories: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for length in np.unique(self.counts).tolist():
            mine = np.flatnonzero(self.counts == length)
            for b, (_, bits) in enumerate(BLOCKS):
                values = self._block(self.prints[mine], b)
                order = np.argsort(values, kind="stable")
                begins = np.searchsorted(values[order], np.arange((1 << bits) + 1)).astype(np.int32)
                self.directories.setdefault(length, []).append((mine[order], begins))

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        first, bits = BLOCKS[b]
        return (prints >> np.uint64(first) & np.uint64((1 << bits) - 1)).astype(np.int64)

    def item_hashes(self, words: list[str]) -> np.ndarray:
        hashes, _ = word_hashes([" ".join(words)])
        return shingle_hashes(hashes, min(self.size, len(words)))

    def met(self, prints: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows, items) that meet in some block of bits, items of ``length`` words."""
        for at in range(0, len(prints), LOOKED_UP):
            for b, (order, begins) in enumerate(self.directories.get(length, ())):
                asked = self._block(prints[at : at + LOOKED_UP], b)[:, None] ^ _CHOICES[b][None, :]
                first = begins[asked].astype(np.int64)
                many = begins[asked + 1] - first
                w, c = np.nonzero(many)
                n = many[w, c]
                if len(n):
                    yield np.repeat(w, n) + at, order[np.repeat(first[w, c] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def found(self, prints: np.ndarray, length: int | None = None) -> np.ndarray:
        """(window, item) pairs within the radius, once each; items of ``length`` words, if given."""
        out = [np.zeros((0, 2), np.int64)]
        for n in self.directories if length is None else (length,):
            for windows, items in self.met(prints, n):
                close = np.bitwise_count(prints[windows] ^ self.prints[items]) <= self.radius
                out.append(np.stack([windows[close], items[close]], 1))
        return np.unique(np.concatenate(out), axis=0)

    def leaks(self, texts: list[str], threshold: float) -> Iterator[tuple[int, int, float, int]]:
        """(text number, item number, similarity, first word) of the best window of each pair."""
        words, bounds = word_hashes(texts)
        runs = shingle_hashes(words, self.size)
        hit = np.flatnonzero(self.gate[(runs & np.uint64(_GATE - 1)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(self.known, runs[hit]), max(0, len(self.known) - 1))
        real = self.known[spot] == runs[hit] if len(self.known) else np.zeros(0, bool)
        hit, spot = hit[real], spot[real]
        text_of = np.searchsorted(bounds, hit, "right") - 1
        per: dict[int, dict[int, set[int]]] = {}
        for p, s, t in zip(hit.tolist(), spot.tolist(), text_of.tolist(), strict=True):
            lo, hi = int(bounds[t]), int(bounds[t + 1])
            if p + self.size > hi:
                continue
            for n in self.lengths[s]:
                starts = range(max(lo, p + self.size - n), min(p, hi - n) + 1) if hi - lo >= n else (lo,)
                per.setdefault(t, {}).setdefault(n, set()).update(starts)
        for n in self.short:  # items that are one short shingle
            runs_n = shingle_hashes(words, n)
            spots = np.flatnonzero(np.isin(runs_n, self.known))
            for p, t in zip(spots.tolist(), (np.searchsorted(bounds, spots, "right") - 1).tolist(), strict=True):
                if p + n <= bounds[t + 1]:
                    per.setdefault(t, {}).setdefault(n, set()).add(p)
        for t, windows in per.items():
            listed, lo, hi, best = None, int(bounds[t]), int(bounds[t + 1]), {}
            for n, starts in windows.items():
                order = sorted(starts)
                k = min(self.size, n)
                prints = np.array([majority(shingle_hashes(words[s : min(s + n, hi)], k)) for s in order], np.uint64)
                for w, i in self.found(prints, n).tolist():
                    listed = listed or text_words(texts[t])
                    first = order[w] - lo
                    score = similarity(shingles(listed[first : first + n], self.size), self.bags[i])
                    if score >= threshold and score > best.get(i, (0.0, 0))[0]:
                        best[i] = (score, first)
            for i, (score, first) in best.items():
                yield t, i, score, first


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, shingle: int = SHINGLE, radius: int = RADIUS, block_items: int = 20_000) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: one row per pair found."""
    kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, "doc_id"), (benchmark, "item_id")))
    names = ["doc_id", "item_id", "similarity", "first_word", "n_words"]
    schema = f"doc_id {kind}, item_id {item_kind}, similarity double, first_word bigint, n_words bigint"
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    id_type = items.select("item_id").limit(0).toArrow().schema.field("item_id").type
    # A bounded block at a time comes to the driver and goes to the workers.
    blocks = _blocks(items, block_items)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        out, _ = _leaks_of(docs, ItemBlock(block, shingle, radius), threshold, schema, names, id_type)
    else:
        docs, parts = stage(_near_items(docs, items, shingle), "leaks-documents"), []
        while block is not None:
            found, shared = _leaks_of(docs, ItemBlock(block, shingle, radius), threshold, schema, names, id_type)
            parts.append(stage(found, "leaks"))
            shared.destroy()
            block, following = following, next(blocks, None)
        drop(docs)
        out = reduce(DataFrame.unionByName, parts)
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("similarity"), "first_word", "n_words")
    return out.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(names)


def _blocks(items: DataFrame, block_items: int) -> Iterator[list[tuple]]:
    """The items, ``block_items`` at a time; one empty block where there is none."""
    rows = ((r["item_id"], r["text"]) for r in items.toLocalIterator())
    yield list(islice(rows, block_items))
    while block := list(islice(rows, block_items)):
        yield block


def _runs(texts: list[str], size: int) -> Iterator[np.ndarray]:
    """The shingle hashes of each text; of one of fewer words, the hash of all."""
    words, bounds = word_hashes(texts)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield shingle_hashes(words[a:b], max(1, min(size, b - a)))


def _near_items(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """doc_id and text of the documents that may hold a shingle of an item (or are, or hold, fewer words than one)."""
    gate, short = np.zeros(GATE_BITS // 8, np.uint8), set()
    for block in _blocks(items, 1000):
        texts = [t or "" for _, t in block]
        for text, runs in zip(texts, _runs(texts, size), strict=True):
            at = (runs & np.uint64(GATE_BITS - 1)).astype(np.int64)
            np.bitwise_or.at(gate, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
            n = len(text_words(text)) if len(runs) == 1 else size
            if 0 < n < size:
                short.add(n)
    shared = docs.sparkSession.sparkContext.broadcast((gate, sorted(short)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate, short = shared.value
        for batch in batches:
            texts, keep = texts_of(batch), []
            for a, b in passes([len(t) for t in texts]):
                marks = [np.zeros(b - a, bool)]
                for n in (size, *short):
                    hits = []
                    for runs in _runs(texts[a:b], n):
                        at = (runs & np.uint64(GATE_BITS - 1)).astype(np.int64)
                        hits.append(bool((gate[at >> 3] >> (at & 7).astype(np.uint8) & 1).any()))
                    marks.append(np.array(hits, bool))
                keep.append(np.any(marks, 0))
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, text string")


def _leaks_of(docs: DataFrame, block: ItemBlock, threshold: float, schema: str, names: list[str], id_type: pa.DataType) -> tuple[DataFrame, Broadcast]:
    """The pairs of one block, and the broadcast that they are read with."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            texts = texts_of(batch)
            for a, b in passes([len(t) for t in texts]):
                rows = list(items.leaks(texts[a:b], threshold)) if items.ids else []
                ids = batch.column("doc_id").slice(a, b - a).take(pa.array([r[0] for r in rows], pa.int64()))
                columns = [pa.array([items.ids[r[1]] for r in rows], id_type), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([len(items.words[r[1]]) for r in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays([ids, *columns], names)

    return in_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, schema), shared


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """Documents that hold no passage of an item; all columns stay.

    Rows that repeat a doc_id go together; rows with a null doc_id stay.
    """
    gone = find_leaks(docs, benchmark, **how).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
