"""Harmonic packing of token sequences.

A piece belongs to class k if its length lies in (C/(k+1), C/k], C being the
capacity, and k pieces of class k fill one sequence.  Classes never mix, so a
piece's sequence follows from its number within its class alone: workers need
only the counts of the others.  Whole capacities are cut off a document first;
the rest is cut at class capacities wherever its class would waste more than
``slack``.  Beyond ``fine`` pieces a sequence, classes grow geometrically.

What is left over, fewer than k pieces in each class whatever the input, is
packed by best fit in one small group; those sequences come last.

Defined cases: a null or empty text is the end id alone; a very long text is
encoded whole and cut into pieces; rows that repeat a doc_id are packed each, ties
in the order read; a null doc_id is kept; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, passes, stage, texts_of
from .word_tokens import shared_encoder

CAPACITY = 4096
END_ID = 2
#: Counts by task and class that are broadcast (12 MB); more are joined by shuffle.
BROADCAST_COUNTS = 500_000


def class_sizes(capacity: int = CAPACITY, fine: int = 48) -> list[int]:
    """Pieces per sequence of each class: 1, 2, 3 ... fine, then steps of an eighth."""
    sizes = list(range(1, min(fine, capacity) + 1))
    while sizes[-1] < capacity:
        sizes.append(min(capacity, sizes[-1] + max(1, sizes[-1] // 8)))
    return sizes


def class_of(length: int, capacity: int, sizes: list[int]) -> int:
    """The largest class size whose pieces may be as long as ``length``."""
    k = capacity // length
    return sizes[int(np.searchsorted(sizes, k, "right")) - 1]


def cut(length: int, capacity: int, sizes: list[int], slack: float = 0.02, least: int = 64) -> list[tuple[int, int]]:
    """Pieces (length, class) of a document of ``length`` tokens, in order."""
    pieces = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = class_of(rest, capacity, sizes)
        if rest <= least or rest * k >= capacity * (1 - slack):
            pieces.append((rest, k))
            break
        # The longest piece of the next class there is: that class has more than capacity / rest pieces, so 0 < full < rest.
        full = capacity // sizes[sizes.index(k) + 1]
        pieces.append((full, class_of(full, capacity, sizes)))
        rest -= full
    return pieces


def pieces_of(docs: DataFrame, vocabulary: str, byte_level: bool, end_id: int, capacity: int, slack: float, tokens: bool) -> DataFrame:
    """Every piece, its class and its number within task and class."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, size int, task int, number bigint" + ", ids array<int>" * tokens
    shared = shared_encoder(docs.sparkSession, vocabulary, byte_level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, sizes = shared.value.encode, TaskContext.get().partitionId(), class_sizes(capacity)
        plans: dict[int, list[tuple[int, int]]] = {}
        counts = dict.fromkeys(sizes, 0)
        for batch in batches:
            texts, names = texts_of(batch), batch.column("doc_id").to_pylist()
            for a, b in passes([len(t) for t in texts]):
                rows = []
                for name, found in zip(names[a:b], encode(texts[a:b]), strict=True):
                    ids = np.append(found, np.uint32(end_id)).astype("<u4")
                    n, start = len(ids), 0
                    if n not in plans:
                        if len(plans) > 50_000:
                            plans.clear()
                        plans[n] = cut(n, capacity, sizes, slack)
                    for length, size in plans[n]:
                        part = ids[start : start + length]
                        rows.append((name, start, length, zlib.crc32(part), n, size, task, counts[size], *([part.astype(np.int32)] * tokens)))
                        counts[size] += 1
                        start += length
                kinds = [batch.schema.field("doc_id").type, *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
                names_out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", "task", "number", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=False)], names_out[: 8 + tokens])

    return in_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, schema)


def _best_fit(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        rows.sort(key=lambda r: (-r["length"], r["task"], r["size"], r["number"]))
        room: list[int] = []
        for r in rows:
            fits = [i for i, free in enumerate(room) if free >= r["length"]]
            i = min(fits, key=room.__getitem__) if fits else len(room)
            if not fits:
                room.append(capacity)
            r["bin"], r["offset"] = i, capacity - room[i]
            room[i] -= r["length"]
        if rows:
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("task", "size", "number", "bin", "offset")} for r in rows], schema=pa.schema([("task", pa.int32()), ("size", pa.int32()), ("number", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64())]))

    return run


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", byte_level: bool = False, end_id: int = END_ID, capacity: int = CAPACITY, slack: float = 0.02, tokens: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokens`` adds the ids of each piece.  Sequences are numbered from 0
    without gaps, class by class; in a sequence pieces stand in the order of
    their numbers, from offset 0 without gaps.
    """
    spark = docs.sparkSession
    rows = stage(pieces_of(docs, vocabulary, byte_level, end_id, capacity, slack, tokens), "pieces")
    # As many rows as tasks times classes; each class sums its own tasks.
    counts = stage(rows.groupBy("task", "size").agg(F.count("*").alias("n")), "piece-counts")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("task")) - F.col("n"))
    totals = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # a row per class
    bases, at = [], 0
    for size in sorted(totals):
        bases.append((size, at, totals[size] - totals[size] % size))
        at += totals[size] // size
    classes = F.broadcast(spark.createDataFrame(bases, "size int, base bigint, whole bigint"))
    placed = before.select("task", "size", "before").join(classes, "size")
    if counts.limit(BROADCAST_COUNTS + 1).count() <= BROADCAST_COUNTS:
        placed = F.broadcast(placed)
    numbered = rows.join(placed, ["task", "size"]).withColumn("rank", F.col("before") + F.col("number"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * tokens]
    whole = numbered.filter("rank < whole").withColumn("sequence_id", F.col("base") + F.floor(F.col("rank") / F.col("size")))
    inside = Window.partitionBy("sequence_id").orderBy("rank")
    whole = whole.withColumn("offset", F.sum("length").over(inside) - F.col("length")).select(columns)
    # Fewer than the sum of the class sizes, a constant: found by all tasks, then moved to one.
    left = numbered.filter("rank >= whole")
    few = left.select("task", "size", "number", "length").repartition(1)
    fitted = F.broadcast(in_arrow(few, _best_fit(capacity), "task int, size int, number bigint, bin bigint, offset bigint"))
    last = left.join(fitted, ["task", "size", "number"]).withColumn("sequence_id", F.col("bin") + F.lit(at)).select(columns)
    return whole.unionByName(last)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its token ids in order, from ``pack(tokens=True)``."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    return packed.groupBy("sequence_id").agg(F.flatten(parts).alias("ids"))
