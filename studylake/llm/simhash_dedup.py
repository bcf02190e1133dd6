"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its
word shingles.  Two fingerprints link if they differ in at most ``radius``
bits.  For radius r every bit position gets a non-zero vector of r+1 bits; the
mask of a non-zero vector v keeps the positions whose vector has an odd inner
product with v.  Any r differing positions span at most r dimensions, so some
v is orthogonal to all of them: its mask drops every differing bit and the two
fingerprints share that table's key.  The 2**(r+1)-1 tables therefore miss no
pair, whatever the data.

Equal fingerprints are one class before any table is built, so thousands of
exact copies cost one row.  A bucket of at most ``small_bucket`` fingerprints
is compared directly.  A larger one is linked through centres: two fingerprints
are within radius r exactly if some centre is within r // 2 bits of one and the
rest of r of the other, and inside a bucket those bits are dropped ones, so every
fingerprint emits itself and its neighbours and each centre with a member near
enough links the others to that one.  Both ways are exact and linear in the bucket.

Keys that may hold a third of all rows (a fingerprint of copies, the root of a
giant component, a node of many edges) are joined apart (``join_on_hot``).

Defined cases: a null or empty text has no word and the fingerprint 0, which
links like any other; a very long text is hashed whole; fewer words than a shingle
give one shingle of all words; a bit set in just half of the hashes is 0; rows that
repeat a doc_id share its component; a null doc_id never names a component unless
every member's is null; an empty table gives an empty result; further columns are
ignored (``keep_one`` passes them through).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, in_arrow, join_on_hot, stage, texts_of

SEED = 42
BITS = 64
_LANES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes, as an unsigned integer."""
    n = len(hashes)
    if n < 512:
        counts = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(n, BITS).sum(0)
    else:
        counts, cuts = np.zeros(BITS, np.int64), np.arange(0, n, 255)
        for k in range(8):  # eight byte-wide counters at once, emptied before they overflow
            lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, cuts)
            counts[k::8] = lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a whole text over its ``shingle``-word runs, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: ASCII white space and A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
    return majority(np.array(hashes, np.uint64))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and the fingerprint as a signed long; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in texts_of(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, fp bigint")


def covering_masks(radius: int = 2) -> list[int]:
    """2**(radius+1)-1 masks such that any ``radius`` bits are all dropped by one."""
    vectors = 2 ** (radius + 1) - 1
    of = [1 + i % vectors for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (of[i] & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _tables(prints: DataFrame, masks: list[int]) -> DataFrame:
    """One row for each fingerprint and table: table number, kept bits."""
    keys = [F.struct(F.lit(i).alias("tab"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)]
    return prints.select("fp", F.explode(F.array(*keys)).alias("t")).select("t.tab", "t.key", "fp")


def _close(members: str, radius: int):
    """Pairs (a < b) of a bounded array that differ in at most ``radius`` bits."""
    m = F.col(members)
    return F.flatten(F.transform(m, lambda a: F.transform(F.filter(m, lambda b: (b > a) & (F.bit_count(a.bitwiseXOR(b)) <= radius)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def _flips(mask: int, most: int) -> list[tuple[int, int]]:
    """(bits, number of bits) of all choices of up to ``most`` dropped bits of a mask."""
    dropped = [b for b in range(BITS) if not mask >> b & 1]
    return [(_signed(sum(1 << b for b in chosen)), n) for n in range(most + 1) for chosen in combinations(dropped, n)]


def links(prints: DataFrame, radius: int = 2, small_bucket: int = 32) -> DataFrame:
    """Edges (a, b) that connect every two distinct fingerprints within the radius (0 to 4).

    ``prints`` holds distinct fingerprints.  Large buckets give links whose
    chains connect exactly what direct pairs would.
    """
    if not 0 <= radius <= 4:
        raise ValueError("radius is 0 to 4: a table more for each choice of bits")
    masks = covering_masks(radius)
    rows = _tables(prints, masks)
    crowded = stage(rows.groupBy("tab", "key").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-crowded")
    met = stage(rows.join(crowded, ["tab", "key"]), "simhash-buckets")
    small = met.filter(F.col("n") <= small_bucket)
    pairs = small.groupBy("tab", "key").agg(F.collect_list("fp").alias("m")).select(F.explode(_close("m", radius)).alias("e")).select("e.a", "e.b")
    near, far = radius // 2, radius - radius // 2
    choices = [(i, *f) for i, m in enumerate(masks) for f in _flips(m, far)]
    flips = F.broadcast(prints.sparkSession.createDataFrame(choices, "tab int, flip bigint, level int"))  # bound by the radius
    large = met.filter(F.col("n") > small_bucket).select("tab", "fp").join(flips, "tab")
    member = F.struct("level", "fp")
    hubs = large.groupBy("tab", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre")).agg(F.min(member).alias("hub"), F.collect_list("fp").alias("m")).filter((F.size("m") > 1) & (F.col("hub.level") <= near))
    spokes = hubs.select(F.col("hub.fp").alias("a"), F.explode("m").alias("b")).filter("a <> b")
    return pairs.unionByName(spokes)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` reaches.

    Labels spread along edges and are then followed one jump (label of the
    label), so that a chain shortens about geometrically.  Each round is a
    written table, and the one before is dropped.
    """
    both = stage(edges.union(edges.select("b", "a")).distinct().toDF("node", "other"), "component-edges")
    first = both.groupBy("node").agg(F.min("other").alias("m"), F.count("*").alias("degree"))
    labels = stage(first.select("node", "degree", F.least("node", "m").alias("root"), F.lit(True).alias("moved")), "component-labels")
    while labels.filter("moved").limit(1).count():
        known = labels.select(F.col("node").alias("other"), "root", F.col("degree").alias("edges"))
        heard = join_on_hot(both, known, "other", "edges").groupBy("node").agg(F.min("root").alias("heard"))
        best = stage(labels.join(heard, "node").select("node", "degree", F.col("root").alias("was"), F.least("root", "heard").alias("best")), "component-best")
        jump = best.groupBy("best").agg(F.count("*").alias("n")).join(labels.select(F.col("node").alias("best"), F.col("root").alias("next")), "best")
        root = F.least("best", "next")
        moved = stage(join_on_hot(best, stage(jump, "component-jump"), "best", "n").select("node", "degree", root.alias("root"), (root < F.col("was")).alias("moved")), "component-labels")
        drop(labels, best)
        labels = moved
    drop(both)
    return labels.select("node", "root")


def smallest_ids(classes: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """node, n, component_id: the smallest ``first`` of a class's component; ``classes``: node, first, n."""
    linked = stage(roots.withColumnRenamed("node", node).join(classes, node), "component-linked")
    groups = linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("nodes"))
    named = join_on_hot(linked.select(node, "root"), stage(groups, "component-groups"), "root", "nodes").select(node, "component_id")
    found = stage(classes.join(named, node, "left").select(node, "n", F.coalesce("component_id", "first").alias("component_id")), "component-ids")
    drop(linked)
    return found


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, small_bucket: int = 32) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id (smallest doc_id)."""
    prints = stage(fingerprints(docs, shingle), "simhash-prints")
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-classes")
    named = smallest_ids(classes, components(links(classes.select("fp"), radius, small_bucket)), "fp")
    drop(classes)
    return join_on_hot(prints, named, "fp", "n").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """Documents without those that a smaller doc_id of their component stands for.

    All columns stay as they are.  Rows that repeat a doc_id stay or go
    together; rows with a null doc_id stay.
    """
    gone = near_duplicates(docs, **how).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
