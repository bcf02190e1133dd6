"""Near copies by exact shingle similarity, for the pipeline.

Two documents are near copies if the sets of their five-word shingles have a
Jaccard similarity of at least ``least``.  Each document has ``BANDS`` keys of
``ROWS`` min-hashes; documents that share a key are candidates, and every
candidate is verified on the shingles.  A pair of similarity s has no key in
common with probability (1 - s**5)**32: 3e-6 at 0.8, less above.

Documents of equal words are one class before any key is compared.  The first
candidates are those of SimHash and its covering masks (``simhash_dedup.links``):
classes whose fingerprints of five-word shingles differ in at most ``RADIUS`` bits.
The min-hash keys add those that the radius can't reach.  Their candidates
are taken in passes, so that a large group costs no square:

* in each of ``STARS`` passes the members of a bucket meet its hub, the one that
  shares buckets with most others (the text that the others were made from, where
  there is one) and isn't connected to an earlier hub;
* of a bucket of at most ``SMALL`` members those in different components meet;
* members of a crowded bucket (texts that share a long passage, say) are told apart
  by a second key.  Seen from the bucket's hub a member's shingles have an order:
  first those that the hub lacks, then those they share, each by hash.  Of two sets of
  similarity ``least`` or more each has one of the other's among its first
  ``(1 - least) * size + 1`` (prefix filter, exact for any order that both use).  So
  members meet only by a shingle of their prefixes: first the hubs of these finer
  buckets once more, then pairs, if sizes and what can follow the shared shingle
  allow the similarity and sketches of ``SKETCH`` bits (one of each of as many further
  min-hashes) differ in at most ``APART``: at 0.8 they differ in 51 on average, deviation
  6.8, so that one pair in 100,000 is passed over, fewer above; at 0.64 in 92.  Texts that
  share nothing but the passage have no shingle in common there.

What is never compared is connected already or can't be similar, so components are
those of all pairs.

Classes and shingles are told apart by 64-bit hashes.  Defined cases: texts
without a word are copies of each other; fewer words than a shingle give one
shingle of all words; a null doc_id never names a component and its row stays;
rows that repeat a doc_id stay or go together; an empty table gives an empty
result; further columns are passed through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import mix
from .common import drop, in_arrow, join_on_hot, stage, texts_of
from .simhash_dedup import SEED, components, links, majority, smallest_ids

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 2
BANDS, ROWS = 32, 5
STARS = 2
SMALL = 8
SKETCH, APART = 512, 80
_rng = np.random.default_rng(SEED)
_ADD, _TIMES = (_rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)
_SKETCH_ADD, _SKETCH_TIMES = (_rng.integers(0, 1 << 64, SKETCH, dtype=np.uint64) for _ in range(2))
_SKETCH_TIMES |= np.uint64(1)


def _joined(text: str | None) -> tuple[list[bytes], bytes]:
    words = (text or "").encode().lower().split()  # as simhash_dedup.fingerprint
    return words, b" ".join(words)


def shingle_hashes(words: list[bytes], joined: bytes, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``size`` words, repeats included."""
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)] if words else []
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        hashes = [xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[size - 1 :], strict=False)]
    return np.array(hashes, np.uint64)


def shingle_set(words: list[bytes], joined: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words."""
    return np.unique(shingle_hashes(words, joined, size))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band: the hash of its min-hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 512):
        least = np.minimum(least, ((shingles[at : at + 512, None] ^ _ADD) * _TIMES).min(0))
    raw = least.tobytes()
    step = 8 * ROWS
    return np.array([xxhash.xxh64_intdigest(raw[i : i + step], i // step) for i in range(0, len(raw), step)], np.uint64)


def sketch(shingles: np.ndarray) -> list[int]:
    """A bit of each of SKETCH min-hashes, as signed longs."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 256):
        least = np.minimum(least, ((shingles[at : at + 256, None] ^ _SKETCH_ADD) * _SKETCH_TIMES).min(0))
    return np.packbits((mix(least) & np.uint64(1)).astype(np.uint8)).view(np.int64).tolist()


def _node(joined: bytes) -> int:
    return xxhash.xxh64_intdigest(joined, 0)


def _signatures(docs: DataFrame) -> DataFrame:
    """doc_id, node (the class of equal words), fp (the SimHash fingerprint) and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints, keys = [], [], []
            for text in texts_of(batch):
                words, joined = _joined(text)
                hashes = shingle_hashes(words, joined)
                nodes.append(_node(joined))
                prints.append(majority(hashes) if len(hashes) else 0)
                keys.append(band_keys(np.unique(hashes)).view(np.int64))
            offsets = pa.array(range(0, BANDS * (len(keys) + 1), BANDS), pa.int32())
            bands = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(np.array(c, np.uint64).view(np.int64)) for c in (nodes, prints)], bands], ["doc_id", "node", "fp", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, node bigint, fp bigint, bands array<bigint>")


def simhash_pairs(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of classes (node, fp) that the SimHash tables link: one class of each fingerprint stands for it and meets the others of it."""
    prints = stage(classes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "copies-fingerprints")
    same = join_on_hot(classes.select("node", "fp"), prints.filter("n > 1"), "fp", "n").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    name = lambda side: prints.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_node"))
    near = links(prints.select("fp"), radius).distinct().join(name("a"), "a").join(name("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return same.unionByName(near).distinct()


def _texts(docs: DataFrame) -> DataFrame:
    """node and text of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = np.array([_node(_joined(t)[1]) for t in texts_of(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), batch.column("text")], ["node", "text"])

    return in_arrow(docs.select(F.col("text").cast("string").alias("text")), run, "node bigint, text string")


def _with_texts(pairs: DataFrame, texts: DataFrame, stretch: int = 500) -> DataFrame:
    """The pairs (a, b) with their texts x and y.

    The text of an ``a`` of many pairs goes out once for every ``stretch`` of
    them, so that the pairs of one centre are spread over tasks.
    """
    pairs = stage(pairs, "copies-pairs")
    count = pairs.groupBy("a").agg(F.ceil(F.count("*") / stretch).alias("salts"))
    salted = pairs.join(count, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts"))).drop("salts")
    centres = texts.toDF("a", "x").join(count, "a").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    # A b is paired with a few centres at most: one for each band.
    return salted.join(texts.toDF("b", "y"), "b").join(centres, ["a", "salt"]).select("a", "b", "x", "y")


def _sets(batch: pa.RecordBatch, last: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The shingles of x and y, row by row; x is often that of the row before, which ``last`` holds."""
    for a, x, y in zip(batch.column("a").to_pylist(), texts_of(batch, "x"), texts_of(batch, "y"), strict=True):
        if not last or a != last[0]:
            last[:] = a, shingle_set(*_joined(x))
        yield last[1], shingle_set(*_joined(y))


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) that are near copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = []
        for batch in batches:
            keep = [jaccard(x, y) >= least for x, y in _sets(batch, last)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return in_arrow(_with_texts(pairs, texts), run, "a bigint, b bigint")


def prefix(mine: np.ndarray, hub: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a set in the order of its hub: enough to share one with every set of that similarity."""
    known = np.isin(mine, hub, assume_unique=True)
    n = len(mine) - math.ceil(least * len(mine) - 1e-9) + 1
    return np.concatenate([mine[~known], mine[known]])[:n]


def _prefixes(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """band (the hub), key (a shingle of the prefix), at (its place), node (the member), size, sketch, of pairs (hub, member)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = []
        for batch in batches:
            found = [(prefix(y, x, least), len(y), sketch(y)) for x, y in _sets(batch, last)]
            counts = np.array([len(f[0]) for f in found], np.int64)
            repeat = lambda c: pa.array(np.repeat(batch.column(c).to_numpy(), counts))
            keys = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.uint64)
            at = np.concatenate([np.arange(n) for n in counts]) if found else np.zeros(0, np.int64)
            size = np.repeat(np.array([f[1] for f in found], np.int64), counts)
            bits = [s for (_, _, s), n in zip(found, counts.tolist(), strict=True) for s in [s] * n]
            columns = [repeat("a"), pa.array(keys.view(np.int64)), pa.array(at.astype(np.int64)), repeat("b"), pa.array(size), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["band", "key", "at", "node", "size", "sketch"])

    return in_arrow(_with_texts(pairs, texts), run, "band bigint, key bigint, at bigint, node bigint, size bigint, sketch array<bigint>")


def _open(met: DataFrame, roots: DataFrame | None) -> DataFrame:
    """band, key, node, weight, root of the members of buckets that hold more than one component."""
    if roots is None:
        return met.withColumn("root", F.col("node"))
    rooted = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("band", "key")
    return rooted.join(several, ["band", "key"])


def _stars(met: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Pairs (a, b), a the hub of a bucket: from the second pass on, of the members that its first hub didn't reach."""
    rows = stage(_open(met, roots), "copies-rooted")
    top = lambda df, name: df.groupBy("band", "key").agg(F.max_by(F.struct("node", "root"), F.struct("weight", -F.col("node"))).alias(name))
    hubs = top(rows, "hub")
    if roots is not None:
        rows = rows.join(hubs, ["band", "key"]).filter("root <> hub.root").drop("hub")
        hubs = top(rows, "hub")
    return rows.join(hubs, ["band", "key"]).filter("root <> hub.root").select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()


def _allowed(rows: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different components that share a key and may be similar by sizes, places and sketches.

    ``at`` shingles stand before the shared one; if it is the first that both have,
    they share it and no more than follows in the shorter rest.
    """
    rows = rows.select("band", "key", "node", "root", "at", "size", "sketch")
    other = rows.toDF("band2", "key2", "node2", "root2", "at2", "size2", "sketch2")
    rest = F.least(F.col("size") - F.col("at"), F.col("size2") - F.col("at2"))
    enough = (rest * (1 + least) >= least * (F.col("size") + F.col("size2")) - 1e-6) & (F.least("size", "size2") >= least * F.greatest("size", "size2") - 1e-6)
    apart = sum((F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("sketch2")[i])) for i in range(SKETCH // 64)), F.lit(0))
    enough &= apart <= APART
    met = rows.join(other, (F.col("band") == F.col("band2")) & (F.col("key") == F.col("key2")) & (F.col("node") < F.col("node2")) & (F.col("root") != F.col("root2")) & enough)
    return met.select(F.col("node").alias("a"), F.col("node2").alias("b"))


def _linked(edges: DataFrame, pairs: DataFrame, texts: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """The edges with those of ``pairs`` that are near copies, and the components."""
    found = stage(_verified(pairs, texts, least), "copies-links")
    edges = edges.unionByName(found)
    return edges, components(edges)


def near_copies(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, component_id (smallest doc_id)."""
    prints = stage(_signatures(docs), "copies-prints")
    classes = stage(prints.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "copies-classes")
    hashed = stage(simhash_pairs(classes), "copies-simhash")
    rows = classes.select("node", F.posexplode("bands").alias("band", "key"))
    crowded = rows.groupBy("band", "key").agg(F.count("*").alias("members")).filter("members > 1")
    # Narrow rows by a key that is unique on the other side: where a bucket is crowded, Spark splits its partition.
    joined = stage(rows.join(crowded, ["band", "key"]), "copies-joined")
    shared = joined.groupBy("node").agg(F.sum("members").alias("weight"))
    met = stage(joined.drop("members").join(shared, "node"), "copies-met")
    drop(joined)
    wanted = met.select("node").union(hashed.select("a")).union(hashed.select("b")).distinct()
    texts = stage(_texts(docs).join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "copies-texts")

    edges, roots = stage(_verified(hashed, texts, least), "copies-links"), None
    for _ in range(STARS):
        edges, roots = _linked(edges, _stars(met, roots), texts, least)

    still = stage(_open(met, roots), "copies-open")
    size = still.groupBy("band", "key").agg(F.count("*").alias("members"), F.max_by("node", F.struct("weight", -F.col("node"))).alias("hub"))
    small = still.join(size.filter(F.col("members") <= SMALL).select("band", "key"), ["band", "key"])
    lists = small.groupBy("band", "key").agg(F.array_sort(F.collect_list(F.struct("node", "root"))).alias("m"))  # SMALL at most
    ahead = lists.select(F.posexplode("m").alias("i", "one"), "m").select("one", F.explode(F.slice("m", F.col("i") + 2, F.lit(SMALL))).alias("two"))
    pairs = ahead.filter("one.root <> two.root").select(F.col("one.node").alias("a"), F.col("two.node").alias("b"))

    crowds = still.join(size.filter(F.col("members") > SMALL), ["band", "key"]).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    finer = stage(_prefixes(crowds, texts, least), "copies-finer")
    shared = finer.groupBy("band", "key").agg(F.count("*").alias("members")).filter("members > 1").drop("members")
    finer = stage(finer.join(shared, ["band", "key"]).withColumn("weight", -F.col("at")), "copies-shared")
    edges, roots = _linked(edges, _stars(finer.drop("sketch"), roots), texts, least)
    edges, roots = _linked(edges, pairs.unionByName(_allowed(_open(finer, roots), least)).distinct(), texts, least)
    named = smallest_ids(classes.select("node", "first", "n"), roots, "node")
    drop(classes, met, texts, still, finer)
    return join_on_hot(prints.select("doc_id", "node"), named, "node", "n").select("doc_id", "component_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """Documents without those that a smaller doc_id of their component stands for; all columns stay."""
    gone = near_copies(docs, **how).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
