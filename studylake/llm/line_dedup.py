"""Repeated lines, found by two Bloom filters and confirmed exactly.

A line's key is the line without ASCII white space at both ends, A-Z lowered;
keys are told apart by 128-bit digests.  One pass over the texts writes each
chunk of documents as (doc_id, digest) pairs, 24 bytes a line.

The filters (one of hashes seen once, one of hashes seen twice, two bits a hash) are cut
by ranges of the hash, parts of about ``lines_per_part`` lines, so parts grow in number
with the corpus and never in size.  Each chunk fills its own bitmap of every part, and
only bitmaps travel: a sorted list of set bits, each as its distance to the one before
in bytes of seven bits, three bytes a line or so whatever the line.  A part's task merges
them: a bit that two chunks set (or two hashes of one chunk) is set in the second
filter.  What goes back to a chunk are its bits in that filter; a key of two
documents always has both among them, a key of one by mistake at a rate that
``bits_per_line`` fixes at every size.  Only pairs so suspected are shuffled by key,
where they are counted exactly and the first document is chosen; false suspects
cost a row, never a wrong result.

Confirmed keys are broadcast as 16-byte digests while there are at most
``broadcast_keys`` of them and joined by document otherwise.

Defined cases: a null or empty text is one empty line; a very long text or line
is read whole; an empty key never counts as repeated; rows that repeat a doc_id
(null too) are one document; of equal lines in one document the first stays
(keep="first"); an empty table gives an empty result; further columns are passed
through or ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, in_arrow, join_on_hot, passes, stage, texts_of

SPACE = b" \t\n\x0b\x0c\r"
DIGEST = np.dtype([("rest", "<u8"), ("hash", "<u8")])


def line_keys(text: str) -> list[bytes]:
    """The key of each line."""
    return [line.strip(SPACE) for line in text.encode().lower().split(b"\n")]


def encode(bits: np.ndarray) -> bytes:
    """Sorted distinct bit numbers as distances, seven bits a byte; the high bit says that more follow."""
    step = np.diff(bits, prepend=np.uint64(0))
    size = np.ones(len(step), np.int64)
    for k in range(1, 5):
        size += step >= np.uint64(1 << 7 * k)
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(5):
        some = np.flatnonzero(size > k)
        out[start[some] + k] = (step[some] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | np.where(size[some] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def decode(data: bytes) -> np.ndarray:
    """The bit numbers again."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    start = np.append(0, np.flatnonzero(raw < 128)[:-1] + 1)
    place = np.arange(len(raw)) - np.repeat(start, np.diff(start, append=len(raw)))
    return np.cumsum(np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), start), dtype=np.uint64)


class Filters:
    """Bitmaps of the bits set once, and of those set twice or more."""

    def __init__(self, bits: int):
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    @staticmethod
    def _held(bitmap: np.ndarray, bits: np.ndarray) -> np.ndarray:
        return (bitmap[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    @staticmethod
    def _set(bitmap: np.ndarray, bits: np.ndarray) -> None:
        if len(bits):  # sorted: the bits of one byte stand together
            at = (bits >> np.uint64(3)).astype(np.int64)
            head = np.append(0, np.flatnonzero(np.diff(at)) + 1)
            bitmap[at[head]] |= np.bitwise_or.reduceat(np.left_shift(np.uint8(1), (bits & np.uint64(7)).astype(np.uint8)), head)

    def merge(self, bits: np.ndarray, again: np.ndarray) -> None:
        """A chunk's bits, and those of them that two of its hashes set."""
        self._set(self.twice, bits[self._held(self.once, bits)])
        self._set(self.twice, again)
        self._set(self.once, bits)

    def seen_twice(self, bits: np.ndarray) -> np.ndarray:
        return bits[self._held(self.twice, bits)]


class Parts:
    """How hashes are dealt: a part by the upper half, a bit of its bitmap by the lower."""

    def __init__(self, lines: int, bits_per_line: int, lines_per_part: int):
        self.count = max(1, -(-lines // lines_per_part))
        self.bits = 1 << max(10, (min(lines, lines_per_part) * bits_per_line - 1).bit_length())
        self.width = np.uint64(-(-(1 << 32) // self.count))

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """PROBES numbers of each hash, for part and bit: part * bits + bit."""
        part, low = (hashes >> np.uint64(32)) // self.width, np.uint64(0xFFFFFFFF)
        probes = [hashes & low, (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)]
        return np.stack([part * np.uint64(self.bits) + (x * np.uint64(self.bits) >> np.uint64(32)) for x in probes], 1)

    def bitmaps(self, hashes: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        """(part, bits, those set twice) of a chunk's hashes, one for each document that holds the key."""
        places, times = np.unique(self.places(hashes), return_counts=True)  # of all probes
        part = places // np.uint64(self.bits)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else np.zeros(1, int)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            bits = places[a:b] % np.uint64(self.bits)
            yield int(part[a]), encode(bits), encode(bits[times[a:b] > 1])


def line_digests(docs: DataFrame) -> DataFrame:
    """chunk, n, doc_ids, digests: the distinct keys of each document, a chunk of documents a row.

    Chunks are numbered at random; two of one number would only share their suspects.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = texts_of(batch), batch.column("doc_id")
            for a, b in passes([len(t) for t in texts]):
                digests, counts = [], []
                for text in texts[a:b]:
                    keys = dict.fromkeys(line_keys(text))
                    keys.pop(b"", None)
                    digests += map(xxhash.xxh3_128_digest, keys)
                    counts.append(len(keys))
                owners = ids.slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), counts)))
                columns = [pa.array([uuid.uuid4().int >> 65]), pa.array([len(digests)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(digests)], pa.int32()), owners), pa.array([b"".join(digests)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "n", "doc_ids", "digests"])

    return in_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"chunk bigint, n bigint, doc_ids array<{kind}>, digests binary")


def suspected_bits(chunks: DataFrame, parts: Parts) -> DataFrame:
    """chunk, part, bits: those bits of each chunk that the part's second filter holds."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, held in zip(batch.column("chunk").to_pylist(), batch.column("digests"), strict=True):
                found = list(parts.bitmaps(np.frombuffer(held.as_buffer(), DIGEST)["hash"]))
                columns = [pa.array([f[0] for f in found], pa.int64()), pa.array([chunk] * len(found), pa.int64()), pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "chunk", "bits", "again"])

    def ask(part: int, rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        filters = Filters(parts.bits)
        for _, bits, again in rows:
            filters.merge(decode(bits), decode(again))
        found = [encode(filters.seen_twice(decode(bits))) for _, bits, _ in rows]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([part] * len(rows), pa.int64()), pa.array(found, pa.binary())], ["chunk", "part", "bits"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for batch in batches:
            for p, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "chunk", "bits", "again")), strict=True):
                if rows and p != part:
                    yield ask(part, rows)
                    rows = []
                part = p
                rows.append(row)
        if rows:
            yield ask(part, rows)

    dealt = in_arrow(chunks.select("chunk", "digests"), cut, "part bigint, chunk bigint, bits binary, again binary").repartition("part").sortWithinPartitions("part")
    return in_arrow(dealt, probe, "chunk bigint, part bigint, bits binary").filter(F.length("bits") > 0)


def suspected_lines(docs: DataFrame, bits_per_line: int = 16, lines_per_part: int = 1 << 23) -> DataFrame:
    """(doc_id, digest), once each, of keys that are suspected of repeating; a written table."""
    chunks = stage(line_digests(docs), "line-digests")
    lines = chunks.agg(F.sum("n")).first()[0] or 0
    parts = Parts(lines, bits_per_line, lines_per_part)
    asked = suspected_bits(chunks, parts).groupBy("chunk").agg(F.collect_list(F.struct("part", "bits")).alias("asked"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owners, held, asked in zip(batch.column("doc_ids"), batch.column("digests"), batch.column("asked").to_pylist(), strict=True):
                digests = np.frombuffer(held.as_buffer(), DIGEST)
                places = np.concatenate([decode(a["bits"]) + np.uint64(a["part"] * parts.bits) for a in asked])
                hit = np.flatnonzero(np.isin(parts.places(digests["hash"]), places).all(1))
                raw = digests[hit].tobytes()
                found = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(hit), [None, pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([owners.values.take(pa.array(hit)), found], ["doc_id", "digest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # A chunk meets its own suspects; pairs by document and key, so that a line of a third of all documents is spread over all tasks.
    pairs = in_arrow(chunks.join(asked, "chunk").select("doc_ids", "digests", "asked"), pick, f"doc_id {kind}, digest binary")
    found = stage(pairs.distinct(), "line-suspects")
    drop(chunks)
    return found


def repeated_lines(suspected: DataFrame, min_docs: int = 10) -> DataFrame:
    """Keys in at least ``min_docs`` documents: digest, n_docs, first_doc (smallest doc_id)."""
    return suspected.groupBy("digest").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).filter(F.col("n_docs") >= min_docs)


def _rest(text: str, doc_id, dropped: dict, first: bool) -> tuple[int, int, str]:
    """Lines before, lines dropped, the rest; ``dropped``: digest -> first document."""
    lines, keys = text.split("\n"), line_keys(text)
    kept, mine = [], set()
    for line, key in zip(lines, keys, strict=True):
        digest = xxhash.xxh3_128_digest(key) if key else b""
        if digest not in dropped:
            kept.append(line)
        elif first and dropped[digest] == doc_id and digest not in mine:
            mine.add(digest)
            kept.append(line)
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, keep: str = "none", broadcast_keys: int = 200_000, **filters) -> DataFrame:
    """``docs`` with the column ``text`` less its repeated lines, and n_lines, n_dropped.

    keep: "none" drops every occurrence, "first" leaves the first line of the
    smallest doc_id.  Columns named n_lines or n_dropped are replaced.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    suspected = suspected_lines(docs, **filters)
    repeated = stage(repeated_lines(suspected, min_docs), "line-keys")
    first = keep == "first"
    docs = docs.drop("n_lines", "n_dropped").withColumn("text", F.col("text").cast("string"))
    names = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_lines bigint, n_dropped bigint"
    few = repeated.limit(broadcast_keys + 1).count() <= broadcast_keys
    if few:
        table = {bytes(r["digest"]): r["first_doc"] for r in repeated.toLocalIterator()}
        shared = docs.sparkSession.sparkContext.broadcast(table)
        drop(suspected, repeated)
    else:
        # Each document with its own repeated keys, met by document.
        mine = join_on_hot(suspected, repeated, "digest", "n_docs")
        per = mine.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list("digest").alias("_keys"), F.collect_list(F.coalesce(F.col("first_doc") == F.col("doc_id"), F.lit(False))).alias("_mine"))
        docs = docs.join(per, docs["doc_id"].eqNullSafe(per["_doc"]), "left").drop("_doc")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            if few:
                out = [_rest(t, i, shared.value, first) for i, t in zip(ids, texts_of(batch), strict=True)]
            else:
                out = []
                for t, i, keys, own in zip(texts_of(batch), ids, batch.column("_keys").to_pylist(), batch.column("_mine").to_pylist(), strict=True):
                    out.append(_rest(t, i, {k: i if o else None for k, o in zip(keys or (), own or (), strict=True)} if i is not None else dict.fromkeys(keys or (), 0), first))
            columns = [pa.array([x[2] for x in out], pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], [*names, "n_lines", "n_dropped"])

    return in_arrow(docs, rewrite, fields)


def digest_lines(result: DataFrame) -> DataFrame:
    """doc_id, counts and the SHA-256 of the kept text, in hex."""
    return result.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
