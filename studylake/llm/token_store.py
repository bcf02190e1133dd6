"""Token ids in directly addressable codes.

An id is cut into byte chunks, lowest first.  Level 0 holds the first chunk of
every token; a continuation bitmap says which tokens go on, and level 1 holds
the second chunk of just those, and so on.  A rank directory (ones before every
512th bit) turns a token's place in one level into its place in the next, so
any token is read by a few array accesses; no block is decoded.

A segment is one self-describing byte string.  A store is a folder of binary
files, each the segments of one task one after the other, and an index beside
them (Parquet, a row per segment in ascending doc_id order: file, place, first
token, documents).  A file's name is new for each attempt and only the index
names it, so a repeated or lost task leaves no half-read file.  ``tokens_at``
reads single tokens by their number in the whole store: a few range reads of
some bytes each, never a segment.

Defined cases: a null or empty text is the end id alone; a very long text is
encoded whole, as one segment; rows that repeat a doc_id are stored each, in the
order of their texts' hashes (ties have equal texts); a null doc_id sorts first;
an empty table is an empty store; further columns are ignored; a number outside
the store has no row in ``tokens_at``.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, passes, scratch_path, texts_of
from .word_tokens import shared_encoder

MAGIC = b"DAC1"
RANK_BITS = 512
END_ID = 2
SEGMENT_TOKENS = 1_000_000
SEGMENT_DOCS = 4096


def encode_segment(ids: np.ndarray) -> bytes:
    """The directly addressable code of some ids (unsigned 32 bits at most)."""
    parts, level = [], ids.astype(np.uint32)
    while True:
        more = level > 0xFF
        chunk = (level & 0xFF).astype(np.uint8).tobytes()
        bitmap, ranks = b"", b""
        if more.any():
            packed = np.packbits(more, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % (RANK_BITS // 8), np.uint8)])
            ones = np.bitwise_count(packed).reshape(-1, RANK_BITS // 8).sum(1, dtype=np.uint32)
            bitmap, ranks = packed.tobytes(), (np.cumsum(ones, dtype=np.uint32) - ones).tobytes()
        parts.append((chunk, bitmap, ranks))
        if not bitmap:
            break
        level = level[more] >> 8
    head = MAGIC + struct.pack("<II", len(parts), len(ids)) + b"".join(struct.pack("<III", *map(len, p)) for p in parts)
    return head + b"".join(x for p in parts for x in p)


class Segment:
    """Random access to the ids of an encoded segment, by range reads (offset, length) of its bytes."""

    def __init__(self, read: bytes | Callable[[int, int], bytes]):
        self.read = (lambda at, n: read[at : at + n]) if isinstance(read, bytes) else read
        head = self.read(0, 12)
        if head[:4] != MAGIC:
            raise ValueError("not a segment")
        levels, self.n = struct.unpack_from("<II", head, 4)
        sizes = struct.unpack(f"<{3 * levels}I", self.read(12, 12 * levels))
        #: For each level the places and sizes of its chunks, bitmap and ranks.
        places = (12 + 12 * levels + np.concatenate([[0], np.cumsum(sizes)])).tolist()
        self.levels = [[(places[3 * k + j], sizes[3 * k + j]) for j in range(3)] for k in range(levels)]

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """One id, from one byte of each of its levels and a block of the bitmap above it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, step = 0, RANK_BITS // 8
        for k, ((chunk, _), (bitmap, size), (ranks, _)) in enumerate(self.levels):
            value |= self.read(chunk + i, 1)[0] << (8 * k)
            if not size:
                break
            block, bit = divmod(i, RANK_BITS)
            bits = int.from_bytes(self.read(bitmap + block * step, step), "little")
            if not bits >> bit & 1:
                break
            (before,) = struct.unpack("<I", self.read(ranks + 4 * block, 4))
            i = before + (bits & ((1 << bit) - 1)).bit_count()
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        values = np.zeros(0, np.uint32)
        for (chunk, n), (bitmap, size), _ in reversed(self.levels):
            level = np.frombuffer(self.read(chunk, n), np.uint8).astype(np.uint32)
            if size:
                more = np.frombuffer(self.read(bitmap, size), np.uint8)
                level[np.unpackbits(more, count=n, bitorder="little").view(bool)] |= values << np.uint32(8)
            values = level
        return values


def write_store(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", byte_level: bool = True, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> str:
    """Encode whole texts and write them in ascending doc_id order; returns ``path``."""
    kind = docs.schema["doc_id"].dataType
    schema = f"part int, segment int, first bigint, n_tokens bigint, doc_ids array<{kind.simpleString()}>, doc_tokens array<bigint>, file string, place bigint, size bigint"
    spark = docs.sparkSession
    shared = shared_encoder(spark, vocabulary, byte_level)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = shared.value.encode, TaskContext.get().partitionId()
        files, root = pafs.FileSystem.from_uri(f"{path}/codes")
        files.create_dir(root)
        name, out = f"{part:06d}-{uuid.uuid4().hex[:12]}.dac", None
        segment = first = held = place = 0
        ids, arrays, kinds = [], [], None

        def close() -> pa.RecordBatch:
            nonlocal segment, first, held, place, out
            if out is None:
                out = files.open_output_stream(f"{root}/{name}")
            payload = encode_segment(np.concatenate(arrays))
            out.write(payload)
            row = {"part": part, "segment": segment, "first": first, "n_tokens": held, "doc_ids": list(ids), "doc_tokens": [len(a) for a in arrays], "file": name, "place": place, "size": len(payload)}
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(kinds), pa.list_(pa.int64()), pa.string(), pa.int64(), pa.int64()]
            segment, first, held, place = segment + 1, first + held, 0, place + len(payload)
            ids.clear()
            arrays.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))

        for batch in batches:
            kinds = batch.schema.field("doc_id").type
            texts, names = texts_of(batch), batch.column("doc_id").to_pylist()
            for a, b in passes([len(t) for t in texts]):
                for doc, found in zip(names[a:b], encode(texts[a:b]), strict=True):
                    ids.append(doc)
                    arrays.append(np.append(found, np.uint32(end_id)))
                    held += len(found) + 1
                    if held >= segment_tokens or len(ids) >= SEGMENT_DOCS:
                        yield close()
        if ids:
            yield close()
        if out is not None:
            out.close()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col("text").cast("string").alias("text")
    order = docs.select("doc_id", text, F.xxhash64(text).alias("tie")).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    in_arrow(order.select("doc_id", "text"), write, schema).write.parquet(f"{path}/index")
    return path


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The index of a store: a row per segment, with its first token's number in the whole store.

    One number for each written part is summed on the driver: parts are as many
    as the write had tasks, however long the texts are.
    """
    rows = spark.read.parquet(f"{path}/index")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    offsets, at = [], 0
    for r in totals:
        offsets.append((r["part"], at))
        at += r["n"]
    base = F.broadcast(spark.createDataFrame(offsets, "part int, base bigint"))
    return rows.join(base, "part").withColumn("first", F.col("base") + F.col("first")).drop("base")


def _segments(path: str) -> Callable[[str, int], Segment]:
    """Opens segments by file and place; a worker keeps few files open."""
    files, root = pafs.FileSystem.from_uri(f"{path}/codes")
    opened: dict[str, pa.NativeFile] = {}

    def segment(name: str, place: int) -> Segment:
        if name not in opened:
            if len(opened) > 16:
                opened.pop(next(iter(opened))).close()
            opened[name] = files.open_input_file(f"{root}/{name}")
        held = opened[name]
        return Segment(lambda at, n: held.read_at(n, place + at))

    return segment


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, decoded from a store: doc_id, start, n_tokens, ids_crc32."""
    index = read_store(spark, path)
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_segment = _segments(path)
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                ids = open_segment(one.column("file")[0].as_py(), one.column("place")[0].as_py()).all().astype("<u4")
                sizes = np.array(one.column("doc_tokens")[0].as_py(), np.int64)
                ends = np.cumsum(sizes)
                crcs = [zlib.crc32(ids[e - n : e]) for n, e in zip(sizes, ends, strict=True)]
                first = one.column("first")[0].as_py()
                yield pa.RecordBatch.from_arrays([one.column("doc_ids").flatten(), pa.array(first + ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # Index rows are small, what they name isn't: dealt anew, so that few files of rows don't mean few tasks.
    dealt = index.select("doc_ids", "doc_tokens", "first", "file", "place").repartition("file", "place")
    return in_arrow(dealt, run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokens_at(spark: SparkSession, path: str, numbers: DataFrame, grid: int = SEGMENT_TOKENS) -> DataFrame:
    """number, token: single tokens of a store by their numbers (a column ``number``), in range reads.

    A number meets its segment by the cell of a grid that both lie in.
    """
    index = read_store(spark, path).select("first", "n_tokens", "file", "place")
    cells = F.sequence(F.floor(F.col("first") / grid), F.floor((F.col("first") + F.col("n_tokens") - 1) / grid))
    wanted = numbers.select(F.col("number").cast("long").alias("number")).distinct().withColumn("cell", F.floor(F.col("number") / grid))
    met = wanted.join(index.withColumn("cell", F.explode(cells)), "cell").filter((F.col("number") >= F.col("first")) & (F.col("number") < F.col("first") + F.col("n_tokens")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_segment, last, segment = _segments(path), None, None
        for batch in batches:
            found = []
            for number, first, name, place in zip(*(batch.column(c).to_pylist() for c in ("number", "first", "file", "place")), strict=True):
                if (name, place) != last:
                    last, segment = (name, place), open_segment(name, place)
                found.append(segment[number - first])
            yield pa.RecordBatch.from_arrays([batch.column("number"), pa.array(found, pa.int64())], ["number", "token"])

    return in_arrow(met.select("number", "first", "file", "place"), run, "number bigint, token bigint")


def token_table(docs: DataFrame, **how) -> DataFrame:
    """Write a store below the shared folder, read it back, one row per document."""
    spark = docs.sparkSession
    return documents(spark, write_store(docs, scratch_path(spark, "tokens"), **how))
