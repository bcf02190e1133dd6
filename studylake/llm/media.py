"""Texts as content-addressed media in tar shards.

A payload is a text's bytes, zeros added up to a positive multiple of 64.  It
is stored as a grey PNG of 64 8-bit samples a row (lossless), as a member of a
tar shard named by the payload's digest.  Each digest is stored once in all:
digests are counted first (no text is shuffled), and of several documents with
one digest the smallest doc_id stores it.  A row carries digest, shard, offset
and length; rows of copies take the place from the catalogue.  A shard's name is
new for each attempt, so a repeated task leaves the rows of the attempt that
counted whole.

Metadata columns (width, height, bits, colour) come from range reads of a
member's first 33 bytes; samples are read only where a feature needs them.
Files go through the file system of their URI (pyarrow), read and written by
executors in the shared folder.

Defined cases: a null or empty text is one row of zeros; a very long text is one
member; equal texts have equal values; rows that repeat a doc_id each get their
row (repeated with their text and in different tasks, each task may store it; the
catalogue names one place); an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, in_arrow, join_on_hot, scratch_path, stage, texts_of

WIDTH = 64
SHARD_BYTES = 64 << 20
PNG = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33  # signature, IHDR with its length, name and checksum
#: Documents that leave the storing to another one: broadcast up to this number (8 MB of ids), else met by document.
FEW_COPIES = 200_000


def payload_of(text: str) -> bytes:
    """The text's bytes and zeros up to a positive multiple of WIDTH."""
    data = text.encode()
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def to_png(payload: bytes) -> bytes:
    """A grey 8-bit PNG, WIDTH samples a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0 before each row
    lines[:, 1:] = rows
    return PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> dict[str, int]:
    """Metadata from the first HEADER_BYTES bytes."""
    if head[:8] != PNG or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, bits, colour = struct.unpack(">IIBB", head[16:26])
    return {"width": width, "height": height, "bits": bits, "colour": colour}


def from_png(media: bytes) -> bytes:
    """The samples of a PNG that ``to_png`` wrote."""
    at, data = 8, b""
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        if media[at + 4 : at + 8] == b"IDAT":
            data += media[at + 8 : at + 8 + n]
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(-1, WIDTH + 1)[:, 1:].tobytes()


class _Shards:
    """The tar shards that one task writes."""

    def __init__(self, root: str):
        self.files, self.root = pafs.FileSystem.from_uri(root)
        self.files.create_dir(self.root)
        self.prefix = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        self.count, self.out, self.at = 0, None, 0

    def put(self, digest: bytes, media: bytes) -> tuple[str, int, int]:
        if self.out is not None and self.at >= SHARD_BYTES:
            self.close()
        if self.out is None:
            self.name = f"{self.prefix}-{self.count:05d}.tar"
            self.out, self.at = self.files.open_output_stream(f"{self.root}/{self.name}"), 0
        info = tarfile.TarInfo(f"{digest.hex()}.png")
        info.size = len(media)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        pad = -len(media) % 512
        self.out.write(head + media + bytes(pad))
        place = self.name, self.at + len(head), len(media)
        self.at += len(head) + len(media) + pad
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out, self.count = None, self.count + 1


def payload_digest(text: Column) -> Column:
    """SHA-256 of a text's payload, in hex."""
    data = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    size = F.greatest(F.lit(WIDTH), F.ceil(F.octet_length(data) / WIDTH) * WIDTH).cast("int")
    return F.sha2(F.rpad(data, size, F.lit(b"\0")), 256)


def store(docs: DataFrame, root: str) -> DataFrame:
    """Write the shards below ``root``; one row per document (a written table):
    doc_id, n_bytes, digest, shard, offset, media_bytes."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    digests = stage(docs.select("doc_id", F.unhex(payload_digest(F.col("text"))).alias("digest")), "media-digests")
    copied = digests.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")).filter("n > 1")
    copied = stage(copied, "media-copied")
    # Documents whose payload another document stores; of rows without an id none is the smallest.
    spared = join_on_hot(digests, copied, "digest", "n").filter("doc_id <> owner OR (doc_id IS NULL AND owner IS NOT NULL)").select("doc_id", "digest").distinct()
    spared = stage(spared, "media-spared")
    few = spared.limit(FEW_COPIES + 1).count() <= FEW_COPIES
    if few:
        shared = spark.sparkContext.broadcast({(r["doc_id"], bytes(r["digest"])) for r in spared.toLocalIterator()})
        rows = docs
    else:
        per = spared.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list("digest").alias("_spared"))
        rows = docs.join(per, docs["doc_id"].eqNullSafe(per["_doc"]), "left").select("doc_id", "text", "_spared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, places = _Shards(root), {}
        for batch in batches:
            rows, ids = [], batch.column("doc_id").to_pylist()
            lists = [()] * len(ids) if few else batch.column("_spared").to_pylist()
            for doc, text, others in zip(ids, texts_of(batch), lists, strict=True):
                payload = payload_of(text)
                digest = hashlib.sha256(payload).digest()
                if (doc, digest) in shared.value if few else digest in (others or ()):
                    place = (None, None, None)
                else:
                    if digest not in places:
                        places[digest] = shards.put(digest, to_png(payload))
                    place = places[digest]
                rows.append((len(text.encode()), digest, *place))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "digest", "shard", "offset", "media_bytes"])
        shards.close()

    placed = stage(in_arrow(rows, run, f"doc_id {kind}, n_bytes bigint, digest binary, shard string, offset bigint, media_bytes bigint"), "media-placed")
    bare = placed.filter("shard IS NULL").select("doc_id", "n_bytes", "digest")
    known = catalog(placed.filter("shard IS NOT NULL")).drop("n_rows").join(copied.select("digest", "n"), "digest")
    index = placed.filter("shard IS NOT NULL").unionByName(join_on_hot(bare, stage(known, "media-known"), "digest", "n"))
    index = stage(index, "media-index")
    drop(digests, copied, spared, placed)
    return index


def catalog(index: DataFrame) -> DataFrame:
    """One place for each digest: the first shard and offset that hold it."""
    place = F.min(F.struct("shard", "offset", "media_bytes"))
    return index.groupBy("digest").agg(place.alias("p"), F.count("*").alias("n_rows")).select("digest", "p.*", "n_rows")


def _reader(root: str):
    files, path = pafs.FileSystem.from_uri(root)
    opened: dict[str, pafs.NativeFile] = {}

    def read(shard: str, offset: int, length: int) -> bytes:
        if shard not in opened:
            if len(opened) > 16:
                opened.popitem()[1].close()
            opened[shard] = files.open_input_file(f"{path}/{shard}")
        return opened[shard].read_at(length, offset)

    return read


def add_header(index: DataFrame, root: str) -> DataFrame:
    """``index`` with width, height, bits and colour, by header-only range reads."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(root)
        for batch in batches:
            heads = [png_header(read(s, o, HEADER_BYTES)) for s, o in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True)]
            extra = [pa.array([h[k] for h in heads], pa.int64()) for k in ("width", "height", "bits", "colour")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "width", "height", "bits", "colour"])

    return in_arrow(index, run, fields + ", width bigint, height bigint, bits bigint, colour bigint")


def add_content(index: DataFrame, root: str) -> DataFrame:
    """``index`` with digests and a mean sample, from the stored bytes read back."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "mean_sample"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64()]

    def look(media: bytes) -> tuple:
        payload = from_png(media)
        mean = float(np.frombuffer(payload, np.uint8).mean())
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(media).hexdigest(), mean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(root)
        for batch in batches:
            seen: dict[tuple, tuple] = {}
            rows = []
            for place in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "media_bytes")), strict=True):
                if place not in seen:
                    seen[place] = look(read(*place))
                rows.append(seen[place])
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], [*batch.schema.names, *names])

    return in_arrow(index, run, fields + ", payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_sha256 string, mean_sample double")


def media_table(docs: DataFrame) -> DataFrame:
    """Store all texts, then read places, headers and contents back."""
    root = scratch_path(docs.sparkSession, "media")
    # Index rows are small, what they name isn't: dealt anew by shard and stretch of it, so that few files of rows don't mean few tasks.
    index = store(docs, root).repartition("shard", F.floor(F.col("offset") / (4 << 20)))
    return add_content(add_header(index, root), root)


def features(table: DataFrame) -> DataFrame:
    """The columns of a media table with its metadata as one text."""
    text = F.format_string("png %dx%d %d bit colour %d mean %.3f", "width", "height", "bits", "colour", "mean_sample")
    return table.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", text.alias("feature"), F.lower(F.hex("digest")).alias("digest"))
