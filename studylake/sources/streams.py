"""Large files read in part: packages counted as a stream, archive entries by range."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from studylake.shipping import in_pandas

from .files import MOST_ENTRY_BYTES

CHUNK = 1 << 20
#: Top-level fields of a package that are kept, and containers whose elements are counted.
KEPT = ("packageKey", "version", "title")
COUNTED = ("questions", "materials", "images")
#: Bytes kept of a key or a kept field; longer ones are cut.
MOST_KEPT = 1 << 16
_MARK = re.compile(rb'["{}\[\],:]|[^\s"{}\[\],:]+')
_IN_STRING = re.compile(rb'["\\]')


class Counter:
    """Counts the elements of a package's arrays from chunks of its bytes.

    Holds the open brackets, one key and the kept fields, whatever the arrays hold.
    """

    def __init__(self):
        self.open = bytearray()
        self.key: str | None = None
        self.text: bytearray | None = None  # of the string that is being read
        self.escaped = self.after_colon = self.filled = self.begun = False
        self.fields: dict[str, str] = {}
        self.counts = dict.fromkeys(COUNTED, 0)

    def feed(self, data: bytes) -> None:
        at = 0
        while at < len(data):
            at = self._string(data, at) if self.text is not None else self._mark(data, at)

    def _string(self, data: bytes, at: int) -> int:
        if self.escaped:
            self._keep(data[at : at + 1])
            self.escaped = False
            return at + 1
        found = _IN_STRING.search(data, at)
        self._keep(data[at : found.start() if found else len(data)])
        if not found:
            return len(data)
        if found[0] == b"\\":
            self._keep(b"\\")
            self.escaped = True
        else:
            self._end_string()
        return found.end()

    def _keep(self, part: bytes) -> None:
        if len(self.open) == 1 and len(self.text) < MOST_KEPT:
            self.text += part

    def _end_string(self) -> None:
        text, self.text = bytes(self.text), None
        if len(self.open) == 1:
            value = json.loads(b'"' + text + b'"', strict=False)
            if not self.after_colon:
                self.key = value
            elif self.key in KEPT:
                self.fields[self.key] = value

    def _mark(self, data: bytes, at: int) -> int:
        found = _MARK.search(data, at)
        if not found:
            return len(data)
        mark, depth = found[0], len(self.open)
        if not depth and (self.begun or mark != b"{"):
            raise ValueError("not a package")
        if depth == 2 and mark not in b"]},":
            self.filled = True
        if mark == b'"':
            self.text = bytearray()
        elif mark in (b"{", b"["):
            self.begun = True
            self.open += mark
            if depth == 1:
                self.filled = False
        elif mark in (b"}", b"]"):
            if self.open[-1:] != (b"{" if mark == b"}" else b"["):
                raise ValueError("not a package")
            self.open.pop()
            if depth == 2 and self.key in self.counts:
                self.counts[self.key] += self.filled
        elif mark == b"," and depth == 2 and self.key in self.counts:
            self.counts[self.key] += 1
        if depth == 1 and mark in (b",", b":"):
            self.after_colon = mark == b":"
        return found.end()

    def result(self) -> tuple:
        if self.open or self.text is not None or not self.begun or "packageKey" not in self.fields:
            raise ValueError("not a package")
        return *(self.fields.get(k) for k in KEPT), *self.counts.values()


def count_package(chunks: Iterable[bytes]) -> tuple:
    """packageKey, version, title and the numbers of questions, materials and images; a ValueError if it is no package."""
    counter = Counter()
    for chunk in chunks:
        counter.feed(chunk)
    return counter.result()


def _chunks(path: str) -> Iterator[bytes]:
    files, at = pafs.FileSystem.from_uri(path)
    with files.open_input_stream(at) as held:
        while chunk := held.read(CHUNK):
            yield chunk


def inspect_files(spark: SparkSession, path: str) -> DataFrame:
    """path, packageKey, version, title, counts and error of package files; a task holds a chunk of a file at a time."""
    names = ["path", *KEPT, *[f"n_{c}" for c in COUNTED], "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p in batch["path"]:
                try:
                    rows.append((p, *count_package(_chunks(p)), None))
                except ValueError:
                    rows.append((p, *[None] * (len(names) - 2), "not a package"))
            yield pd.DataFrame(rows, columns=names)

    listed = spark.read.format("binaryFile").load(path).select("path")
    return in_pandas(listed, run, "path string, packageKey string, version string, title string, n_questions int, n_materials int, n_images int, error string")


class Ranged(io.RawIOBase):
    """A seekable file that counts the bytes read from it."""

    def __init__(self, held):
        self.held, self.bytes = held, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        if whence == 2 and self.held.size() + offset < 0:
            raise OSError("before the file's beginning")  # what zipfile expects of a file shorter than its end record
        return self.held.seek(offset, whence)

    def tell(self) -> int:
        return self.held.tell()

    def read(self, size: int = -1) -> bytes:
        data = self.held.read(size if size >= 0 else None)
        self.bytes += len(data)
        return data

    def close(self) -> None:
        self.held.close()
        super().close()


class Archives:
    """Entries of archives by range reads; the archive asked last stays open, so that its directory is read once for neighbours."""

    def __init__(self):
        self.path, self.held, self.zip, self.error = None, None, None, None

    def close(self) -> None:
        for part in (self.zip, self.held):
            if part is not None:
                part.close()
        self.path = self.held = self.zip = self.error = None

    def _open(self, path: str) -> None:
        self.close()
        self.path = path
        try:
            files, at = pafs.FileSystem.from_uri(path)
            self.held = Ranged(files.open_input_file(at))
            self.zip = zipfile.ZipFile(self.held)
        except zipfile.BadZipFile:
            self.error = "not an archive"
        except FileNotFoundError:
            self.error = "no such file"
        except ValueError as e:
            self.error = str(e)

    def entry(self, path: str, name: str) -> tuple:
        """path, name, content, bytes read for it, error."""
        before = 0
        if path != self.path:
            self._open(path)
        elif self.held:
            before = self.held.bytes
        content, error = None, self.error
        try:
            if not error and self.zip.getinfo(name).file_size > MOST_ENTRY_BYTES:
                error = "entry too large"
            if not error:
                content = self.zip.read(name)
        except KeyError:
            error = "no such entry"
        except zipfile.BadZipFile:
            error = "not an archive"
        except ValueError as e:
            error = str(e)
        return path, name, content, self.held.bytes - before if self.held else 0, error


def read_entries(wanted: DataFrame) -> DataFrame:
    """path, name, content, bytes_read, error of archive entries, asked for by rows (path, name).

    Of each archive its end record and directory are read, then each entry's own
    header and bytes; entries over the limit aren't opened.  The rows are dealt by
    ranges of archive and name, so that a task opens an archive once for all its
    entries there, and a large archive is shared by several tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Archives()
        try:
            for batch in batches:
                yield pd.DataFrame([held.entry(p, n) for p, n in zip(batch["path"], batch["name"], strict=True)], columns=["path", "name", "content", "bytes_read", "error"])
        finally:
            held.close()

    tasks = 2 * wanted.sparkSession.sparkContext.defaultParallelism
    dealt = wanted.select("path", "name").repartitionByRange(tasks, "path", "name").sortWithinPartitions("path", "name")
    return in_pandas(dealt, run, "path string, name string, content binary, bytes_read long, error string")
