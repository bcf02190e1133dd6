"""What the corpus operators share: scratch tables, document columns, batches.

Scratch tables are Parquet folders below ``spark.checkpoint.dir``, which every
executor of a cluster shares, so a lost executor costs a reread, never a
result.  A cluster without that setting is an error; only a local-mode session
falls back on a temporary folder.  A table that was read for the last time is
dropped at once (``drop``), what is left when the session's JVM ends.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studylake.shipping import ship

#: Texts handed to a Python worker at once; a batch is cut further by size.
ROWS_PER_BATCH = 1000
#: And so many bytes at most (one row at least): a thousand long texts, or pairs with one, would be 64 MB in each task's JVM and worker.
BYTES_PER_BATCH = 4 << 20
#: Characters of text that one numpy pass works on.
CHARS_PER_PASS = 4_000_000

_scratch: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """This application's folder for intermediate tables and written files, in the shared folder."""
    application = spark.sparkContext.applicationId
    if application not in _scratch:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = "file://" + tempfile.mkdtemp(prefix="studylake-")
        root = f"{shared.rstrip('/')}/studylake-{application}-{uuid.uuid4().hex[:8]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        _scratch[application] = root
    return _scratch[application]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; the name is never used twice."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a scratch table and return a reader of it (cuts lineage)."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch_path = path
    return found


def drop(*staged: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in staged:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def join_on_hot(rows: DataFrame, table: DataFrame, key: str, weight: str, most: int = 4000, least: int = 10_000) -> DataFrame:
    """``rows`` JOIN ``table`` on a key that is unique in ``table``, where a key may hold a third of all rows.

    ``weight`` is a column of ``table``: the rows of each key.  Keys of more
    than 1/``most`` of all rows (and more than ``least``), which are fewer than
    ``most`` whatever the input, are broadcast; the others are shuffled.
    """
    total, top = table.agg(F.sum(weight), F.max(weight)).first()
    cut = max(least, (total or 0) // most)
    if (top or 0) <= cut:
        return rows.join(table.drop(weight), key)
    hot = F.col(weight) > cut
    heavy = F.broadcast(table.filter(hot).drop(weight))
    rest = rows.join(heavy.select(key), key, "left_anti").join(table.filter(~hot).drop(weight), key)
    return rows.join(heavy, key).unionByName(rest)


def arrow_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch: whole documents are wide rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` by functions of this package: workers get it and small Arrow batches, wherever ``df`` is from."""
    ship(df.sparkSession)
    arrow_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; workers get this package and small Arrow batches."""
    ship(spark)
    arrow_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 5; fold 0 is held out from every fit."""
    return F.crc32(F.col(doc_id).cast("string")) % 5


def passes(sizes: list[int], limit: int = CHARS_PER_PASS) -> Iterator[tuple[int, int]]:
    """Cut consecutive items into runs of about ``limit`` (one item at least)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]
