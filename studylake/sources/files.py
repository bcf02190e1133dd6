"""Readers and writers of package, record, template and document files.

Every reader gives a DataFrame from a path that Spark resolves; containers are
opened inside tasks, one file a row, with limits on entries and sizes.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studylake import schema
from studylake.shipping import in_pandas

#: Limits of a package container (fixed values).
MOST_ENTRIES, MOST_ENTRY_BYTES, MOST_BYTES = 4096, 100 << 20, 512 << 20
MOST_IMAGE_BYTES = 10 << 20
MANIFEST = "manifest.json"


def read_table(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Parquet with an explicit schema; a column that is missing is null."""
    return spark.read.schema(columns).parquet(path)


def live(df: DataFrame) -> DataFrame:
    """Rows that aren't logically deleted."""
    return df.filter(~F.coalesce("deleted", F.lit(False)))


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key; an error if there is none (raised when the result is read)."""
    found = df.filter(F.col(key) == value)
    # One row for the count; a row that fails the assertion raises, others pass as null.
    n = found.agg(F.count("*").alias("_n"))
    checked = n.select(F.assert_true(F.col("_n") > 0, F.lit(f"no row with {key} {value}")).cast("string").alias("_ok"))
    return checked.join(found, how="left").filter("_ok IS NULL").drop("_ok")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one (``spark.checkpoint.dir``), or below a temporary one of a local session; it goes with the session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="studylake-")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


# --- JSON files ------------------------------------------------------------------------------------------


def read_packages(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per package file of version 1 (or line of one): path, the package, and why it isn't valid (null: valid)."""
    raw = spark.read.text(path, wholetext=not lines).select(F.input_file_name().alias("path"), F.from_json("value", schema.PACKAGE).alias("p"))
    return raw.select("path", "p.*", package_error(F.col("p")).alias("error"))


def package_error(p: Column) -> Column:
    """The first rule that a package breaks, null if none."""
    keys = F.transform(p["questions"], lambda q: q["questionKey"])
    known = F.coalesce(F.transform(p["materials"], lambda m: m["materialKey"]), F.array().cast("array<string>"))
    used = F.filter(F.transform(p["questions"], lambda q: q["materialKey"]), lambda k: k.isNotNull())
    bare = F.exists(p["questions"], lambda q: (q["type"] != "SUBJECTIVE") & (F.coalesce(F.size(q["options"]), F.lit(0)) == 0))
    return (
        F.when(p.isNull() | p["packageKey"].isNull(), "not a package")
        .when(F.coalesce(F.length(p["title"]), F.lit(0)) > schema.LIMITS["title"], "title too long")
        .when(F.length(p["packageKey"]) > schema.LIMITS["key"], "key too long")
        .when(F.length(p["version"]) > schema.LIMITS["version"], "version too long")
        .when(F.coalesce(F.size(p["questions"]), F.lit(0)) == 0, "no questions")
        .when(F.size(F.array_distinct(keys)) < F.size(keys), "question keys repeat")
        .when(bare, "objective question without options")
        .when(F.size(F.array_except(used, known)) > 0, "unknown material")
    )


def questions_of(packages: DataFrame) -> DataFrame:
    """One row per question of packages."""
    return packages.select("packageKey", "version", F.posexplode("questions").alias("position", "q")).select("packageKey", "version", "position", "q.*")


def inspect(packages: DataFrame) -> DataFrame:
    """Counts of a package, without its contents."""
    return packages.select("packageKey", "version", "title", *[F.coalesce(F.size(c), F.lit(0)).alias(f"n_{c}") for c in ("questions", "materials", "images")])


def write_packages(questions: DataFrame, path: str, *heads: str) -> str:
    """Packages as JSON lines: one per value of the head columns, questions in order of position."""
    rest = [c for c in questions.columns if c not in heads]
    ordered = F.array_sort(F.collect_list(F.struct("position", *[c for c in rest if c != "position"])))
    questions.groupBy(*heads).agg(ordered.alias("questions")).write.json(path)
    return path


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of exchange files."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", schema.RECORD_FILE).alias("f")).select(F.explode("f.records").alias("r"))
    return rows.select(
        F.col("r.packageKey").alias("package_key"), F.col("r.packageVersion").alias("version"), F.col("r.questionKey").alias("question_key"), F.col("r.selectedKeys").alias("selected_keys"), F.col("r.isCorrect").alias("is_correct"), F.col("r.userAnswer").alias("user_answer"), F.col("r.selfGrade").alias("self_grade"), F.col("r.answeredAt").alias("answered_at")
    )


def write_records(records: DataFrame, path: str) -> str:
    """Records as JSON lines, in order of time within each range."""
    records.repartitionByRange("answered_at").sortWithinPartitions("answered_at").write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    return path


def write_record_files(records: DataFrame, path: str) -> str:
    """Exchange files of records (r, answered_at): one for each range of time, its records in order."""
    ranged = records.repartitionByRange("answered_at").withColumn("part", F.spark_partition_id())
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("answered_at", "r"))), lambda x: x["r"])
    rows = ranged.groupBy("part").agg(ordered.alias("records"))
    body = F.struct(F.lit(1).alias("schemaVersion"), F.lit("").alias("exportedAt"), "records")
    rows.select(F.to_json(body, {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("value"), "part").write.partitionBy("part").text(path)
    return path


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Skill templates, nested as in their files."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema.TEMPLATE).alias("t")).select("t.*")


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Own nodes from either shape: a list of nodes, or {"nodes": [...]}."""
    node = "array<struct<id:string,name:string,prereq:array<string>>>"
    text = spark.read.text(path, wholetext=True)
    nodes = F.coalesce(F.from_json("value", f"nodes {node}")["nodes"], F.from_json("value", node))
    return text.select(F.explode(nodes).alias("n")).select(F.col("n.id").alias("node_id"), F.col("n.name").alias("name"), F.coalesce("n.prereq", F.array().cast("array<string>")).alias("prereq"))


def write_overrides(nodes: DataFrame, path: str) -> str:
    """Own nodes (node_id, name, prereq) as a file of one list, by id; an override is a short list."""
    one = F.array_sort(F.collect_list(F.struct(F.col("node_id").alias("id"), "name", "prereq")))
    nodes.agg(F.to_json(one).alias("value")).coalesce(1).write.text(path)
    return path


def _facts(df: DataFrame) -> dict:
    """Rows and an order-free digest of a table."""
    row = df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("digest")).first()
    return {"rows": row["rows"], "digest": row["digest"]}


def backup(tables: dict[str, DataFrame], path: str) -> str:
    """All tables as Parquet below one folder, and a list of them with rows and digests, which is written last."""
    facts = []
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
        facts.append((name, *_facts(df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")).values()))
    df.sparkSession.createDataFrame(facts, "name string, rows long, digest string").coalesce(1).write.json(f"{path}/_tables")
    return path


def restore(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a backup; names are checked before any path is built."""
    if bad := [n for n in schemas if not re.fullmatch(r"[a-z_]+", n)]:
        raise ValueError(f"not a table name: {bad[0]}")
    return {name: read_table(spark, f"{path}/{name}", s) for name, s in schemas.items()}


def restore_into(spark: SparkSession, path: str, schemas: dict[str, str], target: str) -> str:
    """Put a backup in the place of the tables at ``target``: all of it or nothing.

    Tables are written beside the ones in use, below a folder named by the backup's
    digests, and compared with the backup's list of rows and digests; a table of an
    earlier, broken-off attempt that is whole is not written again.  Then one small
    file that says which folder is in use is replaced.
    """
    source = restore(spark, path, schemas)
    listed = {r["name"]: {"rows": r["rows"], "digest": r["digest"]} for r in spark.read.schema("name string, rows long, digest string").json(f"{path}/_tables").collect()}
    if missing := sorted(set(schemas) - set(listed)):
        raise ValueError(f"not in the backup: {missing[0]}")
    version = hashlib.sha256(json.dumps([[n, listed[n], schemas[n]] for n in sorted(schemas)]).encode()).hexdigest()[:16]
    for name, df in source.items():
        place = f"{target}/{version}/{name}"
        if _exists(spark, f"{place}/_SUCCESS") and _facts(read_table(spark, place, schemas[name])) == listed[name]:
            continue
        df.write.mode("overwrite").parquet(place)
        if _facts(read_table(spark, place, schemas[name])) != listed[name]:
            raise ValueError(f"{name} differs from the backup's list")
    _swap(spark, target, version)
    return target


def restored(spark: SparkSession, target: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables in use at ``target``."""
    version = spark.read.text(f"{target}/current").first()["value"]
    return restore(spark, f"{target}/{version}", schemas)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _swap(spark: SparkSession, target: str, version: str) -> None:
    """Replace the file that names the folder in use, by one rename."""
    fs = spark._jvm.org.apache.hadoop.fs
    new, current = fs.Path(f"{target}/current-{uuid.uuid4().hex}"), fs.Path(f"{target}/current")
    with_bytes = new.getFileSystem(spark._jsc.hadoopConfiguration()).create(new, True)
    with_bytes.write(bytearray(version.encode()))
    with_bytes.close()
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration()).rename(new, current, options)


# --- containers and documents ----------------------------------------------------------------------------


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _entries(content: bytes) -> list[zipfile.ZipInfo]:
    """The entries of an archive after checks of paths, numbers and sizes."""
    found = zipfile.ZipFile(io.BytesIO(content)).infolist()
    names = [e.filename for e in found]
    if len(found) > MOST_ENTRIES or sum(e.file_size for e in found) > MOST_BYTES or any(e.file_size > MOST_ENTRY_BYTES for e in found):
        raise ValueError("archive too large")
    if any(n.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", n) or ":" in n for n in names) or len(set(names)) < len(names):
        raise ValueError("unsafe entry")
    return found


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    """path, manifest, names, error of package containers of version 2 (zip by its first bytes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    if content[:4] != b"PK\x03\x04":
                        raise ValueError("not an archive")
                    found = _entries(content)
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows.append((p, z.read(MANIFEST).decode(), sorted(e.filename for e in found if e.filename != MANIFEST), None))
                except (ValueError, KeyError, zipfile.BadZipFile) as e:
                    rows.append((p, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "manifest", "names", "error"])

    raw = in_pandas(_binary(spark, path), run, "path string, manifest string, names array<string>, error string")
    return raw.select("path", "names", "error", F.from_json("manifest", schema.PACKAGE).alias("package"))


def read_entry(spark: SparkSession, path: str, name: str) -> DataFrame:
    """path, content of one entry of each archive (null where it is missing)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    out.append(z.read(name) if name in z.namelist() else None)
            yield pd.DataFrame({"path": batch["path"], "content": out})

    return in_pandas(_binary(spark, path), run, "path string, content binary")


def containers(packages: DataFrame) -> DataFrame:
    """path-free containers: (packageKey, version, manifest, media map) -> archive bytes, entries sorted, times fixed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for manifest, media in zip(batch["manifest"], batch["media"], strict=True):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    for name, data in [(MANIFEST, manifest.encode()), *sorted((media or {}).items())]:
                        z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
                out.append(held.getvalue())
            yield batch[["packageKey", "version"]].assign(content=out)

    return in_pandas(packages.select("packageKey", "version", "manifest", F.map_entries("media").alias("entries")).select("packageKey", "version", "manifest", F.map_from_entries("entries").alias("media")), run, "packageKey string, version string, content binary")


def _write_each(rows: DataFrame, path: str, ending: str) -> str:
    """A file for each row (name, content), written by the tasks that hold the rows; rows are the files written."""
    name = rows.schema["name"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = pafs.FileSystem.from_uri(path)
        files.create_dir(root)
        for batch in batches:
            for n, content in zip(batch["name"], batch["content"], strict=True):
                with files.open_output_stream(f"{root}/{n}{ending}") as out:
                    out.write(content)
            yield batch[["name"]]

    in_pandas(rows.select("name", "content"), run, f"name {name}").write.format("noop").mode("overwrite").save()
    return path


def write_texts(rows: DataFrame, path: str) -> str:
    """A text file for each row (name, text)."""
    return _write_each(rows.select("name", F.encode("text", "UTF-8").alias("content")), path, ".txt")


def write_containers(archives: DataFrame, path: str) -> str:
    """An archive file for each container (packageKey, version, content)."""
    return _write_each(archives.select(F.concat_ws("-", "packageKey", "version").alias("name"), "content"), path, ".zip")


def read_last_entry(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the last entry (by name, the manifest aside) of each archive: its directory at the end is read, then that entry alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p in batch["path"]:
                files, at = pafs.FileSystem.from_uri(p)
                with files.open_input_file(at) as held, zipfile.ZipFile(held) as z:
                    out.append(z.read(max(n for n in z.namelist() if n != MANIFEST)))
            yield pd.DataFrame({"path": batch["path"], "content": out})

    listed = spark.read.format("binaryFile").load(path).select("path")
    return in_pandas(listed, run, "path string, content binary")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of plain text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, content, error of image files up to the limit."""
    large = F.length("content") > MOST_IMAGE_BYTES
    return _binary(spark, path).select("path", F.when(~large, F.col("content")).alias("content"), F.when(large, "too large").alias("error"))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _paragraphs(part: bytes, block: str) -> list[str]:
    """The text runs of each block element of an office part."""
    return ["".join(t.text or "" for t in b.iter() if _local(t.tag) == "t") for b in ElementTree.fromstring(part).iter() if _local(b.tag) == block]


def _sheet(part: bytes, shared: list[str]) -> list[str]:
    rows = []
    for row in (x for x in ElementTree.fromstring(part).iter() if _local(x.tag) == "row"):
        cells = []
        for c in row:
            value = next((v.text or "" for v in c.iter() if _local(v.tag) in ("v", "t")), "")
            cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
        if any(cells):
            rows.append(" | ".join(cells))
    return rows


def office_text(content: bytes) -> str:
    """Paragraphs of a word file, slides of a presentation, rows of a workbook with headings."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        _entries(content)
        names = z.namelist()

        def numbered(prefix: str) -> list[str]:
            return sorted((n for n in names if re.fullmatch(rf"{prefix}\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))

        if "word/document.xml" in names:
            return "\n".join(p for p in _paragraphs(z.read("word/document.xml"), "p") if p.strip())
        if slides := numbered("ppt/slides/slide"):
            return "\n\n".join(f"# {i}\n" + "\n".join(p for p in _paragraphs(z.read(n), "p") if p.strip()) for i, n in enumerate(slides, 1))
        if sheets := numbered("xl/worksheets/sheet"):
            shared = _paragraphs(z.read("xl/sharedStrings.xml"), "si") if "xl/sharedStrings.xml" in names else []
            return "\n\n".join(f"# {i}\n" + "\n".join(_sheet(z.read(n), shared)) for i, n in enumerate(sheets, 1))
    raise ValueError("not an office file")


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """path, text, error of docx, pptx and xlsx files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append((p, office_text(content), None))
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((p, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return in_pandas(_binary(spark, path), run, "path string, text string, error string")
