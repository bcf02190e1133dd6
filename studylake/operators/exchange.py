"""Banks as packages: union, numbering, checksums, versions, exchange of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylake.operators import review, search


def merge_banks(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """Questions of banks (bank_id, ordinal) as one new bank, numbered 1..n.

    A key that an earlier source has gets the suffix -ordinal.  ``sources`` are
    the banks that someone chose: a short list.
    """
    rows = questions.join(F.broadcast(sources), "bank_id")
    first = rows.groupBy("external_id").agg(F.min("ordinal").alias("first"))
    keyed = rows.join(first, "external_id").withColumn("new_key", F.when(F.col("ordinal") == F.col("first"), F.col("external_id")).otherwise(F.concat("external_id", F.lit("-"), F.col("ordinal").cast("string"))))
    return numbered(keyed, [], ["ordinal"], "id").withColumnRenamed("rank", "number").drop("first")


def numbered(df: DataFrame, keys: list[str], before: list[str], by: str, width: int = 1 << 16) -> DataFrame:
    """``df`` with rank 1..n within ``keys``, in the order of ``before`` and the whole number ``by``.

    A key may hold a third of all rows, so rows are numbered within stretches
    of ``width`` values of ``by`` and shifted by the counts of the stretches
    before; only those counts, one row for a stretch, are ordered whole.
    """
    cell = [*keys, *before, "_cell"]
    rows = df.withColumn("_cell", F.floor(F.col(by) / width))
    counts = rows.groupBy(*cell).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*keys).orderBy(*before, "_cell").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.withColumn("_shift", F.coalesce(F.sum("_n").over(order), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy(by))
    rows, same = rows.withColumn("_in", inside), None
    for c in cell:
        one = rows[c].eqNullSafe(shift[c])
        same = one if same is None else same & one
    return rows.join(shift, same).select(*[rows[c] for c in df.columns], (F.col("_in") + F.col("_shift")).cast("int").alias("rank"))


def unique_keys(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The nth repeat of a key gets the suffix -n."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_n", n).withColumn("unique_key", F.when(F.col("_n") == 1, F.col(key)).otherwise(F.concat(key, F.lit("-"), F.col("_n").cast("string")))).drop("_n")


def continue_numbers(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New rows of each bank: given numbers stay, others go on after the largest."""
    most = existing.unionByName(new.select("bank_id", "number")).groupBy("bank_id").agg(F.coalesce(F.max("number"), F.lit(0)).alias("most"))
    given = new.filter("number IS NOT NULL")
    rest = numbered(new.filter("number IS NULL"), ["bank_id"], [], "position").join(most, "bank_id").withColumn("number", F.col("most") + F.col("rank"))
    return given.unionByName(rest.select(*new.columns))


def append(existing: DataFrame, package: DataFrame) -> DataFrame:
    """Package questions whose key the bank lacks."""
    return package.join(existing.select("bank_id", "external_id"), ["bank_id", "external_id"], "left_anti")


def checksum(*fields: Column) -> Column:
    """SHA-256 of the fields as one JSON object in the given order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def sorted_map(m: Column) -> Column:
    """A map in the order of its keys."""
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def bank_checksum(questions: DataFrame) -> DataFrame:
    """bank_id, checksum: of the questions' checksums in key order, by way of 4,096 groups of keys.

    A group (by the first digits of the key's SHA-256) is hashed in key order,
    then the groups in theirs, so that no row holds a whole bank.
    """
    one = questions.select("bank_id", "external_id", checksum(*[F.col(c) for c in questions.columns if c != "bank_id"]).alias("c"), F.substring(F.sha2("external_id", 256), 1, 3).alias("g"))

    def joined(*fields: str) -> Column:
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*fields))), lambda x: x["c"]), ""), 256)

    groups = one.groupBy("bank_id", "g").agg(joined("external_id", "c").alias("c"))
    return groups.groupBy("bank_id").agg(joined("g", "c").alias("checksum"))


def import_decision(packages: DataFrame, banks: DataFrame) -> DataFrame:
    """package_key, version, decision: CREATED, VERSION_ADDED, ALREADY_IMPORTED or BRANCHED."""
    key = banks.select("package_key").distinct().withColumn("has_key", F.lit(True))
    same = banks.select("package_key", "version", F.col("checksum").alias("old"))
    rows = packages.join(key, "package_key", "left").join(same, ["package_key", "version"], "left")
    decision = F.when(F.col("old") == F.col("checksum"), "ALREADY_IMPORTED").when(F.col("old").isNotNull(), "BRANCHED").when(F.col("has_key"), "VERSION_ADDED").otherwise("CREATED")
    return rows.select("package_key", "version", decision.alias("decision"))


def next_version(version: Column) -> Column:
    """The next patch of a dotted version; 1.0.0 where it can't be read."""
    p = F.split(F.trim(version), r"\.")
    part = [F.coalesce(F.try_element_at(p, F.lit(i)).try_cast("int"), F.lit(0)) for i in (1, 2, 3)]
    fine = version.rlike(r"^\s*[0-9]{1,9}(\.[0-9]{1,9}){0,2}\s*$")
    return F.when(fine, F.concat_ws(".", part[0].cast("string"), part[1].cast("string"), (part[2] + 1).cast("string"))).otherwise("1.0.0")


def import_records(records: DataFrame, banks: DataFrame, questions: DataFrame, log: DataFrame) -> dict[str, DataFrame]:
    """Records of an exchange file met with their bank and question by natural keys.

    new: rows that neither the log nor an earlier row of the file holds;
    missing_banks, missing_questions: what wasn't found.
    """
    b = banks.select("package_key", "version", "bank_id")
    q = questions.select("bank_id", F.col("external_id").alias("question_key"), F.col("id").alias("question_id"))
    placed = records.join(b, ["package_key", "version"], "left").join(q, ["bank_id", "question_key"], "left")
    same = ["question_id", "second", "selected_keys", "is_correct", "user_answer", "self_grade"]
    second = F.date_trunc("second", "answered_at").cast("timestamp_ntz")
    rows = placed.filter("question_id IS NOT NULL").withColumn("second", second).dropDuplicates(same)
    old = log.withColumn("second", second).select(*[F.col(c).alias(f"_{c}") for c in same]).distinct()
    on = rows[same[0]].eqNullSafe(old[f"_{same[0]}"])
    for c in same[1:]:
        on = on & rows[c].eqNullSafe(old[f"_{c}"])
    return {
        "new": rows.join(old, on, "left_anti").drop("second"),
        "missing_banks": placed.filter("bank_id IS NULL").select("package_key", "version").distinct(),
        "missing_questions": placed.filter("bank_id IS NOT NULL AND question_id IS NULL").select("bank_id", "question_key").distinct(),
    }


def merge_category(questions: DataFrame) -> DataFrame:
    """The category as topic where the topic is blank."""
    blank = F.trim(F.coalesce("topic", F.lit(""))) == ""
    return questions.withColumn("topic", F.when(blank, F.col("category")).otherwise(F.col("topic")))


def patch(rows: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with patches laid over: null keeps, blank clears."""
    p = patches.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = rows.join(p, key, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col(f"_{c}").isNull(), F.col(c)).when(F.trim(F.col(f"_{c}").cast("string")) == "", None).otherwise(F.col(f"_{c}"))).drop(f"_{c}")
    return out


def delete_bank(bank_id: int, tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table without a bank's rows, and how many rows each lost."""
    lost = None
    for name, df in tables.items():
        n = df.filter(F.col("bank_id") == bank_id).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        lost = n if lost is None else lost.unionByName(n)
    return {name: df.filter(~F.coalesce(F.col("bank_id") == bank_id, F.lit(False))) for name, df in tables.items()}, lost


def batches(rows: DataFrame, keys: list[str], by: str, size: int) -> DataFrame:
    """``rows`` of each key dealt to batches of ``size`` in the order of a whole number."""
    return numbered(rows, keys, [], by).withColumn("batch", F.floor((F.col("rank") - 1) / size)).drop("rank")


def rebuilt_states(new: DataFrame, log: DataFrame, states: DataFrame) -> DataFrame:
    """States after an import: questions of new records that have none replay all their records, the flag first."""
    fresh = new.select("question_id").distinct().join(states.select("question_id"), "question_id", "left_anti")
    every = log.unionByName(new.select(*log.columns)).join(fresh, "question_id", "left_semi")
    return states.unionByName(review.states(every, raw_first=True))


def export_questions(questions: DataFrame, which: str = "all", topics: list | None = None, categories: list | None = None, ids: list | None = None, wrong: DataFrame | None = None, answered: DataFrame | None = None) -> DataFrame:
    """The questions that an export takes: scope, topics, categories, chosen ids."""
    rows = search.scope(questions, which, wrong, answered)
    return rows.filter(search.all_of(search.among("topic", topics), search.among("category", categories), search.among("id", ids)))


def referenced_materials(materials: DataFrame, questions: DataFrame) -> DataFrame:
    """material_key, content of the materials that the questions name."""
    used = questions.select("material_id").filter("material_id IS NOT NULL").distinct()
    return materials.join(used, "material_id", "left_semi").select("material_id", F.concat(F.lit("material-"), F.col("material_id").cast("string")).alias("material_key"), "content")


def export_identity(banks: DataFrame) -> DataFrame:
    """bank_id, action, error: what an export does to a bank's identity.

    ``banks``: bank_id, package_key, checksum, current (the contents' checksum
    now), version, asked (version wanted, null: as it is), mode, whole (nothing
    filtered).  CLAIM: a new identity that the bank keeps; TEMPORARY: one for
    this file; KEEP; UPGRADE: kept with a new version; BRANCH: a new one whose
    parent is the old.  A new version without new contents is an error.
    """
    changed = ~F.col("checksum").eqNullSafe(F.col("current"))
    mode, none = F.upper(F.coalesce("mode", F.lit(""))), F.coalesce(F.trim("package_key"), F.lit("")) == ""
    action = F.when(none, F.when(F.col("whole"), "CLAIM").otherwise("TEMPORARY")).when(mode == "UPGRADE", F.when(changed, "UPGRADE").otherwise("KEEP")).when((mode == "BRANCH") | changed, "BRANCH").otherwise("KEEP")
    empty = ~changed & F.col("version").isNotNull() & (F.coalesce("asked", "version") != F.col("version"))
    return banks.select("bank_id", action.alias("action"), F.when(empty, "VERSION_WITHOUT_CHANGE").alias("error"))


def mark_published(exports: DataFrame, published: DataFrame, removed: DataFrame) -> DataFrame:
    """Export records, newest first by (created_at, id): marked if published, without the removed."""
    marks = published.select("id").distinct().withColumn("_p", F.lit(True))
    left = exports.join(removed.select("id"), "id", "left_anti").join(marks, "id", "left")
    return left.withColumn("published", F.coalesce("published", F.lit(False)) | F.coalesce("_p", F.lit(False))).drop("_p")


def created_questions(rows: DataFrame) -> DataFrame:
    """Questions of a batch with what a new one has by default: score 1, no mark, not deleted."""
    return rows.withColumn("score", F.coalesce("score", F.lit(1.0))).withColumn("favorite", F.lit(False)).withColumn("deleted", F.lit(False))


def patched_questions(rows: DataFrame, patches: DataFrame, columns: list[str]) -> DataFrame:
    """Questions with patches laid over; one that becomes subjective loses options and answer keys."""
    out = patch(rows, patches, "id", columns)
    subjective = F.col("question_type") == "SUBJECTIVE"
    return out.withColumn("options", F.when(~subjective, F.col("options"))).withColumn("answer_keys", F.when(~subjective, F.col("answer_keys")))


def merged_materials(*sources: DataFrame) -> DataFrame:
    """Materials (document, material, content) of several sources: the first source that has a key wins."""
    every = None
    for n, rows in enumerate(sources):
        one = rows.select("document", "material", "content", F.lit(n).alias("source"))
        every = one if every is None else every.unionByName(one)
    first = F.min_by("content", F.struct("source", "content"))
    return every.groupBy("document", "material").agg(first.alias("content"), F.min("source").alias("source"))


def without_material(questions: DataFrame, material_id: int) -> DataFrame:
    """Questions after a material went: its references are cleared."""
    gone = F.coalesce(F.col("material_id") == material_id, F.lit(False))
    return questions.withColumn("material_id", F.when(~gone, F.col("material_id")))
