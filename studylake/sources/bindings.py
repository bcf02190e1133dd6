"""The given generic tables in the shape of the domain relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studylake.functions import rules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all cores, a few tasks for each: a small file is read by one task, which would do all the work on its rows."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def parts(df: DataFrame, rows: int = 500_000) -> int:
    """So many tasks that each gets about ``rows`` rows, however large the table is; a count of a file reads its footers."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def _graded(df: DataFrame) -> DataFrame:
    return df.withColumn("grade", rules.effective_grade(F.col("self_grade"), F.col("is_correct")))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer log, from events: a question is a user, ten banks."""
    kind = F.col("event_type")
    seconds = F.when(F.get_json_object("props", "$.k").cast("int") < 50, F.floor("value"))
    return _graded(
        table(spark, sf_dir, "events").select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("question_id"),
            (F.col("user_id") % 10).alias("bank_id"),
            F.col("ts").alias("answered_at"),
            F.when(kind.isin("purchase", "signup", "click"), True).when(kind == "error", False).alias("is_correct"),
            F.when(kind == "click", "PARTIAL").alias("self_grade"),
            seconds.alias("seconds"),
        )
    )


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A longer log with ties in time, from lineitem; id is a total order of its rows."""
    flag = F.col("l_returnflag")
    return _graded(
        table(spark, sf_dir, "lineitem").select(
            F.col("l_partkey").alias("question_id"),
            (F.col("l_partkey") % 10).alias("bank_id"),
            F.col("l_shipdate").alias("answered_at"),
            (F.col("l_linestatus") == "F").alias("is_correct"),
            F.when(flag == "R", "WRONG").when(flag == "N", "CORRECT").alias("self_grade"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.col("l_extendedprice").alias("tie"),
        )
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue, from part."""
    kinds = F.array(*[F.lit(k) for k in ("SINGLE", "MULTIPLE", "JUDGE", "SUBJECTIVE")])
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        (F.col("p_partkey") % 10).alias("bank_id"),
        F.col("p_name").alias("content"),
        F.col("p_type").alias("topic"),
        F.col("p_brand").alias("category"),
        F.element_at(kinds, F.col("p_size") % 4 + 1).alias("question_type"),
        (F.col("p_size") / 10).alias("score"),
    )


def banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banks, from nation (25, of which ten have answers)."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("bank_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region_id"))


def session_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of sessions, from lineitem; (session, place) is made unique."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("sort")).agg(
        F.min("l_partkey").alias("question_id"), F.min_by("l_linestatus", F.struct("l_partkey", "l_extendedprice", "l_linestatus")).alias("status"), F.min("l_shipdate").alias("answered_at")
    )


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with keys, numbers, options, answers and materials, some of them broken."""
    n, size = F.col("p_partkey"), F.col("p_size")
    letters = F.slice(F.array(*[F.lit(x) for x in "ABCD"]), F.lit(1), size % 5)
    return table(spark, sf_dir, "part").select(
        n.alias("id"),
        (n % 10).alias("bank_id"),
        F.concat(F.col("p_brand"), F.lit("-"), F.col("p_type")).alias("external_id"),
        F.when(n % 3 != 0, size).alias("number"),
        F.col("p_name").alias("content"),
        F.transform(letters, lambda k: F.struct(k.alias("key"), F.concat(k, F.lit(" "), F.col("p_type")).alias("text"))).alias("options"),
        F.when(size % 4 == 0, "").when(size % 4 == 1, "B").when(size % 4 == 2, "A, C").alias("answer_keys"),
        F.when(size % 7 != 0, F.col("p_type")).otherwise(" ").alias("topic"),
        F.col("p_brand").alias("category"),
        F.element_at(F.array(*[F.lit(k) for k in ("SINGLE", "MULTIPLE", "JUDGE", "SUBJECTIVE")]), size % 4 + 1).alias("question_type"),
        (size / 10).alias("score"),
        F.when(n % 4 == 0, F.floor(n / 40)).alias("material_id"),
        (size % 3 == 0).alias("favorite"),
        n.alias("position"),
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of questions, from labels: thirty nodes, of which twenty-five exist."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("question_id"),
        (F.col("doc_id") % 30).cast("string").alias("node_id"),
        F.when(F.col("toxic") == 1, "ai").otherwise("author").alias("source"),
        (0.5 + F.col("quality") / 4).alias("confidence"),
        (F.col("quality") == 1).alias("confirmed"),
    )


def skill_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill nodes, from nation: each needs the one ten before it, and its region's first."""
    nation = table(spark, sf_dir, "nation")
    n, before = F.col("n_nationkey"), F.col("n_nationkey") - 10
    need = F.filter(F.array(F.when(before >= 0, before.cast("string")), F.when(n % 5 != 0, (n - n % 5).cast("string"))), lambda x: x.isNotNull())
    return nation.select(n.cast("string").alias("node_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("stage"), need.alias("prereq"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes, from documents."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), F.col("text").alias("content"), F.col("source").alias("color"), F.col("n_chars"))


def note_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of notes, from labels: to a question or a bank."""
    bank = F.col("doc_id") % 3 == 0
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("note_id"), F.when(bank, "BANK").otherwise("QUESTION").alias("target_type"), F.when(bank, F.col("doc_id") % 40).otherwise(F.col("doc_id")).alias("target_id"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Practice sessions, from orders."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), (F.col("o_custkey") % 10).alias("bank_id"), F.col("o_orderpriority").alias("mode"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of conversations."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), "role", F.col("text").alias("content"))
