"""What the answer log says: latest answers, wrong questions, healing, cohorts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylake.functions import rules


def latest(attempts: DataFrame, *more: str) -> DataFrame:
    """The latest answer of each question, by (answered_at, id), ties to ``more``.

    An aggregate, not a window: each task keeps one row for a question.
    """
    order = F.struct("answered_at", "id", *more)
    rest = [c for c in attempts.columns if c != "question_id"]
    return attempts.groupBy("question_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("question_id", "r.*")


def wrong_questions(attempts: DataFrame) -> DataFrame:
    """bank_id, question_id, wrong_times, last_at of questions whose latest answer is wrong."""
    wrong = rules.is_wrong(F.col("grade"))
    order = F.struct("answered_at", "id")
    per = attempts.groupBy("bank_id", "question_id").agg(F.count_if(wrong).alias("wrong_times"), F.max("answered_at").alias("last_at"), F.max_by(wrong, order).alias("now_wrong"))
    return per.filter("now_wrong").drop("now_wrong")


def page(df: DataFrame, order: list[Column], number: int, size: int, most: int = 100) -> DataFrame:
    """One page in a total order, with the total; number and size are clamped."""
    size, number = max(1, min(size, most)), max(1, number)
    total = df.agg(F.count("*")).scalar()
    return df.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("total", total)


def healed(attempts: DataFrame, *more: str) -> DataFrame:
    """Questions whose latest answer is right and an earlier one was wrong."""
    order = F.struct("answered_at", "id", *more)
    right, wrong = rules.is_right(F.col("grade")), rules.is_wrong(F.col("grade"))
    per = attempts.groupBy("question_id").agg(F.max_by(right, order).alias("right"), F.max("answered_at").alias("healed_at"), F.count_if(wrong).alias("wrong_times"))
    return per.filter("right AND wrong_times > 0").drop("right")


def after_first_error(attempts: DataFrame, *more: str) -> DataFrame:
    """Per bank: questions once wrong, decided and right answers after the first error."""
    wrong = rules.is_wrong(F.col("grade"))
    earlier = Window.partitionBy("question_id").orderBy("answered_at", "id", *more).rowsBetween(Window.unboundedPreceding, -1)
    rows = attempts.withColumn("again", F.coalesce(F.max(wrong).over(earlier), F.lit(False)))
    return rows.groupBy("bank_id").agg(
        F.countDistinct(F.when(wrong, F.col("question_id"))).alias("cohort"),
        F.count_if(F.col("again") & F.col("grade").isNotNull()).alias("decided"),
        F.count_if(F.col("again") & rules.is_right(F.col("grade"))).alias("right_again"),
    )


def month_snapshots(attempts: DataFrame, as_of: datetime, months: int = 6, *more: str) -> DataFrame:
    """Questions wrong at the end (23:59:59) of each of the last months.

    An answer counts from its own month on, so each question's answers are cut
    to one for a month before they meet the months: no row is multiplied by
    more than ``months``.
    """
    spark = attempts.sparkSession
    ends = spark.range(months).select(F.last_day(F.add_months(F.lit(as_of.date()), -F.col("id").cast("int"))).alias("month_end"))
    first = F.trunc(F.add_months(F.lit(as_of.date()), 1 - months), "month")
    ends = F.broadcast(ends.withColumn("cut", F.col("month_end").cast("timestamp_ntz") + F.expr("INTERVAL '0 23:59:59' DAY TO SECOND")))
    # The last fraction of a month's second belongs to the next month's snapshot.
    seen = F.greatest(F.last_day(F.col("answered_at") + F.expr("INTERVAL '0 0:0:0.999999' DAY TO SECOND")), F.last_day(first))
    one = attempts.withColumn("seen", seen).groupBy("question_id", "seen").agg(F.max_by(F.struct(rules.is_wrong(F.col("grade")).alias("wrong"), "answered_at", "id", *more), F.struct("answered_at", "id", *more)).alias("r"))
    at = one.join(ends, F.col("seen") <= F.col("month_end")).groupBy("month_end", "question_id").agg(F.max_by("r.wrong", F.struct("r.answered_at", "r.id", *[f"r.{m}" for m in more])).alias("wrong"))
    return ends.select("month_end").join(at.groupBy("month_end").agg(F.count_if("wrong").alias("wrong_questions")), "month_end", "left").select("month_end", F.coalesce("wrong_questions", F.lit(0)).alias("wrong_questions"))
