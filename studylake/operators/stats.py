"""Statistics over the answer log: days, streaks, forecasts, banks, heat maps."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studylake.functions import rules


def calendar(df: DataFrame, first: date, last: date) -> DataFrame:
    """Every day from first to last."""
    return df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))


def daily(attempts: DataFrame, first: date, last: date) -> DataFrame:
    """answered, decided, correct of each day, days without answers too."""
    per = attempts.groupBy(F.to_date("answered_at").alias("day")).agg(F.count("*").alias("answered"), F.count("grade").alias("decided"), F.count_if(rules.is_right(F.col("grade"))).alias("correct"))
    days = calendar(attempts, first, last)
    return days.join(per, "day", "left").select("day", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("answered", "decided", "correct")])


def moving_rate(days: DataFrame) -> DataFrame:
    """Mean of daily rates over seven calendar days with at least three decided days, else null.

    ``days`` is a calendar: as many rows as days.
    """
    rate = F.when(F.col("decided") > 0, F.col("correct") / F.col("decided"))
    number = F.datediff("day", F.lit("1970-01-01"))
    week = Window.orderBy(number).rangeBetween(-6, 0)
    rows = days.withColumn("rate", rate)
    return rows.select("day", F.when(F.count("rate").over(week) >= 3, F.round(F.avg("rate").over(week), 6)).alias("rate7"))


def streaks(attempts: DataFrame, as_of: date, *keys: str) -> DataFrame:
    """Longest run of days, and the run that ends today or yesterday, of each key."""
    days = attempts.select(*keys, F.to_date("answered_at").alias("day")).filter(F.col("day") <= F.lit(as_of)).distinct()
    runs = days.withColumn("start", F.date_sub("day", F.row_number().over(Window.partitionBy(*keys).orderBy("day"))))
    lengths = runs.groupBy(*keys, "start").agg(F.count("*").alias("length"), F.max("day").alias("last"))
    return lengths.groupBy(*keys).agg(F.max("length").alias("longest"), F.coalesce(F.max(F.when(F.datediff(F.lit(as_of), "last") <= 1, F.col("length"))), F.lit(0)).alias("current"))


def totals(attempts: DataFrame) -> DataFrame:
    """Answers, decided, correct, seconds over all."""
    return attempts.agg(F.count("*").alias("answered"), F.count("grade").alias("decided"), F.count_if(rules.is_right(F.col("grade"))).alias("correct"), F.sum("seconds").alias("seconds"), F.countDistinct("question_id").alias("questions"))


def by_bank(attempts: DataFrame, banks: DataFrame, questions: DataFrame) -> DataFrame:
    """Every bank: questions, answered, decided, correct, rate, low flag."""
    per = attempts.groupBy("bank_id").agg(F.count("*").alias("answered"), F.count("grade").alias("decided"), F.count_if(rules.is_right(F.col("grade"))).alias("correct"), F.countDistinct("question_id").alias("seen"))
    size = questions.groupBy("bank_id").agg(F.count("*").alias("questions"))
    rows = banks.join(per, "bank_id", "left").join(size, "bank_id", "left")
    rate = F.when(F.col("decided") > 0, F.round(F.col("correct") / F.col("decided"), 6))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("questions", "seen", "answered", "decided", "correct")]
    return rows.select("bank_id", "name", *zero, rate.alias("rate"), F.coalesce(rate < 0.6, F.lit(False)).alias("low"))


def progress(attempts: DataFrame, questions: DataFrame) -> DataFrame:
    """Per bank: questions, answered of them, left, accuracy over all records."""
    live = attempts.join(questions.select(F.col("id").alias("question_id")), "question_id", "left_semi")
    good = F.coalesce(F.col("is_correct"), F.lit(False)) | F.coalesce(F.col("self_grade") == "CORRECT", F.lit(False))
    seen = live.groupBy("bank_id").agg(F.countDistinct("question_id").alias("answered"), F.count("*").alias("records"), F.count_if(good).alias("correct"))
    size = questions.groupBy("bank_id").agg(F.count("*").alias("questions"))
    rows = size.join(seen, "bank_id", "left").fillna(0, ["answered", "records", "correct"])
    return rows.select("bank_id", "questions", "answered", (F.col("questions") - F.col("answered")).alias("left"), "records", "correct", F.when(F.col("records") > 0, rules.round_half_up(F.col("correct") * 100 / F.col("records"))).otherwise(F.lit(0)).cast("long").alias("percent"))


def forecast(states: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """Reviews due on each of the coming days; the backlog is today's."""
    due = F.greatest(F.to_date("due_at"), F.lit(as_of))
    live = states.filter(~F.coalesce("suspended", F.lit(False)))
    per = live.groupBy(due.alias("day")).agg(F.count("*").alias("due"))
    spine = states.sparkSession.range(days).select(F.date_add(F.lit(as_of), F.col("id").cast("int")).alias("day"))
    return spine.join(per, "day", "left").select("day", F.coalesce("due", F.lit(0)).alias("due"))


def level_histogram(states: DataFrame) -> DataFrame:
    """Questions at each level 0..5, empty levels too."""
    level = F.greatest(F.lit(0), F.least(F.lit(5), F.col("level")))
    per = states.groupBy(level.alias("level")).agg(F.count("*").alias("n"))
    spine = states.sparkSession.range(6).select(F.col("id").cast("int").alias("level"))
    return spine.join(per, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))


def heat_map(days: DataFrame) -> DataFrame:
    """Cells of a calendar heat map: week column (from Monday), weekday, shade 0..5."""
    shade = F.when(F.col("answered") <= 0, 0).when(F.col("answered") <= 4, 1).when(F.col("answered") <= 9, 2).when(F.col("answered") <= 19, 3).when(F.col("answered") <= 34, 4).otherwise(5)
    first = days.agg(F.min("day")).scalar()
    monday = F.date_sub("first", F.weekday("first"))
    return days.withColumn("first", first).select("day", F.floor(F.datediff("day", monday) / 7).alias("week"), F.weekday("day").alias("weekday"), shade.alias("shade"))


def selected_sum(counts: DataFrame, chosen: list, *columns: str) -> DataFrame:
    """Sums of counts per bank over the chosen banks, 0 for none."""
    return counts.filter(F.col("bank_id").isin(chosen)).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])
