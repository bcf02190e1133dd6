"""Spaced repetition and rating: ordered folds of each question's answers.

A fold keeps Spark's own operators: the answers of a question are collected in
order and folded by ``aggregate``.  The log of one question is bounded by its
learner; the hot dimension here is the bank, and banks never group a fold.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylake.functions import rules


def _ordered(*fields: str) -> Column:
    return F.array_sort(F.collect_list(F.struct("answered_at", "id", *fields)))


def states(attempts: DataFrame, raw_first: bool = False) -> DataFrame:
    """question_id, bank_id, level, interval_days, due_at after all decided answers.

    raw_first: the flag before the self grade (as a replay of imported records does).
    """
    right = F.coalesce("is_correct", F.when(F.col("self_grade").isNotNull(), F.col("self_grade") == "CORRECT")) if raw_first else F.when(F.col("grade").isNotNull(), F.col("grade") == "CORRECT")
    rows = attempts.withColumn("right", right).filter("right IS NOT NULL")
    start = F.struct(F.lit(0).alias("level"), F.lit(None).cast("timestamp_ntz").alias("at"), F.lit(False).alias("right"))

    def step(s: Column, x: Column) -> Column:
        return F.struct(rules.next_level(s["level"], x["right"]).alias("level"), x["answered_at"].alias("at"), x["right"].alias("right"))

    last = rows.groupBy("question_id").agg(F.min("bank_id").alias("bank_id"), F.aggregate(_ordered("right"), start, step).alias("s"))
    days = rules.interval_days(F.col("s.level"))
    due = F.when(F.col("s.right"), F.col("s.at") + F.make_dt_interval(days)).otherwise(F.col("s.at"))
    return last.select("question_id", "bank_id", F.col("s.level").alias("level"), days.alias("interval_days"), due.alias("due_at"), F.lit(False).alias("suspended"))


def queue(states_: DataFrame, as_of: datetime) -> DataFrame:
    """Reviews due, stalest first, with the days they are late."""
    due = states_.filter(~F.coalesce("suspended", F.lit(False)) & (F.col("due_at") <= F.lit(as_of)))
    late = F.greatest(F.lit(0), F.datediff(F.lit(as_of), "due_at"))
    return due.select("question_id", "bank_id", "level", "due_at", late.alias("overdue_days"))


def summary(states_: DataFrame, as_of: datetime) -> DataFrame:
    """Per bank: states, due now, overdue since before today, mastered."""
    live = ~F.coalesce("suspended", F.lit(False))
    today = F.lit(as_of.replace(hour=0, minute=0, second=0, microsecond=0))
    return states_.groupBy("bank_id").agg(
        F.count("*").alias("total"),
        F.count_if(live & (F.col("due_at") <= F.lit(as_of))).alias("due"),
        F.count_if(live & (F.col("due_at") < today)).alias("overdue"),
        F.count_if(F.col("level") >= 3).alias("learned"),
    )


def suspend(states_: DataFrame, questions: DataFrame, on: bool = True) -> DataFrame:
    """States with some questions suspended or resumed."""
    chosen = questions.select("question_id").distinct().withColumn("_hit", F.lit(True))
    return states_.join(chosen, "question_id", "left").withColumn("suspended", F.when(F.col("_hit"), F.lit(on)).otherwise(F.col("suspended"))).drop("_hit")


def reset(states_: DataFrame, log: DataFrame, bank_id: int) -> tuple[DataFrame, DataFrame]:
    """States and log without those of a bank."""
    other = ~F.coalesce(F.col("bank_id") == bank_id, F.lit(False))
    return states_.filter(other), log.filter(other)


def earlier_answers(rows: DataFrame, by: tuple[str, ...] = ("bank_id",)) -> DataFrame:
    """``rows`` with the answers, all and right, before each in its group (n_before, ok_before).

    A group (a bank, a set of nodes) may hold a third of the log, so its running count
    is taken in two steps: within an hour, and over the sums of the hours before.
    """
    hour = F.date_trunc("hour", "answered_at").cast("timestamp_ntz")
    rows = rows.withColumn("hour", hour)
    cell = [*by, "hour"]
    sums = rows.groupBy(cell).agg(F.count("*").alias("n"), F.count_if("is_correct").alias("ok"))
    past = Window.partitionBy(*by).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*cell, *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"{c}_past") for c in ("n", "ok")])
    near = Window.partitionBy(*cell).orderBy("answered_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("n_near", F.count("*").over(near)).withColumn("ok_near", F.coalesce(F.count_if(F.col("is_correct")).over(near), F.lit(0)))
    rows = rows.join(sums, cell)
    return rows.withColumn("n_before", F.col("n_past") + F.col("n_near")).withColumn("ok_before", F.col("ok_past") + F.col("ok_near")).drop("hour", "n_past", "ok_past", "n_near", "ok_near")


def node_abilities(attempts: DataFrame, tags: DataFrame) -> DataFrame:
    """The decided answers with ``ability``: how the questions on the same nodes of the bank went up to and with each.

    ``tags``: question_id, node_id.  Questions of one bank with the same set of nodes form
    a class; an answer counts once for every class whose set meets that of its question,
    however many nodes they share, and each class keeps one running count.  Answers to
    questions without nodes have the ability of a mastery of one half.
    """
    right = F.when(F.col("grade").isNotNull(), rules.is_right(F.col("grade")))
    rows = attempts.withColumn("is_correct", right).filter("is_correct IS NOT NULL")
    sets = tags.groupBy("question_id").agg(F.array_sort(F.collect_set("node_id")).alias("nodes"))  # the nodes of a question
    rows = rows.join(sets, "question_id", "left")
    classes = rows.filter("nodes IS NOT NULL").select("bank_id", "nodes").distinct()
    of_node = classes.select("bank_id", "nodes", F.explode("nodes").alias("node"))
    meets = of_node.join(of_node.withColumnRenamed("nodes", "other"), ["bank_id", "node"]).select("bank_id", "nodes", "other").distinct()
    seen = rows.select("bank_id", F.col("nodes").alias("other"), "answered_at", "id", "is_correct").join(meets, ["bank_id", "other"])
    own = earlier_answers(seen, ("bank_id", "nodes")).filter(F.col("nodes") == F.col("other")).select("id", "n_before", "ok_before")
    share = (F.col("ok_before") + F.when(F.col("is_correct"), 1).otherwise(0) + 1.5) / (F.col("n_before") + 1 + 3)
    counted = rows.join(own, "id", "left").withColumn("ability", F.when(F.col("n_before").isNotNull(), rules.ability(share)).otherwise(0.0))
    return counted.drop("nodes", "n_before", "ok_before")


def ratings(attempts: DataFrame, questions: DataFrame, tags: DataFrame) -> DataFrame:
    """question_id, difficulty, attempts: ratings after all decided answers to known questions.

    A question starts from its type and score (``questions``: id, question_type, score);
    the ability at an answer is that on the question's nodes at the time.
    """
    start = questions.select(F.col("id").alias("question_id"), rules.initial_difficulty(F.col("question_type"), F.col("score")).alias("start"))
    return rated(node_abilities(attempts, tags).join(start, "question_id"))


def rated(rows: DataFrame) -> DataFrame:
    """The ordered fold: question_id, difficulty, attempts from rows with is_correct, ability and start."""
    # The fold needs the start inside: the first element carries it.
    zero = F.lit(None).cast("double")

    def step(d: Column, x: Column) -> Column:
        return rules.elo(F.coalesce(d, x["start"]), x["is_correct"], x["ability"])

    return rows.groupBy("question_id").agg(F.aggregate(_ordered("is_correct", "ability", "start"), zero, step).alias("difficulty"), F.count("*").alias("attempts"))
