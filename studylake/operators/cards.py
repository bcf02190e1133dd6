"""Flash cards, conversations and jobs: the smaller keyed tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studylake.functions import rules
from studylake.operators import exchange


def candidates(questions: DataFrame, tags: DataFrame, cards: DataFrame, least: int = 20, size: int = 20) -> DataFrame:
    """question_id, batch: tagged questions without a card whose analysis is long enough."""
    fit = questions.filter(F.length(F.trim("analysis")) >= least)
    rows = fit.join(tags.select("question_id").distinct(), "question_id", "left_semi").join(cards.select("question_id"), "question_id", "left_anti")
    return exchange.batches(rows.select("bank_id", "question_id"), ["bank_id"], "question_id", size)


def at_most(cards: DataFrame, batch: DataFrame, most: int = 3) -> DataFrame:
    """Cards of a batch's questions, the first ``most`` of each."""
    n = F.row_number().over(Window.partitionBy("question_id").orderBy("position"))
    return cards.join(batch.select("question_id"), "question_id", "left_semi").withColumn("n", n).filter(F.col("n") <= most).drop("n")


def step(cards: DataFrame, answers: DataFrame) -> DataFrame:
    """Cards after one answer each (remembered, answered_at): a lapse sets back to level 0, due now."""
    a = answers.select("card_id", "remembered", "answered_at")
    level = rules.next_level(F.col("level"), F.col("remembered"))
    rows = cards.join(a, "card_id", "left")
    new = F.col("remembered").isNotNull()
    return rows.select(
        "card_id",
        F.when(new, level).otherwise(F.col("level")).alias("level"),
        F.when(new, rules.interval_days(level)).otherwise(F.col("interval_days")).alias("interval_days"),
        F.when(F.col("remembered"), F.col("answered_at") + F.make_dt_interval(rules.interval_days(level))).when(new, F.col("answered_at")).otherwise(F.col("due_at")).alias("due_at"),
        (F.col("lapses") + F.when(new & ~F.col("remembered"), 1).otherwise(0)).alias("lapses"),
    )


def totals(cards: DataFrame, as_of: datetime) -> DataFrame:
    """Cards in all, unconfirmed, due and learned, per bank."""
    due = F.col("confirmed") & (F.col("due_at") <= F.lit(as_of))
    return cards.groupBy("bank_id").agg(F.count("*").alias("total"), F.count_if(~F.col("confirmed")).alias("unconfirmed"), F.count_if(due).alias("due"), F.count_if(F.col("level") >= 3).alias("learned"))


def tail(messages: DataFrame, most: int = 8) -> DataFrame:
    """The last messages of each conversation."""
    n = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("id")))
    return messages.withColumn("n", n).filter(F.col("n") <= most)


def highest_hint(messages: DataFrame) -> DataFrame:
    """The largest hint level of each conversation's assistant messages, 0 without one."""
    level = F.when(F.col("role") == "assistant", F.col("hint_level"))
    return messages.groupBy("session_id").agg(F.coalesce(F.max(level), F.lit(0)).alias("hint_level"), F.count("*").alias("messages"))


def job_states(jobs: DataFrame, as_of: datetime, stale_minutes: int = 10, keep_days: int = 7) -> DataFrame:
    """job_id, state: ACTIVE, STALE (pending too long), EXPIRED (finished long ago) or DONE."""
    age = F.timestamp_diff("MINUTE", "updated_at", F.lit(as_of))
    live = F.col("status") == "PENDING"
    state = F.when(live & (age > stale_minutes), "STALE").when(live, "ACTIVE").when(age > keep_days * 1440, "EXPIRED").otherwise("DONE")
    return jobs.select("job_id", state.alias("state"))


def missing_answers(questions: DataFrame, size: int = 10) -> DataFrame:
    """Objective questions without answer keys, dealt to batches of each bank."""
    blank = F.col("answer_keys").isNull() | (F.trim("answer_keys") == "")
    return exchange.batches(questions.filter(blank & (F.col("question_type") != "SUBJECTIVE")).select("bank_id", "id"), ["bank_id"], "id", size)


def last_results(answers: DataFrame) -> DataFrame:
    """question_id, last_result: of the latest answered card of each question."""
    return answers.groupBy("question_id").agg(F.max_by("remembered", F.struct("answered_at", "card_id")).alias("remembered")).select("question_id", F.when(F.col("remembered"), "REMEMBERED").otherwise("FORGOTTEN").alias("last_result"))


def queue(cards: DataFrame, as_of: datetime, most: int = 200) -> DataFrame:
    """Confirmed cards that are due, longest first, at most 200."""
    due = cards.filter(F.col("confirmed") & (F.col("due_at") <= F.lit(as_of)))
    return due.orderBy("due_at", "card_id").limit(max(1, min(most, 200)))


def explanation_modes(asked: DataFrame, log: DataFrame) -> DataFrame:
    """question_id, mode: as requested (WRONG or NEUTRAL), else WRONG if the latest answer is wrong."""
    last = log.groupBy("question_id").agg(F.max_by(rules.is_wrong(F.col("grade")), F.struct("answered_at", "id")).alias("wrong"))
    wish = F.upper("requested")
    mode = F.when(wish.isin("WRONG", "NEUTRAL"), wish).when(F.col("wrong"), "WRONG").otherwise("NEUTRAL")
    return asked.join(last, "question_id", "left").select("question_id", mode.alias("mode"))


def conversations(asked: DataFrame, existing: DataFrame) -> DataFrame:
    """asked (question_id, practice_session_id, kind) with the open conversation to go on with, null for a new one.

    Nulls are equal in a key; of several open ones the latest counts.
    """
    keys = ["question_id", "practice_session_id", "kind"]
    live = existing.filter("NOT closed").groupBy(*keys).agg(F.max_by("conversation_id", F.struct("updated_at", "conversation_id")).alias("conversation_id"))
    on = asked[keys[0]].eqNullSafe(live[keys[0]])
    for k in keys[1:]:
        on = on & asked[k].eqNullSafe(live[k])
    return asked.join(live, on, "left").select(*[asked[k] for k in keys], "conversation_id")


def question_history(log: DataFrame, tags: DataFrame) -> DataFrame:
    """question_id, wrong_times, last_at, phrases: a question's past, and how its nodes go (node: word)."""
    own = log.groupBy("question_id").agg(F.count_if(rules.is_wrong(F.col("grade"))).alias("wrong_times"), F.max("answered_at").alias("last_at"), F.count("grade").alias("n"), F.count_if(rules.is_right(F.col("grade"))).alias("ok"))
    links = tags.select("question_id", "node_id").distinct()
    node = links.join(own, "question_id").groupBy("node_id").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"))
    node = node.filter("n >= 3").select("node_id", F.concat_ws(": ", "node_id", rules.phrase(F.col("n"), F.col("ok"))).alias("text"))
    texts = links.join(node, "node_id").groupBy("question_id").agg(F.array_sort(F.collect_list("text")).alias("texts"))
    none = F.array().cast("array<string>")
    return own.filter("wrong_times > 0").join(texts, "question_id", "left").select("question_id", "wrong_times", "last_at", F.array_join(F.coalesce("texts", none), "; ").alias("phrases"))
