"""Practice sessions: drawing questions, and reports of what was answered."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylake.functions import rules


def in_order(wanted: DataFrame, questions: DataFrame) -> DataFrame:
    """Given ids (position, id) in their order: unknown ones and repeats dropped, placed from 1.

    A session is a bounded list: one window places it.
    """
    first = wanted.groupBy("id").agg(F.min("position").alias("position"))
    known = first.join(questions.select("id"), "id", "left_semi")
    return known.select("id", F.row_number().over(Window.orderBy("position", "id")).alias("place"))


#: Modes of a session (fixed values).
MODES = ("ALL", "SEQUENCE", "TOPIC", "FAVORITE", "WRONG", "REVIEW", "SKILL", "PLAN")


def pool(questions: DataFrame, mode: str, wrong: DataFrame | None = None, due: DataFrame | None = None, tags: DataFrame | None = None, nodes: list | None = None, ids: DataFrame | None = None) -> DataFrame:
    """The questions of a bank that a mode draws from; SKILL: those tagged with one of ``nodes``."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    by = {"WRONG": wrong, "REVIEW": due, "PLAN": ids}
    if mode == "FAVORITE":
        return questions.filter("favorite")
    if mode == "SKILL":
        by["SKILL"] = tags.filter(F.col("node_id").isin(nodes or []))
    if mode not in by:
        return questions
    rows = by[mode]
    chosen = rows.select(F.col("question_id" if "question_id" in rows.columns else "id").alias("id"))
    return questions.join(chosen, "id", "left_semi")


def _unit(whole: bool) -> Column:
    """A material with its questions, or one question."""
    one = F.concat(F.lit("q"), F.col("id").cast("string"))
    return F.coalesce(F.concat(F.lit("m"), F.col("material_id").cast("string")), one) if whole else one


def draw(questions: DataFrame, mode: str, count: int | None, seed: int = 0, done: DataFrame | None = None, start: int | None = None, order: DataFrame | None = None) -> DataFrame:
    """id, place of the questions of a session, out of a mode's ``pool``, until ``count`` is reached.

    ALL and SEQUENCE keep the questions of a material together, so the last
    unit may pass the count.  ALL and TOPIC take units not yet done (some
    question isn't) first; the order of units is a hash of seed and unit, but
    SEQUENCE goes by number, single questions before materials, from the unit
    of ``start`` on, and PLAN follows ``order`` (position, id) whatever the count.
    Without a count all are drawn.
    """
    if mode == "PLAN":
        return in_order(order, questions)
    if start is not None and mode != "SEQUENCE":
        raise ValueError("a first question is for SEQUENCE")
    whole = mode in ("ALL", "SEQUENCE")
    rows = questions.withColumn("unit", _unit(whole)).withColumn("grouped", F.lit(whole) & F.col("material_id").isNotNull())
    if mode in ("ALL", "TOPIC") and done is not None:
        rows = rows.join(done.select("id").distinct().withColumn("_done", F.lit(True)), "id", "left").withColumn("_done", F.coalesce("_done", F.lit(False)))
    else:
        rows = rows.withColumn("_done", F.lit(False))
    units = rows.groupBy("unit").agg(F.count("*").alias("size"), F.min("_done").alias("late"), F.max("grouped").alias("grouped"), F.min(F.struct(F.col("number").isNull().alias("none"), F.coalesce("number", F.lit(0)).alias("number"), "id")).alias("first"))
    if mode == "SEQUENCE":
        by = F.struct("grouped", "first", "unit")
    else:
        by = F.struct("late", F.sha2(F.concat(F.lit(f"{seed}-"), "unit"), 256), "unit")
    units = units.withColumn("by", by)
    if start is not None:
        begin = rows.filter(F.col("id") == start).select("unit").join(units, "unit").agg(F.max("by")).scalar()
        units = units.filter(F.col("by") >= begin)
    # Every unit has a question, so count units are enough: what is ordered in one place is bounded.
    some = units.orderBy("by").limit(count) if count and count > 0 else units
    before = F.sum("size").over(Window.orderBy("by").rowsBetween(Window.unboundedPreceding, -1))
    chosen = some.withColumn("before", F.coalesce(before, F.lit(0)))
    if count and count > 0:
        chosen = F.broadcast(chosen.filter(F.col("before") < count))
    inside = Window.partitionBy("unit").orderBy(F.asc_nulls_last("number"), "id")
    return rows.select("id", "unit", "number").join(chosen.select("unit", "before"), "unit").select("id", (F.col("before") + F.row_number().over(inside)).alias("place"))


def report(session_questions: DataFrame, questions: DataFrame, records: DataFrame) -> DataFrame:
    """Per session: questions, answered, correct, earned, most, rate."""
    last = records.groupBy("session_id", "question_id").agg(F.max_by(F.struct("grade", "self_score"), F.struct("answered_at", "id")).alias("r"))
    rows = session_questions.join(questions.select(F.col("id").alias("question_id"), "score"), "question_id").join(last, ["session_id", "question_id"], "left")
    earned = rules.earned_score(F.col("score"), F.col("r.grade"), F.col("r.self_score"))
    return rows.groupBy("session_id").agg(
        F.count("*").alias("questions"),
        F.count("r").alias("answered"),
        F.count_if(rules.is_right(F.col("r.grade"))).alias("correct"),
        F.count_if(rules.is_wrong(F.col("r.grade"))).alias("wrong"),
        F.round(F.sum(F.when(F.col("r").isNotNull(), earned).otherwise(0.0)), 4).alias("earned"),
        F.round(F.sum("score"), 4).alias("most"),
    )


def seconds_per_question(records: DataFrame, sessions: DataFrame) -> DataFrame:
    """Recorded seconds, or those since the answer before (the session's start first)."""
    order = Window.partitionBy("session_id").orderBy("answered_at", "id")
    rows = records.join(sessions, "session_id")
    since = F.coalesce(F.lag("answered_at").over(order), F.col("created_at"))
    gap = F.greatest(F.lit(0), F.timestamp_diff("SECOND", since, "answered_at"))
    return rows.select("session_id", "id", F.coalesce("seconds", gap).alias("seconds"))


def contains(session_questions: DataFrame, asked: DataFrame, parts: int | None = None) -> DataFrame:
    """session_id, question_id, known: whether a session holds a question; each asked pair once, a null key is never known.

    Both sides meet in one grouping by the pair, in ``parts`` tasks if given.
    """
    pair = ["session_id", "question_id"]
    rows = session_questions.select(*pair, F.lit(True).alias("_own")).unionByName(asked.select(*pair, F.lit(False).alias("_own")))
    if parts:
        rows = rows.repartition(parts, *pair)
    met = rows.groupBy(*pair).agg(F.max("_own").alias("_own"), F.min("_own").alias("_only"))
    known = F.col("_own") & F.col("session_id").isNotNull() & F.col("question_id").isNotNull()
    return met.filter("NOT _only").select(*pair, known.alias("known"))


def submit(answers: DataFrame, questions: DataFrame, sessions_: DataFrame, session_questions: DataFrame) -> DataFrame:
    """A batch of answers (answer_id, session_id, question_id, selected_keys, user_answer) judged.

    answer_id, bank_id, question_id, session_id, is_correct (null: undecided), error.  An answer
    outside a session has a null session_id.  ``sessions_``: session_id, bank_id, finished.
    """
    q = questions.select(F.col("id").alias("question_id"), "bank_id", "question_type", "answer_keys")
    s = sessions_.select("session_id", F.col("bank_id").alias("_bank"), "finished")
    own = session_questions.select("session_id", "question_id").distinct().withColumn("_own", F.lit(True))
    rows = answers.join(q, "question_id", "left").join(s, "session_id", "left").join(own, ["session_id", "question_id"], "left")
    inside, subjective = F.col("session_id").isNotNull(), F.col("question_type") == "SUBJECTIVE"
    error = (
        F.when(F.col("bank_id").isNull(), "NO_QUESTION")
        .when(inside & F.col("_bank").isNull(), "NO_SESSION")
        .when(inside & (F.col("_bank") != F.col("bank_id")), "OTHER_BANK")
        .when(inside & F.col("finished"), "FINISHED")
        .when(inside & F.col("_own").isNull(), "NOT_IN_SESSION")
        .when(subjective & (F.trim(F.coalesce("user_answer", F.lit(""))) == ""), "NO_TEXT")
        .when(~subjective & (F.size(rules.key_set(F.col("selected_keys"))) == 0), "NO_SELECTION")
    )
    right = rules.answered_right(F.col("question_type"), F.col("answer_keys"), F.col("selected_keys"))
    return rows.withColumn("error", error).select("answer_id", "bank_id", "question_id", "session_id", F.when(F.col("error").isNull(), right).alias("is_correct"), "error")


def stepped_states(states: DataFrame, judged: DataFrame, at: datetime) -> DataFrame:
    """States after a batch of judged answers, one for a question at most; undecided ones don't step."""
    decided = judged.filter("error IS NULL AND is_correct IS NOT NULL").select("question_id", F.col("bank_id").alias("_bank"), F.col("is_correct").alias("_right"))
    rows = states.join(decided, "question_id", "full")
    new = F.col("_right").isNotNull()
    level = rules.next_level(F.coalesce("level", F.lit(0)), F.col("_right"))
    days = rules.interval_days(level)
    due = F.when(F.col("_right"), F.lit(at).cast("timestamp_ntz") + F.make_dt_interval(days)).otherwise(F.lit(at).cast("timestamp_ntz"))
    return rows.select(
        "question_id",
        F.coalesce("bank_id", "_bank").alias("bank_id"),
        F.when(new, level).otherwise(F.col("level")).alias("level"),
        F.when(new, days).otherwise(F.col("interval_days")).alias("interval_days"),
        F.when(new, due).otherwise(F.col("due_at")).alias("due_at"),
    )


def scopes(asked: DataFrame) -> DataFrame:
    """session_id with its topics and categories joined by commas, null without any."""
    return asked.select("session_id", *[F.when(F.size(c) > 0, F.array_join(c, ",")).alias(f"scope_{c}") for c in ("topics", "categories")])


def review_by_node(records: DataFrame, tags: DataFrame, log: DataFrame) -> DataFrame:
    """session_id, node_id, wrong, rate: wrong answers of sessions by node, most first, with the
    percentage right of all decided answers on the node's questions (-1 without any)."""
    wrong = records.filter(rules.is_wrong(F.col("grade"))).join(tags.select("question_id", "node_id").distinct(), "question_id").groupBy("session_id", "node_id").agg(F.count("*").alias("wrong"))
    per = log.groupBy("question_id").agg(F.count("grade").alias("n"), F.count_if(rules.is_right(F.col("grade"))).alias("ok"))
    node = tags.select("question_id", "node_id").distinct().join(per, "question_id").groupBy("node_id").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"))
    rate = F.when(F.col("n") > 0, F.floor(F.col("ok") * 100 / F.col("n") + 0.5)).otherwise(F.lit(-1)).cast("long")
    return wrong.join(node, "node_id", "left").select("session_id", "node_id", "wrong", F.coalesce(rate, F.lit(-1).cast("long")).alias("rate"))


def review_totals(records: DataFrame) -> DataFrame:
    """session_id, total, correct, wrong, undecided."""
    right, wrong = (F.count_if(f(F.col("grade"))) for f in (rules.is_right, rules.is_wrong))
    n = records.groupBy("session_id").agg(F.count("*").alias("total"), right.alias("correct"), wrong.alias("wrong"))
    return n.withColumn("undecided", F.col("total") - F.col("correct") - F.col("wrong"))
