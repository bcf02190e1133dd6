"""Mastery of topics and the practice plan."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studylake.functions import rules
from studylake.operators import attempts
from studylake.sources import files


def mastery(log: DataFrame, tags: DataFrame, as_of: datetime, *more: str) -> DataFrame:
    """node_id, questions, attempts, correct, mastery from the last eight answers.

    An answer weighs 1, the last three 1.5; a right one counts by its age
    (exp(-days/30)) and a fifth more after seven days.  Only the last eight
    answers of each question can be among a node's last eight, so they alone
    are tagged and meet by node.
    """
    flag = F.coalesce(F.col("is_correct"), F.lit(False))
    keys = ["answered_at", "id", *more]
    newest = Window.partitionBy("question_id").orderBy(*[F.desc(k) for k in keys])
    recent = log.withColumn("n", F.row_number().over(newest)).filter("n <= 8").select("question_id", *keys, flag.alias("ok"))
    node = Window.partitionBy("node_id").orderBy(*[F.desc(k) for k in keys], F.desc("question_id"))
    last = recent.join(tags.select("question_id", "node_id"), "question_id").withColumn("n", F.row_number().over(node)).filter("n <= 8")
    days = F.greatest(F.lit(0), F.floor(F.timestamp_diff("SECOND", "answered_at", F.lit(as_of)) / 86400))
    weight = F.when(F.col("n") <= 3, 1.5).otherwise(1.0)
    worth = F.when(F.col("ok"), F.exp(-days / 30.0) * F.when(days >= 7, 1.2).otherwise(1.0) * weight).otherwise(0.0)
    score = last.groupBy("node_id").agg((F.sum(worth) / F.sum(weight)).alias("m"))
    per = log.groupBy("question_id").agg(F.count("*").alias("n"), F.count_if(flag).alias("ok"))
    size = tags.join(per, "question_id", "left").groupBy("node_id").agg(F.countDistinct("question_id").alias("questions"), F.coalesce(F.sum("n"), F.lit(0)).alias("attempts"), F.coalesce(F.sum("ok"), F.lit(0)).alias("correct"))
    return size.join(score, "node_id", "left").select("node_id", "questions", "attempts", "correct", rules.round_half_up(F.coalesce("m", F.lit(0.0)), 3).alias("mastery"))


def weakest(nodes: DataFrame, unseen: DataFrame) -> DataFrame:
    """The node of least mastery that still has unseen questions; of equals the one with fewer questions."""
    live = nodes.join(unseen.select("node_id").distinct(), "node_id", "left_semi")
    return live.agg(F.min_by(F.struct("node_id", "questions"), F.struct("mastery", "questions", "node_id")).alias("n")).filter("n IS NOT NULL").select("n.*")


DEFAULT_COUNT, MOST = 20, 200


def wanted(count: int | None) -> int:
    """Places of a plan: 20 unless a positive number is asked for, 200 at most."""
    return DEFAULT_COUNT if count is None or count <= 0 else min(count, MOST)


def quotas(count: int) -> tuple[int, int, int]:
    """Wrong, due and weak places: 30 % each, one at least while places last."""
    return tuple(max(int(count * 0.3), 1 if count >= n else 0) for n in (1, 2, 3))


def current_difficulty(questions: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``questions`` with difficulty: the stored rating, else that of type and score."""
    first = rules.initial_difficulty(F.col("question_type"), F.col("score"))
    if stored is None:
        return questions.withColumn("difficulty", first)
    known = stored.select(F.col("question_id").alias("id"), F.col("difficulty").alias("_stored"))
    return questions.join(known, "id", "left").withColumn("difficulty", F.coalesce("_stored", first)).drop("_stored")


def question_mastery(tags: DataFrame, nodes: DataFrame) -> DataFrame:
    """question_id, mastery (the best of its nodes, 0.5 at least) and its first node."""
    per = tags.select("question_id", "node_id").join(nodes.select("node_id", "mastery"), "node_id", "left")
    return per.groupBy("question_id").agg(F.greatest(F.lit(0.5), F.max(F.coalesce("mastery", F.lit(0.5)))).alias("mastery"), F.min("node_id").alias("node_id"))


def by_target_success(candidates: DataFrame, rated: DataFrame) -> DataFrame:
    """question_id, rank: candidates (question_id, position) ordered for a success of 85 %.

    Questions of equal mastery are a group; groups come in the order of their
    first candidate, and inside a group the predicted success decides, then the
    position.  Mastery has three digits, so groups are a thousand at most.
    """
    rows = candidates.join(rated, "question_id")
    first = rows.groupBy("mastery").agg(F.min("position").alias("group_first"))
    p = rules.success(F.col("difficulty"), rules.ability(F.col("mastery")))
    ranked = rows.join(F.broadcast(first), "mastery").withColumn("target", F.round(rules.target_rank(p), 9))
    return ranked.select("question_id", F.struct("group_first", "target", "position").alias("rank"))


def plan(wrong: DataFrame, due: DataFrame, weak: DataFrame, new: DataFrame, stale: DataFrame, count: int | None = None) -> DataFrame:
    """reason, place, question_id: buckets in order, no question twice.

    Each bucket is (question_id, rank); a bucket takes its quota of what the
    ones before left, new questions and then the stalest fill the rest (both
    count as new).  A plan is a bounded list: of each bucket only the first
    places that it and those before it could fill are read (600 rows at most),
    all in one job, and dealt here.
    """
    spark, want = wrong.sparkSession, wanted(count)
    sizes = [*quotas(want), want, want]
    parts = []
    for n, (bucket, size) in enumerate(zip((wrong, due, weak, new, stale), sizes, strict=True)):
        rows = bucket.groupBy("question_id").agg(F.min("rank").alias("rank")).orderBy("rank", "question_id").limit(size + want)
        parts.append(rows.select(F.lit(n).alias("bucket"), F.row_number().over(Window.orderBy("rank", "question_id")).alias("n"), "question_id"))
    found = sorted(tuple(r) for r in reduce(DataFrame.unionByName, parts).collect())
    picked = _dealt(found, want)
    kind = wrong.schema["question_id"].dataType.simpleString()
    return spark.createDataFrame([(reason, place, q) for place, (q, reason) in enumerate(picked.items(), 1)], f"reason string, place int, question_id {kind}")


def _dealt(found: list, want: int) -> dict:
    """Reasons of the picked questions in order; ``found`` holds (bucket, n, question, ...) in the order of bucket and n."""
    picked: dict = {}
    for n, (reason, size) in enumerate(zip(("WRONG", "DUE", "WEAK", "NEW", "NEW"), (*quotas(want), want, want), strict=True)):
        free = [r[2] for r in found if r[0] == n and r[2] not in picked]
        for q in free[: min(size, want - len(picked))]:
            picked[q] = reason
    return picked


def candidates(facts: DataFrame) -> DataFrame:
    """bucket, n, question_id, node_id: the questions of every bucket in its order, the first 400 (twice the longest plan).

    ``facts``: one row for each question (question_id, node_id, difficulty,
    mastery, number, last_at, times, and whether it is wrong, due, weak).  All
    buckets are cut from the same rows.  Wrong, due, weak and new questions go
    for a success of 85 % (see ``by_target_success``), the stalest by their
    last answer, those without one first.
    """
    number, none = F.coalesce("number", F.lit(-1)).cast("long"), F.lit(0).cast("long")
    place = lambda n, asks, first: F.when(asks, F.struct(F.lit(n).alias("bucket"), first.alias("first")))
    unseen = F.col("last_at").isNull()
    buckets = F.array(place(0, F.col("wrong"), -F.col("times")), place(1, F.col("due"), none), place(2, F.col("weak"), none), place(3, unseen, number), place(4, F.lit(True), number))
    rows = facts.select("question_id", "node_id", "difficulty", "mastery", "last_at", F.explode(F.filter(buckets, lambda b: b.isNotNull())).alias("b")).select("*", "b.*").drop("b")
    rows = rows.withColumn("position", F.struct("first", "question_id"))
    # Mastery has three digits and is 0.5 at least: some 2,000 groups at most.
    groups = rows.filter("bucket < 4").groupBy("bucket", "mastery").agg(F.min("position").alias("group_first"))
    target = F.round(rules.target_rank(rules.success(F.col("difficulty"), rules.ability(F.col("mastery")))), 9)
    aimed = F.struct(F.col("group_first.first").alias("a"), F.col("group_first.question_id").alias("b"), target.alias("target"), "position")
    stalest = F.struct(F.unix_micros(F.col("last_at").cast("timestamp")).alias("a"), F.lit(None).alias("b"), F.lit(0.0).alias("target"), "position")
    ranked = rows.join(F.broadcast(groups), ["bucket", "mastery"], "left").withColumn("rank", F.when(F.col("bucket") < 4, aimed).otherwise(stalest))
    # A bound on the number within a bucket is kept by every task before the shuffle.
    own = F.row_number().over(Window.partitionBy("bucket").orderBy("rank"))
    return ranked.withColumn("n", own).filter(F.col("n") <= 2 * MOST).select("bucket", "n", "question_id", "node_id")


def practice_plan(log: DataFrame, questions: DataFrame, tags: DataFrame, states: DataFrame, as_of: datetime, count: int | None = None, stored: DataFrame | None = None, review: bool = True) -> DataFrame:
    """The plan of one bank: reason, place, question_id, node_id.

    ``log``, ``questions``, ``tags`` and ``states`` hold that bank's rows; ``stored``
    are rated difficulties; without ``review`` no question is due.
    """
    tags = tags.join(questions.select(F.col("id").alias("question_id")), "question_id", "left_semi")
    nodes = mastery(log, tags, as_of)
    rated = current_difficulty(questions, stored).select(F.col("id").alias("question_id"), "difficulty", "number")
    rated = rated.join(question_mastery(tags, nodes), "question_id", "left").withColumn("mastery", F.coalesce("mastery", F.lit(0.5)))
    answered = log.groupBy("question_id").agg(F.max("answered_at").alias("last_at"), F.count_if(~F.coalesce("is_correct", F.lit(True))).alias("times"))
    untouched = tags.join(answered, "question_id", "left_anti")
    flag = lambda rows, name: rows.select("question_id").distinct().withColumn(name, F.lit(True))
    live = states.filter(F.lit(review) & ~F.coalesce("suspended", F.lit(False)) & (F.col("due_at") <= F.lit(as_of)))
    weak = untouched.join(F.broadcast(weakest(nodes, untouched).select("node_id")), "node_id")
    facts = rated.join(answered, "question_id", "left")
    for rows, name in ((attempts.wrong_questions(log), "wrong"), (live, "due"), (weak, "weak")):
        facts = facts.join(flag(rows, name), "question_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    # Read twice (order of groups, ranks), so written once.
    path = files.scratch(log.sparkSession, "plan")
    facts.write.parquet(path)
    found = sorted(map(tuple, candidates(files.read_table(log.sparkSession, path, facts.schema)).collect()), key=lambda r: r[:2])
    node_of, want = {r[2]: r[3] for r in found}, wanted(count)
    rows = [(reason, place, q, node_of[q]) for place, (q, reason) in enumerate(_dealt(found, want).items(), 1)]
    kind = rated.schema["question_id"].dataType.simpleString()
    return log.sparkSession.createDataFrame(rows, f"reason string, place int, question_id {kind}, node_id {tags.schema['node_id'].dataType.simpleString()}")


#: The sentence of a plan (fixed values).
SAYS = {"WRONG": " 题是你之前做错的", "DUE": " 题今天到期复习", "NEW": " 题你还没做过"}


def explanation(items: DataFrame, weak_node: DataFrame, bank_questions: int) -> DataFrame:
    """text: what a plan (reason) is made of; ``weak_node``: name and questions, at most one row."""
    n = items.groupBy().pivot("reason", ["WRONG", "DUE", "WEAK", "NEW"]).count().fillna(0)
    n = n.select("*", weak_node.agg(F.max("name")).scalar().alias("name"), weak_node.agg(F.max("questions")).scalar().alias("own"))
    part = {k: F.when(F.col(k) > 0, F.concat(F.col(k).cast("string"), F.lit(text))) for k, text in SAYS.items()}
    weak = F.when((F.col("WEAK") > 0) & F.col("name").isNotNull(), F.concat(F.col("WEAK").cast("string"), F.lit(" 题来自「"), "name", F.lit("」（这个知识点你库里只有 "), F.col("own").cast("string"), F.lit(" 题）")))
    body = F.concat_ws(" · ", part["WRONG"], part["DUE"], weak, part["NEW"])
    total = F.col("WRONG") + F.col("DUE") + F.col("WEAK") + F.col("NEW")
    text = F.concat(F.lit("这 "), total.cast("string"), F.lit(" 题："), F.when(body == "", "都是你练过的题").otherwise(body), F.lit(f"（题库共 {bank_questions} 题）"))
    return n.select(F.when(total == 0, "这个题库还没有可练的题").otherwise(text).alias("text"))
