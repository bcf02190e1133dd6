"""Skill graphs, tags of questions, coverage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def nodes_of(templates: DataFrame) -> DataFrame:
    """One row per node of nested templates."""
    stage = templates.select("templateId", "version", F.explode("stages").alias("s"))
    return stage.select("templateId", F.col("s.id").alias("stage_id"), F.explode("s.nodes").alias("n")).select("templateId", "stage_id", F.col("n.id").alias("node_id"), F.col("n.name").alias("name"), F.col("n.level").alias("level"), F.col("n.prereq").alias("prereq"))


def edges_of(nodes: DataFrame) -> DataFrame:
    """node_id, prereq: one row per prerequisite."""
    return nodes.select("node_id", F.explode("prereq").alias("prereq"))


def closure(edges: DataFrame, depth: int = 20) -> DataFrame:
    """node_id, ancestor, distance: all prerequisites, shortest way, up to a depth.

    Frontier by frontier, each met with what is known; graphs are catalogues
    (a template), far smaller than the log, and each round's known pairs are
    kept in memory until the next has them.
    """
    known = edges.select("node_id", F.col("prereq").alias("ancestor"), F.lit(1).alias("distance")).distinct().cache()
    frontier, held = known, [known]
    for step in range(2, depth + 1):
        more = frontier.select("node_id", F.col("ancestor").alias("node")).join(edges.select(F.col("node_id").alias("node"), F.col("prereq").alias("ancestor")), "node").select("node_id", "ancestor").distinct()
        frontier = more.join(known, ["node_id", "ancestor"], "left_anti").withColumn("distance", F.lit(step)).cache()
        held.append(frontier)
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    # The pairs of a catalogue: written into a plan of their own, so that no round stays cached.
    rows, schema = known.collect(), known.schema
    for df in held:
        df.unpersist()
    return edges.sparkSession.createDataFrame(rows, schema)


def graph_errors(nodes: DataFrame, edges: DataFrame, depth: int = 20) -> DataFrame:
    """error, node_id: duplicate ids, dangling prerequisites, nodes on a cycle."""
    twice = nodes.groupBy("node_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("DUPLICATE").alias("error"), "node_id")
    dangling = edges.join(nodes.select(F.col("node_id").alias("prereq")), "prereq", "left_anti").select(F.lit("DANGLING").alias("error"), "node_id").distinct()
    cycle = closure(edges, depth).filter(F.col("node_id") == F.col("ancestor")).select(F.lit("CYCLE").alias("error"), "node_id")
    return twice.unionByName(dangling).unionByName(cycle)


def graph_version(version, text):
    """Version and the first four bytes of the text's SHA-256."""
    return F.concat(version, F.lit("-"), F.substring(F.sha2(text, 256), 1, 8))


def customise(nodes: DataFrame, added: DataFrame, disabled: DataFrame) -> DataFrame:
    """Official nodes with added ones (same id: renamed), less disabled ones; their prerequisites too."""
    base = nodes.join(added.select("node_id"), "node_id", "left_anti").unionByName(added, allowMissingColumns=True)
    off = disabled.agg(F.collect_set("node_id")).scalar()
    live = base.withColumn("off", off).withColumn("prereq", F.array_except("prereq", "off"))
    return live.filter(~F.array_contains("off", F.col("node_id"))).drop("off")


def tag_state(questions: DataFrame, tags: DataFrame) -> DataFrame:
    """question_id, state: CONFIRMED, SUGGESTED (by a model) or UNTAGGED."""
    per = tags.groupBy("question_id").agg(F.bool_or("confirmed").alias("c"), F.bool_or(F.col("source") == "ai").alias("a"))
    state = F.when(F.col("c"), "CONFIRMED").when(F.col("a"), "SUGGESTED").otherwise("UNTAGGED")
    return questions.select("question_id").join(per, "question_id", "left").select("question_id", state.alias("state"))


def coverage(questions: DataFrame, tags: DataFrame) -> DataFrame:
    """Questions in each state, and how many are usable (any tag that counts)."""
    s = tag_state(questions, tags)
    return s.agg(F.count("*").alias("total"), *[F.count_if(F.col("state") == x).alias(x.lower()) for x in ("CONFIRMED", "SUGGESTED", "UNTAGGED")], F.count_if(F.col("state") != "UNTAGGED").alias("usable"))


def node_coverage(nodes: DataFrame, tags: DataFrame, enough: int = 3) -> DataFrame:
    """Every node with its questions and whether they are enough evidence."""
    per = tags.groupBy("node_id").agg(F.countDistinct("question_id").alias("questions"))
    rows = nodes.select("node_id").join(per, "node_id", "left").withColumn("questions", F.coalesce("questions", F.lit(0)))
    return rows.withColumn("enough", F.col("questions") >= enough)


def orphans(nodes: DataFrame, tags: DataFrame) -> DataFrame:
    """Tags of nodes that the graph lacks: rows and questions."""
    lost = tags.join(nodes.select("node_id"), "node_id", "left_anti")
    return lost.agg(F.count("*").alias("tags"), F.countDistinct("question_id").alias("questions"))


def upsert(tags: DataFrame, found: DataFrame) -> DataFrame:
    """Tags after new findings: a human's row wins, the higher confidence stays,
    model rows of a found question that weren't found again go."""
    keys = ["question_id", "node_id"]
    new = found.select(*keys, F.col("confidence").alias("c2"), F.lit(True).alias("new"))
    seen = found.select("question_id").distinct().withColumn("asked", F.lit(True))
    both = tags.join(new, keys, "full").join(seen, "question_id", "left")
    human = F.coalesce(F.col("source") == "human", F.lit(False))
    keep = human | F.coalesce("new", F.lit(False)) | F.coalesce("asked", F.lit(False)).eqNullSafe(False)
    return both.filter(keep).select(*keys, F.when(F.col("source").isNull(), "ai").otherwise(F.col("source")).alias("source"), F.greatest("confidence", "c2").alias("confidence"), F.coalesce("confirmed", F.lit(False)).alias("confirmed"))


def customisation(nodes: DataFrame, added: DataFrame, disabled: DataFrame) -> DataFrame:
    """node_id, name, official_name, kind: OFFICIAL, RENAMED, ADDED or DISABLED, of a customised template."""
    own = added.select("node_id", F.col("name").alias("_own"))
    off = disabled.select("node_id").distinct().withColumn("_off", F.lit(True))
    rows = nodes.select("node_id", F.col("name").alias("official_name")).join(own, "node_id", "full").join(off, "node_id", "left")
    kind = F.when(F.col("_off"), "DISABLED").when(F.col("official_name").isNull(), "ADDED").when(F.col("_own").isNotNull() & (F.col("_own") != F.col("official_name")), "RENAMED").otherwise("OFFICIAL")
    return rows.select("node_id", F.coalesce("_own", "official_name").alias("name"), "official_name", kind.alias("kind"))


def reset(added: DataFrame, disabled: DataFrame, node_ids: list) -> tuple[DataFrame, DataFrame]:
    """The overrides (added, disabled) without those of some nodes."""
    return added.filter(~F.col("node_id").isin(node_ids)), disabled.filter(~F.col("node_id").isin(node_ids))


def template_sizes(nodes: DataFrame) -> DataFrame:
    """Stages and nodes of each template, from one row per node."""
    return nodes.groupBy("templateId").agg(F.countDistinct("stage_id").alias("stages"), F.count("*").alias("nodes"))


def catalogue(nodes: DataFrame) -> DataFrame:
    """stage, text: a stage's nodes, "id name" a line, by id."""
    line = F.array_sort(F.collect_list(F.concat_ws(" ", "node_id", "name")))
    return nodes.groupBy("stage").agg(F.array_join(line, "\n").alias("text"))


def tags_of(questions: DataFrame, tags: DataFrame, nodes: DataFrame) -> DataFrame:
    """question_id, tags: of each question those whose node exists, by node id."""
    live = tags.join(questions.select("question_id"), "question_id", "left_semi").join(nodes.select("node_id", "name"), "node_id")
    one = F.struct("node_id", "name", "source", "confidence", "confirmed")
    return live.groupBy("question_id").agg(F.array_sort(F.collect_list(one)).alias("tags"))


def matching(questions: DataFrame, tags: DataFrame, status: str | None = None, node_id: str | None = None) -> DataFrame:
    """question_id, state: questions in a state (null: any) that stand under a node (null: any)."""
    rows = tag_state(questions, tags)
    if status:
        rows = rows.filter(F.col("state") == status)
    if node_id:
        rows = rows.join(tags.filter(F.col("node_id") == node_id).select("question_id"), "question_id", "left_semi")
    return rows


def set_tags(tags: DataFrame, questions: DataFrame, node_ids: list, nodes: DataFrame) -> DataFrame:
    """Tags after a user set those of some questions: a model's and the user's former ones go, the author's stay."""
    known = nodes.filter(F.col("node_id").isin(node_ids or [])).agg(F.collect_set("node_id")).scalar()
    chosen = questions.select("question_id").distinct()
    mine = F.col("source").isin("ai", "user")
    rest = tags.join(chosen.withColumn("_hit", F.lit(True)), "question_id", "left").filter(~(F.coalesce("_hit", F.lit(False)) & mine)).drop("_hit")
    # A short list of nodes for each question.
    new = chosen.withColumn("n", known).select("question_id", F.explode("n").alias("node_id"))
    return rest.unionByName(new.select("question_id", "node_id", F.lit("user").alias("source"), F.lit(1.0).alias("confidence"), F.lit(True).alias("confirmed")))


def apply(action: str, tags: DataFrame, nodes: DataFrame, questions: DataFrame | None = None, node_id: str | None = None, new_nodes: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(tags after an action, question_id of the affected): confirm, reject, set or retag.

    ``questions`` is the scope; without it ``node_id`` is.  confirm and reject
    touch a model's unconfirmed suggestions only; retag without questions takes
    those that the model put under the node; set without questions does nothing.
    """
    ai = F.col("source") == "ai"
    inside = F.lit(True) if questions is not None or not node_id else F.col("node_id") == node_id
    if action in ("set", "retag"):
        if questions is None:
            questions = tags.filter(ai & inside & F.lit(action == "retag")).select("question_id").distinct()
        affected = questions.select("question_id").distinct()
        return set_tags(tags, affected, new_nodes or [], nodes), affected
    if action not in ("confirm", "reject"):
        raise ValueError("action is confirm, reject, set or retag")
    rows = tags.withColumn("_hit", F.coalesce(ai & ~F.coalesce("confirmed", F.lit(False)) & inside, F.lit(False)))
    if questions is not None:
        scope = questions.select("question_id").distinct().withColumn("_in", F.lit(True))
        rows = rows.join(scope, "question_id", "left").withColumn("_hit", F.col("_hit") & F.coalesce("_in", F.lit(False))).drop("_in")
    affected = rows.filter("_hit").select("question_id").distinct()
    after = rows.filter("NOT _hit") if action == "reject" else rows.withColumn("confirmed", F.col("confirmed") | F.col("_hit"))
    return after.select(*tags.columns), affected


# --- nodes of groups, kept between runs -------------------------------------------------------------------

GROUP_NODES = "key string, version string, fingerprint string, nodes array<struct<node_id:string,confidence:double>>, run int"


def fingerprints(questions: DataFrame, *of: str) -> DataFrame:
    """key, fingerprint: a group's number of questions and the sum of their digests, whatever their order."""
    part = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in of]).cast("decimal(38,0)")
    return questions.filter("key IS NOT NULL").groupBy("key").agg(F.concat_ws("-", F.count("*"), F.sum(part)).alias("fingerprint"))


def kept_nodes(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The newest row of each group and version in the runs' table (those before a run)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], GROUP_NODES)
    rows = spark.read.schema(GROUP_NODES).parquet(path)
    rows = rows.filter(F.col("run") < before) if before is not None else rows
    return rows.groupBy("key", "version").agg(F.max_by(F.struct("fingerprint", "nodes", "run"), "run").alias("r")).select("key", "version", "r.*")


def refresh_nodes(questions: DataFrame, path: str, run: int, version: str, find: Callable[[DataFrame], DataFrame], *of: str) -> DataFrame:
    """key, nodes, run of each group of the questions (key, ...), read from the table at ``path`` where it holds them.

    A group is stale if the table has no row of this graph's version with the
    group's fingerprint over the columns ``of``.  ``find`` (questions of stale
    groups -> key, node_id, confidence) is called for those alone; what it says
    is appended as run ``run``, a group that it passes over with no nodes.
    Runs are numbered upward; a run that is repeated replaces its own rows, so
    one that was broken off can be repeated.
    """
    spark = questions.sparkSession
    groups = fingerprints(questions, *of)
    held = kept_nodes(spark, path, run).filter(F.col("version") == version)
    stale = groups.join(held.select("key", "fingerprint"), ["key", "fingerprint"], "left_anti")
    found = find(questions.join(stale.select("key"), "key", "left_semi")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("node_id", F.col("confidence").cast("double").alias("confidence")))).alias("nodes"))
    none = F.array().cast("array<struct<node_id:string,confidence:double>>")
    rows = stale.join(found, "key", "left").select("key", F.lit(version).alias("version"), "fingerprint", F.coalesce("nodes", none).alias("nodes"))
    rows.write.mode("overwrite").parquet(f"{path}/run={run}")
    now = kept_nodes(spark, path, run + 1).filter(F.col("version") == version)
    return groups.join(now, ["key", "fingerprint"]).select("key", "nodes", "run")


def inherited_tags(questions: DataFrame, nodes: DataFrame, tags: DataFrame) -> DataFrame:
    """question_id, node_id, confidence: questions (question_id, key) take their group's nodes, those that a person tagged none."""
    human = tags.filter("source = 'human'").select("question_id").distinct()
    return questions.join(human, "question_id", "left_anti").join(nodes, "key").select("question_id", F.explode("nodes").alias("n")).select("question_id", "n.*")
