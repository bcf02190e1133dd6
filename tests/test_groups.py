"""Nodes of groups kept between runs; formulas left as images."""

from __future__ import annotations

from pyspark.sql import functions as F

from studylake.operators import exams, skills


def asked(seen, more=0):
    """A finder that notes which groups it is asked for; group c has no nodes."""

    def find(rows):
        seen.append(sorted(r["key"] for r in rows.select("key").distinct().collect()))
        return rows.filter("key <> 'c'").groupBy("key").agg((F.min("id") + more).cast("string").alias("node_id"), F.lit(0.5).alias("confidence"))

    return find


def questions(spark, rows):
    return spark.createDataFrame(rows, "id long, key string, content string")


def told(df):
    return {r["key"]: (r["run"], [n["node_id"] for n in r["nodes"]]) for r in df.collect()}


def test_only_stale_groups_are_asked(spark, tmp_path):
    path, seen = f"file://{tmp_path}/nodes", []
    rows = [(1, "a", "x"), (2, "a", "y"), (3, "b", "z"), (4, "c", None), (5, None, "lost")]
    first = told(skills.refresh_nodes(questions(spark, rows), path, 1, "v1", asked(seen), "id", "content"))
    assert first == {"a": (1, ["1"]), "b": (1, ["3"]), "c": (1, [])}
    # Another order changes nothing; a group without nodes isn't asked again.
    assert told(skills.refresh_nodes(questions(spark, rows[::-1]), path, 2, "v1", asked(seen, 10), "id", "content")) == first
    changed = questions(spark, [*rows[:2], (3, "b", "new"), rows[3], (6, "d", "d"), (6, "d", "d")])
    third = told(skills.refresh_nodes(changed, path, 3, "v1", asked(seen, 10), "id", "content"))
    assert third == first | {"b": (3, ["13"]), "d": (3, ["16"])}
    # A repeated run replaces its own rows; a new version of the graph makes all stale.
    assert told(skills.refresh_nodes(changed, path, 3, "v1", asked(seen, 20), "id", "content")) == first | {"b": (3, ["23"]), "d": (3, ["26"])}
    assert {v[0] for v in told(skills.refresh_nodes(changed, path, 4, "v2", asked(seen), "id", "content")).values()} == {4}
    assert seen == [["a", "b", "c"], [], ["b", "d"], ["b", "d"], ["a", "b", "c", "d"]]


def test_people_tag_before_groups(spark):
    nodes = spark.createDataFrame([("a", [("n", 0.5), ("m", 0.2)]), ("c", [])], "key string, nodes array<struct<node_id:string,confidence:double>>")
    asked_ = spark.createDataFrame([(1, "a"), (2, "a"), (3, "c"), (4, None)], "question_id long, key string")
    tags = spark.createDataFrame([(2, "human"), (1, "ai")], "question_id long, source string")
    assert sorted(map(tuple, skills.inherited_tags(asked_, nodes, tags).collect())) == [(1, "m", 0.2), (1, "n", 0.5)]


def test_leftover_formulas(spark):
    option = "array<struct<key:string,text:string>>"
    rows = spark.createDataFrame(
        [(1, 1, " [图片5] ", None, None, None), (1, 2, "see\n [图片5]\t" + "w" * 200, [("A", "[图片6]"), ("B", None)], None, "[图片9][图片9]"), (1, 3, None, None, "[图片8]", None), (2, 1, "other [图片5]", None, None, None)],
        f"doc int, position int, content string, options {option}, reference string, answer_text string",
    )
    materials = spark.createDataFrame([(1, 1, "about [图片8] it"), (1, 2, None)], "doc int, position int, content string")
    formulas = spark.createDataFrame([(1, n) for n in (5, 6, 7, 8, 8)], "doc int, number long")
    got = {tuple(r)[:2]: tuple(r)[2:] for r in exams.leftover_formulas(rows, materials, formulas, "doc").collect()}
    around = ("see   " + "w" * 200)[:120]
    assert got == {(1, 5): (around, 2), (1, 6): (around, 1), (1, 8): ("about   it", 2)}
    assert exams.leftover_formulas(rows.limit(0), materials.limit(0), formulas, "doc").count() == 0


def test_delimiters_in_every_field(spark):
    rows = spark.createDataFrame([(r"\(x\)", [("A", r"\[y\]"), ("B", None)], None)], "content string, options array<struct<key:string,text:string>>, analysis string")
    row = exams.plain_delimiters(rows, "content", "analysis").first()
    assert (row["content"], [o["text"] for o in row["options"]], row["analysis"]) == ("$x$", ["$$y$$", None], None)
