"""What must not grow faster than the input: work done once, by all cores, in tasks of bounded size."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from studylake.functions import exam as M
from studylake.operators import exams as E
from studylake.operators import layout as L
from studylake.operators import sessions as S
from studylake.plans import registry
from studylake.sources import bindings as B
from studylake.sources import streams


def _optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_directory_is_read_once_for_many_entries(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(400):
            z.writestr(f"entry{i}", str(i))
    wanted = spark.createDataFrame([(f"file://{path}", f"entry{i}") for i in range(400)], "path string, name string")
    got = streams.read_entries(wanted).collect()
    assert {r["name"]: bytes(r["content"]).decode() for r in got} == {f"entry{i}": str(i) for i in range(400)}
    tasks, whole = 2 * spark.sparkContext.defaultParallelism, path.stat().st_size
    assert sum(r["bytes_read"] for r in got) < (tasks + 2) * whole


#: Queries of much work on each row of a small file.
DEALT = ["lost_numbers", "panel_cuts", "answer_lists", "trimmed_chunks", "image_quota_ranges", "decoded_replies", "reply_questions"]


@pytest.mark.parametrize("name", DEALT)
def test_rows_are_dealt_over_all_cores(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_numbers_of_a_text_are_listed_once(spark):
    rows = spark.createDataFrame([("a", "b")], "source string, parsed string")
    assert _optimised(rows.select(M.lost_numbers(F.col("source"), F.col("parsed")))).count("split(") <= 4  # a plan's text names an array's source twice


def test_an_answer_list_is_read_once(spark):
    """Headings looked for once in a plan, a token's kind found once in a step of the walk."""
    plan = _optimised(spark.createDataFrame([("a",)], "text string").select(M.is_answer_list(F.col("text"))))
    assert plan.count("正确答案：") <= 2  # a plan's text names an array's source twice
    codes = _optimised(spark.createDataFrame([("a",)], "text string").select(M.G.compact_codes(F.col("text"))))
    assert codes.count(r"^\d{1,3}$") <= 4  # in the walk and among the tokens, each named twice


def test_compact_texts_of_every_character(spark):
    """A text of codes with one more character: only white space, marks and the codes' own may stand there."""
    texts = [f"1.A 2.B{c} 3.CD" for c in " \n\t,，、;；AH√×对错.．:：)）()xI-【】9\u2028\u0085\u00a0"] + ["1.A 2.B 3.CD\n", "答案：1.A 2.B 3.CD", " 1 A\n2、B;3) C ", "x1.A 2.B 3.C", "", None]
    got = {r["text"]: r["codes"] and [tuple(c) for c in r["codes"]] for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", M.G.compact_codes(F.col("text")).alias("codes")).collect()}
    abc, cd = [(1, "A"), (2, "B"), (3, "C")], [(1, "A"), (2, "B"), (3, "CD")]
    want = {f"1.A 2.B{c} 3.CD": cd for c in " \n\t,，、;；"} | {f"1.A 2.B{c} 3.CD": [(1, "A"), (2, f"B{c}"), (3, "CD")] for c in "AH√×对错"}
    want |= {"1.A 2.B 3.CD\n": cd, "答案：1.A 2.B 3.CD": cd, " 1 A\n2、B;3) C ": abc}
    assert got == {t: want.get(t) for t in texts}


def test_ink_is_computed_once(spark):
    rows = spark.createDataFrame([([1],)], "raw array<int>")
    assert _optimised(rows.select(L.column_cuts(F.transform("raw", lambda x: x + 1717), F.lit(60)))).count("1717") <= 2


def test_replies_are_decoded_once_before_their_questions(spark):
    rows = spark.createDataFrame([(1, "[]")], "id int, reply string")
    plan = _optimised(E.reply_questions(E.decode(rows, "id"), "id"))
    assert plan.count("+- Filter") == 1  # that on content


def test_a_reply_is_searched_for_its_fence_once(spark):
    rows = spark.createDataFrame([(1, "[]")], "id int, reply string")
    assert _optimised(E.decode(rows, "id")).count("(?:json)") <= 2  # asked for and taken


def test_membership_of_repeats_and_nulls(spark):
    own = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 3)], "session_id int, question_id int")
    asked = spark.createDataFrame([(1, 1), (1, 1), (1, 3), (None, 3)], "session_id int, question_id int")
    got = {tuple(r) for r in S.contains(own, asked, 3).collect()}
    assert got == {(1, 1, True), (1, 3, False), (None, 3, False)}


def test_membership_tasks_follow_the_rows(spark, sf_dir, monkeypatch):
    assert B.parts(spark.range(1000), 10) == 100
    monkeypatch.setattr(B, "parts", lambda _: 37)
    assert registry.QUERIES["session_membership"](spark, sf_dir).rdd.getNumPartitions() == 37
