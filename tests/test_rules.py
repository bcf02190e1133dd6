"""The rules on the small cases that fix their meaning."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from studylake.functions import rules
from studylake.functions import text as X
from studylake.operators import attempts, exchange, plan, review, sessions, skills, stats

NOW = datetime(2024, 3, 10, 12)
LOG = "id long, bank_id long, question_id long, is_correct boolean, self_grade string, self_score double, seconds long, session_id long, answered_at timestamp"


def log(spark, rows):
    made = spark.createDataFrame([(i, b, q, ok, grade, None, None, s, at) for i, b, q, ok, grade, s, at in rows], LOG).withColumn("answered_at", F.col("answered_at").cast("timestamp_ntz"))
    return made.withColumn("grade", rules.effective_grade(F.col("self_grade"), F.col("is_correct")))


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def at(day, hour=8):
    return datetime(2024, 3, day, hour)


@pytest.fixture(scope="module")
def mixed(spark):
    """Wrong, right, partial, self-graded wrong and undecided answers of one session."""
    return log(spark, [(1, 1, 1, False, None, 5, at(1)), (2, 1, 2, True, None, 5, at(2)), (3, 1, 3, True, "PARTIAL", 5, at(3)), (4, 1, 4, None, "WRONG", 5, at(4)), (5, 1, 5, None, None, 5, at(5))]).cache()


def test_one_rule_for_every_consumer(spark, mixed):
    assert values(attempts.wrong_questions(mixed), "question_id") == [(1,), (3,), (4,)]
    assert values(stats.totals(mixed), "answered", "decided", "correct") == [(5, 4, 1)]
    questions = spark.createDataFrame([(q, 2.0) for q in range(1, 6)], "id long, score double")
    asked = questions.select(F.lit(5).cast("long").alias("session_id"), F.col("id").alias("question_id"))
    assert values(sessions.report(asked, questions, mixed), "questions", "answered", "correct", "wrong", "earned", "most") == [(5, 5, 1, 3, 3.0, 10.0)]


def test_ties_go_to_the_higher_id(spark):
    rows = log(spark, [(1, 1, 1, False, None, 1, at(1)), (2, 1, 1, True, None, 1, at(1))])
    assert values(attempts.wrong_questions(rows), "question_id") == []
    assert values(attempts.healed(rows), "question_id", "wrong_times") == [(1, 1)]


def test_month_end_leaves_the_last_fraction_out(spark):
    late = datetime(2024, 1, 31, 23, 59, 59, 500_000)
    rows = log(spark, [(1, 1, 1, False, None, 1, late), (2, 1, 2, False, None, 1, datetime(2024, 1, 31, 23, 59, 59))])
    got = {str(r[0]): r[1] for r in attempts.month_snapshots(rows, NOW, 3).collect()}
    assert got == {"2024-01-31": 1, "2024-02-29": 2, "2024-03-31": 2}


def test_streaks(spark):
    rows = log(spark, [(i, 1, 1, True, None, 1, at(d)) for i, d in enumerate([1, 2, 3, 5, 8, 9])])
    assert values(stats.streaks(rows, NOW.date()), "longest", "current") == [(3, 2)]
    assert values(stats.streaks(rows, at(11).date()), "longest", "current") == [(3, 0)]


def test_ladder(spark):
    rows = log(spark, [(i, 1, 1, ok, None, 1, at(1 + i)) for i, ok in enumerate([True] * 6 + [False])])
    assert values(review.states(rows.filter("id < 1")), "level", "interval_days", "due_at") == [(1, 2, at(3))]
    assert values(review.states(rows.filter("id < 6")), "level", "interval_days") == [(5, 30)]
    assert values(review.states(rows), "level", "interval_days", "due_at") == [(0, 1, at(7))]
    state = review.states(rows)
    assert review.queue(state, at(7)).count() == 1 and review.queue(state, datetime(2024, 3, 7, 7)).count() == 0


def test_rating(spark):
    assert one(spark, rules.ability(F.lit(0.0)), rules.ability(F.lit(0.5)), rules.ability(F.lit(1.0))) == [-400.0, 0.0, 400.0]
    p = one(spark, rules.success(F.lit(-301.0), F.lit(0.0)))[0]
    assert abs(p - 0.85) < 0.02
    down, up = one(spark, rules.elo(F.lit(400.0), F.lit(True), F.lit(0.0)), rules.elo(F.lit(400.0), F.lit(False), F.lit(0.0)))
    assert down < 400 < up
    kinds = one(spark, *[rules.initial_difficulty(F.lit(k), F.lit(1.0)) for k in ("JUDGE", "SINGLE", "MULTIPLE", "SUBJECTIVE")])
    assert kinds == sorted(kinds)


def test_running_counts_equal_a_window_of_the_whole_bank(spark):
    rows = log(spark, [(i, i % 2, i % 5, i % 3 == 0, None, 1, datetime(2024, 3, 1 + i % 4, i % 24, (i * 7) % 60)) for i in range(300)])
    known = sorted((r["answered_at"], r["id"], r["bank_id"], r["is_correct"]) for r in rows.collect())
    want = {i: (sum(b == bank for _, _, b, _ in known[:k]), sum(b == bank and ok for _, _, b, ok in known[:k])) for k, (_, i, bank, _) in enumerate(known)}
    assert {r["id"]: (r["n_before"], r["ok_before"]) for r in review.earlier_answers(rows).collect()} == want


def test_interleave_and_phrases_are_the_fixed_ones(spark):
    assert one(spark, *[rules.interleave(F.lit(m)) for m in (0.0, 0.59, 0.6, 0.84, 0.85, 1.0)]) == [0.0, 0.0, 0.15, 0.15, 0.35, 0.35]
    assert one(spark, *[rules.phrase(F.lit(n), F.lit(k)) for n, k in ((2, 2), (5, 4), (4, 2), (3, 1))]) == ["数据还太少", "较好", "一般", "较弱"]


def test_ratings_equal_a_replay(spark):
    """Row by row: the ability is the shrunk rate of all answers so far, this one too, to questions that share a node in the bank."""
    rng = random.Random(6)
    nodes = {q: set(rng.sample("abcdef", rng.randrange(0, 4))) for q in range(14)}
    kinds = {q: rng.choice(["SINGLE", "MULTIPLE", "JUDGE", "SUBJECTIVE"]) for q in range(12)}  # two unknown questions
    base = {"SINGLE": 400.0, "MULTIPLE": 460.0, "JUDGE": 320.0, "SUBJECTIVE": 520.0}
    answers = [(i, rng.randrange(2), rng.randrange(14), rng.choice([True, False, None]), rng.choice([None, None, "PARTIAL", "CORRECT"]), 1, datetime(2024, 3, 1 + rng.randrange(3), rng.randrange(24), rng.randrange(60))) for i in range(250)]
    answers = [(i, q % 2, q, *rest) for i, _, q, *rest in answers]
    grade = lambda ok, own: own or (None if ok is None else "CORRECT" if ok else "WRONG")
    want, seen = {}, []
    for i, bank, q, ok, own, _, at in sorted(answers, key=lambda r: (r[6], r[0])):
        if grade(ok, own) is None:
            continue
        right = grade(ok, own) == "CORRECT"
        seen.append((bank, q, right))
        same = [r for b, other, r in seen if b == bank and nodes[other] & nodes[q]]
        ability = max(-400, min(400, 400 * (2 * (sum(same) + 1.5) / (len(same) + 3) - 1))) if nodes[q] else 0.0
        if q in kinds:
            d, n = want.get(q, (base[kinds[q]], 0))
            want[q] = max(-400, min(1200, d + 16 * (1 / (1 + 10 ** ((d - ability) / 400)) - right))), n + 1
    questions = spark.createDataFrame([(q, k, 1.0) for q, k in kinds.items()], "id long, question_type string, score double")
    tags = spark.createDataFrame([(q, n) for q, some in nodes.items() for n in (*some, *some)], "question_id long, node_id string")
    got = {r["question_id"]: (r["difficulty"], r["attempts"]) for r in review.ratings(log(spark, answers), questions, tags).collect()}
    assert set(got) == set(want) and all(abs(got[q][0] - want[q][0]) < 1e-6 and got[q][1] == want[q][1] for q in want)


def test_more_answer_lines(spark):
    from studylake.functions import exam as M

    lines = ["12 B", "【第3题的答案】anything at all", "1－8 A", "3-5：A，B C", "1234. A", "1. ABCDEFGH", "参考答案：", "key: 1.A 2,B 3.C", "1.A；2.B；3 C"]
    assert one(spark, *[X.is_answer_line(F.lit(x)) for x in lines[:6]]) == [True, True, False, True, False, False]
    assert one(spark, X.answer_of(F.lit(lines[3]), F.lit(4)), X.answer_of(F.lit(lines[3]), F.lit(6))) == ["B", None]
    assert one(spark, M.compact_answers(F.lit(lines[8])), M.compact_answers(F.lit(lines[7]))) == [{1: "A", 2: "B", 3: "C"}, {}]


def bucket(spark, ids):
    return spark.createDataFrame([(q, r) for r, q in enumerate(ids)], "question_id long, rank int")


def test_plan_buckets(spark):
    got = plan.plan(bucket(spark, [1, 2]), bucket(spark, [1, 3]), bucket(spark, [4, 5, 6]), bucket(spark, range(4, 13)), bucket(spark, [1, 2, 3]), 10).orderBy("place").collect()
    assert [(r["reason"], r["question_id"]) for r in got] == [("WRONG", 1), ("WRONG", 2), ("DUE", 3), ("WEAK", 4), ("WEAK", 5), ("WEAK", 6), ("NEW", 7), ("NEW", 8), ("NEW", 9), ("NEW", 10)]


@pytest.mark.parametrize("count", [0, -3, 1, None, 500])
def test_small_plans(spark, count):
    """No or a nonsensical count is the default of twenty, so a small bank comes whole; one place goes to a wrong question."""
    none = bucket(spark, [])
    got = [r["question_id"] for r in plan.plan(bucket(spark, [7]), none, none, bucket(spark, [1, 2, 3, 4, 5]), none, count).orderBy("place").collect()]
    assert got == ([7] if count == 1 else [7, 1, 2, 3, 4, 5])
    assert plan.plan(none, none, none, none, none, 20).count() == 0


def test_quotas_of_small_plans():
    assert [plan.quotas(n) for n in (1, 2, 3, 4, 10, 20)] == [(1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 1, 1), (3, 3, 3), (6, 6, 6)]
    assert [plan.wanted(n) for n in (None, 0, -3, 1, 500)] == [20, 20, 20, 1, 200]


def test_plan_of_a_bank(spark):
    """The weakest node is the all-wrong one; no question is due where reviews are off."""
    questions = spark.createDataFrame([(q, q, "SINGLE", 1.0) for q in range(1, 13)], "id long, number int, question_type string, score double")
    tags = spark.createDataFrame([(q, "weak" if q in (1, 4, 5, 6) else "fine") for q in range(1, 13)], "question_id long, node_id string")
    rows = log(spark, [(1, 1, 1, False, None, 1, at(1)), (2, 1, 2, False, None, 1, at(2)), (3, 1, 3, True, None, 1, at(3))])
    due = spark.createDataFrame([(1, False, at(4)), (3, False, at(5)), (7, True, at(5)), (8, False, at(20))], "question_id long, suspended boolean, due_at timestamp").withColumn("due_at", F.col("due_at").cast("timestamp_ntz"))
    got = plan.practice_plan(rows, questions, tags, due, NOW, 10).orderBy("place").collect()
    assert [r["reason"] for r in got] == ["WRONG"] * 2 + ["DUE"] + ["WEAK"] * 3 + ["NEW"] * 4
    assert {r["question_id"] for r in got[:2]} == {1, 2} and got[2]["question_id"] == 3 and {r["question_id"] for r in got[3:6]} == {4, 5, 6}
    assert len({r["question_id"] for r in got}) == 10 and got[3]["node_id"] == "weak"
    off = plan.practice_plan(rows, questions, tags, due, NOW, 10, review=False)
    assert off.filter("reason = 'DUE'").count() == 0 and off.count() == 10


def test_given_ids_keep_their_order(spark):
    wanted = spark.createDataFrame([(0, 9), (1, 3), (2, 9), (3, 77), (4, 5)], "position int, id long")
    known = spark.createDataFrame([(3,), (5,), (9,)], "id long")
    assert [r["id"] for r in sessions.in_order(wanted, known).orderBy("place").collect()] == [9, 3, 5]


def test_numbers_continue(spark):
    old = spark.createDataFrame([(1, 12)], "bank_id long, number int")
    new = spark.createDataFrame([(1, None, 0), (1, None, 1)], "bank_id long, number int, position int")
    assert values(exchange.continue_numbers(old, new), "number") == [(13,), (14,)]


@pytest.mark.parametrize("version, following", [("1.0.0", "1.0.1"), ("1.2", "1.2.1"), ("1", "1.0.1"), ("beta", "1.0.0"), (None, "1.0.0")])
def test_next_version(spark, version, following):
    assert one(spark, exchange.next_version(F.lit(version).cast("string"))) == [following]


def test_import_twice_is_once(spark):
    banks = spark.createDataFrame([("p", "1", 1)], "package_key string, version string, bank_id long")
    questions = spark.createDataFrame([(7, 1, "q7")], "id long, bank_id long, external_id string")
    rows = [("p", "1", "q7", "A", True, None, None, at(1)), ("p", "1", "q7", "A", True, None, None, at(1)), ("p", "1", "lost", "A", True, None, None, at(1)), ("x", "1", "q7", "A", True, None, None, at(1))]
    records = spark.createDataFrame(rows, "package_key string, version string, question_key string, selected_keys string, is_correct boolean, user_answer string, self_grade string, answered_at timestamp").withColumn("answered_at", F.col("answered_at").cast("timestamp_ntz"))
    empty = spark.createDataFrame([], "question_id long, selected_keys string, is_correct boolean, user_answer string, self_grade string, answered_at timestamp_ntz")
    first = exchange.import_records(records, banks, questions, empty)
    assert first["new"].count() == 1
    assert values(first["missing_banks"], "package_key") == [("x",)] and values(first["missing_questions"], "question_key") == [("lost",)]
    again = exchange.import_records(records, banks, questions, first["new"].select(empty.columns))
    assert again["new"].count() == 0


def test_graph_errors(spark):
    nodes = spark.createDataFrame([("a", ["b"]), ("b", ["c"]), ("c", ["a"]), ("d", ["gone"]), ("d", [])], "node_id string, prereq array<string>")
    assert values(skills.graph_errors(nodes, skills.edges_of(nodes)), "error", "node_id") == [("CYCLE", "a"), ("CYCLE", "b"), ("CYCLE", "c"), ("DANGLING", "d"), ("DUPLICATE", "d")]


def test_checksum_follows_content_only(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (1, "b", None)], "bank_id long, external_id string, content string")
    same = exchange.bank_checksum(rows.orderBy(F.desc("external_id"))).first()["checksum"]
    assert same == exchange.bank_checksum(rows).first()["checksum"]
    assert same != exchange.bank_checksum(rows.fillna("y")).first()["checksum"]


ANSWERS = [("1. A", 1, "A"), ("2、bc", 2, "bc"), ("3：D", 3, "D"), (" 12)C ", 12, "C"), ("【第3题答案】：bd", 3, "bd"), ("9~10 BD ABD", 10, "ABD"), ("4、√", 4, "√"), ("1-8：B D C C B A B D", 3, "C"), ("1-8：B D C C B A B D", 9, None), ("1-3 ABC", 2, None), ("1-3 A,B", 2, "B"), ("1. A word", 1, None), ("3.5", 3, None), ("text", 1, None), ("2. A", 1, None)]


@pytest.mark.parametrize("line, number, answer", ANSWERS)
def test_answer_grammar(spark, line, number, answer):
    assert one(spark, X.answer_of(F.lit(line), F.lit(number))) == [answer]


@pytest.mark.parametrize("line, number", [("9. What is", 9), ("10、什么", 10), ("3.14 is pi", None), ("no. 3", None), ("[图片2]7) text", 7), ("5. B", None), ("6.", 6), ("3.1998年的", 3)])
def test_question_numbers(spark, line, number):
    assert one(spark, X.question_number(F.lit(line))) == [number]


def test_text_builders(spark):
    assert one(spark, X.tidy(F.lit("a​　b  \n\n\n\nc"))) == ["a b\n\nc"]
    assert one(spark, X.file_name(F.lit('a/b:c*?"<>|.. '))) == ["a_b_c______"]
    assert one(spark, X.file_name(F.lit("CON.txt")), X.file_name(F.lit(" "))) == ["_CON.txt", "untitled"]
    assert one(spark, X.fenced(F.lit('x ```json\n{"a": 1}\n``` y'))) == ['{"a": 1}']
    assert one(spark, X.images(F.lit("[图片3] [图片1] [图片3]"))) == [[3, 1]]
    assert one(spark, rules.round_half_up(F.lit(-2.5)), rules.round_half_up(F.lit(2.5))) == [-2.0, 3.0]


def test_answers_begin_where_the_text_says(spark, sf_dir, monkeypatch):
    """answer_lists with its texts dealt to other parts: where answers begin follows the text, not the part."""
    from studylake.plans import exam_queries, registry

    case = exam_queries._case
    monkeypatch.setattr(exam_queries, "_case", lambda n, *texts: case(n, *texts[2:], *texts[:2]))
    got = {r["id"]: (r["n"], r["begins"]) for r in registry.QUERIES["answer_lists"](spark, sf_dir).collect()}
    parts = exam_queries._part(spark, sf_dir).select("p_partkey", "p_name", "p_size").collect()
    assert got == {p["p_partkey"]: ((0, len(p["p_name"]) + 1), (0, -1), (0, -1), (3, 0), (0, 0))[p["p_size"] % 5] for p in parts}
    assert {p["p_size"] % 5 for p in parts} == set(range(5))


def test_exam_builders(spark):
    from studylake.functions import exam as M

    text = "一、选择\n1. first\n2. second\n7. odd\n3. third\n4. fourth\n8. last\n1. A\n答案"
    b = one(spark, M.boundaries(F.lit(text)))[0]
    assert [text[i:].split(".")[0] for i in b] == ["1", "2", "7", "8"]
    assert one(spark, M.boundaries(F.lit("1. a\n2. b"))) == [[]]
    assert one(spark, M.answer_section(F.lit(text)), M.answer_section(F.lit("none"))) == [text.index("1. A"), -1]
    assert one(spark, M.compact_answers(F.lit("1.A 2.BD 3）C 3.D"))) == [{1: "A", 2: "BD", 3: "D"}]
    assert one(spark, M.compact_answers(F.lit("1.A"))) == [{}]
    assert one(spark, M.is_answer_list(F.lit("1. A\n2. B\nx")), M.is_answer_list(F.lit("1. A\nx\ny\nz\nw")), M.is_answer_list(F.lit("1.A 2.B 3.C"))) == [True, False, True]
    assert one(spark, M.bracket_answer(F.lit("【1题答案】 12.\n【第1题答案】：see  text"), F.lit(1)), M.bracket_answer(F.lit("【2题答案】3"), F.lit(2))) == ["see text", None]
    none = F.array().cast(M.OPTIONS)
    kinds = one(spark, *[M.checked_question(F.lit(k), none, F.lit(None).cast("double")) for k in ("judge", "SINGLE")])
    assert [(k["type"], len(k["options"]), k["score"]) for k in kinds] == [("JUDGE", 2, 1.0), ("SUBJECTIVE", 0, 5.0)]
    abc = F.transform(F.array(F.lit("x"), F.lit("y"), F.lit("z")), lambda t: F.struct(t.alias("key"), t.alias("text")))
    assert one(spark, M.mislabelled_choice(F.lit("SUBJECTIVE"), F.lit("下列正确的是"), abc), M.mislabelled_choice(F.lit("SUBJECTIVE"), F.lit("简述下列"), abc)) == ["SINGLE", "SUBJECTIVE"]
    assert one(spark, M.is_junk(F.lit("SINGLE"), F.lit("ok"), abc), M.is_junk(F.lit("SINGLE"), F.lit("a 3.\nnext"), abc), M.is_junk(F.lit("SINGLE"), F.lit("ok"), none)) == [False, True, True]
    assert one(spark, M.images_within(F.lit("a[图片3]b[图片9]"), F.lit(3), F.lit(4))) == ["a[图片3]b"]


SOURCE = "第一章 标题\n1. first question of all\nA. red B. blue\nThe passage that belongs to the second\nquestion stands above its number\n2.\nA. green\nB. white\n答案：A\n3. third one here\nA. cat\nB. dog"
AB = [("A", "green"), ("B", "white")]


@pytest.mark.parametrize(
    "content, options, kind, want",
    [
        ("question stands above its number", AB, "SINGLE", ("The passage that belongs to the second\nquestion stands above its number", True)),
        ("2. green", AB, "SINGLE", ("The passage that belongs to the second\nquestion stands above its number", True)),
        # The next number that stands alone is taken for a stem's own, so a stem with its number before it takes what lies between.
        ("first question of all", [("A", "red"), ("B", "blue")], "SINGLE", ("The passage that belongs to the second\nquestion stands above its number", True)),
        ("third one here", [("A", "cat"), ("B", "white")], "SINGLE", ("third one here", False)),
        ("第一章 标题", [], "SINGLE", ("第一章 标题", False)),
        ("答案：A", [], "SINGLE", ("答案：A", False)),
        ("[图片3]", [], "SINGLE", ("[图片3]", False)),
        ("not in the text", [], "SINGLE", ("not in the text", False)),
        ("not in the text", [], "JUDGE", ("not in the text", True)),
        ("this is not in the text but long enough to stay", [], "SINGLE", ("this is not in the text but long enough to stay", True)),
    ],
)
def test_questions_by_their_source(spark, content, options, kind, want):
    from studylake.functions import exam as M

    row = spark.createDataFrame([(SOURCE, content, options, kind)], f"text string, content string, options {M.OPTIONS}, kind string")
    got = row.select(M.from_source(F.split("text", "\n"), F.col("content"), F.col("options"), F.col("kind")).alias("s")).first()["s"]
    assert got["kept"] == want[1] and (not got["kept"] or got["content"] == want[0])


def test_answers_from_their_source(spark):
    from studylake.functions import exam as M

    text = "1. what\nA. x\n（B）\n2. who\n答案：正确\n3. when\n【答案】 cd\n5. how\n1-3：A B C\n【第5题答案】B"
    ask = lambda c, n: one(spark, M.answer_evidence(F.lit(text), F.lit(c), F.lit(n).cast("int")))[0]
    assert ask("what", 1) == ["A", "B"] and ask("who", 2) == ["A", "B"] and ask("when", 3) == ["C", "D"]
    assert ask("how", None) == ["B"] and ask("nowhere", None) == [] and ask("nowhere", 5) == ["B"]
    assert one(spark, M.agrees(F.array(F.lit("a")), F.array(F.lit("A"))), M.agrees(F.array().cast("array<string>"), F.array().cast("array<string>")), M.agrees(F.array(F.lit("C")), F.array(F.lit("A")))) == [True, True, False]


def test_rows_are_linear_in_a_text(spark):
    """Doubling a text's lines about doubles the time of the cleaner and of the boundaries."""
    import time

    from studylake.functions import exam as M

    def seconds(n):
        rows = spark.createDataFrame([(1, "\n".join(f"{i % 900 + 1}. line {i % (n // 4)}" for i in range(n)))], "id long, text string").cache()
        rows.count()
        began = time.perf_counter()
        assert X.without_repeats(rows, "id").first()["n_lines"] == n
        assert rows.select(F.size(M.boundaries(F.col("text")))).first()[0] == min(n, 900)
        return time.perf_counter() - began

    seconds(200)
    small, large = seconds(4_000), seconds(16_000)
    assert large < 4 * small + 3, (small, large)


def test_empty_log(spark):
    none = log(spark, []).filter("id > 0")
    assert attempts.wrong_questions(none).count() == attempts.healed(none).count() == review.states(none).count() == 0
    assert attempts.month_snapshots(none, NOW, 2).agg(F.sum("wrong_questions")).first()[0] == 0
    assert values(stats.totals(none), "answered", "decided") == [(0, 0)]
