"""Queries over the answer log."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from studylake.functions import rules
from studylake.operators import attempts as A
from studylake.operators import plan as P
from studylake.operators import review as R
from studylake.operators import sessions as S
from studylake.operators import stats as T
from studylake.sources import bindings as B

from .base import AS_OF, AS_OF_SHIPPED, EDITED, LOG, QUESTIONS, SHIPPED, STATES, query

FIRST, LAST = date(2024, 1, 1), date(2024, 2, 4)
DAYS = f"""WITH {LOG}, d AS (SELECT CAST(answered_at AS DATE) AS day, count(*) AS answered, count(grade) AS decided, count(*) FILTER (WHERE grade = 'CORRECT') AS correct FROM g GROUP BY 1),
c AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-04', INTERVAL 1 DAY)) AS DATE) AS day),
days AS (SELECT c.day, coalesce(answered, 0) AS answered, coalesce(decided, 0) AS decided, coalesce(correct, 0) AS correct FROM c LEFT JOIN d USING (day))"""


@query(f"""WITH {LOG}, l AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY answered_at DESC, id DESC) AS rn,
  count(*) FILTER (WHERE grade <> 'CORRECT') OVER (PARTITION BY question_id) AS wrong_times, max(answered_at) OVER (PARTITION BY question_id) AS last_at FROM g)
SELECT bank_id, question_id, wrong_times, last_at FROM l WHERE rn = 1 AND grade <> 'CORRECT'""")
def wrong_questions(spark, sf_dir):
    return A.wrong_questions(B.attempts(spark, sf_dir))


@query(f"""WITH {LOG}, l AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY answered_at DESC, id DESC) AS rn,
  count(*) FILTER (WHERE grade <> 'CORRECT') OVER (PARTITION BY question_id) AS wrong_times, max(answered_at) OVER (PARTITION BY question_id) AS last_at FROM g),
w AS (SELECT bank_id, question_id, wrong_times, last_at FROM l WHERE rn = 1 AND grade <> 'CORRECT')
SELECT *, (SELECT count(*) FROM w) AS total FROM w ORDER BY wrong_times DESC, last_at DESC, question_id LIMIT 20 OFFSET 20""")
def wrong_page(spark, sf_dir):
    rows = A.wrong_questions(B.attempts(spark, sf_dir))
    return A.page(rows, [F.desc("wrong_times"), F.desc_nulls_last("last_at"), F.asc("question_id")], 2, 20)


@query(f"""WITH {SHIPPED} SELECT question_id, answered_at, id, is_correct, grade FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY answered_at DESC, id DESC, tie DESC) AS rn FROM h) WHERE rn = 1""")
def latest_attempt(spark, sf_dir):
    return A.latest(B.shipped(spark, sf_dir), "tie").select("question_id", "answered_at", "id", "is_correct", "grade")


@query(f"""WITH {SHIPPED}, l AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY answered_at DESC, id DESC, tie DESC) AS rn, max(answered_at) OVER (PARTITION BY question_id) AS healed_at,
  count(*) FILTER (WHERE grade <> 'CORRECT') OVER (PARTITION BY question_id) AS wrong_times FROM h)
SELECT question_id, healed_at, wrong_times FROM l WHERE rn = 1 AND grade = 'CORRECT' AND wrong_times > 0""")
def healed_questions(spark, sf_dir):
    return A.healed(B.shipped(spark, sf_dir), "tie").select("question_id", "healed_at", "wrong_times")


@query(f"""WITH {LOG}, l AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY answered_at DESC, id DESC) AS rn, count(*) FILTER (WHERE grade <> 'CORRECT') OVER (PARTITION BY question_id) AS wrong_times FROM g)
SELECT question_id, answered_at AS healed_at, wrong_times FROM l WHERE rn = 1 AND grade = 'CORRECT' AND wrong_times > 0 ORDER BY answered_at DESC, question_id LIMIT 5""")
def recently_healed(spark, sf_dir):
    return A.healed(B.attempts(spark, sf_dir)).select("question_id", "healed_at", "wrong_times").orderBy(F.desc("healed_at"), "question_id").limit(5)


@query(f"""WITH {LOG}, e AS (SELECT *, coalesce(max(CASE WHEN grade <> 'CORRECT' THEN 1 ELSE 0 END) OVER (PARTITION BY question_id ORDER BY answered_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS again FROM g)
SELECT bank_id, count(DISTINCT CASE WHEN grade <> 'CORRECT' THEN question_id END) AS cohort, count(*) FILTER (WHERE again AND grade IS NOT NULL) AS decided, count(*) FILTER (WHERE again AND grade = 'CORRECT') AS right_again FROM e GROUP BY bank_id""")
def after_first_error(spark, sf_dir):
    return A.after_first_error(B.attempts(spark, sf_dir))


@query(f"""WITH {SHIPPED}, m AS (SELECT last_day(CAST(DATE '1999-06-15' - to_months(CAST(i AS INT)) AS DATE)) AS month_end FROM range(6) t(i)),
l AS (SELECT month_end, grade, row_number() OVER (PARTITION BY month_end, question_id ORDER BY answered_at DESC, h.id DESC, tie DESC) AS rn FROM m JOIN h ON answered_at <= CAST(month_end AS TIMESTAMP) + INTERVAL '23 hours 59 minutes 59 seconds')
SELECT m.month_end, count(*) FILTER (WHERE rn = 1 AND grade <> 'CORRECT') AS wrong_questions FROM m LEFT JOIN l USING (month_end) GROUP BY 1""")
def month_end_wrong(spark, sf_dir):
    return A.month_snapshots(B.shipped(spark, sf_dir), AS_OF_SHIPPED, 6, "tie")


@query(f"{DAYS} SELECT * FROM days")
def daily_counts(spark, sf_dir):
    return T.daily(B.attempts(spark, sf_dir), FIRST, LAST)


@query(f"{DAYS}, r AS (SELECT day, CASE WHEN decided > 0 THEN correct / decided END AS rate FROM days) SELECT day, CASE WHEN count(rate) OVER w >= 3 THEN round(avg(rate) OVER w, 6) END AS rate7 FROM r WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)")
def moving_rate(spark, sf_dir):
    return T.moving_rate(T.daily(B.attempts(spark, sf_dir), FIRST, LAST))


@query(f"{DAYS} SELECT day, CAST(floor(datediff('day', DATE '2024-01-01', day) / 7) AS BIGINT) AS week, CAST(isodow(day) - 1 AS INT) AS weekday, CASE WHEN answered <= 0 THEN 0 WHEN answered <= 4 THEN 1 WHEN answered <= 9 THEN 2 WHEN answered <= 19 THEN 3 WHEN answered <= 34 THEN 4 ELSE 5 END AS shade FROM days")
def heat_map(spark, sf_dir):
    return T.heat_map(T.daily(B.attempts(spark, sf_dir), FIRST, LAST))


_RUNS = """d AS (SELECT DISTINCT {key} AS k, CAST(answered_at AS DATE) AS day FROM {rows} WHERE CAST(answered_at AS DATE) <= DATE '{as_of}'),
r AS (SELECT k, day, day - CAST(row_number() OVER (PARTITION BY k ORDER BY day) AS INT) AS start FROM d),
n AS (SELECT k, start, count(*) AS length, max(day) AS last FROM r GROUP BY 1, 2)"""


@query(f"WITH {LOG}, {_RUNS.format(key='question_id', rows='g', as_of='2024-01-30')} SELECT k AS question_id, max(length) AS longest, coalesce(max(length) FILTER (WHERE datediff('day', last, DATE '2024-01-30') <= 1), 0) AS current FROM n GROUP BY k")
def question_streaks(spark, sf_dir):
    return T.streaks(B.attempts(spark, sf_dir), AS_OF.date(), "question_id")


@query(f"WITH {SHIPPED}, {_RUNS.format(key='bank_id', rows='h', as_of='1999-06-15')} SELECT k AS bank_id, max(length) AS longest, coalesce(max(length) FILTER (WHERE datediff('day', last, DATE '1999-06-15') <= 1), 0) AS current FROM n GROUP BY k")
def bank_streaks(spark, sf_dir):
    return T.streaks(B.shipped(spark, sf_dir), AS_OF_SHIPPED.date(), "bank_id")


@query(f"WITH {LOG} SELECT count(*) AS answered, count(grade) AS decided, count(*) FILTER (WHERE grade = 'CORRECT') AS correct, CAST(sum(seconds) AS BIGINT) AS seconds, count(DISTINCT question_id) AS questions FROM g")
def statistics_totals(spark, sf_dir):
    return T.totals(B.attempts(spark, sf_dir))


@query(f"""WITH {LOG}, {QUESTIONS}, p AS (SELECT bank_id, count(*) AS answered, count(grade) AS decided, count(*) FILTER (WHERE grade = 'CORRECT') AS correct, count(DISTINCT question_id) AS seen FROM g GROUP BY 1),
z AS (SELECT bank_id, count(*) AS questions FROM q GROUP BY 1)
SELECT CAST(n_nationkey AS BIGINT) AS bank_id, n_name AS name, coalesce(questions, 0) AS questions, coalesce(seen, 0) AS seen, coalesce(answered, 0) AS answered, coalesce(decided, 0) AS decided, coalesce(correct, 0) AS correct,
  CASE WHEN decided > 0 THEN round(correct / decided, 6) END AS rate, coalesce(correct / nullif(decided, 0) < 0.6, false) AS low
FROM nation LEFT JOIN p ON p.bank_id = n_nationkey LEFT JOIN z ON z.bank_id = n_nationkey""")
def bank_statistics(spark, sf_dir):
    return T.by_bank(B.attempts(spark, sf_dir), B.banks(spark, sf_dir), B.questions(spark, sf_dir))


@query(f"""WITH {LOG}, {QUESTIONS}, s AS (SELECT g.bank_id, count(DISTINCT question_id) AS answered, count(*) AS records, count(*) FILTER (WHERE coalesce(is_correct, false) OR coalesce(self_grade = 'CORRECT', false)) AS correct FROM g WHERE question_id IN (SELECT id FROM q) GROUP BY 1),
z AS (SELECT bank_id, count(*) AS questions FROM q GROUP BY 1)
SELECT z.bank_id, questions, coalesce(answered, 0) AS answered, questions - coalesce(answered, 0) AS left, coalesce(records, 0) AS records, coalesce(correct, 0) AS correct, CAST(CASE WHEN records > 0 THEN floor(correct * 100 / records + 0.5) ELSE 0 END AS BIGINT) AS percent FROM z LEFT JOIN s USING (bank_id)""")
def bank_progress(spark, sf_dir):
    return T.progress(B.attempts(spark, sf_dir), B.questions(spark, sf_dir))


@query(f"WITH {LOG}, {STATES} SELECT question_id, bank_id, level, interval_days, due_at FROM s")
def review_states(spark, sf_dir):
    return R.states(B.attempts(spark, sf_dir)).drop("suspended")


@query(f"WITH {LOG}, {STATES} SELECT question_id, bank_id, level, due_at, CAST(greatest(0, datediff('day', due_at, TIMESTAMP '2024-01-30 12:00:00')) AS INT) AS overdue_days FROM s WHERE due_at <= TIMESTAMP '2024-01-30 12:00:00' ORDER BY due_at, question_id LIMIT 100")
def review_queue(spark, sf_dir):
    return R.queue(R.states(B.attempts(spark, sf_dir)), AS_OF).orderBy("due_at", "question_id").limit(100)


@query(f"WITH {LOG}, {STATES} SELECT bank_id, count(*) AS total, count(*) FILTER (WHERE due_at <= TIMESTAMP '2024-01-30 12:00:00') AS due, count(*) FILTER (WHERE due_at < TIMESTAMP '2024-01-30 00:00:00') AS overdue, count(*) FILTER (WHERE level >= 3) AS learned FROM s GROUP BY 1")
def review_summary(spark, sf_dir):
    return R.summary(R.states(B.attempts(spark, sf_dir)), AS_OF)


@query(f"WITH {LOG}, {STATES}, p AS (SELECT greatest(CAST(due_at AS DATE), DATE '2024-01-30') AS day, count(*) AS due FROM s GROUP BY 1), c AS (SELECT DATE '2024-01-30' + CAST(i AS INT) AS day FROM range(30) t(i)) SELECT c.day, coalesce(due, 0) AS due FROM c LEFT JOIN p USING (day)")
def review_forecast(spark, sf_dir):
    return T.forecast(R.states(B.attempts(spark, sf_dir)), AS_OF.date())


@query(f"WITH {LOG}, {STATES}, p AS (SELECT level, count(*) AS n FROM s GROUP BY 1) SELECT CAST(i AS INT) AS level, coalesce(n, 0) AS n FROM range(6) t(i) LEFT JOIN p ON p.level = i")
def level_histogram(spark, sf_dir):
    return T.level_histogram(R.states(B.attempts(spark, sf_dir)))


#: Two nodes a question: its type and its brand.
_TWO_TAGS = "t AS (SELECT p_partkey AS question_id, p_type AS node_id FROM part UNION ALL SELECT p_partkey, p_brand FROM part)"


def _two_tags(spark, sf_dir):
    q = B.questions(spark, sf_dir)
    return q.select(F.col("id").alias("question_id"), F.explode(F.array("topic", "category")).alias("node_id"))


@query(f"""WITH RECURSIVE {LOG}, {QUESTIONS}, {_TWO_TAGS}, p AS (SELECT DISTINCT a.question_id AS mine, b.question_id AS other FROM t a JOIN t b USING (node_id)),
o AS (SELECT id, question_id, bank_id, answered_at, grade = 'CORRECT' AS ok, row_number() OVER (PARTITION BY question_id ORDER BY answered_at, id) AS rn FROM g WHERE grade IS NOT NULL),
c AS (SELECT o.id, count(r.id) AS n, count(*) FILTER (WHERE r.ok) AS k FROM o JOIN p ON p.mine = o.question_id JOIN o r ON r.question_id = p.other AND r.bank_id = o.bank_id WHERE (r.answered_at, r.id) <= (o.answered_at, o.id) GROUP BY 1),
x AS (SELECT o.question_id, rn, ok, CASE WHEN c.id IS NULL THEN 0 ELSE greatest(-400, least(400, 400 * (2 * ((k + 1.5) / (n + 3)) - 1))) END::DOUBLE AS ability FROM o LEFT JOIN c USING (id)),
r AS (SELECT q.id AS question_id, 0::BIGINT AS rn, (CASE question_type WHEN 'SUBJECTIVE' THEN 520 WHEN 'MULTIPLE' THEN 460 WHEN 'JUDGE' THEN 320 ELSE 400 END + CASE WHEN score > 2 AND question_type <> 'SUBJECTIVE' THEN 40 ELSE 0 END)::DOUBLE AS d FROM q WHERE id IN (SELECT question_id FROM x)
  UNION ALL SELECT x.question_id, x.rn, greatest(-400, least(1200, d + 16 * (1 / (1 + pow(10::DOUBLE, (d - ability) / 400)) - CASE WHEN ok THEN 1 ELSE 0 END)))::DOUBLE FROM r JOIN x ON x.question_id = r.question_id AND x.rn = r.rn + 1)
SELECT question_id, round(max_by(d, rn), 4) AS difficulty, max(rn) AS attempts FROM r GROUP BY 1""")
def ratings(spark, sf_dir):
    found = R.ratings(B.attempts(spark, sf_dir), B.questions(spark, sf_dir), _two_tags(spark, sf_dir))
    return found.select("question_id", F.round("difficulty", 4).alias("difficulty"), "attempts")


_LAST8 = f"""{LOG}, t AS (SELECT p_partkey AS question_id, p_type AS node_id FROM part), l AS (SELECT node_id, coalesce(is_correct, false) AS ok, greatest(0, floor(date_diff('second', answered_at, TIMESTAMP '2024-01-30 12:00:00') / 86400)) AS days,
  row_number() OVER (PARTITION BY node_id ORDER BY answered_at DESC, id DESC) AS n FROM g JOIN t USING (question_id)),
m AS (SELECT node_id, sum(CASE WHEN ok THEN exp(-days / 30.0) * CASE WHEN days >= 7 THEN 1.2 ELSE 1 END * CASE WHEN n <= 3 THEN 1.5 ELSE 1 END ELSE 0 END) / sum(CASE WHEN n <= 3 THEN 1.5 ELSE 1 END) AS m FROM l WHERE n <= 8 GROUP BY 1),
z AS (SELECT node_id, count(DISTINCT t.question_id) AS questions, count(g.id) AS attempts, count(*) FILTER (WHERE is_correct) AS correct FROM t LEFT JOIN g USING (question_id) GROUP BY 1),
nodes AS (SELECT node_id, questions, attempts, correct, floor(coalesce(m, 0) * 1000 + 0.5) / 1000 AS mastery FROM z LEFT JOIN m USING (node_id))"""


def _tags(spark, sf_dir):
    return B.questions(spark, sf_dir).select(F.col("id").alias("question_id"), F.col("topic").alias("node_id"))


@query(f"WITH {_LAST8} SELECT * FROM nodes")
def node_mastery(spark, sf_dir):
    return P.mastery(B.attempts(spark, sf_dir), _tags(spark, sf_dir), AS_OF)


@query(f"WITH {_LAST8} SELECT node_id, questions FROM nodes WHERE node_id IN (SELECT node_id FROM t WHERE question_id NOT IN (SELECT question_id FROM g)) ORDER BY mastery, questions, node_id LIMIT 1")
def weakest_node(spark, sf_dir):
    log, tags = B.attempts(spark, sf_dir), _tags(spark, sf_dir)
    unseen = tags.join(log.select("question_id"), "question_id", "left_anti")
    return P.weakest(P.mastery(log, tags, AS_OF), unseen)


def _bucket(name: str, source: str, order: str) -> str:
    """SQL of a plan's bucket in the order of its target success: groups of equal mastery by their first candidate."""
    p = "(1 / (1 + pow(10::DOUBLE, (difficulty - greatest(-400, least(400, 400 * (2 * mastery - 1)))) / 400)))"
    return f"""{name}p AS (SELECT question_id, mastery, difficulty, row_number() OVER (ORDER BY {order}) AS pos FROM ({source}) JOIN rated USING (question_id)),
{name}r AS (SELECT question_id, pos, min(pos) OVER (PARTITION BY mastery) AS gf, round(CASE WHEN {p} BETWEEN 0.8 AND 0.9 THEN 0 ELSE 100 END + abs({p} - 0.85), 9) AS tr FROM {name}p)"""


def _pick(name: str, source: str, order: str, limit: int, *taken: str) -> str:
    free = " AND ".join(f"question_id NOT IN (SELECT question_id FROM {t})" for t in taken) or "true"
    return f"{name} AS (SELECT question_id, row_number() OVER (ORDER BY {order}) AS r FROM {source} WHERE {free} ORDER BY r LIMIT {limit})"


_PLAN = f"""{_LAST8.replace("FROM part)", "FROM part WHERE p_partkey % 10 = 3)")}, {STATES}, {EDITED},
a3 AS (SELECT question_id, max(answered_at) AS last_at, count(*) FILTER (WHERE NOT is_correct) AS times FROM g WHERE bank_id = 3 GROUP BY 1),
l3 AS (SELECT question_id, grade, row_number() OVER (PARTITION BY question_id ORDER BY answered_at DESC, id DESC) AS rn FROM g WHERE bank_id = 3),
rated AS (SELECT e.id AS question_id, number, greatest(0.5, coalesce(nodes.mastery, 0.5)) AS mastery, t.node_id,
  (CASE question_type WHEN 'SUBJECTIVE' THEN 520.0 WHEN 'MULTIPLE' THEN 460.0 WHEN 'JUDGE' THEN 320.0 ELSE 400.0 END + CASE WHEN score > 2 AND question_type <> 'SUBJECTIVE' THEN 40.0 ELSE 0.0 END)::DOUBLE AS difficulty
  FROM e LEFT JOIN t ON t.question_id = e.id LEFT JOIN nodes ON nodes.node_id = t.node_id WHERE e.bank_id = 3),
weak AS (SELECT node_id FROM nodes WHERE node_id IN (SELECT node_id FROM t WHERE question_id NOT IN (SELECT question_id FROM a3)) ORDER BY mastery, questions, node_id LIMIT 1),
{_bucket("w", "SELECT question_id, times FROM a3 WHERE question_id IN (SELECT question_id FROM l3 WHERE rn = 1 AND grade <> 'CORRECT')", "times DESC, question_id")},
{_bucket("d", "SELECT question_id FROM s WHERE bank_id = 3 AND due_at <= TIMESTAMP '2024-01-30 12:00:00'", "question_id")},
{_bucket("k", "SELECT question_id FROM t WHERE question_id NOT IN (SELECT question_id FROM a3) AND node_id = (SELECT node_id FROM weak)", "question_id")},
{_bucket("n", "SELECT id AS question_id FROM e WHERE bank_id = 3 AND id NOT IN (SELECT question_id FROM a3)", "coalesce(number, -1), question_id")},
{_pick("w1", "wr", "gf, tr, pos", 6)}, {_pick("d1", "dr", "gf, tr, pos", 6, "w1")}, {_pick("k1", "kr", "gf, tr, pos", 6, "w1", "d1")}, {_pick("n1", "nr", "gf, tr, pos", 20, "w1", "d1", "k1")},
{_pick("o1", "(SELECT question_id, last_at, number FROM rated LEFT JOIN a3 USING (question_id))", "last_at NULLS FIRST, coalesce(number, -1), question_id", 20, "w1", "d1", "k1", "n1")},
every AS (SELECT 0 AS bucket, 'WRONG' AS reason, * FROM w1 UNION ALL SELECT 1, 'DUE', * FROM d1 UNION ALL SELECT 2, 'WEAK', * FROM k1 UNION ALL SELECT 3, 'NEW', * FROM n1 UNION ALL SELECT 4, 'NEW', * FROM o1),
plan AS (SELECT reason, CAST(row_number() OVER (ORDER BY bucket, r) AS INT) AS place, question_id, node_id FROM every JOIN rated USING (question_id) ORDER BY 2 LIMIT 20)"""


def _plan(spark, sf_dir):
    """The parts of bank 3 and its plan."""
    log, questions = B.attempts(spark, sf_dir).filter("bank_id = 3"), B.edited(spark, sf_dir).filter("bank_id = 3")
    tags = _tags(spark, sf_dir).filter("question_id % 10 = 3")
    return log, questions, tags, P.practice_plan(log, questions, tags, R.states(log), AS_OF)


@query(f"WITH {_PLAN} SELECT * FROM plan")
def practice_plan(spark, sf_dir):
    return _plan(spark, sf_dir)[3]


@query(f"""WITH {_PLAN}, c AS (SELECT count(*) AS total, count(*) FILTER (WHERE reason = 'WRONG') AS w, count(*) FILTER (WHERE reason = 'DUE') AS d, count(*) FILTER (WHERE reason = 'WEAK') AS k, count(*) FILTER (WHERE reason = 'NEW') AS n FROM plan),
x AS (SELECT *, (SELECT node_id FROM weak) AS name, (SELECT questions FROM nodes WHERE node_id = (SELECT node_id FROM weak)) AS own, (SELECT count(*) FROM e WHERE bank_id = 3) AS size FROM c)
SELECT '这 ' || total || ' 题：' || concat_ws(' · ', CASE WHEN w > 0 THEN w || ' 题是你之前做错的' END, CASE WHEN d > 0 THEN d || ' 题今天到期复习' END, CASE WHEN k > 0 THEN k || ' 题来自「' || name || '」（这个知识点你库里只有 ' || own || ' 题）' END, CASE WHEN n > 0 THEN n || ' 题你还没做过' END) || '（题库共 ' || size || ' 题）' AS text FROM x""")
def plan_explanation(spark, sf_dir):
    log, questions, tags, items = _plan(spark, sf_dir)
    unseen = tags.join(log.select("question_id"), "question_id", "left_anti")
    weak = P.weakest(P.mastery(log, tags, AS_OF), unseen).select(F.col("node_id").alias("name"), "questions")
    return P.explanation(items, weak, questions.count())


_RATED = """d AS (SELECT id, CASE WHEN id % 3 = 0 THEN CAST(id % 900 AS DOUBLE) ELSE CASE question_type WHEN 'SUBJECTIVE' THEN 520.0 WHEN 'MULTIPLE' THEN 460.0 WHEN 'JUDGE' THEN 320.0 ELSE 400.0 END + CASE WHEN score > 2 AND question_type <> 'SUBJECTIVE' THEN 40.0 ELSE 0.0 END END::DOUBLE AS difficulty FROM q)"""


def _stored(spark, sf_dir):
    """Ratings of every third question."""
    return B.questions(spark, sf_dir).filter("id % 3 = 0").select(F.col("id").alias("question_id"), (F.col("id") % 900).cast("double").alias("difficulty"))


@query(f"WITH {QUESTIONS}, {_RATED} SELECT * FROM d")
def current_difficulties(spark, sf_dir):
    return P.current_difficulty(B.questions(spark, sf_dir), _stored(spark, sf_dir)).select("id", "difficulty")


@query(f"""WITH {QUESTIONS}, {_RATED}, rated AS (SELECT id AS question_id, difficulty, (0.5 + (id % 4) / 8.0)::DOUBLE AS mastery FROM d), {_bucket("x", "SELECT id AS question_id FROM q", "question_id")}
SELECT question_id, CAST(row_number() OVER (ORDER BY gf, tr, pos) AS INT) AS place FROM xr ORDER BY place LIMIT 100""")
def target_success_order(spark, sf_dir):
    rated = P.current_difficulty(B.questions(spark, sf_dir), _stored(spark, sf_dir)).select(F.col("id").alias("question_id"), "difficulty", (0.5 + (F.col("id") % 4) / 8.0).cast("double").alias("mastery"))
    ranked = P.by_target_success(rated.select("question_id", F.struct("question_id").alias("position")), rated)
    first = ranked.orderBy("rank").limit(100)
    return first.select("question_id", F.row_number().over(Window.orderBy("rank")).alias("place"))


@query("SELECT p_partkey AS id, CASE WHEN m >= 0.85 THEN 0.35 WHEN m >= 0.6 THEN 0.15 ELSE 0 END::DOUBLE AS share FROM (SELECT p_partkey, p_size / 50 AS m FROM part)")
def interleave_shares(spark, sf_dir):
    return B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), rules.interleave(F.col("p_size") / 50).alias("share"))


_SESSION = """sq AS (SELECT l_orderkey AS session_id, l_linenumber AS sort, min(l_partkey) AS question_id, min_by(l_linestatus, {'a': l_partkey, 'b': l_extendedprice, 'c': l_linestatus}) AS status, min(l_shipdate) AS answered_at FROM lineitem GROUP BY 1, 2)"""


@query(f"""WITH {_SESSION}, {QUESTIONS}, x AS (SELECT session_id, question_id, max_by(status, {{'a': answered_at, 'b': sort}}) AS status FROM sq GROUP BY 1, 2)
SELECT session_id, count(*) AS questions, count(*) AS answered, count(*) FILTER (WHERE x.status = 'F') AS correct, count(*) FILTER (WHERE x.status <> 'F') AS wrong, round(sum(CASE WHEN x.status = 'F' THEN score ELSE 0 END), 4) AS earned, round(sum(score), 4) AS most
FROM sq JOIN q ON q.id = sq.question_id JOIN x USING (session_id, question_id) GROUP BY 1""")
def session_report(spark, sf_dir):
    sq = B.session_questions(spark, sf_dir)
    records = sq.select("session_id", "question_id", F.when(F.col("status") == "F", "CORRECT").otherwise("WRONG").alias("grade"), F.lit(None).cast("double").alias("self_score"), "answered_at", F.col("sort").alias("id"))
    return S.report(sq, B.questions(spark, sf_dir), records)


@query(f"""WITH {LOG}, k AS (SELECT *, question_id * 100 + day(answered_at) AS session_id FROM g), f AS (SELECT session_id, min(answered_at) AS start FROM k GROUP BY 1)
SELECT session_id, id, coalesce(seconds, greatest(0, date_diff('second', date_trunc('second', coalesce(lag(answered_at) OVER (PARTITION BY session_id ORDER BY answered_at, id), start)), date_trunc('second', answered_at)))) AS seconds FROM k JOIN f USING (session_id)""")
def recorded_seconds(spark, sf_dir):
    """A session is a question's answers of one day."""
    rows = B.attempts(spark, sf_dir).withColumn("session_id", F.col("question_id") * 100 + F.dayofmonth("answered_at")).withColumn("answered_at", F.date_trunc("second", "answered_at").cast("timestamp_ntz"))
    starts = rows.groupBy("session_id").agg(F.min("answered_at").alias("created_at"))
    return S.seconds_per_question(rows, starts)


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey AS session_id, o_orderdate AS t, (SELECT min(o_orderdate) FROM orders) AS start FROM orders)
SELECT session_id, id, greatest(0, date_diff('second', coalesce(lag(t) OVER (PARTITION BY session_id ORDER BY t, id), start), t)) AS seconds FROM o""")
def elapsed_seconds(spark, sf_dir):
    orders = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("session_id"), F.col("o_orderdate").alias("answered_at"), F.lit(None).cast("long").alias("seconds"))
    first = orders.agg(F.min("answered_at")).scalar()
    return S.seconds_per_question(orders, orders.select("session_id").distinct().withColumn("created_at", first))


@query(f"WITH {LOG}, {STATES}, x AS (SELECT count(*) AS answered, count(*) FILTER (WHERE CAST(answered_at AS DATE) = DATE '2024-01-30') AS today FROM g) SELECT x.answered, today, round(least(1, today / 50), 6) AS goal, (SELECT count(*) FROM s WHERE due_at <= TIMESTAMP '2024-01-30 12:00:00') AS due, (SELECT count(*) FROM part) AS questions FROM x")
def home_overview(spark, sf_dir):
    log = B.attempts(spark, sf_dir)
    x = log.agg(F.count("*").alias("answered"), F.count_if(F.to_date("answered_at") == F.lit(AS_OF.date())).alias("today"))
    due = R.queue(R.states(log), AS_OF).agg(F.count("*")).scalar()
    size = B.questions(spark, sf_dir).agg(F.count("*")).scalar()
    return x.withColumn("due", due).withColumn("questions", size).select("answered", "today", F.round(F.least(F.lit(1.0), F.col("today") / 50), 6).alias("goal"), "due", "questions")


@query(f"WITH {QUESTIONS}, d AS (SELECT id, CASE question_type WHEN 'SUBJECTIVE' THEN 520.0 WHEN 'MULTIPLE' THEN 460.0 WHEN 'JUDGE' THEN 320.0 ELSE 400.0 END + CASE WHEN score > 2 AND question_type <> 'SUBJECTIVE' THEN 40.0 ELSE 0.0 END AS d FROM q) SELECT id, CAST(d AS DOUBLE) AS difficulty, CAST(floor(100 / (1 + pow(10::DOUBLE, d / 400)) + 0.5) AS BIGINT) AS percent FROM d")
def predicted_success(spark, sf_dir):
    d = rules.initial_difficulty(F.col("question_type"), F.col("score"))
    p = rules.success(d, F.lit(0.0))
    return B.questions(spark, sf_dir).select("id", d.alias("difficulty"), F.floor(p * 100 + 0.5).alias("percent"))


@query(f"WITH {LOG}, r AS (SELECT question_id, count(grade) AS n, count(*) FILTER (WHERE grade = 'CORRECT') AS ok FROM g GROUP BY 1) SELECT question_id, n, ok, CASE WHEN n < 3 THEN '数据还太少' WHEN ok / n >= 0.8 THEN '较好' WHEN ok / n >= 0.5 THEN '一般' ELSE '较弱' END AS phrase, round((ok + 1.5) / (n + 3), 6) AS shrunk FROM r")
def performance_phrase(spark, sf_dir):
    r = B.attempts(spark, sf_dir).groupBy("question_id").agg(F.count("grade").alias("n"), F.count_if(rules.is_right(F.col("grade"))).alias("ok"))
    return r.select("*", rules.phrase(F.col("n"), F.col("ok")).alias("phrase"), F.round((F.col("ok") + 1.5) / (F.col("n") + 3), 6).alias("shrunk"))
