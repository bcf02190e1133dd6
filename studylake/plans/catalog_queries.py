"""Queries over the catalogue, tags, notes, sessions and packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from studylake import schema
from studylake.functions import rules
from studylake.functions import text as X
from studylake.operators import attempts as A
from studylake.operators import cards as C
from studylake.operators import exchange as E
from studylake.operators import review as R
from studylake.operators import search as Q
from studylake.operators import sessions as S
from studylake.operators import skills as K
from studylake.sources import bindings as B
from studylake.sources import files as L

from .base import AS_OF, AS_OF_SHIPPED, EDITED, LOG, QUESTIONS, STATES, query

TAGS = """t AS (SELECT doc_id AS question_id, CAST(doc_id % 30 AS VARCHAR) AS node_id, CASE WHEN toxic = 1 THEN 'ai' ELSE 'author' END AS source, 0.5::DOUBLE + quality / 4 AS confidence, quality = 1 AS confirmed FROM labels)"""
NODES = """n AS (SELECT CAST(n_nationkey AS VARCHAR) AS node_id, n_name AS name, n_regionkey AS stage,
  list_filter([CASE WHEN n_nationkey >= 10 THEN CAST(n_nationkey - 10 AS VARCHAR) END, CASE WHEN n_nationkey % 5 <> 0 THEN CAST(n_nationkey - n_nationkey % 5 AS VARCHAR) END], lambda x: x IS NOT NULL) AS prereq FROM nation),
edges AS (SELECT node_id, unnest(prereq) AS prereq FROM n)"""
LINKS = """k AS (SELECT doc_id AS note_id, CASE WHEN doc_id % 3 = 0 THEN 'BANK' ELSE 'QUESTION' END AS target_type, CASE WHEN doc_id % 3 = 0 THEN doc_id % 40 ELSE doc_id END AS target_id FROM labels)"""


# --- search, scopes, pages -------------------------------------------------------------------------------


@query(f"WITH {QUESTIONS} SELECT id, bank_id, content, topic FROM q WHERE (contains(content, 'ring') OR contains(category, '#2')) AND topic IN ('SMALL', 'LARGE') AND bank_id = 4")
def question_search(spark, sf_dir):
    chosen = Q.all_of(Q.contains("ring", "content") | Q.contains("#2", "category"), Q.among("topic", ["SMALL", "LARGE"]), Q.equals("bank_id", 4), Q.equals("question_type", ""), Q.among("category", []))
    return B.questions(spark, sf_dir).filter(chosen).select("id", "bank_id", "content", "topic")


@query(f"WITH {QUESTIONS} SELECT id, bank_id, topic FROM q WHERE question_type = 'JUDGE' ORDER BY score DESC, id LIMIT 20 OFFSET 40")
def question_page(spark, sf_dir):
    rows = B.questions(spark, sf_dir).filter(Q.all_of(Q.equals("question_type", Q.known(" judge ", schema.QUESTION_TYPES))))
    return A.page(rows, [F.desc_nulls_last("score"), F.asc("id")], 3, 20).select("id", "bank_id", "topic")


@query(f"WITH {QUESTIONS}, {LOG} SELECT bank_id, count(*) AS undone FROM q WHERE id NOT IN (SELECT question_id FROM g) GROUP BY 1")
def undone_questions(spark, sf_dir):
    answered = B.attempts(spark, sf_dir).select("question_id")
    return Q.scope(B.questions(spark, sf_dir), "undone", answered=answered).groupBy("bank_id").agg(F.count("*").alias("undone"))


@query(f"WITH {QUESTIONS}, {LOG}, l AS (SELECT question_id, grade, row_number() OVER (PARTITION BY question_id ORDER BY answered_at DESC, id DESC) AS rn FROM g) SELECT id, topic, question_type FROM q WHERE id IN (SELECT question_id FROM l WHERE rn = 1 AND grade <> 'CORRECT')")
def wrong_scope(spark, sf_dir):
    wrong = A.wrong_questions(B.attempts(spark, sf_dir))
    return Q.scope(B.questions(spark, sf_dir), "wrong", wrong=wrong).select("id", "topic", "question_type")


@query(f"WITH {EDITED} SELECT id, number, question_type, favorite FROM e WHERE favorite AND bank_id = 2")
def favourite_navigation(spark, sf_dir):
    return Q.scope(B.edited(spark, sf_dir).filter("bank_id = 2"), "favorite").select("id", "number", "question_type", "favorite")


@query(f"WITH {EDITED} SELECT bank_id, list(DISTINCT trim(topic) ORDER BY trim(topic)) AS topics FROM e WHERE trim(topic) <> '' GROUP BY 1")
def distinct_topics(spark, sf_dir):
    rows = B.edited(spark, sf_dir).select("bank_id", X.blank_to_null(F.col("topic")).alias("topic")).filter("topic IS NOT NULL")
    return rows.groupBy("bank_id").agg(F.array_sort(F.collect_set("topic")).alias("topics"))


@query(f"WITH {QUESTIONS} SELECT CAST(n_nationkey AS BIGINT) AS bank_id, n_name AS name, count(q.id) AS questions FROM nation LEFT JOIN q ON q.bank_id = n_nationkey WHERE contains(n_name, '1') GROUP BY 1, 2")
def bank_list(spark, sf_dir):
    banks = B.banks(spark, sf_dir).filter(Q.all_of(Q.contains("1", "name")))
    size = B.questions(spark, sf_dir).groupBy("bank_id").agg(F.count("*").alias("questions"))
    return banks.join(size, "bank_id", "left").select("bank_id", "name", F.coalesce("questions", F.lit(0)).alias("questions"))


@query(f"WITH {LOG} SELECT id, question_id FROM g WHERE date_trunc('second', answered_at) = (SELECT date_trunc('second', min(answered_at)) FROM g) AND self_grade IS NOT DISTINCT FROM NULL")
def same_second(spark, sf_dir):
    log = B.attempts(spark, sf_dir)
    first = log.agg(F.date_trunc("second", F.min("answered_at")).alias("s"))
    rows = log.join(F.broadcast(first), F.date_trunc("second", "answered_at") == F.col("s"))
    return rows.filter(Q.same("self_grade", None)).select("id", "question_id")


@query(f"WITH {LOG}, s AS (SELECT question_id, count(grade) AS decided, count(*) FILTER (WHERE grade = 'CORRECT') AS ok FROM g GROUP BY 1), {QUESTIONS} SELECT bank_id, CAST(count(*) FILTER (WHERE s.decided IS NULL) AS BIGINT) AS undone, count(*) FILTER (WHERE s.decided = 0) AS undecided, count(*) FILTER (WHERE s.decided > 0 AND ok / s.decided < 0.6) AS weak, count(*) FILTER (WHERE s.decided > 0 AND ok / s.decided >= 0.6) AS rest FROM q LEFT JOIN s ON s.question_id = q.id GROUP BY 1")
def priority_groups(spark, sf_dir):
    s = B.attempts(spark, sf_dir).groupBy(F.col("question_id").alias("id")).agg(F.count("grade").alias("decided"), F.count_if(rules.is_right(F.col("grade"))).alias("ok"))
    rate = F.when(F.col("decided") > 0, F.col("ok") / F.col("decided"))
    kind = F.when(F.col("decided").isNull(), "undone").when(F.col("decided") == 0, "undecided").when(rate < 0.6, "weak").otherwise("rest")
    rows = B.questions(spark, sf_dir).join(s, "id", "left").withColumn("kind", kind)
    return rows.groupBy("bank_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("undone", "undecided", "weak", "rest")])


@query(f"WITH {QUESTIONS}, {LOG}, l AS (SELECT question_id, max(answered_at) AS last_at FROM g GROUP BY 1) SELECT id, last_at FROM q LEFT JOIN l ON l.question_id = q.id WHERE q.bank_id = 1 ORDER BY last_at NULLS FIRST, id LIMIT 200")
def stalest_questions(spark, sf_dir):
    last = B.attempts(spark, sf_dir).groupBy(F.col("question_id").alias("id")).agg(F.max("answered_at").alias("last_at"))
    return B.questions(spark, sf_dir).filter("bank_id = 1").join(last, "id", "left").select("id", "last_at").orderBy(F.asc_nulls_first("last_at"), "id").limit(200)


# --- notes -----------------------------------------------------------------------------------------------


@query(f"WITH {LINKS} SELECT doc_id AS note_id FROM documents WHERE doc_id NOT IN (SELECT note_id FROM k)")
def unlinked_notes(spark, sf_dir):
    return Q.unlinked(B.notes(spark, sf_dir), B.note_links(spark, sf_dir)).select("note_id")


@query(f"WITH {LINKS} SELECT note_id, target_type, target_id, coalesce(CASE WHEN target_type = 'QUESTION' THEN p_name ELSE n_name END, '(deleted)') AS title FROM k LEFT JOIN part ON target_type = 'QUESTION' AND p_partkey = target_id LEFT JOIN nation ON target_type = 'BANK' AND n_nationkey = target_id")
def note_titles(spark, sf_dir):
    return Q.notes_with_titles(B.notes(spark, sf_dir), B.note_links(spark, sf_dir), B.questions(spark, sf_dir), B.banks(spark, sf_dir))


@query(f"WITH {LINKS}, {QUESTIONS} SELECT DISTINCT note_id FROM k WHERE (target_type = 'BANK' AND target_id = 3) OR (target_type = 'QUESTION' AND target_id IN (SELECT id FROM q WHERE bank_id = 3))")
def notes_of_bank(spark, sf_dir):
    links = B.note_links(spark, sf_dir)
    own = B.questions(spark, sf_dir).filter("bank_id = 3").select(F.col("id").alias("target_id"))
    direct = links.filter("target_type = 'BANK' AND target_id = 3").select("note_id")
    return direct.union(links.filter("target_type = 'QUESTION'").join(own, "target_id", "left_semi").select("note_id")).distinct()


@query(r"SELECT doc_id AS note_id, CASE WHEN length(line) > 60 THEN substr(line, 1, 60) || '…' ELSE line END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')) AS line FROM documents WHERE contains(text, 'the'))")
def note_previews(spark, sf_dir):
    return B.notes(spark, sf_dir).filter(Q.contains("the", "content")).select("note_id", Q.preview(F.col("content")).alias("preview"))


@query("WITH d AS (SELECT date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-06-15') AS days FROM orders) SELECT CASE WHEN days <= 0 THEN 'today' WHEN days = 1 THEN 'yesterday' WHEN days < 7 THEN 'week' WHEN days < 30 THEN 'month' ELSE 'older' END AS time_group, count(*) AS n FROM d GROUP BY 1")
def time_groups(spark, sf_dir):
    rows = B.sessions(spark, sf_dir).select(Q.time_group(F.col("created_at"), AS_OF_SHIPPED).alias("time_group"))
    return rows.groupBy("time_group").agg(F.count("*").alias("n"))


@query(f"WITH {LINKS} SELECT note_id, target_type, target_id FROM k UNION SELECT doc_id, 'BANK', 1 FROM documents WHERE doc_id % 2 = 0")
def added_links(spark, sf_dir):
    wanted = B.notes(spark, sf_dir).filter("note_id % 2 = 0").select("note_id", F.lit("BANK").alias("target_type"), F.lit(1).cast("long").alias("target_id"))
    return Q.add_links(B.note_links(spark, sf_dir), wanted.union(wanted))


# --- sessions --------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT l_orderkey, count(*) AS records, count(*) FILTER (WHERE l_linestatus = 'F') AS correct FROM lineitem GROUP BY 1)
SELECT o_orderkey AS session_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'Wrong questions' WHEN '2-HIGH' THEN 'Plan' ELSE 'Practice' END AS label, coalesce(records, 0) AS records, CASE WHEN records > 0 THEN round(correct / records, 6) END AS rate
FROM orders LEFT JOIN a ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10""")
def recent_sessions(spark, sf_dir):
    per = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("session_id")).agg(F.count("*").alias("records"), F.count_if(F.col("l_linestatus") == "F").alias("correct"))
    last = B.sessions(spark, sf_dir).filter("status = 'F'").orderBy(F.desc("created_at"), F.desc("session_id")).limit(10)
    label = F.when(F.col("mode") == "1-URGENT", "Wrong questions").when(F.col("mode") == "2-HIGH", "Plan").otherwise("Practice")
    rate = F.when(F.col("records") > 0, F.round(F.col("correct") / F.col("records"), 6))
    return F.broadcast(last).join(per, "session_id", "left").select("session_id", label.alias("label"), F.coalesce("records", F.lit(0)).alias("records"), rate.alias("rate"))


def _drawn(pool: str, whole: bool, late: str = "false", order: str = "sha256('7-' || unit)", start: str = "") -> str:
    """SQL of a draw of 30 from a pool (rows of e): id, place."""
    unit = "coalesce('m' || material_id, 'q' || id)" if whole else "'q' || id"
    first = "min({'none': number IS NULL, 'number': coalesce(number, 0), 'id': id})"
    return f"""(WITH p AS (SELECT *, {unit} AS unit, {late} AS done FROM ({pool})),
u AS (SELECT unit, count(*) AS size, bool_and(done) AS late, bool_or({'material_id IS NOT NULL' if whole else 'false'}) AS grouped, {first} AS first FROM p GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY late, {order}, unit) AS r FROM u), c AS (SELECT * FROM k {start}),
b AS (SELECT unit, coalesce(sum(size) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT id, CAST(before AS BIGINT) + row_number() OVER (PARTITION BY unit ORDER BY number NULLS LAST, id) AS place FROM p JOIN b USING (unit) WHERE before < 30)"""


_FOUR = "SELECT * FROM e WHERE bank_id = 4"


def _pool(spark, sf_dir):
    return B.edited(spark, sf_dir).filter("bank_id = 4")


def _done(spark, sf_dir):
    return B.attempts(spark, sf_dir).select(F.col("question_id").alias("id"))


@query(f"WITH {EDITED} SELECT * FROM {_drawn(_FOUR, True, order='grouped, first')}")
def draw_in_sequence(spark, sf_dir):
    return S.draw(_pool(spark, sf_dir), "SEQUENCE", 30)


@query(f"WITH {EDITED} SELECT * FROM {_drawn(_FOUR, True, order='grouped, first', start='WHERE r >= (SELECT r FROM k WHERE unit = (SELECT unit FROM p WHERE id = 44))')}")
def draw_from_a_question(spark, sf_dir):
    return S.draw(_pool(spark, sf_dir), "SEQUENCE", 30, start=44)


@query(f"WITH {EDITED}, {LOG} SELECT * FROM {_drawn(_FOUR, True, 'id IN (SELECT question_id FROM g)')}")
def draw_undone_first(spark, sf_dir):
    return S.draw(_pool(spark, sf_dir), "ALL", 30, 7, _done(spark, sf_dir))


@query(f"WITH {EDITED}, {LOG} SELECT * FROM {_drawn(_FOUR + " AND topic IN ('ECONOMY', 'LARGE', 'SMALL')", False, 'id IN (SELECT question_id FROM g)')}")
def draw_topics(spark, sf_dir):
    rows = S.pool(_pool(spark, sf_dir).filter(Q.among("topic", ["ECONOMY", "LARGE", "SMALL"])), "TOPIC")
    return S.draw(rows, "TOPIC", 30, 7, _done(spark, sf_dir))


@query(f"WITH {EDITED} SELECT * FROM {_drawn(_FOUR + ' AND favorite', False)}")
def draw_favourites(spark, sf_dir):
    return S.draw(S.pool(_pool(spark, sf_dir), "FAVORITE"), "FAVORITE", 30, 7)


@query(f"""WITH {EDITED}, {LOG}, l AS (SELECT question_id, grade, row_number() OVER (PARTITION BY question_id ORDER BY answered_at DESC, id DESC) AS rn FROM g) SELECT * FROM {_drawn(_FOUR + " AND id IN (SELECT question_id FROM l WHERE rn = 1 AND grade <> 'CORRECT')", False)}""")
def draw_wrong(spark, sf_dir):
    return S.draw(S.pool(_pool(spark, sf_dir), "WRONG", wrong=A.wrong_questions(B.attempts(spark, sf_dir))), "WRONG", 30, 7)


@query(f"""WITH {EDITED}, {LOG}, {STATES} SELECT * FROM {_drawn(_FOUR + " AND id IN (SELECT question_id FROM s WHERE due_at <= TIMESTAMP '2024-01-30 12:00:00')", False)}""")
def draw_due(spark, sf_dir):
    due = R.queue(R.states(B.attempts(spark, sf_dir)), AS_OF)
    return S.draw(S.pool(_pool(spark, sf_dir), "REVIEW", due=due), "REVIEW", 30, 7)


@query(f"""WITH {EDITED}, {TAGS} SELECT * FROM {_drawn(_FOUR + " AND id IN (SELECT question_id FROM t WHERE node_id IN ('4', '14'))", False)}""")
def draw_skill(spark, sf_dir):
    rows = S.pool(_pool(spark, sf_dir), "SKILL", tags=B.tags(spark, sf_dir), nodes=["4", "14"])
    return S.draw(rows, "SKILL", 30, 7)


@query(f"WITH {EDITED}, w AS (SELECT p_partkey AS id, p_partkey * 37 % 1000 AS position FROM part WHERE p_size < 25) SELECT w.id, CAST(row_number() OVER (ORDER BY position, w.id) AS INT) AS place FROM w WHERE w.id IN (SELECT id FROM e WHERE bank_id = 4)")
def draw_plan(spark, sf_dir):
    order = B.table(spark, sf_dir, "part").filter("p_size < 25").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 37 % 1000).alias("position"))
    return S.draw(S.pool(_pool(spark, sf_dir), "PLAN", ids=order), "PLAN", None, order=order)


@query(f"""WITH {QUESTIONS}, w AS (SELECT l_partkey AS id, min(l_orderkey * 10 + l_linenumber) AS position FROM lineitem WHERE l_orderkey < 30 GROUP BY 1)
SELECT w.id, CAST(row_number() OVER (ORDER BY position, id) AS INT) AS place FROM w WHERE w.id IN (SELECT id FROM q)""")
def given_order(spark, sf_dir):
    wanted = B.table(spark, sf_dir, "lineitem").filter("l_orderkey < 30").select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    return S.in_order(wanted, B.questions(spark, sf_dir))


@query("SELECT o_orderkey AS session_id, l_linenumber AS sort, l_partkey AS question_id, CASE WHEN o_orderstatus = 'F' THEN l_linestatus END AS answer FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def session_questions(spark, sf_dir):
    line = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("sort"), F.col("l_partkey").alias("question_id"), "l_linestatus")
    return B.sessions(spark, sf_dir).join(line, "session_id").select("session_id", "sort", "question_id", F.when(F.col("status") == "F", F.col("l_linestatus")).alias("answer"))


@query(f"""WITH {EDITED}, c AS (SELECT id, list_sort(list_distinct(list_filter(list_transform(string_split(coalesce(answer_keys, ''), ','), lambda k: upper(trim(k))), lambda k: k <> ''))) AS k FROM e), s AS (SELECT id, (['b', 'C,a', 'A', ''])[id % 4 + 1] AS given FROM e)
SELECT id, given, given <> '' AND k = list_sort(list_distinct(list_transform(string_split(given, ','), lambda x: upper(trim(x))))) AS matches FROM c JOIN s USING (id)""")
def answer_check(spark, sf_dir):
    given = F.element_at(F.array(*[F.lit(x) for x in ("b", "C,a", "A", "")]), (F.col("id") % 4 + 1).cast("int"))
    return B.edited(spark, sf_dir).select("id", given.alias("given"), rules.answer_matches(F.col("answer_keys"), given).alias("matches"))


@query("WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_tax * 100 AS earned, 8.0::DOUBLE AS most FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN earned >= most - 1e-9 THEN 'CORRECT' WHEN earned <= 1e-9 THEN 'WRONG' ELSE 'PARTIAL' END AS grade FROM x WHERE earned <= most + 1e-9")
def derived_self_grade(spark, sf_dir):
    grade = rules.self_grade_of(F.col("l_tax") * 100, F.lit(8.0))
    return B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", grade.alias("grade")).filter("grade IS NOT NULL")


# --- tags and skills -------------------------------------------------------------------------------------

_STATE = f"{TAGS}, {QUESTIONS}, p AS (SELECT question_id, bool_or(confirmed) AS c, bool_or(source = 'ai') AS a FROM t GROUP BY 1), s AS (SELECT q.id AS question_id, CASE WHEN c THEN 'CONFIRMED' WHEN a THEN 'SUGGESTED' ELSE 'UNTAGGED' END AS state FROM q LEFT JOIN p ON p.question_id = q.id)"


def _ids(spark, sf_dir):
    return B.questions(spark, sf_dir).select(F.col("id").alias("question_id"))


@query(f"WITH {_STATE} SELECT * FROM s")
def tag_states(spark, sf_dir):
    return K.tag_state(_ids(spark, sf_dir), B.tags(spark, sf_dir))


@query(f"WITH {_STATE} SELECT count(*) AS total, count(*) FILTER (WHERE state = 'CONFIRMED') AS confirmed, count(*) FILTER (WHERE state = 'SUGGESTED') AS suggested, count(*) FILTER (WHERE state = 'UNTAGGED') AS untagged, count(*) FILTER (WHERE state <> 'UNTAGGED') AS usable FROM s")
def tag_coverage(spark, sf_dir):
    return K.coverage(_ids(spark, sf_dir), B.tags(spark, sf_dir))


@query(f"WITH {NODES}, {TAGS} SELECT n.node_id, count(DISTINCT question_id) AS questions, count(DISTINCT question_id) >= 15 AS enough FROM n LEFT JOIN t USING (node_id) GROUP BY 1")
def node_coverage(spark, sf_dir):
    return K.node_coverage(B.skill_nodes(spark, sf_dir), B.tags(spark, sf_dir), 15)


@query(f"WITH {NODES}, {TAGS} SELECT count(*) AS tags, count(DISTINCT question_id) AS questions FROM t WHERE node_id NOT IN (SELECT node_id FROM n)")
def orphan_tags(spark, sf_dir):
    return K.orphans(B.skill_nodes(spark, sf_dir), B.tags(spark, sf_dir))


@query(f"""WITH RECURSIVE {NODES}, c AS (SELECT node_id, prereq AS ancestor, 1 AS distance FROM edges UNION SELECT c.node_id, edges.prereq, distance + 1 FROM c JOIN edges ON edges.node_id = c.ancestor WHERE distance < 20)
SELECT node_id, ancestor, min(distance) AS distance FROM c GROUP BY 1, 2""")
def prerequisite_closure(spark, sf_dir):
    return K.closure(K.edges_of(B.skill_nodes(spark, sf_dir)))


@query(f"""WITH RECURSIVE {NODES}, x AS (SELECT node_id, prereq FROM edges UNION ALL SELECT '0', '12' UNION ALL SELECT '3', 'gone'), c AS (SELECT node_id, prereq AS ancestor, 1 AS d FROM x UNION SELECT c.node_id, x.prereq, d + 1 FROM c JOIN x ON x.node_id = c.ancestor WHERE d < 20)
SELECT 'DANGLING' AS error, '3' AS node_id UNION SELECT DISTINCT 'CYCLE', node_id FROM c WHERE node_id = ancestor""")
def graph_errors(spark, sf_dir):
    nodes = B.skill_nodes(spark, sf_dir)
    more = spark.createDataFrame([("0", "12"), ("3", "gone")], "node_id string, prereq string")
    return K.graph_errors(nodes, K.edges_of(nodes).unionByName(more))


@query(f"""WITH {NODES} SELECT node_id, CASE WHEN node_id = '7' THEN 'Renamed' ELSE name END AS name, CAST(CASE WHEN node_id = '7' THEN 0 ELSE len(list_filter(prereq, lambda p: p NOT IN ('10', '5'))) END AS INT) AS needs FROM n WHERE node_id NOT IN ('10', '5')
UNION ALL SELECT 'own', 'Added', 1""")
def customised_nodes(spark, sf_dir):
    added = spark.createDataFrame([("7", "Renamed", []), ("own", "Added", ["5", "1"])], "node_id string, name string, prereq array<string>")
    off = spark.createDataFrame([("10",), ("5",)], "node_id string")
    return K.customise(B.skill_nodes(spark, sf_dir), added, off).select("node_id", "name", F.size("prereq").alias("needs"))


@query(f"""WITH {TAGS}, f AS (SELECT p_partkey AS question_id, CAST(p_size % 30 AS VARCHAR) AS node_id, 0.7::DOUBLE AS c2 FROM part)
SELECT coalesce(t.question_id, f.question_id) AS question_id, coalesce(t.node_id, f.node_id) AS node_id, coalesce(source, 'ai') AS source, greatest(confidence, c2) AS confidence, coalesce(confirmed, false) AS confirmed
FROM t FULL JOIN f USING (question_id, node_id) WHERE f.question_id IS NOT NULL OR source = 'human' OR t.question_id NOT IN (SELECT question_id FROM f)""")
def tag_upsert(spark, sf_dir):
    found = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"), (F.col("p_size") % 30).cast("string").alias("node_id"), F.lit(0.7).alias("confidence"))
    return K.upsert(B.tags(spark, sf_dir), found)


@query(f"""WITH {EDITED}, k AS (SELECT id, substr(coalesce(nullif(trim(topic), ''), nullif(trim(category), ''), nullif(regexp_extract(external_id, '^([^-_.]+)', 1), '')), 1, 160) AS key FROM e), m AS (SELECT key, min(id) % 25 AS node FROM k WHERE key <> 'PROMO' GROUP BY 1)
SELECT id AS question_id, CAST(node AS VARCHAR) AS node_id FROM k JOIN m USING (key)""")
def group_tags(spark, sf_dir):
    keyed = B.edited(spark, sf_dir).select("id", X.group_key(F.col("topic"), F.col("category"), F.col("external_id")).alias("key"))
    given = keyed.filter("key <> 'PROMO'").groupBy("key").agg((F.min("id") % 25).alias("node"))
    return keyed.join(given, "key").select(F.col("id").alias("question_id"), F.col("node").cast("string").alias("node_id"))


@query(f"""WITH {EDITED}, k AS (SELECT id, substr(coalesce(nullif(trim(topic), ''), nullif(trim(category), ''), nullif(regexp_extract(external_id, '^([^-_.]+)', 1), '')), 1, 160) AS key FROM e),
m AS (SELECT key, min(id) % 25 AS node, bool_or(id % 50 = 0) AS changed FROM k GROUP BY 1)
SELECT key, CAST(CASE WHEN changed THEN 2 ELSE 1 END AS INT) AS run, CAST(CASE WHEN changed THEN node + 1 ELSE node END AS VARCHAR) AS node_id FROM m""")
def kept_group_nodes(spark, sf_dir):
    """Nodes of groups after two runs: every fiftieth question changed between them, and only its group was asked again."""
    keyed = B.edited(spark, sf_dir).select("id", "content", X.group_key(F.col("topic"), F.col("category"), F.col("external_id")).alias("key"))
    asked = lambda more: lambda rows: rows.groupBy("key").agg((F.min("id") % 25 + more).cast("string").alias("node_id"), F.lit(0.8).alias("confidence"))
    path = L.scratch(spark, "group-nodes")
    K.refresh_nodes(keyed, path, 1, "g-1", asked(0), "id", "content")
    changed = keyed.withColumn("content", F.when(F.col("id") % 50 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    found = K.refresh_nodes(changed, path, 2, "g-1", asked(1), "id", "content")
    return found.select("key", "run", F.element_at("nodes", 1)["node_id"].alias("node_id"))


@query(f"WITH {TAGS}, {LOG}, l AS (SELECT question_id, grade, row_number() OVER (PARTITION BY question_id ORDER BY answered_at DESC, id DESC) AS rn FROM g) SELECT node_id, count(*) AS wrong FROM t JOIN l USING (question_id) WHERE rn = 1 AND grade <> 'CORRECT' GROUP BY 1")
def wrong_by_node(spark, sf_dir):
    wrong = A.wrong_questions(B.attempts(spark, sf_dir)).select("question_id")
    return B.tags(spark, sf_dir).join(wrong, "question_id").groupBy("node_id").agg(F.count("*").alias("wrong"))


# --- packages and exchange -------------------------------------------------------------------------------


@query(f"""WITH {EDITED}, s AS (SELECT *, CASE bank_id WHEN 3 THEN 1 WHEN 1 THEN 2 WHEN 8 THEN 3 END AS ordinal FROM e WHERE bank_id IN (1, 3, 8)), f AS (SELECT external_id, min(ordinal) AS first FROM s GROUP BY 1)
SELECT id, CASE WHEN ordinal = first THEN external_id ELSE external_id || '-' || ordinal END AS new_key, CAST(row_number() OVER (ORDER BY ordinal, id) AS BIGINT) AS number FROM s JOIN f USING (external_id)""")
def merged_banks(spark, sf_dir):
    sources = spark.createDataFrame([(3, 1), (1, 2), (8, 3)], "bank_id long, ordinal int")
    return E.merge_banks(B.edited(spark, sf_dir).drop("number"), sources).select("id", "new_key", F.col("number").cast("long").alias("number"))


@query(f"""WITH {EDITED}, r AS (SELECT id, external_id, row_number() OVER (PARTITION BY external_id ORDER BY id) AS rn FROM e) SELECT id, CASE WHEN rn = 1 THEN external_id ELSE external_id || '-' || rn END AS unique_key FROM r""")
def unique_keys(spark, sf_dir):
    return E.unique_keys(B.edited(spark, sf_dir), "external_id", ["id"]).select("id", "unique_key")


@query(f"""WITH {EDITED}, old AS (SELECT bank_id, max(number) AS m FROM e WHERE id % 2 = 0 GROUP BY 1), new AS (SELECT * FROM e WHERE id % 2 = 1), given AS (SELECT bank_id, max(number) AS m FROM new GROUP BY 1),
r AS (SELECT id, bank_id, number, row_number() OVER (PARTITION BY bank_id, number IS NULL ORDER BY position) AS n FROM new)
SELECT id, CAST(coalesce(number, greatest(coalesce(old.m, 0), coalesce(given.m, 0)) + n) AS INT) AS number FROM r LEFT JOIN old USING (bank_id) LEFT JOIN given USING (bank_id)""")
def continued_numbers(spark, sf_dir):
    rows = B.edited(spark, sf_dir)
    old = rows.filter("id % 2 = 0").select("bank_id", "number")
    return E.continue_numbers(old, rows.filter("id % 2 = 1").select("id", "bank_id", "number", "position")).select("id", F.col("number").cast("int").alias("number"))


@query(f"WITH {EDITED} SELECT id, bank_id, external_id FROM e WHERE id >= 1000 AND (bank_id, external_id) NOT IN (SELECT (bank_id, external_id) FROM e WHERE id < 1000)")
def appended_package(spark, sf_dir):
    rows = B.edited(spark, sf_dir).select("id", "bank_id", "external_id")
    return E.append(rows.filter("id < 1000"), rows.filter("id >= 1000")).select("id", "bank_id", "external_id")


@query(f"""WITH {EDITED}, c AS (SELECT bank_id, external_id, sha256('{{"external_id":"' || external_id || '","id":' || id || ',"topic":"' || topic || '","number":' || coalesce(CAST(number AS VARCHAR), 'null') || '}}') AS c FROM e), x AS (SELECT bank_id, substr(sha256(external_id), 1, 3) AS k, sha256(string_agg(c, '' ORDER BY external_id, c)) AS c FROM c GROUP BY 1, 2) SELECT bank_id, sha256(string_agg(c, '' ORDER BY k, c)) AS checksum FROM x GROUP BY 1""")
def bank_checksums(spark, sf_dir):
    return E.bank_checksum(B.edited(spark, sf_dir).select("bank_id", "external_id", "id", "topic", "number"))


@query("""WITH b AS (SELECT c_mktsegment AS package_key, CAST(c_nationkey AS VARCHAR) AS version, CAST(max(c_custkey) % 3 AS VARCHAR) AS checksum FROM customer WHERE c_nationkey < 15 AND c_mktsegment <> 'FURNITURE' GROUP BY 1, 2),
p AS (SELECT c_mktsegment AS package_key, CAST(c_nationkey AS VARCHAR) AS version, CAST(min(c_custkey) % 3 AS VARCHAR) AS checksum FROM customer GROUP BY 1, 2)
SELECT p.package_key, p.version, CASE WHEN b.checksum = p.checksum THEN 'ALREADY_IMPORTED' WHEN b.checksum IS NOT NULL THEN 'BRANCHED' WHEN p.package_key IN (SELECT package_key FROM b) THEN 'VERSION_ADDED' ELSE 'CREATED' END AS decision
FROM p LEFT JOIN b ON b.package_key = p.package_key AND b.version = p.version""")
def import_decisions(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("package_key"), F.col("c_nationkey").cast("string").alias("version"), "c_custkey", "c_nationkey")
    banks = c.filter("c_nationkey < 15 AND package_key <> 'FURNITURE'").groupBy("package_key", "version").agg((F.max("c_custkey") % 3).cast("string").alias("checksum"))
    packages = c.groupBy("package_key", "version").agg((F.min("c_custkey") % 3).cast("string").alias("checksum"))
    return E.import_decision(packages, banks)


@query("""WITH v AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '1.' || p_size WHEN 1 THEN p_size || '.2.3' WHEN 2 THEN 'v' || p_size WHEN 3 THEN ' ' || p_size || ' ' END AS version FROM part)
SELECT id, CASE id % 5 WHEN 0 THEN trim(version) || '.1' WHEN 1 THEN split_part(version, '.', 1) || '.2.4' WHEN 3 THEN trim(version) || '.0.1' ELSE '1.0.0' END AS next FROM v""")
def next_versions(spark, sf_dir):
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    version = F.when(k == 0, F.concat(F.lit("1."), size)).when(k == 1, F.concat(size, F.lit(".2.3"))).when(k == 2, F.concat(F.lit("v"), size)).when(k == 3, F.concat(F.lit(" "), size, F.lit(" ")))
    return B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), E.next_version(version).alias("next"))


_RECORDS = f"""{LOG}, {EDITED}, keyed AS (SELECT id, bank_id, external_id || '/' || id AS question_key FROM e),
file AS (SELECT 'bank' || CASE WHEN g.id % 50 = 0 THEN 99 ELSE k.bank_id END AS package_key, CASE WHEN g.id % 31 = 0 THEN 'lost' ELSE k.question_key END AS question_key, answered_at, is_correct, self_grade FROM g JOIN keyed k ON k.id = g.question_id),
placed AS (SELECT file.*, k.id AS question_id, b.bank_id FROM file LEFT JOIN (SELECT DISTINCT bank_id, 'bank' || bank_id AS package_key FROM keyed) b USING (package_key) LEFT JOIN keyed k ON k.bank_id = b.bank_id AND k.question_key = file.question_key)"""


def _records(spark, sf_dir):
    q = B.edited(spark, sf_dir).select("id", "bank_id", F.concat("external_id", F.lit("/"), F.col("id").cast("string")).alias("external_id"))
    log = B.attempts(spark, sf_dir)
    key = F.when(log["id"] % 50 == 0, F.lit("bank99")).otherwise(F.concat(F.lit("bank"), q["bank_id"].cast("string")))
    file = log.join(q, log["question_id"] == q["id"]).select(
        key.alias("package_key"), F.lit("1.0.0").alias("version"), F.when(log["id"] % 31 == 0, "lost").otherwise(q["external_id"]).alias("question_key"), "answered_at", "is_correct", "self_grade", F.lit(None).cast("string").alias("selected_keys"), F.lit(None).cast("string").alias("user_answer")
    )
    banks = q.select("bank_id").distinct().select("bank_id", F.concat(F.lit("bank"), F.col("bank_id").cast("string")).alias("package_key"), F.lit("1.0.0").alias("version"))
    known = log.filter("id % 3 = 0").select("question_id", "answered_at", "is_correct", "self_grade", F.lit(None).cast("string").alias("selected_keys"), F.lit(None).cast("string").alias("user_answer"))
    return E.import_records(file, banks, q, known)


@query(f"""WITH {_RECORDS}, o AS (SELECT DISTINCT question_id, date_trunc('second', answered_at) AS second, is_correct, self_grade FROM g WHERE id % 3 = 0),
x AS (SELECT DISTINCT question_id, date_trunc('second', answered_at) AS second, is_correct, self_grade FROM placed WHERE question_id IS NOT NULL)
SELECT x.question_id, count(*) AS new_records FROM x WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.question_id = x.question_id AND o.second = x.second AND o.is_correct IS NOT DISTINCT FROM x.is_correct AND o.self_grade IS NOT DISTINCT FROM x.self_grade) GROUP BY 1""")
def imported_records(spark, sf_dir):
    return _records(spark, sf_dir)["new"].groupBy("question_id").agg(F.count("*").alias("new_records"))


@query(f"WITH {_RECORDS} SELECT DISTINCT bank_id, question_key FROM placed WHERE bank_id IS NOT NULL AND question_id IS NULL")
def records_without_question(spark, sf_dir):
    return _records(spark, sf_dir)["missing_questions"]


@query(f"WITH {EDITED} SELECT id, CASE WHEN trim(topic) = '' THEN category ELSE topic END AS topic FROM e")
def merged_category(spark, sf_dir):
    return E.merge_category(B.edited(spark, sf_dir)).select("id", "topic")


@query(f"WITH {EDITED} SELECT id, CASE WHEN id % 6 = 0 THEN NULL WHEN id % 6 = 3 THEN 'patched' ELSE topic END AS topic FROM e")
def patched_questions(spark, sf_dir):
    rows = B.edited(spark, sf_dir)
    patches = rows.filter("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, " ").otherwise("patched").alias("topic"))
    return E.patch(rows, patches, "id", ["topic"]).select("id", "topic")


@query(f"WITH {EDITED}, {LOG} SELECT 'question' AS \"table\", count(*) AS rows FROM e WHERE bank_id = 7 UNION ALL SELECT 'record', count(*) FROM g WHERE bank_id = 7")
def deleted_bank(spark, sf_dir):
    return E.delete_bank(7, {"question": B.edited(spark, sf_dir), "record": B.attempts(spark, sf_dir)})[1]


@query(f"WITH {EDITED}, m AS (SELECT DISTINCT content, topic FROM e), r AS (SELECT content, topic, min(id) AS keep FROM e GROUP BY 1, 2) SELECT id, keep FROM e JOIN r USING (content, topic)")
def remapped_copies(spark, sf_dir):
    rows = B.edited(spark, sf_dir)
    keep = rows.groupBy("content", "topic").agg(F.min("id").alias("keep"))
    return rows.join(keep, ["content", "topic"]).select("id", "keep")


@query(f"""WITH {EDITED}, k AS (SELECT id, list_filter(string_split(coalesce(answer_keys, ''), ','), lambda x: trim(x) <> '') AS keys, list_transform(options, lambda o: o.key) AS known, question_type, options, score FROM e)
SELECT id, 'options' AS rule FROM k WHERE question_type <> 'SUBJECTIVE' AND len(options) < 2
UNION ALL SELECT id, 'keys' FROM k WHERE question_type <> 'SUBJECTIVE' AND len(list_filter(keys, lambda x: NOT list_contains(known, x))) > 0""")
def rule_violations(spark, sf_dir):
    return schema.violations(B.edited(spark, sf_dir), "id", schema.question_rules())


@query(f"WITH {EDITED} SELECT bank_id, external_id, count(*) AS n FROM e GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return schema.duplicates(B.edited(spark, sf_dir), ["bank_id", "external_id"])


@query(f"WITH {EDITED} SELECT bank_id, id, CAST(floor((row_number() OVER (PARTITION BY bank_id ORDER BY id) - 1) / 10) AS BIGINT) AS batch FROM e WHERE coalesce(trim(answer_keys), '') = '' AND question_type <> 'SUBJECTIVE'")
def missing_answers(spark, sf_dir):
    return C.missing_answers(B.edited(spark, sf_dir))


# --- cards, conversations, jobs --------------------------------------------------------------------------


@query("SELECT conv_id AS session_id, turn AS id, CAST(rn AS INT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 8")
def recent_dialogue(spark, sf_dir):
    return C.tail(B.messages(spark, sf_dir)).select("session_id", "id", "n")


@query("SELECT conv_id AS session_id, CAST(coalesce(max(CASE WHEN role = 'assistant' THEN length(text) % 4 END), 0) AS INT) AS hint_level, count(*) AS messages FROM conversations GROUP BY 1")
def hint_levels(spark, sf_dir):
    return C.highest_hint(B.messages(spark, sf_dir).withColumn("hint_level", F.length("content") % 4))


@query(f"WITH {TAGS} SELECT doc_id % 10 AS bank_id, doc_id AS question_id, CAST(floor((row_number() OVER (PARTITION BY doc_id % 10 ORDER BY doc_id) - 1) / 20) AS BIGINT) AS batch FROM documents WHERE length(trim(text)) >= 20 AND doc_id IN (SELECT question_id FROM t) AND doc_id % 4 <> 0")
def card_candidates(spark, sf_dir):
    notes = B.notes(spark, sf_dir).select(F.col("note_id").alias("question_id"), (F.col("note_id") % 10).alias("bank_id"), F.col("content").alias("analysis"))
    have = notes.filter("question_id % 4 = 0").select("question_id")
    return C.candidates(notes, B.tags(spark, sf_dir), have)


_CARDS = "c AS (SELECT l_partkey * 10 + 0 AS card_id, l_partkey % 10 AS bank_id, CAST(max(l_quantity) AS INT) % 6 AS level, max(l_shipdate) AS due_at, CAST(count(*) AS INT) % 3 AS lapses, count(*) % 4 <> 0 AS confirmed FROM lineitem GROUP BY l_partkey)"


def _cards(spark, sf_dir):
    line = B.table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg((F.max("l_quantity").cast("int") % 6).alias("level"), F.max("l_shipdate").alias("due_at"), F.count("*").alias("n"))
    return line.select((F.col("l_partkey") * 10).alias("card_id"), (F.col("l_partkey") % 10).alias("bank_id"), "level", "due_at", (F.col("n") % 3).cast("int").alias("lapses"), (F.col("n") % 4 != 0).alias("confirmed"), F.lit(1).alias("interval_days"))


@query(f"WITH {_CARDS} SELECT bank_id, count(*) AS total, count(*) FILTER (WHERE NOT confirmed) AS unconfirmed, count(*) FILTER (WHERE confirmed AND due_at <= TIMESTAMP '2001-06-15 12:00:00') AS due, count(*) FILTER (WHERE level >= 3) AS learned FROM c GROUP BY 1")
def card_totals(spark, sf_dir):
    return C.totals(_cards(spark, sf_dir), AS_OF_SHIPPED.replace(year=2001))


@query(f"""WITH {_CARDS}, s AS (SELECT *, CASE WHEN card_id % 3 = 0 THEN card_id % 2 = 0 END AS ok, CASE WHEN card_id % 2 = 0 THEN least(level + 1, 5) ELSE 0 END AS up FROM c)
SELECT card_id, CAST(CASE WHEN ok IS NULL THEN level ELSE up END AS INT) AS level, CAST(CASE WHEN ok IS NULL THEN 1 WHEN up = 0 THEN 1 ELSE least(CAST(pow(2, up) AS INT), 30) END AS INT) AS interval_days,
  CASE WHEN ok IS NULL THEN due_at WHEN ok THEN TIMESTAMP '2001-06-15 12:00:00' + to_days(CAST(least(CAST(pow(2, up) AS INT), 30) AS INT)) ELSE TIMESTAMP '2001-06-15 12:00:00' END AS due_at, CAST(lapses + CASE WHEN NOT ok THEN 1 ELSE 0 END AS INT) AS lapses FROM s""")
def card_steps(spark, sf_dir):
    cards = _cards(spark, sf_dir)
    answers = cards.filter("card_id % 3 = 0").select("card_id", (F.col("card_id") % 2 == 0).alias("remembered"), F.lit(AS_OF_SHIPPED.replace(year=2001)).cast("timestamp_ntz").alias("answered_at"))
    return C.step(cards, answers)


@query("""WITH j AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'O' THEN 'PENDING' ELSE 'FINISHED' END AS status, date_diff('minute', o_orderdate, TIMESTAMP '1999-06-15 12:00:00') AS age FROM orders)
SELECT job_id, CASE WHEN status = 'PENDING' AND age > 10 THEN 'STALE' WHEN status = 'PENDING' THEN 'ACTIVE' WHEN age > 10080 THEN 'EXPIRED' ELSE 'DONE' END AS state FROM j""")
def job_states(spark, sf_dir):
    jobs = B.sessions(spark, sf_dir).select(F.col("session_id").alias("job_id"), F.when(F.col("status") == "O", "PENDING").otherwise("FINISHED").alias("status"), F.col("created_at").alias("updated_at"))
    return C.job_states(jobs, AS_OF_SHIPPED)


@query(f"WITH {LOG} SELECT id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || ' min' WHEN m < 1440 THEN CAST(floor(m / 60) AS BIGINT) || ' h' ELSE CAST(floor(m / 1440) AS BIGINT) || ' d' END AS ago FROM (SELECT id, CAST(trunc(epoch_us(TIMESTAMP '2024-01-30 12:00:00' - answered_at) / 60000000) AS BIGINT) AS m FROM g)")
def time_ago(spark, sf_dir):
    return B.attempts(spark, sf_dir).select("id", Q.ago(F.col("answered_at"), AS_OF).alias("ago"))
