"""Queries over submissions, tags, exports, conversations and the smaller services."""

from __future__ import annotations

from pyspark.sql import functions as F

from studylake import schema
from studylake.functions import rules
from studylake.functions import text as X
from studylake.operators import cards as C
from studylake.operators import exchange as E
from studylake.operators import review as R
from studylake.operators import search as Q
from studylake.operators import sessions as S
from studylake.operators import skills as K
from studylake.operators import stats as T
from studylake.sources import bindings as B

from .base import AS_OF, EDITED, LOG, QUESTIONS, STATES, query
from .catalog_queries import LINKS, NODES, TAGS

# --- submissions and sessions ----------------------------------------------------------------------------

_GIVEN = ["A,C", "b", "", None]


@query(f"""WITH {EDITED}, a AS (SELECT l_orderkey * 10 + l_linenumber AS answer_id, CASE WHEN l_partkey % 17 = 0 THEN -1 ELSE l_partkey END AS question_id,
  CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_orderkey % 11 = 0 THEN -l_orderkey ELSE l_orderkey END AS session_id, (['A,C', 'b', '', NULL])[CAST(l_quantity AS INT) % 4 + 1] AS given, CASE WHEN l_tax > 0.04 THEN 'text' ELSE ' ' END AS said FROM lineitem),
s AS (SELECT o_orderkey AS session_id, o_orderkey % 2 + 3 AS bank_id, o_orderstatus = 'F' AS finished FROM orders), own AS (SELECT DISTINCT l_orderkey AS session_id, l_partkey AS question_id FROM lineitem WHERE l_linenumber <= 5),
keys AS (SELECT id, list_sort(list_distinct(list_filter(list_transform(string_split(coalesce(answer_keys, ''), ','), lambda k: upper(trim(k))), lambda k: k <> ''))) AS k FROM e),
j AS (SELECT a.answer_id, e.bank_id, question_type, k, list_sort(list_distinct(list_filter(list_transform(string_split(coalesce(given, ''), ','), lambda x: upper(trim(x))), lambda x: x <> ''))) AS mine,
  CASE WHEN e.id IS NULL THEN 'NO_QUESTION' WHEN a.session_id IS NOT NULL AND s.session_id IS NULL THEN 'NO_SESSION' WHEN a.session_id IS NOT NULL AND s.bank_id <> e.bank_id THEN 'OTHER_BANK' WHEN a.session_id IS NOT NULL AND finished THEN 'FINISHED'
    WHEN a.session_id IS NOT NULL AND own.question_id IS NULL THEN 'NOT_IN_SESSION' WHEN question_type = 'SUBJECTIVE' AND trim(said) = '' THEN 'NO_TEXT' WHEN question_type <> 'SUBJECTIVE' AND len(mine) = 0 THEN 'NO_SELECTION' END AS error
  FROM a LEFT JOIN e ON e.id = a.question_id LEFT JOIN keys ON keys.id = a.question_id LEFT JOIN s USING (session_id) LEFT JOIN own ON own.session_id = a.session_id AND own.question_id = a.question_id)
SELECT bank_id, error, CASE WHEN error IS NULL AND question_type <> 'SUBJECTIVE' AND len(k) > 0 THEN len(mine) > 0 AND mine = k END AS is_correct, count(*) AS n FROM j GROUP BY ALL""")
def submitted_answers(spark, sf_dir):
    line = B.table(spark, sf_dir, "lineitem")
    given = F.element_at(F.array(*[F.lit(g) for g in _GIVEN]), (F.col("l_quantity").cast("int") % 4 + 1))
    key = F.col("l_orderkey")
    session = F.when(key % 3 == 0, F.lit(None)).when(key % 11 == 0, -key).otherwise(key)
    answers = line.select((key * 10 + F.col("l_linenumber")).alias("answer_id"), F.when(F.col("l_partkey") % 17 == 0, -1).otherwise(F.col("l_partkey")).alias("question_id"), session.alias("session_id"), given.alias("selected_keys"), F.when(F.col("l_tax") > 0.04, "text").otherwise(" ").alias("user_answer"))
    sessions = B.sessions(spark, sf_dir).select("session_id", (F.col("session_id") % 2 + 3).alias("bank_id"), (F.col("status") == "F").alias("finished"))
    own = line.filter("l_linenumber <= 5").select(key.alias("session_id"), F.col("l_partkey").alias("question_id"))
    judged = S.submit(answers, B.edited(spark, sf_dir), sessions, own)
    return judged.groupBy("bank_id", "error", "is_correct").agg(F.count("*").alias("n"))


@query(f"""WITH {LOG}, {STATES}, j AS (SELECT p_partkey AS question_id, p_partkey % 10 AS bank_id, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 3 = 1 END AS ok FROM part WHERE p_partkey % 2 = 0),
x AS (SELECT coalesce(s.question_id, j.question_id) AS question_id, coalesce(s.bank_id, j.bank_id) AS bank_id, ok, CASE WHEN ok THEN least(coalesce(level, 0) + 1, 5) WHEN NOT ok THEN 0 ELSE level END AS level, interval_days, due_at FROM s FULL JOIN (SELECT * FROM j WHERE ok IS NOT NULL) j ON j.question_id = s.question_id)
SELECT question_id, bank_id, CAST(level AS INT) AS level, CAST(CASE WHEN ok IS NULL THEN interval_days WHEN level = 0 THEN 1 ELSE least(CAST(pow(2, level) AS INT), 30) END AS INT) AS interval_days,
  CASE WHEN ok IS NULL THEN due_at WHEN ok THEN TIMESTAMP '2024-01-30 12:00:00' + to_days(CAST(least(CAST(pow(2, level) AS INT), 30) AS INT)) ELSE TIMESTAMP '2024-01-30 12:00:00' END AS due_at FROM x""")
def states_after_answers(spark, sf_dir):
    k = F.col("p_size") % 3
    judged = B.table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("question_id"), (F.col("p_partkey") % 10).alias("bank_id"), F.when(k != 0, k == 1).alias("is_correct"), F.lit(None).cast("string").alias("error"))
    return S.stepped_states(R.states(B.attempts(spark, sf_dir)), judged, AS_OF)


@query(f"""WITH {LOG}, raw AS (SELECT * REPLACE (CASE WHEN coalesce(is_correct, self_grade = 'CORRECT') THEN 'CORRECT' WHEN NOT coalesce(is_correct, self_grade = 'CORRECT') THEN 'WRONG' END AS grade) FROM g),
{STATES.replace("FROM g WHERE grade", "FROM raw WHERE grade")}
SELECT question_id, bank_id, level, interval_days, due_at FROM s WHERE question_id IN (SELECT question_id FROM g WHERE id % 3 <> 0) AND question_id % 2 = 1""")
def states_after_import(spark, sf_dir):
    """Odd questions have no state before the import of two thirds of the log."""
    log = B.attempts(spark, sf_dir)
    have = R.states(log).filter("question_id % 2 = 0")
    return E.rebuilt_states(log.filter("id % 3 <> 0"), log.filter("id % 3 = 0"), have).filter("question_id % 2 = 1").drop("suspended")


@query("SELECT o_orderkey AS session_id, l_partkey AS question_id, bool_or(l_linenumber <= 3) AS known FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def session_membership(spark, sf_dir):
    line = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("question_id"), "l_linenumber")
    parts = B.parts(line)
    sessions = B.sessions(spark, sf_dir).select("session_id").repartition(parts, "session_id")
    asked = line.repartition(parts, "session_id").join(sessions, "session_id", "left_semi")
    return S.contains(line.filter("l_linenumber <= 3"), asked, parts)


@query("SELECT o_orderkey AS session_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE o_orderpriority || ',' || o_orderstatus END AS scope_topics, CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus END AS scope_categories FROM orders")
def session_scopes(spark, sf_dir):
    orders, k = B.table(spark, sf_dir, "orders"), F.col("o_orderkey") % 3
    none = F.array().cast("array<string>")
    topics = F.when(k == 0, none).when(k == 1, F.array("o_orderpriority")).otherwise(F.array("o_orderpriority", "o_orderstatus"))
    asked = orders.select(F.col("o_orderkey").alias("session_id"), topics.alias("topics"), F.when(F.col("o_custkey") % 2 == 0, F.array("o_orderstatus")).alias("categories"))
    return S.scopes(asked)


_RECORDS = "r AS (SELECT l_orderkey AS session_id, l_partkey AS question_id, CASE WHEN l_quantity < 10 THEN NULL WHEN l_linestatus = 'F' THEN 'CORRECT' ELSE 'WRONG' END AS grade FROM lineitem)"


def _session_records(spark, sf_dir):
    grade = F.when(F.col("l_quantity") < 10, None).when(F.col("l_linestatus") == "F", "CORRECT").otherwise("WRONG")
    return B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("question_id"), grade.alias("grade"))


@query(f"WITH {_RECORDS} SELECT session_id, count(*) AS total, count(*) FILTER (WHERE grade = 'CORRECT') AS correct, count(*) FILTER (WHERE grade = 'WRONG') AS wrong, count(*) FILTER (WHERE grade IS NULL) AS undecided FROM r GROUP BY 1")
def session_review(spark, sf_dir):
    return S.review_totals(_session_records(spark, sf_dir))


@query(f"""WITH {_RECORDS}, {TAGS}, u AS (SELECT DISTINCT question_id, node_id FROM t), w AS (SELECT session_id, node_id, count(*) AS wrong FROM r JOIN u USING (question_id) WHERE grade = 'WRONG' GROUP BY 1, 2),
n AS (SELECT node_id, count(grade) AS n, count(*) FILTER (WHERE grade = 'CORRECT') AS ok FROM r JOIN u USING (question_id) GROUP BY 1)
SELECT session_id, node_id, wrong, CAST(CASE WHEN n > 0 THEN floor(ok * 100 / n + 0.5) ELSE -1 END AS BIGINT) AS rate FROM w JOIN n USING (node_id)""")
def session_review_by_node(spark, sf_dir):
    records = _session_records(spark, sf_dir)
    return S.review_by_node(records, B.tags(spark, sf_dir), records)


@query("WITH a AS (SELECT c_nationkey % 10 AS bank_id, count(*) AS questions, CAST(sum(c_custkey) AS BIGINT) AS records FROM customer GROUP BY 1) SELECT CAST(coalesce(sum(questions), 0) AS BIGINT) AS questions, CAST(coalesce(sum(records), 0) AS BIGINT) AS records FROM a WHERE bank_id IN (2, 3, 99)")
def selected_banks(spark, sf_dir):
    per = B.table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") % 10).alias("bank_id")).agg(F.count("*").alias("questions"), F.sum("c_custkey").alias("records"))
    return T.selected_sum(per, [2, 3, 99], "questions", "records")


@query("SELECT l_suppkey AS bank_id, count(*) AS total, CAST(ceil(count(*) / 20) AS BIGINT) AS pages FROM lineitem GROUP BY 1")
def page_counts(spark, sf_dir):
    return B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("bank_id")).agg(F.count("*").alias("total")).withColumn("pages", rules.page_count(F.col("total"), 20))


# --- tags ------------------------------------------------------------------------------------------------

_SET = f"{TAGS}, {QUESTIONS}, p AS (SELECT question_id, bool_or(confirmed) AS c, bool_or(source = 'ai') AS a FROM t GROUP BY 1), st AS (SELECT q.id AS question_id, CASE WHEN c THEN 'CONFIRMED' WHEN a THEN 'SUGGESTED' ELSE 'UNTAGGED' END AS state FROM q LEFT JOIN p ON p.question_id = q.id)"


def _ids(spark, sf_dir):
    return B.questions(spark, sf_dir).select(F.col("id").alias("question_id"))


@query(f"WITH {_SET} SELECT question_id, state FROM st WHERE state = 'SUGGESTED'")
def tag_review(spark, sf_dir):
    return K.matching(_ids(spark, sf_dir), B.tags(spark, sf_dir), "SUGGESTED")


@query(f"WITH {_SET} SELECT question_id, state FROM st WHERE question_id IN (SELECT question_id FROM t WHERE node_id = '7')")
def tag_review_of_node(spark, sf_dir):
    return K.matching(_ids(spark, sf_dir), B.tags(spark, sf_dir), None, "7")


@query(f"WITH {TAGS}, {NODES} SELECT question_id, string_agg(node_id || ':' || name || ':' || source, ',' ORDER BY node_id) AS tags FROM t JOIN n USING (node_id) WHERE question_id IN (SELECT p_partkey FROM part) GROUP BY 1")
def tags_of_questions(spark, sf_dir):
    found = K.tags_of(_ids(spark, sf_dir), B.tags(spark, sf_dir), B.skill_nodes(spark, sf_dir))
    return found.select("question_id", F.array_join(F.transform("tags", lambda t: F.concat_ws(":", t["node_id"], t["name"], t["source"])), ",").alias("tags"))


@query(f"WITH {TAGS} SELECT question_id, node_id, source, confidence, confirmed OR (source = 'ai' AND node_id = '4') AS confirmed FROM t")
def confirmed_tags(spark, sf_dir):
    return K.apply("confirm", B.tags(spark, sf_dir), B.skill_nodes(spark, sf_dir), node_id="4")[0]


@query(f"WITH {TAGS} SELECT * FROM t WHERE NOT (source = 'ai' AND NOT confirmed AND question_id % 2 = 0)")
def rejected_tags(spark, sf_dir):
    scope = _ids(spark, sf_dir).union(B.tags(spark, sf_dir).select("question_id")).filter("question_id % 2 = 0")
    return K.apply("reject", B.tags(spark, sf_dir), B.skill_nodes(spark, sf_dir), questions=scope)[0]


@query(f"""WITH {TAGS}, a AS (SELECT DISTINCT question_id FROM t WHERE source = 'ai' AND node_id = '9')
SELECT * FROM t WHERE NOT (question_id IN (SELECT question_id FROM a) AND source IN ('ai', 'user')) UNION ALL SELECT question_id, node, 'user', 1.0::DOUBLE, true FROM a, (VALUES ('3'), ('12')) v(node)""")
def retagged(spark, sf_dir):
    return K.apply("retag", B.tags(spark, sf_dir), B.skill_nodes(spark, sf_dir), node_id="9", new_nodes=["3", "12", "gone"])[0]


@query(f"WITH {TAGS} SELECT 'confirm' AS action, count(DISTINCT question_id) AS questions FROM t WHERE source = 'ai' AND NOT confirmed UNION ALL SELECT 'set', (SELECT count(*) FROM part WHERE p_size = 1) UNION ALL SELECT 'set without a scope', 0")
def tag_action_counts(spark, sf_dir):
    tags, nodes = B.tags(spark, sf_dir), B.skill_nodes(spark, sf_dir)
    chosen = B.table(spark, sf_dir, "part").filter("p_size = 1").select(F.col("p_partkey").alias("question_id"))
    found = {"confirm": K.apply("confirm", tags, nodes)[1], "set": K.apply("set", tags, nodes, questions=chosen, new_nodes=["1"])[1], "set without a scope": K.apply("set", tags, nodes, new_nodes=["1"])[1]}
    parts = [df.agg(F.count("*").alias("questions")).select(F.lit(name).alias("action"), "questions") for name, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {NODES} SELECT stage, string_agg(node_id || ' ' || name, chr(10) ORDER BY node_id || ' ' || name) AS text FROM n GROUP BY 1")
def node_catalogue(spark, sf_dir):
    return K.catalogue(B.skill_nodes(spark, sf_dir))


@query(f"""WITH {NODES} SELECT coalesce(n.node_id, a.node_id) AS node_id, coalesce(a.name, n.name) AS name, n.name AS official_name, CASE WHEN coalesce(n.node_id, a.node_id) IN ('10', '5') THEN 'DISABLED' WHEN n.name IS NULL THEN 'ADDED' WHEN a.name IS NOT NULL THEN 'RENAMED' ELSE 'OFFICIAL' END AS kind
FROM n FULL JOIN (VALUES ('7', 'Renamed'), ('own', 'Added')) a(node_id, name) ON a.node_id = n.node_id""")
def customisation_view(spark, sf_dir):
    added = spark.createDataFrame([("7", "Renamed"), ("own", "Added")], "node_id string, name string")
    off = spark.createDataFrame([("10",), ("5",), ("5",)], "node_id string")
    return K.customisation(B.skill_nodes(spark, sf_dir), added, off)


@query("SELECT 'region' AS \"templateId\", count(DISTINCT n_regionkey) AS stages, count(*) AS nodes FROM nation")
def template_sizes(spark, sf_dir):
    nodes = B.skill_nodes(spark, sf_dir).select(F.lit("region").alias("templateId"), F.col("stage").alias("stage_id"), "node_id")
    return K.template_sizes(nodes)


@query(f"WITH {NODES} SELECT node_id, '1.0.0-' || substr(sha256(name), 1, 8) AS version FROM n")
def graph_versions(spark, sf_dir):
    return B.skill_nodes(spark, sf_dir).select("node_id", K.graph_version(F.lit("1.0.0"), F.col("name")).alias("version"))


# --- tutor, cards ----------------------------------------------------------------------------------------


@query(f"""WITH {LOG}, l AS (SELECT question_id, grade, row_number() OVER (PARTITION BY question_id ORDER BY answered_at DESC, id DESC) AS rn FROM g)
SELECT p_partkey AS question_id, CASE WHEN p_size % 5 = 0 THEN 'NEUTRAL' WHEN p_size % 5 = 1 THEN 'WRONG' WHEN grade <> 'CORRECT' THEN 'WRONG' ELSE 'NEUTRAL' END AS mode FROM part LEFT JOIN l ON l.question_id = p_partkey AND rn = 1""")
def explanation_modes(spark, sf_dir):
    k = F.col("p_size") % 5
    asked = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"), F.when(k == 0, "neutral").when(k == 1, "Wrong").when(k == 2, "other").alias("requested"))
    return C.explanation_modes(asked, B.attempts(spark, sf_dir))


@query("""WITH t AS (SELECT o_orderkey AS conversation_id, o_custkey AS question_id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey % 2 END AS ps, o_orderpriority AS kind, o_orderstatus = 'F' AS closed, o_orderdate AS ts FROM orders),
a AS (SELECT DISTINCT question_id, ps, kind FROM t) SELECT a.question_id, a.ps AS practice_session_id, a.kind, (SELECT arg_max(conversation_id, {'ts': ts, 'id': conversation_id}) FROM t WHERE t.question_id = a.question_id AND t.ps IS NOT DISTINCT FROM a.ps AND t.kind = a.kind AND NOT closed) AS conversation_id FROM a""")
def open_conversations(spark, sf_dir):
    rows = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("conversation_id"), F.col("o_custkey").alias("question_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 2).alias("practice_session_id"), F.col("o_orderpriority").alias("kind"), (F.col("o_orderstatus") == "F").alias("closed"), F.col("o_orderdate").alias("updated_at"))
    return C.conversations(rows.select("question_id", "practice_session_id", "kind").distinct(), rows)


@query(f"""WITH {LOG}, {TAGS}, o AS (SELECT question_id, count(*) FILTER (WHERE grade <> 'CORRECT') AS wrong_times, max(answered_at) AS last_at, count(grade) AS n, count(*) FILTER (WHERE grade = 'CORRECT') AS ok FROM g GROUP BY 1), u AS (SELECT DISTINCT question_id, node_id FROM t),
n AS (SELECT node_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(ok) AS BIGINT) AS ok FROM u JOIN o USING (question_id) GROUP BY 1), w AS (SELECT node_id, node_id || ': ' || CASE WHEN ok / n >= 0.8 THEN '较好' WHEN ok / n >= 0.5 THEN '一般' ELSE '较弱' END AS text FROM n WHERE n >= 3),
x AS (SELECT question_id, string_agg(text, '; ' ORDER BY text) AS phrases FROM u JOIN w USING (node_id) GROUP BY 1)
SELECT question_id, wrong_times, last_at, coalesce(phrases, '') AS phrases FROM o LEFT JOIN x USING (question_id) WHERE wrong_times > 0""")
def question_histories(spark, sf_dir):
    return C.question_history(B.attempts(spark, sf_dir), B.tags(spark, sf_dir))


@query("WITH a AS (SELECT l_partkey AS question_id, l_shipdate AS t, l_orderkey * 10 + l_linenumber AS c, l_extendedprice AS x, l_linestatus = 'F' AS ok FROM lineitem) SELECT question_id, CASE WHEN arg_max(ok, {'t': t, 'c': c + x / 1e7}) THEN 'REMEMBERED' ELSE 'FORGOTTEN' END AS last_result FROM a GROUP BY 1")
def last_card_results(spark, sf_dir):
    card = F.col("l_orderkey") * 10 + F.col("l_linenumber") + F.col("l_extendedprice") / 1e7
    rows = B.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("question_id"), F.col("l_shipdate").alias("answered_at"), card.alias("card_id"), (F.col("l_linestatus") == "F").alias("remembered"))
    return C.last_results(rows)


# --- exports, materials, banks ---------------------------------------------------------------------------


@query("""WITH b AS (SELECT c_custkey AS bank_id, CASE WHEN c_custkey % 5 = 0 THEN ' ' WHEN c_custkey % 5 <> 1 THEN c_mktsegment END AS package_key, CASE WHEN c_custkey % 3 = 0 THEN 'x' WHEN c_custkey % 3 = 1 THEN 'y' END AS checksum, 'x' AS current, CASE WHEN c_custkey % 7 <> 0 THEN '1.0.0' END AS version, CASE c_custkey % 4 WHEN 0 THEN '1.0.1' WHEN 1 THEN '1.0.0' END AS asked, (['upgrade', 'BRANCH', 'auto', NULL])[c_nationkey % 4 + 1] AS mode, c_nationkey % 2 = 0 AS whole FROM customer)
SELECT bank_id, CASE WHEN coalesce(trim(package_key), '') = '' THEN CASE WHEN whole THEN 'CLAIM' ELSE 'TEMPORARY' END WHEN upper(mode) = 'UPGRADE' THEN CASE WHEN checksum IS DISTINCT FROM current THEN 'UPGRADE' ELSE 'KEEP' END WHEN upper(mode) = 'BRANCH' OR checksum IS DISTINCT FROM current THEN 'BRANCH' ELSE 'KEEP' END AS action,
  CASE WHEN checksum = current AND version IS NOT NULL AND coalesce(asked, version) <> version THEN 'VERSION_WITHOUT_CHANGE' END AS error FROM b""")
def export_identities(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    modes = F.element_at(F.array(*[F.lit(m) for m in ("upgrade", "BRANCH", "auto", None)]), n % 4 + 1)
    banks = B.table(spark, sf_dir, "customer").select(k.alias("bank_id"), F.when(k % 5 == 0, " ").when(k % 5 != 1, F.col("c_mktsegment")).alias("package_key"), F.when(k % 3 == 0, "x").when(k % 3 == 1, "y").alias("checksum"), F.lit("x").alias("current"), F.when(k % 7 != 0, "1.0.0").alias("version"), F.when(k % 4 == 0, "1.0.1").when(k % 4 == 1, "1.0.0").alias("asked"), modes.alias("mode"), (n % 2 == 0).alias("whole"))
    return E.export_identity(banks)


_TAKEN = f"{EDITED}, x AS (SELECT * FROM e WHERE bank_id = 4 AND favorite AND topic IN ('ECONOMY', 'LARGE', 'SMALL', 'MEDIUM'))"


def _taken(spark, sf_dir):
    return E.export_questions(B.edited(spark, sf_dir).filter("bank_id = 4"), "favorite", ["ECONOMY", "LARGE", "SMALL", "MEDIUM"], [])


@query(f"WITH {_TAKEN} SELECT id, topic FROM x")
def exported_questions(spark, sf_dir):
    return _taken(spark, sf_dir).select("id", "topic")


def _materials(spark, sf_dir):
    return B.table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("material_id"), F.col("p_name").alias("content"))


@query(f"WITH {_TAKEN} SELECT p_partkey - 1 AS material_id, 'material-' || (p_partkey - 1) AS material_key, p_name AS content FROM part WHERE p_partkey - 1 IN (SELECT material_id FROM x)")
def exported_materials(spark, sf_dir):
    return E.referenced_materials(_materials(spark, sf_dir), _taken(spark, sf_dir))


@query("SELECT o_orderkey AS id, o_orderdate AS created_at, o_orderstatus = 'F' OR o_orderkey % 7 = 0 AS published FROM orders WHERE o_orderkey % 5 <> 0")
def export_records(spark, sf_dir):
    rows = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", True).alias("published"))
    return E.mark_published(rows, rows.filter("id % 7 = 0"), rows.filter("id % 5 = 0"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 1.0 ELSE p_size / 10 END::DOUBLE AS score, false AS favorite, false AS deleted FROM part")
def created_questions(spark, sf_dir):
    rows = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 != 0, F.col("p_size") / 10).alias("score"))
    return E.created_questions(rows)


@query(f"WITH {EDITED} SELECT id, CASE WHEN id % 4 = 0 THEN 'SUBJECTIVE' ELSE question_type END AS question_type, CASE WHEN id % 4 = 0 OR question_type = 'SUBJECTIVE' THEN NULL ELSE CAST(len(options) AS INT) END AS n_options, CASE WHEN id % 4 = 0 OR question_type = 'SUBJECTIVE' THEN NULL ELSE answer_keys END AS answer_keys FROM e")
def questions_made_subjective(spark, sf_dir):
    rows = B.edited(spark, sf_dir)
    patches = rows.filter("id % 4 = 0").select("id", F.lit("SUBJECTIVE").alias("question_type"))
    return E.patched_questions(rows, patches, ["question_type"]).select("id", "question_type", F.when(F.col("options").isNotNull(), F.size("options")).alias("n_options"), "answer_keys")


@query("SELECT CAST(n_nationkey AS BIGINT) AS bank_id, CASE WHEN n_nationkey % 3 = 0 THEN 'new ' || n_name ELSE n_name END AS name, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey % 2 = 0 ELSE true END AS review_enabled FROM nation")
def patched_banks(spark, sf_dir):
    banks = B.banks(spark, sf_dir).withColumn("review_enabled", F.lit(True))
    patches = banks.filter("bank_id % 3 = 0").select("bank_id", F.concat(F.lit("new "), "name").alias("name"), (F.col("bank_id") % 2 == 0).alias("review_enabled"))
    return E.patch(banks, patches, "bank_id", ["name", "review_enabled"]).select("bank_id", "name", "review_enabled")


@query(f"WITH {EDITED} SELECT id, CASE WHEN material_id <> 3 THEN material_id END AS material_id FROM e")
def questions_without_material(spark, sf_dir):
    return E.without_material(B.edited(spark, sf_dir), 3).select("id", "material_id")


@query("""WITH s AS (SELECT p_brand AS document, p_type AS material, p_name AS content, 0 AS source, p_partkey AS id FROM part WHERE p_size < 10 UNION ALL SELECT p_brand, p_type, p_name, 1, p_partkey FROM part WHERE p_size >= 5)
SELECT document, material, arg_min(content, {'s': source, 'c': content}) AS content, min(source) AS source FROM s GROUP BY 1, 2""")
def merged_materials(spark, sf_dir):
    rows = B.table(spark, sf_dir, "part").select(F.col("p_brand").alias("document"), F.col("p_type").alias("material"), F.col("p_name").alias("content"), "p_size")
    return E.merged_materials(rows.filter("p_size < 10"), rows.filter("p_size >= 5"))


# --- scalars ---------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, regexp_matches(text, '==[^=\n]*==|\*\*[^*\n]+\*\*|__[^_\n]+__') AS marked FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '==' || substr(text, 1, 9) || '==' WHEN 1 THEN '**' || substr(text, 1, 30) || '** and' WHEN 2 THEN '__' || substr(text, 1, 5) ELSE text END AS text FROM documents)""")
def marked_notes(spark, sf_dir):
    t, k = F.col("text"), F.col("doc_id") % 4
    made = F.when(k == 0, F.concat(F.lit("=="), F.substring(t, 1, 9), F.lit("=="))).when(k == 1, F.concat(F.lit("**"), F.substring(t, 1, 30), F.lit("** and"))).when(k == 2, F.concat(F.lit("__"), F.substring(t, 1, 5))).otherwise(t)
    return B.table(spark, sf_dir, "documents").select("doc_id", X.has_marks(made).alias("marked"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN '<table><tr><td colspan="' || p_size || '">' || p_name || '</td></tr></table>' ELSE '<table><tr><td>' || p_name || '</td></tr></table>' END AS html FROM part""")
def clean_tables(spark, sf_dir):
    span = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(' colspan="'), F.col("p_size").cast("string"), F.lit('"'))).otherwise("")
    html = F.concat(F.lit('<div><script>alert("x < y")</script><table class="a" onclick="b()"><tr><td style="color: red"'), span, F.lit(" id=x><b>"), "p_name", F.lit("</b></td></tr></table></div>"))
    return B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.table_html(html).alias("html"))


@query("""SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'https://d.org' WHEN 1 THEN 'http://h' || p_size || '.org/a' WHEN 4 THEN 'HTTPS://x.org:80' END AS base, CASE p_size % 6 WHEN 0 THEN 'https://d.org/api' WHEN 1 THEN 'http://h' || p_size || '.org/a/api' WHEN 4 THEN 'HTTPS://x.org:80/api' END AS address FROM part""")
def base_addresses(spark, sf_dir):
    k, n = F.col("p_size") % 6, F.col("p_size").cast("string")
    raw = F.when(k == 0, "  ").when(k == 1, F.concat(F.lit(" http://h"), n, F.lit(".org/a//"))).when(k == 2, F.concat(F.lit("http://h.org?q="), n)).when(k == 3, "ftp://h.org").when(k == 4, "HTTPS://x.org:80/").otherwise("http://h.org/#top")
    base = X.base_address(raw, "https://d.org/")
    return B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), base.alias("base"), X.appended(base, F.lit("/api")).alias("address"))


@query("SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_type END AS name FROM part")
def first_names(spark, sf_dir):
    k = F.col("p_size") % 4
    fields = [F.when(k == 0, F.concat(F.lit(" "), "p_name")).otherwise(" "), F.when(k == 1, F.col("p_brand")), F.when(k == 2, F.concat("p_type", F.lit("  "))).otherwise("")]
    return B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.first_filled(*fields).alias("name"))


@query("SELECT c_custkey AS id, to_base64(encode(c_name)) AS code, c_name AS name, c_custkey % 3 <> 0 AS fine FROM customer")
def encoded_names(spark, sf_dir):
    code = F.base64(F.encode("c_name", "UTF-8"))
    back = X.decoded(F.when(F.col("c_custkey") % 3 == 0, F.concat(code, F.lit("*"))).otherwise(code))
    return B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), code.alias("code"), F.decode(X.decoded(code), "UTF-8").alias("name"), back.isNotNull().alias("fine"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id % 9 WHEN 1 THEN event_id % 9 END AS version FROM events")
def strict_numbers(spark, sf_dir):
    """JSON scalars: 3 and 3.0 are numbers, "3", 3.5 and true are none."""
    n, k = (F.col("event_id") % 9).cast("string"), F.col("event_id") % 5
    raw = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit(".0"))).when(k == 2, F.concat(F.lit('"'), n, F.lit('"'))).when(k == 3, F.concat(n, F.lit(".5"))).otherwise("true")
    return B.table(spark, sf_dir, "events").select("event_id", rules.same_kind_number(F.try_parse_json(raw)).alias("version"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN p_brand || ',' || p_type ELSE p_type END AS list FROM part")
def clean_lists(spark, sf_dir):
    raw = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" "), "p_brand", F.lit(" ,, "), "p_type", F.lit(","))).otherwise(F.concat(F.lit(", "), "p_type"))
    return B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.clean_list(raw).alias("list"))


@query(f"WITH {EDITED}, r AS (SELECT *, row_number() OVER (PARTITION BY bank_id, external_id ORDER BY id) AS n FROM e) SELECT id, bank_id, external_id FROM r WHERE n = 1")
def first_of_keys(spark, sf_dir):
    return schema.enforce_first(B.edited(spark, sf_dir), ["bank_id", "external_id"], [F.asc("id")]).select("id", "bank_id", "external_id")


@query("SELECT doc_id, length(text) > 2000 OR length(source) > 3 AS too_long FROM documents")
def long_notes(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", schema.too_long({"text": 2000, "source": 3}).alias("too_long"))


@query(f"WITH {LOG}, {STATES}, x AS (SELECT p_partkey AS question_id FROM part WHERE p_size < 25) SELECT s.question_id, x.question_id IS NOT NULL AS suspended FROM s LEFT JOIN x ON x.question_id = s.question_id")
def suspended_states(spark, sf_dir):
    chosen = B.table(spark, sf_dir, "part").filter("p_size < 25").select(F.col("p_partkey").alias("question_id"))
    return R.suspend(R.states(B.attempts(spark, sf_dir)), chosen).select("question_id", "suspended")


# --- notes, resets, limits -------------------------------------------------------------------------------


@query(f"WITH {LINKS}, {QUESTIONS} SELECT doc_id AS note_id, source AS color FROM documents WHERE contains(text, 'e') AND source = (SELECT max(source) FROM documents) AND doc_id IN (SELECT note_id FROM k WHERE (target_type = 'BANK' AND target_id = 6) OR (target_type = 'QUESTION' AND target_id IN (SELECT id FROM q WHERE bank_id = 6)))")
def note_list(spark, sf_dir):
    notes = B.notes(spark, sf_dir)
    colour = notes.agg(F.max("color")).first()[0]
    return Q.note_list(notes, B.note_links(spark, sf_dir), B.questions(spark, sf_dir), "e", 6, None, colour).select("note_id", "color")


@query(f"WITH {LINKS} SELECT note_id FROM k WHERE target_type = 'BANK' AND target_id = 9")
def notes_of_target(spark, sf_dir):
    return Q.note_list(B.notes(spark, sf_dir), B.note_links(spark, sf_dir), B.questions(spark, sf_dir), target=("BANK", 9)).select("note_id")


@query(f"WITH {LINKS}, {QUESTIONS}, b AS (SELECT note_id, target_id AS bank_id FROM k WHERE target_type = 'BANK' UNION SELECT note_id, bank_id FROM k JOIN q ON q.id = target_id WHERE target_type = 'QUESTION') SELECT bank_id, count(*) AS notes FROM b GROUP BY 1")
def notes_per_bank(spark, sf_dir):
    return Q.notes_per_bank(B.note_links(spark, sf_dir), B.questions(spark, sf_dir))


@query("SELECT doc_id AS note_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'g' ELSE source END AS color, CAST(CASE WHEN doc_id % 3 = 0 THEN least(2000, 2 * length(text)) ELSE length(text) END AS INT) AS size FROM documents")
def changed_notes(spark, sf_dir):
    notes = B.notes(spark, sf_dir)
    changes = notes.filter("note_id % 3 = 0").select("note_id", F.concat("content", "content").alias("content"), F.when(F.col("note_id") % 2 == 0, "g").otherwise("no colour").alias("color"))
    return Q.changed_notes(notes, changes).select("note_id", "color", F.length("content").alias("size"))


@query(f"WITH {LOG}, {STATES} SELECT 'states' AS \"table\", count(*) AS rows FROM s WHERE bank_id <> 3 UNION ALL SELECT 'log', count(*) FROM g WHERE bank_id <> 3")
def after_reset(spark, sf_dir):
    log = B.attempts(spark, sf_dir)
    left = R.reset(R.states(log), log, 3)
    one = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in zip(("states", "log"), left, strict=True)]
    return one[0].unionByName(one[1])


@query("SELECT l_linenumber AS job, 'QUESTIONS' AS rule FROM lineitem GROUP BY 1 HAVING count(*) > 5000 UNION ALL SELECT l_linenumber, 'MATERIALS' FROM lineitem WHERE l_quantity > 25 GROUP BY 1 HAVING count(*) > 500")
def import_limits(spark, sf_dir):
    line = B.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("job"), "l_quantity")
    return schema.import_errors(line, line.filter("l_quantity > 25"), "job")


@query("""WITH c AS (SELECT l_partkey * 10 AS card_id, max(l_shipdate) AS due_at, count(*) % 4 <> 0 AS confirmed FROM lineitem GROUP BY l_partkey) SELECT card_id, due_at FROM c WHERE confirmed AND due_at <= TIMESTAMP '2001-06-15 12:00:00' ORDER BY due_at, card_id LIMIT 200""")
def card_queue(spark, sf_dir):
    cards = B.table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") * 10).alias("card_id")).agg(F.max("l_shipdate").alias("due_at"), (F.count("*") % 4 != 0).alias("confirmed"))
    return C.queue(cards, AS_OF.replace(year=2001, month=6, day=15), 500).select("card_id", "due_at")
