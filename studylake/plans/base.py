"""Registration of queries, and what their oracle SQL shares."""

from __future__ import annotations

from datetime import datetime

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: The moment that "now" means in every query.
AS_OF = datetime(2024, 1, 30, 12, 0, 0)
AS_OF_SHIPPED = datetime(1999, 6, 15, 12, 0, 0)

#: The answer log bound to events, and to lineitem, as in sources.bindings.
LOG = """a AS (SELECT event_id AS id, user_id AS question_id, user_id % 10 AS bank_id, ts AS answered_at,
  CASE WHEN event_type IN ('purchase', 'signup', 'click') THEN true WHEN event_type = 'error' THEN false END AS is_correct,
  CASE WHEN event_type = 'click' THEN 'PARTIAL' END AS self_grade,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) < 50 THEN CAST(floor(value) AS BIGINT) END AS seconds FROM events),
g AS (SELECT *, coalesce(self_grade, CASE WHEN is_correct THEN 'CORRECT' WHEN NOT is_correct THEN 'WRONG' END) AS grade FROM a)"""
SHIPPED = """b AS (SELECT l_partkey AS question_id, l_partkey % 10 AS bank_id, l_shipdate AS answered_at, l_linestatus = 'F' AS is_correct,
  CASE l_returnflag WHEN 'R' THEN 'WRONG' WHEN 'N' THEN 'CORRECT' END AS self_grade, l_orderkey * 10 + l_linenumber AS id, l_extendedprice AS tie FROM lineitem),
h AS (SELECT *, coalesce(self_grade, CASE WHEN is_correct THEN 'CORRECT' WHEN NOT is_correct THEN 'WRONG' END) AS grade FROM b)"""
QUESTIONS = """q AS (SELECT p_partkey AS id, p_partkey % 10 AS bank_id, p_name AS content, p_type AS topic, p_brand AS category,
  (['SINGLE', 'MULTIPLE', 'JUDGE', 'SUBJECTIVE'])[p_size % 4 + 1] AS question_type, p_size / 10 AS score FROM part)"""
EDITED = """e AS (SELECT p_partkey AS id, p_partkey % 10 AS bank_id, p_brand || '-' || p_type AS external_id, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS number, p_name AS content,
  list_transform((['A', 'B', 'C', 'D'])[1:p_size % 5], lambda k: {'key': k, 'text': k || ' ' || p_type}) AS options,
  CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'B' WHEN 2 THEN 'A, C' END AS answer_keys, CASE WHEN p_size % 7 <> 0 THEN p_type ELSE ' ' END AS topic, p_brand AS category,
  (['SINGLE', 'MULTIPLE', 'JUDGE', 'SUBJECTIVE'])[p_size % 4 + 1] AS question_type, p_size / 10 AS score, CASE WHEN p_partkey % 4 = 0 THEN CAST(floor(p_partkey / 40) AS BIGINT) END AS material_id,
  p_size % 3 = 0 AS favorite, p_partkey AS position FROM part)"""
#: Ladder states by windows: the level is the run of right answers up to the last.
STATES = """s0 AS (SELECT *, sum(CASE WHEN grade <> 'CORRECT' THEN 1 ELSE 0 END) OVER (PARTITION BY question_id ORDER BY answered_at, id) AS island FROM g WHERE grade IS NOT NULL),
s1 AS (SELECT *, sum(CASE WHEN grade = 'CORRECT' THEN 1 ELSE 0 END) OVER (PARTITION BY question_id, island) AS run,
  row_number() OVER (PARTITION BY question_id ORDER BY answered_at DESC, id DESC) AS rn FROM s0),
s AS (SELECT question_id, bank_id, CAST(least(run, 5) AS INT) AS level,
  CAST(CASE WHEN run = 0 THEN 1 ELSE least(CAST(pow(2, least(run, 5)) AS INT), 30) END AS INT) AS interval_days,
  CASE WHEN grade = 'CORRECT' THEN answered_at + to_days(CAST(least(CAST(pow(2, least(run, 5)) AS INT), 30) AS INT)) ELSE answered_at END AS due_at
  FROM s1 WHERE rn = 1)"""


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add
