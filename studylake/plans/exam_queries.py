"""Queries over parsed questions, replies and page layouts, made from the given tables with every case in turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from studylake.functions import exam as M
from studylake.functions import text as X
from studylake.operators import exams as E
from studylake.sources import bindings as B

from .base import EDITED, query
from .text_queries import EXAM, exams


def _part(spark, sf_dir):
    return B.dealt(B.table(spark, sf_dir, "part"), "p_partkey")


def _edited(spark, sf_dir):
    return B.dealt(B.edited(spark, sf_dir), "id")


def _case(n, *values, of="p_size"):
    """The n-th value by a column's remainder."""
    return F.element_at(F.array(*[F.lit(v) if isinstance(v, (str, int, float, type(None))) else v for v in values]), (F.col(of) % n + 1).cast("int"))


# --- checks of parsed questions --------------------------------------------------------------------------


@query(f"""WITH {EDITED}, x AS (SELECT id, CASE WHEN question_type = 'JUDGE' AND len(options) < 2 THEN 2 ELSE len(options) END AS n, CASE WHEN len(options) = 0 AND question_type IN ('SINGLE', 'MULTIPLE') THEN 'SUBJECTIVE' ELSE question_type END AS type, CASE WHEN id % 3 = 0 THEN NULL ELSE score END AS given FROM e)
SELECT id, type, CAST(n AS INT) AS n, coalesce(given, CASE WHEN type = 'SUBJECTIVE' THEN 5.0 ELSE 1.0 END)::DOUBLE AS score FROM x""")
def checked_questions(spark, sf_dir):
    c = M.checked_question(F.lower("question_type"), F.col("options"), F.when(F.col("id") % 3 != 0, F.col("score")))
    return _edited(spark, sf_dir).select("id", c.alias("c")).select("id", "c.type", F.size("c.options").alias("n"), "c.score")


@query(f"""WITH {EDITED} SELECT id, CASE WHEN question_type = 'SUBJECTIVE' AND len(options) >= 2 AND id % 3 = 1 THEN 'SINGLE' ELSE question_type END AS type FROM e""")
def relabelled_choices(spark, sf_dir):
    asked = F.concat("content", _case(3, "", "，下列正确的是", "，请简述下列各项", of="id"))
    return _edited(spark, sf_dir).select("id", M.mislabelled_choice(F.col("question_type"), asked, F.col("options")).alias("type"))


@query(f"""WITH {EDITED} SELECT id, (len(options) >= 2 AND id % 4 = 0) OR (question_type IN ('SINGLE', 'MULTIPLE') AND len(options) < 3) OR id % 5 = 0 AS junk FROM e""")
def junk_questions(spark, sf_dir):
    same = F.transform("options", lambda o: F.struct(o["key"].alias("key"), F.lit(" same").alias("text")))
    options = F.when(F.col("id") % 4 == 0, same).otherwise(F.col("options"))
    content = F.when(F.col("id") % 5 == 0, F.concat("content", F.lit(" 7.\n next"))).otherwise(F.col("content"))
    return _edited(spark, sf_dir).select("id", M.is_junk(F.col("question_type"), content, options).alias("junk"))


@query("SELECT p_partkey AS id, CASE p_size % 4 WHEN 1 THEN 'ORIGINAL' WHEN 2 THEN 'AI_SUPPLEMENT' END AS source FROM part")
def answer_sources(spark, sf_dir):
    keys = F.when(F.col("p_size") % 4 != 0, F.array(F.lit("A"))).otherwise(F.array().cast("array<string>"))
    return _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), M.answer_source(keys, F.col("p_size") % 4 == 1, F.col("p_size") % 4 == 2).alias("source"))


@query("SELECT p_partkey AS id, CASE WHEN p_size BETWEEN 10 AND 20 THEN '[图片' || p_size || ']' ELSE '' END || ' x [图片15]' AS kept, CASE WHEN p_size <> 15 THEN '[图片:s' || p_size || ']' ELSE '[图片15]' END || ' x [图片15]' AS named FROM part")
def image_references(spark, sf_dir):
    text = F.concat(F.lit("[图片"), F.col("p_size").cast("string"), F.lit("] x [图片15]"))
    names = F.when(F.col("p_size") != 15, F.create_map(F.col("p_size"), F.concat(F.lit("s"), F.col("p_size").cast("string")))).otherwise(F.create_map().cast("map<int,string>"))
    return _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), M.images_within(text, F.lit(10), F.lit(20)).alias("kept"), M.image_names(text, names).alias("named"))


@query("WITH m AS (SELECT DISTINCT p_brand AS doc, p_type AS material FROM part WHERE p_size < 20) SELECT p_partkey AS id, m.material FROM part LEFT JOIN m ON m.doc = p_brand AND m.material = p_type")
def live_materials(spark, sf_dir):
    rows = _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("doc"), F.col("p_type").alias("material"), "p_size")
    return E.clear_dangling(rows.drop("p_size"), rows.filter("p_size < 20").select("doc", "material"), "doc").select("id", "material")


@query("WITH e AS (SELECT l_suppkey AS doc, l_linenumber AS page, count(*) AS expected, count(*) FILTER (WHERE l_quantity > 5) AS found FROM lineitem GROUP BY 1, 2) SELECT * FROM e WHERE found < expected")
def missing_pages(spark, sf_dir):
    line = B.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("page"), "l_quantity")
    return E.missing_pages(line.groupBy("doc", "page").agg(F.count("*").alias("expected")), line.filter("l_quantity > 5"), "doc")


@query(rf"WITH {EXAM}, l AS (SELECT id, unnest(string_split(text, chr(10))) AS line FROM exam), n AS (SELECT id, count(*) FILTER (WHERE regexp_matches(line, '^\s*\d{{1,3}}\s*[.、．]') AND NOT (regexp_matches(line, '^\d{{1,3}}\.\d') AND NOT regexp_matches(line, '^\d{{1,3}}\.\d{{4}}年'))) AS n FROM l GROUP BY 1) SELECT id, CAST(n AS INT) AS numbers, id % 5 AS parsed FROM n WHERE n >= 5 AND id % 5 < 3")
def degraded_replies(spark, sf_dir):
    found = B.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("item_id") % 5)).alias("k")).filter("k > 0")
    return E.degraded(exams(spark, sf_dir), found, "id")


# --- answer lists ----------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, p_size % 5 IN (0, 1) AS listed, CASE p_size % 5 WHEN 0 THEN 'B' END AS second, CAST(CASE WHEN p_size % 5 = 0 THEN 3 ELSE 0 END AS INT) AS n, CAST(CASE p_size % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN length(p_name) + 1 ELSE -1 END AS INT) AS begins FROM part")
def answer_lists(spark, sf_dir):
    name = F.col("p_name")
    text = _case(5, F.lit("1.A 2.B 3.CD"), F.lit("1. A\n2. B\nnote"), F.concat(name, F.lit("\n1. A\n"), name, F.lit("\n"), name, F.lit("\n"), name), name, F.concat(name, F.lit("\n3.5 m")))
    compact = M.compact_answers(text)
    first = F.when(F.size(compact) > 0, F.lit(0)).otherwise(M.answer_section(text))  # a compact text is answers from its start
    return _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), M.is_answer_list(text).alias("listed"), F.try_element_at(compact, F.lit(2)).alias("second"), F.size(compact).alias("n"), first.alias("begins"))


@query("SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'see ' || p_name WHEN 2 THEN 'x = ' || p_size || ' m' END AS tail FROM part")
def bracket_answers(spark, sf_dir):
    n = F.col("p_size").cast("string")
    text = _case(4, F.concat(F.lit("【第"), n, F.lit("题答案】：see   "), "p_name"), F.concat(F.lit("【"), n, F.lit("题答案】 12.")), F.concat(F.lit("【"), n, F.lit("题的答案】 1, 2\n【"), n, F.lit("题答案】x = "), n, F.lit(" m")), F.lit("none"))
    return _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), M.bracket_answer(text, F.col("p_size")).alias("tail"))


@query("SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN '{\"k\": ' || p_size || '}' WHEN 1 THEN '[' || p_size || ', {\"a\": 1}]' ELSE p_name END AS body FROM part")
def fenced_bodies(spark, sf_dir):
    n = F.col("p_size").cast("string")
    text = _case(3, F.concat(F.lit('said ```json\n{"k": '), n, F.lit("}\n``` end")), F.concat(F.lit("so: ["), n, F.lit(', {"a": 1}] and')), F.concat(F.lit(" "), "p_name", F.lit("\n")))
    return _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), X.fenced(text).alias("body"))


# --- the source of questions -----------------------------------------------------------------------------


def _asked(spark, sf_dir):
    """The questions of the exams as a model might give them: some answers wrong, some contents not in the source."""
    i = F.explode(F.filter(F.sequence(F.lit(1), 3 + F.col("item_id").cast("int") % 6), lambda i: (F.col("item_id").cast("int") * 7 + i) % 6 != 0)).alias("i")
    rows = B.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.translate("text", "\n", " ").alias("text"), i)
    content = F.when(((F.col("id") + F.col("i")) % 7 == 0) | (F.length("text") < F.col("i") * 20 + 30), "nowhere in the source at all").otherwise(F.trim(F.substring("text", F.col("i") * 20, F.lit(30))))
    options = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(t).alias("text")) for k, t in (("A", "one"), ("B", "two"))])
    keys = F.when(F.col("i") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("A")))
    return rows.select("id", F.col("i").alias("position"), content.alias("content"), F.col("i").alias("number"), F.lit("SINGLE").alias("type"), options.alias("options"), keys.alias("answer_keys"))


_SAYS = "(CASE answer WHEN 'A' THEN ['A'] WHEN 'b' THEN ['B'] WHEN 'CD' THEN ['C', 'D'] WHEN 'E' THEN ['E'] ELSE ['A'] END)"


@query(rf"WITH {EXAM} SELECT id, i AS number, trim(substr(text, CAST(i * 20 AS INT), 30)) AS content FROM parts WHERE (id + i) % 7 <> 0 AND length(text) >= i * 20 + 30 AND (id + i) % 5 <> 3")
def questions_that_fit(spark, sf_dir):
    """Contents that the source lacks go, and questions whose second option stands elsewhere."""
    bad = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(t).alias("text")) for k, t in (("A", "one"), ("B", "elsewhere"))])
    asked = _asked(spark, sf_dir).withColumn("options", F.when((F.col("id") + F.col("number")) % 5 == 3, bad).otherwise(F.col("options")))
    found = E.repaired(asked, exams(spark, sf_dir), "id")
    return found.select("id", F.col("number").cast("long").alias("number"), "content")


@query(rf"WITH {EXAM} SELECT id, i AS number, {_SAYS} AS evidence, i % 3 = 0 OR {_SAYS} = ['A'] AS borne_out FROM parts")
def source_evidence(spark, sf_dir):
    found = E.with_source(_asked(spark, sf_dir), exams(spark, sf_dir), "id")
    return found.select("id", F.col("number").cast("long").alias("number"), "evidence", "borne_out")


@query(rf"WITH {EXAM} SELECT id, i AS number, list_filter({_SAYS}, lambda k: k IN ('A', 'B')) AS answer_keys, CASE WHEN len(list_filter({_SAYS}, lambda k: k IN ('A', 'B'))) > 0 THEN 'ORIGINAL' END AS answer_source FROM parts")
def recovered_answers(spark, sf_dir):
    found = E.recovered(_asked(spark, sf_dir), exams(spark, sf_dir), "id")
    return found.select("id", F.col("number").cast("long").alias("number"), "answer_keys", "answer_source")


@query(rf"WITH {EXAM}, c AS (SELECT id, i, (id + i) % 7 = 0 OR length(text) < i * 20 + 30 AS lost FROM parts) SELECT id, i AS number, CAST(row_number() OVER (PARTITION BY id ORDER BY lost, i) AS INT) AS place FROM c")
def questions_in_source_order(spark, sf_dir):
    shuffled = _asked(spark, sf_dir).withColumn("position", F.when(F.col("content").startswith("nowhere"), F.col("number")).otherwise(-F.col("number")))
    found = E.by_position(shuffled, exams(spark, sf_dir), "id")
    return found.select("id", F.col("number").cast("long").alias("number"), "place")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN [CAST(p_size AS INT), 3] ELSE [CAST(p_size AS INT)] END AS lost FROM part WHERE p_size > 9")
def lost_numbers(spark, sf_dir):
    n = F.col("p_size").cast("string")
    pad = F.repeat(F.lit("words of the text\n"), F.lit(12))
    shared = F.lit("1. first\n2. second\n4、fourth\n5. fifth\n6. sixth\n7. next\n")
    source = F.concat(pad, n, F.lit(". x\n"), F.when(F.col("p_size") % 2 == 0, "3. y\n").otherwise(""), shared, F.lit("8: A\n2.5 m"))
    return _part(spark, sf_dir).filter("p_size > 9").select(F.col("p_partkey").alias("id"), M.lost_numbers(source, shared).alias("lost"))


@query("SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN p_name || chr(10) || '3. next' WHEN 1 THEN 'B. two' ELSE '' END AS text FROM part")
def trimmed_chunks(spark, sf_dir):
    name = F.col("p_name")
    text = _case(3, F.concat(F.lit("\n2. cut\nA. one\n答案：A\n"), name, F.lit("\n3. next\n"), name), F.concat(F.lit("7.\nB. two\n"), name), F.concat(F.lit(" \n"), name))
    head = F.when(F.col("p_size") % 3 == 1, M.trimmed(text, False, True)).otherwise(M.trimmed(text))
    return _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.regexp_replace(head, r"^7\.\n", "").alias("text"))


@query("SELECT p_partkey AS id, CAST(CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS INT) AS ranges, true AS whole FROM part")
def image_quota_ranges(spark, sf_dir):
    """Four questions of four images (cut once) or of two (whole)."""
    per = F.when(F.col("p_size") % 2 == 0, 4).otherwise(2)
    question = lambda q: F.concat((q + 1).cast("string"), F.lit(". "), "p_name", F.array_join(F.transform(F.sequence(F.lit(1), per), lambda k: F.concat(F.lit("[图片"), (q * 10 + k).cast("string"), F.lit("]"))), ""))
    rows = _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), question), "\n").alias("text"))
    one = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end")))
    rows = rows.withColumn("r", M.split_by_images(F.col("text"), one))
    whole = (F.element_at("r", 1)["start"] == 0) & (F.element_at("r", -1)["end"] == F.length("text"))
    return rows.select("id", F.size("r").alias("ranges"), whole.alias("whole"))


@query("SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'a' || chr(10) || '[图片5]' || chr(10) || 'b' || chr(10) || 'c' || chr(10) || 'd' || chr(10) || '[图片6]' WHEN 1 THEN 'a' || chr(10) || 'b' || chr(10) || 'c' || chr(10) || 'd' ELSE '' END AS text FROM part")
def placed_images(spark, sf_dir):
    images = F.when(F.col("p_size") % 3 != 1, F.array(*[F.struct(F.lit(y).cast("double").alias("y"), F.lit(0.0).alias("height")) for y in (780, 10)])).otherwise(F.array().cast("array<struct<y:double,height:double>>"))
    page = F.when(F.col("p_size") % 3 == 2, "").otherwise("a\nb\nc\nd")
    return _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), M.with_image_marks(page, images, F.lit(5)).alias("text"))


@query("SELECT p_partkey AS id, p_name || chr(10) || '' || chr(10) || 'see' AS plain, 'pages 3.14 and 2024.5, ' || p_name || chr(10) || '7.wide' AS split FROM part")
def layout_lines(spark, sf_dir):
    noisy = F.concat(F.lit("  "), "p_name", F.lit("\n扫一扫 now\n\nimages/a-1.jpg\nsee images/b.png"))
    glued = F.concat(F.lit("pages 3.14 and 2024.5, "), "p_name", F.lit("7.wide"))
    return _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), X.without_adverts(noisy).alias("plain"), X.numbers_begin_lines(glued).alias("split"))


# --- replies and layouts ---------------------------------------------------------------------------------


@query(f"""WITH {EDITED} SELECT id, CASE WHEN id % 4 = 3 THEN 'NOT_JSON' END AS error, CAST(CASE WHEN id % 4 = 3 THEN 0 ELSE 2 END AS INT) AS questions, CAST(CASE WHEN id % 4 = 1 THEN 3 ELSE 0 END AS INT) AS materials FROM e""")
def decoded_replies(spark, sf_dir):
    found = E.decode(_replies(spark, sf_dir), "id")
    return found.select("id", "error", F.size("questions").alias("questions"), F.size("materials").alias("materials"))


def _replies(spark, sf_dir):
    """Arrays and objects, fenced or not, with a bad element; every fourth is no JSON."""
    q = F.concat(F.lit('{"questionNumber": '), F.col("id").cast("string"), F.lit(', "type": "single", "content": " '), "content", F.lit(' ", "options": [{"key": "A", "text": "x"}], "answerKeys": ["A"], "materialKey": "m2", "other": {}}'))
    other = F.lit('{"type": "SUBJECTIVE", "content": "why", "score": 3.5, "materialKey": "none"}')
    array = F.concat(F.lit("["), q, F.lit(", "), other, F.lit("]"))
    materials = F.lit('[{"materialKey": "m2", "content": "first"}, {"materialKey": "m2", "content": "second"}, {"materialKey": "none", "content": " "}]')
    whole = F.concat(F.lit('```json\n{"materials": '), materials, F.lit(', "questions": '), array, F.lit("}\n```"))
    reply = F.when(F.col("id") % 4 == 3, "sorry, nothing").when(F.col("id") % 4 == 1, whole).otherwise(array)
    return _edited(spark, sf_dir).select("id", reply.alias("reply"))


@query(f"""WITH {EDITED} SELECT id, 0 AS position, CAST(id AS INT) AS number, content, 'SINGLE' AS type, 1.0::DOUBLE AS score, CASE WHEN id % 4 = 1 THEN 'm2' END AS material FROM e WHERE id % 4 <> 3
UNION ALL SELECT id, 1, NULL, 'why', 'SUBJECTIVE', 3.5::DOUBLE, NULL FROM e WHERE id % 4 <> 3""")
def reply_questions(spark, sf_dir):
    found = E.reply_questions(E.decode(_replies(spark, sf_dir), "id"), "id")
    return found.select("id", "position", "number", "content", "type", "score", "material")


@query(f"WITH {EDITED} SELECT id, 'm2' AS material, 'first' AS content FROM e WHERE id % 4 = 1")
def reply_materials(spark, sf_dir):
    return E.reply_materials(E.decode(_replies(spark, sf_dir), "id"), "id")


_BLOCKS = """b AS (SELECT l_suppkey AS doc, CAST(l_linenumber AS INT) AS page, (['text', 'image', 'page_footer', 'chart', 'text'])[CAST(l_quantity AS INT) % 5 + 1] AS type,
  (['words of ' || l_partkey, '3. asks', '②', 'A', ' '])[CAST(floor(l_extendedprice) AS BIGINT) % 5 + 1] AS text, l_discount AS x, l_orderkey + l_partkey / 1e4 + l_extendedprice / 1e12 AS y, l_tax * 1000 AS side FROM lineitem),
k AS (SELECT *, CASE WHEN type IN ('image', 'chart') THEN 'image' WHEN text = '②' THEN 'tag' WHEN text = 'A' THEN 'noise' ELSE 'text' END AS kind FROM b WHERE type <> 'page_footer' AND (type NOT IN ('image', 'chart') OR side >= 24) AND (type IN ('image', 'chart') OR trim(text) <> '')),
f AS (SELECT *, min(CASE WHEN kind = 'text' AND text = '3. asks' THEN page END) OVER (PARTITION BY doc) AS first, count(*) FILTER (WHERE kind = 'text') OVER (PARTITION BY doc, page) AS texts FROM k)"""


@query(f"WITH {_BLOCKS} SELECT doc, page, kind, count(*) AS n FROM f WHERE NOT (kind = 'image' AND coalesce(page < first, false)) AND texts > 0 GROUP BY ALL")
def reading_order(spark, sf_dir):
    line = B.table(spark, sf_dir, "lineitem")
    text = F.element_at(F.array(F.concat(F.lit("words of "), F.col("l_partkey").cast("string")), *[F.lit(t) for t in ("3. asks", "②", "A", " ")]), (F.col("l_extendedprice").cast("long") % 5 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("text", "image", "page_footer", "chart", "text")]), F.col("l_quantity").cast("int") % 5 + 1)
    blocks = line.select(F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("page"), kind.alias("type"), text.alias("text"), F.col("l_discount").alias("x"), (F.col("l_orderkey") + F.col("l_partkey") / 1e4).alias("y"), (F.col("l_tax") * 1000).alias("width"), F.lit(500.0).alias("height"))
    return E.reading_order(blocks, "doc").groupBy("doc", "page", "kind").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS r, p_size % 4 AS k FROM part) SELECT id, r AS "rows", CASE WHEN k = 3 THEN 3 ELSE 2 END AS "columns", k IN (0, 1) AS grid FROM n""")
def image_grids(spark, sf_dir):
    """Two by two, three by two, one row, and two rows of unequal length."""
    k = F.col("p_size") % 4
    cells = F.when(k == 0, F.lit("00 01 10 11")).when(k == 1, "00 01 10 11 20 21").when(k == 2, "00 01").otherwise("00 01 02 10 11")
    rows = _part(spark, sf_dir).select(F.col("p_partkey").alias("doc"), F.explode(F.split(cells, " ")).alias("c"))
    r, c = F.substring("c", 1, 1).cast("int"), F.substring("c", 2, 1).cast("int")
    boxes = rows.select("doc", F.col("c").alias("id"), (c * 120 + r * 3).cast("double").alias("x"), (r * 100).cast("double").alias("y"), F.lit(90.0).alias("width"), F.lit(80.0).alias("height"))
    return E.grids(boxes, "doc").select(F.col("doc").alias("id"), F.col("rows").cast("int").alias("rows"), F.col("columns").cast("int").alias("columns"), "grid")


@query("SELECT p_partkey AS id, p_size % 4 < 2 AS noise FROM part")
def layout_noise(spark, sf_dir):
    line = _case(4, " B．", "ab_1/x.y-z", "B. two words", "a code line that is far too long to be one")
    return _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), M.layout_noise(line).alias("noise"))


# --- formulas left as images -----------------------------------------------------------------------------


@query(f"""WITH {EDITED}, q AS (SELECT bank_id, id, CASE WHEN id % 9 = 0 THEN ' [图片' || id % 40 || ']' ELSE content || chr(10) || '$x_' || id || '$ [图片' || id % 40 || ']  more [图片7] ' || repeat(content || ' ', CAST(id % 5 AS INT)) END AS content, len(options) AS n, id % 6 = 0 AS answered FROM e),
t AS (SELECT bank_id, 0 AS kind, id, content, unnest(list_distinct([CAST(id % 40 AS BIGINT)] || CASE WHEN id % 9 <> 0 THEN [7::BIGINT] ELSE [] END || CASE WHEN n > 1 THEN [id % 40 + 50] ELSE [] END || CASE WHEN answered THEN [id % 30 + 100] ELSE [] END)) AS number FROM q
  UNION ALL SELECT s_suppkey % 10, 1, s_suppkey, s_name || ' [图片' || s_suppkey % 70 + 60 || ']', s_suppkey % 70 + 60 FROM supplier),
c AS (SELECT *, substr(trim(regexp_replace(regexp_replace(content, '\\s+', ' ', 'g'), '\\[图片\\d+\\]', ' ', 'g')), 1, 120) AS context FROM t WHERE number % 3 <> 1 AND number < 125)
SELECT bank_id, CAST(number AS INT) AS number, coalesce(arg_min(context, kind * 1000000000 + id) FILTER (WHERE trim(context) <> ''), '') AS context, count(*) AS places FROM c GROUP BY ALL""")
def leftover_formulas(spark, sf_dir):
    """Numbers of formula images that contents, options, answers and materials still name, with what stands around them."""
    id_, mark = F.col("id"), lambda n: F.concat(F.lit("[图片"), n.cast("string"), F.lit("]"))
    content = F.when(id_ % 9 == 0, F.concat(F.lit(" "), mark(id_ % 40))).otherwise(F.concat("content", F.lit("\n\\(x_"), id_.cast("string"), F.lit("\\) "), mark(id_ % 40), F.lit("  more "), mark(F.lit(7)), F.lit(" "), F.repeat(F.concat("content", F.lit(" ")), (id_ % 5).cast("int"))))
    options = F.transform("options", lambda o, i: o.withField("text", F.when(i == 1, mark(id_ % 40 + 50)).otherwise(o["text"])))
    answer = F.when(id_ % 12 == 0, mark(id_ % 30 + 100)), F.when(id_ % 12 == 6, mark(id_ % 30 + 100))
    rows = _edited(spark, sf_dir).select("bank_id", "id", content.alias("content"), options.alias("options"), answer[0].alias("reference"), answer[1].alias("answer_text"), F.col("id").alias("position"))
    supplier = B.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 10).alias("bank_id"), F.col("s_suppkey").alias("position"), F.concat("s_name", F.lit(" "), mark(F.col("s_suppkey") % 70 + 60)).alias("content"))
    formulas = rows.select("bank_id").distinct().select("bank_id", F.explode(F.filter(F.sequence(F.lit(0), F.lit(124)), lambda n: n % 3 != 1)).alias("number"))
    return E.leftover_formulas(E.plain_delimiters(rows, "content", "reference", "answer_text"), supplier, formulas, "bank_id")
