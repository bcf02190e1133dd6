"""Queries over texts: lines, addresses, messages, and exam texts made of benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from studylake.functions import exam as M
from studylake.functions import pages as P
from studylake.functions import text as X
from studylake.operators import exams as E
from studylake.operators import search as Q
from studylake.sources import bindings as B

from .base import query

#: An exam for each benchmark item: three to eight questions, some left out, with options, answers, an image mark, noise,
#: decimals and years in the text that look like question numbers.
EXAM = r"""parts AS (SELECT item_id AS id, i, (['A', 'b', 'CD', '√', 'E'])[(item_id + i) % 5 + 1] AS answer, (item_id + i) % 3 = 0 AS decimal, (item_id + i) % 4 = 0 AS year, translate(text, chr(10), ' ') AS text FROM benchmark, unnest(range(1, 4 + item_id % 6)) t(i) WHERE (item_id * 7 + i) % 6 <> 0),
exam AS (SELECT id, string_agg('第' || i || '部分' || chr(10) || i || CASE WHEN i % 2 = 0 THEN '、' ELSE '. ' END || substr(text, CAST(i * 20 AS INT), 30) || ' [图片' || (i * 3) || ']' || chr(10) || 'A. one' || chr(10) || 'B. two'
  || CASE WHEN decimal THEN chr(10) || i || '.5 is a decimal' ELSE '' END || CASE WHEN year THEN chr(10) || i || '.1998年的 report' ELSE '' END || chr(10) || 'page foot' || chr(10) || i || ': ' || answer, chr(10) ORDER BY i) AS text FROM parts GROUP BY 1)"""


def exams(spark, sf_dir):
    """id, text: the exams."""
    answers, one = F.array(*[F.lit(a) for a in ("A", "b", "CD", "√", "E")]), F.col("item_id").cast("int")

    def part(i):
        n = i.cast("string")
        head = F.concat(F.lit("第"), n, F.lit("部分\n"), n, F.when(i % 2 == 0, "、").otherwise(". "), F.substring(F.translate("text", "\n", " "), i * 20, F.lit(30)))
        decimal = F.when((one + i) % 3 == 0, F.concat(F.lit("\n"), n, F.lit(".5 is a decimal"))).otherwise("")
        year = F.when((one + i) % 4 == 0, F.concat(F.lit("\n"), n, F.lit(".1998年的 report"))).otherwise("")
        return F.concat(head, F.lit(" [图片"), (i * 3).cast("string"), F.lit("]\nA. one\nB. two"), decimal, year, F.lit("\npage foot\n"), n, F.lit(": "), F.element_at(answers, (one + i) % 5 + 1))

    numbers = F.filter(F.sequence(F.lit(1), 3 + one % 6), lambda i: (one * 7 + i) % 6 != 0)
    return B.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.array_join(F.transform(numbers, part), "\n").alias("text"))


# --- lines -----------------------------------------------------------------------------------------------


@query("SELECT trim(line) AS line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY 1 HAVING count(*) >= 3")
def line_frequency(spark, sf_dir):
    return X.line_frequency(B.table(spark, sf_dir, "documents"), "doc_id")


@query("SELECT doc_id, trim(line) AS line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY 1, 2 HAVING count(*) >= 3")
def repeated_lines_inside(spark, sf_dir):
    return X.repeated_inside(B.table(spark, sf_dir, "documents"), "doc_id")


@query("""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents), u AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM l),
c AS (SELECT *, CASE WHEN trim(line) = '' THEN 0 ELSE count(*) OVER (PARTITION BY doc_id, trim(line)) END AS n FROM u)
SELECT doc_id, CAST(count(*) AS INT) AS n_lines, CAST(count(*) FILTER (WHERE n < 3) AS INT) AS n_kept, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE n < 3), '')) AS digest FROM c GROUP BY 1""")
def cleaned_pages(spark, sf_dir):
    return X.without_repeats(B.table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "n_lines", "n_kept", F.md5("text").alias("digest"))


#: Pages of twenty lines (sentences have lines of their own); lines by turns as they are, or numbers, stems, decimals, options, feet and repeats.
_PAGED = r"""own AS (SELECT doc_id, unnest(string_split(replace(coalesce(text, ''), '. ', '.' || chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(coalesce(text, ''), '. ', '.' || chr(10)), chr(10)), 1) - 1 AS i FROM documents),
made AS (SELECT doc_id, i, i // 20 AS page, CASE (doc_id * 7 + i * 5 + length(line)) % 12 WHEN 0 THEN i % 90 || '.' WHEN 1 THEN ' 下列' || i || '是：' WHEN 2 THEN '属于' || i || '的？ ' || i % 90 || ' 、' WHEN 3 THEN i % 90 || '.' || doc_id || ' m' WHEN 4 THEN 'B. ' || line
  WHEN 5 THEN '' WHEN 6 THEN 'head ' || i % 3 WHEN 7 THEN '第 ' || i || '页 共 99 页' WHEN 8 THEN '要求' || i WHEN 9 THEN i % 90 || ' ．' ELSE line END AS line FROM own),
paged AS (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY i) AS text FROM made GROUP BY ALL)"""
_BARE = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
_BEHIND = r"'^(.+[：:？?）)]\s*)([0-9]{1,3})\s*[.．、]\s*$'"


@query(rf"""WITH RECURSIVE {_PAGED}, l AS (SELECT doc_id, page, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, page, regexp_split_to_array(text, '\r\n|[\n\x0b\x0c\r\x{{85}}\x{{2028}}\x{{2029}}]') AS a FROM paged)),
t AS (SELECT *, {_BARE.format("x")} AS t FROM l), c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS n FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY i) AS nth FROM c WHERE t = '' OR (n < 3 AND NOT regexp_matches(t, '第\s*[0-9０-９]+\s*页\s*[,，]?\s*共\s*[0-9０-９]+\s*页'))),
w AS (SELECT *, nth > 1 AND regexp_matches(t, '^[0-9]{{1,3}}\.[0-9]') AS wraps, regexp_matches(t, {_BEHIND}) AS behind FROM k),
p AS (SELECT doc_id, page, i, 0 AS part, wraps, CASE WHEN wraps THEN t WHEN behind THEN regexp_extract(t, {_BEHIND}, 1) ELSE x END AS x FROM w UNION ALL SELECT doc_id, page, i, 1, false, regexp_extract(t, {_BEHIND}, 2) || '.' FROM w WHERE behind AND NOT wraps),
g AS (SELECT *, count(*) FILTER (WHERE NOT wraps) OVER (PARTITION BY doc_id, page ORDER BY i, part) AS g FROM p), j AS (SELECT doc_id, page, g, string_agg(x, '' ORDER BY i, part) AS x FROM g GROUP BY ALL),
b AS (SELECT *, {_BARE.format("x")} AS t FROM j),
e AS MATERIALIZED (SELECT *, CASE WHEN regexp_matches(t, '^[0-9]{{1,3}}\s*[.．、]\s*$') THEN 'n' WHEN t <> '' AND NOT regexp_matches(t, '^([A-Ha-h]\s*[.．、]|答案|参考答案|解析)') AND regexp_matches(t, '[{P.STEM_ENDS}]$|{"|".join(P.STEM_WORDS)}') THEN 's' ELSE 'o' END AS kind FROM b),
r AS (SELECT doc_id, page, CAST(0 AS BIGINT) AS g, 0 AS stretch, 0 AS rank, 0 AS lines, 0 AS chars, 1 AS next, false AS moved FROM e GROUP BY ALL
  UNION ALL SELECT e.doc_id, e.page, e.g, CASE WHEN kind = 'o' THEN next + 1 ELSE next END, CASE WHEN kind = 's' THEN 1 WHEN kind = 'n' AND (lines > 4 OR chars > 300) THEN 2 ELSE 0 END,
    CASE WHEN kind = 's' THEN lines + 1 WHEN kind = 'n' AND lines <= 4 AND chars <= 300 THEN lines ELSE 0 END, CASE WHEN kind = 's' THEN chars + CAST(length(t) AS INT) WHEN kind = 'n' AND lines <= 4 AND chars <= 300 THEN chars ELSE 0 END,
    CASE WHEN kind = 'o' THEN next + 2 WHEN kind = 'n' AND (lines > 4 OR chars > 300) THEN next + 1 ELSE next END, kind = 'n' AND lines BETWEEN 1 AND 4 AND chars <= 300
  FROM r JOIN e ON e.doc_id = r.doc_id AND e.page = r.page AND e.g = r.g + 1),
o AS (SELECT e.doc_id, e.page, stretch, rank, e.g, CASE WHEN kind = 's' AND max(CASE WHEN moved THEN e.g END) OVER (PARTITION BY e.doc_id, e.page, stretch) > e.g THEN t ELSE e.x END AS x FROM e JOIN r ON e.doc_id = r.doc_id AND e.page = r.page AND e.g = r.g),
f AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY stretch, rank, g) AS n, regexp_replace(replace(regexp_replace(x, '[\x{{200B}}-\x{{200D}}\x{{FEFF}}]', '', 'g'), chr(12288), ' '), '[ \t]+$', '') AS x FROM o),
z AS (SELECT *, {_BARE.format("x")} = '' AS blank, lag({_BARE.format("x")} = '') OVER (PARTITION BY doc_id, page ORDER BY n) AS before FROM f),
y AS (SELECT doc_id, page, string_agg(CASE WHEN blank THEN '' ELSE x END, chr(10) ORDER BY n) || chr(10) AS text FROM z WHERE NOT (blank AND coalesce(before, false)) GROUP BY ALL)
SELECT doc_id, CAST(paged.page AS INT) AS page, CAST(coalesce(length(y.text), 0) AS INT) AS characters, md5(coalesce(y.text, '')) AS digest FROM paged LEFT JOIN y USING (doc_id, page)""")
def page_texts(spark, sf_dir):
    """Pages without running lines, decimals joined, numbers before their stems."""

    def made(line, i):
        n, two = i.cast("string"), (i % 90).cast("string")
        cases = (F.concat(two, F.lit(".")), F.concat(F.lit(" 下列"), n, F.lit("是：")), F.concat(F.lit("属于"), n, F.lit("的？ "), two, F.lit(" 、")), F.concat(two, F.lit("."), F.col("doc_id").cast("string"), F.lit(" m")), F.concat(F.lit("B. "), line),
                 F.lit(""), F.concat(F.lit("head "), (i % 3).cast("string")), F.concat(F.lit("第 "), n, F.lit("页 共 99 页")), F.concat(F.lit("要求"), n), F.concat(two, F.lit(" ．")))
        kind = (F.col("doc_id") * 7 + i * 5 + F.length(line)) % 12
        out = line
        for k, text in enumerate(cases):
            out = F.when(kind == k, text).otherwise(out)
        return out

    lines = F.transform(F.split(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n")), "\n"), made)
    docs = B.table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"))
    first = F.sequence(F.lit(0), F.size("lines") - 1, F.lit(20))
    pages = docs.select("doc_id", F.transform(first, lambda at: F.array_join(F.slice("lines", at + 1, F.lit(20)), "\n")).alias("pages"))
    found = pages.select("doc_id", F.posexplode(P.clean_pages(F.col("pages"))).alias("page", "text"))
    return found.select("doc_id", "page", F.length("text").alias("characters"), F.md5("text").alias("digest"))


@query("SELECT doc_id, CAST(coalesce(length(trim(text)), 0) AS INT) AS characters, coalesce(length(trim(text)), 0) < 200 AS cover FROM documents")
def cover_pages(spark, sf_dir):
    size = F.coalesce(F.length(F.trim("text")), F.lit(0))
    return B.table(spark, sf_dir, "documents").select("doc_id", size.alias("characters"), (size < 200).alias("cover"))


@query("SELECT conv_id, count(*) AS messages, CAST(sum(n) AS BIGINT) AS characters FROM (SELECT conv_id, length(CASE WHEN length(text) > 400 THEN substr(text, 1, 200) || chr(10) || '…' || chr(10) || substr(text, -200) ELSE text END) AS n FROM conversations) GROUP BY 1")
def shortened_dialogues(spark, sf_dir):
    rows = B.messages(spark, sf_dir).select(F.col("session_id").alias("conv_id"), F.length(X.head_and_tail(F.col("content"), 400)).alias("n"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum("n").alias("characters"))


# --- exam texts ------------------------------------------------------------------------------------------


_NUMBERED = r"regexp_matches(line, '^\s*\d{1,3}\s*[.、．]') AND NOT (regexp_matches(line, '^\d{1,3}\.\d') AND NOT regexp_matches(line, '^\d{1,3}\.\d{4}年'))"


@query(rf"""WITH {EXAM}, l AS (SELECT id, unnest(string_split(text, chr(10))) AS line FROM exam)
SELECT id, CAST(regexp_extract(line, '^\s*(\d{{1,3}})', 1) AS INT) AS number, line FROM l WHERE {_NUMBERED}""")
def question_starts(spark, sf_dir):
    rows = X.lines(exams(spark, sf_dir), "id").withColumn("number", X.question_number(F.col("line")))
    return rows.filter("number IS NOT NULL").select("id", "number", "line")


@query(rf"WITH {EXAM} SELECT id, i AS question, answer FROM parts")
def dotted_answers(spark, sf_dir):
    rows = X.lines(exams(spark, sf_dir), "id").filter(X.is_answer_line(F.col("line")))
    # "3: CD" is an answer line; "A. one" is not.
    number = F.regexp_extract("line", r"^\s*(\d+)", 1).cast("int")
    return rows.select("id", number.cast("long").alias("question"), X.answer_of(F.col("line"), number).alias("answer"))


@query("WITH r AS (SELECT p_partkey AS id, p_partkey % 30 + 1 AS start, p_size % 9 AS ahead FROM part) SELECT id, CASE WHEN ahead <= 7 THEN (['B', 'D', 'CA', 'C', '√', 'a', 'BD', 'D'])[ahead + 1] END AS answer FROM r")
def range_answers(spark, sf_dir):
    """Answer lines of eight questions from a number on, asked for one at or beyond the range."""
    p = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 30 + 1).cast("int").alias("start"), (F.col("p_size") % 9).alias("ahead"))
    line = F.concat(F.col("start").cast("string"), F.when(F.col("id") % 2 == 0, "-").otherwise(" ~ "), (F.col("start") + 7).cast("string"), F.when(F.col("id") % 3 == 0, "：").otherwise(" "), F.lit("B D，CA C；√ a BD、D"))
    return p.select("id", X.answer_of(line, F.col("start") + F.col("ahead")).alias("answer"))


@query(rf"WITH {EXAM}, m AS (SELECT id, list(CAST(i * 3 AS INT) ORDER BY i) AS images FROM parts GROUP BY 1) SELECT id, images, CAST(length(regexp_replace(text, '\[图片(\d+)\]', '', 'g')) AS INT) AS n_plain FROM exam JOIN m USING (id)")
def image_marks(spark, sf_dir):
    return exams(spark, sf_dir).select("id", X.images(F.col("text")).alias("images"), F.length(X.without_images(F.col("text"))).alias("n_plain"))


@query(rf"""WITH {EXAM}, l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM exam),
n AS (SELECT *, CASE WHEN {_NUMBERED} THEN CAST(regexp_extract(line, '^\s*(\d{{1,3}})', 1) AS INT) END AS number FROM l),
s AS (SELECT *, count(number) OVER (PARTITION BY id ORDER BY place) AS section FROM n)
SELECT id, max(number) AS question, count(*) AS n_lines FROM s WHERE section > 0 GROUP BY id, section""")
def question_bodies(spark, sf_dir):
    found = X.questions_in(exams(spark, sf_dir), "id")
    return found.select("id", "question", F.size(F.split("body", "\n")).cast("long").alias("n_lines"))


@query("WITH f AS (SELECT p_brand || '/' || p_partkey % 7 AS paper, p_size AS number FROM part), h AS (SELECT paper, min(number) AS lo, max(number) AS hi FROM f GROUP BY 1 HAVING count(DISTINCT number) >= 5), m AS (SELECT paper, i AS missing, row_number() OVER (PARTITION BY paper ORDER BY i) AS n FROM h, unnest(range(lo, hi + 1)) t(i) WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.paper = h.paper AND f.number = i)) SELECT paper, CAST(missing AS INT) AS missing FROM m WHERE n <= 12")
def missing_numbers(spark, sf_dir):
    found = B.table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), (F.col("p_partkey") % 7).cast("string")).alias("paper"), F.col("p_size").alias("number"))
    return X.missing_numbers(found, "paper", "number")


@query("WITH l AS (SELECT p_brand AS page, p_retailprice AS y, p_partkey AS id, CASE WHEN p_retailprice - lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) > 2 THEN 1 ELSE 0 END AS far FROM part), c AS (SELECT page, sum(far) OVER (PARTITION BY page ORDER BY y, id ROWS UNBOUNDED PRECEDING) AS cluster FROM l) SELECT page, CAST(cluster AS BIGINT) AS cluster, count(*) AS n FROM c GROUP BY 1, 2")
def row_clusters(spark, sf_dir):
    rows = B.table(spark, sf_dir, "part").select(F.col("p_brand").alias("page"), F.struct("p_retailprice", "p_partkey").alias("at"), F.col("p_retailprice").alias("y"))
    return X.clusters(rows, "page", "y", 2.0).groupBy("page", F.col("cluster").cast("long").alias("cluster")).agg(F.count("*").alias("n"))


@query("WITH o AS (SELECT doc_id, (doc_id * 37) % 5000 AS spot FROM documents), s AS (SELECT doc_id, unnest([0, 300, 900, 2000 + doc_id % 7]) AS start FROM documents) SELECT doc_id, CAST(count(*) AS INT) AS page FROM o JOIN s USING (doc_id) WHERE start <= spot GROUP BY 1")
def page_of_offset(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id")
    starts = docs.select("doc_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(300).cast("long"), F.lit(900).cast("long"), 2000 + F.col("doc_id") % 7)).alias("start"))
    offsets = docs.select("doc_id", ((F.col("doc_id") * 37) % 5000).alias("offset"))
    return X.page_of(offsets, starts, "doc_id").select("doc_id", "page")


@query(rf"""WITH {EXAM}, l AS (SELECT id, unnest(string_split(text, chr(10))) AS line FROM exam), q AS (SELECT id, CAST(count(*) AS INT) AS loose FROM l WHERE {_NUMBERED} GROUP BY 1), n AS (SELECT id, count(*) AS n FROM parts GROUP BY 1)
SELECT id, loose, CAST(CASE WHEN n >= 3 THEN n ELSE 0 END AS INT) AS bounds, CAST(CASE WHEN n >= 3 THEN least(6, ceil(n / 2)) ELSE 1 END AS INT) AS chunks, true AS whole FROM q JOIN n USING (id)""")
def exam_chunks(spark, sf_dir):
    rows = exams(spark, sf_dir).withColumn("b", M.boundaries(F.col("text"))).withColumn("c", M.chunks(F.col("b"), F.length("text"), 2))
    whole = (F.element_at("c", 1)["start"] == 0) & (F.element_at("c", -1)["end"] == F.length("text"))
    return rows.select("id", M.loose_count(F.col("text")).alias("loose"), F.size("b").alias("bounds"), F.size("c").alias("chunks"), whole.alias("whole"))


def _markdown(spark, sf_dir):
    """Three questions and a material for each benchmark item, in the Markdown form."""
    parts = ["lead text\n# 材料 1\n", F.substring("text", 1, 40), "\n## 第1题 单选题\n题干：", F.substring("text", 41, 20), "\nA. one B. two\nC. three\n答案：c\n## 第2题\n", F.substring("text", 61, 20), "\n答案：\n解析：why\n## 第4题 判断题\n**题干**\n", F.substring("text", 81, 20), "\n参考答案：yes"]
    return B.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("text"))


@query(r"""SELECT item_id AS id, v.number, v.type, CASE v.number WHEN 1 THEN trim(regexp_replace(substr(text, 41, 20), '\s*\n\s*', chr(10), 'g'), ' ' || chr(10)) WHEN 2 THEN trim(regexp_replace(substr(text, 61, 20), '\s*\n\s*', chr(10), 'g'), ' ' || chr(10)) WHEN 4 THEN trim(regexp_replace(substr(text, 81, 20), '\s*\n\s*', chr(10), 'g'), ' ' || chr(10)) ELSE 'lead text' END AS content, CAST(CASE WHEN v.number = 1 THEN 3 ELSE 0 END AS INT) AS n_options,
  CASE WHEN v.number = 1 THEN 'C' ELSE '' END AS keys, CASE WHEN v.number = 2 THEN 'why' END AS analysis, CASE WHEN v.number = 4 THEN 'yes' END AS reference, v.number IS NOT NULL AS has_material
FROM benchmark, (VALUES (NULL, 'SUBJECTIVE'), (1, 'SINGLE'), (2, 'SUBJECTIVE'), (4, 'JUDGE')) v(number, type)""")
def markdown_questions(spark, sf_dir):
    q = E.markdown_questions(_markdown(spark, sf_dir), "id")
    return q.select("id", "number", "type", F.trim("content").alias("content"), F.size("options").alias("n_options"), F.array_join("answer_keys", "").alias("keys"), "analysis", "reference", F.col("material").isNotNull().alias("has_material"))


@query("""WITH f AS (SELECT p_brand AS paper, p_partkey AS position, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 8 + p_size END AS number FROM part), l AS (SELECT paper, min(number) AS low FROM f GROUP BY 1),
r AS (SELECT f.*, low, row_number() OVER (PARTITION BY paper, number IS NULL ORDER BY position) AS n FROM f JOIN l USING (paper)) SELECT position, CAST(coalesce(number, CASE WHEN n < low THEN n END) AS INT) AS number FROM r""")
def filled_numbers(spark, sf_dir):
    found = B.table(spark, sf_dir, "part").select(F.col("p_brand").alias("paper"), F.col("p_partkey").alias("position"), F.when(F.col("p_partkey") % 3 != 0, 8 + F.col("p_size")).alias("number"))
    return E.fill_numbers(found, "paper").select("position", F.col("number").cast("int").alias("number"))


@query("""WITH f AS (SELECT o_custkey AS job, o_orderkey AS position, CAST(floor(o_totalprice) AS BIGINT) % 20 AS pages FROM orders) SELECT job, position, CAST(coalesce(sum(pages) OVER (PARTITION BY job ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_page FROM f""")
def merged_files(spark, sf_dir):
    files = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("position"), (F.floor("o_totalprice") % 20).alias("pages"))
    return E.merge_files(files, "job").select("job", "position", "first_page")


@query("""WITH b AS (SELECT l_suppkey AS doc, l_orderkey * 10 + l_linenumber AS place, l_extendedprice AS x, (['image', 'text', 'tag', 'image'])[CAST(l_quantity AS INT) % 4 + 1] AS kind FROM lineitem),
c AS (SELECT *, count(*) FILTER (WHERE kind = 'text') OVER (PARTITION BY doc ORDER BY place, x ROWS UNBOUNDED PRECEDING) AS chain FROM b) SELECT doc, chain, count(*) AS images FROM c WHERE kind = 'image' GROUP BY 1, 2""")
def image_chains(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in ("image", "text", "tag", "image")])
    line = B.table(spark, sf_dir, "lineitem")
    blocks = line.select(F.col("l_suppkey").alias("doc"), F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_extendedprice")).alias("place"), F.element_at(kinds, F.col("l_quantity").cast("int") % 4 + 1).alias("kind"))
    return E.image_chains(blocks, "doc").groupBy("doc", "chain").agg(F.count("*").alias("images"))


# --- keys, quality, copies -------------------------------------------------------------------------------


@query("""WITH r AS (SELECT p_partkey AS place, lower(regexp_replace(p_name || p_type, '[\\s_]+', '', 'g')) AS key, p_size % 5 * 10 + CASE WHEN p_size % 4 <> 0 THEN 5 ELSE 0 END AS quality FROM part),
b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY quality DESC, place) AS rn, min(place) OVER (PARTITION BY key) AS first_place FROM r) SELECT key, place, CAST(quality AS INT) AS quality, first_place FROM b WHERE rn = 1""")
def best_of_copies(spark, sf_dir):
    p = B.table(spark, sf_dir, "part")
    options = F.slice(F.array(*[F.lit(x) for x in "ABCD"]), F.lit(1), F.col("p_size") % 5)
    rows = p.select(F.col("p_partkey").alias("place"), X.question_key(F.col("p_name"), F.array("p_type")).alias("key"), X.quality(F.col("p_name"), options, F.when(F.col("p_size") % 4 != 0, "B")).alias("quality"))
    return X.best_of(rows, ["key"], "quality", "place").select("key", "place", "quality", "first_place")


@query(r"SELECT md5(regexp_replace(text, '[ \t\n\x0b\f\r_]+', '', 'g')) AS key, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def equal_texts(spark, sf_dir):
    """Texts equal but for white space and underscores, letters as they are."""
    key = F.md5(F.regexp_replace("text", r"[ \t\n\x0B\f\r_]+", ""))
    return B.table(spark, sf_dir, "documents").groupBy(key.alias("key")).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")


# --- scalars ---------------------------------------------------------------------------------------------


@query("SELECT lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host, count(*) AS pages, bool_or(regexp_matches(url, '^https?://(localhost|127\\.|10\\.|192\\.168\\.)')) AS private FROM pages GROUP BY 1")
def hosts(spark, sf_dir):
    h = X.host(F.col("url"))
    return B.table(spark, sf_dir, "pages").select(h.alias("host")).groupBy("host").agg(F.count("*").alias("pages"), F.bool_or(X.private_host(F.col("host"))).alias("private"))


@query(r"SELECT page_id, CASE WHEN name = '' THEN 'untitled' ELSE substr(name, 1, 40) END AS name FROM (SELECT page_id, regexp_replace(regexp_replace(trim(url), '[\\/:*?\x22<>|\x00-\x1f]', '_', 'g'), '[. ]+$', '') AS name FROM pages)")
def file_names(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select("page_id", X.file_name(F.col("url"), 40).alias("name"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) > 90 THEN 90 ELSE CAST(json_extract_string(props, '$.k') AS INT) END AS clamped FROM events")
def json_walk(spark, sf_dir):
    k = F.from_json("props", "k int", {"mode": "PERMISSIVE"})["k"]
    return B.table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.greatest(F.lit(0), F.least(F.lit(90), k)).alias("clamped"))


_MESSAGES = ["read Timeout", "HTTP 429", "模型服务限流", "Connection refused by", "AI 输出不是合法 JSON", "bad page in a.PDF", "nothing known", None]
_CAUSES = [[], ["SocketTimeoutException"], ["UnknownHostException", "Error"], ["IOException"], None]


def _sql(x):
    return "NULL" if x is None else "[" + ", ".join(map(_sql, x)) + "]" + ("::VARCHAR[]" if not x else "") if isinstance(x, list) else f"'{x}'"


@query(f"""WITH m AS (SELECT o_orderkey AS id, lower(coalesce(([{', '.join(map(_sql, _MESSAGES))}])[o_orderkey % 8 + 1] || ' ' || o_orderpriority, '')) AS m, ([{', '.join(map(_sql, _CAUSES))}])[o_custkey % 5 + 1] AS c FROM orders)
SELECT id, CASE WHEN contains(m, 'timeout') OR contains(m, '超时') OR coalesce(list_has_any(c, ['HttpTimeoutException', 'SocketTimeoutException']), false) THEN 'MODEL_TIMEOUT'
  WHEN contains(m, 'http 429') OR contains(m, 'rate limit') OR contains(m, '限流') OR contains(m, '请求过于频繁') THEN 'MODEL_RATE_LIMITED'
  WHEN contains(m, '无法连接') OR contains(m, 'connection refused') OR coalesce(list_has_any(c, ['ConnectException', 'UnknownHostException']), false) THEN 'MODEL_CONNECTION_FAILED'
  WHEN contains(m, 'ai 输出不是合法 json') OR contains(m, '模型返回空白') OR contains(m, '响应格式异常') THEN 'MODEL_RESPONSE_INVALID'
  WHEN contains(m, 'mineru') OR contains(m, '文档解析') OR contains(m, 'pdf') OR contains(m, 'docx') OR coalesce(list_has_any(c, ['IOException']), false) THEN 'DOCUMENT_PARSE_FAILED' ELSE 'IMPORT_PROCESSING_FAILED' END AS class FROM m""")
def failure_classes(spark, sf_dir):
    said = F.element_at(F.array(*[F.lit(x) for x in _MESSAGES]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    none = F.lit(None).cast("array<string>")
    causes = F.element_at(F.array(*[none if c is None else F.array(*[F.lit(x) for x in c]).cast("array<string>") for c in _CAUSES]), (F.col("o_custkey") % 5 + 1).cast("int"))
    return B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), X.failure_class(F.concat(said, F.lit(" "), "o_orderpriority"), causes).alias("class"))


@query("""WITH c AS (SELECT c_custkey AS id, c_custkey % 4 AS k, md5(c_name) AS h, c_name AS n FROM customer)
SELECT id, CASE k WHEN 0 THEN '*** for ' || n WHEN 1 THEN '(***) ' || n WHEN 2 THEN 'no key; tank-' || n ELSE '*** and ***, ' || n END AS message, 'E: ' || CASE k WHEN 0 THEN '*** for ' || n WHEN 1 THEN '(***) ' || n WHEN 2 THEN 'no key; tank-' || n ELSE '*** and ***, ' || n END AS line, substr(h, 1, 3) || '***' || substr(h, -3) AS masked FROM c""")
def redacted(spark, sf_dir):
    h, n = F.md5("c_name"), F.col("c_name")
    k = F.col("c_custkey") % 4
    said = F.when(k == 0, F.concat(F.lit("API_key= "), h, F.lit(" for "), n)).when(k == 1, F.concat(F.lit("(sk-"), h, F.lit(") "), n)).when(k == 2, F.concat(F.lit("no key; tank-"), n)).otherwise(F.concat(F.lit("api key: "), h, F.lit(" and SK-"), h, F.lit(", "), n))
    return B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), X.redact(said).alias("message"), X.diagnostic(F.lit("E"), said).alias("line"), X.masked_key(h).alias("masked"))


@query("SELECT p_partkey AS id, '$x$ and $$' || p_name || '$$ a b' AS formula FROM part")
def formulas(spark, sf_dir):
    made = F.concat(F.lit("\\(x\\) and \\["), F.col("p_name"), F.lit("\\] a　​b"))
    return B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.latex(X.tidy(made)).alias("formula"))


@query("SELECT p_partkey AS id, regexp_full_match(p_brand || '-' || p_size, '[\\p{L}\\p{N}._-]{1,100}') AS fine, CASE WHEN p_size % 3 = 0 THEN 'MULTIPLE' WHEN p_size % 3 = 1 THEN 'SUBJECTIVE' ELSE 'SINGLE' END AS kind FROM part")
def inferred_types(spark, sf_dir):
    m = F.col("p_size") % 3
    kind = X.question_type(F.when(m != 1, F.array(F.lit("A"), F.lit("B"))), F.when(m == 0, "二、多选题"))
    return B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.valid_key(F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string"))).alias("fine"), kind.alias("kind"))


@query("SELECT conv_id, turn, 'x' AS kind FROM conversations WHERE contains(text, 'the') AND role = 'user'")
def message_search(spark, sf_dir):
    return B.table(spark, sf_dir, "conversations").filter(Q.all_of(Q.contains("the", "text"), Q.equals("role", "user"))).select("conv_id", "turn", F.lit("x").alias("kind"))
