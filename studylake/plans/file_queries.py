"""Queries that write files below the scratch folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from studylake.sources import bindings as B
from studylake.sources import files as L
from studylake.sources import office as O
from studylake.sources import streams as T

from .base import EDITED, LOG, query


@query("SELECT n_nationkey AS id, n_name AS name, NULL::VARCHAR AS missing FROM nation WHERE n_nationkey % 5 <> 0")
def stored_banks(spark, sf_dir):
    """Parquet by an explicit schema with a column that the file lacks, without what is marked as deleted."""
    path = L.scratch(spark, "banks")
    B.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 5 == 0, True).alias("deleted")).write.parquet(path)
    return L.live(L.read_table(spark, path, "id int, name string, missing string, deleted boolean")).drop("deleted")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey = 7")
def bank_by_key(spark, sf_dir):
    return L.lookup(B.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), "id", 7)


def _packages(spark, sf_dir):
    """Written packages of version 1: a bank each, questions in order; two banks break a rule."""
    rows = B.edited(spark, sf_dir).filter("bank_id < 6").select(F.concat(F.lit("bank"), F.col("bank_id").cast("string")).alias("packageKey"), F.lit("1.0.0").alias("version"), F.lit("t").alias("title"), F.col("id").cast("int").alias("position"), F.when(F.col("bank_id") == 2, "same").otherwise(F.concat(F.lit("q"), F.col("id").cast("string"))).alias("questionKey"), F.when(F.col("bank_id") == 3, "SINGLE").otherwise("SUBJECTIVE").alias("type"), "content", "score", F.when(F.col("bank_id") == 4, "gone").alias("materialKey"))
    return L.read_packages(spark, L.write_packages(rows, L.scratch(spark, "packages"), "packageKey", "version", "title") + "/*.json", lines=True)


@query("""SELECT 'bank' || p_partkey % 10 AS "packageKey", CASE p_partkey % 10 WHEN 2 THEN 'question keys repeat' WHEN 3 THEN 'objective question without options' WHEN 4 THEN 'unknown material' END AS error, CAST(count(*) AS INT) AS n_questions, CAST(0 AS INT) AS n_materials FROM part WHERE p_partkey % 10 < 6 GROUP BY ALL""")
def package_files(spark, sf_dir):
    found = _packages(spark, sf_dir)
    counts = L.inspect(found).select("packageKey", "n_questions", "n_materials")
    return found.select("packageKey", "error").join(counts, "packageKey")


@query("""SELECT 'bank' || p_partkey % 10 AS "packageKey", CAST(row_number() OVER (PARTITION BY p_partkey % 10 ORDER BY p_partkey) - 1 AS INT) AS position, p_name AS content, (p_size / 10)::DOUBLE AS score FROM part WHERE p_partkey % 10 < 6""")
def package_questions(spark, sf_dir):
    return L.questions_of(_packages(spark, sf_dir)).select("packageKey", "position", "content", "score")


@query("""SELECT 'bank' || p_partkey % 10 AS "packageKey", list('i' || p_partkey || '.png' ORDER BY 'i' || p_partkey || '.png') AS names, '1.0.0' AS version, NULL::VARCHAR AS error, max('i' || p_partkey || '.png') AS last FROM part WHERE p_partkey % 10 < 3 AND p_partkey < 120 GROUP BY 1""")
def package_containers(spark, sf_dir):
    """Containers of version 2 written as archives, listed, and one entry of each read."""
    name = F.concat(F.lit("i"), F.col("p_partkey").cast("string"), F.lit(".png"))
    media = F.map_from_entries(F.collect_list(F.struct(name, F.encode(name, "UTF-8"))))
    rows = B.table(spark, sf_dir, "part").filter("p_partkey % 10 < 3 AND p_partkey < 120").groupBy(F.concat(F.lit("bank"), (F.col("p_partkey") % 10).cast("string")).alias("packageKey")).agg(media.alias("media"), F.max(name).alias("last"))
    manifest = F.to_json(F.struct("packageKey", F.lit("1.0.0").alias("version")))
    path = L.write_containers(L.containers(rows.select("packageKey", F.lit("1.0.0").alias("version"), manifest.alias("manifest"), "media")), L.scratch(spark, "containers"))
    found = L.read_containers(spark, path).select("path", F.col("package.packageKey").alias("packageKey"), F.array_sort("names").alias("names"), F.col("package.version").alias("version"), "error")
    # The last entry's bytes are its name.
    ends = L.read_last_entry(spark, path).select("path", F.decode("content", "UTF-8").alias("last"))
    return found.join(ends, "path").drop("path")


@query(f"WITH {LOG} SELECT 'bank' || bank_id AS package_key, 'q' || question_id AS question_key, is_correct, self_grade, answered_at, count(*) AS n FROM g GROUP BY ALL")
def record_files(spark, sf_dir):
    log = B.attempts(spark, sf_dir)
    record = F.struct(F.concat(F.lit("bank"), F.col("bank_id").cast("string")).alias("packageKey"), F.lit("1.0.0").alias("packageVersion"), F.concat(F.lit("q"), F.col("question_id").cast("string")).alias("questionKey"), F.col("is_correct").alias("isCorrect"), F.col("self_grade").alias("selfGrade"), F.col("answered_at").alias("answeredAt"))
    path = L.write_record_files(log.select(record.alias("r"), "answered_at"), L.scratch(spark, "records"))
    return L.read_records(spark, path).groupBy("package_key", "question_key", "is_correct", "self_grade", "answered_at").agg(F.count("*").alias("n"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS node_id, n_name AS name, CASE WHEN n_nationkey >= 10 THEN [CAST(n_nationkey - 10 AS VARCHAR)] ELSE [] END AS prereq FROM nation")
def override_files(spark, sf_dir):
    n = F.col("n_nationkey")
    prereq = F.when(n >= 10, F.array((n - 10).cast("string"))).otherwise(F.array().cast("array<string>"))
    nodes = B.table(spark, sf_dir, "nation").select(n.cast("string").alias("node_id"), F.col("n_name").alias("name"), prereq.alias("prereq"))
    return L.read_overrides(spark, L.write_overrides(nodes, L.scratch(spark, "overrides")))


@query(f"WITH {EDITED}, {LOG} SELECT 'question' AS \"table\", count(*) AS rows, CAST(sum(id) AS BIGINT) AS ids FROM e UNION ALL SELECT 'record', count(*), CAST(sum(id) AS BIGINT) FROM g")
def restored_backup(spark, sf_dir):
    path = L.backup({"question": B.edited(spark, sf_dir).select("id", "content"), "record": B.attempts(spark, sf_dir).select("id", "answered_at")}, L.scratch(spark, "backup"))
    schemas = {"question": "id long, content string", "record": "id long, answered_at timestamp_ntz"}
    tables = L.restored(spark, L.restore_into(spark, path, schemas, L.scratch(spark, "restored")), schemas)
    one = [df.agg(F.count("*").alias("rows"), F.sum("id").alias("ids")).select(F.lit(name).alias("table"), "rows", "ids") for name, df in tables.items()]
    return one[0].unionByName(one[1])


@query("SELECT page_id, length(html) AS size, md5(html) AS digest FROM pages WHERE length(html) > 0")
def plain_text_files(spark, sf_dir):
    """Texts written one to a file and read whole."""
    pages = B.table(spark, sf_dir, "pages").filter("length(html) > 0").select(F.col("page_id").alias("name"), F.col("html").alias("text"))
    found = L.read_texts(spark, L.write_texts(pages, L.scratch(spark, "texts")))
    name = F.regexp_extract("path", r"([^/]+)\.txt$", 1).cast("long")
    return found.select(name.alias("page_id"), F.length("text").cast("long").alias("size"), F.md5("text").alias("digest"))


@query("""SELECT 'bank' || p_partkey % 10 AS "packageKey", CAST(count(*) AS INT) AS n_questions FROM part GROUP BY 1""")
def streamed_counts(spark, sf_dir):
    """Packages of all banks written one to a file and counted as streams."""
    key = F.concat(F.lit("bank"), (F.col("p_partkey") % 10).cast("string"))
    question = F.struct(F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("questionKey"), F.col("p_name").alias("content"))
    made = B.table(spark, sf_dir, "part").groupBy(key.alias("packageKey")).agg(F.collect_list(question).alias("questions"))
    texts = made.select(F.col("packageKey").alias("name"), F.to_json(F.struct("packageKey", "questions")).alias("text"))
    return T.inspect_files(spark, L.write_texts(texts, L.scratch(spark, "streamed"))).select("packageKey", "n_questions")


@query("""SELECT 'bank' || s_nationkey AS "packageKey", 'i' || s_suppkey || '.txt' AS name, s_name AS content, NULL::VARCHAR AS error FROM supplier""")
def archive_entries(spark, sf_dir):
    """Every entry of archives of suppliers, each by its own range reads."""
    name = F.concat(F.lit("i"), F.col("s_suppkey").cast("string"), F.lit(".txt"))
    rows = B.table(spark, sf_dir, "supplier").select(F.concat(F.lit("bank"), F.col("s_nationkey").cast("string")).alias("packageKey"), name.alias("name"), F.col("s_name").alias("text"))
    made = rows.groupBy("packageKey").agg(F.map_from_entries(F.collect_list(F.struct("name", F.encode("text", "UTF-8")))).alias("media"))
    path = L.write_containers(L.containers(made.select("packageKey", F.lit("1").alias("version"), F.lit("{}").alias("manifest"), "media")), L.scratch(spark, "archives"))
    wanted = rows.select("packageKey", F.concat(F.lit(path + "/"), "packageKey", F.lit("-1.zip")).alias("path"), "name")
    found = T.read_entries(wanted)
    return found.select(F.regexp_extract("path", r"(bank\d+)-1\.zip$", 1).alias("packageKey"), "name", F.decode("content", "UTF-8").alias("content"), "error")


_WORD = "xmlns:w='w' xmlns:m='m' xmlns:a='a' xmlns:v='v' xmlns:r='http://r'"
_RELATED = "<Relationships><Relationship Id='r1' Target='media/a.png'/><Relationship Id='r2' Target='media/b.wmf'/><Relationship Id='r3' Target='media/a.png'/><Relationship Id='r4' Target='media/c.svg'/></Relationships>"


@query(r"""WITH s AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey AS n, s_suppkey % 6 AS k FROM supplier),
f AS (SELECT *, CASE k WHEN 0 THEN '\frac{' || n || '}{' || id || 'x}' WHEN 1 THEN '{' || n || '}^{' || id || '}' WHEN 2 THEN '\sqrt[' || n || ']{' || id || '}' WHEN 3 THEN '\sum_{i=' || n || '}^{' || id || '}{i}' WHEN 4 THEN '\left(' || n || '\le ' || id || '\right)' ELSE '\begin{matrix}' || n || ' & 1 \\ 0 & ' || id || '\end{matrix}' END AS formula FROM s),
t AS (SELECT *, name || ' ' || n || chr(10) || 'so $' || formula || '$ holds' || CASE WHEN n % 2 = 0 THEN '[图片1]' ELSE '' END || chr(10) || 'a' || id || ' | ' || CASE WHEN n % 2 = 0 THEN '[图片2]' ELSE '[图片1]' END || chr(10) || 'end' || CASE WHEN n % 2 = 1 THEN ' [图片2]' ELSE '' END AS text FROM f)
SELECT id, 'DOCX' AS kind, text, CAST(2 AS INT) AS images, CAST(CASE WHEN n % 2 = 0 THEN 2 ELSE 1 END AS INT) AS formula_image, CAST(1 AS INT) AS skipped FROM t""")
def word_documents(spark, sf_dir):
    """A word file of each supplier: a formula, images named twice, a table, an image of another kind."""
    n, k, id_ = F.col("s_nationkey").cast("string"), F.col("s_suppkey") % 6, F.col("s_suppkey").cast("string")
    run = lambda x: F.concat(F.lit("<m:r><m:t>"), x, F.lit("</m:t></m:r>"))
    tag = lambda name, *xs: F.concat(F.lit(f"<m:{name}>"), *[F.lit(x) if isinstance(x, str) else x for x in xs], F.lit(f"</m:{name}>"))
    cell = lambda x: tag("e", run(x))
    formula = (
        F.when(k == 0, tag("f", tag("num", run(n)), tag("den", run(F.concat(id_, F.lit("x"))))))
        .when(k == 1, tag("sSup", cell(n), tag("sup", run(id_))))
        .when(k == 2, tag("rad", tag("deg", run(n)), cell(id_)))
        .when(k == 3, tag("nary", "<m:naryPr><m:chr m:val='∑'/></m:naryPr>", tag("sub", run(F.concat(F.lit("i="), n))), tag("sup", run(id_)), cell(F.lit("i"))))
        .when(k == 4, tag("d", cell(F.concat(n, F.lit("≤"), id_))))
        .otherwise(tag("m", tag("mr", cell(n), cell(F.lit("1"))), tag("mr", cell(F.lit("0")), cell(id_))))
    )
    image = lambda r: f"<w:r><w:drawing><a:blip r:embed='{r}'/></w:drawing></w:r>"
    even = F.col("s_nationkey") % 2 == 0
    words = lambda *xs: F.concat(F.lit("<w:p>"), *[F.lit(x) if isinstance(x, str) else x for x in xs], F.lit("</w:p>"))
    text = lambda x: F.concat(F.lit("<w:r><w:t>"), F.lit(x) if isinstance(x, str) else x, F.lit("</w:t></w:r>"))
    body = F.concat(
        F.lit(f"<w:document {_WORD}><w:body>"),
        words(text(F.col("s_name")), "<w:r><w:tab/></w:r>", text(n)),
        words(text("so "), F.concat(F.lit("<m:oMath>"), formula, F.lit("</m:oMath>")), text(" holds"), F.when(even, image("r1")).otherwise("")),
        F.lit("<w:tbl><w:tr><w:tc>"), words(text(F.concat(F.lit("a"), id_))), F.lit("</w:tc><w:tc>"),
        words("<w:r><w:object><v:imagedata r:id='r2'/></w:object></w:r>"), F.lit("</w:tc></w:tr></w:tbl>"),
        words(text(F.when(even, "end").otherwise("end ")), image("r3"), image("r4")), F.lit("</w:body></w:document>"),
    )
    parts = {"word/document.xml": body, "word/_rels/document.xml.rels": F.lit(_RELATED), **{f"word/media/{m}": F.lit(m) for m in ("a.png", "b.wmf", "c.svg")}}
    media = F.map_from_arrays(F.array(*[F.lit(p) for p in parts]), F.array(*[F.encode(c, "UTF-8") for c in parts.values()]))
    rows = B.table(spark, sf_dir, "supplier").select(id_.alias("packageKey"), F.lit("docx").alias("version"), F.lit("{}").alias("manifest"), media.alias("media"))
    found = O.read_documents(spark, L.write_containers(L.containers(rows), L.scratch(spark, "word")))
    number = F.element_at(F.transform(F.filter("images", lambda i: i["formula"]), lambda i: i["number"]), 1)
    return found.select(F.regexp_extract("path", r"(\d+)-docx\.zip$", 1).cast("long").alias("id"), "kind", "text", F.size("images").alias("images"), number.alias("formula_image"), "skipped")
