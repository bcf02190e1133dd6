"""Documents to questions: the Markdown form, line by line, and numbers filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylake.functions import exam as M
from studylake.functions import grammar as G
from studylake.functions import text as X


def _joined(section: str, name: str) -> Column:
    parts = F.array_sort(F.collect_list(F.when(F.col("section") == section, F.struct("place", F.col("body")))))
    return F.regexp_replace(F.array_join(F.transform(parts, lambda x: x["body"]), "\n"), r"^\s+|\s+$", "").alias(name)


def markdown_questions(docs: DataFrame, key: str) -> DataFrame:
    """Questions of Markdown texts: key, block, number, type, content, options, answer_keys, analysis, reference, material.

    A block is what follows a question or material heading; a text before the
    first heading, and a text without any, is block 0.  All windows run within
    one document's lines.
    """
    line = F.trim("line")
    own, block = Window.partitionBy(key).orderBy("place"), Window.partitionBy(key, "block").orderBy("place")
    rows = X.lines(docs, key).withColumn("of_heading", G.question_heading(line)).withColumn("number", F.col("of_heading.number")).withColumn("is_material", G.is_material_heading(line))
    head = F.col("number").isNotNull() | F.col("is_material")
    rows = rows.withColumn("head", head).withColumn("block", F.count_if("head").over(own)).withColumn("kind", F.when(head, F.coalesce("of_heading.kind", F.lit(""))))
    rows = rows.withColumn("of_field", F.when(~F.col("head"), G.field(line))).withColumn("field", F.col("of_field.name"))
    option = ~F.col("head") & F.col("field").isNull() & G.option(line).isNotNull()
    # Options without their field begin at the first option line of a stem that has two.
    rows = rows.withColumn("option", option).withColumn("n_options", F.count_if("option").over(Window.partitionBy(key, "block")))
    opens = F.when(F.col("option") & (F.col("n_options") >= 2) & (F.count("field").over(block) == F.count(F.when(F.col("field") == "题干", 1)).over(block)), "选项")
    rows = rows.withColumn("mark", F.coalesce("field", opens)).withColumn("section", F.coalesce(F.last("mark", True).over(block), F.lit("题干")))
    rows = rows.withColumn("body", F.when(F.col("field").isNotNull(), F.col("of_field.rest")).otherwise(line)).filter("NOT head OR is_material OR number IS NOT NULL")
    per = rows.groupBy(key, "block").agg(
        F.max("number").alias("number"),
        F.bool_or("is_material").alias("is_material"),
        F.max("kind").alias("heading"),
        *[_joined(s, n) for s, n in (("题干", "stem"), ("选项", "option_lines"), ("答案", "answer"), ("解析", "analysis"), ("参考答案", "reference"))],
        F.max(F.when(F.col("head"), F.col("line"))).alias("title"),
    )
    # A heading's own line is no part of the stem.
    stem = F.trim(F.when(F.col("title").isNotNull(), F.regexp_replace(F.substr("stem", F.length(F.trim("title")) + 1), r"^\s+", "")).otherwise(F.col("stem")))
    per = per.withColumn("content", stem)
    materials = F.last(F.when(F.col("is_material") & (F.col("content") != ""), F.concat(F.lit("m"), F.col("block").cast("string"))), True).over(Window.partitionBy(key).orderBy("block"))
    # A line that is no option goes on with the option before it.
    marked = F.array_join(F.transform(F.split("option_lines", "\n"), lambda x: F.concat(F.when(G.option(x).isNotNull(), "\n").otherwise(""), x)), "")
    options = F.flatten(F.transform(F.filter(F.split(marked, "\n"), lambda x: x != ""), lambda x: M.options_of(x)))
    made = per.withColumn("material", materials).withColumn("options", options).filter("NOT is_material AND content <> ''")
    return made.select(key, "block", "number", X.question_type(F.col("options"), F.col("heading")).alias("type"), "content", "options", M.answer_letters(F.col("answer")).alias("answer_keys"), X.blank_to_null(F.col("analysis")).alias("analysis"), X.blank_to_null(F.col("reference")).alias("reference"), "material")


def fill_numbers(found: DataFrame, key: str) -> DataFrame:
    """Questions (key, position, number) with free numbers below the smallest known one for those without."""
    per = found.groupBy(key).agg(F.min("number").alias("low"), F.collect_set("number").alias("taken"))
    order = Window.partitionBy(key, F.col("number").isNull()).orderBy("position")
    free = F.array_except(F.sequence(F.lit(1), F.greatest(F.col("low") - 1, F.lit(1))), F.col("taken"))
    rows = found.withColumn("n", F.row_number().over(order)).join(per, key)
    given = F.when(F.col("low") > 1, F.try_element_at(free, F.col("n")))
    return rows.withColumn("number", F.coalesce("number", given)).drop("n", "low", "taken")


def clear_dangling(questions: DataFrame, materials: DataFrame, key: str) -> DataFrame:
    """Questions with references to materials that their document lacks cleared."""
    known = materials.select(key, "material", F.lit(True).alias("_known")).distinct()
    return questions.join(known, [key, "material"], "left").withColumn("material", F.when(F.col("_known"), F.col("material"))).drop("_known")


def merge_files(files: DataFrame, job: str) -> DataFrame:
    """Files of a job with the pages before each added to its page numbers."""
    before = Window.partitionBy(job).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("first_page", F.coalesce(F.sum("pages").over(before), F.lit(0)))


def missing_pages(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Pages with fewer parsed questions than the source shows: key, page, expected, found."""
    have = found.groupBy(key, "page").agg(F.count("*").alias("found"))
    rows = expected.join(have, [key, "page"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return rows.filter(F.col("found") < F.col("expected"))


def degraded(source: DataFrame, found: DataFrame, key: str, least: int = 5, most: int = 3) -> DataFrame:
    """Documents whose source has numbers enough but of which almost nothing was parsed."""
    n = found.groupBy(key).agg(F.count("*").alias("parsed"))
    rows = source.select(key, M.loose_count(F.col("text")).alias("numbers")).join(n, key, "left").withColumn("parsed", F.coalesce("parsed", F.lit(0)))
    return rows.filter((F.col("numbers") >= least) & (F.col("parsed") < most))


def image_chains(blocks: DataFrame, key: str) -> DataFrame:
    """Image blocks with the number of their chain: tags don't break a chain, text and noise do."""
    order = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    broken = F.count_if(F.col("kind").isin("text", "noise")).over(order)
    return blocks.withColumn("chain", broken).filter("kind = 'image'")


#: What a model's reply holds, every field optional.
REPLY_QUESTION = "struct<questionNumber:int,type:string,content:string,options:array<struct<key:string,text:string>>,answerKeys:array<string>,answerText:string,analysis:string,referenceAnswer:string,materialKey:string,score:double>"
REPLY_MATERIAL = "struct<materialKey:string,content:string>"


def decode(replies: DataFrame, key: str) -> DataFrame:
    """key, questions, materials, error of model replies: an array of questions, or {materials, questions}.

    A fence around the JSON goes; elements that don't fit are left out, the others stay.
    """
    # A column of its own, as every use in one select would look for the fence again.
    replies, body = replies.select(key, X.fenced(F.col("reply")).alias("body")), F.col("body")
    raw = F.from_json(body, "questions string, materials string")
    array = body.rlike(r"^\s*\[")
    listed = lambda text, kind: F.filter(F.transform(F.from_json(text, "array<string>"), lambda x: F.from_json(x, kind)), lambda x: x.isNotNull())
    none = lambda kind: F.array().cast(f"array<{kind}>")
    rows = replies.select(key, array.alias("array"), F.when(array, body).otherwise(raw["questions"]).alias("q"), raw["materials"].alias("m"), F.try_parse_json(body).isNull().alias("bad"))
    return rows.select(
        key,
        F.coalesce(listed(F.col("q"), REPLY_QUESTION), none(REPLY_QUESTION)).alias("questions"),
        F.coalesce(F.when(~F.col("array"), listed(F.col("m"), REPLY_MATERIAL)), none(REPLY_MATERIAL)).alias("materials"),
        F.when(F.col("bad"), "NOT_JSON").alias("error"),
    )


def reply_questions(decoded: DataFrame, key: str) -> DataFrame:
    """key, position and the checked questions of decoded replies.

    Questions without content go; types, options and scores get their defaults; a
    material that the reply doesn't hold with content is no reference.
    """
    known = F.transform(F.filter("materials", lambda m: (F.trim(F.coalesce(m["materialKey"], F.lit(""))) != "") & (F.trim(F.coalesce(m["content"], F.lit(""))) != "")), lambda m: m["materialKey"])
    # Outer: for a plain one Spark puts a filter on the array's size before it, which decodes the reply once more; the filter on content drops its nulls.
    rows = decoded.select(key, known.alias("known"), F.posexplode_outer("questions").alias("position", "q")).filter(F.trim("q.content") != "")
    rows = rows.withColumn("c", M.checked_question(F.col("q.type"), F.col("q.options"), F.col("q.score")))
    material = F.when(F.array_contains("known", F.col("q.materialKey")), F.col("q.materialKey"))
    return rows.select(key, "position", F.col("q.questionNumber").alias("number"), F.trim("q.content").alias("content"), "c.type", "c.options", "c.score", F.coalesce("q.answerKeys", F.array().cast("array<string>")).alias("answer_keys"), material.alias("material"))


def reply_materials(decoded: DataFrame, key: str) -> DataFrame:
    """key, material, content: the first of each key that has both."""
    rows = decoded.select(key, F.posexplode_outer("materials").alias("place", "m")).filter((F.trim("m.materialKey") != "") & (F.trim("m.content") != ""))
    return rows.groupBy(key, F.col("m.materialKey").alias("material")).agg(F.min_by("m.content", "place").alias("content"))


def with_source(questions: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Questions with what their document's text says: line, number_there (of the content), evidence, borne_out, options_there.

    Each question meets its own document; a text is cut into lines once for each.
    """
    rows = questions.join(sources.select(key, F.col("text").alias("_text")), key, "left").withColumn("_lines", F.split(F.coalesce("_text", F.lit("")), r"\r\n|\n|\r", -1))
    plain = X.without_images(F.col("content"))
    rows = rows.withColumn("line", M.content_line(F.col("_lines"), plain)).withColumn("number_there", M.number_near(F.col("_lines"), F.col("line"), True))
    rows = rows.withColumn("evidence", M.answer_evidence(F.coalesce("_text", F.lit("")), plain, F.col("number")))
    there = F.when(F.col("number_there").isNotNull(), M.options_at_question(F.col("_lines"), F.col("options"), F.col("number_there"))).otherwise(F.lit(True))
    return rows.withColumn("borne_out", M.agrees(F.col("answer_keys"), F.col("evidence"))).withColumn("options_there", there).drop("_text", "_lines")


def repaired(questions: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Questions whose stem and options fit their document's text, stems put together from it where they stand above their number.

    Questions of a material and those of a document without text stay as they are.
    """
    rows = questions.join(sources.select(key, F.col("text").alias("_text")), key, "left")
    lines_ = F.split(F.coalesce("_text", F.lit("")), r"\r\n|\n|\r", -1)
    bare = F.trim(F.coalesce("_text", F.lit(""))) == ""
    if "material" in questions.columns:
        bare = bare | (F.trim(F.coalesce("material", F.lit(""))) != "")
    rows = rows.withColumn("_bare", bare).withColumn("_s", M.from_source(lines_, F.col("content"), F.col("options"), F.col("type")))
    return rows.filter(F.col("_bare") | F.col("_s.kept")).withColumn("content", F.when(F.col("_bare"), F.col("content")).otherwise(F.col("_s.content"))).select(*questions.columns)


def recovered(questions: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Questions with the model's answers cleared and those that the source gives put in, with their source label."""
    rows = with_source(questions, sources, key).join(sources.select(key, F.col("text").alias("_text")), key, "left")
    subjective = F.col("type") == "SUBJECTIVE"
    keys = F.array_sort(F.array_intersect("evidence", F.transform("options", lambda o: F.upper(o["key"]))))
    none = F.array().cast("array<string>")
    reference = F.when(subjective, M.bracket_answer(F.col("_text"), F.coalesce("number", "number_there")))
    rows = rows.withColumn("answer_keys", F.when(subjective, none).otherwise(F.coalesce(keys, none))).withColumn("reference", reference)
    label = F.when((F.size("answer_keys") > 0) | F.col("reference").isNotNull(), "ORIGINAL")
    return rows.withColumn("answer_source", label).drop("_text", "line", "number_there", "evidence", "borne_out", "options_there")


def by_position(questions: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Questions with their place in the order of the source: those found by line, then the others as they came."""
    rows = with_source(questions, sources, key)
    order = Window.partitionBy(key).orderBy(F.col("line") < 0, "line", "position")
    return rows.withColumn("place", F.row_number().over(order)).select(*questions.columns, "place")


def reading_order(blocks: DataFrame, key: str, pdf: bool = True) -> DataFrame:
    """key, page, place, kind, text of page blocks (key, page, type, text, x, y, width, height) in reading order.

    Heads and feet go, and images shorter than 24 points; noise stays as a kind;
    numbers in circles are tags.  Images before the first page with a question
    number go, and pages of a PDF without text.
    """
    image = F.col("type").isin("image", "chart")
    text = X.numbers_begin_lines(F.col("text"))
    tag = F.trim("text").rlike(r"^(?:[\u2460-\u2473]|\d{1,2})$")
    kind = F.when(image, "image").when(M.layout_noise(F.col("text")) & ~tag, "noise").when(tag, "tag").otherwise("text")
    rows = blocks.filter(~F.col("type").startswith("page_")).filter(~image | (F.least("width", "height") >= 24)).filter(image | (F.trim("text") != ""))
    rows = rows.select(key, "page", "x", "y", kind.alias("kind"), F.when(~image, text).otherwise(F.col("text")).alias("text"))
    asks = F.when((F.col("kind") == "text") & F.col("text").rlike(r"(^|[^\d])\d{1,3}[.、．]"), F.col("page"))
    own = Window.partitionBy(key)
    rows = rows.withColumn("first_page", F.min(asks).over(own)).withColumn("has_text", F.count_if(F.col("kind") == "text").over(Window.partitionBy(key, "page")) > 0)
    early = (F.col("kind") == "image") & F.coalesce(F.col("page") < F.col("first_page"), F.lit(False))
    kept = rows.filter(~early & (F.col("has_text") | F.lit(not pdf)))
    order = Window.partitionBy(key, "page").orderBy("y", "x", "kind", "text")
    return kept.withColumn("place", F.row_number().over(order)).select(key, "page", "place", "kind", "text")


def grids(boxes: DataFrame, key: str, gap: float = 25.0, column: float = 12.0, apart: float = 200.0) -> DataFrame:
    """key, rows, columns, grid: whether images (key, id, x, y, width, height) stand in two or three equal, aligned rows."""
    rows = X.clusters(boxes.withColumn("cy", F.col("y") + F.col("height") / 2), key, "cy", gap)
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(key, "cluster").orderBy("x", "id")))
    head = F.min(F.when(F.col("cluster") == 0, F.col("x"))).over(Window.partitionBy(key, "k"))
    per = rows.withColumn("off", F.abs(F.col("x") - head)).groupBy(key, "cluster").agg(F.count("*").alias("n"), F.avg("cy").alias("cy"), F.max(F.coalesce("off", F.lit(1e9))).alias("off"))
    per = per.withColumn("step", F.col("cy") - F.lag("cy").over(Window.partitionBy(key).orderBy("cluster")))
    whole = per.groupBy(key).agg(F.count("*").alias("rows"), F.min("n").alias("least"), F.max("n").alias("columns"), F.max("off").alias("off"), F.coalesce(F.max("step"), F.lit(0.0)).alias("step"))
    grid = F.col("rows").between(2, 3) & (F.col("least") == F.col("columns")) & (F.col("columns") >= 2) & (F.col("off") <= column) & (F.col("step") <= apart)
    return whole.select(key, "rows", "columns", grid.alias("grid"))


#: So much of a question goes with a formula's image as its context (fixed value).
CONTEXT = 120


def plain_delimiters(questions: DataFrame, *fields: str) -> DataFrame:
    """Dollar signs around formulas in every text of the questions: the named fields, and the options where there are any."""
    given = {c: X.latex(F.col(c)) for c in fields}
    if "options" in questions.columns:
        given["options"] = F.transform("options", lambda o: o.withField("text", X.latex(o["text"])))
    return questions.withColumns(given)


def leftover_formulas(questions: DataFrame, materials: DataFrame, formulas: DataFrame, key: str) -> DataFrame:
    """key, number, context, places: images of formulas (key, number) that texts still refer to.

    Looked for in contents, options, reference answers and answer texts of the
    questions (key, position, content, options, reference, answer_text) and in
    the materials (key, position, content).  ``context``: the beginning of the
    first content around such a reference that isn't blank, without marks, one
    line; empty if there is none.  ``places``: questions and materials that
    refer to it.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    options = F.array_join(F.transform(F.coalesce("options", F.array().cast("array<struct<key:string,text:string>>")), lambda o: text(o["text"])), "\n")
    whole = F.concat_ws("\n", text(F.col("content")), options, text(F.col("reference")), text(F.col("answer_text")))
    line = F.trim(F.regexp_replace(F.regexp_replace(text(F.col("content")), r"\s+", " "), X.IMAGE, " "))
    context = F.substring(line, 1, CONTEXT).alias("context")
    rows = questions.select(key, F.lit(0).alias("kind"), "position", context, F.explode(X.images(whole)).alias("number"))
    rows = rows.unionByName(materials.select(key, F.lit(1).alias("kind"), "position", context, F.explode(X.images(text(F.col("content")))).alias("number")))
    known = formulas.select(key, F.col("number").cast("int").alias("number")).distinct()
    place = F.when(F.trim("context") != "", F.struct("kind", "position"))
    return rows.join(known, [key, "number"]).groupBy(key, "number").agg(F.coalesce(F.min_by("context", place), F.lit("")).alias("context"), F.count("*").alias("places"))
