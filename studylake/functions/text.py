"""String, date and version builders, and the grammar of exam texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylake.functions import grammar as G
from studylake.functions.arrays import bound

#: Marks of images inside texts (fixed format).
IMAGE = r"\[图片(\d+)\]"
#: Zero-width and byte-order characters (fixed values).
ZERO_WIDTH = "[\u200b\u200c\u200d\u2060\ufeff]"


def blank_to_null(x: Column) -> Column:
    """Trimmed, null if nothing is left."""
    t = F.trim(x)
    return F.when(t != "", t)


def clean_list(x: Column) -> Column:
    """A comma-joined list, trimmed, blanks dropped."""
    return F.array_join(F.filter(F.transform(F.split(x, ","), lambda p: F.trim(p)), lambda p: p != ""), ",")


def fold_space(x: Column) -> Column:
    """White space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def tidy(x: Column) -> Column:
    """Zero-width characters gone, wide blanks plain, ends of lines bare, two line feeds at most."""
    y = F.regexp_replace(x, ZERO_WIDTH, "")
    y = F.translate(y, "　 ", "  ")
    y = F.regexp_replace(y, r"[ \t]+(?=\n|$)", "")
    return F.regexp_replace(y, r"\n{3,}", "\n\n")


def latex(x: Column) -> Column:
    """Bracket delimiters of formulas as dollar signs."""
    for a, b in ((r"\(", "$"), (r"\)", "$"), (r"\[", "$$"), (r"\]", "$$")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def file_name(x: Column, most: int = 80) -> Column:
    """A safe file name: illegal characters as _, reserved names marked, cut."""
    y = F.regexp_replace(F.trim(x), r'[\\/:*?"<>|\x00-\x1f]', "_")
    y = F.regexp_replace(y, r"[. ]+$", "")
    y = F.when(F.upper(y).rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(\..*)?$"), F.concat(F.lit("_"), y)).otherwise(y)
    return F.when(y == "", "untitled").otherwise(F.substring(y, 1, most))


def valid_key(x: Column) -> Column:
    """Letters, digits, dot, underscore, hyphen; at most 100."""
    return x.rlike(r"^[\p{L}\p{N}._-]{1,100}$")


def head_and_tail(x: Column, most: int = 50000) -> Column:
    """The first and last halves of a text that is too long."""
    half = most // 2
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, half), F.lit("\n…\n"), F.substring(x, -half, half))).otherwise(x)


def fenced(x: Column) -> Column:
    """What a code fence holds, else the outermost braces or brackets, else the text."""
    fence = F.regexp_extract(x, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(x, r"(?s)([\[{].*[\]}])", 1)
    return F.regexp_replace(F.when(fence != "", fence).when(braces != "", braces).otherwise(x), r"^\s+|\s+$", "")


def images(x: Column) -> Column:
    """Numbers of image marks, distinct, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(IMAGE), F.lit(1)), lambda n: n.cast("int")))


def without_images(x: Column) -> Column:
    """The text without image marks."""
    return F.regexp_replace(x, IMAGE, "")


def question_key(content: Column, options: Column) -> Column:
    """Content and option texts without white space and underscores: equal for equal questions."""
    return F.lower(F.regexp_replace(F.concat(F.coalesce(content, F.lit("")), F.coalesce(F.array_join(options, ""), F.lit(""))), r"[\s_]+", ""))


def quality(content: Column, options: Column, answer: Column) -> Column:
    """Ten for an option, five for an answer, three for a stem of over thirty characters."""
    return F.coalesce(F.size(options), F.lit(0)) * 10 + F.when(F.trim(F.coalesce(answer, F.lit(""))) != "", 5).otherwise(0) + F.when(F.length(content) > 30, 3).otherwise(0)


def answer_of(line: Column, number: Column) -> Column:
    """The answer of a question in an answer line (bracketed, dotted or a range); null if it has none.

    A range's answers stand apart by blanks and marks, in the order of the numbers.
    """

    ranged = lambda r: F.when(number.between(r["start"], r["end"]), F.try_element_at(r["answers"], (number - r["start"] + 1).cast("int")))
    return bound(G.single_answer(line), lambda one: F.coalesce(F.when(one["number"] == number, one["answer"]), bound(G.answer_range(line), ranged)))


def is_answer_line(line: Column) -> Column:
    """Whether a line is an answer line of any form."""
    return G.is_single(line) | G.answer_range(line).isNotNull()


def decimal_like(line: Column) -> Column:
    """Whether a line begins with a decimal number (a number before a year isn't one)."""
    return G.is_decimal(line)


def question_number(line: Column) -> Column:
    """The number that a line begins a question with, else null (decimals and answer lines aren't questions)."""
    bare = F.trim(F.regexp_replace(line, rf"^(\s*{IMAGE})+", ""))
    return bound(bare, lambda x: F.when(~decimal_like(x) & (G.is_number_alone(x) | ~G.is_single(x)), G.start_number(x)))


def question_type(options: Column, heading: Column) -> Column:
    """Type from a heading's words (fixed values), else by the number of options."""
    h = F.coalesce(heading, F.lit(""))
    n = F.coalesce(F.size(options), F.lit(0))
    return F.when(h.contains("单"), "SINGLE").when(h.contains("多"), "MULTIPLE").when(h.rlike("判断|对错"), "JUDGE").when(h.rlike("主观|填空|简答|解答|计算|实验|问答"), "SUBJECTIVE").when(n >= 2, "SINGLE").otherwise("SUBJECTIVE")


def group_key(topic: Column, category: Column, external_id: Column) -> Column:
    """Topic, else category, else the key's first part; 160 characters."""
    return F.substring(F.coalesce(blank_to_null(topic), blank_to_null(category), blank_to_null(F.regexp_extract(external_id, r"^([^-_.]+)", 1))), 1, 160)


def host(url: Column) -> Column:
    """The lowered host of an address."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def private_host(h: Column) -> Column:
    """Whether a host is local or in a private range."""
    return h.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|0\.0\.0\.0|172\.(1[6-9]|2\d|3[01])\.)")


def redact(x: Column) -> Column:
    """Keys, bare or after the word that announces them, as ***."""
    named = r"api[_ -]?key\s*[:=]\s*"
    return F.regexp_replace(x, rf"(?i)(?:{BARE_KEY}|{named}){KEY_END}", "***")


def diagnostic(kind: Column, message: Column, most: int = 180) -> Column:
    """A failure in one line: its type, and its message without secrets, cut."""
    said = F.trim(F.regexp_replace(redact(F.coalesce(message, F.lit(""))), r"[\r\n]+", " "))
    cut = F.when(F.length(said) > most, F.concat(F.substring(said, 1, most), F.lit("…"))).otherwise(said)
    return F.when(cut == "", kind).otherwise(F.concat_ws(": ", kind, cut))


def masked_key(x: Column) -> Column:
    """A key with only its ends shown; null if blank."""
    ends = F.concat(F.substring(x, 1, 3), F.lit("***"), F.substring(x, -3, 3))
    return F.when(F.trim(x) != "", F.when(F.length(x) <= 6, "***").otherwise(ends))


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, place, line of each text."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("place", "line"))


def line_frequency(docs: DataFrame, key: str, least: int = 3) -> DataFrame:
    """Trimmed lines that occur so often over all texts."""
    rows = lines(docs, key).select(F.trim("line").alias("line")).filter("line <> ''")
    return rows.groupBy("line").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def repeated_inside(docs: DataFrame, key: str, least: int = 3) -> DataFrame:
    """key, line, n: lines that a text repeats (running heads and feet)."""
    rows = lines(docs, key).select(key, F.trim("line").alias("line")).filter("line <> ''")
    return rows.groupBy(key, "line").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def without_repeats(docs: DataFrame, key: str, least: int = 3) -> DataFrame:
    """Texts without the lines that they repeat, inside one row: no shuffle.

    Sorted by their trimmed text, ``least`` equal lines stand side by side; what
    stays goes back in its order.  A null text is one empty line.
    """
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = F.array_sort(F.transform(split, lambda x, i: F.struct(F.trim(x).alias("t"), i.alias("i"), x.alias("x"))))

    def stays(all_: Column, r: Column, i: Column) -> Column:
        crowded = F.lit(False)
        for before in range(least):
            first = F.get(all_, i - before)["t"]
            crowded = crowded | F.coalesce((i >= before) & (first == F.get(all_, i - before + least - 1)["t"]), F.lit(False))
        return (r["t"] == "") | ~crowded

    left = bound(rows, lambda all_: F.filter(all_, lambda r, i: stays(all_, r, i)))
    kept = F.transform(F.array_sort(F.transform(left, lambda r: F.struct(r["i"].alias("i"), r["x"].alias("x")))), lambda r: r["x"])
    done = docs.select(key, F.size(split).alias("n_lines"), kept.alias("kept"))
    return done.select(key, "n_lines", F.size("kept").alias("n_kept"), F.array_join("kept", "\n").alias("text"))


def questions_in(docs: DataFrame, key: str) -> DataFrame:
    """key, question, body: a text cut at lines that begin a question.

    The section of a line is the running count of beginnings before it; it is
    taken over each text's own lines.
    """
    own = Window.partitionBy(key).orderBy("place")
    rows = lines(docs, key).withColumn("number", question_number(F.col("line"))).withColumn("section", F.count("number").over(own))
    part = rows.filter("section > 0").groupBy(key, "section")
    return part.agg(F.max("number").alias("question"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("body"))


def best_of(rows: DataFrame, keys: list[str], score: str, place: str) -> DataFrame:
    """Best score of each key, ties to the first; placed where the key came first."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(score, -F.col(place)))
    return rows.groupBy(*keys).agg(best.alias("b"), F.min(place).alias("first_place")).select(*keys, "b.*", "first_place")


def missing_numbers(found: DataFrame, key: str, number: str, most: int = 12) -> DataFrame:
    """Numbers between a document's smallest and largest that it lacks, the first ``most``."""
    per = found.groupBy(key).agg(F.array_sort(F.collect_set(number)).alias("have")).filter(F.size("have") >= 5)
    want = F.sequence(F.element_at("have", 1), F.element_at("have", -1))
    return per.select(key, F.explode(F.slice(F.array_except(want, F.col("have")), 1, most)).alias("missing"))


def clusters(rows: DataFrame, key: str, at: str, gap: float = 25.0) -> DataFrame:
    """Rows with the island of neighbours no further than ``gap`` apart."""
    order = Window.partitionBy(key).orderBy(at)
    far = F.when(F.col(at) - F.lag(at).over(order) > gap, 1).otherwise(0)
    return rows.withColumn("far", far).withColumn("cluster", F.sum("far").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("far")


def page_of(offsets: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """The page that an offset lies in: the last start at or before it."""
    pages = starts.groupBy(key).agg(F.array_sort(F.collect_list("start")).alias("starts"))
    return offsets.join(pages, key, "left").withColumn("page", F.size(F.filter("starts", lambda s: s <= F.col("offset")))).drop("starts")


#: Classes of failures in the order of their tests: words of the message, types of the causes (fixed values).
FAILURES = (
    ("MODEL_TIMEOUT", ("timeout", "超时"), ("HttpTimeoutException", "SocketTimeoutException")),
    ("MODEL_RATE_LIMITED", ("http 429", "rate limit", "限流", "请求过于频繁"), ()),
    ("MODEL_CONNECTION_FAILED", ("无法连接", "connection refused"), ("ConnectException", "UnknownHostException")),
    ("MODEL_RESPONSE_INVALID", ("ai 输出不是合法 json", "模型返回空白", "响应格式异常", "模型端点持续返回空白"), ()),
    ("DOCUMENT_PARSE_FAILED", ("mineru", "文档解析", "pdf", "docx"), ("IOException",)),
)
OTHER_FAILURE = "IMPORT_PROCESSING_FAILED"


def failure_class(message: Column, causes: Column | None = None) -> Column:
    """A class of failure, by ordered tests of the messages and, where known, the causes' types (an array)."""
    m = F.lower(F.coalesce(message, F.lit("")))
    found = F.lit(OTHER_FAILURE)
    for name, words, types in reversed(FAILURES):
        test = F.lit(False)
        for w in words:
            test = test | F.contains(m, F.lit(w))
        if causes is not None and types:
            test = test | F.coalesce(F.arrays_overlap(causes, F.array(*[F.lit(t) for t in types])), F.lit(False))
        found = F.when(test, name).otherwise(found)
    return found


# --- marks, markup, addresses ----------------------------------------------------------------------------

#: Keys in messages, the tags and attributes of tables that stay, lines of advertising (fixed values).
BARE_KEY, KEY_END = "sk-[a-z0-9_-]{8,}", r"[^\s,;)}\]]+"
TABLE_TAGS, TABLE_ATTRIBUTES = ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"), "colspan|rowspan"
ADVERTS = ("扫一扫", "粉笔客户端", "提交答案后即可", "听课刷题", "扫描二维码下载")


def has_marks(x: Column) -> Column:
    """Whether a note holds a highlight, bold or underlined run within one line."""
    runs = [rf"{m}[^{c}\n]{t}{m}" for m, c, t in (("==", "=", "*"), (r"\*\*", "*", "+"), ("__", "_", "+"))]
    return F.coalesce(x, F.lit("")).rlike("|".join(runs))


def table_html(x: Column) -> Column:
    """Table markup with only table tags and spans; scripts and styles go whole, other tags leave their text."""
    plain = F.regexp_replace(x, r"(?is)<(script|style|iframe|object|embed|link|meta)\b.*?</\1\s*>|<(script|style|iframe|object|embed|link|meta)\b[^>]*>", "")
    span = rf"""(?i)\b(?:{TABLE_ATTRIBUTES})\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+)"""

    def attribute(k: Column) -> Column:
        value = F.regexp_replace(F.regexp_replace(k, r"^[^=]*=\s*", ""), r"""^["']|["']$""", "")
        return F.concat(F.trim(F.substring_index(k, "=", 1)), F.lit('="'), value, F.lit('"'))

    def tag(t: Column) -> Column:
        name = F.lower(F.regexp_extract(t, r"^<\s*/?\s*([A-Za-z0-9]+)", 1))
        opened = F.concat(F.lit("<"), F.concat_ws(" ", F.array(name), F.transform(F.regexp_extract_all(t, F.lit(span), F.lit(0)), attribute)), F.lit(">"))
        return F.when(name.isin(*TABLE_TAGS), F.when(t.rlike(r"^<\s*/"), F.concat(F.lit("</"), name, F.lit(">"))).otherwise(opened)).otherwise("")

    tags = F.transform(F.regexp_extract_all(plain, F.lit("<[^>]+>"), F.lit(0)), tag)
    return F.array_join(F.zip_with(F.split(plain, "<[^>]+>", -1), F.concat(tags, F.array(F.lit(""))), lambda p, t: F.concat(p, t)), "")


def base_address(x: Column, default: str) -> Column:
    """An http address without trailing slashes, the default if blank; null with a query, a fragment or another scheme."""
    y = F.coalesce(blank_to_null(x), F.lit(default))
    fine = y.rlike(r"(?i)^https?://[^/\s?#]+") & ~y.rlike("[?#]")
    return F.when(fine, F.regexp_replace(y, "/+$", ""))


def appended(base: Column, path: Column) -> Column:
    """A path below a base address; null unless the path begins with a slash."""
    return F.when(path.startswith("/"), F.concat(base, path))


def first_filled(*fields: Column) -> Column:
    """The first of the fields that isn't blank, trimmed."""
    return F.coalesce(*[blank_to_null(f) for f in fields])


def decoded(x: Column) -> Column:
    """The bytes of a Base64 text, null if it is none."""
    return F.try_to_binary(x, F.lit("base64"))


def squeezed(x: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(x, r"\s+", "")


def without_adverts(x: Column) -> Column:
    """Trimmed lines without advertising and without paths of images; lines left empty by that go too."""
    def line(t: Column) -> Column:
        return F.trim(F.regexp_replace(t, r"images/[A-Za-z0-9._-]+\.(?:jpg|jpeg|png|webp)", ""))

    advert = lambda t: t.rlike("|".join(ADVERTS))
    kept = F.filter(F.transform(F.split(x, r"\r\n|\n|\r", -1), lambda t: F.trim(t)), lambda t: (t == "") | (~advert(t) & (line(t) != "")))
    return F.array_join(F.transform(kept, line), "\n")


def numbers_begin_lines(x: Column) -> Column:
    """Question numbers inside a line on lines of their own; numbers with digits or points beside them stay."""
    return F.regexp_replace(x, rf"(?<![.\p{{N}}])([0-9]{{1,3}})([.、．])(?![.\p{{N}}])", "\n$1$2")
