"""Cleaning of a document's pages: running heads and feet, wrapped decimals, numbers that stand after their question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from studylake.functions.arrays import bound, scan

#: Words of a stem and marks at its end (fixed values).
STEM_WORDS = (
    "是指", "指的是", "下列", "属于", "根据", "据此", "从所给", "要求", "关于", "以下", "上述", "主要", "说明", "表明", "体现", "推断", "能够", "应当", "必须", "填入", "选择", "正确", "错误", "相当于", "方式", "关系",
)
STEM_ENDS, ASKING_MARKS, NUMBER_MARKS = "。！？：:；", "：:？?）)", ".．、"
#: A stem that moves has at most so many lines and characters (fixed values).
MOST_LINES, MOST_CHARACTERS = 4, 300
_LINE_END = "\r\n|[\n\u000b\u000c\r\u0085\u2028\u2029]"
_BLANK = "".join(map(chr, range(33)))


def _bare(x: Column) -> Column:
    return F.btrim(x, F.lit(_BLANK))


def is_footer(line: Column) -> Column:
    """A page's number out of all pages."""
    said = F.translate(F.regexp_replace(line, r"\s+", ""), "0123456789０１２３４５６７８９，", "#" * 20 + ",")
    return F.regexp_replace(F.regexp_replace(said, "#+", "#"), ",", "").contains("第#页共#页")


def wraps_decimal(line: Column) -> Column:
    """A line that goes on with a decimal number."""
    return F.regexp_extract(line, r"^(\d+)\.\d", 1).rlike("^.{1,3}$")


def number_alone(line: Column) -> Column:
    """A question's number without anything else."""
    body = F.regexp_replace(line, r"\s+", "")
    return (body != "") & F.contains(F.lit(NUMBER_MARKS), F.right(body, F.lit(1))) & F.left(body, F.length(body) - 1).rlike(r"^\d{1,3}$") & ~line.rlike(r"\d\s+\d")


def number_behind(line: Column) -> Column:
    """(line, number) of a line that asks and ends with a question's number, else null."""
    body = F.regexp_replace(line, rf"\s*[{NUMBER_MARKS}]\s*$", "")
    number = F.regexp_extract(body, r"(\d{1,3})$", 1)
    head = F.left(body, F.length(body) - F.length(number))
    end = F.right(F.regexp_replace(head, r"\s+$", ""), F.lit(1))
    asks = (end != "") & F.contains(F.lit(ASKING_MARKS), end) & (F.length(F.trim(head)) > 1)
    return F.when((body != line) & (number != "") & asks, F.struct(head.alias("line"), F.concat(number, F.lit(".")).alias("number")))


def stem_like(line: Column) -> Column:
    """Whether a line reads like (a part of) a question's stem: no option, no answer, the words or the end of one."""
    first = F.upper(F.left(line, F.lit(1)))
    rest = F.left(F.ltrim(F.substring(line, 2, 1_000_000_000)), F.lit(1))
    option = first.between("A", "H") & (rest != "") & F.contains(F.lit(NUMBER_MARKS), rest)
    answer = line.startswith("答案") | line.startswith("参考答案") | line.startswith("解析")
    words = F.lit(False)
    for w in STEM_WORDS:
        words = words | line.contains(w)
    return (line != "") & ~option & ~answer & (words | F.contains(F.lit(STEM_ENDS), F.right(line, F.lit(1))))


def _lines(pages: Column) -> Column:
    """(t, page, i, x) of all lines, each page led by an entry without line (i = -1)."""

    def of(p: Column, k: Column) -> Column:
        entry = lambda x, i: F.struct(_bare(x).alias("t"), k.alias("page"), i.alias("i"), x.alias("x"))
        return F.concat(F.array(entry(F.lit(""), F.lit(-1))), F.transform(F.split(F.coalesce(p, F.lit("")), _LINE_END, -1), entry))

    return F.flatten(F.transform(pages, of))


def _without_repeats(lines: Column, least: int) -> Column:
    """Lines that stand fewer than ``least`` times in the document and are no page's foot: equal lines are side by side when sorted."""

    def stays(all_: Column, r: Column, i: Column) -> Column:
        crowded = F.lit(False)
        for before in range(least):
            same = (F.get(all_, i - before)["t"] == r["t"]) & (F.get(all_, i - before + least - 1)["t"] == r["t"])
            crowded = crowded | F.coalesce((i >= before) & same, F.lit(False))
        return (r["t"] == "") | ~(crowded | is_footer(r["t"]))

    left = bound(F.array_sort(lines), lambda all_: F.filter(all_, lambda r, i: stays(all_, r, i)))
    return F.array_sort(F.transform(left, lambda r: F.struct(r["page"].alias("page"), r["i"].alias("i"), r["t"].alias("t"), r["x"].alias("x"))))


def _joined(lines: Column) -> Column:
    """(x, top) after numbers behind a line got their own and wrapped decimals went to the line before."""

    def pieces(all_: Column) -> Column:
        def of(r: Column, at: Column) -> Column:
            part = lambda x, joins: F.struct(x.alias("x"), F.lit(joins).alias("joins"), (r["i"] < 0).alias("top"))
            wraps = (r["i"] >= 0) & wraps_decimal(r["t"]) & F.coalesce(F.get(all_, at - 1)["i"] >= 0, F.lit(False))
            split = lambda b: F.when(wraps, F.array(part(r["t"], True))).when(b.isNotNull(), F.array(part(b["line"], False), part(b["number"], False))).otherwise(F.array(part(r["x"], False)))
            return bound(number_behind(r["t"]), split)

        return F.flatten(F.transform(all_, of))

    def put(all_: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(all_) - 1), lambda i: ~F.get(all_, i)["joins"])

        def group(hs: Column, h: Column, j: Column) -> Column:
            n = F.coalesce(F.get(hs, j + 1), F.size(all_)) - h
            return F.struct(F.array_join(F.transform(F.slice(all_, h + 1, n), lambda r: r["x"]), "").alias("x"), F.get(all_, h)["top"].alias("top"))

        return bound(heads, lambda hs: F.transform(hs, lambda h, j: group(hs, h, j)))

    return bound(bound(lines, pieces), put)


def _in_order(lines: Column) -> Column:
    """(x, top) with a question's number before the stem that stood above it.

    One pass keeps the lines and characters of the stem so far.  A number goes
    before that stem if it is short; then stem and number are one stretch, in
    which numbers come first.  A long stem is a passage: the number stays, and
    it, like any other line, begins a new stretch.
    """

    def entry(r: Column, i: Column) -> Column:
        t = _bare(r["x"])
        kind = F.when(r["top"], "top").when(number_alone(t), "number").when(stem_like(t), "stem").otherwise("other")
        return F.struct(kind.alias("kind"), i.cast("int").alias("i"), F.length(t).alias("n"), t.alias("t"), r["x"].alias("x"))

    def state(stretch: Column, rank: int, lines_: Column, chars: Column, next_: Column, moved: Column) -> Column:
        return F.struct(stretch.alias("stretch"), F.lit(rank).alias("rank"), lines_.alias("lines"), chars.alias("chars"), next_.alias("next"), moved.alias("moved"))

    def step(s: Column, x: Column) -> Column:
        at, none, no = s["next"], F.lit(0), F.lit(False)
        short = (s["lines"] <= MOST_LINES) & (s["chars"] <= MOST_CHARACTERS)
        stem = state(at, 1, s["lines"] + 1, s["chars"] + x["n"], at, no)
        before, behind = state(at, 0, s["lines"], s["chars"], at, s["lines"] > 0), state(at, 2, none, none, at + 1, no)
        return F.when(x["kind"] == "stem", stem).when(x["kind"] != "number", state(at + 1, 0, none, none, at + 2, no)).when(short, before).otherwise(behind)

    kind = "struct<stretch:int,rank:int,lines:int,chars:int,next:int,moved:boolean>"
    start = F.struct(*[F.lit(0)] * 5, F.lit(False))

    def ordered(all_: Column) -> Column:
        keyed = F.zip_with(all_, scan(all_, start, kind, step), lambda x, s: F.struct(s["stretch"].alias("stretch"), s["rank"].alias("rank"), x["i"].alias("i"), s["moved"].alias("moved"), x.alias("line")))
        return F.array_sort(keyed)

    def last_number(s: Column, x: Column) -> Column:
        return F.when(x["moved"], F.struct(x["stretch"].alias("stretch"), x["i"].alias("i"))).otherwise(s)

    def finished(rows: Column) -> Column:
        numbers = scan(rows, F.struct(F.lit(-1), F.lit(-1)), "struct<stretch:int,i:int>", last_number)
        carried = lambda x, s: (x["rank"] == 1) & (s["stretch"] == x["stretch"]) & (s["i"] > x["i"])
        return F.zip_with(rows, numbers, lambda x, s: F.struct(F.when(carried(x, s), x["line"]["t"]).otherwise(x["line"]["x"]).alias("x"), (x["line"]["kind"] == "top").alias("top")))

    return bound(bound(F.transform(lines, entry), ordered), finished)


def _plain(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.translate(x, "\u3000", " "), "[\u200b-\u200d\ufeff]", ""), r"[ \t]+$", "")


def clean_pages(pages: Column, least: int = 3) -> Column:
    """Cleaned texts of a document's pages (array of texts), in their order.

    Lines that the document repeats ``least`` times go, and the feet that count
    pages; a line that begins with a decimal belongs to the line before; a
    question's number behind or below its short stem goes before it; zero-width
    characters go, blank lines stand alone.  A null page is one empty line, a
    null document null.  The cost follows the text's length.
    """

    def texts(all_: Column) -> Column:
        tops = F.filter(F.sequence(F.lit(0), F.size(all_) - 1), lambda i: F.get(all_, i)["top"])

        def page(ts: Column, at: Column, j: Column) -> Column:
            own = F.transform(F.slice(all_, at + 2, F.coalesce(F.get(ts, j + 1), F.size(all_)) - at - 1), lambda r: _plain(r["x"]))
            single = lambda xs: F.filter(xs, lambda x, i: (_bare(x) != "") | (i == 0) | (_bare(F.coalesce(F.get(xs, i - 1), F.lit("x"))) != ""))
            shown = lambda xs: F.when(F.size(xs) == 0, "").otherwise(F.concat(F.array_join(F.transform(xs, lambda x: F.when(_bare(x) == "", "").otherwise(x)), "\n"), F.lit("\n")))
            return bound(bound(own, single), shown)

        return bound(tops, lambda ts: F.transform(ts, lambda at, j: page(ts, at, j)))

    cleaned = lambda p: bound(_in_order(_joined(_without_repeats(_lines(p), least))), texts)
    return bound(pages, lambda p: F.when(F.size(p) > 0, cleaned(p)).when(p.isNotNull(), F.array().cast("array<string>")))
