"""Builders over whole exam texts: answers, boundaries, chunks, checks of parsed questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import grammar as G
from . import text as X
from .arrays import bound, starts

#: Words by which a subjective question with options is a choice after all (fixed values).
ASKS_TEXT = "请简述|请论述|请说明|谈谈|说明理由|简述|论述|撰写|作答|请分析|填正确答案标号|（填|求|计算"
ASKS_CHOICE = "哪个|哪项|以下|下列|多少|正确|错误|属于|能够|不能|选择|填入"
MOST_CHUNKS, MOST_ANSWER_LIST, MOST_IMAGES = 6, 5000, 10
OPTIONS = "array<struct<key:string,text:string>>"


def _lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\n|\r", -1)


def bracket_answer(text: Column, number: Column) -> Column:
    """The words after a bracketed answer heading of a question; bare numbers and marks don't count."""
    headed = lambda x: G.heading_number(F.coalesce(F.get(G.tokens(x), F.lit(0)), F.lit("")))
    hits = F.filter(_lines(text), lambda x: headed(x) == number)
    tails = F.transform(hits, lambda x: X.fold_space(G.after_heading(x)))

    def fine(t: Column) -> Column:
        probe = F.regexp_replace(F.regexp_replace(t, X.IMAGE, ""), r"[\d\s.．、,，;；:：()（）\-_=+*/<>×÷~～^]+", "")
        return (t != "") & ((probe != "") | t.contains("[图片"))

    return F.try_element_at(F.filter(tails, fine), F.lit(1))


def is_answer_list(text: Column) -> Column:
    """Whether a text is a list of answers: one compact line, or two matching lines and at least half."""

    def listed(some: Column) -> Column:
        hits = F.size(F.filter(some, lambda x: X.is_answer_line(x) | G.is_answer_heading(x)))
        return bound(hits, lambda n: (n >= 2) & (n * 2 >= F.size(some)))

    def of(t: Column) -> Column:
        some = F.filter(F.transform(_lines(t), lambda x: F.trim(x)), lambda x: x != "")
        return G.compact_codes(t).isNotNull() | bound(some, listed)

    return F.coalesce((F.length(text) <= MOST_ANSWER_LIST) & bound(F.regexp_replace(text, r"^\s+|\s+$", ""), of), F.lit(False))


def compact_answers(line: Column) -> Column:
    """Question number -> answer of a compact line such as "1.A 2.B 3.CD"; the last of a number counts."""
    # Of codes sorted by number and place the last of each number stays.
    ordered = lambda codes: F.array_sort(F.transform(codes, lambda c, i: F.struct(c["number"].alias("k"), i.alias("i"), c["answer"].alias("v"))))
    last = lambda all_: F.filter(F.zip_with(all_, F.slice(all_, F.lit(2), F.size(all_)), lambda a, b: F.when(b.isNull() | (a["k"] != b["k"]), F.struct(a["k"].alias("k"), a["v"].alias("v")))), lambda x: x.isNotNull())
    found = bound(G.compact_codes(line), lambda codes: bound(ordered(codes), last))
    return F.coalesce(F.map_from_entries(found), F.create_map().cast("map<int,string>"))


def loose_count(text: Column) -> Column:
    """Lines that begin or end with a question number, from the first section heading on."""
    rows = F.transform(_lines(F.coalesce(text, F.lit(""))), lambda x: F.trim(x))
    first = F.greatest(F.array_position(F.transform(rows, lambda x: G.is_section(x)), F.lit(True)), F.lit(1))
    ends = lambda x: x.rlike(r"\d{1,2}\s*[.．、)]\s*$") & ~G.is_number_alone(x) & ~G.is_single(x)
    return F.size(F.filter(F.slice(rows, first.cast("int"), F.size(rows)), lambda x: X.question_number(x).isNotNull() | ends(x)))


def boundaries(text: Column) -> Column:
    """Offsets of the questions: of numbered lines, the longest run whose numbers rise (three at least).

    A run takes the next number that is larger than its last; of equally long
    ones the first counts.  The run from a line goes on as that from the next
    line with a larger number, so the lengths come in one walk from the end, which
    remembers only lines that no later, larger number hides (as many as there are
    numbers of three digits, at most).
    """
    lines_ = _lines(text)

    def number(x: Column) -> Column:
        return F.when(~G.is_single(F.trim(x)), G.start_number(x))

    def numbered(all_: Column) -> Column:
        at = starts(F.transform(all_, lambda x: F.length(x) + 1))
        return F.filter(F.zip_with(all_, at, lambda x, o: F.struct(number(x).alias("n"), o.alias("at"))), lambda r: r["n"].isNotNull())

    def first_of_longest(found: Column) -> Column:
        step = "array<struct<n:int,size:int>>"
        zero = F.struct(F.array().cast(step).alias("open"), F.lit(0).alias("best"), F.lit(0).alias("at"))

        def back(t: Column, r: Column) -> Column:
            larger = F.filter(t["open"], lambda o: o["n"] > r["n"])
            size = F.coalesce(F.get(larger, F.lit(0))["size"], F.lit(0)) + 1
            longer = size >= t["best"]
            here = F.array(F.struct(r["n"].alias("n"), size.alias("size"))).cast(step)
            return F.struct(F.concat(here, larger).alias("open"), F.when(longer, size).otherwise(t["best"]).alias("best"), F.when(longer, r["at"]).otherwise(t["at"]).alias("at"))

        return F.aggregate(F.reverse(found), zero, back)

    def run(found: Column, top: Column) -> Column:
        empty = F.struct(F.lit(-1).alias("n"), F.array().cast("array<int>").alias("run"))
        take = lambda t, r: F.when((r["at"] >= top["at"]) & (r["n"] > t["n"]), F.struct(r["n"].alias("n"), F.concat(t["run"], F.array(r["at"])).alias("run"))).otherwise(t)
        return F.when(top["best"] >= 3, F.aggregate(found, empty, take, lambda t: t["run"])).otherwise(F.array().cast("array<int>"))

    return bound(lines_, lambda all_: bound(numbered(all_), lambda found: bound(first_of_longest(found), lambda top: run(found, top))))


def chunks(bounds: Column, length: Column, target: int = 15) -> Column:
    """Ranges (start, end) of a text: at most six, each about ``target`` questions, the one before a chunk repeated at its head."""
    n = F.size(bounds)
    count = F.least(F.lit(MOST_CHUNKS), F.greatest(F.lit(1), F.ceil(n / target).cast("int")))
    per = F.ceil(n / count).cast("int")

    def one(i: Column) -> Column:
        first, last = i * per, F.least(n, (i + 1) * per)
        start = F.when(first == 0, F.lit(0)).otherwise(F.try_element_at(bounds, F.least(first, n)))
        end = F.when(last >= n, length).otherwise(F.try_element_at(bounds, last + 1))
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))

    return F.when(n < 3, F.array(F.struct(F.lit(0).alias("start"), length.cast("int").alias("end")))).otherwise(F.transform(F.sequence(F.lit(0), count - 1), one))


def answer_section(text: Column) -> Column:
    """Offset of the first answer line or heading, -1 without one."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("found"))

    def look(acc: Column, x: Column) -> Column:
        hit = (acc["found"] < 0) & (X.is_answer_line(F.trim(x)) | G.is_answer_heading(x))
        return F.struct((acc["at"] + F.length(x) + 1).alias("at"), F.when(hit, acc["at"]).otherwise(acc["found"]).alias("found"))

    return F.coalesce(F.aggregate(_lines(text), zero, look, lambda a: a["found"]), F.lit(-1))


def answer_letters(text: Column) -> Column:
    """Answer letters in order, in capitals."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Ha-h])"), F.lit(1)), lambda k: F.upper(k))


def options_of(line: Column) -> Column:
    """The options that a line holds, one or several: array of (key, text)."""
    apart = F.split(F.regexp_replace(line, rf"\s([A-Da-d]\s*[{G.AFTER_QUESTION}])", "\n$1"), "\n")
    return F.filter(F.transform(apart, lambda p: G.option(p)), lambda o: o.isNotNull())


def checked_question(kind: Column, options: Column, score: Column) -> Column:
    """Type, options and score after the defaults: a judgement gets its two options, a choice without any is subjective."""
    two = F.array(F.struct(F.lit("A").alias("key"), F.lit("正确").alias("text")), F.struct(F.lit("B").alias("key"), F.lit("错误").alias("text"))).cast(OPTIONS)
    k, none = F.upper(kind), F.array().cast(OPTIONS)
    n = F.coalesce(F.size(options), F.lit(0))
    new = F.when((n == 0) & k.isin("SINGLE", "MULTIPLE"), "SUBJECTIVE").otherwise(k)
    opts = F.when((k == "JUDGE") & (n < 2), two).when(n == 0, none).otherwise(options)
    return F.struct(new.alias("type"), opts.alias("options"), F.coalesce(score, F.when(new == "SUBJECTIVE", 5.0).otherwise(1.0)).alias("score"))


def mislabelled_choice(kind: Column, content: Column, options: Column) -> Column:
    """SINGLE for a subjective question that asks for a choice among filled options, else its type."""
    filled = (F.size(options) >= 2) & F.forall(options, lambda o: F.coalesce(F.trim(o["text"]) != "", F.lit(False)))
    asks = content.rlike(ASKS_CHOICE) & ~content.rlike(ASKS_TEXT)
    return F.when((kind == "SUBJECTIVE") & F.coalesce(asks & filled, F.lit(False)), "SINGLE").otherwise(kind)


def is_junk(kind: Column, content: Column, options: Column) -> Column:
    """Equal options, a choice of fewer than three, or a stem with the next question glued to it."""
    n = F.coalesce(F.size(options), F.lit(0))
    texts = F.array_distinct(F.transform(options, lambda o: F.trim(F.coalesce(o["text"], F.lit("")))))
    equal = (n >= 2) & (F.size(texts) == 1) & (F.element_at(texts, 1) != "")
    few = ~kind.isin("JUDGE", "SUBJECTIVE") & (n < 3)
    return F.coalesce(equal, F.lit(False)) | few | F.coalesce(content.rlike(r"\d{1,2}\s*[.．、]\s*\n\s*\S"), F.lit(False))


def answer_source(keys: Column, in_source: Column, supplement: Column) -> Column:
    """ORIGINAL if the source has the answer, AI_SUPPLEMENT if a model may add one, else null."""
    return F.when(F.size(keys) > 0, F.when(in_source, "ORIGINAL").when(supplement, "AI_SUPPLEMENT"))


def images_within(content: Column, low: Column, high: Column) -> Column:
    """The text without image marks whose number lies outside a range."""
    outside = F.filter(X.images(content), lambda n: (n < low) | (n > high))
    return F.aggregate(outside, content, lambda t, n: F.replace(t, F.concat(F.lit("[图片"), n.cast("string"), F.lit("]")), F.lit("")))


def image_names(content: Column, names: Column) -> Column:
    """Image marks with stored names put in (map number -> name); marks without a name stay."""
    known = F.filter(X.images(content), lambda n: F.map_contains_key(names, n))
    return F.aggregate(known, content, lambda t, n: F.replace(t, F.concat(F.lit("[图片"), n.cast("string"), F.lit("]")), F.concat(F.lit("[图片:"), F.try_element_at(names, n), F.lit("]"))))


def layout_noise(line: Column) -> Column:
    """Option letters alone and short code lines."""
    return line.rlike(r"^\s*[A-Ha-h]\s*[.．、]?\s*$") | line.rlike(r"^[A-Za-z0-9_/.\-]{1,32}$")


# --- the source text of parsed questions -----------------------------------------------------------------


def line_at(lines_: Column, offset: Column) -> Column:
    """The number of the line (white space left out of all lines) that an offset lies in."""
    begins = starts(F.transform(lines_, lambda x: F.length(X.squeezed(x))))
    return F.size(F.filter(begins, lambda s: s <= offset)) - 1


def content_line(lines_: Column, content: Column) -> Column:
    """The line that a question's content begins in, -1 if none: that of its first line, else of its first thirty
    characters without white space."""
    head = F.trim(F.element_at(_lines(content), 1))
    direct = F.array_position(F.transform(lines_, lambda x: F.contains(x, head)), F.lit(True)) - 1
    probe = F.substring(X.squeezed(content), 1, 30)
    at = F.position(probe, F.array_join(F.transform(lines_, lambda x: X.squeezed(x)), "")) - 1
    squeezed = F.when((probe != "") & (at >= 0), line_at(lines_, at)).otherwise(F.lit(-1))
    return F.when((head != "") & (direct >= 0), direct).otherwise(squeezed).cast("int")


def number_near(lines_: Column, line: Column, forward: bool) -> Column:
    """The question number of the first numbered line from a line on, or of the last up to it; null if none."""
    numbers = F.transform(lines_, lambda x: X.question_number(x))
    part = F.slice(numbers, line + 1, F.size(numbers)) if forward else F.reverse(F.slice(numbers, F.lit(1), line + 1))
    return F.when(line >= 0, F.get(F.filter(part, lambda n: n.isNotNull()), F.lit(0)))


def answer_keys_of(said: Column) -> Column:
    """The option keys that a said answer means, A and B for the words of a judgement."""
    keys = F.array_distinct(F.filter(F.split(F.upper(said), ""), lambda c: c.rlike("^[A-H]$")))
    return F.when(said.isin(*G.MEANS_A), F.array(F.lit("A"))).when(said.isin(*G.MEANS_B), F.array(F.lit("B"))).otherwise(keys)


def answer_evidence(text: Column, content: Column, number: Column) -> Column:
    """The option keys that a source gives as the answer of a question, sorted.

    From the ten lines at the question's number after its content, up to the next
    number, and from every answer line that holds the number.
    """
    none = F.array().cast("array<string>")

    def of(lines_: Column) -> Column:
        begin = content_line(lines_, content)

        def with_number(at: Column) -> Column:
            # at: the line of the question's number, null without one
            rest = F.slice(lines_, at + 2, F.lit(9))
            stop = F.array_position(F.transform(rest, lambda x: X.question_number(x).isNotNull()), F.lit(True))
            window = F.array_join(F.concat(F.slice(lines_, at + 1, F.lit(1)), F.when(stop > 0, F.slice(rest, F.lit(1), (stop - 1).cast("int"))).otherwise(rest)), "\n")
            said = G.said_answers(window)
            near = F.when(at.isNotNull(), F.flatten(F.transform(said, lambda v: answer_keys_of(v)))).otherwise(none)
            own = F.coalesce(F.when(number > 0, number), F.when(at.isNotNull(), F.regexp_extract(F.get(lines_, at), r"^\s*(\d{1,3})", 1).try_cast("int")))

            def listed(n: Column) -> Column:
                by_line = F.transform(lines_, lambda x: F.concat(F.coalesce(answer_keys_of(X.answer_of(x, n)), none), F.coalesce(answer_keys_of(F.try_element_at(compact_answers(x), n)), none)))
                return F.when(n.isNotNull(), F.flatten(by_line)).otherwise(none)

            return F.array_sort(F.array_distinct(F.concat(F.coalesce(near, none), F.coalesce(bound(own, listed), none))))

        from_ = F.transform(F.slice(lines_, begin + 1, F.size(lines_)), lambda x: G.is_number_alone(x) | X.question_number(x).isNotNull())
        found = F.array_position(from_, F.lit(True))
        return bound(F.when((begin >= 0) & (found > 0), (begin + found - 1).cast("int")), with_number)

    return F.when(F.trim(text) != "", bound(_lines(text), of)).otherwise(none)


def agrees(keys: Column, evidence: Column) -> Column:
    """Whether a source bears out all answer keys; without keys nothing is to be borne out."""
    return F.coalesce(F.size(keys) == 0, F.lit(True)) | (F.size(F.array_except(F.transform(keys, lambda k: F.upper(k)), evidence)) == 0)


def options_at_question(lines_: Column, options: Column, number: Column) -> Column:
    """Whether the first six characters of every filled option stand in the five lines at the question's number."""
    texts = F.filter(F.transform(options, lambda o: F.trim(X.without_images(F.coalesce(o["text"], F.lit(""))))), lambda t: t != "")
    at = F.array_position(F.transform(lines_, lambda x: F.coalesce(X.question_number(x) == number, F.lit(False))), F.lit(True))
    area = F.array_join(F.slice(lines_, F.greatest(at, F.lit(1)).cast("int"), F.lit(5)), "\n")
    return F.coalesce((F.size(texts) == 0) | bound(area, lambda a: F.forall(texts, lambda t: F.contains(a, F.substring(t, 1, 6)))), F.lit(True))


def options_of_one_question(lines_: Column, options: Column) -> Column:
    """Whether every filled option stands in the source as one, and all of them below the same number."""
    probes = F.transform(F.filter(F.transform(options, lambda o: F.coalesce(o["text"], F.lit(""))), lambda t: F.trim(X.without_images(t)) != ""), lambda t: F.substring(t, 1, 6))
    spot = lambda q: F.array_position(F.transform(lines_, lambda x: F.regexp_like(x, F.concat(F.lit(r"[A-Da-d][.．、]\s*\Q"), q, F.lit(r"\E")))), F.lit(True)) - 1

    def one(spots: Column) -> Column:
        numbers = F.array_distinct(F.filter(F.transform(spots, lambda at: number_near(lines_, at.cast("int"), False)), lambda n: n.isNotNull()))
        return F.forall(spots, lambda at: at >= 0) & (F.size(numbers) <= 1)

    return F.coalesce(bound(F.transform(probes, spot), one), F.lit(True))


def from_source(lines_: Column, content: Column, options: Column, kind: Column) -> Column:
    """(content, kept) of a question after a look at its source.

    A stem that stands above its number is put together from the lines there
    (fifteen characters at least).  Not kept: an answer or heading taken for a
    stem, a short stem that the source lacks, options of another question.
    """
    plain = F.trim(X.without_images(content))
    own = G.start_number(plain)
    numbered = lambda x: G.is_number_alone(x) | X.question_number(F.trim(x)).isNotNull()
    stops = lambda x: G.start_number(x).isNotNull() | G.is_option_line(x) | G.is_said_part(x)

    def of(all_: Column) -> Column:
        found = F.struct(
            content_line(all_, plain).alias("line"),
            (F.array_position(F.transform(all_, numbered), F.lit(True)) - 1).cast("int").alias("first"),
            F.when(own.isNotNull(), F.array_position(F.transform(all_, lambda x: F.regexp_like(x, F.concat(F.lit(r"^\s*"), own.cast("string"), F.lit(r"\s*[.．、)）](?:\s*[A-Da-d].*|\s*)$")))), F.lit(True)) - 1).otherwise(F.lit(-1)).cast("int").alias("own"),
        )

        def anchored(f: Column) -> Column:
            probe = F.substring(X.without_images(F.coalesce(F.get(options, F.lit(0))["text"], F.lit(""))), 1, 8)
            near = F.contains(F.array_join(F.slice(all_, f["line"] + 1, F.lit(8)), ""), probe)
            heading = (f["line"] >= 0) & ((f["first"] < 0) | (f["first"] > f["line"])) & (F.length(plain) <= 60)
            anchor = F.when((f["line"] >= 0) & ((F.trim(probe) == "") | near), f["line"]).when(f["own"] >= 0, f["own"]).otherwise(F.lit(-1))

            def collected(at: Column) -> Column:
                alone = F.transform(all_, lambda x: G.is_number_alone(x))
                later = F.array_position(F.slice(alone, at + 2, F.size(all_)), F.lit(True))
                number = F.when(F.get(alone, at) | (later == 0), at).otherwise((at + later).cast("int"))
                first = F.greatest(f["first"], F.lit(0))
                above = F.transform(F.reverse(F.slice(all_, first + 1, F.greatest(number - first, F.lit(0)))), lambda x: F.trim(x))
                stop = F.array_position(F.transform(above, lambda x: (x != "") & stops(x)), F.lit(True))
                kept = F.filter(F.reverse(F.when(stop > 0, F.slice(above, F.lit(1), (stop - 1).cast("int"))).otherwise(above)), lambda x: x != "")
                text = F.array_join(kept, "\n")
                wanted = own.isNotNull() | ((f["line"] >= 0) & (f["line"] < number))
                near_number = F.when(f["line"] >= 0, number_near(all_, f["line"], True))
                same = F.when(near_number.isNotNull(), options_at_question(all_, options, near_number)).otherwise(options_of_one_question(all_, options))
                fits = (kind == "JUDGE") | (F.coalesce(F.size(options), F.lit(0)) == 0) | same
                lost = at < 0
                return F.struct(
                    F.when(~lost & wanted & (F.length(text) >= 15), text).otherwise(content).alias("content"),
                    F.when(heading, False).when(lost, (F.length(plain) > 30) | (kind == "JUDGE")).otherwise(fits).alias("kept"),
                )

            return bound(anchor, collected)

        return bound(found, anchored)

    refused = (plain == "") | G.is_said_part(plain)
    result = bound(lines_, of)
    return F.when(refused, F.struct(content.alias("content"), F.lit(False).alias("kept"))).otherwise(result)


def trimmed(chunk: Column, head: bool = True, tail: bool = True) -> Column:
    """A chunk without what was cut off from other questions at its edges.

    head: blank lines, the first numbered line and the options and answers after
    it; tail: lines after the last one that is an option, a number, an answer or an image.
    """

    def of(all_: Column) -> Column:
        rows = F.transform(all_, lambda x: F.trim(x))
        first = F.lit(1)
        if head:
            # 0 before the number, 1 after it, 2 at the first line that stays.
            def walk(t: Column, x: Column) -> Column:
                numbered = G.is_number_alone(x) | X.question_number(x).isNotNull()
                belongs = G.is_option_line(x) | G.is_answer_part(x)
                goes = (x == "") | (numbered & (t["seen"] == 0)) | (belongs & (t["seen"] == 1))
                seen = F.when((t["seen"] == 2) | ~goes, 2).when((x != "") & numbered & (t["seen"] == 0), 1).otherwise(t["seen"])
                return F.struct(seen.alias("seen"), (t["n"] + F.when(seen < 2, 1).otherwise(0)).alias("n"))

            first = F.aggregate(rows, F.struct(F.lit(0).alias("seen"), F.lit(0).alias("n")), walk, lambda t: t["n"]) + 1
        last = F.size(rows)
        if tail:
            ends = lambda x: G.is_option_line(x) | G.start_number(x).isNotNull() | G.is_answer_part(x) | (F.contains(x, F.lit("[图片")) & x.endswith("]"))
            back = F.array_position(F.transform(F.reverse(rows), ends), F.lit(True))
            last = F.when(back > 0, F.size(rows) - back + 1).otherwise(F.lit(0))
        return bound(F.struct(first.cast("int").alias("a"), last.cast("int").alias("b")), lambda r: F.array_join(F.slice(all_, r["a"], F.greatest(r["b"] - r["a"] + 1, F.lit(0))), "\n"))

    return bound(_lines(chunk), of)


def split_by_images(text: Column, ranges: Column, most: int = MOST_IMAGES) -> Column:
    """Ranges (start, end) of a text, those of more than ``most`` images cut at questions, six ranges in all at most."""
    kind = "array<struct<start:int,end:int>>"

    def cuts(segment: Column) -> Column:
        def add(t: Column, b: Column) -> Column:
            many = F.size(X.images(F.substr(segment, t["last"] + 1, b - t["last"]))) > most
            return F.when(many, F.struct(F.concat(t["cuts"], F.array(b)).alias("cuts"), b.alias("last"))).otherwise(t)

        inner = F.filter(boundaries(segment), lambda b: b > 0)
        return F.aggregate(inner, F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("last")), add, lambda t: t["cuts"])

    def one(t: Column, r: Column) -> Column:
        segment = F.substr(text, r["start"] + 1, r["end"] - r["start"])
        found = F.when((t["budget"] > 0) & (F.size(X.images(segment)) > most), bound(segment, cuts)).otherwise(F.array().cast("array<int>"))

        def cut(all_: Column) -> Column:
            used = F.slice(all_, F.lit(1), F.greatest(t["budget"], F.lit(0)))
            edges = F.concat(F.array(r["start"]), F.transform(used, lambda c: r["start"] + c), F.array(r["end"]))
            pieces = F.zip_with(F.slice(edges, F.lit(1), F.size(edges) - 1), F.slice(edges, F.lit(2), F.size(edges) - 1), lambda a, b: F.struct(a.alias("start"), b.alias("end"))).cast(kind)
            return F.struct(F.concat(t["out"], pieces).alias("out"), (t["budget"] - F.size(used)).alias("budget"))

        return bound(found, cut)

    zero = F.struct(F.array().cast(kind).alias("out"), (F.lit(MOST_CHUNKS) - F.size(ranges)).alias("budget"))
    return F.aggregate(ranges, zero, one, lambda t: t["out"])


def listed_numbers(text: Column) -> Column:
    """Question numbers of a text in order, distinct: at a line's start, else at its end; answer lines left out."""
    start, end = r"^\s*(\d{1,3})\s*[.．、)）](?!\d)", r"(?<![\d.．])(\d{1,3})\s*[.．、]\s*$"

    def number(x: Column) -> Column:
        return F.coalesce(F.regexp_extract(x, start, 1).try_cast("int"), F.regexp_extract(x, end, 1).try_cast("int"))

    rows = F.filter(F.transform(_lines(text), lambda x: F.trim(x)), lambda x: x.rlike(r"\d") & ~G.is_single(x))
    return F.array_distinct(F.filter(F.transform(rows, number), lambda n: n.between(1, 999)))


def lost_numbers(source: Column, parsed: Column) -> Column:
    """Numbers of the text layer that the parsed text lacks; none unless both are long enough to tell."""
    def lost(both: Column) -> Column:
        told = (F.size(both["a"]) >= 5) & (F.size(both["b"]) >= 5)
        return F.when(told, F.array_except(both["a"], both["b"]))

    both = F.struct(listed_numbers(source).alias("a"), listed_numbers(parsed).alias("b"))
    return F.coalesce(F.when(F.length(source) >= 200, bound(both, lost)), F.array().cast("array<int>"))


def with_image_marks(page: Column, images_: Column, first: Column) -> Column:
    """A page's text with the marks of its images (array of y and page height, from the foot) put after the lines they stand at.

    ``first`` is the number of the page's first image; an image's centre is taken 30 points above its foot.
    """

    def of(all_: Column) -> Column:
        n = F.size(all_)
        height = lambda e: F.when(e["height"] > 0, e["height"]).otherwise(F.lit(842.0))
        # An image goes after the first line that isn't above its own, and never before the image ahead of it.
        want = F.transform(images_, lambda e: F.greatest(((F.lit(1.0) - (e["y"] + 30) / height(e)) * n).cast("int"), F.lit(0)))
        lines_ = F.transform(all_, lambda x, i: F.struct(i.alias("at"), F.lit(-1).alias("k"), x.alias("x")))

        def placed(want_: Column) -> Column:
            marks = F.transform(want_, lambda w, k: F.struct(F.least(F.array_max(F.slice(want_, F.lit(1), k + 1)), n - 1).alias("at"), k.alias("k"), F.concat(F.lit("[图片"), (first + k).cast("string"), F.lit("]")).alias("x")))
            return F.array_join(F.transform(F.array_sort(F.concat(lines_, marks)), lambda r: r["x"]), "\n")

        return F.when(F.size(images_) > 0, bound(want, placed)).otherwise(page)

    return F.when(F.trim(page) == "", page).otherwise(bound(F.split(page, "\n"), of))
