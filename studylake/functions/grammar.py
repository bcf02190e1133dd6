"""Lines of exam texts, read as tokens.

A line is cut into numbers, runs of answer marks, bracketed headings and single other
characters; what a line is follows from its tokens and their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bound

#: Characters of the grammar (fixed values).
ANSWER_CHARS = "A-Ha-h√×对错"
AFTER_NUMBER = ".．、:：)）"
AFTER_QUESTION = ".．、)）"
COLONS = ":："
DASHES = "-~—～"
BETWEEN_ANSWERS = ",，、;；"
AFTER_HEADING = "·.．、:：-—"
#: Words of the grammar (fixed values).
ANSWER_WORDS = ("参考答案", "正确答案", "答案")
FIELD_WORDS = ("题干", "选项", "答案", "解析", "参考答案")
CHINESE_DIGITS = "一二三四五六七八九十"
#: Words that stand for the options of a judgement (fixed values).
MEANS_A, MEANS_B = ("正确", "对", "√"), ("错误", "错", "×")
#: Where the answer of a question is said inside a text, before or around it (fixed values).
SAID_BEFORE = ("正确答案", "参考答案", "答案", "【答案】", "答")

_TOKEN = rf"【[^】]*】|\d+|[{ANSWER_CHARS}]+|\s+|[\s\S]"
#: The same without white space, which a search passes over.
_SOLID = rf"【[^】]*】|\d+|[{ANSWER_CHARS}]+|\S"
#: How a line begins whose first token is a number, or a number or a heading: others needn't be cut into tokens.
_DIGIT, _DIGIT_OR_HEAD = r"^\s*\d", r"^\s*[\d【]"
#: What a text of compact codes is made of.
_CODES = rf"^\s*\d[\s\d{ANSWER_CHARS}{AFTER_NUMBER}{BETWEEN_ANSWERS}]*$"


def _all_tokens(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(_TOKEN), F.lit(0))


def tokens(line: Column) -> Column:
    """The tokens of a line, white space left out."""
    return F.regexp_extract_all(line, F.lit(_SOLID), F.lit(0))


def _number(t: Column) -> Column:
    return t.rlike(r"^\d{1,3}$")


def _answer(t: Column) -> Column:
    return t.rlike(rf"^[{ANSWER_CHARS}]+$")


def _short_answer(t: Column) -> Column:
    return _answer(t) & (F.length(t) <= 6)


def _among(t: Column, chars: str) -> Column:
    return (F.length(t) == 1) & F.contains(F.lit(chars), t)


def _read(line: Column, use: Callable[[Column, Callable[[int], Column]], Column]) -> Column:
    """``use`` of a line's tokens and of a function that gives the token at a place, empty beyond the end."""
    return bound(tokens(line), lambda all_: use(all_, lambda i: F.coalesce(F.get(all_, F.lit(i)), F.lit(""))))


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def heading_number(token: Column) -> Column:
    """The number of a bracketed heading of a question's answer; null for any other token."""
    inner = squeezed(F.regexp_replace(token, "[【】]", ""))
    n = F.regexp_extract(inner, r"\d+", 0)
    forms = [F.concat(F.lit(before), n, F.lit(f"题{after}答案")) for before in ("", "第") for after in ("", "的")]
    return F.when(token.startswith("【") & (F.length(n) <= 3) & inner.isin(*forms), n.try_cast("int"))


def after_heading(line: Column) -> Column:
    """What follows a bracketed heading and its colon."""
    rest = F.regexp_replace(line, r"^[^】]*】\s*", "")
    return F.trim(F.when(_among(F.substring(rest, 1, 1), COLONS), F.substring(rest, 2, 1_000_000_000)).otherwise(rest))


def single_answer(line: Column) -> Column:
    """(number, answer) of a line of one answer, its number headed or followed by a mark; null for any other line."""

    def of(all_: Column, at: Callable[[int], Column]) -> Column:
        n = F.size(all_)
        headed = heading_number(at(0))
        last = F.coalesce(F.try_element_at(all_, F.lit(-1)), F.lit(""))
        after_head = headed.isNotNull() & ((n == 2) | ((n == 3) & _among(at(1), COLONS))) & _short_answer(last)
        dotted = (n == 3) & _number(at(0)) & _among(at(1), AFTER_NUMBER) & _short_answer(last)
        return F.when(after_head, F.struct(headed.alias("number"), last.alias("answer"))).when(dotted, F.struct(at(0).try_cast("int").alias("number"), last.alias("answer")))

    return F.when(line.rlike(_DIGIT_OR_HEAD), _read(line, of))


def answer_range(line: Column) -> Column:
    """(start, end, answers) of a line of answers for a range of questions; null for any other line."""

    def of(all_: Column, at: Callable[[int], Column]) -> Column:
        begins = _number(at(0)) & _among(at(1), DASHES) & _number(at(2))
        skip = F.when(_among(at(3), COLONS), 5).otherwise(4)
        rest = F.slice(all_, skip, F.size(all_))
        answers = F.filter(rest, _answer)
        fine = begins & _answer(F.coalesce(F.get(rest, F.lit(0)), F.lit(""))) & F.forall(rest, lambda t: _answer(t) | _among(t, BETWEEN_ANSWERS))
        return F.when(fine, F.struct(at(0).try_cast("int").alias("start"), at(2).try_cast("int").alias("end"), answers.alias("answers")))

    return F.when(line.rlike(_DIGIT), _read(line, of))


def is_single(line: Column) -> Column:
    """A line of a number and its answer (the mark between them left out at will), or under a bracketed heading."""

    def of(all_: Column, at: Callable[[int], Column]) -> Column:
        n = F.size(all_)
        code = _number(at(0)) & (((n == 2) & _short_answer(at(1))) | ((n == 3) & _among(at(1), AFTER_NUMBER) & _short_answer(at(2))))
        return code | heading_number(at(0)).isNotNull()

    return F.coalesce(line.rlike(_DIGIT_OR_HEAD) & _read(line, of), F.lit(False))


def is_answer_heading(line: Column) -> Column:
    """A line that only says that answers follow."""
    return squeezed(line).isin(*[w + c for w in ANSWER_WORDS for c in ("", *COLONS)])


def _without_word(text: Column) -> Column:
    """A compact line without the word and colon before its codes."""
    words = [*ANSWER_WORDS, "keys", "key"]
    bare = F.coalesce(*[F.when(F.startswith(text, F.lit(w)), F.ltrim(F.substring(text, len(w) + 1, 1_000_000_000))) for w in words], text)
    return bound(bare, lambda b: F.ltrim(F.when(_among(F.substring(b, 1, 1), COLONS), F.substring(b, 2, 1_000_000_000)).otherwise(b)))


def compact_codes(text: Column) -> Column:
    """(number, answer) of each code of a compact text such as "1.A 2.B 3.CD": three at least, kept apart; null for any other.

    One walk over the tokens: a code is a number, a mark or none, and an answer; white
    space may stand inside, and white space or marks must stand between two codes.
    """
    number, mark, answer, apart, wrong = 0, 1, 2, 3, 4  # what was read last
    codes = "array<struct<number:int,answer:string>>"
    zero = F.struct(F.lit(apart).alias("state"), F.lit(0).alias("n"), F.lit(0).alias("last"))

    def step(t: Column, x: Column) -> Column:
        s, blank = t["state"], x.rlike(r"^\s")
        to = (
            F.when(blank, F.when(s == answer, apart).otherwise(s))
            .when((s == apart) & _number(x), number)
            .when((s == number) & _among(x, AFTER_NUMBER), mark)
            .when(((s == number) | (s == mark)) & _short_answer(x), answer)
            .when(((s == answer) | ((s == apart) & (t["n"] > 0))) & _among(x, BETWEEN_ANSWERS), apart)
            .otherwise(wrong)
        )
        return bound(to, lambda to: F.struct(to.alias("state"), (t["n"] + F.when(to == answer, 1).otherwise(0)).alias("n"), F.when(blank, t["last"]).otherwise(to).alias("last")))

    def of(all_: Column) -> Column:
        return bound(F.aggregate(all_, zero, step), lambda end: F.when((end["state"] != wrong) & (end["last"] == answer) & (end["n"] >= 3), _codes(all_)))

    def _codes(all_: Column) -> Column:
        numbers, answers = F.filter(all_, _number), F.filter(all_, _answer)
        return F.zip_with(numbers, answers, lambda n, a: F.struct(n.try_cast("int").alias("number"), a.alias("answer"))).cast(codes)

    # Codes begin with a number and hold no other character: other texts needn't be walked.
    walked = lambda line: F.when(line.rlike(_CODES), bound(_all_tokens(line), of))
    return bound(F.trim(text), lambda t: bound(_without_word(t), walked))


def start_number(line: Column) -> Column:
    """The number that a line begins with, if a mark of questions follows it."""
    return F.when(line.rlike(_DIGIT), _read(line, lambda _, at: F.when(_number(at(0)) & _among(at(1), AFTER_QUESTION), at(0).try_cast("int"))))


def is_number_alone(line: Column) -> Column:
    return line.rlike(_DIGIT) & _read(line, lambda all_, at: (F.size(all_) == 2) & _number(at(0)) & _among(at(1), AFTER_QUESTION))


def is_decimal(line: Column) -> Column:
    """A line that begins with a decimal number; a question's number before a year, or years, is none."""

    def of(_: Column, at: Callable[[int], Column]) -> Column:
        decimal = _number(at(0)) & (at(1) == ".") & at(2).rlike(r"^\d+$") & F.startswith(F.trim(line), F.concat(at(0), at(1), at(2)))
        year = (F.length(at(2)) == 4) & ((at(3) == "年") | (_among(at(3), DASHES) & (F.length(at(4)) == 4) & at(4).rlike(r"^\d+$") & (at(5) == "年")))
        return decimal & ~year

    return F.coalesce(line.rlike(_DIGIT) & _read(line, of), F.lit(False))


def is_section(line: Column) -> Column:
    """A line that begins a section: Chinese digits and a mark."""
    head = F.regexp_extract(line, "^[^、.．]*", 0)
    return (head != "") & (F.translate(head, CHINESE_DIGITS, "") == "") & (F.length(head) < F.length(line))


def option(line: Column) -> Column:
    """(key, text) of a line that is an option, after a bullet or none; null for any other."""

    def of(_: Column, at: Callable[[int], Column]) -> Column:
        def from_(i: int) -> Column:
            text = F.regexp_replace(F.substring(line, F.position(at(i + 1), line) + 1, F.length(line)), r"^\s+", "")
            return F.when(at(i).rlike("^[A-Ha-h]$") & _among(at(i + 1), AFTER_QUESTION), F.struct(F.upper(at(i)).alias("key"), F.trim(text).alias("text")))

        return F.when(_among(at(0), "-*"), from_(1)).otherwise(from_(0))

    return _read(line, of)


def _after_hashes(line: Column) -> Column:
    """What a Markdown heading says, squeezed; empty for a line that is none."""
    body = F.regexp_replace(line, "^#+", "")
    hashes = F.length(line) - F.length(body)
    return F.when(hashes.between(1, 6), F.trim(body)).otherwise("")


def question_heading(line: Column) -> Column:
    """(number, kind) of a Markdown heading of a question; kind is what follows it, empty if nothing."""

    def of(body: Column) -> Column:
        left = squeezed(F.substring_index(body, "题", 1))
        number = F.when(left.startswith("第"), F.substring(left, 2, 100)).otherwise(left)
        rest = F.ltrim(F.substring(body, F.position(F.lit("题"), body) + 1, 1_000_000))
        marked = F.contains(F.lit(AFTER_HEADING + " "), F.substring(F.substring(body, F.position(F.lit("题"), body) + 1, 1_000_000), 1, 1))
        kind = F.ltrim(F.when(_among(F.substring(rest, 1, 1), AFTER_HEADING), F.substring(rest, 2, 1_000_000)).otherwise(rest))
        fine = F.contains(body, F.lit("题")) & _number(number) & ((rest == "") | (marked & F.length(kind).between(1, 20)))
        return F.when(fine, F.struct(number.try_cast("int").alias("number"), kind.alias("kind")))

    return bound(_after_hashes(line), of)


def is_material_heading(line: Column) -> Column:
    """A Markdown heading of a material: its name is a number, after an m or none, or in Chinese digits."""
    body = squeezed(_after_hashes(line))
    name = F.regexp_replace(F.substring(body, 3, 1_000), f"[{COLONS}]$", "")
    digits = F.when(F.lower(F.substring(name, 1, 1)) == "m", F.substring(name, 2, 1_000)).otherwise(name)
    return body.startswith("材料") & (name != "") & (digits.rlike(r"^\d+$") | (F.translate(name, CHINESE_DIGITS, "") == ""))


def field(line: Column) -> Column:
    """(name, rest) of a line that begins a field, its name in stars or not; null for any other."""
    bare = lambda x: F.regexp_replace(x, r"^\s*\*{0,2}\s*", "")
    start = bare(line)

    def of(word: str) -> Column:
        rest = bare(F.substring(start, len(word) + 1, 1_000_000_000))
        rest = F.when(_among(F.substring(rest, 1, 1), COLONS), F.substring(rest, 2, 1_000_000_000)).otherwise(rest)
        return F.when(F.startswith(start, F.lit(word)), F.struct(F.lit(word).alias("name"), F.regexp_replace(rest, r"^\s+", "").alias("rest")))

    return F.coalesce(*[of(w) for w in FIELD_WORDS])


def said_answers(text: Column) -> Column:
    """Answers that a text says: after a word for it, or alone in brackets."""
    squeezed_ = F.regexp_replace(text, r"[ \t]+", "")
    value = f"([A-Ha-h]{{1,6}}|{'|'.join((*MEANS_A[:1], *MEANS_B[:1]))}|[对错√×])"
    after = [F.regexp_extract_all(squeezed_, F.lit(rf"{w}{'' if w != '答' else '(?=[:：])'}[{COLONS}]?\s*[（(]?{value}"), F.lit(1)) for w in SAID_BEFORE if w not in ("正确答案", "参考答案")]
    return F.flatten(F.array(*after, F.regexp_extract_all(squeezed_, F.lit(rf"[（(]\s*{value}\s*[）)]"), F.lit(1))))


def is_option_line(line: Column) -> Column:
    """A line that begins with an option's letter and a dot."""
    return line.rlike("^[A-Da-d]") & _among(F.substring(line, 2, 1), ".．、")


def is_answer_part(line: Column) -> Column:
    """A line that begins with the name of an answer or of its explanation."""
    return line.startswith("答案") | line.startswith("参考答案") | line.startswith("解析")


def is_said_part(line: Column) -> Column:
    """The same, with a colon."""
    return is_answer_part(line) & F.exists(F.array(*[F.lit(w + c) for w in ("答案", "参考答案", "解析") for c in COLONS]), lambda w: F.startswith(line, w))
