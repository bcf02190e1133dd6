"""Filters that fall away when not asked for, scopes, notes, banks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of the conditions that are given."""
    given = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, given) if given else F.lit(True)


def equals(column: str, value) -> Column | None:
    """Equality, or nothing where the value is null or blank."""
    return None if value is None or value == "" else F.col(column) == value


def same(column: str, value) -> Column:
    """Equality in which null equals null."""
    return F.col(column).eqNullSafe(F.lit(value))


def contains(keyword: str | None, *columns: str) -> Column | None:
    """A literal, case-sensitive substring of any column."""
    if not keyword:
        return None
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.col(c), F.lit(keyword)), F.lit(False)) for c in columns])


def among(column: str, values: list | None) -> Column | None:
    """Membership, or nothing for an empty list."""
    return F.col(column).isin(*values) if values else None


def known(value: str | None, allowed: tuple[str, ...]) -> str | None:
    """A value of a fixed set in its canonical form; others mean no filter."""
    upper = (value or "").strip().upper()
    return upper if upper in allowed else None


def scope(questions: DataFrame, which: str, wrong: DataFrame | None = None, answered: DataFrame | None = None) -> DataFrame:
    """all, favorite, wrong or undone questions."""
    if which == "favorite":
        return questions.filter("favorite")
    if which == "wrong":
        return questions.join(wrong.select(F.col("question_id").alias("id")), "id", "left_semi")
    if which == "undone":
        return questions.join(answered.select(F.col("question_id").alias("id")), "id", "left_anti")
    return questions


def same_second(column: str, at) -> Column:
    """Within the second of a moment."""
    return F.date_trunc("second", F.col(column)) == F.date_trunc("second", F.lit(at))


def preview(text: Column, most: int = 60) -> Column:
    """One line: white space folded, cut with an ellipsis."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def notes_with_titles(notes: DataFrame, links: DataFrame, questions: DataFrame, banks: DataFrame) -> DataFrame:
    """note_id, target_type, target_id, title: each link with its question's or bank's title."""
    q = questions.select(F.col("id").alias("target_id"), F.lit("QUESTION").alias("target_type"), F.col("content").alias("q"))
    b = banks.select(F.col("bank_id").alias("target_id"), F.lit("BANK").alias("target_type"), F.col("name").alias("b"))
    rows = notes.select("note_id").join(links, "note_id").join(q, ["target_type", "target_id"], "left").join(b, ["target_type", "target_id"], "left")
    return rows.select("note_id", "target_type", "target_id", F.coalesce("q", "b", F.lit("(deleted)")).alias("title"))


def unlinked(notes: DataFrame, links: DataFrame) -> DataFrame:
    """Notes without a link."""
    return notes.join(links.select("note_id"), "note_id", "left_anti")


def add_links(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """Links after adding some again or anew: each once."""
    keys = ["note_id", "target_type", "target_id"]
    return links.unionByName(wanted.select(*keys).distinct().join(links, keys, "left_anti"))


def time_group(at: Column, as_of) -> Column:
    """today, yesterday, week, month or older."""
    days = F.datediff(F.lit(as_of), at)
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(days < 7, "week").when(days < 30, "month").otherwise("older")


def ago(at: Column, as_of) -> Column:
    """How long ago, in words."""
    minutes = F.timestamp_diff("MINUTE", at, F.lit(as_of))
    return F.when(minutes < 1, "just now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h"))).otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit(" d")))


#: Colours of notes, and how long one may be (fixed values).
COLOURS, MOST_NOTE = ("y", "g", "b", "p"), 2000


def note_list(notes: DataFrame, links: DataFrame, questions: DataFrame, keyword: str | None = None, bank_id: int | None = None, target: tuple[str, int] | None = None, colour: str | None = None, loose: bool = False) -> DataFrame:
    """Notes by keyword, bank (linked to it or to one of its questions), target (type, id), colour, or without any link."""
    rows = notes.filter(all_of(contains(keyword, "content"), equals("color", colour)))
    if loose:
        return unlinked(rows, links)
    if bank_id is not None:
        rows = rows.join(note_banks(links, questions).filter(F.col("bank_id") == bank_id).select("note_id"), "note_id", "left_semi")
    if target is not None:
        kind, number = target
        rows = rows.join(links.filter((F.col("target_type") == kind) & (F.col("target_id") == number)).select("note_id"), "note_id", "left_semi")
    return rows


def note_banks(links: DataFrame, questions: DataFrame) -> DataFrame:
    """note_id, bank_id, once each: the banks that a note is linked to, by themselves or by a question."""
    direct = links.filter("target_type = 'BANK'").select("note_id", F.col("target_id").alias("bank_id"))
    own = questions.select(F.col("id").alias("target_id"), "bank_id")
    return direct.unionByName(links.filter("target_type = 'QUESTION'").join(own, "target_id").select("note_id", "bank_id")).distinct()


def notes_per_bank(links: DataFrame, questions: DataFrame) -> DataFrame:
    """bank_id, notes."""
    return note_banks(links, questions).groupBy("bank_id").agg(F.count("*").alias("notes"))


def changed_notes(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """Notes with changes (note_id, content, color) laid over: null keeps, a long text is cut, an unknown colour keeps the old."""
    new = changes.select("note_id", F.substring("content", 1, MOST_NOTE).alias("_content"), F.when(F.col("color").isin(*COLOURS), F.col("color")).alias("_color"))
    out = notes.join(new, "note_id", "left")
    return out.withColumn("content", F.coalesce("_content", "content")).withColumn("color", F.coalesce("_color", "color")).drop("_content", "_color")
