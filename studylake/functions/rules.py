"""The rules of the model as column builders: each stands in one place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def effective_grade(self_grade: Column, is_correct: Column) -> Column:
    """A self grade wins; else the flag decides; null is undecided."""
    return F.coalesce(self_grade, F.when(is_correct, "CORRECT").when(~is_correct, "WRONG"))


def is_wrong(grade: Column) -> Column:
    """Decided and not correct (partial is wrong)."""
    return F.coalesce(grade != "CORRECT", F.lit(False))


def is_right(grade: Column) -> Column:
    """Decided and correct."""
    return F.coalesce(grade == "CORRECT", F.lit(False))


def earned_score(score: Column, grade: Column, self_score: Column) -> Column:
    """A self score within bounds, else full, half or nothing by grade."""
    by_grade = F.when(grade == "CORRECT", score).when(grade == "PARTIAL", score / 2).otherwise(F.lit(0.0))
    return F.when(self_score.isNotNull(), F.greatest(F.lit(0.0), F.least(score, self_score))).otherwise(by_grade)


def self_grade_of(earned: Column, most: Column) -> Column:
    """CORRECT, PARTIAL or WRONG by points; null outside 0..most."""
    ok = (earned >= -1e-9) & (earned <= most + 1e-9)
    return F.when(ok, F.when(earned >= most - 1e-9, "CORRECT").when(earned <= 1e-9, "WRONG").otherwise("PARTIAL"))


def key_set(keys: Column) -> Column:
    """Sorted distinct keys of a comma-joined text."""
    parts = F.transform(F.split(F.coalesce(keys, F.lit("")), ","), lambda k: F.upper(F.trim(k)))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda k: k != "")))


def answer_matches(answer_keys: Column, selected: Column) -> Column:
    """Same set of keys; an empty selection never matches."""
    mine = key_set(selected)
    return (F.size(mine) > 0) & (mine == key_set(answer_keys))


def next_level(level: Column, right: Column) -> Column:
    """One step of the ladder: up to 5, or back to 0."""
    return F.when(right, F.least(level + 1, F.lit(5))).otherwise(F.lit(0))


def interval_days(level: Column) -> Column:
    """Days until the next review at a level just reached (0: one day)."""
    return F.when(level == 0, F.lit(1)).otherwise(F.least(F.pow(F.lit(2), level).cast("int"), F.lit(30)))


def ability(mastery: Column) -> Column:
    """Mastery 0..1 as ability -400..400."""
    return F.greatest(F.lit(-400.0), F.least(F.lit(400.0), F.lit(400.0) * (F.lit(2.0) * mastery - F.lit(1.0))))


def success(difficulty: Column, ability_: Column) -> Column:
    """Predicted share of right answers."""
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (difficulty - ability_) / F.lit(400.0)))


def initial_difficulty(question_type: Column, score: Column) -> Column:
    """Before any answer: 400 for a single choice (fixed values)."""
    base = F.when(question_type == "SUBJECTIVE", 520.0).when(question_type == "MULTIPLE", 460.0).when(question_type == "JUDGE", 320.0).otherwise(400.0)
    return base + F.when((score > 2) & (question_type != "SUBJECTIVE"), 40.0).otherwise(0.0)


def elo(difficulty: Column, right: Column, ability_: Column) -> Column:
    """One rating step, K 16, within -400..1200."""
    moved = difficulty + F.lit(16.0) * (success(difficulty, ability_) - F.when(right, 1.0).otherwise(0.0))
    return F.greatest(F.lit(-400.0), F.least(F.lit(1200.0), moved))


def target_rank(p: Column) -> Column:
    """Order by distance from 85 %, those within 80..90 % first."""
    return F.when(p.between(0.80, 0.90), 0.0).otherwise(1.0) * 100 + F.abs(p - 0.85)


def round_half_up(x: Column, digits: int = 0) -> Column:
    """floor(x + 0.5) at some digits."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def interleave(mastery: Column) -> Column:
    """Share of neighbouring topics to mix in: none below a mastery of 0.6 (fixed values)."""
    return F.when(mastery >= 0.85, 0.35).when(mastery >= 0.6, 0.15).otherwise(0.0)


def phrase(n: Column, right: Column) -> Column:
    """The words for a performance, of at least three answers (fixed values)."""
    rate = right / n
    return F.when(n < 3, "数据还太少").when(rate >= 0.8, "较好").when(rate >= 0.5, "一般").otherwise("较弱")


def answered_right(question_type: Column, answer_keys: Column, selected: Column) -> Column:
    """Whether a submission is right; null (undecided) for subjective questions and those without an answer."""
    open_ = (question_type == "SUBJECTIVE") | (F.size(key_set(answer_keys)) == 0)
    return F.when(~F.coalesce(open_, F.lit(False)), answer_matches(answer_keys, selected))


def page_count(total: Column, size: int) -> Column:
    """Pages of ``size`` rows."""
    return F.ceil(total / size).cast("long")


def same_kind_number(value: Column) -> Column:
    """The integer of a JSON scalar: 1 and 1.0 count, "1", 1.5 and true don't."""
    kind = F.schema_of_variant(value)
    whole = F.try_variant_get(value, "$", "double")
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL.*)$") & (whole == F.floor(whole)), whole.cast("long"))
