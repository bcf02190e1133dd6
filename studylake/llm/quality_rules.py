"""Quality by weak supervision: rules vote or abstain, their accuracies are estimated.

Each rule looks at one measure of a text and votes good (1), bad (-1) or abstains
(0).  No rule decides: a two-class model holds for each rule how often it votes good, bad
and not at all on good and on bad texts (rules are independent given the class).
Expectation-maximisation estimates these rates, and so the rules' accuracies, and the
share of good texts from the votes of all documents that the base rules pass, without
labels.  It starts from one belief about every rule: a bad vote is rare on good texts, a
good vote frequent on both kinds; what a rule is worth is learned.  A bad vote never
speaks for a text and a good one never against it.  A document's quality is the posterior
probability of "good"; it is kept at ``bar`` or more, unless the base rules fail it.

Votes form at most 3 to the number of rules patterns, whatever the corpus, so the
estimate runs on the counts of the patterns.  Measures, votes and posterior are
DataFrame functions.  Repeated windows are found inside the row: the hashes of a
text's windows are sorted with their places and neighbours compared, and texts whose
window hashes are all distinct skip that.  Windows are told apart by 64-bit hashes.

Defined cases: a null or empty text has no words, fails the base rules and its votes
abstain; very long texts and lines are measured whole; rows that repeat a doc_id or
text each get their row and count each in the estimate; a null doc_id keeps its row;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylake.functions.arrays import bound

from .common import stage

BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
#: Counted as symbols by the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Frequent function words of some languages in lower case; a text in sentences holds some of them.
FUNCTION_WORDS = (
    "the of and to in is that for was with "
    "der die und das ist von den mit ein nicht "
    "de la le et les des que en un pour "
    "el los las una por con del se no para "
    "il di che non per una sono dei o e da do na nie i w het van een"
).split()


@dataclass(frozen=True)
class Rule:
    """A vote by one measure: good and bad are SQL conditions over the measures; neither means abstain."""

    name: str
    good: str
    bad: str


RULES = (
    Rule("symbols", "n_symbols <= 0.01 * n_words", "n_symbols > 0.1 * n_words"),
    Rule("word_length", "word_chars BETWEEN 3.5 * n_words AND 9 * n_words", "word_chars < 2.5 * n_words OR word_chars > 12 * n_words"),
    Rule("capitals", "n_capitals <= 0.1 * word_chars", "n_capitals > 0.3 * word_chars"),
    Rule("repeated_lines", "n_lines >= 3 AND n_dup_lines = 0", "n_dup_lines > 0.3 * n_lines"),
    Rule("repeated_words", "n_repeat_words <= 0.02 * n_words", "n_repeat_words > 0.2 * n_words"),
    Rule("variety", "n_distinct >= pow(n_words, 0.75)", "n_distinct < pow(n_words, 0.6)"),
    Rule("sentences", "n_stops BETWEEN n_words / 60 AND n_words / 3", "n_stops > n_words / 2 OR (n_words >= 40 AND n_stops = 0)"),
    Rule("shouts", "n_shouts <= 0.02 * n_words", "n_shouts > 0.15 * n_words"),
    Rule("function_words", "n_function >= 3", "n_words >= 30 AND n_function = 0"),
    Rule("figures", "n_figures <= 0.05 * word_chars", "n_figures > 0.25 * word_chars"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


#: Rates of a bad vote, none and a good vote, on bad and on good texts, before anything is learned.
BELIEF = ((0.3, 0.1, 0.6), (0.02, 0.18, 0.8))


@dataclass
class Model:
    """Share of good texts and, by rule, the rates of its votes (bad, none, good) on bad and on good texts."""

    good: float
    rates: dict[str, tuple[tuple[float, ...], tuple[float, ...]]]
    rounds: int

    def weights(self) -> dict[str, tuple[float, float, float]]:
        """What a rule's bad vote, abstention and good vote add to the log-odds of "good"."""
        odds = {r: [math.log(g / b) for b, g in zip(*rates, strict=True)] for r, rates in self.rates.items()}
        return {r: (min(0.0, w[0]), w[1], max(0.0, w[2])) for r, w in odds.items()}

    def accuracies(self) -> dict[str, float]:
        """How often each rule is right where it votes."""
        return {r: (self.good * g[2] + (1 - self.good) * b[0]) / (self.good * (g[0] + g[2]) + (1 - self.good) * (b[0] + b[2])) for r, (b, g) in self.rates.items()}

    def odds(self) -> float:
        return math.log(self.good / (1 - self.good))


def _repeat_words(h: Column) -> Column:
    """Words covered by windows whose hash stands twice or more in ``h``, the hashes by place."""
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.coalesce(a["x"] == b["x"], F.lit(False)))
        either = lambda e: F.zip_with(e, F.concat(F.array(F.lit(False)), e), lambda a, b: F.coalesce(a, F.lit(False)) | b)
        # One flag more than places: the last stands for no window.
        return F.sort_array(F.filter(F.zip_with(s, bound(same, either), lambda a, twice: F.when(twice, a["i"])), lambda i: i.isNotNull()))

    def covered(p: Column) -> Column:
        ahead = F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(ahead, F.lit(0).cast("long"), lambda t, x: t + x)

    return bound(bound(placed, starts), covered)


def _count(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are of the class ``chars``."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def _pairs(h: Column, apart: int) -> Column:
    """The hash of each element and the one ``apart`` places on; shorter by ``apart``."""
    n = F.size(h) - apart
    # Both sides cut once for the whole array: a slice for each element would copy the array each time.
    both = F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(apart + 1), n), lambda a, b: F.xxhash64(a, b))
    return F.when(n > 0, both).otherwise(F.array().cast("array<bigint>"))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of each text, by one pass over the texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim("text", F.lit(BLANKS))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select(
        "doc_id",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN)).alias("w"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("lines"),
        F.regexp_replace("text", "[\\p{L}\\s]+", "").alias("marks"),
        _count(F.col("text"), "\\p{Lu}").alias("n_capitals"),
    )
    lines, marks = F.col("lines"), F.col("marks")
    rows = rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _count(marks, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).alias("n_lines"),
        "n_capitals",
        _count(marks, "!").alias("n_shouts"),
        _count(marks, ".!?").alias("n_stops"),
        _count(marks, "0-9").alias("n_figures"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    rows = rows.select(
        *[c for c in rows.columns if c != "h"],
        F.size(F.array_distinct("h")).alias("n_distinct"),
        F.size(F.array_intersect("h", F.array(*[F.xxhash64(F.lit(w)) for w in FUNCTION_WORDS]))).alias("n_function"),
        bound(bound(_pairs(F.col("h"), 1), lambda x: _pairs(x, 2)), lambda x: _pairs(x, 4)).alias("h"),
    )
    repeated = F.size(F.array_distinct("h")) < F.size("h")
    return rows.select(*[c for c in rows.columns if c != "h"], F.when(repeated, _repeat_words(F.col("h"))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"))


def votes(measures: DataFrame) -> DataFrame:
    """``measures`` with a column vote_<rule> for each rule: 1, -1 or 0; a text without words gets no vote."""
    some = F.col("n_words") > 0
    vote = lambda r: F.when(some & F.expr(r.bad), -1).when(some & F.expr(r.good), 1).otherwise(0)
    return measures.select("*", *[vote(r).cast("tinyint").alias(f"vote_{r.name}") for r in RULES])


def estimate(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = 200, pull: float = 0.01) -> Model:
    """Rates by expectation-maximisation from (votes, documents) patterns.

    A share ``pull`` of the documents of each class stands for the belief that it
    starts from, at every size of the corpus, so that a rule without votes keeps it.
    """
    total = sum(n for _, n in patterns)
    weight_of_belief = pull * total + 1
    model, moved = Model(0.8, dict.fromkeys(names, BELIEF), 0), 1.0
    while model.rounds < rounds and moved > 1e-7:
        weights, prior = model.weights(), model.odds()
        sums = {r: [[weight_of_belief * x for x in side] for side in BELIEF] for r in names}
        mass = 0.0
        for pattern, n in patterns:
            odds = prior + sum(weights[r][v + 1] for r, v in zip(names, pattern, strict=True))
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            mass += n * p
            for r, v in zip(names, pattern, strict=True):
                sums[r][0][v + 1] += n * (1 - p)
                sums[r][1][v + 1] += n * p
        rates = {r: tuple(tuple(x / sum(side) for x in side) for side in both) for r, both in sums.items()}
        good = (mass + 0.8 * weight_of_belief) / (total + weight_of_belief)
        moved = max([abs(good - model.good)] + [abs(a - b) for r in names for k in (0, 1) for a, b in zip(rates[r][k], model.rates[r][k], strict=True)])
        model = Model(good, rates, model.rounds + 1)
    return model


def fit_model(voted: DataFrame) -> Model:
    """The model from the votes of all documents that the base rules leave to it; what reaches the driver is one row for each pattern of votes."""
    names = [r.name for r in RULES]
    columns = [f"vote_{r}" for r in names]
    rows = voted.filter(~base_failed()).groupBy(columns).count().orderBy(columns).collect()
    return estimate([(tuple(r[c] for c in columns), r["count"]) for r in rows], names)


def posterior(model: Model) -> Column:
    """The probability of "good" from the columns vote_<rule>."""
    odds = F.lit(model.odds())
    for r, (bad, none, good) in model.weights().items():
        odds = odds + F.when(F.col(f"vote_{r}") > 0, good).when(F.col(f"vote_{r}") < 0, bad).otherwise(none)
    return 1 / (1 + F.exp(-odds))


def base_failed() -> Column:
    """Too short, or mostly repeated windows: these rules alone are enough to leave a text out."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, bar: float = 0.5) -> DataFrame:
    """doc_id, the measures, the votes, base_failed, quality (posterior of good; 0 without words), kept."""
    voted = stage(votes(measure(docs)), "quality-votes")
    model = fit_model(voted)
    scored = voted.withColumn("base_failed", base_failed()).withColumn("quality", F.when(F.col("n_words") > 0, posterior(model)).otherwise(0.0))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= bar))

