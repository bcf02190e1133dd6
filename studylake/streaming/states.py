"""Keyed state over a stream of answers: the ladder and the rating, answer by answer.

The batch folds of ``operators.review`` are what these must equal where answers
arrive in the order of time.  State is one small row per question, so its size
follows the catalogue, not the log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupStateTimeout

from studylake.shipping import ship

LADDER = "question_id long, level int, interval_days int, due_at timestamp_ntz, answers long"
RATING = "question_id long, difficulty double, attempts long"


def once(answers: DataFrame, *keys: str, delay: str = "1 hour") -> DataFrame:
    """A stream without answers delivered again within the delay."""
    stamped = answers.withColumn("event_time", F.col("answered_at").cast("timestamp"))
    return stamped.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(list(keys)).drop("event_time")


def ladder_step(level: int, right: bool) -> tuple[int, int]:
    """The next level and its interval in days."""
    level = min(level + 1, 5) if right else 0
    return level, (1 if level == 0 else min(1 << level, 30))


def _ladder(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    level, n, days, due = 0, 0, 1, None
    if state.exists:
        level, n = state.get
    rows = pd.concat(list(batches)).sort_values(["answered_at", "id"], kind="stable")
    for right, at in zip(rows["right"], rows["answered_at"], strict=True):
        level, days = ladder_step(level, right)
        due, n = (at + pd.Timedelta(days=days) if right else at), n + 1
    state.update((level, n))
    yield pd.DataFrame({"question_id": [key[0]], "level": [level], "interval_days": [days], "due_at": [due], "answers": [n]})


def ladder(answers: DataFrame) -> DataFrame:
    """The state of each question after every micro-batch that holds answers to it."""
    ship(answers.sparkSession)
    rows = answers.filter("grade IS NOT NULL").select("question_id", "id", "answered_at", (F.col("grade") == "CORRECT").alias("right"))
    return rows.groupBy("question_id").applyInPandasWithState(_ladder, LADDER, "level int, answers long", "update", GroupStateTimeout.NoTimeout)


class _Ladder(StatefulProcessor):
    """One value for a question; it begins with what the batch fold left."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("ladder", "level int, answers long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.held.update((int(row["level"]), int(row["answers"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        level, n = self.held.get() if self.held.exists() else (0, 0)
        for _, right, at in pd.concat(list(rows)).sort_values(["answered_at", "id"], kind="stable")[["id", "right", "answered_at"]].itertuples(index=False):
            level, days = ladder_step(level, right)
            due, n = (at + pd.Timedelta(days=days) if right else at), n + 1
        self.held.update((level, n))
        yield pd.DataFrame({"question_id": [key[0]], "level": [level], "interval_days": [days], "due_at": [due], "answers": [n]})

    def close(self) -> None:
        pass


def ladder_after(answers: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``ladder`` over a stream that goes on where a batch ended.

    ``before`` (question_id, level, answers; one row each) is the state of the
    answers up to the stream's first; it counts once, in the first run of a
    checkpoint.  Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    ship(answers.sparkSession)
    rows = answers.filter("grade IS NOT NULL").select("question_id", "id", "answered_at", (F.col("grade") == "CORRECT").alias("right"))
    begin = before.select("question_id", "level", F.col("answers").cast("long").alias("answers")).groupBy("question_id") if before is not None else None
    return rows.groupBy("question_id").transformWithStateInPandas(_Ladder(), LADDER, "Update", "None", begin)


def _rating(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values(["answered_at", "id"], kind="stable")
    d, n = state.get if state.exists else (float(rows["start"].iloc[0]), 0)
    for right, ability in zip(rows["is_correct"], rows["ability"], strict=True):
        d = min(1200.0, max(-400.0, d + 16.0 * (1.0 / (1.0 + 10.0 ** ((d - ability) / 400.0)) - (1.0 if right else 0.0))))
        n += 1
    state.update((d, n))
    yield pd.DataFrame({"question_id": [key[0]], "difficulty": [d], "attempts": [n]})


def rating(answers: DataFrame) -> DataFrame:
    """The rating of each question; answers carry the ability at their time and the initial rating."""
    ship(answers.sparkSession)
    rows = answers.filter("is_correct IS NOT NULL").select("question_id", "id", "answered_at", "is_correct", "ability", "start")
    return rows.groupBy("question_id").applyInPandasWithState(_rating, RATING, "difficulty double, attempts long", "update", GroupStateTimeout.NoTimeout)


def latest(updates: DataFrame, count: str = "answers") -> DataFrame:
    """The newest state of each question from a table of updates."""
    rest = [c for c in updates.columns if c != "question_id"]
    return updates.groupBy("question_id").agg(F.max_by(F.struct(*rest), F.col(count)).alias("s")).select("question_id", "s.*")
