"""States of a stream against the batch folds over the same answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from studylake.functions import rules
from studylake.operators import review
from studylake.sources import bindings
from studylake.streaming import states


def _run(stream, name, tmp_path, mode="update"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return stream.sparkSession.table(name)


@pytest.fixture()
def answers(spark, sf_dir, tmp_path):
    """The log as files in the order of time, read one a micro-batch."""
    log = bindings.attempts(spark, sf_dir).orderBy("answered_at").limit(240).cache()
    folder = tmp_path / "log"
    for low in range(0, 240, 80):
        part = log.orderBy("answered_at").offset(low).limit(80)
        part.coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return log, stream


def test_ladder_equals_the_fold(answers, tmp_path):
    log, stream = answers
    got = states.latest(_run(states.ladder(stream), "ladder", tmp_path))
    want = review.states(log)
    columns = ["question_id", "level", "interval_days", "due_at"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_rating_equals_the_fold(answers, tmp_path):
    log, stream = answers
    ability = rules.ability(F.lit(0.6))
    start = F.lit(400.0)
    got = states.latest(_run(states.rating(stream.withColumn("ability", ability).withColumn("start", start)), "rating", tmp_path), "attempts")
    want = {r["question_id"]: r for r in review.rated(log.filter("is_correct IS NOT NULL").withColumn("ability", ability).withColumn("start", start)).collect()}
    rows = got.collect()
    assert len(rows) == len(want)
    assert all(abs(r["difficulty"] - want[r["question_id"]]["difficulty"]) < 1e-9 and r["attempts"] == want[r["question_id"]]["attempts"] for r in rows)


def test_delivered_twice_counts_once(answers, tmp_path):
    log, stream = answers
    got = _run(states.once(stream.union(stream), "question_id", "answered_at"), "once", tmp_path, "append")
    assert got.count() == log.select("question_id", "answered_at").distinct().count()


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def test_a_stream_goes_on_where_the_batch_ended(answers, rocks, spark, tmp_path):
    """The first third as a batch, the second in one run, the last after a restart from the same checkpoint."""
    log, _ = answers
    parts = [log.orderBy("answered_at", "id").offset(low).limit(80).cache() for low in range(0, 240, 80)]
    assert sum(p.count() for p in parts) == 240
    done = parts[0].filter("grade IS NOT NULL").groupBy("question_id").agg(F.count("*").alias("answers"))
    review.states(parts[0]).join(done, "question_id").write.parquet(str(tmp_path / "before"))
    before = spark.read.parquet(str(tmp_path / "before"))
    folder, out = str(tmp_path / "more"), str(tmp_path / "out")
    for part in parts[1:]:
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = states.ladder_after(spark.readStream.schema(log.schema).parquet(folder), before)
        write = lambda rows, n: rows.write.mode("append").parquet(out)
        query = stream.writeStream.foreachBatch(write).outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "point")).start()
        query.awaitTermination(300)
        assert query.exception() is None
    got = states.latest(spark.read.parquet(out))
    columns = ["question_id", "level", "interval_days", "due_at"]
    touched = parts[1].union(parts[2]).filter("grade IS NOT NULL").select("question_id").distinct()
    want = review.states(log).join(touched, "question_id", "left_semi")
    assert got.count() > 10 and sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert before.join(touched, "question_id", "left_semi").count() > 0
