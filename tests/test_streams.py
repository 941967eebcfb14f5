"""The answer log as a stateful stream and the bucketed state beneath it."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from itemloom.operators import state
from itemloom.streaming import answers, buckets, journal

T0 = datetime(2024, 1, 1)
EVENT = "attempt_id bigint, position int, at timestamp_ntz, id bigint, kind string, selection string, time_ms bigint"


def log_rows(n, seed=3):
    deal = random.Random(seed)
    rows = []
    for i in range(n):
        kind = "show" if deal.random() < 0.3 else "answer"
        at = T0 + timedelta(minutes=deal.randrange(5000))
        attempt = 1 if deal.random() < 0.34 else deal.randrange(2, 9)
        rows.append((attempt, deal.randrange(3), at, i, kind, deal.choice(["A", "B", None]), deal.choice([None, -3, 40])))
    return rows


def put(spark, rows, path):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(path))


def follow(spark, base, attempts, delay):
    schema = spark.createDataFrame([], EVENT).schema
    events = journal.read_events(spark, str(base / "in"), schema, files_per_trigger=1)
    query = answers.maintain_answer_log(events, attempts, str(base / "log"), str(base / "ckpt"), delay)
    query.awaitTermination()
    return sorted(map(tuple, answers.item_state(spark, str(base / "log")).collect()), key=repr)


@pytest.fixture
def attempts(spark):
    closed = [(i, T0 + timedelta(minutes=3000) if i % 2 else None) for i in range(1, 8)]
    return spark.createDataFrame(closed, "id bigint, closed_at timestamp_ntz")


def test_answers_in_any_order_with_a_restart(spark, tmp_path, attempts):
    rows = log_rows(400)
    for i in range(0, 300, 100):
        put(spark, rows[i : i + 100] + rows[i : i + 5], tmp_path / "in")  # five come twice
    follow(spark, tmp_path, attempts, "30 days")
    put(spark, rows[300:] + rows[:7], tmp_path / "in")
    got = follow(spark, tmp_path, attempts, "30 days")
    whole = spark.createDataFrame(rows, EVENT)
    assert got == sorted(map(tuple, state.fold_answers(whole, attempts).collect()), key=repr)
    refused = answers.refused_events(spark, str(tmp_path / "log"))
    reasons = {r["reason"]: r["n"] for r in refused.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert reasons["repeated"] > 0 and set(reasons) == {"repeated", "closed", "unknown attempt"}
    once = refused.where("reason <> 'repeated'").select("id").distinct()
    assert once.count() == state.refused_answers(whole, attempts).count()


def test_an_answer_behind_the_watermark_is_a_refused_row(spark, tmp_path, attempts):
    at = lambda m: T0 + timedelta(minutes=m)
    put(spark, [(2, 0, at(10), 1, "answer", "A", 5), (2, 0, at(500), 2, "answer", "B", 5)], tmp_path / "in")
    follow(spark, tmp_path, attempts, "60 minutes")
    put(spark, [(2, 0, at(501), 3, "answer", "A", 5)], tmp_path / "in")
    follow(spark, tmp_path, attempts, "60 minutes")
    put(spark, [(2, 0, at(20), 4, "answer", "C", 5), (2, 0, at(5), 5, "show", None, None), (2, 0, at(499), 6, "answer", "D", 5), (2, 0, None, 7, "show", None, 0)], tmp_path / "in")
    (row,) = follow(spark, tmp_path, attempts, "60 minutes")
    # A, D, B, A: the answer at 499 is within the delay, the one at 20 is not; the show still counts.
    assert row == (2, 0, "A", at(501), at(5), 20, 3)
    assert {(r["id"], r["reason"]) for r in answers.refused_events(spark, str(tmp_path / "log")).collect()} == {(4, "late"), (7, "no time")}


def latest(rows):
    return rows.groupBy("k").agg(F.max("v").alias("v"))


def test_a_batch_writes_the_buckets_it_touches(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k bigint, v bigint"
    rows = lambda *pairs: spark.createDataFrame(list(pairs), schema)
    assert buckets.read(spark, path, schema).isEmpty()
    buckets.merge(rows(*[(i, 0) for i in range(200)]), 0, path, schema, ["k"], latest, buckets=8)
    size = lambda n: sum(f.stat().st_size for f in Path(path, f"batch={n}").rglob("*.parquet"))
    first = size(0)
    for n in range(1, 5):
        for _ in range(2):  # each batch is run again after its commit
            buckets.merge(rows((7, n)), n, path, schema, ["k"], latest, buckets=8)
    written = [p.name for p in Path(path, "batch=4").glob("bucket=*")]
    assert len(written) == 1 and size(4) < first / 4
    got = dict(map(tuple, buckets.read(spark, path, schema).collect()))
    assert got == {i: 4 if i == 7 else 0 for i in range(200)}
    # Older states of the bucket are gone, the others of batch 0 stand.
    assert {p.name for p in Path(path).glob("batch=*")} == {"batch=0", "batch=3", "batch=4"}
    assert len(list(Path(path, "batch=0").glob("bucket=*"))) == 7
    assert {p.name for p in Path(path, "commits").glob("batch=*")} == {"batch=3", "batch=4"}
    buckets.merge(rows(), 5, path, schema, ["k"], latest, buckets=8)
    assert buckets.read(spark, path, schema).count() == 200


def test_a_bucket_left_without_rows_is_read_as_empty(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k bigint, v bigint"
    rows = lambda *pairs: spark.createDataFrame(list(pairs), schema)
    kept = lambda given: latest(given).where("v >= 0")
    for n, pairs in enumerate([[(1, 5), (2, -1)], [(1, -3), (3, 4)], [(2, -2)], [(2, 6)]]):
        buckets.merge(rows(*pairs), n, path, schema, ["k"], kept, buckets=64, first=latest)
    assert dict(map(tuple, buckets.read(spark, path, schema).collect())) == {1: 5, 2: 6, 3: 4}


def test_the_answer_log_runs_no_python_per_key(spark, tmp_path, attempts):
    put(spark, log_rows(50), tmp_path / "in")
    events = journal.read_events(spark, str(tmp_path / "in"), spark.createDataFrame([], EVENT).schema)
    query = answers.maintain_answer_log(events, attempts, str(tmp_path / "log"), str(tmp_path / "ckpt"), "30 days")
    query.awaitTermination()
    assert not query.lastProgress["stateOperators"]
    assert answers.item_state(spark, str(tmp_path / "log")).count() > 0
