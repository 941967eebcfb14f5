import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from itemloom.operators import diff, state
from itemloom.sources import marks_blob
from itemloom.streaming import journal

T0 = datetime(2024, 1, 1)


def marks(spark, *rows):
    return spark.createDataFrame(
        [(i, q, v, T0 + timedelta(hours=h)) for i, (q, v, h) in enumerate(rows)], "id bigint, question_id bigint, value string, created_at timestamp_ntz"
    )


def test_latest_mark_ties_go_by_id(spark):
    m = marks(spark, (1, "known", 1), (1, "unsure", 1), (2, "flagged", 3), (2, "cleared", 4))
    assert {r["question_id"]: r["value"] for r in state.current_mark(m).collect()} == {1: "unsure", 2: "cleared"}
    assert {r["value"]: r["n"] for r in state.mark_counts(state.current_mark(m)).collect()} == {"known": 0, "unsure": 1, "flagged": 0}


def test_import_is_idempotent(spark):
    question = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    incoming = spark.createDataFrame([(1, "known"), (2, "unsure"), (3, ""), (9, "known"), (2, "bogus")], "question_id bigint, value string")
    journal_ = marks(spark, (2, "unsure", 1))
    first = state.classify_import(incoming, question, state.current_mark(journal_))
    assert sorted((r["question_id"], r["fate"]) for r in first.collect()) == [(1, "imported"), (2, "ignored"), (2, "skipped"), (3, "empty"), (9, "unmatched")]
    new = first.where("fate = 'imported'").select(F.lit(100).cast("bigint").alias("id"), "question_id", "value", F.lit(T0).cast("timestamp_ntz").alias("created_at"))
    merged, refused = state.append_marks(journal_, new)
    assert refused.isEmpty()
    again = state.classify_import(incoming, question, state.current_mark(merged))
    assert again.where("fate = 'imported'").isEmpty()


def test_four_blob_shapes(spark, tmp_path):
    flat = {"a/1": "known", "a/2": ""}
    shapes = [flat, {"marks": flat}, {"kb-marks": json.dumps(flat)}, [{"question_id": "a/1", "value": "known"}, {"id": "a/2", "value": ""}]]
    for i, shape in enumerate(shapes):
        (tmp_path / f"b{i}.json").write_text(json.dumps(shape))
    rows = marks_blob.parse_blobs(marks_blob.read_blobs(spark, str(tmp_path))).collect()
    assert sorted((r["question_id"], r["value"]) for r in rows) == [("a/1", "known")] * 4 + [("a/2", "")] * 4
    assert all(r["at"] is not None for r in rows)


def test_answers_after_the_close_are_rejected(spark):
    log = spark.createDataFrame(
        [(1, 0, T0, 1, "show", None, 0), (1, 0, T0 + timedelta(days=1), 2, "answer", "A", 50), (1, 0, T0 + timedelta(days=2), 3, "answer", "A", -5),
         (1, 0, T0 + timedelta(days=3), 4, "answer", "B", 7), (1, 0, T0 + timedelta(days=9), 5, "answer", "C", 7), (1, 1, T0, 6, "show", None, 0)],
        "attempt_id bigint, position int, at timestamp_ntz, id bigint, kind string, selection string, time_ms bigint",
    )
    closed = spark.createDataFrame([(1, T0 + timedelta(days=5))], "id bigint, closed_at timestamp_ntz")
    rows = {r["position"]: r for r in state.fold_answers(log, closed).collect()}
    r = rows[0]
    assert (r["selection"], r["change_count"], r["time_ms"]) == ("B", 1, 57)
    assert r["first_shown_at"] == T0 and r["answered_at"] == T0 + timedelta(days=3)
    assert rows[1]["answered_at"] is None and rows[1]["change_count"] == 0


def test_second_plan_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a", 1.5, "r1"), (2, "b", None, "r1"), (3, "c", 2.0, "r1")], "id int, t string, w double, ingest_run_id string")
    new = spark.createDataFrame([(2, "b", None), (3, "C", 2.0), (4, "d", None)], "id int, t string, w double")
    plan = diff.plan_table(new, old, ["id"])
    assert {r["id"]: r["change"] for r in plan.collect()} == {1: "delete", 2: "unchanged", 3: "update", 4: "insert"}
    after = diff.apply_plan(plan, "r2")
    assert {r["ingest_run_id"] for r in after.collect()} == {"r2"}
    again = diff.plan_table(new, after, ["id"])
    assert {r["change"] for r in again.collect()} == {"unchanged"}


def test_stream_equals_batch_over_many_micro_batches(spark, tmp_path):
    for i in range(4):
        rows = [(10 * i + j, j % 3, "known" if (i + j) % 2 else "unsure", T0 + timedelta(hours=(7 * i + j) % 5)) for j in range(10)]
        spark.createDataFrame(rows, "id bigint, question_id bigint, value string, created_at timestamp_ntz").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = journal.read_events(spark, str(tmp_path / "in"), batch.schema, files_per_trigger=1)
    q = journal.maintain_current_marks(stream, str(tmp_path / "state"), str(tmp_path / "ckpt"))
    q.awaitTermination()
    assert len(q.recentProgress) >= 4
    got = {r["question_id"]: r["value"] for r in journal.read_state(spark, str(tmp_path / "state")).collect()}
    assert got == {r["question_id"]: r["value"] for r in state.current_mark(batch).collect()}
    # A restart without new files leaves the state; one with a file goes on from it.
    again = lambda: journal.maintain_current_marks(journal.read_events(spark, str(tmp_path / "in"), batch.schema), str(tmp_path / "state"), str(tmp_path / "ckpt"))
    again().awaitTermination()
    assert {r["question_id"]: r["value"] for r in journal.read_state(spark, str(tmp_path / "state")).collect()} == got
    late = spark.createDataFrame([(99, 0, "flagged", T0 + timedelta(days=9))], "id bigint, question_id bigint, value string, created_at timestamp_ntz")
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    again().awaitTermination()
    assert {r["question_id"]: r["value"] for r in journal.read_state(spark, str(tmp_path / "state")).collect()} == got | {0: "flagged"}
    assert journal.read_state(spark, str(tmp_path / "nothing")).isEmpty()


def test_ranges_of_keys_leave_equal_rows_in_place(spark):
    old = spark.range(20000).select("id", F.concat(F.lit("t"), "id").alias("t"), F.when(F.col("id") % 3 == 0, 1.5).alias("w"))
    new = old.where("id <> 5").withColumn("w", F.when(F.col("id") == 9, 2.5).otherwise(F.col("w"))).unionByName(
        spark.createDataFrame([(-1, None, None)], "id bigint, t string, w double")
    )
    ranges = diff.differing_ranges(new, old, ["id"], ["t", "w"])
    assert ranges.count() <= 3 and diff.under(old, ranges, ["id"]).count() <= 12
    changed = diff.changed_rows(new, old, ["id"])
    assert {(r["id"], r["change"]) for r in changed.collect()} == {(5, "delete"), (9, "update"), (-1, "insert")}
    found = diff.verify_fields(old, new, "id", ["t", "w"])
    assert {(r["id"], r["problem"]) for r in found.collect()} == {(5, "missing"), (9, "w"), (-1, "unexpected")}
    # A repeated row is a difference, equal tables in another order are none.
    assert diff.differing_ranges(old, old.repartition(5, "t"), ["id"], ["t", "w"]).isEmpty()
    twice = old.unionByName(old.where("id = 4"))
    assert diff.differing_ranges(old, twice, ["id"], ["t", "w"]).count() == 1
    assert [tuple(r) for r in diff.refused_keys(twice, old, ["id"]).collect()] == [(4, 2, "desired")]
