import random
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from itemloom.functions import blocked
from itemloom.operators import state


def log(spark, n=900):
    """One key holds a third of the rows."""
    rng = random.Random(3)
    rows = []
    for i in range(n):
        key = 0 if i % 3 == 0 else rng.randint(1, 40)
        at = datetime(2024, 1, 1) + timedelta(minutes=rng.randint(0, 12000))
        rows.append((i, key, rng.choice("ab"), at))
    return spark.createDataFrame(rows, "id bigint, question_id bigint, value string, created_at timestamp_ntz")


ORDER = [F.col, "created_at", "id"]


def test_row_number_and_lag_equal_the_plain_window(spark):
    df = log(spark)
    order = [F.col("created_at"), F.col("id")]
    w = Window.partitionBy("question_id").orderBy(*order)
    day = F.date_trunc("day", F.col("created_at"))
    out = blocked.row_number(df, ["question_id"], day, order, "rn")
    out = blocked.lag(out, ["question_id"], day, order, F.col("value"), "prev")
    same = out.withColumn("rn2", F.row_number().over(w)).withColumn("prev2", F.lag("value").over(w))
    assert same.count() == 900
    assert same.where(~(F.col("rn") == F.col("rn2")) | ~F.col("prev").eqNullSafe(F.col("prev2"))).isEmpty()


def test_toggles_equal_the_step_by_step_fold(spark):
    df = log(spark)
    got = {r["id"]: r["state"] for r in state.fold_toggles(df).collect()}
    now = {}
    for r in sorted(df.collect(), key=lambda r: (r["created_at"], r["id"])):
        q, v = r["question_id"], r["value"]
        now[q] = None if now.get(q) == v else v
        assert got[r["id"]] == now[q]


def test_a_run_may_span_many_days(spark):
    rows = [(i, 1, "a", datetime(2024, 1, 1) + timedelta(days=i)) for i in range(9)]
    df = spark.createDataFrame(rows, "id bigint, question_id bigint, value string, created_at timestamp_ntz")
    got = [r["state"] for r in state.fold_toggles(df).orderBy("id").collect()]
    assert got == ["a", None] * 4 + ["a"]
