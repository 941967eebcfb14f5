"""Answer logs leave nothing out without a row."""

import datetime as dt

from itemloom.operators import state

T0 = dt.datetime(2024, 1, 1)


def test_late_shows_stay_and_refused_events_are_rows(spark):
    day = lambda n: T0 + dt.timedelta(days=n)
    log = spark.createDataFrame(
        [(1, 0, day(9), 1, "show", None, 0), (1, 0, day(9), 2, "answer", "A", 5), (7, 0, day(1), 3, "show", None, 0), (1, 1, day(1), 4, "answer", "B", 5)],
        "attempt_id bigint, position int, at timestamp_ntz, id bigint, kind string, selection string, time_ms bigint",
    )
    closed = spark.createDataFrame([(1, day(5))], "id bigint, closed_at timestamp_ntz")
    got = {(r["attempt_id"], r["position"]): (r["first_shown_at"], r["selection"]) for r in state.fold_answers(log, closed).collect()}
    assert got == {(1, 0): (day(9), None), (1, 1): (day(1), "B")}
    assert {r["id"]: r["reason"] for r in state.refused_answers(log, closed).collect()} == {2: "closed", 3: "unknown attempt"}
