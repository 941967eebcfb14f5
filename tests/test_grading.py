from itertools import combinations
from math import comb

import pytest
from pyspark.sql import functions as F

from itemloom.functions import grading as g
from itemloom.operators import exams


def grade(spark, options, correct, chosen_sets):
    rows = [(i, 1, list(options), list(correct), list(c), 1) for i, c in enumerate(chosen_sets)]
    df = spark.createDataFrame(
        rows, "id int, attempt_id int, option_labels array<string>, correct_labels array<string>, selected_labels array<string>, answered_at int"
    )
    return exams.grade_items(df)


@pytest.mark.parametrize("correct, wrong", [("C", -1 / 3), ("BD", -1 / 5)])
def test_every_subset(spark, correct, wrong):
    subsets = [c for k in range(5) for c in combinations("ABCD", k)]
    got = {tuple(r["chosen"]): r for r in grade(spark, "ABCD", correct, subsets).collect()}
    assert len(got) == 16
    for chosen, r in got.items():
        if not chosen:
            expected = ("blank", 0.0)
        elif chosen == tuple(correct):
            expected = ("correct", 1.0)
        elif len(chosen) != len(correct):
            expected = ("over_selected" if len(chosen) > len(correct) else "under_selected", wrong)
        else:
            expected = ("incorrect", wrong)
        assert (r["outcome"], r["credit"]) == expected
        assert r["is_correct"] == (chosen == tuple(correct))


def test_click_order_and_unknown_labels_do_not_matter(spark):
    r = grade(spark, "ABCD", "BD", [("D", "B", "Z")]).first()
    assert r["is_correct"] and r["chosen"] == ["B", "D"]


def test_combinations(one):
    for n, k in [(4, 1), (4, 2), (5, 0), (3, 5), (40, 20), (30, 15)]:
        assert one(g.combinations(F.lit(n), F.lit(k))) == comb(n, k)


def test_guessing_earns_nothing(spark):
    graded = grade(spark, "ABCDE", "BD", [("A",)]).unionByName(grade(spark, "ABCD", "A", [("A",)]))
    rows = exams.guessing_calibration(graded).collect()
    assert {(r["options"], r["wanted"], r["responses"]) for r in rows} == {(5, 2, 10), (4, 1, 4)}
    assert all(r["expected_credit"] == 0.0 for r in rows)


def test_scale(one):
    assert one(g.scaled_score(F.lit(0.0))) == 100
    assert one(g.scaled_score(F.lit(1.5))) == 1000
    assert one(g.scaled_score(F.lit(0.5), 0, 1)) == 0  # half-even
    assert one(g.scaled_score(F.lit(31.0 / 45))) == 720


def test_thirds_do_not_drift(spark):
    items = grade(spark, "ABCD", "C", [("A",)] * 3000 + [("C",)] * 1000)
    r = exams.attempt_totals(items).first()
    assert (r["item_count"], r["correct_count"], r["credit_total"]) == (4000, 1000, 0.0)


def test_attempts_are_graded_once(spark):
    attempt = spark.createDataFrame([(1, "x", 5), (2, "x", None), (3, "x", 6)], "id int, certification_id string, submitted_at int")
    items = grade(spark, "ABCD", "C", [("C",)]).select("id", "attempt_id", "option_labels", "correct_labels", "selected_labels", "answered_at")
    done = spark.createDataFrame([(3,)], "attempt_id int")
    rows = exams.grade_attempts(attempt, items, graded=done).collect()
    assert [(r["attempt_id"], r["scaled_score"], r["passed"]) for r in rows] == [(1, 1000, True)]


def test_responses_by_rank(spark):
    rows = [("ABCDE", 2), ("ABC", 3), ("ABCD", 1), ("AB", 3)]
    keys = spark.createDataFrame([(list(o), k) for o, k in rows], "option_labels array<string>, wanted int")
    got = {}
    for r in exams.guessing_space(keys).collect():
        got.setdefault(("".join(r["option_labels"]), r["wanted"]), {})[r["rank"]] = tuple(r["selected_labels"])
    assert got == {(o, k): dict(enumerate(combinations(o, k))) for o, k in rows if k <= len(o)}


def test_forty_options(spark, monkeypatch):
    monkeypatch.setattr(exams, "SPAN", 100)
    labels = [f"o{i:02d}" for i in range(40)]
    keys = spark.createDataFrame([(labels, [labels[3], labels[39]], 2), (labels, labels[:3], 3)], "option_labels array<string>, key array<string>, wanted int")
    rows = exams.guessing_calibration(keys).collect()
    assert {(r["wanted"], r["responses"], r["expected_credit"]) for r in rows} == {(2, comb(40, 2), 0.0), (3, comb(40, 3), 0.0)}
    last = keys.limit(1).select(g.unrank(F.col("option_labels"), F.lit(20), F.lit(comb(40, 20) - 1)).alias("v")).first()["v"]
    assert last == labels[20:]


def test_cut_proportion(one):
    cut = lambda lo, hi, at: one(g.cut_proportion(F.lit(lo), F.lit(hi), F.lit(at)))
    assert cut(100, 1000, 720) == pytest.approx(31 / 45) and cut(0, 0, 5) == 0.0
