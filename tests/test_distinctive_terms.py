import random

from itemloom.operators import search_index as I
from itemloom.operators import stats


def test_only_plurals_are_joined(spark):
    rows = [("a", "cats", 4), ("a", "cat", 2), ("a", "glass", 5), ("b", "cats", 3), ("b", "dog", 9), ("c", "dogs", 1)]
    terms = stats.distinctive_terms(spark.createDataFrame(rows, "domain string, term string, n bigint"), 12, 1)
    got = {(r["domain"], r["term"]): r["count"] for r in terms.collect()}
    assert got == {("a", "cat"): 6, ("a", "glass"): 5, ("b", "cat"): 3, ("b", "dog"): 9, ("c", "dog"): 1}
    lines = terms._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert sum("Filter" in line and "EndsWith(term" in line for line in lines) == 2


def test_token_totals_against_a_count(spark, monkeypatch):
    deal = random.Random(4)
    words = ["Éa", "b", "c_d", "É", "x1"]
    text = lambda: " ".join(deal.choice(words) for _ in range(deal.randrange(40)))
    rows = [(str(i % 90), text(), None if i % 5 == 0 else text()) for i in range(100)]  # ten ids come twice
    monkeypatch.setattr(I, "PIECE_CHARS", 300)
    want = {}
    for doc, *bodies in rows:
        for field, body in zip("pq", bodies):
            for pos, token in enumerate((body or "").replace("_", " ").lower().replace("é", "e").split()):
                n, docs, positions = want.setdefault((token, field), [0, set(), 0])
                want[token, field] = [n + 1, docs | {doc}, positions + pos]
    totals = I.token_totals(spark.createDataFrame(rows, "doc_id string, p string, q string"), ["p", "q"])
    assert {(r[0], r[1]): tuple(r[2:]) for r in totals.collect()} == {k: (n, len(d), s) for k, (n, d, s) in want.items()}
