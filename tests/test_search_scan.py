"""Searches of the documents' own texts find what an index finds, and neither build one nor move what they find."""

import pytest
from pyspark.sql import functions as F

from itemloom.operators import search as X
from itemloom.operators import search_index as I
from itemloom.operators import search_scan as T
from itemloom.session import work_path

SF = "/root/testdata/sf0.001"
DOCS = [
    (1, "a b a b c", "b c\na b c d", "running cats"),
    (2, "b a b", "c a", "runs cat İx"),
    (3, "a b x c", "a", "ran a cat run cats connecting connection"),
    (4, "", "b-c a_b", "a b\nc"),
    (5, "", "", ""),
    (6, "Café b c d", "CAFE", "a b c a b c d"),
]
ASKED = ('"a b"', '"a b c"', '"b a b c"', "x_b-c", "a_b*", 'ca* "a b"', '"runs cats"', '"b c" a d', "a b c x", '"none such"', '"a a"', "c", "cafe", "caf* co*", '"a b c d"', "connected", "c* b", "*")


def _queries(spark, *raws):
    return spark.createDataFrame(list(enumerate(raws)), "query_id int, raw string")


@pytest.fixture(scope="module")
def both(spark):
    docs = spark.createDataFrame(DOCS, "doc_id int, prompt string, options string, explanation string")
    folders = [work_path(spark, "test-search") for _ in range(2)]
    I.write(docs, folders[0])
    T.store(docs, folders[1])
    return I.read(spark, folders[0]), T.read(spark, folders[1])


@pytest.mark.parametrize("stemmed", [False, True])
@pytest.mark.parametrize("piece", [1, 1 << 20])
def test_texts_are_searched_as_an_index_is(spark, both, monkeypatch, stemmed, piece):
    index, texts = both
    queries = _queries(spark, *ASKED)
    asked, met, scored = index.terms_and_parts(queries, stemmed)
    want = sorted((q, d, round(s, 9)) for q, d, s in I.ranked(asked, scored).collect())
    at = sorted((t, d, n, sorted(s)) for t, d, _, n, s in I.occurrences(index, met).collect())
    monkeypatch.setattr(T, "PIECE_CHARS", piece)
    asked, words, scored = texts.terms_and_parts(queries, stemmed)
    assert sorted((q, d, round(s, 9)) for q, d, s in I.ranked(asked, scored).collect()) == want and len(want) > 20
    assert sorted((t, d, n, list(s)) for t, d, n, s in texts.occurrences(words).collect()) == at


def test_prefixes_are_met_in_the_texts(spark, both):
    index, texts = both
    asked = I.asked_terms(_queries(spark, *ASKED))
    want = I.resolved(index, I.term_tokens(asked).where("is_prefix")).select("term", "token").distinct().collect()
    forms = I.term_tokens(asked).where("is_prefix").select("term", F.col("token").alias("form"))
    got = texts.started(T.lexicon(asked, of="is_prefix")).join(forms, "form").select("term", "token").collect()
    assert sorted(got) == sorted(want) and len(got) > 4


def test_no_terms_and_too_many(spark, both, monkeypatch):
    texts = both[1]
    asked, words, scored = texts.terms_and_parts(_queries(spark, "*", ""))
    assert I.ranked(asked, scored).count() == 0 and texts.occurrences(words).count() == 0
    monkeypatch.setattr(I, "SENT_ROWS", 2)
    assert T.lexicon(I.asked_terms(_queries(spark, "a b c"))) is None


def test_repeated_ids_need_an_index(spark):
    folder = work_path(spark, "test-search")
    T.store(spark.createDataFrame([DOCS[0], DOCS[0]], "doc_id int, prompt string, options string, explanation string"), folder)
    assert T.read(spark, folder) is None


def test_the_bar_loses_no_hit(spark, monkeypatch):
    monkeypatch.setattr(T, "FIRST_SHARE", 3)
    hits = spark.range(2_000).select((F.col("id") % 7).alias("query_id"), F.col("id").alias("doc_id"), (-(F.col("id") * 37 % 11)).cast("double").alias("score"))
    hits = hits.where("query_id < 6 OR doc_id < 20")
    got = sorted(map(tuple, T.top(hits, 10).collect()))
    assert got == sorted(map(tuple, X.top_hits(hits, 10).collect())) and len(got) > 60


def test_queries_build_no_index_and_move_no_rows_by_document(spark, monkeypatch):
    from __spark_entry__ import queries
    from itemloom.plans import searching

    monkeypatch.setattr(searching, "index_of", lambda bank: (_ for _ in ()).throw(AssertionError("an index was built")))
    for name in ("search_bm25", "search_matches", "search_phrase_occurrences", "search_bm25_stemmed"):
        found = queries()[name](spark, SF)
        assert found.count() > 0
        assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    for name in ("search_snippets", "search_prefix_expansion", "search_top_hits", "search_results_page"):
        assert queries()[name](spark, SF).count() > 0


def test_searches_run_where_the_package_is_not_installed(tmp_path):
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from itemloom.session import local_session
print("rows", entry.queries()["search_top_hits"](local_session(4, 4), {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 1778" in run.stdout, run.stderr[-2000:]
