"""Tokens of an index come from code points, a piece at a time, without an object a token."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from itemloom.functions import text as tx
from itemloom.operators import search as X
from itemloom.operators import search_index as I

FOLDING = str.maketrans(*tx.folding())
BODIES = [
    ["Prompt_caching, cuts COST!", "", "Café ÉTÉ"],
    ["", "", ""],
    ["a", "x² Ⅰ \U0001f600b\U00010400 中文 ١", "line\nend "],
    ["İstanbul", "ὈΣ ΟΣ'Α", "_"],
]


def _schema():
    return to_arrow_schema(T._parse_datatype_string(I._DOCUMENT.format("bigint")))


@pytest.mark.parametrize("rows", [BODIES[:3], BODIES, BODIES[1:2], []])
def test_tokens_are_those_of_the_matches(spark, rows):
    batch = pa.record_batch([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["doc_id", "bodies"])
    got = [r for part in I._document_rows(_schema(), FOLDING, [batch]) for r in part.to_pylist()]
    want = [[I._spans(body, FOLDING) for body in row] for row in rows]
    for k, name in enumerate(("tokens", "starts", "ends")):
        assert [r[name] for r in got] == [[part[k] for part in row] for row in want]
    assert [r["doc_len"] for r in got] == [sum(len(part[0]) for part in row) for row in want]


def test_a_piece_makes_no_object_a_token(spark):
    batch = pa.record_batch([pa.array([1], pa.int64()), pa.array([["a b c d " * 500_000, "", ""]])], names=["doc_id", "bodies"])
    tracemalloc.start()
    (out,) = I._document_rows(_schema(), FOLDING, [batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.column("doc_len").to_pylist() == [2_000_000]
    assert peak < 150_000_000


def test_a_reindex_moves_documents_not_tokens(spark):
    from __spark_entry__ import queries

    plan = queries()["search_reindex"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "posexplode" not in plan


def test_a_reindexed_table_is_that_of_the_edited_documents(spark):
    fields = tuple(X.FIELD_WEIGHTS)
    table = lambda rows: spark.createDataFrame(rows, "doc_id int, prompt string, options string, explanation string")
    docs = table([(1, "one two", "b", ""), (2, "three", "", "c"), (3, "gone", "gone", "gone"), (4, "", "", "")])
    edited = table([(1, "one two", "b", ""), (2, "four four", "x", None), (4, "", "", "")])
    touched = spark.createDataFrame([(2,), (3,)], "question_id int")
    keep = ["doc_id", "doc_len", "tokens"]
    got = I.reindexed(I.indexed_documents(docs, fields).select(*keep), edited, touched, fields)
    assert sorted(got.collect()) == sorted(I.indexed_documents(edited, fields).select(*keep).collect())
    posted = I.document_postings(got, len(fields)).groupBy("doc_id").agg(F.sum(F.size("places")).alias("n"))
    assert {r["doc_id"]: r["n"] for r in posted.collect()} == {1: 3, 2: 3}
