"""The faster forms of text functions give what the plain ones gave."""

import random

from pyspark.sql import functions as F

from itemloom.functions import text as tx


def _texts(n=3_000):
    deal = random.Random(5)
    pieces = list("*\\ \t\n\x1c\x1f\xa0 aZé_9`[]()") + ["  ", "**", " *", "* ", "\\*", " \n", "https://x"]
    return ["".join(deal.choice(pieces) for _ in range(deal.randrange(25))) for _ in range(n)]


def test_faster_forms_agree_with_the_plain_ones(spark):
    table = spark.createDataFrame([(t,) for t in _texts()], "t string").repartition(8)
    star = r"(?U)(?<![\w\\])\*([^*]+?)(?<!\\)\*(?!\w)"
    got = table.select(
        "t",
        F.regexp_replace("t", star, "$1").alias("stars"),
        F.regexp_replace("t", r"(?U)\*(?<![\w\\]\*)([^*]++)(?<!\\)\*(?!\w)", "$1").alias("fast_stars"),
        F.translate("t", "*[]()`\\", "").alias("translated"),
        tx.replaced(F.col("t"), "*[]()`\\").alias("replaced"),
        tx.replaced(F.col("t"), "*[", "x").alias("partly"),
        F.translate("t", "*[", "x").alias("plain_partly"),
    )
    assert got.where("stars <> fast_stars OR translated <> replaced OR partly <> plain_partly").collect() == []
    assert got.where("stars <> t").count() > 20


def test_the_markdown_of_a_document_is_made_once(spark):
    from __spark_entry__ import queries

    plan = queries()["stripped_markdown"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("https://e.org/") == 1
