"""Folders of URL lists."""

import datetime as dt

from itemloom.llm import urls


def test_folders_of_a_list_keep_their_case(spark):
    day = dt.date(2024, 1, 1)
    entries = spark.createDataFrame([("Example.COM/Docs", "block", day)], "pattern string, action string, day date")
    captures = spark.createDataFrame([(1, "https://EXAMPLE.com/Docs/a", day), (2, "https://example.com/docs/a", day)], "capture_id bigint, url string, fetched date")
    assert {r["capture_id"]: r["verdict"] for r in urls.judge(captures, entries).collect()} == {1: "block", 2: "none"}
