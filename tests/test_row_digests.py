"""Digests of files by their rows."""

from pyspark.sql import functions as F

from itemloom.sources import shards


def test_digests_by_rows_see_every_row_and_the_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "FANOUT", 3)

    def digest(name, values):
        spark.createDataFrame([(v, None) for v in values], "v int, w string").coalesce(1).write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
        return shards.row_digests(rows, F.col("_metadata.file_path")).collect()[0]["sha256"]

    same, changed, moved = list(range(25)), [*range(24), 99], [1, 0, *range(2, 25)]
    assert digest("a", same) == digest("b", same)
    assert len({digest("c", same), digest("d", changed), digest("e", moved)}) == 3
