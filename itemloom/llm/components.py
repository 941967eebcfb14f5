"""Connected components of a graph given as links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm.shared import discard, materialised_alone, shuffles_removed


def components(links: DataFrame) -> DataFrame:
    """node and component, the smallest node reachable, of every node in ``links`` (a, b).

    Rounds alternate two steps (large star: a node's larger neighbours move to its smallest
    neighbour; small star: its smaller ones do), so paths shrink by about half a round and
    hubs lose their links.  Each round is a table in the shared folder, which cuts the
    lineage, and goes once the two after it are complete, its shuffle files at once; it ends when a round changes nothing.
    Work per round is in proportion to the links.
    """
    edges = links.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).filter("a <> b")
    edges = materialised_alone(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    before = None
    spent = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        down = large.select(F.col("b").alias("n"), F.col("a").alias("s"))
        lowest = down.groupBy("n").agg(F.min("s").alias("m"))
        small = (
            down.join(lowest, "n").select(F.col("m").alias("a"), F.col("s").alias("b")).filter("a <> b")
            .unionByName(lowest.select(F.col("m").alias("a"), F.col("n").alias("b"))).distinct()
        )
        last, edges = edges, materialised_alone(small, "links")
        if spent is not None:
            discard(spent)
        spent = last
        with shuffles_removed(links.sparkSession):
            state = edges.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    members = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return members.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
