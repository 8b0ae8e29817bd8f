"""Connected components of a distributed edge table (alternating large-star and small-star contraction)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.tables import clear, mark, with_hot, written


def _with_least(links: DataFrame) -> DataFrame:
    """Links (a, b) with m, the least b of each a. A minimum is a partial aggregate, and a hub's links meet it where they lie."""
    least = written(links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
    return with_hot(links, least, "a", least.agg(F.sum("n")).head()[0] or 0)


def _turned(links: DataFrame) -> DataFrame:
    return links.select(F.col("b").alias("a"), F.col("a").alias("b"))


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(a, b) links of any orderable type -> (node, component), the smallest node that is reachable.

    Nodes without a link are absent; nulls, self links and repeated links change nothing. Each round is two aggregations by node; every
    node keeps links to smaller nodes only, so no round holds more links than the first. A hub's neighbours are never gathered in
    one task: see ``with_hot``. Ends when a round changes nothing; needs O(log^2 n) rounds.
    """
    spark = edges.sparkSession
    before = mark()
    links = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    for _ in range(rounds):
        met = _with_least(links.unionByName(_turned(links))).withColumn("m", F.least("m", "a"))
        large = written(met.where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        met = _with_least(large)
        small = met.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(met.where("b = m").select("a", "b"))
        last = mark()
        new = written(small.where("a != b").distinct())
        clear(spark, before, last)
        links = new
        # a star forest: every node has one link, to a node that has none
        many = new.groupBy("a").count().where("count > 1").select("a").limit(1)
        deep = new.select("a").join(new.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1)
        if not many.unionByName(deep).head(1):
            break
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
