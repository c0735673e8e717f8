"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); the component is its smallest node.

    Each round first hangs the larger neighbours of a node under the smallest one, then does
    the same with the smaller neighbours; the smallest neighbour is a partial aggregate and a
    node with many links only shows up in the joins, whose sides Spark may split. The rounds
    end when the links no longer change, which takes about the logarithm of the longest path.
    Links to itself are ignored; no links give no rows.
    """
    smaller = F.least("a", "b")
    larger = F.greatest("a", "b")
    # every link is (a, b) with a > b from here on
    state = materialise(links.filter("a <> b").select(larger.alias("a"), smaller.alias("b")).distinct())
    before = None
    while True:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        wide = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        least = wide.groupBy("a").agg(F.min("b").alias("m"))
        small = wide.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        state = materialise(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    roots = state.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
