"""Connected components by alternating stars, as joins and aggregations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.operators.storage import materialise


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of longs to (u, root): each node with the least node that it reaches.

    Each round hangs the larger neighbours of a node on the least one (large star), then the
    smaller ones (small star), and is written before the next begins. A hub is one hot key of a
    join with one row per node, which adaptive execution splits. Nodes without an edge to another
    node are not returned. Rounds grow with the logarithm of the longest chain.
    """
    now = materialise(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges"
    )
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_least(both), "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        large = materialise(large, "large-star")
        small = large.join(_least(large), "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        heads = _least(large).select("u", F.col("m").alias("v"))
        now = materialise(small.unionByName(heads).where("u != v").distinct(), "small-star")
        marks = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if marks == state:
            return now.withColumnRenamed("v", "root")
        state = marks
