"""Connected components by alternating large-star and small-star rounds.

Edges are (a, b) pairs of longs. Minima are aggregated before they are joined
back; where a hub has ``HUB`` neighbours or more, the join is salted by the
neighbour, so no node is a group in one task. Each round is written to the shared
folder and the one before it deleted; nothing but counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import forget, stored

MAX_ROUNDS = 60
HUB, SALTS = 256, 16


def _star(edges: DataFrame, large: bool, salted: bool) -> DataFrame:
    """Link every neighbour (larger ones, or smaller ones and the node) to the least neighbour."""
    if large:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
    else:
        both = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    least = both.groupBy("node").agg(F.min("other").alias("least"))
    if salted:
        salt = F.pmod(F.xxhash64("other"), F.lit(SALTS)).cast("int")
        least = least.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        linked = both.withColumn("salt", salt).join(least, ["node", "salt"]).drop("salt")
    else:
        linked = both.join(least, "node")
    linked = linked.withColumn("root", F.least("node", "least"))
    if large:
        made = linked.filter("other > node").select(F.col("other").alias("a"), F.col("root").alias("b"))
    else:
        made = linked.select(F.col("other").alias("a"), F.col("root").alias("b")).union(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return made.filter("a <> b").distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for every other node with an edge."""
    current = stored(spark, edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "edges")
    state = None
    for _ in range(MAX_ROUNDS):
        ends = current.select("a").union(current.select("b")).groupBy("a").count()
        salted = (ends.agg(F.max("count")).first()[0] or 0) >= HUB
        before, current = current, stored(spark, _star(_star(current, True, salted), False, salted), "stars")
        forget(spark, before)
        # Settled when the edges are stars around least nodes and stay the same.
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
