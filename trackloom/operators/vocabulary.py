"""A vocabulary tree over descriptors, and the stored index that uses its words.

The tree is trained level by level: the descriptors of a node choose among its
children (an equi-join on the node, never a cross join), and the children move to the
mean of theirs. A descriptor's word is the leaf that it reaches by going down, with
the nearest ``beam`` nodes kept at each level.

nodes: level (from 1), parent, node, centre, n. The root is node 0; the children of
node k are k * branching + 1 and following.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.functions.geometry import sign_bits
from trackloom.operators import matching
from trackloom.operators.rounds import cut, drop
from trackloom.sources import snapshots

#: Bytes of a level's centres up to which they are broadcast; a larger level is joined by node.
LEVEL_BYTES = 32 << 20
#: Squared distance of a descriptor from the centre of child c.
SQUARED = "aggregate(zip_with(descriptor, c.centre, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v)"


#: Every descriptor begins at the root. A column, not a constant: so the first level is joined by key as the others are.
ROOT = "CAST(coalesce(size(descriptor) * 0, 0) AS LONG) AS node"


def _children(centres: DataFrame) -> DataFrame:
    """parent and the array of its children: as many as the tree branches."""
    return centres.groupBy("parent").agg(F.sort_array(F.collect_list(F.struct("node", "centre"))).alias("children"))


def _small(centres: DataFrame) -> bool:
    r = centres.agg(F.count("*").alias("n"), F.max(F.size("centre")).alias("size")).first()
    return r["n"] * (r["size"] or 0) * 8 <= LEVEL_BYTES


def _nearest(rows: DataFrame, centres: DataFrame, small: bool, beam: int = 1) -> DataFrame:
    """Rows with ``near``: the nearest children (d2, node) of their node, at most ``beam``."""
    children = _children(centres)
    joined = rows.join(F.broadcast(children) if small else children, rows["node"] == children["parent"]).drop("parent")
    scored = f"transform(children, c -> struct({SQUARED} AS d2, c.node AS node))"
    return joined.withColumn("near", F.expr(f"array({f'array_min({scored})'})" if beam == 1 else f"slice(array_sort({scored}), 1, {beam})")).drop("children")


def train_tree(descriptors: DataFrame, branching: int = 16, depth: int = 3, rounds: int = 5, seed: int = 0) -> DataFrame:
    """The nodes of a vocabulary tree by k-means of each node's descriptors; up to branching ** depth words.

    First centres are different descriptors of the node in an order drawn by ``seed``, so a tree depends on its
    descriptors and seed alone. Descriptors that are null or hold null count nowhere; no descriptors, no nodes."""
    rows = cut(descriptors.select("image_id", "idx", F.col("descriptor").cast("array<double>").alias("descriptor"), F.expr(ROOT)).filter(F.col("descriptor").isNotNull() & ~F.exists("descriptor", F.isnull)))
    size = rows.agg(F.max(F.size("descriptor"))).first()[0]
    mean = F.expr(f"array({', '.join(f'avg(descriptor[{k}])' for k in range(size or 0))})") if size else F.first("descriptor")
    found = None
    for level in range(1, depth + 1):
        drawn = Window.partitionBy("node").orderBy(F.xxhash64("descriptor", F.lit(seed + level)), "image_id", "idx")
        some = rows.withColumn("k", F.row_number().over(drawn)).filter(F.col("k") <= 4 * branching).groupBy("node", "descriptor").agg(F.min("k").alias("k"))
        own = Window.partitionBy("node").orderBy("k")
        first = some.withColumn("k", F.row_number().over(own)).filter(F.col("k") <= branching)
        centres = cut(first.select(F.col("node").alias("parent"), (F.col("node") * branching + F.col("k")).alias("node"), F.col("descriptor").alias("centre"), F.lit(0).cast("long").alias("n")))
        small = _small(centres)
        for _ in range(rounds):
            placed = _nearest(rows, centres, small).select(F.col("node").alias("parent"), F.col("near")[0]["node"].alias("node"), "descriptor")
            moved = cut(placed.groupBy("parent", "node").agg(mean.alias("centre"), F.count("*").alias("n")))
            drop(centres)
            centres = moved
        below = cut(_nearest(rows, centres, small).select("image_id", "idx", "descriptor", F.col("near")[0]["node"].alias("node")))
        drop(rows)
        rows = below
        level_nodes = centres.select(F.lit(level).alias("level"), "parent", "node", "centre", "n")
        found = level_nodes if found is None else found.unionByName(level_nodes)
    drop(rows)
    return cut(found)


def descend(descriptors: DataFrame, nodes: DataFrame, beam: int = 1) -> DataFrame:
    """image_id, idx, word_id and d2: the leaf that each descriptor reaches. With a wider beam the nearest leaf
    of those below the nearest ``beam`` nodes of each level. Columns beside these are kept."""
    kept = [c for c in descriptors.columns if c not in ("image_id", "idx", "descriptor")]
    rows = descriptors.select("image_id", "idx", *kept, F.col("descriptor").cast("array<double>").alias("descriptor"), F.expr(ROOT))
    depth = nodes.agg(F.max("level")).first()[0] or 0
    order = Window.partitionBy("image_id", "idx").orderBy("d2", "node")
    for level in range(1, depth + 1):
        centres = nodes.filter(F.col("level") == level).select("parent", "node", "centre")
        near = _nearest(rows, centres, _small(centres), beam).withColumn("near", F.explode("near")).select("image_id", "idx", *kept, "descriptor", "near.node", "near.d2")
        if beam > 1:
            near = near.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= (beam if level < depth else 1)).drop("_rank")
        rows = near
    return rows.select("image_id", "idx", *kept, F.col("node").alias("word_id"), "d2") if depth else rows.limit(0).select("image_id", "idx", *kept, F.col("node").alias("word_id"), F.lit(0.0).alias("d2"))


def postings(descriptors: DataFrame, nodes: DataFrame, beam: int = 1) -> DataFrame:
    """The inverted file of images: image_id, idx, word_id, sig."""
    return descend(descriptors.withColumn("sig", sign_bits(F.col("descriptor"))), nodes, beam).select("image_id", "idx", "word_id", "sig")


def _tables(nodes: DataFrame, entries: DataFrame) -> dict[str, DataFrame]:
    weights = matching.idf(entries)
    return {"nodes": nodes, "postings": entries, "weights": weights, "norms": matching.image_norms(entries, weights)}


def create_index(spark: SparkSession, folder: str, descriptors: DataFrame, nodes: DataFrame, beam: int = 1) -> str:
    """Write an index of images: tree, postings, word weights and image norms appear together, as one version."""
    return snapshots.commit(spark, folder, _tables(nodes, postings(descriptors, nodes, beam)))


def open_index(spark: SparkSession, folder: str, version: str | None = None, check: bool = False) -> dict[str, DataFrame]:
    return snapshots.load(spark, folder, version, check)


def extend_index(spark: SparkSession, folder: str, descriptors: DataFrame, beam: int = 1) -> str:
    """A new version with the images that the index lacks; weights and norms are those of all images."""
    index = open_index(spark, folder)
    new = descriptors.join(index["postings"].select("image_id").distinct(), "image_id", "left_anti")
    return snapshots.commit(spark, folder, _tables(index["nodes"], index["postings"].unionByName(postings(new, index["nodes"], beam))))


def remove_images(spark: SparkSession, folder: str, images: DataFrame) -> str:
    """A new version without some images (image_id)."""
    index = open_index(spark, folder)
    return snapshots.commit(spark, folder, _tables(index["nodes"], index["postings"].join(images.select("image_id"), "image_id", "left_anti")))


def query_index(index: dict[str, DataFrame], descriptors: DataFrame, top: int, beam: int = 1) -> DataFrame:
    """The images that score best for each image of descriptors: query_image, image_id, score, rank."""
    asked = postings(descriptors, index["nodes"], beam)
    return matching.top_images(matching.image_scores(asked, index["postings"], index["weights"], index["norms"], votes=True), top).drop("votes")
