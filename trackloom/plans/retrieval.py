"""Queries of retrieval by trained words: vocabulary trees, stored indexes, vote and verify."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trackloom.operators import vocabulary, voting
from trackloom.operators.rounds import shared_folder
from trackloom.plans.adapters import view
from trackloom.plans.base import query


def _described(spark, d):
    return view(spark, d, "descriptors").select("image_id", "idx", "descriptor")


@query("SELECT count(*) AS descriptors, TRUE AS nearest FROM descriptors", "descriptors")
def r01_tree(spark, d):
    """A tree trained over all descriptors: each descriptor's leaf is the nearest child of the node above it."""
    x = _described(spark, d)
    nodes = vocabulary.train_tree(x, branching=4, depth=3, rounds=2)
    found = vocabulary.descend(x.withColumn("own", F.col("descriptor").cast("array<double>")), nodes)
    leaf = nodes.filter("level = 3")
    other = found.join(leaf.select(F.col("node").alias("word_id"), "parent"), "word_id").join(leaf.select("parent", "centre"), "parent")
    d2 = F.aggregate(F.zip_with("own", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    least = other.groupBy("image_id", "idx").agg(F.min(d2).alias("least"), F.first("d2").alias("d2"))
    return least.agg(F.count("*").alias("descriptors"), F.bool_and(F.abs(F.col("least") - F.col("d2")) < 1e-9).alias("nearest"))


@query("SELECT DISTINCT image_id AS query_image, image_id, 1 AS rank FROM descriptors", "descriptors")
def r03_tree_retrieval(spark, d):
    """By words of a trained tree, each image is the first to be retrieved for itself."""
    x = _described(spark, d)
    nodes = vocabulary.train_tree(x, branching=4, depth=3, rounds=2)
    tables = vocabulary._tables(nodes, vocabulary.postings(x, nodes))
    return vocabulary.query_index(tables, x, 1).select("query_image", "image_id", "rank")


@query("SELECT image_id, count(*) AS postings, image_id % 5 <> 0 AS first FROM descriptors WHERE image_id % 5 <> 0 GROUP BY image_id", "descriptors")
def s35_stored_index(spark, d):
    """An index of some images is written, opened with a check, extended by the others, and loses some."""
    x = _described(spark, d)
    folder = f"{shared_folder(spark)}/indexes/{uuid.uuid4().hex}"
    some = x.filter("image_id % 2 = 0")
    vocabulary.create_index(spark, folder, some, vocabulary.train_tree(some, branching=4, depth=2, rounds=2))
    vocabulary.extend_index(spark, folder, x)
    vocabulary.remove_images(spark, folder, x.filter("image_id % 5 = 0").select("image_id").distinct())
    index = vocabulary.open_index(spark, folder, check=True)
    best = vocabulary.query_index(index, x.filter("image_id % 5 <> 0"), 1).select(F.col("query_image").alias("image_id"), (F.col("image_id") == F.col("query_image")).alias("first"))
    return index["postings"].groupBy("image_id").agg(F.count("*").alias("postings")).join(best, "image_id")


PLANTED_SQL = """WITH m AS (SELECT a.image_id AS pair, a.point3d_id AS p, (a.point3d_id*7+a.image_id) % 4 = 0 AS off FROM tracks AS a JOIN tracks AS b ON a.point3d_id = b.point3d_id AND b.image_id = a.image_id+1),
    g AS (SELECT pair, CAST(p*37 % 901 AS DOUBLE) AS u, CAST(p*53 % 701 AS DOUBLE) AS v FROM m WHERE NOT off), b AS (SELECT pair, min(u) AS lu, max(u) AS hu, min(v) AS lv, max(v) AS hv, count(*) AS n FROM g GROUP BY pair HAVING count(*) >= 10),
    c AS (SELECT g.pair, any_value(n) AS inliers, count(DISTINCT least(63, CAST(floor((u-lu)*64/greatest(hu-lu, 1e-9)) AS INT))*1000+least(63, CAST(floor((v-lv)*64/greatest(hv-lv, 1e-9)) AS INT))) AS cells FROM g JOIN b ON g.pair = b.pair GROUP BY g.pair)
    SELECT pair, inliers, cells, round((1+pair%3/4e0)*cos(pair%6/1e1), 4)+0e0 AS a11, round((1+pair%3/4e0)*sin(pair%6/1e1), 4)+0e0 AS a21, round(20e0*(pair%4), 2)+0e0 AS tx, round(-15e0*(pair%5), 2)+0e0 AS ty FROM c"""


@query(PLANTED_SQL, "tracks")
def r12_vote_and_verify(spark, d):
    """A similarity that is planted between the features of following images, of which a quarter is off, is voted for, verified and refined."""
    t = view(spark, d, "tracks").select("image_id", "point3d_id")
    both = t.join(t.select((F.col("image_id") - 1).alias("image_id"), "point3d_id"), ["image_id", "point3d_id"]).select(F.col("image_id").alias("pair"), F.col("point3d_id").alias("p"))
    off = (F.col("p") * 7 + F.col("pair")) % 4 == 0
    scale, angle = 1 + F.col("pair") % 3 / 4, F.col("pair") % 6 / 10
    one = both.select("pair", "p", off.alias("off"), (F.col("p") * 37 % 901).cast("double").alias("x1"), (F.col("p") * 53 % 701).cast("double").alias("y1"), (1.0 + F.col("p") % 3).alias("s1"), (F.col("p") % 5 / 10).alias("o1"), scale.alias("k"), angle.alias("w"))
    bad = F.when(F.col("off"), 150.0 + F.col("p") * 11 % 13 * 40).otherwise(0.0)
    x2 = F.col("k") * (F.cos("w") * F.col("x1") - F.sin("w") * F.col("y1")) + 20.0 * (F.col("pair") % 4) + bad
    y2 = F.col("k") * (F.sin("w") * F.col("x1") + F.cos("w") * F.col("y1")) - 15.0 * (F.col("pair") % 5) - bad
    rows = one.select("pair", F.col("p").alias("idx1"), "x1", "y1", "s1", "o1", F.col("p").alias("idx2"), x2.alias("x2"), y2.alias("y2"), (F.col("s1") * F.col("k")).alias("s2"), (F.col("o1") + F.col("w")).alias("o2"), "off")
    enough = rows.groupBy("pair").agg(F.count_if(~F.col("off")).alias("good")).filter("good >= 10").select("pair")
    found = voting.verified(rows.drop("off"), voting.Options(error=25.0)).join(enough, "pair")
    return found.select("pair", "inliers", "cells", *((F.round(c, k) + 0.0).alias(c) for c, k in (("a11", 4), ("a21", 4), ("tx", 2), ("ty", 2))))
