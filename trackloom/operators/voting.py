"""Vote and verify: spatial verification of retrieved images.

Each match of two features proposes a similarity. Votes fall into bins of
translation, scale and angle, on grids that are halved level by level; the
transformations of the bins that score best are verified on all matches of the
image pair; the best one is refined to an affine transformation on its inliers,
which stays where it has more. What counts in the end is not the inliers, but the
cells of the image that they lie in.

matches: pair, idx1, x1, y1, s1, o1 (scale and orientation), idx2, x2, y2, s2, o2; a
feature may have several candidates, of which it takes the nearest. Features without a
scale over zero count nowhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import geometry as geo
from trackloom.operators import mapping, matching
from trackloom.operators.rounds import cut


@dataclass(frozen=True)
class Options:
    #: Largest translation; bins of translation, scale (up to a factor of ten either way) and angle; levels.
    reach: float = 2000.0
    trans_bins: int = 64
    scale_bins: int = 32
    angle_bins: int = 8
    levels: int = 6
    #: Transformations that are verified for each pair.
    top: int = 30
    #: Largest squared error of a match either way, and largest ratio of scales.
    error: float = 100.0**2
    scale_ratio: float = 2.0
    grid: int = 64


WAY = ("a11", "a12", "a21", "a22", "tx", "ty")


def votes(matches: DataFrame, o: Options) -> DataFrame:
    """The bins that matches vote for, with what they propose: pair, bx, by, bs, ba, scale, angle, tx, ty."""
    one, two = (tuple(F.col(f"{n}{k}") for n in "xyso") for k in (1, 2))
    names = ("scale", "angle", "tx", "ty")
    rows = matches.filter("s1 > 0 AND s2 > 0").select("pair", *(c.alias(n) for c, n in zip(geo.match_transform(one, two), names, strict=True)))
    rows = rows.withColumn("angle", F.atan2(F.sin("angle"), F.cos("angle"))).withColumn("log", F.log2("scale"))
    most = F.log2(F.lit(10.0))
    rows = rows.filter((F.abs("tx") <= o.reach) & (F.abs("ty") <= o.reach) & (F.abs("log") <= most))
    cell = lambda c, reach, bins: F.least(F.floor((c + reach) / (2 * reach) * bins), F.lit(bins - 1)).cast("int")
    trans = lambda c: cell(F.col(c), F.lit(o.reach), o.trans_bins)
    return rows.select("pair", trans("tx").alias("bx"), trans("ty").alias("by"), cell(F.col("log"), most, o.scale_bins).alias("bs"), cell(F.col("angle"), F.pi(), o.angle_bins).alias("ba"), *names)


def proposals(matches: DataFrame, o: Options) -> DataFrame:
    """The mean transformations of the best bins of each pair: pair, rank and the affine coefficients."""
    cast = cut(votes(matches, o))
    axes = ["bx", "by", "bs", "ba"]
    best = matching.hough_bins(cast.select(F.col("pair").alias("query_image"), F.lit(0).alias("image_id"), *axes), o.levels, o.top)
    means = cast.groupBy("pair", *axes).agg(*(F.avg(c).alias(c) for c in ("scale", "angle", "tx", "ty")))
    c, s = F.col("scale") * F.cos("angle"), F.col("scale") * F.sin("angle")
    return means.join(best.select(F.col("query_image").alias("pair"), *axes, "rank"), ["pair", *axes]).select("pair", "rank", *(v.alias(n) for v, n in zip((c, -s, s, c, F.col("tx"), F.col("ty")), WAY, strict=True)))


def _inside(o: Options) -> Column:
    """Whether a match agrees with a transformation both ways, and in scale."""
    a, b, c, d, tx, ty = (F.col(n) for n in WAY)
    det = a * d - b * c
    x1, y1, x2, y2 = (F.col(n) for n in ("x1", "y1", "x2", "y2"))
    there = F.pow(a * x1 + b * y1 + tx - x2, 2) + F.pow(c * x1 + d * y1 + ty - y2, 2)
    u, v = x2 - tx, y2 - ty
    safe = F.when(F.abs(det) > 1e-12, det)
    back = F.pow((d * u - b * v) / safe - x1, 2) + F.pow((a * v - c * u) / safe - y1, 2)
    ratio = F.col("s2") / F.col("s1") / F.sqrt(F.abs(safe))
    return F.coalesce((there <= o.error) & (back <= o.error) & (ratio <= o.scale_ratio) & (ratio >= 1 / o.scale_ratio), F.lit(False)), there


def inliers(matches: DataFrame, ways: DataFrame, o: Options) -> DataFrame:
    """Matches that agree with transformations (pair, rank, coefficients): the nearest candidate of each feature."""
    good, error = _inside(o)
    rows = matches.join(ways, "pair").filter(good).withColumn("error", error)
    nearest = Window.partitionBy("pair", "rank", "idx1").orderBy("error", "idx2")
    return rows.withColumn("_n", F.row_number().over(nearest)).filter("_n = 1").drop("_n")


def refined(found: DataFrame) -> DataFrame:
    """The affine transformation of least squares of each pair's inliers, from their covariances. Inliers on a
    line have none."""
    sums = found.groupBy("pair", "rank").agg(*(F.avg(c).alias(f"m{c}") for c in ("x1", "y1", "x2", "y2")), F.var_pop("x1").alias("xx"), F.var_pop("y1").alias("yy"), F.covar_pop("x1", "y1").alias("xy"), *(F.covar_pop(a, b).alias(f"{a}{b}") for a in ("x1", "y1") for b in ("x2", "y2")))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    rows = sums.withColumn("det", det).filter("det > 1e-9 * greatest(xx * yy, 1e-30)")
    solve = lambda b: (F.expr(f"(x1{b} * yy - y1{b} * xy) / det"), F.expr(f"(y1{b} * xx - x1{b} * xy) / det"))
    (a, b), (c, d) = solve("x2"), solve("y2")
    rows = rows.select("pair", "rank", *(v.alias(n) for v, n in zip((a, b, c, d), WAY, strict=False)), "mx1", "my1", "mx2", "my2")
    return rows.select("pair", "rank", *WAY[:4], F.expr("mx2 - a11 * mx1 - a12 * my1").alias("tx"), F.expr("my2 - a21 * mx1 - a22 * my1").alias("ty"))


def verified(matches: DataFrame, options: Options = Options()) -> DataFrame:
    """pair, inliers, cells (effective inliers), and the transformation a11..ty that most matches agree with. Pairs of
    fewer than three agreeing matches are left out."""
    matches = cut(matches.filter("s1 > 0 AND s2 > 0"))
    ways = cut(proposals(matches, options))
    counts = inliers(matches, ways, options).groupBy("pair", "rank").agg(F.count("*").alias("n"))
    first = Window.partitionBy("pair").orderBy(F.desc("n"), "rank")
    best = counts.withColumn("_n", F.row_number().over(first)).filter("_n = 1 AND n >= 3").select("pair", "rank")
    similar = cut(ways.join(best, ["pair", "rank"]).withColumn("rank", F.lit(0)))
    affine = refined(inliers(matches, similar, options)).withColumn("rank", F.lit(1))
    both = similar.select("pair", "rank", *WAY).unionByName(affine.select("pair", "rank", *WAY))
    found = cut(inliers(matches, both, options))
    totals = found.groupBy("pair", "rank").agg(F.count("*").alias("inliers"), F.sum("error").alias("rest"))
    # The refined one stays where it has more inliers, or as many with less error.
    order = Window.partitionBy("pair").orderBy(F.desc("inliers"), "rest", "rank")
    winner = totals.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("pair", "rank", "inliers")
    cells = mapping.cell_count(found.join(winner, ["pair", "rank"]).select(F.col("pair").alias("grp"), F.col("x1").alias("u"), F.col("y1").alias("v")), options.grid)
    return winner.join(both, ["pair", "rank"]).join(cells.withColumnRenamed("grp", "pair"), "pair").select("pair", "inliers", "cells", *WAY)


def reranked(scores: DataFrame, checked: DataFrame) -> DataFrame:
    """Retrieval scores (query_image, image_id, score) with the effective inliers (cells) of verified pairs of the
    same columns added: verified images come first."""
    both = scores.join(checked.select("query_image", "image_id", "cells"), ["query_image", "image_id"], "left").na.fill(0, ["cells"])
    return both.withColumn("score", F.col("score") + F.col("cells"))
