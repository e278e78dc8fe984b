"""Structure journal, merge deltas and model comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.ranks import numbered


def read_since(journal: DataFrame, cursors: DataFrame, cap: int) -> DataFrame:
    """For each cursor: whether a gap forces a rebuild, and how many batches follow it.

    The journal keeps its last ``cap`` revisions. Revisions are gapless, so counts
    follow from its newest and oldest one.
    """
    ends = journal.agg(F.max("revision").alias("newest"))
    oldest = F.greatest(F.lit(1), F.col("newest") - cap + 1)
    rows = cursors.join(F.broadcast(ends))
    gap = (F.col("cursor") == 0) | (F.col("cursor") > F.col("newest")) | (F.col("cursor") + 1 < oldest)
    return rows.select("cursor", gap.alias("gap"), F.when(gap, 0).otherwise(F.col("newest") - F.col("cursor")).alias("batches"))


def merge_delta(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Upserts over a base (key, value): changed rows step their generation; a null value is a tombstone."""
    new = delta.select(key, F.col("value").alias("new"), F.lit(True).alias("touched"))
    old = base.select(key, F.col("value").alias("old"), F.lit(True).alias("had"))
    rows = old.join(new, key, "full")
    dead = F.col("touched") & F.col("new").isNull()
    generation = F.when(F.col("had").isNull() | F.col("touched").isNull(), 0).otherwise(1)
    return rows.filter(~F.coalesce(dead, F.lit(False))).select(key, F.coalesce("new", "old").alias("value"), generation.alias("generation"))


def compare_points(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distance of points with the same id in two models, null where one lacks it."""
    other = b.select("point3d_id", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"))
    d = F.sqrt((F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by")) ** 2 + (F.col("z") - F.col("bz")) ** 2)
    return a.select("point3d_id", "x", "y", "z").join(other, "point3d_id", "full").select("point3d_id", d.alias("distance"))


def publish(changes: DataFrame, cap: int) -> DataFrame:
    """Revisions of a journal: the changes of one batch are one revision, aborted batches are none, and
    only the last ``cap`` revisions are kept.

    changes: at (order), batch, aborted, suppressed (nested changes that a composite one stands for), kind, entity."""
    batches = changes.groupBy("batch").agg(F.min("at").alias("at"), F.bool_or("aborted").alias("gone")).filter("NOT gone")
    revisions = batches.withColumn("revision", F.row_number().over(Window.orderBy("at")))
    newest = revisions.agg(F.max("revision").alias("newest"))
    kept = revisions.join(F.broadcast(newest)).filter(F.col("revision") > F.col("newest") - cap)
    return changes.filter("NOT suppressed").join(kept.select("batch", "revision"), "batch").select("revision", "kind", "entity")


def active_solve(images: DataFrame, observations: DataFrame, fixed: DataFrame) -> DataFrame:
    """Residuals of a solve: observations in registered images, numbered from 0 by point and image, with
    whether their pose and point may move. observations: point3d_id, image_id, idx; fixed: image_id."""
    seen = observations.join(images.filter("registered").select("image_id"), "image_id", "left_semi")
    lengths = seen.groupBy("point3d_id").agg(F.count("*").alias("n"))
    rows = seen.join(fixed.select("image_id", F.lit(True).alias("held")), "image_id", "left").join(lengths, "point3d_id")
    ready = rows.select("point3d_id", "image_id", "idx", F.col("held").isNull().alias("pose_moves"), (F.col("n") >= 2).alias("point_moves"))
    return numbered(ready, "point3d_id", "image_id", "idx").withColumn("residual", F.col("_n") - 1).drop("_n")
