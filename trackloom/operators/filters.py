"""Model filters: every one returns the points, observations or images with what becomes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geometry import bogus_camera, ray_angle, squared_error
from trackloom.operators.stats import co_observations


def reprojection_filter(points2d: DataFrame, most: float) -> DataFrame:
    """Observations off by more than ``most`` pixels go; a point left with fewer
    than two goes whole. points2d: u, v and the projection pu, pv with depth."""
    e2 = squared_error((F.col("u"), F.col("v")), (F.col("pu"), F.col("pv")), F.col("depth"))
    scored = points2d.select("point3d_id", e2.alias("e2"))
    sums = scored.groupBy("point3d_id").agg(
        F.count("*").alias("len"), F.count_if(F.col("e2") > most * most).alias("bad"), F.sum(F.when(F.col("e2") <= most * most, F.sqrt("e2"))).alias("err")
    )
    dropped = (F.col("len") < 2) | (F.col("bad") >= F.col("len") - 1)
    kept = F.when(dropped, 0).otherwise(F.col("len") - F.col("bad"))
    return sums.select(
        "point3d_id", kept.alias("kept_len"), F.when(dropped, F.col("len")).otherwise(F.col("bad")).alias("deleted"), dropped.alias("dropped"),
        F.when(~dropped, F.col("err") / F.nullif(F.col("len") - F.col("bad"), F.lit(0))).alias("error"),
    )


def angle_filter(observed: DataFrame, least_degrees: float) -> DataFrame:
    """Largest ray angle of each point; points below the least, or seen once, go."""
    both = co_observations(observed, "ox", "oy", "oz", "x", "y", "z")
    angle = ray_angle(tuple(F.col(c) for c in ("ox1", "oy1", "oz1")), tuple(F.col(c) for c in ("ox2", "oy2", "oz2")), tuple(F.col(c) for c in ("x1", "y1", "z1")))
    best = both.groupBy("point3d_id").agg(F.max(F.degrees(angle)).alias("max_angle"))
    every = observed.select("point3d_id").distinct().join(best, "point3d_id", "left")
    return every.select("point3d_id", F.coalesce("max_angle", F.lit(0.0)).alias("max_angle"), (F.coalesce("max_angle", F.lit(-1.0)) >= least_degrees).alias("keep"))


def behind_camera(observed: DataFrame) -> DataFrame:
    return observed.filter(F.col("depth") < 2.220446049250313e-16).select("image_id", "idx")


def image_filter(images: DataFrame, cameras: DataFrame, tracks: DataFrame, low: float, high: float) -> DataFrame:
    """Registered images that go, with the reason: no points, or a bogus camera."""
    seen = tracks.select("image_id").distinct().withColumn("seen", F.lit(True))
    bad = cameras.select("camera_id", bogus_camera(*(F.col(c) for c in ("f", "cx", "cy", "width", "height")), low, high).alias("bogus"))
    rows = images.filter("registered").join(seen, "image_id", "left").join(bad, "camera_id")
    reason = F.when(F.col("seen").isNull(), "no_points").when(F.col("bogus"), "bogus_camera")
    return rows.select("image_id", reason.alias("reason")).filter("reason IS NOT NULL")


def crop(points: DataFrame, tracks: DataFrame, low: tuple, high: tuple) -> DataFrame:
    """Points in a box (bounds included) and how many images see each."""
    inside = points.filter(F.col("x").between(low[0], high[0]) & F.col("y").between(low[1], high[1]) & F.col("z").between(low[2], high[2])).select("point3d_id")
    return inside.join(tracks, "point3d_id", "left").groupBy("point3d_id").agg(F.count("image_id").alias("images"))


def delete_observations(tracks: DataFrame, gone: DataFrame) -> DataFrame:
    """Tracks without some observations; a point that keeps fewer than two goes."""
    kept = tracks.join(gone.select("image_id", "idx"), ["image_id", "idx"], "left_anti")
    enough = kept.groupBy("point3d_id").count().filter("count >= 2").select("point3d_id")
    untouched = tracks.join(gone.select("image_id", "idx"), ["image_id", "idx"], "left_semi").select("point3d_id").distinct()
    return kept.join(untouched, "point3d_id", "left_anti").unionByName(kept.join(untouched, "point3d_id", "left_semi").join(enough, "point3d_id", "left_semi"))


def deregister(tracks: DataFrame, images: DataFrame) -> DataFrame:
    gone = tracks.join(images.select("image_id"), "image_id", "left_semi")
    return delete_observations(tracks, gone)


def route_by_length(lengths: DataFrame, least: int, kdtree_only: bool = False) -> DataFrame:
    route = F.lit("KDTREE") if kdtree_only else F.when(F.col("track_length") < least + 3, "PROJECTION").otherwise("KDTREE")
    return lengths.withColumn("route", route)


def lidar_outliers(associations: DataFrame, points: DataFrame, projection: float = 10.0, icp: float = 2.0) -> DataFrame:
    """Associations that stay: the point is there and near enough for the kind of match."""
    found = associations.join(points.select("point3d_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz")), "point3d_id")
    d = F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2 + (F.col("z") - F.col("pz")) ** 2)
    return found.filter(d <= F.when(F.col("type") == "Proj", projection).otherwise(icp)).drop("px", "py", "pz")


def combined_filter(observed: DataFrame, most: float, least_degrees: float) -> DataFrame:
    """Reprojection, then the angle of what is left, then depth: the observations that stay.

    observed: point3d_id, image_id, e2 (squared error), depth, the camera centre (ox, oy, oz) and the point (x, y, z)."""
    near = observed.filter(F.col("e2") <= most * most)
    enough = near.groupBy("point3d_id").count().filter("count >= 2").select("point3d_id")
    kept = near.join(enough, "point3d_id", "left_semi")
    wide = angle_filter(kept, least_degrees).filter("keep").select("point3d_id")
    return kept.join(wide, "point3d_id", "left_semi").filter(F.col("depth") >= 2.220446049250313e-16)


def seen_in(observed: DataFrame, images: DataFrame) -> DataFrame:
    """All observations of the points that some of the images see."""
    points = observed.join(images.select("image_id"), "image_id", "left_semi").select("point3d_id").distinct()
    return observed.join(points, "point3d_id", "left_semi")


def enough_inliers(pairs: DataFrame, least: int) -> DataFrame:
    """Pairs with too few inliers are kept as empty markers."""
    return pairs.withColumn("n_rows", F.when(F.col("n_rows") < least, 0).otherwise(F.col("n_rows")))


def consistent_pixels(pairs: DataFrame, depth_error: float, pixel_error: float, cosine: float) -> DataFrame:
    """Pixel pairs whose depths, places and normals agree. pairs: depth1, depth2, e2, cosine."""
    near = F.abs(F.col("depth1") - F.col("depth2")) <= depth_error * F.col("depth1")
    return pairs.filter(near & (F.col("e2") <= pixel_error * pixel_error) & (F.col("cosine") >= cosine))
