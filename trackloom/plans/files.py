"""Queries of large binary files: written by parts, read back by blocks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trackloom.operators.rounds import shared_folder
from trackloom.plans.adapters import view
from trackloom.plans.base import query, rounded
from trackloom.sources import split_files


def _path(spark, name: str) -> str:
    return f"{shared_folder(spark)}/files/{uuid.uuid4().hex}/{name}"


@query("SELECT camera_id, model, width, height, f, cx, cy FROM cameras", "cameras")
def s13_split_cameras(spark, d):
    """Cameras as a binary file and back, a task for each block of it."""
    path = _path(spark, "cameras.bin")
    split_files.write(view(spark, d, "cameras").select("camera_id", "model", "width", "height", F.array("f", "f", "cx", "cy").alias("params")), path, "cameras")
    p = F.col("params")
    return split_files.read(spark, path, "cameras").select("camera_id", "model", "width", "height", p[0].alias("f"), p[2].alias("cx"), p[3].alias("cy"))


@query(
    """SELECT image_id, name, camera_id, round(qw, 6) AS qw, round(tx, 6) AS tx, count(point3d_id) AS observations, coalesce(sum(point3d_id), 0)::BIGINT AS point_ids, round(coalesce(sum(idx*1e0), 0), 6) AS xs
    FROM images LEFT JOIN tracks USING (image_id) GROUP BY ALL""",
    "images tracks",
)
def s13_split_images(spark, d):
    """Images with their observations as a binary file and back."""
    path = _path(spark, "images.bin")
    own = view(spark, d, "tracks").groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("idx", "point3d_id"))).alias("seen"))
    rows = view(spark, d, "images").join(own, "image_id", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<struct<idx:int,point3d_id:bigint>>")))
    number = F.transform("seen", lambda s: s["idx"].cast("double"))
    split_files.write(rows.select("image_id", F.array("qw", "qx", "qy", "qz").alias("qvec"), F.array("tx", "ty", "tz").alias("tvec"), "camera_id", "name", number.alias("xs"), number.alias("ys"), F.col("seen.point3d_id").alias("points")), path, "images")
    total = lambda column, kind: F.aggregate(column, F.lit(0).cast(kind), lambda a, x: a + x)
    return rounded(
        split_files.read(spark, path, "images").select(
            "image_id", "name", "camera_id", F.col("qvec")[0].alias("qw"), F.col("tvec")[0].alias("tx"), F.size("points").cast("long").alias("observations"), total("points", "long").alias("point_ids"), total("xs", "double").alias("xs"),
        )
    )


@query(
    """SELECT point3d_id, x, y, z, r, g, b, coalesce(error, -1e0) AS error, count(image_id) AS length, coalesce(sum(image_id), 0)::BIGINT AS image_ids, coalesce(sum(idx), 0)::BIGINT AS idxs
    FROM points3d LEFT JOIN tracks USING (point3d_id) GROUP BY ALL""",
    "points3d tracks",
)
def s13_split_points(spark, d):
    """Points with their tracks as a binary file and back."""
    path = _path(spark, "points3D.bin")
    own = view(spark, d, "tracks").groupBy("point3d_id").agg(F.sort_array(F.collect_list(F.struct("image_id", "idx"))).alias("track"))
    rows = view(spark, d, "points3d").join(own, "point3d_id", "left").withColumn("track", F.coalesce("track", F.array().cast("array<struct<image_id:bigint,idx:int>>")))
    split_files.write(rows.select("point3d_id", "x", "y", "z", "r", "g", "b", F.coalesce("error", F.lit(-1.0)).alias("error"), F.col("track.image_id").alias("images"), F.col("track.idx").alias("idxs")), path, "points")
    total = lambda column: F.aggregate(column, F.lit(0).cast("long"), lambda a, x: a + x)
    return split_files.read(spark, path, "points").select("point3d_id", "x", "y", "z", "r", "g", "b", "error", F.size("images").cast("long").alias("length"), total("images").alias("image_ids"), total("idxs").alias("idxs"))


#: Point clouds hold single-precision numbers.
CLOUD = ", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE)+0e0 AS {c}" for c in ("x", "y", "z", "nx"))


@query(f"SELECT {CLOUD}, count(*) AS points FROM lidar GROUP BY ALL", "lidar")
def s16_split_cloud(spark, d):
    """LiDAR points as a binary point cloud and back, counted by place."""
    path = _path(spark, "cloud.ply")
    zero = F.lit(0)
    split_files.write_cloud(view(spark, d, "lidar").select("lidar_id", "x", "y", "z", "nx", "ny", "nz", zero.alias("r"), zero.alias("g"), zero.alias("b")), path, "lidar_id")
    places = split_files.read(spark, path, "ply").select(*((F.col(c) + 0.0).alias(c) for c in ("x", "y", "z", "nx")))
    return places.groupBy("x", "y", "z", "nx").agg(F.count("*").alias("points"))


@query(
    """SELECT row_number() OVER (ORDER BY point3d_id)-1 AS row, unnest([0, 1, 2]) AS col, round(unnest([x, y, z]), 4)+0e0 AS value, 2*round(unnest([x, y, z]), 4)+0e0 AS twice FROM points3d""",
    "points3d",
)
def s36_split_map(spark, d):
    """A dense map with two planes, a row for each point, and back."""
    from trackloom.operators.ranks import numbered

    path = _path(spark, "points.map")
    p = numbered(view(spark, d, "points3d"), "point3d_id").select((F.col("_n") - 1).cast("int").alias("row"), F.posexplode(F.array("x", "y", "z")).alias("col", "v"))
    split_files.write_map(p.select("row", "col", F.array("v", F.col("v") * 2).alias("values")), path)
    v = F.col("values")
    return split_files.read(spark, path, "map").select(F.col("row").cast("long").alias("row"), "col", (F.round(v[0].cast("double"), 4) + 0.0).alias("value"), (2 * F.round(v[1].cast("double") / 2, 4) + 0.0).alias("twice"))
