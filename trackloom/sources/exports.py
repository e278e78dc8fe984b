"""Exports of a model to other programs' text formats, as lines for ``write.text``.

Every writer gives a DataFrame of (part, at, value): parts follow each other, and
within a part lines go by ``at``. Numbers have a fixed number of decimals, so that
lines are the same on every cluster.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geometry import center, rotation

NUMBER = "%.6f"


def _printed(value: Column) -> Column:
    """What Java has to format so that six decimals are those of C's printf (for values under 4e9).

    Java rounds the shortest decimal text of a number, C the number itself; they part where that text ends in a
    tie, which Java always rounds up. There the product with 1e6, which is exact for both halves of the number,
    tells on which side of the tie it is; a true tie goes to the even digit."""
    size = F.abs(value)
    low = F.floor(size * 1e6).cast("double")
    big = size * 134217729.0 - (size * 134217729.0 - size)
    over = (big * 1e6 - (low + 0.5)) + (size - big) * 1e6
    down = (size < 4e9) & (size == (low + 0.5) / 1e6) & ((over < 0) | ((over == 0) & (low % 2 == 0)))
    return F.when(down, F.signum(value) * (low + 0.25) / 1e6).otherwise(value)


def _format(pattern: str, *columns) -> Column:
    cells = [F.col(c) if isinstance(c, str) else c for c in columns]
    cells = [_printed(c) if kind == "f" else c for kind, c in zip(re.findall("%([a-z])", pattern), cells, strict=True)]
    return F.format_string(pattern.replace("%f", NUMBER), *cells)


def _line(df: DataFrame, part: int, at, value) -> DataFrame:
    return df.select(F.lit(part).alias("part"), F.lit(at).cast("long").alias("at") if isinstance(at, int) else at.cast("long").alias("at"), value.alias("value"))


def _posed(images: DataFrame, cameras: DataFrame) -> DataFrame:
    """Registered images with their camera, renumbered from 0 by id."""
    rows = images.filter("registered").join(F.broadcast(cameras.select("camera_id", "f", "cx", "cy", "width", "height")), "camera_id")
    return rows.withColumn("place", F.row_number().over(Window.orderBy("image_id")) - 1)


def _pose(names: str) -> tuple:
    return tuple(F.col(n) for n in names.split())


def _elements(tracks: DataFrame, posed: DataFrame, value) -> DataFrame:
    """The track of each point as one string: an element for each image, in the order of places."""
    rows = tracks.join(posed.select("image_id", "place", "cx", "cy"), "image_id")
    first = rows.groupBy("point3d_id", "place").agg(F.min(F.struct("idx", "u", "v", "cx", "cy")).alias("e")).select("point3d_id", "place", "e.*")
    return first.groupBy("point3d_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", value.alias("s")))), lambda e: e["s"]), " ").alias("track"), F.count("*").alias("size"))


def nvm(images: DataFrame, cameras: DataFrame, points: DataFrame, tracks: DataFrame) -> DataFrame:
    """NVM_V3: images with focal length, rotation and centre; points with one observation an image.
    tracks: point3d_id, image_id, idx, u, v."""
    posed = _posed(images, cameras)
    c = center(_pose("qw qx qy qz"), _pose("tx ty tz"))
    heads = posed.agg(F.count("*").alias("n"))
    lines = _line(heads, 0, 0, F.lit("NVM_V3")).union(_line(heads, 0, 1, F.lit(""))).union(_line(heads, 0, 2, F.col("n").cast("string")))
    lines = lines.union(_line(posed, 1, F.col("place"), _format("%s %f %f %f %f %f %f %f %f 0 0", "name", "f", "qw", "qx", "qy", "qz", *c)))
    lines = lines.union(_line(points.agg(F.count("*").alias("n")), 2, 0, F.col("n").cast("string")))
    own = _elements(tracks, posed, _format("%d %d %f %f", "place", "idx", "u", "v"))
    rows = points.join(own, "point3d_id", "left")
    value = F.rtrim(F.concat(_format("%f %f %f %d %d %d %d ", "x", "y", "z", "r", "g", "b", F.coalesce("size", F.lit(0).cast("long"))), F.coalesce("track", F.lit(""))))
    return lines.union(_line(rows, 3, F.col("point3d_id"), value))


def cam(images: DataFrame, cameras: DataFrame) -> DataFrame:
    """One two-line file for each image: pose, then normalised intrinsics. at is the image."""
    posed = _posed(images, cameras)
    r = [x for row in rotation(_pose("qw qx qy qz")) for x in row]
    focal = F.col("f") / F.greatest("width", "height")
    one = _line(posed, 0, F.col("image_id"), _format(" ".join(["%f"] * 12), "tx", "ty", "tz", *r))
    return one.union(_line(posed, 1, F.col("image_id"), _format("%f 0 0 1 %f %f", focal, F.col("cx") / F.col("width"), F.col("cy") / F.col("height"))))


def bundler(images: DataFrame, cameras: DataFrame, points: DataFrame, tracks: DataFrame) -> DataFrame:
    """Bundler's version 0.3: y and z turned round, pixels from the principal point upwards."""
    posed = _posed(images, cameras)
    r = rotation(_pose("qw qx qy qz"))
    counts = posed.agg(F.count("*").alias("n")).join(points.agg(F.count("*").alias("m")))
    lines = _line(counts, 0, 0, F.lit("# Bundle file v0.3")).union(_line(counts, 0, 1, _format("%d %d", "n", "m")))
    five = [_format("%f 0 0", "f"), _format("%f %f %f", *r[0]), _format("%f %f %f", *(-x for x in r[1])), _format("%f %f %f", *(-x for x in r[2])), _format("%f %f %f", F.col("tx"), -F.col("ty"), -F.col("tz"))]
    for k, value in enumerate(five):
        lines = lines.union(_line(posed, 1, F.col("place") * 5 + k, value))
    own = _elements(tracks, posed, _format("%d %d %f %f", F.col("place"), F.col("idx"), F.col("u") - F.col("cx"), F.col("cy") - F.col("v")))
    rows = points.join(own, "point3d_id", "left")
    three = [_format("%f %f %f", "x", "y", "z"), _format("%d %d %d", "r", "g", "b"), F.rtrim(F.concat(_format("%d ", F.coalesce("size", F.lit(0).cast("long"))), F.coalesce("track", F.lit(""))))]
    for k, value in enumerate(three):
        lines = lines.union(_line(rows, 2, F.col("point3d_id") * 3 + k, value))
    return lines


def ply(points: DataFrame) -> DataFrame:
    """An ASCII point cloud with colours."""
    n = points.agg(F.count("*").alias("n"))
    head = ["ply", "format ascii 1.0", None, *(f"property float {c}" for c in "xyz"), *(f"property uchar {c}" for c in ("red", "green", "blue")), "end_header"]
    lines = None
    for k, text in enumerate(head):
        part = _line(n, 0, k, F.concat(F.lit("element vertex "), F.col("n")) if text is None else F.lit(text))
        lines = part if lines is None else lines.union(part)
    return lines.union(_line(points, 1, F.col("point3d_id"), _format("%f %f %f %d %d %d", "x", "y", "z", "r", "g", "b")))


def model_header(kind: str, rows: DataFrame, mean: str | None = None) -> DataFrame:
    """The comment lines over a text file of cameras, images or points. rows: n, and the mean it states."""
    fields = {
        "cameras": ("# Camera list with one line of data per camera:", "#   CAMERA_ID, MODEL, WIDTH, HEIGHT, PARAMS[]"),
        "points": ("# 3D point list with one line of data per point:", "#   POINT3D_ID, X, Y, Z, R, G, B, ERROR, TRACK[] as (IMAGE_ID, POINT2D_IDX)"),
    }
    label = {"cameras": "cameras", "points": "points"}[kind]
    last = F.concat(F.lit(f"# Number of {label}: "), F.col("n"))
    if mean:
        last = F.concat(last, F.lit(", mean track length: "), _format("%f", mean))
    one = rows.limit(1)
    return _line(one, 0, 0, F.lit(fields[kind][0])).union(_line(one, 0, 1, F.lit(fields[kind][1]))).union(_line(one, 0, 2, last))


def comparison_csv(errors: DataFrame) -> DataFrame:
    """Pose errors of two models (image_id, rotation, translation, center) with two comment lines."""
    one = errors.sparkSession.createDataFrame([(0, "# Model comparison pose errors: one entry per common image"), (1, "# <rotation error (deg)>, <translation error>, <proj center error>")], "at long, value string")
    return _line(one, 0, F.col("at"), F.col("value")).union(_line(errors, 1, F.col("image_id"), F.format_string("%.12f, %.12f, %.12f", "rotation", "translation", "center")))


def bounding_box(box: DataFrame) -> DataFrame:
    """The aligned box (lo and hi by axis) as two lines of three numbers."""
    return _line(box, 0, 0, _format("%f %f %f", "lox", "loy", "loz")).union(_line(box, 0, 1, _format("%f %f %f", "hix", "hiy", "hiz")))


def sift_lines(features: DataFrame, size: int) -> DataFrame:
    """SIFT text of each image: a header with the count, then x y scale orientation and the descriptor. (image_id, at, value)"""
    head = features.groupBy("image_id").agg(F.concat(F.count("*"), F.lit(f" {size}")).alias("value")).select("image_id", F.lit(-1).alias("at"), "value")
    body = features.select("image_id", F.col("idx").alias("at"), F.concat(_format("%f %f %f %f ", "x", "y", "scale", "orientation"), F.array_join(F.transform("descriptor", lambda v: v.cast("string")), " ")).alias("value"))
    return head.union(body)


def read_sift(lines: DataFrame, size: int) -> DataFrame:
    """Features of SIFT text (image_id, at, value): the affine shape comes from scale and orientation.
    The header tells how many rows count; rows beyond it are left out."""
    w = F.split(F.trim("value"), r"\s+")
    heads = lines.filter("at < 0").select("image_id", w[0].cast("long").alias("n"), w[1].cast("int").alias("size")).filter(F.col("size") == size)
    rows = lines.filter("at >= 0").join(heads, "image_id").filter("at < n")
    num = lambda i: w[i].cast("double")
    c, s = num(2) * F.cos(num(3)), num(2) * F.sin(num(3))
    return rows.select("image_id", F.col("at").cast("int").alias("idx"), num(0).alias("x"), num(1).alias("y"), c.alias("a11"), (-s).alias("a12"), s.alias("a21"), c.alias("a22"), F.slice(w, 5, size).cast("array<int>").alias("descriptor"))
