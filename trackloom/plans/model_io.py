"""Queries of tables and files: lookups, transactions, imports and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import geometry as geo
from trackloom.operators import pairs, stats, tables
from trackloom.plans.adapters import view
from trackloom.plans.base import cols, query, rounded
from trackloom.sources import exports, model_text

# -- rows and tables ----------------------------------------------------------


@query("SELECT n_name AS name, EXISTS (SELECT 1 FROM images WHERE images.name = n_name) AS known FROM nation UNION ALL SELECT s_name, TRUE FROM supplier", "images")
def d02_exists_name(spark, d):
    asked = view(spark, d, "nation").select(F.col("n_name").alias("name")).union(view(spark, d, "supplier").select("s_name"))
    return tables.flagged(asked, view(spark, d, "images"), "name")


@query("SELECT image_id, name, camera_id FROM images WHERE name = 'Supplier#000000007' UNION ALL SELECT image_id, name, camera_id FROM images WHERE image_id = 5", "images")
def d03_read_one(spark, d):
    """One image by its name, and one by its id."""
    im = view(spark, d, "images").select("image_id", "name", "camera_id")
    return tables.where_equal(im, "name", "Supplier#000000007").union(tables.where_equal(im, "image_id", 5))


@query("SELECT (SELECT image_id FROM images WHERE name = 'Supplier#000000009') AS found, (SELECT image_id FROM images WHERE name = 'nobody') AS missing", "images")
def j23_image_by_name(spark, d):
    """The id of a name, null where no image has it."""
    im = view(spark, d, "images")
    one = lambda name, alias: tables.where_equal(im, "name", name).agg(F.max("image_id").alias(alias))
    return one("Supplier#000000009", "found").join(one("nobody", "missing"))


@query("SELECT src*2147483647+dst AS pair_id, min(src_idx) AS idx1, min(dst_idx) AS idx2, count(*) AS n FROM edges WHERE src < dst GROUP BY src, dst UNION ALL SELECT CAST(2147483647 AS BIGINT)*1000001+1000002, 5, 7, 1", "edges")
def d10_insert_matches(spark, d):
    """Matches of a reversed pair are appended the right way round; a pair that is there is not written twice."""
    e = view(spark, d, "edges").filter("src < dst")
    have = e.select(F.col("src").alias("image_id1"), F.col("dst").alias("image_id2"), F.col("src_idx").alias("idx1"), F.col("dst_idx").alias("idx2"))
    again = have.select(F.col("image_id2").alias("image_id1"), F.col("image_id1").alias("image_id2"), F.col("idx2").alias("idx1"), F.col("idx1").alias("idx2"))
    new = spark.createDataFrame([(1000002, 1000001, 7, 5)], "image_id1 long, image_id2 long, idx1 int, idx2 int")
    out = tables.append_matches(have, again.unionByName(new))
    return out.groupBy(geo.pair_id(*cols("image_id1", "image_id2")).alias("pair_id")).agg(F.min("idx1").alias("idx1"), F.min("idx2").alias("idx2"), F.count("*").alias("n"))


@query("SELECT 'images' AS name, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'keypoints', 0 UNION ALL SELECT 'cameras', count(*) FROM cameras", "cameras")
def d13_clear_images(spark, d):
    """Clearing the images takes their keypoints along and leaves the cameras."""
    kept = tables.clear({"images": view(spark, d, "images"), "keypoints": view(spark, d, "tracks"), "cameras": view(spark, d, "cameras")}, "images")
    out = None
    for name, table in kept.items():
        part = table.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = part if out is None else out.union(part)
    return out


@query("SELECT image_id, name, camera_id, NULL::DOUBLE AS prior_x FROM images UNION ALL SELECT image_id+1000000, name, camera_id, tx FROM images WHERE image_id % 10 = 0", "images")
def d16_migrate(spark, d):
    """An old table takes the present schema: columns it lacks are null."""
    im = view(spark, d, "images")
    old = im.select("image_id", "name", "camera_id")
    new = im.filter("image_id % 10 = 0").select((F.col("image_id") + 1000000).alias("image_id"), "name", "camera_id", F.col("tx").alias("prior_x"))
    return tables.migrated(old, new.schema).unionByName(new)


@query(
    """WITH s AS (SELECT image_id, camera_id, row_number() OVER (ORDER BY image_id) AS k FROM images WHERE image_id % 4 = 1)
    SELECT i.image_id, CASE WHEN s.k IS NULL THEN i.camera_id ELSE (SELECT max(camera_id) FROM cameras)+s.k END AS camera_id, c.f FROM images AS i JOIN cameras AS c ON i.camera_id = c.camera_id LEFT JOIN s ON s.image_id = i.image_id""",
    "images cameras",
)
def d17_split_cameras(spark, d):
    """Every selected image gets a camera of its own, a copy of the one it had."""
    images, cameras = tables.split_cameras(view(spark, d, "images").select("image_id", "camera_id"), view(spark, d, "cameras"), F.col("image_id") % 4 == 1)
    return images.join(cameras.select("camera_id", "f"), "camera_id").select("image_id", "camera_id", "f")


@query("SELECT image_id, i.camera_id, name, f, cx FROM images AS i JOIN cameras AS c ON i.camera_id = c.camera_id", "images cameras")
def j12_image_cameras(spark, d):
    return tables.with_cameras(view(spark, d, "images"), view(spark, d, "cameras")).select("image_id", "camera_id", "name", "f", "cx")


@query("SELECT 'x' AS axis, min(x) AS lo, max(x) AS hi, round(avg(x), 6) AS centroid FROM p UNION ALL SELECT 'y', min(y), max(y), round(avg(y), 6) FROM p UNION ALL SELECT 'z', min(z), max(z), round(avg(z), 6) FROM p".replace("FROM p", "FROM (SELECT CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, CAST(CAST(y AS FLOAT) AS DOUBLE) AS y, CAST(CAST(z AS FLOAT) AS DOUBLE) AS z FROM points3d) AS p"), "points3d")
def g07_bounding_box(spark, d):
    return rounded(stats.trimmed_bounds(view(spark, d, "points3d"), 0.0, 1.0))


@query(
    """SELECT 'cameras' AS entity, count(*) AS n FROM cameras UNION ALL SELECT 'images', count(*) FROM images UNION ALL SELECT 'keypoints', count(*) FROM tracks UNION ALL SELECT 'descriptors', count(*) FROM descriptors
    UNION ALL SELECT 'most_keypoints', max(n) FROM (SELECT count(*) AS n FROM tracks GROUP BY image_id) AS t UNION ALL SELECT 'verified_pairs', count(*) FROM pairs WHERE n_rows > 0""",
    "cameras images tracks descriptors pairs",
)
def g30_totals(spark, d):
    """The counts that an overview shows."""
    t = view(spark, d, "tracks")
    most = t.groupBy("image_id").count().agg(F.lit("most_keypoints").alias("entity"), F.coalesce(F.max("count"), F.lit(0)).alias("n"))
    one = lambda table, name: table.agg(F.lit(name).alias("entity"), F.count("*").alias("n"))
    out = most
    for name, table in (("cameras", "cameras"), ("images", "images"), ("descriptors", "descriptors")):
        out = out.union(one(view(spark, d, table), name))
    return out.union(one(t, "keypoints")).union(one(tables.with_rows(view(spark, d, "pairs")), "verified_pairs"))


# -- files ---------------------------------------------------------------------


@query("SELECT image_id, round(qw, 6) AS qw, round(tx, 6)+0e0 AS tx, name, (SELECT count(*) FROM tracks AS t WHERE t.image_id = images.image_id) AS points FROM images", "images tracks")
def s11_images_text(spark, d):
    """Images written as text and read back with their points."""
    im = view(spark, d, "images")
    p = view(spark, d, "points2d").select("image_id", "idx", F.coalesce("u", F.lit(0.0)).alias("x"), F.coalesce("v", F.lit(0.0)).alias("y"), "point3d_id")
    lines = model_text.image_lines(im, p)
    images, points = model_text.read_images(lines.filter("value <> '' OR part = 0").withColumn("value", F.when(F.col("value") == "", "-").otherwise(F.col("value"))).select(F.struct("image_id", "part").alias("at"), "value"), "at")
    counts = points.groupBy("image_id").agg(F.count("*").alias("points"))
    return images.join(counts, "image_id", "left").select("image_id", F.round("qw", 6).alias("qw"), (F.round("tx", 6) + 0.0).alias("tx"), "name", F.coalesce("points", F.lit(0).cast("long")).alias("points"))


@query("SELECT 0 AS part, 0 AS at, '# 3D point list with one line of data per point:' AS value UNION ALL SELECT 0, 1, '#   POINT3D_ID, X, Y, Z, R, G, B, ERROR, TRACK[] as (IMAGE_ID, POINT2D_IDX)' UNION ALL SELECT 0, 2, '# Number of points: ' || (SELECT count(*) FROM points3d) || ', mean track length: ' || printf('%.6f', (SELECT count(*) FROM tracks)/(SELECT count(*) FROM points3d))", "points3d tracks")
def s14_text_headers(spark, d):
    n = view(spark, d, "points3d").agg(F.count("*").alias("n")).join(view(spark, d, "tracks").agg(F.count("*").alias("t")))
    return exports.model_header("points", n.withColumn("mean", F.col("t") / F.col("n")), "mean")


@query(
    """SELECT 0 AS part, CAST(k AS BIGINT) AS at, value FROM (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9]) AS k, unnest(['ply', 'format ascii 1.0', 'element vertex ' || (SELECT count(*) FROM points3d), 'property float x', 'property float y', 'property float z',
    'property uchar red', 'property uchar green', 'property uchar blue', 'end_header']) AS value) AS h UNION ALL SELECT 1, point3d_id, printf('%.6f %.6f %.6f %d %d %d', x, y, z, r, g, b) FROM points3d""",
    "points3d",
)
def s20_export_ply(spark, d):
    return exports.ply(view(spark, d, "points3d"))


POSED_SQL = """WITH i AS (SELECT image_id, name, f, cx, cy, qw, qx, qy, qz, tx, ty, tz, row_number() OVER (ORDER BY image_id)-1 AS place FROM images AS i JOIN cameras AS c ON i.camera_id = c.camera_id WHERE registered),
    e AS (SELECT p.point3d_id, place, idx, coalesce(u, 0) AS u, coalesce(v, 0) AS v, i.cx, i.cy FROM points2d AS p JOIN i ON p.image_id = i.image_id)"""


def _pixels(spark, d):
    return view(spark, d, "points2d").select("point3d_id", "image_id", "idx", F.coalesce("u", F.lit(0.0)).alias("u"), F.coalesce("v", F.lit(0.0)).alias("v"))


def _model(spark, d):
    return view(spark, d, "images"), view(spark, d, "cameras"), view(spark, d, "points3d"), _pixels(spark, d)


@query(
    POSED_SQL
    + """, t AS (SELECT point3d_id, count(*) AS n, string_agg(printf('%d %d %.6f %.6f', place, idx, u, v), ' ' ORDER BY place) AS s FROM e GROUP BY point3d_id)
    SELECT 0 AS part, 0 AS at, 'NVM_V3' AS value UNION ALL SELECT 0, 1, '' UNION ALL SELECT 0, 2, CAST(count(*) AS VARCHAR) FROM i
    UNION ALL SELECT 1, place, printf('%s %.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f 0 0', name, f, qw, qx, qy, qz, -((1-2*(qy*qy+qz*qz))*tx+2*(qx*qy+qw*qz)*ty+2*(qx*qz-qw*qy)*tz), -(2*(qx*qy-qw*qz)*tx+(1-2*(qx*qx+qz*qz))*ty+2*(qy*qz+qw*qx)*tz), -(2*(qx*qz+qw*qy)*tx+2*(qy*qz-qw*qx)*ty+(1-2*(qx*qx+qy*qy))*tz)) FROM i
    UNION ALL SELECT 2, 0, CAST(count(*) AS VARCHAR) FROM points3d
    UNION ALL SELECT 3, p.point3d_id, rtrim(printf('%.6f %.6f %.6f %d %d %d %d ', x, y, z, r, g, b, coalesce(n, 0)) || coalesce(s, '')) FROM points3d AS p LEFT JOIN t ON p.point3d_id = t.point3d_id""",
    "images cameras points2d points3d",
)
def s21_export_nvm(spark, d):
    return exports.nvm(*_model(spark, d))


@query(
    POSED_SQL
    + """ SELECT 0 AS part, image_id AS at, printf('%.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f', tx, ty, tz, 1-2*(qy*qy+qz*qz), 2*(qx*qy-qw*qz), 2*(qx*qz+qw*qy), 2*(qx*qy+qw*qz), 1-2*(qx*qx+qz*qz), 2*(qy*qz-qw*qx), 2*(qx*qz-qw*qy), 2*(qy*qz+qw*qx), 1-2*(qx*qx+qy*qy)) AS value FROM i
    UNION ALL SELECT 1, image_id, printf('%.6f 0 0 1 %.6f %.6f', f/1000, cx/1000, cy/800) FROM i""",
    "images cameras points2d",
)
def s22_export_cam(spark, d):
    return exports.cam(view(spark, d, "images"), view(spark, d, "cameras"))


@query(
    POSED_SQL
    + """, t AS (SELECT point3d_id, count(*) AS n, string_agg(printf('%d %d %.6f %.6f', place, idx, u-cx, cy-v), ' ' ORDER BY place) AS s FROM e GROUP BY point3d_id)
    SELECT 0 AS part, 0 AS at, '# Bundle file v0.3' AS value UNION ALL SELECT 0, 1, (SELECT count(*) FROM i) || ' ' || (SELECT count(*) FROM points3d)
    UNION ALL SELECT 1, 5*place, printf('%.6f 0 0', f) FROM i UNION ALL SELECT 1, 5*place+1, printf('%.6f %.6f %.6f', 1-2*(qy*qy+qz*qz), 2*(qx*qy-qw*qz), 2*(qx*qz+qw*qy)) FROM i
    UNION ALL SELECT 1, 5*place+2, printf('%.6f %.6f %.6f', -(2*(qx*qy+qw*qz)), -(1-2*(qx*qx+qz*qz)), -(2*(qy*qz-qw*qx))) FROM i UNION ALL SELECT 1, 5*place+3, printf('%.6f %.6f %.6f', -(2*(qx*qz-qw*qy)), -(2*(qy*qz+qw*qx)), -(1-2*(qx*qx+qy*qy))) FROM i
    UNION ALL SELECT 1, 5*place+4, printf('%.6f %.6f %.6f', tx, -ty, -tz) FROM i
    UNION ALL SELECT 2, 3*point3d_id, printf('%.6f %.6f %.6f', x, y, z) FROM points3d UNION ALL SELECT 2, 3*point3d_id+1, printf('%d %d %d', r, g, b) FROM points3d
    UNION ALL SELECT 2, 3*p.point3d_id+2, rtrim(printf('%d ', coalesce(n, 0)) || coalesce(s, '')) FROM points3d AS p LEFT JOIN t ON p.point3d_id = t.point3d_id""",
    "images cameras points2d points3d",
)
def s24_export_bundler(spark, d):
    return exports.bundler(*_model(spark, d))


@query(
    """SELECT d.image_id, idx, round(idx*25e-2, 6) AS x, round((1+idx%3)*cos(idx*1e-1), 5)+0e0 AS a11, round(-(1+idx%3)*sin(idx*1e-1), 5)+0e0 AS a12, list_sum(list_transform(descriptor, lambda v: CAST(round(v*1000) AS BIGINT))) AS total FROM descriptors AS d""",
    "descriptors",
)
def s28_sift_text(spark, d):
    """SIFT text written and read back, image by image."""
    x = view(spark, d, "descriptors")
    features = x.select("image_id", "idx", (F.col("idx") * 0.25).alias("x"), F.lit(0.5).alias("y"), (1 + F.col("idx") % 3).cast("double").alias("scale"), (F.col("idx") * 0.1).alias("orientation"), F.transform("descriptor", lambda v: F.round(v * F.lit(1000).cast("float")).cast("int")).alias("descriptor"))
    back = exports.read_sift(exports.sift_lines(features, 64), 64)
    total = F.aggregate(F.transform("descriptor", lambda v: v.cast("long")), F.lit(0).cast("long"), lambda a, v: a + v)
    return back.select("image_id", "idx", F.round("x", 6).alias("x"), (F.round("a11", 5) + 0.0).alias("a11"), (F.round("a12", 5) + 0.0).alias("a12"), total.alias("total"))


@query("SELECT name, round(tx, 6)+0e0 AS x, round(ty, 6)+0e0 AS y, round(tz, 6)+0e0 AS z FROM images WHERE image_id % 3 <> 0", "images")
def s33_reference_locations(spark, d):
    """``name x y z`` lines, and of the images with a prior."""
    im = view(spark, d, "images")
    lines = im.filter("image_id % 3 = 1").select(F.format_string("%s %.6f  %.6f %.6f", "name", "tx", "ty", "tz").alias("value"))
    priors = im.select("name", *(F.when(F.col("image_id") % 3 == 2, F.col(c)).alias(c) for c in ("tx", "ty", "tz")))
    found = pairs.located_names(lines).union(pairs.with_prior(priors))
    return found.select("name", *((F.round(c, 6) + 0.0).alias(c) for c in "xyz"))


@query(
    """SELECT 0 AS part, 0 AS at, '# Model comparison pose errors: one entry per common image' AS value UNION ALL SELECT 0, 1, '# <rotation error (deg)>, <translation error>, <proj center error>'
    UNION ALL SELECT 1, image_id, printf('%.12f, %.12f, %.12f', CAST(image_id % 7 AS DOUBLE), CAST(image_id % 5 AS DOUBLE), CAST(image_id % 3 AS DOUBLE)) FROM images""",
    "images",
)
def s42_comparison_csv(spark, d):
    im = view(spark, d, "images")
    rest = lambda k, name: (F.col("image_id") % k).cast("double").alias(name)
    return exports.comparison_csv(im.select("image_id", rest(7, "rotation"), rest(5, "translation"), rest(3, "center")))


@query("SELECT 0 AS part, 0 AS at, printf('%.6f %.6f %.6f', min(x), min(y), min(z)) AS value FROM points3d UNION ALL SELECT 0, 1, printf('%.6f %.6f %.6f', max(x), max(y), max(z)) FROM points3d", "points3d")
def s43_box_file(spark, d):
    box = view(spark, d, "points3d").agg(*(f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))))
    return exports.bounding_box(box)
