"""Queries of the scalar families."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import geometry as geo
from trackloom.functions import libm
from trackloom.functions import scalars as sc
from trackloom.plans.adapters import view
from trackloom.plans.base import cols, query, round_to, rounded


@query(
    """SELECT event_type, round(median(value), 6) AS median, round(list_sort(list(value))[CAST(round(0.3e0*(count(*)-1)) AS INT)+1], 6) AS p30, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS variance,
    round(stddev_samp(value), 6) AS stddev, bool_or(value < 1) AS any_low, list_sort(list(value))[CAST(floor(0.9e0*count(*)) AS INT)+1] AS p90 FROM events GROUP BY event_type"""
)
def f05_statistics(spark, d):
    v = F.col("value")
    out = view(spark, d, "events").groupBy("event_type").agg(
        F.median("value").alias("median"), F.round(sc.nearest_rank(F.collect_list("value"), 30), 6).alias("p30"), F.avg("value").alias("mean"), F.round(F.var_samp("value"), 4).alias("variance"),
        F.stddev_samp("value").alias("stddev"), F.bool_or(v < 1).alias("any_low"), sc.at_fraction(F.collect_list("value"), 0.9).alias("p90"),
    )
    return rounded(out)


@query("SELECT n, CASE WHEN n < 3 THEN 0 ELSE CAST(round(n*(n-1)*(n-2)/6) AS BIGINT) END AS choose3, CAST(greatest(0, least(255, n*9-40)) AS INT) AS byte FROM range(40) AS r(n)")
def f09_combinations(spark, d):
    n = F.col("id")
    return spark.range(40).select(n.alias("n"), F.when(n < 3, 0).otherwise(sc.choose(n, 3)).alias("choose3"), sc.saturating_cast(n * 9 - 40, "uint8").cast("int").alias("byte"))


@query(
    """SELECT doc_id, source, len(regexp_split_to_array(source, '[0-9]+')) AS parts, CASE WHEN contains(source, 'c1') THEN list_last(string_split(source, 'c1')) ELSE '' END AS tail,
    lower(lang) = lang AS low, '/data/' || lang AS parent, source || '.txt' AS base, '.txt' AS ext FROM documents"""
)
def f23_paths(spark, d):
    path = F.concat(F.lit("/data/"), F.col("lang"), F.lit("/"), F.col("source"), F.lit(".txt"))
    parent, base, ext = sc.file_parts(path)
    return view(spark, d, "documents").select(
        "doc_id", "source", F.size(sc.split_any(F.col("source"), "0123456789")).alias("parts"), sc.text_after(F.col("source"), "c1").alias("tail"),
        (F.lower("lang") == F.col("lang")).alias("low"), parent.alias("parent"), base.alias("base"), ext.alias("ext"),
    )


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 3 END AS n, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE round(p_retailprice, 6) END AS first FROM part"""
)
def f28_csv(spark, d):
    text = F.concat(F.col("p_retailprice").cast("string"), F.lit(" ; "), F.col("p_size").cast("string"), F.lit(",, "), F.when(F.col("p_partkey") % 3 == 0, "bad").otherwise("1e3"))
    numbers = sc.csv_to_doubles(text)
    return rounded(view(spark, d, "part").select("p_partkey", F.size(numbers).alias("n"), F.get(numbers, F.lit(0)).alias("first")))


@query(
    """SELECT a.image_id, round(a.qw*b.qw+a.qz*b.qz, 6)+0e0 AS qw, round(b.qz*a.qw-b.qw*a.qz, 6)+0e0 AS qz,
    round(b.tx-((1-2*power(b.qz*a.qw-b.qw*a.qz, 2))*a.tx-2*(a.qw*b.qw+a.qz*b.qz)*(b.qz*a.qw-b.qw*a.qz)*a.ty), 6)+0e0 AS tx, round(b.tz-a.tz, 6)+0e0 AS tz FROM images AS a JOIN images AS b ON b.image_id = a.image_id+1""",
    "images",
)
def f46_relative_pose(spark, d):
    im = view(spark, d, "images")
    pose = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")
    a = im.select("image_id", *(F.col(c).alias(f"a{c}") for c in pose))
    b = im.select((F.col("image_id") - 1).alias("image_id"), *(F.col(c).alias(f"b{c}") for c in pose))
    q, t = geo.relative_pose(cols("aqw", "aqx", "aqy", "aqz"), cols("atx", "aty", "atz"), cols("bqw", "bqx", "bqy", "bqz"), cols("btx", "bty", "btz"))
    values = {"qw": q[0], "qz": q[3], "tx": t[0], "tz": t[2]}
    return a.join(b, "image_id").select("image_id", *((F.round(v, 6) + 0.0).alias(n) for n, v in values.items()))


@query(
    """SELECT image_id, round(qw*qw+qx*qx-qy*qy-qz*qz, 6)+0e0 AS r00, round(2*(qx*qy-qw*qz), 6)+0e0 AS r01, round(2*(qx*qy+qw*qz), 6)+0e0 AS r10, round(1-2*(qx*qx+qz*qz), 6)+0e0 AS r11, round(1-2*(qx*qx+qy*qy), 6)+0e0 AS r22 FROM images""",
    "images",
)
def f42_rotation(spark, d):
    r = geo.rotation(geo.normalized(cols("qw", "qx", "qy", "qz")))
    cells = {"r00": r[0][0], "r01": r[0][1], "r10": r[1][0], "r11": r[1][1], "r22": r[2][2]}
    return view(spark, d, "images").select("image_id", *((F.round(v, 6) + 0.0).alias(n) for n, v in cells.items()))


@query("SELECT point3d_id, image_id, CASE WHEN depth < 2.220446049250313e-16 THEN 1.7976931348623157e308 ELSE round(power(px-1, 2)+power(py+2, 2), 6) END AS e2 FROM observed", "observed")
def f49_squared_error(spark, d):
    """Its sines, cosines and squares are the C library's, as the SQL's are: no last bit decides a rounding otherwise."""
    turn = (F.col("image_id") - 1) * 0.05
    images = view(spark, d, "images").withColumns({"qw": libm.cos(turn), "qz": libm.sin(turn)})
    e2 = geo.squared_error(cols("px", "py"), (F.lit(1.0), F.lit(-2.0)), F.col("depth"), libm.square)
    return view(spark, d, "observed", images=images).select("point3d_id", "image_id", round_to(e2).alias("e2"))


@query("SELECT point3d_id, round(x/10+x/10*(0.1e0*(x*x+y*y)/100+0.01e0*power((x*x+y*y)/100, 2))+2*0.001e0*x*y/100+0.002e0*((x*x+y*y)/100+2*x*x/100), 6) AS u FROM points3d", "points3d")
def f56_distortion(spark, d):
    u, _ = geo.opencv_distorted(F.col("x") / 10, F.col("y") / 10, 0.1, 0.01, 0.001, 0.002)
    return rounded(view(spark, d, "points3d").select("point3d_id", u.alias("u")))


@query("SELECT point3d_id, round(2*(x*0.6e0-y*0.8e0)+1, 6)+0e0 AS x, round(2*(x*0.8e0+y*0.6e0)-3, 6)+0e0 AS y, round(2*z+5, 6) AS z FROM points3d", "points3d")
def f61_similarity(spark, d):
    """A similarity transform of scale 2, a rotation about z and a translation."""
    moved = geo.Similarity(2.0, (0.8**0.5, 0.0, 0.0, 0.2**0.5), (1.0, -3.0, 5.0)).point(cols("x", "y", "z"))
    return view(spark, d, "points3d").select("point3d_id", *((F.round(v, 6) + 0.0).alias(n) for n, v in zip("xyz", moved, strict=True)))


@query("SELECT lidar_id, round(-(nx*x+ny*y+nz*z), 6)+0e0 AS d, round(sqrt(x*x+y*y+z*z), 6) AS range FROM lidar", "lidar")
def f65_planes(spark, d):
    offset = geo.plane_offset(cols("nx", "ny", "nz"), cols("x", "y", "z"))
    return view(spark, d, "lidar").select("lidar_id", (F.round(offset, 6) + 0.0).alias("d"), F.round(geo.norm(cols("x", "y", "z")), 6).alias("range"))


@query(
    """SELECT vec_id, round(list_sum(list_transform(r, lambda v: v*v)), 5) AS one, round(r[1], 5) AS first FROM
    (SELECT vec_id, list_transform(embedding, lambda v: sqrt(abs(CAST(v AS DOUBLE))/list_sum(list_transform(embedding, lambda w: abs(CAST(w AS DOUBLE)))))) AS r FROM embeddings) AS t"""
)
def f73_root_descriptors(spark, d):
    r = geo.unit_root(F.col("embedding").cast("array<double>"))
    e = view(spark, d, "embeddings").select("vec_id", r.alias("r"))
    return e.select("vec_id", F.round(geo.dot_arrays(F.col("r"), F.col("r")), 5).alias("one"), F.round(F.col("r")[0], 5).alias("first"))


@query("SELECT vec_id, list_sum(list_transform(embedding, lambda v: CAST(v > 0 AS INT)))::BIGINT AS bits FROM embeddings")
def r08_signatures(spark, d):
    return view(spark, d, "embeddings").select("vec_id", F.bit_count(geo.sign_bits(F.col("embedding"))).cast("long").alias("bits"))


@query(
    """WITH c AS (SELECT avg(x) AS mx, avg(y) AS my FROM points3d), s AS (SELECT sqrt(2)/sqrt(avg(power(x-mx, 2)+power(y-my, 2))) AS s FROM points3d, c)
    SELECT point3d_id, round((x-mx)*s, 6)+0e0 AS x, round((y-my)*s, 6)+0e0 AS y FROM points3d, c, s""",
    "points3d",
)
def f71_center_normalize(spark, d):
    p = view(spark, d, "points3d").select("point3d_id", "x", "y")
    c = F.broadcast(p.agg(F.avg("x").alias("mx"), F.avg("y").alias("my")))
    moved = p.join(c).select("point3d_id", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    s = F.broadcast(moved.agg((F.sqrt(F.lit(2.0)) / F.sqrt(F.avg(F.col("x") ** 2 + F.col("y") ** 2))).alias("s")))
    return moved.join(s).select("point3d_id", *((F.round(F.col(v) * F.col("s"), 6) + 0.0).alias(v) for v in "xy"))
