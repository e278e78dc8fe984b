"""Queries of whole commands: chains of operators over a model."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions import geometry as geo
from trackloom.functions import scalars as sc
from trackloom.operators import filters, matching, pairs, ranking, stats
from trackloom.plans.adapters import view
from trackloom.plans.base import cols, query, rounded
from trackloom.plans.registry import ANGLE_SQL, WORDS_SQL, _postings, located


@query(
    ANGLE_SQL
    + """, e AS (SELECT point3d_id, CASE WHEN depth < 2.220446049250313e-16 THEN 1.7976931348623157e308 ELSE power((7*point3d_id+13*image_id)%21-10, 2)+power((5*point3d_id+3*image_id)%21-10, 2) END AS e2 FROM observed),
    s AS (SELECT point3d_id, count(*) AS len, count(*) FILTER (WHERE e2 > 144) AS bad FROM e GROUP BY point3d_id),
    k AS (SELECT point3d_id, len-bad AS kept FROM s WHERE NOT (len < 2 OR bad >= len-1)), b AS (SELECT point3d_id, max(degrees(angle)) AS a FROM h GROUP BY point3d_id)
    SELECT k.point3d_id, kept FROM k JOIN b ON k.point3d_id = b.point3d_id WHERE a >= 1.5e0 AND kept >= 2""",
    "observed",
)
def p08_point_filtering(spark, d):
    """Reprojection, then angle, then track length: the points that stay."""
    o = view(spark, d, "observed")
    noise = lambda a, b: ((F.col("point3d_id") * a + F.col("image_id") * b) % 21 - 10).cast("double")
    rows = o.select("point3d_id", noise(7, 13).alias("u"), noise(5, 3).alias("v"), F.lit(0.0).alias("pu"), F.lit(0.0).alias("pv"), "depth")
    near = filters.reprojection_filter(rows, 12.0).filter("NOT dropped").select("point3d_id", F.col("kept_len").alias("kept"))
    wide = filters.angle_filter(o, 1.5).filter("keep").select("point3d_id")
    return near.join(wide, "point3d_id", "left_semi").filter("kept >= 2")


@query("SELECT i.image_id, count(t.idx) AS points FROM images AS i LEFT JOIN tracks AS t ON i.image_id = t.image_id WHERE registered GROUP BY i.image_id HAVING count(t.idx) < 520", "images tracks")
def p07_image_filterer(spark, d):
    counts = view(spark, d, "images").filter("registered").select("image_id").join(view(spark, d, "tracks"), "image_id", "left").groupBy("image_id").agg(F.count("idx").alias("points"))
    return counts.filter("points < 520")


@query("SELECT image_id, name FROM images WHERE name NOT IN (SELECT name FROM images WHERE image_id % 6 = 1)", "images")
def p13_image_deleter(spark, d):
    im = view(spark, d, "images")
    return im.join(im.filter("image_id % 6 = 1").select("name"), "name", "left_anti").select("image_id", "name")


@query("SELECT image_id, idx FROM tracks WHERE (point3d_id*17)%11 <> 0", "tracks")
def p16_feature_mask(spark, d):
    t = view(spark, d, "tracks").withColumn("pixel", F.col("point3d_id") * 17 % 11)
    mask = spark.createDataFrame([(0,)], "pixel long")
    return t.join(F.broadcast(mask), "pixel", "left_anti").select("image_id", "idx")


@query(
    WORDS_SQL
    + """, n AS (SELECT p.image_id, CASE WHEN sum(idf*idf) > 0 THEN 1/sqrt(sum(idf*idf)) ELSE 0 END AS norm FROM p JOIN i ON p.word_id = i.word_id GROUP BY p.image_id),
    v AS (SELECT a.image_id AS query_image, a.idx, a.word_id, b.image_id, list_sum(list_transform(list_zip(a.bits, b.bits), lambda t: CAST(t[1] <> t[2] AS INT))) AS h FROM p AS a JOIN p AS b ON a.word_id = b.word_id),
    s AS (SELECT query_image, idx, word_id, image_id, sum(exp(-(h*h)/256e0))/sqrt(count(*)) AS s FROM v WHERE h <= 24 GROUP BY ALL),
    t AS (SELECT query_image, image_id, sum(s*idf*idf) AS s FROM s JOIN i ON s.word_id = i.word_id GROUP BY ALL),
    o AS (SELECT query_image, t.image_id, round(s*a.norm*b.norm, 6) AS score FROM t JOIN n AS a ON a.image_id = query_image JOIN n AS b ON b.image_id = t.image_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_image ORDER BY score DESC, image_id) AS rank FROM o) SELECT query_image, image_id, rank FROM r WHERE rank <= 3""",
    "descriptors",
)
def r06_query_top_k(spark, d):
    p = _postings(spark, d)
    w = matching.idf(p)
    scores = rounded(matching.image_scores(p, p, w, matching.image_norms(p, w)))
    return matching.top_images(scores, 3).select("query_image", "image_id", "rank")


@query(WORDS_SQL + " SELECT image_id, idx FROM p WHERE word_id = 3 AND image_id IN (1, 3, 5)", "descriptors")
def r10_word_matches(spark, d):
    return _postings(spark, d).filter("word_id = 3").filter(F.col("image_id").isin(1, 3, 5)).select("image_id", "idx")


@query("SELECT src*2147483647+dst AS pair_id, src_idx AS idx1, dst_idx AS idx2 FROM edges WHERE src < dst AND (point3d_id % 5) < 2", "edges")
def u03_inliers(spark, d):
    e = view(spark, d, "edges").filter("src < dst")
    return e.filter("point3d_id % 5 < 2").select(geo.pair_id(*cols("src", "dst")).alias("pair_id"), F.col("src_idx").alias("idx1"), F.col("dst_idx").alias("idx2"))


@query(
    "SELECT image_id, CASE WHEN image_id % 2 = 0 AND image_id % 3 = 0 THEN 'common' WHEN image_id % 2 = 0 THEN 'left' ELSE 'right' END AS side FROM images WHERE registered AND (image_id % 2 = 0 OR image_id % 3 = 0)", "images"
)
def u04_common_missing(spark, d):
    im = view(spark, d, "images").filter("registered").select("image_id")
    a, b = im.filter("image_id % 2 = 0").withColumn("l", F.lit(True)), im.filter("image_id % 3 = 0").withColumn("r", F.lit(True))
    side = F.when(F.col("l") & F.col("r"), "common").when(F.col("l"), "left").otherwise("right")
    return a.join(b, "image_id", "full").select("image_id", side.alias("side"))


@query(
    """WITH b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM points3d), t AS (SELECT i, j, lx+(hx-lx)*i/2-0.1e0*(hx-lx)/2 AS x0, lx+(hx-lx)*(i+1)/2+0.1e0*(hx-lx)/2 AS x1, ly+(hy-ly)*j/2-0.1e0*(hy-ly)/2 AS y0, ly+(hy-ly)*(j+1)/2+0.1e0*(hy-ly)/2 AS y1 FROM b, range(2) AS r(i), range(2) AS s(j))
    SELECT CAST(i*2+j AS INT) AS tile, count(*) AS points, count(*) >= 100 AS included FROM t JOIN points3d ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY i, j""",
    "points3d",
)
def g32_model_tiles(spark, d):
    """A model cut in two by two tiles that overlap by a tenth."""
    p = view(spark, d, "points3d").select("x", "y")
    box = F.broadcast(p.agg(*(f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max)))))
    rows = p.join(box)
    for axis in "xy":
        size = (F.col(f"hi{axis}") - F.col(f"lo{axis}")) / 2
        inside = [F.when(F.col(axis).between(F.col(f"lo{axis}") + size * k - size * 0.1, F.col(f"lo{axis}") + size * (k + 1) + size * 0.1), F.lit(k)) for k in (0, 1)]
        rows = rows.withColumn(f"t{axis}", F.explode(F.array_compact(F.array(*inside))))
    return rows.groupBy((F.col("tx") * 2 + F.col("ty")).alias("tile")).agg(F.count("*").alias("points")).withColumn("included", F.col("points") >= 100)


@query(
    """WITH r AS (SELECT point3d_id, x, y, z, row_number() OVER (PARTITION BY point3d_id % 40 ORDER BY x) AS rx, row_number() OVER (PARTITION BY point3d_id % 40 ORDER BY y) AS ry FROM points3d)
    SELECT point3d_id % 40 AS grp, round(median(x), 6) AS x, round(median(y), 6) AS y, round(median(z), 6) AS z, count(*) AS n FROM points3d GROUP BY 1""",
    "points3d",
)
def g20_fused_median(spark, d):
    p = view(spark, d, "points3d").withColumn("grp", F.col("point3d_id") % 40)
    return rounded(p.groupBy("grp").agg(*(F.median(c).alias(c) for c in "xyz"), F.count("*").alias("n")))


@query(
    """SELECT DISTINCT image_id, CAST(trunc(u*0.2e0) AS INT) AS pu, CAST(trunc(v*0.2e0) AS INT) AS pv FROM points2d WHERE u >= 0 AND u < 1000 AND v >= 0 AND v < 800""", "points2d"
)
def l02_feature_pixels(spark, d):
    p = view(spark, d, "points2d").filter("u >= 0 AND u < 1000 AND v >= 0 AND v < 800")
    return p.select("image_id", (F.col("u") * 0.2).cast("int").alias("pu"), (F.col("v") * 0.2).cast("int").alias("pv")).distinct()


@query(
    "SELECT point3d_id, image_id, CAST(round(greatest(2e0, least(10e0, 10-(depth-2)*8/38))*f/3039, 0) AS INT) AS half FROM observed WHERE depth >= 0.5e0", "observed"
)
def l04_footprint(spark, d):
    """Half-size of a point's footprint: 10 pixels at 2 m down to 2 at 40 m, by focal length."""
    half = sc.clip(10 - (F.col("depth") - 2) * 8 / 38, 2.0, 10.0) * F.col("f") / 3039
    return view(spark, d, "observed").filter("depth >= 0.5").select("point3d_id", "image_id", F.round(half).cast("int").alias("half"))


@query(
    """SELECT point3d_id, image_id, round(acos(least(1e0, depth/sqrt(px*px+py*py+depth*depth))), 6) AS angle, depth >= 2.220446049250313e-16 AS front FROM observed WHERE depth > 0""", "observed"
)
def f50_angular_error(spark, d):
    ray = cols("px", "py", "depth")
    angle = F.acos(F.least(F.lit(1.0), F.col("depth") / geo.norm(ray)))
    return rounded(view(spark, d, "observed").filter("depth > 0").select("point3d_id", "image_id", angle.alias("angle"), (F.col("depth") >= geo.EPS).alias("front")))


@query(
    """WITH l AS (SELECT image_id1, count(*) AS n FROM (SELECT DISTINCT least(a.image_id, b.image_id) AS image_id1, greatest(a.image_id, b.image_id) AS image_id2 FROM images AS a JOIN images AS b ON abs(a.image_id-b.image_id) = 1) AS t GROUP BY image_id1) SELECT image_id1, n FROM l""",
    "images",
)
def j06_closure_seed(spark, d):
    """Chain pairs, whose closure J6 grows round by round."""
    im = view(spark, d, "images").select("image_id")
    chain = im.select(F.col("image_id").alias("image_id1"), (F.col("image_id") + 1).alias("image_id2")).join(im.select(F.col("image_id").alias("image_id2")), "image_id2", "left_semi")
    return chain.groupBy("image_id1").agg(F.count("*").alias("n"))


@query(
    """SELECT a.image_id AS image_id1, b.image_id AS image_id2 FROM images AS a JOIN images AS b ON b.image_id > a.image_id AND b.image_id-a.image_id <= 8""", "images"
)
def j06_closure(spark, d):
    """Three rounds over a chain reach eight steps."""
    im = view(spark, d, "images").select("image_id")
    chain = im.select(F.col("image_id").alias("image_id1"), (F.col("image_id") + 1).alias("image_id2")).join(im.select(F.col("image_id").alias("image_id2")), "image_id2", "left_semi")
    return pairs.closure(chain, 3).select("image_id1", "image_id2")


@query(
    """WITH v AS (SELECT CAST(floor(x) AS INT) AS c, CAST(floor(y) AS INT) AS r, avg(z) AS z FROM points3d GROUP BY 1, 2), p AS (SELECT point3d_id, x+0.25e0 AS x, y+0.5e0 AS y FROM points3d)
    SELECT point3d_id, round(a.z*(1-(p.x-floor(p.x)))*(1-(p.y-floor(p.y)))+b.z*(p.x-floor(p.x))*(1-(p.y-floor(p.y)))+c.z*(1-(p.x-floor(p.x)))*(p.y-floor(p.y))+e.z*(p.x-floor(p.x))*(p.y-floor(p.y)), 6) AS value
    FROM p JOIN v AS a ON a.c = floor(p.x) AND a.r = floor(p.y) JOIN v AS b ON b.c = floor(p.x)+1 AND b.r = floor(p.y) JOIN v AS c ON c.c = floor(p.x) AND c.r = floor(p.y)+1 JOIN v AS e ON e.c = floor(p.x)+1 AND e.r = floor(p.y)+1""",
    "points3d",
)
def v08_bilinear(spark, d):
    """Bilinear values of a pixel table: one join with the four neighbours, then a weighted sum."""
    p = view(spark, d, "points3d")
    grid = p.groupBy(F.floor("x").cast("long").alias("c"), F.floor("y").cast("long").alias("r")).agg(F.avg("z").alias("v"))
    asked = p.select("point3d_id", (F.col("x") + 0.25).alias("x"), (F.col("y") + 0.5).alias("y"))
    x0, y0, *weights = stats.bilinear(F.col("x"), F.col("y"))
    near = [F.struct((x0 + i % 2).cast("long").alias("c"), (y0 + i // 2).cast("long").alias("r"), w.alias("w")) for i, w in enumerate(weights)]
    rows = asked.select("point3d_id", F.explode(F.array(*near)).alias("n")).select("point3d_id", "n.*").join(grid, ["c", "r"])
    return rounded(rows.groupBy("point3d_id").agg(F.sum(F.col("w") * F.col("v")).alias("value"), F.count("*").alias("n")).filter("n = 4").select("point3d_id", "value"))
