"""Queries of robust estimation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.operators import robust
from trackloom.plans.adapters import view
from trackloom.plans.base import query, rounded
from trackloom.streaming import events


@query(
    """SELECT pair_id, n_rows, CASE WHEN r >= 1 THEN 1 WHEN r <= 0 THEN 9223372036854775807 ELSE CAST(ceil(ln(1e0-0.99e0)/ln(1-power(r, 4))*3) AS BIGINT) END AS trials FROM (SELECT pair_id, n_rows, least(1e0, n_rows/100e0) AS r FROM pairs) AS t""",
    "pairs",
)
def e03_trials(spark, d):
    p = view(spark, d, "pairs")
    return p.select("pair_id", "n_rows", robust.trial_count(F.least(F.lit(100.0), F.col("n_rows").cast("double")), F.lit(100.0), 4).alias("trials"))


@query(
    """WITH r AS (SELECT event_type AS grp, CAST(user_id % 5 AS INT) AS model, value AS r FROM events), s AS (SELECT grp, model, count(*) FILTER (WHERE r <= 60) AS inliers, coalesce(sum(CASE WHEN r <= 60 THEN r END), 0) AS total FROM r GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY inliers DESC, total, model) AS rn FROM s) SELECT grp, model, inliers, round(total, 4) AS total FROM o WHERE rn = 1"""
)
def e04_support(spark, d):
    r = view(spark, d, "events").select(F.col("event_type").alias("grp"), (F.col("user_id") % 5).cast("int").alias("model"), F.col("value").alias("r"))
    best = robust.best_model(robust.inlier_support(r, ["grp", "model"], 60.0), "grp", "model")
    return best.select("grp", "model", "inliers", F.round("total", 4).alias("total"))


@query("SELECT event_type AS grp, round(sum(least(value, 60)), 4) AS score FROM events GROUP BY event_type")
def e05_truncated(spark, d):
    r = view(spark, d, "events").select(F.col("event_type").alias("grp"), F.col("value").alias("r"))
    return robust.truncated_support(r, ["grp"], 60.0).select("grp", F.round("score", 4).alias("score"))


@query(
    """WITH c AS (SELECT pair_id, n_rows*(1+image_id1%3) AS e, n_rows*3 AS f, n_rows*(image_id2%4) AS h FROM pairs)
    SELECT pair_id, CASE WHEN e < 15 AND f < 15 AND h < 15 THEN 1 WHEN e > 0.95e0*f AND e >= 15 THEN CASE WHEN h > 0.8e0*e THEN 6 ELSE 2 END WHEN h > 0.8e0*f THEN 6 ELSE 3 END AS config FROM c""",
    "pairs",
)
def e09_config(spark, d):
    n = F.col("n_rows")
    return view(spark, d, "pairs").select("pair_id", robust.calibrated_config(n * (1 + F.col("image_id1") % 3), n * 3, n * (F.col("image_id2") % 4)).alias("config"))


@query(
    """SELECT image_id, round(avg(CAST(u < 128 OR u > 872 OR v < 128 OR v > 672 AS INT)), 6) AS border FROM points2d WHERE u IS NOT NULL GROUP BY image_id""", "points2d"
)
def e12_border_share(spark, d):
    p = view(spark, d, "points2d").filter("u IS NOT NULL")
    outside = (F.col("u") < 128) | (F.col("u") > 872) | (F.col("v") < 128) | (F.col("v") > 672)
    return rounded(p.groupBy("image_id").agg(F.avg(outside.cast("int")).alias("border")))


@query("SELECT g, n, n-CAST(count_bad AS BIGINT) AS inliers, 2e0 AS scale FROM (SELECT point3d_id % 4 AS g, count(*) AS n, count(*) FILTER (WHERE point3d_id % 9 = 0) AS count_bad FROM points3d GROUP BY 1) AS t", "points3d")
def e01_align_models(spark, d):
    """Similarity of scale 2 under one ninth of outliers, by group."""
    p = view(spark, d, "points3d")
    off = F.when(F.col("point3d_id") % 9 == 0, 500 + F.col("point3d_id") * 7 % 1000).otherwise(0)
    rows = p.select((F.col("point3d_id") % 4).alias("g"), *(F.col(c).alias(f"{c}1") for c in "xyz"), (2 * (F.col("x") * 0.6 - F.col("y") * 0.8) + off).alias("x2"), (2 * (F.col("x") * 0.8 + F.col("y") * 0.6) + off * 2).alias("y2"), (2 * F.col("z") + 5).alias("z2"))
    return robust.align_groups(rows, "g", 0.5).select("g", "n", "inliers", F.round("scale", 6).alias("scale"))


@query(
    """WITH RECURSIVE c AS (SELECT 200*(8e-1*ln(8e-1/5e-1)+2e-1*ln(2e-1/5e-1))+1 AS a0), a(k, a) AS (SELECT 0, a0 FROM c UNION ALL SELECT k+1, a0+ln(a) FROM a, c WHERE k < 40),
    m AS (SELECT event_type, CAST(user_id % 10 AS INT) AS model, value, row_number() OVER w AS seen, count(*) FILTER (WHERE abs(value*(1+user_id % 10)/5e0) <= 60) OVER w AS met FROM events WINDOW w AS (PARTITION BY event_type, user_id % 10 ORDER BY event_id)),
    r AS (SELECT *, met*ln(2e-1/5e-1)+(seen-met)*ln(8e-1/5e-1) > (SELECT ln(a) FROM a WHERE k = 40) AS past FROM m), f AS (SELECT event_type, model, min(seen) FILTER (WHERE past) AS out, max(seen) AS n FROM r GROUP BY ALL)
    SELECT f.event_type, f.model, f.out IS NULL AS stands, r.met AS inliers, r.seen AS looked_at FROM f JOIN r ON f.event_type = r.event_type AND f.model = r.model AND r.seen = coalesce(f.out, f.n)"""
)
def e07_sequential_test(spark, d):
    """Models are given up as soon as their residuals make a good one too unlikely."""
    r = view(spark, d, "events").select("event_type", (F.col("user_id") % 10).cast("int").alias("model"), "event_id", (F.col("value") * (1 + F.col("user_id") % 10) / 5).alias("r"))
    return robust.sequential_test(r, ["event_type", "model"], "event_id", 60.0, 0.2, 0.5)


@query(
    """WITH RECURSIVE g AS (SELECT s_nationkey % 4 AS model_id, row_number() OVER w AS images, CAST(sum(1000*(s_suppkey % 7)+1) OVER w AS BIGINT) AS points FROM supplier WINDOW w AS (PARTITION BY s_nationkey % 4 ORDER BY s_suppkey)),
    t AS (SELECT model_id, images, points, TRUE AS fired, images AS i0, points AS p0 FROM g WHERE images = 1 UNION ALL
    SELECT model_id, images, points, fired, CASE WHEN fired THEN images ELSE i0 END, CASE WHEN fired THEN points ELSE p0 END FROM (
    SELECT g.model_id, g.images, g.points, g.images >= t.i0*12e-1 OR g.images >= t.i0+9 OR g.points >= t.p0*125e-2 OR g.points >= t.p0+20000 AS fired, t.i0, t.p0 FROM t JOIN g ON g.model_id = t.model_id AND g.images = t.images+1) AS s)
    SELECT CAST(model_id AS BIGINT) AS model_id, images, points, fired FROM t"""
)
def w17_global_triggers(spark, d):
    """The registrations that set a global refinement off, by model."""
    so_far = Window.partitionBy("model_id").orderBy("seq")
    s = view(spark, d, "supplier").select((F.col("s_nationkey") % 4).cast("long").alias("model_id"), F.col("s_suppkey").alias("seq"))
    growth = s.select("model_id", "seq", F.row_number().over(so_far).cast("long").alias("images"), F.sum(1000 * (F.col("seq") % 7) + 1).over(so_far).cast("long").alias("points"))
    return events.global_triggers(growth, 1.2, 9, 1.25, 20_000)
