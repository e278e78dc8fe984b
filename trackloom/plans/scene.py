"""Queries of filters, tracks, retrieval, clusters, LiDAR steps and the structure journal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions import geometry as geo
from trackloom.operators import filters, graph, journal, lidar, mapping, matching, partition, ranking, robust, stats, tables
from trackloom.operators.rounds import cut
from trackloom.plans.adapters import view
from trackloom.plans.base import DIGITS, cols, query, round_to, rounded
from trackloom.plans.mapping import j20_z_buffer
from trackloom.plans.registry import ANGLE_SQL, MATCH_SQL, NEAR_SQL, WORDS_SQL, _postings

#: Squared errors of the test model's observations.
E2_SQL = "CASE WHEN depth < 2.220446049250313e-16 THEN 1.7976931348623157e308 ELSE power((7*point3d_id+13*image_id)%21-10, 2)+power((5*point3d_id+3*image_id)%21-10, 2) END"


def scored(spark, d):
    """Observations with their squared error."""
    noise = lambda a, b: ((F.col("point3d_id") * a + F.col("image_id") * b) % 21 - 10).cast("double")
    u, v = noise(7, 13), noise(5, 3)
    return view(spark, d, "observed").withColumn("e2", F.when(F.col("depth") < geo.EPS, geo.BEHIND).otherwise(u * u + v * v))


# -- filters --------------------------------------------------------------------


ANGLES_OF = """, j AS (SELECT a.point3d_id, power(a.ox-b.ox,2)+power(a.oy-b.oy,2)+power(a.oz-b.oz,2) AS base, power(a.x-a.ox,2)+power(a.y-a.oy,2)+power(a.z-a.oz,2) AS r1, power(a.x-b.ox,2)+power(a.y-b.oy,2)+power(a.z-b.oz,2) AS r2
        FROM k AS a JOIN k AS b ON a.point3d_id = b.point3d_id AND a.image_id < b.image_id),
    g AS (SELECT point3d_id, max(CASE WHEN r1*r2 = 0 THEN 0 ELSE least(abs(acos(greatest(-1e0, least(1e0, (r1+r2-base)/(2*sqrt(r1*r2)))))), pi()-abs(acos(greatest(-1e0, least(1e0, (r1+r2-base)/(2*sqrt(r1*r2))))))) END) AS t FROM j GROUP BY point3d_id)"""


@query(
    f"""WITH e AS (SELECT *, {E2_SQL} AS e2 FROM observed), n AS (SELECT * FROM e WHERE e2 <= 121), k AS (SELECT * FROM n WHERE point3d_id IN (SELECT point3d_id FROM n GROUP BY point3d_id HAVING count(*) >= 2))"""
    + ANGLES_OF
    + " SELECT k.point3d_id, k.image_id FROM k JOIN g ON k.point3d_id = g.point3d_id WHERE degrees(t) >= 5 AND depth >= 2.220446049250313e-16",
    "observed",
)
def p04_combined(spark, d):
    return filters.combined_filter(scored(spark, d), 11.0, 5.0).select("point3d_id", "image_id")


@query(
    f"""WITH s AS (SELECT * FROM observed WHERE point3d_id IN (SELECT point3d_id FROM tracks WHERE image_id IN (SELECT image_id FROM images WHERE camera_id <= 5))), e AS (SELECT *, {E2_SQL} AS e2 FROM s),
    n AS (SELECT * FROM e WHERE e2 <= 121), k AS (SELECT * FROM n WHERE point3d_id IN (SELECT point3d_id FROM n GROUP BY point3d_id HAVING count(*) >= 2))"""
    + ANGLES_OF
    + " SELECT k.point3d_id, count(*) AS kept FROM k JOIN g ON k.point3d_id = g.point3d_id WHERE degrees(t) >= 5 AND depth >= 2.220446049250313e-16 GROUP BY k.point3d_id",
    "observed",
)
def p05_in_images(spark, d):
    """The combined filter over the points that the images of five cameras see."""
    seen = filters.seen_in(scored(spark, d), view(spark, d, "images").filter("camera_id <= 5"))
    return filters.combined_filter(seen, 11.0, 5.0).groupBy("point3d_id").agg(F.count("*").alias("kept"))


@query("SELECT pair_id, CASE WHEN n_rows < 3 THEN 0 ELSE n_rows END AS n_rows FROM pairs", "pairs")
def p17_enough_inliers(spark, d):
    return filters.enough_inliers(view(spark, d, "pairs"), 3).select("pair_id", "n_rows")


@query(
    """SELECT a.point3d_id, a.image_id AS image_id1, b.image_id AS image_id2 FROM observed AS a JOIN observed AS b ON a.point3d_id = b.point3d_id AND a.image_id < b.image_id
    WHERE abs(a.depth-b.depth) <= 2e-1*a.depth AND (a.image_id-b.image_id)*(a.image_id-b.image_id)/1e2 <= 49 AND cos((a.image_id-b.image_id)*1e-2) >= 9e-1""",
    "observed",
)
def p21_pixel_gates(spark, d):
    both = stats.co_observations(view(spark, d, "observed"), "depth")
    gap = (F.col("image_id1") - F.col("image_id2")).cast("double")
    return filters.consistent_pixels(both.withColumn("e2", gap * gap / 100).withColumn("cosine", F.cos(gap * 0.01)), 0.2, 7.0, 0.9).select("point3d_id", "image_id1", "image_id2")


@query("SELECT image_id, bool_or(depth < 0) AS any_less, bool_or(depth > 45) AS any_greater FROM observed GROUP BY image_id", "observed")
def p22_any(spark, d):
    depths = view(spark, d, "observed").groupBy("image_id").agg(F.collect_list("depth").alias("v"))
    return depths.select("image_id", F.exists("v", lambda x: x < 0).alias("any_less"), F.exists("v", lambda x: x > 45).alias("any_greater"))


# -- tracks and models ------------------------------------------------------------


@query("SELECT CAST(r_regionkey AS VARCHAR) || '.' || n_nationkey AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
def u14_leaves(spark, d):
    n = view(spark, d, "nation")
    top = view(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("path"), F.lit("root").alias("parent"))
    low = n.select(F.concat_ws(".", "n_regionkey", "n_nationkey").alias("path"), F.col("n_regionkey").cast("string").alias("parent"))
    root = spark.createDataFrame([("root", None)], "path string, parent string")
    return graph.leaf_clusters(root.union(top).union(low)).select("path")


@query(
    """WITH c AS (SELECT DISTINCT e.src AS image_id, e.src_idx AS idx, e.point3d_id+e.dst % 3 AS point3d_id, ((e.src*7+e.dst*13) % 50)/10e0 AS degrees FROM edges AS e WHERE e.src_idx % 3 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY image_id, idx ORDER BY degrees, point3d_id) AS rn FROM c) SELECT image_id, idx, point3d_id, round(degrees, 6) AS degrees FROM r WHERE rn = 1 AND degrees <= 2""",
    "edges",
)
def u18_continue(spark, d):
    """Unlinked features (every third) join the point they see at the least angle."""
    e = view(spark, d, "edges").filter("src_idx % 3 = 0")
    c = e.select(F.col("src").alias("image_id"), F.col("src_idx").alias("idx"), (F.col("point3d_id") + F.col("dst") % 3).alias("point3d_id"), ((F.col("src") * 7 + F.col("dst") * 13) % 50 / 10).alias("degrees"))
    return rounded(graph.continued(c, 2.0))


@query(
    """WITH t AS (SELECT point3d_id*10+image_id % 2 AS p, point3d_id AS o, image_id, idx FROM tracks), n AS (SELECT p, any_value(o) AS o, count(*) AS len FROM t GROUP BY p),
    l AS (SELECT a.p AS point_a, b.p AS point_b, a.o, a.len AS la, b.len AS lb FROM n AS a JOIN n AS b ON a.o = b.o AND a.p < b.p),
    m AS (SELECT l.*, q.x*la/(la+lb)+(q.x+1e-2)*lb/(la+lb) AS mx, q.y AS my, q.z AS mz FROM l JOIN points3d AS q ON q.point3d_id = l.o),
    s AS (SELECT m.point_a, m.point_b, la+lb AS track_len, mx, my, mz, bool_and(o.depth > 1e-9 AND power(o.f*((1-2*i.qz*i.qz)*mx-2*i.qw*i.qz*my+i.tx)/nullif(mz+i.tz, 0)-o.f*o.px/nullif(o.depth, 0), 2)+power(o.f*(2*i.qw*i.qz*mx+(1-2*i.qz*i.qz)*my+i.ty)/nullif(mz+i.tz, 0)-o.f*o.py/nullif(o.depth, 0), 2) <= 4) AS ok
        FROM m JOIN observed AS o ON o.point3d_id = m.o JOIN images AS i ON i.image_id = o.image_id GROUP BY ALL)
    SELECT point_a, point_b, track_len, round(mx, 6)+0e0 AS mx FROM s WHERE ok""",
    "observed points3d",
)
def u16_merge_tracks(spark, d):
    """Points split in two by the parity of the image, one half moved a little, are merged where that fits all views."""
    t = view(spark, d, "tracks").select((F.col("point3d_id") * 10 + F.col("image_id") % 2).alias("point3d_id"), "image_id", "idx")
    lengths = t.groupBy("point3d_id").agg(F.count("*").alias("len"))
    at = view(spark, d, "points3d").select(F.col("point3d_id").alias("own"), "x", "y", "z")
    half = lengths.withColumn("own", F.floor(F.col("point3d_id") / 10)).join(at, "own").withColumn("x", F.col("x") + F.col("point3d_id") % 2 * 0.01)
    im = view(spark, d, "images").select("image_id", "qw", "qx", "qy", "qz", "tx", "ty", "tz")
    o = view(spark, d, "observed").select((F.col("point3d_id") * 10 + F.col("image_id") % 2).alias("point3d_id"), "image_id", "px", "py", "depth", "f").join(im, "image_id")
    zero = F.lit(0.0)
    u, v = geo.project(geo.to_camera(cols("qw", "qx", "qy", "qz"), cols("tx", "ty", "tz"), cols("mx", "my", "mz")), F.col("f"), zero, zero)
    low = F.nullif("depth", zero)
    error = F.when(F.col("depth") <= 1e-9, geo.BEHIND).otherwise((u - F.col("f") * F.col("px") / low) ** 2 + (v - F.col("f") * F.col("py") / low) ** 2)
    found = graph.merged_tracks(graph.merge_links(t, view(spark, d, "edges")), half.select("point3d_id", "x", "y", "z", "len"), o, error, 2.0)
    return found.select("point_a", "point_b", "track_len", (round_to(F.col("mx")) + 0.0).alias("mx"))


@query(
    """WITH a AS (SELECT image_id, idx, point3d_id FROM tracks WHERE image_id % 3 <> 0 AND point3d_id % 2 = 0), b AS (SELECT image_id, idx, point3d_id FROM tracks WHERE image_id % 3 <> 1),
    r AS (SELECT b.point3d_id, count(*) FILTER (WHERE a.point3d_id IS NULL) AS fresh, count(a.point3d_id) AS known, count(DISTINCT a.point3d_id) AS olds, min(a.point3d_id) AS old FROM b LEFT JOIN a ON a.image_id = b.image_id AND a.idx = b.idx GROUP BY b.point3d_id),
    c AS (SELECT point3d_id, fresh, known, CASE WHEN olds = 1 AND fresh+known >= 2 THEN 'merge' WHEN fresh >= 2 THEN 'create' ELSE 'skip' END AS act FROM r)
    SELECT c.point3d_id, fresh, known, act, round(2*(6e-1*x-8e-1*y)+1, 6)+0e0 AS x FROM c JOIN points3d AS p ON p.point3d_id = c.point3d_id WHERE act <> 'skip'""",
    "tracks points3d",
)
def u05_model_merge(spark, d):
    """A model that has every other point takes in another one's points, moved into its frame."""
    t = view(spark, d, "tracks")
    own, new = t.filter("image_id % 3 <> 0 AND point3d_id % 2 = 0"), t.filter("image_id % 3 <> 1")
    acts = graph.incoming_tracks(new, own, new.select("image_id").distinct()).filter("act <> 'skip'")
    move = geo.Similarity(2.0, (0.8**0.5, 0.0, 0.0, 0.2**0.5), (1.0, -2.0, 3.0))
    p = view(spark, d, "points3d").select("point3d_id", move.point(cols("x", "y", "z"))[0].alias("x"))
    return acts.join(p, "point3d_id").select("point3d_id", "fresh", "known", "act", (F.round("x", DIGITS) + 0.0).alias("x"))


@query(None)
def u06_merge_models(spark, d):
    """Models of the images of each camera and their neighbours, merged until none share three images."""
    im = view(spark, d, "images").select(F.col("camera_id").cast("long").alias("cluster"), "image_id")
    near = im.select("cluster", (F.col("image_id") + 1).alias("image_id")).join(im.select("image_id"), "image_id", "left_semi").select("cluster", "image_id")
    return partition.merge_to_fixpoint(im.union(near), 3)


@query(None)
def u13_hierarchy(spark, d):
    """The scene cut into clusters of thirty images at most, with five of their neighbours each."""
    e = view(spark, d, "pairs").select("image_id1", "image_id2", F.col("n_rows").alias("weight"))
    return partition.hierarchy(e, 2, 30, 5)


# -- rankings and clusters -----------------------------------------------------------


OVERLAP_SQL = """b AS (SELECT image_id1 AS image_id, image_id2 AS other_id, n_rows FROM pairs UNION ALL SELECT image_id2, image_id1, n_rows FROM pairs),
    o AS (SELECT image_id, other_id, row_number() OVER (PARTITION BY image_id ORDER BY n_rows DESC, other_id) AS rank FROM b)"""


def both_ways(p, *others):
    """Pairs of images from both ends, in one pass over them: image_id, other_id and other columns."""
    way = lambda a, b: F.struct(F.col(a).alias("image_id"), F.col(b).alias("other_id"))
    return p.select(F.explode(F.array(way("image_id1", "image_id2"), way("image_id2", "image_id1"))).alias("p"), *others).select("p.*", *others)


def overlap(spark, d, p=None):
    both = both_ways(view(spark, d, "pairs") if p is None else p, "n_rows")
    return both.select("image_id", "other_id", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("n_rows"), "other_id")).alias("rank"))


@query(
    f"""WITH {OVERLAP_SQL} SELECT image_id, other_id FROM o WHERE image_id % 3 = 0 AND rank <= 4 UNION ALL SELECT a.image_id, b.image_id FROM images AS a JOIN images AS b ON a.image_id <> b.image_id WHERE a.image_id = 1
    UNION ALL SELECT a.image_id, b.image_id FROM images AS a JOIN images AS b ON b.image_id IN (a.image_id+1, a.image_id+2) WHERE a.image_id % 3 = 2""",
    "pairs images",
)
def w07_stereo_sources(spark, d):
    """Sources by all three kinds of specification."""
    im = view(spark, d, "images").select("image_id", "name")
    name = lambda k: im.select((F.col("image_id") - k).alias("image_id"), F.col("name").alias(f"n{k}"))
    rows = im.join(name(1), "image_id", "left").join(name(2), "image_id", "left")
    kind = F.when(F.col("image_id") % 3 == 0, "__auto__, 4").when(F.col("image_id") % 3 == 2, F.concat_ws(", ", "n1", "n2")).when(F.col("image_id") == 1, "__all__")
    config = rows.select("name", kind.alias("spec")).filter("spec IS NOT NULL AND spec <> ''")
    return ranking.stereo_sources(config, im, overlap(spark, d))


@query("SELECT camera_id AS cluster, count(*) AS size, min(image_id) AS first, row_number() OVER (ORDER BY count(*) DESC, min(image_id)) AS place FROM images GROUP BY camera_id", "images")
def w11_cluster_order(spark, d):
    return ranking.cluster_order(view(spark, d, "images").select(F.col("camera_id").alias("cluster"), "image_id"))


@query(
    f"""WITH {OVERLAP_SQL}, c AS (SELECT camera_id % 4 AS cluster, image_id FROM images), f AS (SELECT c.cluster, o.other_id AS other, o.rank AS turn, o.image_id FROM o JOIN c ON c.image_id = o.image_id JOIN c AS k ON k.image_id = o.other_id WHERE k.cluster <> c.cluster AND rank <= 6),
    m AS (SELECT cluster, other, min(turn*1000000+image_id) AS spot FROM f GROUP BY cluster, other), t AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY spot, other) AS place FROM m)
    SELECT cluster, image_id FROM c UNION ALL SELECT cluster, other FROM t WHERE place <= 7""",
    "pairs images",
)
def w10_round_robin(spark, d):
    """Four clusters take in seven related images each, best matches first."""
    c = view(spark, d, "images").select((F.col("camera_id") % 4).alias("cluster"), "image_id")
    e = view(spark, d, "pairs").select("image_id1", "image_id2", F.col("n_rows").alias("weight"))
    return partition.round_robin_overlap(c, e, 7, 6)


@query(
    f"""WITH {OVERLAP_SQL}, c AS (SELECT camera_id % 4 AS cluster, image_id FROM images), f AS (SELECT c.cluster, b.other_id AS other, max(b.n_rows) AS w FROM b JOIN c ON c.image_id = b.image_id JOIN c AS k ON k.image_id = b.other_id WHERE k.cluster <> c.cluster GROUP BY c.cluster, b.other_id),
    t AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY w DESC, other) AS place FROM f) SELECT cluster, image_id FROM c UNION ALL SELECT cluster, other FROM t WHERE place <= 5""",
    "pairs images",
)
def w12_overlap_edges(spark, d):
    c = view(spark, d, "images").select((F.col("camera_id") % 4).alias("cluster"), "image_id")
    return partition.with_overlap(c, view(spark, d, "pairs").select("image_id1", "image_id2", F.col("n_rows").alias("weight")), 5)


@query(
    f"""WITH {OVERLAP_SQL}, s AS (SELECT image_id FROM images WHERE registered AND image_id % 3 <> 0) SELECT coalesce((SELECT arg_min(other_id, rank) FROM o WHERE image_id = 3 AND other_id IN (SELECT image_id FROM s)), (SELECT min(image_id) FROM s)) AS image_id""",
    "pairs images",
)
def w13_next_to_fuse(spark, d):
    im = view(spark, d, "images").select("image_id", F.col("registered").alias("used"), (F.col("image_id") % 3 == 0).alias("fused"))
    return ranking.next_to_fuse(im, overlap(spark, d), 3)


HOUGH_SQL = """WITH v AS (SELECT src AS query_image, dst AS image_id, CAST(src_idx % 16 AS INT) AS bx, CAST(dst_idx % 16 AS INT) AS bya, CAST(point3d_id % 8 AS INT) AS bs, CAST((src+dst) % 4 AS INT) AS ba FROM edges WHERE src < dst),
    f AS (SELECT query_image, image_id, bx, bya AS by_, bs, ba, count(*) AS n FROM v GROUP BY ALL),
    s AS (SELECT f.query_image, f.image_id, f.bx, f.by_, f.bs, f.ba, any_value(f.n) AS n, sum(g.n*(CASE WHEN g.bx = f.bx AND g.by_ = f.by_ AND g.bs = f.bs AND g.ba = f.ba THEN 1e0 ELSE 0 END + CASE WHEN g.bx>>1 = f.bx>>1 AND g.by_>>1 = f.by_>>1 AND g.bs>>1 = f.bs>>1 AND g.ba>>1 = f.ba>>1 THEN 5e-1 ELSE 0 END
        + CASE WHEN g.bx>>2 = f.bx>>2 AND g.by_>>2 = f.by_>>2 AND g.bs>>2 = f.bs>>2 AND g.ba>>2 = f.ba>>2 THEN 25e-2 ELSE 0 END)) AS score FROM f JOIN f AS g ON f.query_image = g.query_image AND f.image_id = g.image_id GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_image, image_id ORDER BY score DESC, bx, by_, bs, ba) AS rank FROM s)"""


@query(HOUGH_SQL + " SELECT query_image, image_id, bx, by_ AS by, bs, ba, n, round(score, 6) AS score, rank FROM r WHERE rank <= 3", "edges")
def w14_hough_bins(spark, d):
    e = view(spark, d, "edges").filter("src < dst")
    v = e.select(F.col("src").alias("query_image"), F.col("dst").alias("image_id"), (F.col("src_idx") % 16).cast("int").alias("bx"), (F.col("dst_idx") % 16).cast("int").alias("by"), (F.col("point3d_id") % 8).cast("int").alias("bs"), ((F.col("src") + F.col("dst")) % 4).cast("int").alias("ba"))
    return rounded(matching.hough_bins(v, 3, 3))


# -- matching and retrieval ------------------------------------------------------------


@query(
    MATCH_SQL.format(a=1, b=2).replace("WHERE dot > 0)", "WHERE dot > 0 AND (idx1-idx2)*(idx1-idx2)*5 <= 500)") + " SELECT idx1, idx2, round(best, 6) AS best, round(second, 6) AS second FROM m", "descriptors"
)
def j11_guided_match(spark, d):
    """Matches within ten pixels of the identity homography, features lying along a line."""
    x = view(spark, d, "descriptors").select("image_id", "idx", "descriptor", F.col("idx").cast("double").alias("x"), (F.col("idx") * 2.0).alias("y"))
    a, b = (x.filter(F.col("image_id") == i).select(F.lit(1).alias("pair"), "idx", "descriptor", "x", "y") for i in (1, 2))
    eye = tuple(tuple(F.lit(1.0 if i == j else 0.0) for j in range(3)) for i in range(3))
    error = geo.transfer_error(eye, cols("x1", "y1"), cols("x2", "y2"))
    return rounded(matching.guided_matches(a, b, error, 500**0.5, 0.98, 1.3).select("idx1", "idx2", "best", "second"))


@query(None)
def j10_approximate_match(spark, d):
    x = view(spark, d, "descriptors").select("image_id", "idx", "descriptor")
    a, b = (x.filter(F.col("image_id") == i).select(F.lit(1).alias("pair"), "idx", "descriptor") for i in (1, 2))
    return matching.approximate_matches(a, b, 0.98, 1.3).select("idx1", "idx2", "best", "second")


SCORES_SQL = (
    WORDS_SQL
    + """, n AS (SELECT p.image_id, CASE WHEN sum(idf*idf) > 0 THEN 1/sqrt(sum(idf*idf)) ELSE 0 END AS norm FROM p JOIN i ON p.word_id = i.word_id GROUP BY p.image_id),
    v AS (SELECT a.image_id AS query_image, a.idx, a.word_id, b.image_id, list_sum(list_transform(list_zip(a.bits, b.bits), lambda t: CAST(t[1] <> t[2] AS INT))) AS h FROM p AS a JOIN p AS b ON a.word_id = b.word_id),
    s AS (SELECT query_image, idx, word_id, image_id, sum(exp(-(h*h)/256e0))/sqrt(count(*)) AS s FROM v WHERE h <= 24 GROUP BY ALL),
    t AS (SELECT query_image, image_id, sum(s*idf*idf) AS s FROM s JOIN i ON s.word_id = i.word_id GROUP BY ALL),
    o AS (SELECT query_image, t.image_id, round(s*a.norm*b.norm, 6) AS score FROM t JOIN n AS a ON a.image_id = query_image JOIN n AS b ON b.image_id = t.image_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_image ORDER BY score DESC, image_id) AS rank FROM o WHERE query_image <> image_id{asked})"""
)


def retrieved(spark, d):
    p = _postings(spark, d)
    w = matching.idf(p)
    return rounded(matching.image_scores(p, p, w, matching.image_norms(p, w)))


@query(SCORES_SQL.format(asked="") + " SELECT DISTINCT least(query_image, image_id) AS image_id1, greatest(query_image, image_id) AS image_id2 FROM r WHERE rank <= 3", "descriptors")
def j04_vocabulary_pairs(spark, d):
    """Every image with the three that retrieval ranks first."""
    return matching.loop_pairs(retrieved(spark, d), view(spark, d, "descriptors").select("image_id").distinct(), 3)


@query(SCORES_SQL.format(asked=" AND query_image % 3 = 1") + " SELECT DISTINCT least(query_image, image_id) AS image_id1, greatest(query_image, image_id) AS image_id2 FROM r WHERE rank <= 2", "descriptors")
def j03_loop_detection(spark, d):
    """Every third image looks for loops by retrieval."""
    return matching.loop_pairs(retrieved(spark, d), view(spark, d, "descriptors").filter("image_id % 3 = 1").select("image_id").distinct(), 2)


@query(WORDS_SQL + " SELECT image_id, count(*) AS postings FROM p GROUP BY image_id", "descriptors")
def r04_add_images(spark, d):
    """An index of some images takes in the others; those it has are skipped."""
    p = _postings(spark, d)
    return matching.added_images(p.filter("image_id % 2 = 0"), p).groupBy("image_id").agg(F.count("*").alias("postings"))


@query(SCORES_SQL.format(asked="") + " SELECT query_image, image_id, score FROM o WHERE query_image % 2 = 1 AND image_id % 2 = 0", "descriptors")
def r13_retrieve(spark, d):
    """One list of images asked of another."""
    p = _postings(spark, d)
    w = matching.idf(p)
    return rounded(matching.image_scores(p.filter("image_id % 2 = 1"), p.filter("image_id % 2 = 0"), w, matching.image_norms(p, w)))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE)*CAST(v AS DOUBLE))), 4) AS kept FROM embeddings")
def r09_projection(spark, d):
    """The Hamming projection of every descriptor keeps its squared length: its rows are orthonormal."""
    x = view(spark, d, "embeddings").select("vec_id", "embedding")
    return matching.projected(x, "embedding", 64).select("vec_id", F.round(F.aggregate("projected", F.lit(0.0), lambda s, v: s + v * v), 4).alias("kept"))


@query(None)
def r01_vocabulary(spark, d):
    """How many descriptors each of sixteen trained words gets."""
    x = view(spark, d, "descriptors").select("image_id", "idx", "descriptor")
    words = matching.train_words(x, 16)
    return matching.nearest_words(x, words, 1).groupBy("word_id").agg(F.count("*").alias("n"))


@query(None)
def r11_one_to_one(spark, d):
    """One-to-one matches among the candidates of every pair of images."""
    e = view(spark, d, "edges").filter("src < dst")
    c = e.select((F.col("src") * 100000 + F.col("dst")).alias("pair"), F.col("src_idx").alias("idx1"), F.explode(F.array("dst_idx", (F.col("dst_idx") + 1).cast("int"))).alias("idx2"))
    return matching.one_to_one(c.withColumn("distance", (F.abs(F.col("idx1") - F.col("idx2")) % 7).cast("double")))


@query("SELECT pair_id, CASE WHEN f < 15 AND h < 15 THEN 1 WHEN h > 8e-1*f THEN 6 ELSE 3 END AS config FROM (SELECT pair_id, n_rows*3 AS f, n_rows*(image_id2 % 4) AS h FROM pairs) AS c", "pairs")
def e10_uncalibrated(spark, d):
    n = F.col("n_rows")
    return view(spark, d, "pairs").select("pair_id", robust.uncalibrated_config(n * 3, n * (F.col("image_id2") % 4)).alias("config"))


# -- LiDAR ---------------------------------------------------------------------------


@query("SELECT CAST(round(-y) AS BIGINT) AS kx, CAST(round(-z) AS BIGINT) AS ky, CAST(round(x) AS BIGINT) AS kz, count(*) AS n FROM lidar GROUP BY 1, 2, 3", "lidar")
def l01_initialize(spark, d):
    return lidar.prepared(view(spark, d, "lidar")).groupBy("kx", "ky", "kz").agg(F.count("*").alias("n"))


@query(
    """WITH v AS (SELECT DISTINCT CAST(round(x) AS BIGINT) AS kx, CAST(round(y) AS BIGINT) AS ky, CAST(round(z) AS BIGINT) AS kz FROM points3d),
    c AS (SELECT i.image_id, kx, ky, kz, (1-2*qz*qz)*kx-2*qw*qz*ky+tx AS a, 2*qw*qz*kx+(1-2*qz*qz)*ky+ty AS b, kz+tz AS c, f, cx, cy FROM v, images AS i JOIN cameras AS k ON i.camera_id = k.camera_id)
    SELECT image_id, kx, ky, kz FROM c WHERE c <= 40 AND a*f <= (1000-cx)*c AND a*f >= -cx*c AND b*f <= (800-cy)*c AND b*f >= -cy*c AND image_id <> 1""",
    "points3d images cameras",
)
def l03_submap_search(spark, d):
    """The cells in each image's view, 40 m deep."""
    rows = view(spark, d, "images").filter("image_id <> 1").join(F.broadcast(view(spark, d, "cameras")), "camera_id")
    near = mapping.frustum_voxels(stats.submap(view(spark, d, "points3d")), lidar.view_planes(rows, 40.0), 1.0, 1e-6)
    return lidar.in_view(near, rows, 40.0).select("image_id", "kx", "ky", "kz")


@query(
    """WITH q AS (SELECT image_id, idx, point3d_id, depth, CAST(trunc(u*0.05e0) AS INT) AS pu, CAST(trunc(v*0.05e0) AS INT) AS pv FROM points2d WHERE depth > 1 AND abs(u) < 2e3 AND abs(v) < 2e3),
    f AS (SELECT image_id, point3d_id AS id, depth, pu+a AS pu, pv+b AS pv FROM q, range(-1, 2) AS x(a), range(-1, 2) AS y(b)), r AS (SELECT *, row_number() OVER (PARTITION BY image_id, pu, pv ORDER BY depth, id) AS rn FROM f),
    g AS (SELECT *, row_number() OVER (PARTITION BY image_id, pu, pv ORDER BY idx, point3d_id) AS rn FROM q)
    SELECT g.image_id, g.idx, g.point3d_id, r.id AS lidar_id, round(r.depth, 6) AS depth FROM g JOIN r ON g.image_id = r.image_id AND g.pu = r.pu AND g.pv = r.pv WHERE g.rn = 1 AND r.rn = 1""",
    "points2d",
)
def l05_associations(spark, d):
    """Each feature pixel's first feature with the nearest point of its pixel."""
    p = view(spark, d, "points2d").filter("depth > 1 AND abs(u) < 2e3 AND abs(v) < 2e3")
    features = p.select("image_id", "idx", "point3d_id", (F.col("u") * 0.05).cast("int").alias("pu"), (F.col("v") * 0.05).cast("int").alias("pv"))
    return lidar.pixel_associations(features, j20_z_buffer(spark, d))


@query(
    """SELECT DISTINCT t.image_id FROM tracks AS t LEFT JOIN pairs AS p ON (p.image_id1 = 2 AND p.image_id2 = t.image_id) OR (p.image_id2 = 2 AND p.image_id1 = t.image_id)
    WHERE t.image_id <> 2 AND t.point3d_id IN (SELECT point3d_id FROM tracks WHERE image_id = 2) AND (p.n_rows IS NULL OR p.n_rows > 1)""",
    "tracks pairs",
)
def l06_track_images(spark, d):
    return lidar.images_to_project(view(spark, d, "tracks"), view(spark, d, "pairs"), 2, 1)


@query(
    """WITH c AS (SELECT t.point3d_id, t.image_id, l.lidar_id, abs((t.image_id*37+l.lidar_id*11)%101/101e0) AS cosine FROM tracks AS t JOIN lidar AS l ON l.lidar_id % 50000 = t.point3d_id % 50000),
    r AS (SELECT *, row_number() OVER (PARTITION BY point3d_id ORDER BY cosine, image_id, lidar_id) AS rn FROM c) SELECT point3d_id, lidar_id, 'Proj' AS type FROM r WHERE rn = 1""",
    "tracks lidar",
)
def l07_projection_match(spark, d):
    from trackloom.plans.mapping import j21_best_association

    return j21_best_association(spark, d).select("point3d_id", "lidar_id", F.lit("Proj").alias("type"))


@query(
    NEAR_SQL
    + """ SELECT point3d_id, lidar_id, CASE WHEN abs(ny) > 10*abs(nx) AND abs(ny) > 10*abs(nz) THEN 'IcpGround' ELSE 'Icp' END AS type, round(dist, 6) AS dist, global_opt_num+1 AS rounds
    FROM m WHERE rn = 1 AND dist <= greatest(0.2e0, 1.5e0-global_opt_num*0.1e0) AND point3d_id IN (SELECT point3d_id FROM tracks GROUP BY point3d_id HAVING count(*) >= 3)""",
    "points3d lidar tracks",
)
def l09_global_preparation(spark, d):
    """Associations of the points in three images or more, and their next round."""
    variable = view(spark, d, "tracks").groupBy("point3d_id").count().filter("count >= 3")
    return rounded(lidar.global_associations(view(spark, d, "points3d"), variable, view(spark, d, "lidar"), 1.5, 0.2, 0.1))


# -- journal and solve ---------------------------------------------------------------


@query(
    """WITH c AS (SELECT event_id AS spot, CAST(floor(event_id/4e0) AS BIGINT) AS batch, event_id % 17 = 0 AS aborted, event_id % 5 = 0 AS suppressed, event_type AS kind, user_id AS entity FROM events),
    b AS (SELECT batch, min(spot) AS spot FROM c GROUP BY batch HAVING NOT bool_or(aborted)), r AS (SELECT batch, row_number() OVER (ORDER BY spot) AS revision, count(*) OVER () AS newest FROM b)
    SELECT revision, kind, entity FROM c JOIN r ON c.batch = r.batch WHERE NOT suppressed AND revision > newest-500"""
)
def m20_publish(spark, d):
    e = view(spark, d, "events")
    changes = e.select(F.col("event_id").alias("at"), F.floor(F.col("event_id") / 4).alias("batch"), (F.col("event_id") % 17 == 0).alias("aborted"), (F.col("event_id") % 5 == 0).alias("suppressed"), F.col("event_type").alias("kind"), F.col("user_id").alias("entity"))
    return journal.publish(changes, 500)


@query(
    """WITH s AS (SELECT t.* FROM tracks AS t JOIN images AS i ON t.image_id = i.image_id WHERE registered), n AS (SELECT point3d_id, count(*) AS n FROM s GROUP BY point3d_id)
    SELECT s.point3d_id, image_id, idx, image_id <> (SELECT min(image_id) FROM images WHERE registered) AS pose_moves, n >= 2 AS point_moves, row_number() OVER (ORDER BY s.point3d_id, image_id, idx)-1 AS residual FROM s JOIN n ON s.point3d_id = n.point3d_id""",
    "tracks images",
)
def m24_active_solve(spark, d):
    """The residuals of a solve in which the first image stands still."""
    im = view(spark, d, "images")
    first = im.filter("registered").agg(F.min("image_id").alias("image_id"))
    return journal.active_solve(im, view(spark, d, "tracks"), first)


@query(
    """WITH g AS (SELECT CAST(floor(event_id/50e0) AS BIGINT) AS round, count(*) FILTER (WHERE event_id % 7 = 0) AS changed, count(*) AS adjusted FROM events GROUP BY 1), r AS (SELECT round, CASE WHEN adjusted = 0 THEN 0 ELSE changed/adjusted END AS changed FROM g),
    f AS (SELECT min(round) AS last FROM r WHERE changed < 13e-2) SELECT round, round(changed, 6) AS changed FROM r, f WHERE f.last IS NULL OR round <= f.last"""
)
def w19_convergence(spark, d):
    """Rounds of refinement up to the first whose share of changes is small."""
    e = view(spark, d, "events").groupBy(F.floor(F.col("event_id") / 50).alias("round")).agg(F.count_if(F.col("event_id") % 7 == 0).alias("changed"), F.count("*").alias("adjusted"))
    return rounded(ranking.until_settled(e, 0.13))


@query(
    f"""WITH {OVERLAP_SQL}, n AS (SELECT image_id, sum(n_rows) AS n FROM b GROUP BY image_id), f AS (SELECT image_id, row_number() OVER (ORDER BY n DESC, image_id) AS first_rank FROM n), p AS (SELECT f.image_id, f.first_rank, o.other_id, o.rank FROM f JOIN o ON o.image_id = f.image_id),
    k AS (SELECT least(image_id, other_id) AS image_id1, greatest(image_id, other_id) AS image_id2, min(first_rank*100000+rank) AS spot FROM p GROUP BY 1, 2) SELECT image_id1, image_id2, row_number() OVER (ORDER BY spot) AS turn FROM k""",
    "pairs",
)
def m01_initial_pairs(spark, d):
    """The order in which pairs are tried first: images by correspondences, partners by overlap, each pair once."""
    p = cut(view(spark, d, "pairs").select("image_id1", "image_id2", "n_rows"))  # counted once, read by all below
    o = overlap(spark, d, p)
    n = both_ways(p, "n_rows").groupBy("image_id").agg(F.sum("n_rows").alias("n"))
    first = n.select("image_id", F.row_number().over(Window.orderBy(F.desc("n"), "image_id")).alias("first_rank"))
    return ranking.pair_turns(first, o)


@query(
    """WITH l AS (SELECT image_id, depth, row_number() OVER (PARTITION BY image_id ORDER BY depth)-1 AS rk, count(*) OVER (PARTITION BY image_id) AS n FROM observed WHERE depth > 0),
    b AS (SELECT image_id, min(depth) FILTER (WHERE rk = CAST(round(5e-2*(n-1)) AS BIGINT)) AS lo, min(depth) FILTER (WHERE rk = CAST(round(95e-2*(n-1)) AS BIGINT)) AS hi FROM l GROUP BY image_id)
    SELECT o.image_id, point3d_id, CASE WHEN depth > 0 THEN round((greatest(lo, least(hi, depth))-lo)/nullif(hi-lo, 0), 5) ELSE 0 END AS gray FROM observed AS o JOIN b ON o.image_id = b.image_id""",
    "observed",
)
def v03_depth_gray(spark, d):
    """Depths as gray values between two robust percentiles of their image."""
    o = view(spark, d, "observed").select("image_id", "point3d_id", "depth")
    return stats.depth_gray(o, 5, 95).select("image_id", "point3d_id", F.round("gray", 5).alias("gray"))


@query(
    """SELECT lidar_id, CASE WHEN abs(nx)/sqrt(nx*nx+nz*nz)+25e-2 > 1 THEN 'horizontal' WHEN abs(nz)/sqrt(nx*nx+nz*nz)+25e-2 > 1 THEN 'vertical' ELSE 'undefined' END AS way FROM lidar WHERE nx*nx+nz*nz > 0""",
    "lidar",
)
def v10_line_ways(spark, d):
    """Segments whose direction is near one of the axes."""
    rows = view(spark, d, "lidar").filter("nx*nx+nz*nz > 0")
    return rows.select("lidar_id", stats.line_way(F.col("nx"), F.col("nz"), 0.25).alias("way"))


@query(
    """WITH i AS (SELECT image_id, camera_id, name, CASE WHEN image_id % 4 = 0 THEN 'north' ELSE 'south' END AS folder FROM images) SELECT image_id, dense_rank() OVER (ORDER BY folder) AS by_folder, 1 AS by_all, row_number() OVER (ORDER BY image_id) AS by_image FROM i""", "images"
)
def s26_shared_cameras(spark, d):
    """Camera ids of found images under the three sharing policies."""
    im = view(spark, d, "images").select("image_id", F.when(F.col("image_id") % 4 == 0, "north").otherwise("south").alias("folder"))
    by = lambda policy: tables.shared_cameras(im, policy).select("image_id", F.col("camera_id").alias(f"by_{policy}"))
    return by("folder").join(by("all"), "image_id").join(by("image"), "image_id")


@query(None)
def v02_fused_points(spark, d):
    """Observations whose depths agree grow together into fused points, each the median of its members."""
    both = stats.co_observations(view(spark, d, "observed"), "idx", "depth")
    gap = (F.col("image_id1") - F.col("image_id2")).cast("double")
    links = filters.consistent_pixels(both.withColumn("e2", gap * gap / 100).withColumn("cosine", F.lit(1.0)), 0.05, 3.0, 0.9)
    node = lambda k: (F.col(f"image_id{k}") * 1_000_000 + F.col(f"idx{k}")).alias("ab"[k - 1])
    groups = graph.grown(links.select(node(1), node(2)))
    o = view(spark, d, "observed").select((F.col("image_id") * 1_000_000 + F.col("idx")).alias("node"), "x", "y", "z")
    return rounded(groups.join(o, "node").groupBy("root").agg(F.count("*").alias("n"), *(F.median(c).alias(c) for c in "xyz")).filter("n >= 2"))
