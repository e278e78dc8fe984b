import math
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import cameras
from trackloom.functions import geometry as geo
from trackloom.functions import scalars as sc
from trackloom.operators import filters, graph, matching, pairs, partition, ranks, robust, stats, tables
from trackloom.sources import database, exports, model_binary, model_text, snapshots
from trackloom.streaming import events


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_pair_ids(spark):
    a, b = geo.pair_images(geo.pair_id(F.lit(7).cast("long"), F.lit(3).cast("long")))
    r = one(spark, a=a, b=b, same=geo.pair_id(F.lit(7), F.lit(3)) == geo.pair_id(F.lit(3), F.lit(7)))
    assert (r.a, r.b, r.same) == (3, 7, True)


def test_bounds(spark):
    cloud = [(i, 2.0 * i, -1.0 * i, 0.25) for i in range(5)]
    points = spark.createDataFrame(cloud, "point3d_id long, x double, y double, z double")
    assert rows(stats.trimmed_bounds(points, 0.0, 1.0), "axis", "lo", "hi", "centroid") == [("x", 0.0, 8.0, 4.0), ("y", -4.0, 0.0, -2.0), ("z", 0.25, 0.25, 0.25)]
    assert rows(stats.trimmed_bounds(points, 0.25, 0.75), "axis", "lo", "hi") == [("x", 2.0, 6.0), ("y", -3.0, -1.0), ("z", 0.25, 0.25)]
    assert stats.trimmed_bounds(points.limit(0), 0.0, 1.0).count() == 0


def test_crop(spark):
    # Points on a diagonal: the box takes those on its two bounds, and leaves those just beyond.
    points = spark.createDataFrame([(i, i / 4, 2.0, -i / 4) for i in range(9)], "point3d_id long, x double, y double, z double")
    tracks = spark.createDataFrame([(2, 7, 0), (2, 8, 0), (4, 8, 1), (6, 9, 0), (7, 9, 1)], "point3d_id long, image_id long, idx int")
    kept = filters.crop(points, tracks, (0.5, 2.0, -1.5), (2.0, 2.0, -0.5))
    assert rows(kept, "point3d_id", "images") == [(2, 2), (3, 0), (4, 1), (5, 0), (6, 1)]
    assert filters.crop(points, tracks, (0.5, 2.0001, -1.5), (2.0, 3.0, -0.5)).count() == 0


def test_correspondences(spark):
    sizes = spark.createDataFrame([(0, 10), (1, 10), (2, 10)], "image_id long, num_points int")
    m = spark.createDataFrame([(0, 1, 0, 0), (0, 1, 0, 1), (0, 1, 5, 0), (0, 1, 3, 10), (1, 1, 2, 2), (1, 2, 0, 4)], "image_id1 long, image_id2 long, idx1 int, idx2 int")
    edges = graph.new_correspondences(m, sizes)
    assert rows(edges, "src", "src_idx", "dst", "dst_idx") == [(0, 0, 1, 0), (1, 0, 0, 0), (1, 0, 2, 4), (2, 4, 1, 0)]
    assert graph.transitive_correspondences(edges, 0, 0, 0).count() == 0
    assert rows(graph.transitive_correspondences(edges, 0, 0, 1), "image_id", "idx", "depth") == [(1, 0, 1)]
    assert rows(graph.transitive_correspondences(edges, 0, 0, 3), "image_id", "idx", "depth") == [(1, 0, 1), (2, 4, 2)]


def chain_of_groups(spark, groups, size):
    """Tight groups of images, each linked weakly to the next."""
    inside = [(g * size + i, g * size + j, 50 + i) for g in range(groups) for i in range(size) for j in range(i + 1, size)]
    between = [(g * size + size - 1, (g + 1) * size, 3) for g in range(groups - 1)]
    return spark.createDataFrame(inside + between, "image_id1 long, image_id2 long, weight int")


def test_scene_clusters(spark):
    edges = chain_of_groups(spark, 4, 3)
    clusters = partition.scene_clusters(edges, 4)

    def sets(df):
        found = {}
        for r in df.collect():
            found.setdefault(r[0], set()).add(r.image_id)
        return sorted(map(sorted, found.values()))

    assert sets(clusters) == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11]]
    assert sets(partition.with_overlap(clusters, edges, 1)) == [[0, 1, 2, 3], [2, 3, 4, 5], [5, 6, 7, 8], [8, 9, 10, 11]]
    leaves = partition.hierarchy(edges, 2, 4, 0)
    assert max(map(len, sets(leaves))) <= 4 and sorted(x for s in sets(leaves) for x in s) == list(range(12))
    assert sets(partition.round_robin_overlap(clusters, edges, 1, 5)) == [[0, 1, 2, 3], [2, 3, 4, 5], [5, 6, 7, 8], [8, 9, 10, 11]]


def test_models_merge_until_nothing_changes(spark):
    members = [(1, i) for i in (1, 2, 3, 4)] + [(2, i) for i in (3, 4, 5, 6)] + [(3, i) for i in (5, 7, 8)] + [(4, i) for i in (6, 8, 9)] + [(5, 20)]
    df = spark.createDataFrame(members, "cluster long, image_id long")
    # 2 joins 1 at once; 3 and 4 share one image with it, and one with each other.
    assert rows(partition.merge_to_fixpoint(df, 2).select("cluster").distinct(), "cluster") == [(1,), (3,), (4,), (5,)]
    assert rows(partition.merge_to_fixpoint(df, 1).select("cluster").distinct(), "cluster") == [(1,), (5,)]


def test_spatial_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    p = rng.uniform(0, 100, (60, 3))
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")
    found = rows(pairs.within(df, "id", 25.0, 6), "id", "other")
    want = []
    for i in range(60):
        d = ((p - p[i]) ** 2).sum(1)
        want += [(i, int(j)) for j in np.argsort(d, kind="stable")[:6] if j != i and d[j] <= 625]
    assert found == sorted(want)


def test_matching_empty_side(spark):
    d = spark.createDataFrame([(1, i, [float(i == k) for k in range(4)]) for i in range(4)], "pair int, idx int, descriptor array<double>")
    assert rows(matching.mutual_matches(d, d), "idx1", "idx2") == [(i, i) for i in range(4)]
    assert matching.mutual_matches(d, d.limit(0)).count() == 0


def test_deleting_from_a_track_of_two_deletes_the_point(spark):
    t = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (2, 1, 1), (2, 2, 1), (2, 3, 1), (3, 4, 0)], "point3d_id long, image_id long, idx int")
    gone = spark.createDataFrame([(1, 0), (1, 1)], "image_id long, idx int")
    assert rows(filters.delete_observations(t, gone), "point3d_id", "image_id") == [(2, 2), (2, 3), (3, 4)]


def test_routes(spark):
    lengths = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4, 5, 8)], "track_length int")
    count = lambda **k: {r.route: r["count"] for r in filters.route_by_length(lengths, 1, **k).groupBy("route").count().collect()}
    assert count() == {"PROJECTION": 4, "KDTREE": 3} and count(kdtree_only=True) == {"KDTREE": 7}


def test_merge_of_databases(spark):
    a, b = (spark.createDataFrame(r, "image_id long, name string") for r in ([(1, "test1"), (2, "test2")], [(1, "test3"), (2, "test4")]))
    ids = tables.merged_ids(a, b, "image_id")
    assert rows(ids, "source", "old_id", "new_id") == [(1, 1, 1), (1, 2, 2), (2, 1, 3), (2, 2, 4)]
    p = spark.createDataFrame([(0, 1, 2, 5), (0, 1, 2, 0)], "pair_id long, image_id1 long, image_id2 long, n_rows long")
    assert rows(tables.merged_pairs(p, ids, 2), "image_id1", "image_id2", "n_rows") == [(3, 4, 5)]
    assert tables.clashing_names(a, b).count() == 0 and tables.clashing_names(a, a).count() == 2


def test_scalars(spark):
    r = one(
        spark, after=sc.text_after(F.lit("a/b/c"), "/"), none=sc.text_after(F.lit("abc"), "/"), whole=sc.text_after(F.lit("abc"), ""), good=sc.csv_to_doubles(F.lit(" 1 ;2,, 3")), bad=sc.csv_to_doubles(F.lit("1,x")),
        choose=sc.choose(F.lit(10), 3), s=sc.scale_sigmoid(F.lit(1.0)), p=sc.nearest_rank(F.array(*map(F.lit, (5.0, 1.0, 2.0))), 50), d=sc.has_duplicate(F.array(F.lit(1), F.lit(1))),
    )
    assert (r.after, r.none, r.whole, r.good, r.bad, r.choose, r.p, r.d) == ("c", "", "abc", [1.0, 2.0, 3.0], [], 120, 2.0, True) and abs(r.s - 1) < 1e-12


def test_ellipsoid_round_trip(spark):
    df = spark.createDataFrame([(48.85, 2.29, 66.0), (-33.9, 18.4, 12.5), (0.0, -179.0, 0.0)], "lat double, lon double, alt double")
    x, y, z = geo.ecef(*(F.col(c) for c in ("lat", "lon", "alt")))
    la, lo, al = geo.geodetic(x, y, z)
    for r in df.select("*", la.alias("la"), lo.alias("lo"), al.alias("al")).collect():
        assert math.isclose(r.la, r.lat, abs_tol=1e-9) and math.isclose(r.lo, r.lon, abs_tol=1e-9) and math.isclose(r.al, r.alt, abs_tol=1e-6)


def test_rotation_of_a_point(spark):
    h = math.sqrt(0.5)
    q = tuple(F.lit(v) for v in (h, 0.0, 0.0, h))
    r = one(spark, **dict(zip("xyz", geo.rotated(q, tuple(F.lit(v) for v in (1.0, 0.0, 0.0))), strict=True)), n=geo.normalized(tuple(F.lit(0.0) for _ in range(4)))[0])
    assert abs(r.x) < 1e-12 and abs(r.y - 1) < 1e-12 and r.n == 1.0


def test_ransac_finds_the_similarity():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 3))
    y = 2 * x @ np.array([[0.6, 0.8, 0], [-0.8, 0.6, 0], [0, 0, 1]]) + [1, -3, 5]
    y[::4] += rng.uniform(50, 90, (50, 3))
    model, mask = robust.ransac(x, y, robust.similarity_fit, robust.residuals_of, 3, 0.01, 0)
    assert mask.sum() == 150 and np.allclose(model[:3, 3], [1, -3, 5])


def test_triangulation(spark):
    p1, p2 = np.hstack([np.eye(3), np.zeros((3, 1))]), np.hstack([np.eye(3), [[-1.0], [0], [0]]])
    x = np.array([0.3, -0.2, 4.0, 1])
    u, v = p1 @ x, p2 @ x
    df = spark.createDataFrame([(1, p1.ravel().tolist(), p2.ravel().tolist(), *(float(c) for c in (u[0] / u[2], u[1] / u[2], v[0] / v[2], v[1] / v[2])))], "id long, p1 array<double>, p2 array<double>, u1 double, v1 double, u2 double, v2 double")
    r = df.mapInPandas(robust.triangulate, "id long, x double, y double, z double").first()
    assert np.allclose([r.x, r.y, r.z], x[:3])


def test_text_model_round_trip(spark):
    images = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 4, "a b.png"), (2, 0.5, 0.5, 0.5, 0.5, 0.0, 0.0, 0.0, 4, "c.png")], "image_id long, qw double, qx double, qy double, qz double, tx double, ty double, tz double, camera_id long, name string")
    points = spark.createDataFrame([(1, 0, 1.5, 2.5, 7), (1, 1, 3.0, 4.0, None), (2, 0, 5.0, 6.0, 7)], "image_id long, idx int, x double, y double, point3d_id long")
    lines = model_text.image_lines(images, points).withColumn("at", F.struct("image_id", "part")).select("at", "value")
    got, got_points = model_text.read_images(lines, "at")
    assert rows(got, "image_id", "name", "tz") == [(1, "a b.png", 3.0), (2, "c.png", 0.0)]
    assert sorted(map(tuple, got_points.collect()), key=str) == sorted(map(tuple, points.collect()), key=str)


def test_binary_model_round_trip(spark, tmp_path):
    cameras = [(1, 1, 1000, 800, [500.0, 500.0, 500.0, 400.0]), (2, 10, 10, 20, [float(i) for i in range(12)])]
    images = [(1, [1.0, 0.0, 0.0, 0.0], [1.0, 2.0, 3.0], 2, "x/é.png", [1.0, 2.0], [3.0, 4.0], [7, None]), (2, [0.0] * 4, [0.0] * 3, 1, "", [], [], [])]
    points = [(7, 1.0, 2.0, 3.0, 9, 8, 7, 0.5, [1, 2], [0, 4]), (8, 0.0, 0.0, 0.0, 0, 0, 0, -1.0, [], [])]
    for kind, encode, data in (("cameras", model_binary.encode_cameras, cameras), ("images", model_binary.encode_images, images), ("points", model_binary.encode_points, points)):
        path = tmp_path / f"{kind}.bin"
        path.write_bytes(encode(data))
        found = model_binary.read(spark, str(path), kind, rows=1).drop("path").collect()
        assert sorted(tuple(r) for r in found) == data


@pytest.mark.parametrize("binary", [False, True])
def test_ply(spark, tmp_path, binary):
    data = model_binary.encode_ply([(1.0, 2.0, 3.0, 4, 5, 6), (-1.5, 0.0, 2.0, 255, 0, 1)])
    if binary:
        head = b"ply\nformat binary_little_endian 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n"
        data = head + struct.pack("<3f3B", 1, 2, 3, 4, 5, 6) + struct.pack("<3f3B", -1.5, 0, 2, 255, 0, 1)
    (tmp_path / "a.ply").write_bytes(data)
    found = model_binary.read(spark, str(tmp_path / "a.ply"), "ply")
    assert rows(found, "x", "y", "z", "r", "g", "b", "nx") == [(-1.5, 0, 2, 255, 0, 1, 0), (1, 2, 3, 4, 5, 6, 0)]


def test_database_ingest(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "d.db")
    con.executescript(
        """CREATE TABLE cameras (camera_id INTEGER, model INTEGER, width INTEGER, height INTEGER, params BLOB, prior_focal_length INTEGER);
        CREATE TABLE images (image_id INTEGER, name TEXT, camera_id INTEGER); CREATE TABLE keypoints (image_id INTEGER, rows INTEGER, cols INTEGER, data BLOB);
        CREATE TABLE descriptors (image_id INTEGER, rows INTEGER, cols INTEGER, data BLOB); CREATE TABLE matches (pair_id INTEGER, rows INTEGER, cols INTEGER, data BLOB);
        CREATE TABLE two_view_geometries (pair_id INTEGER, rows INTEGER, cols INTEGER, data BLOB, config INTEGER);"""
    )
    con.execute("INSERT INTO cameras VALUES (1, 0, 10, 10, ?, 1)", (np.array([1.0, 2.0, 3.0]).tobytes(),))
    con.execute("INSERT INTO images VALUES (1, 'a', 1)")
    con.execute("INSERT INTO keypoints VALUES (1, 2, 4, ?)", (np.array([[1, 2, 3, 0], [4, 5, 6, 0]], np.float32).tobytes(),))
    con.execute("INSERT INTO matches VALUES (?, 1, 2, ?)", (1 * 2147483647 + 2, np.array([[3, 4]], np.uint32).tobytes()))
    con.execute("INSERT INTO matches VALUES (5, 0, 2, NULL)")
    con.commit()
    con.close()
    assert database.ingest(str(tmp_path / "d.db"), str(tmp_path / "out")) == ["cameras", "images", "keypoints", "matches"]
    assert rows(spark.read.parquet(str(tmp_path / "out/matches")), "image_id1", "image_id2", "idx1", "idx2") == [(1, 2, 3, 4)]
    assert rows(spark.read.parquet(str(tmp_path / "out/keypoints")), "x", "a11", "a22") == [(1.0, 3.0, 3.0), (4.0, 6.0, 6.0)]


def test_streams(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"), "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string" if dict(source.dtypes)["ts"] == "timestamp_ntz" else "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    q = events.tumbling(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    want = events.tumbling(source.withColumn("ts", F.col("ts").cast("timestamp")), "1 day")
    assert rows(spark.table("tumbled"), "start", "event_type", "n") == rows(want, "start", "event_type", "n")
    assert events.sessions(source.withColumn("ts", F.col("ts").cast("timestamp"))).agg(F.sum("n")).first()[0] == source.count()


def test_trigger_stream(spark, tmp_path):
    growth = [(1, 1, 2, 100), (1, 2, 3, 105), (1, 3, 4, 300), (2, 1, 10, 1000), (2, 2, 10, 1001), (2, 3, 12, 1001)]
    spark.createDataFrame(growth, "model_id long, seq long, images long, points long").coalesce(1).write.parquet(str(tmp_path / "g"))
    stream = events.read_events(spark, str(tmp_path / "g"), "model_id long, seq long, images long, points long")
    q = events.global_triggers(stream).writeStream.outputMode("append").format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    table = spark.createDataFrame(growth, "model_id long, seq long, images long, points long")
    assert rows(events.global_triggers(table), "model_id", "images", "points", "fired") == rows(spark.table("fired"), "model_id", "images", "points", "fired")
    assert rows(spark.table("fired"), "model_id", "images", "points", "fired") == [(1, 2, 100, True), (1, 3, 105, True), (1, 4, 300, True), (2, 10, 1000, True), (2, 10, 1001, False), (2, 12, 1001, True)]


def test_ranks_and_numbers(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.standard_normal(3000), np.full(700, 0.5), rng.integers(0, 5, 300)]).tolist()
    df = spark.createDataFrame([(i % 3, x) for i, x in enumerate(v)] + [(0, None)], "g int, v double")
    for r in ranks.percentile(ranks.ranked(df, "v", "g"), {"low": 0.013, "mid": 0.5, "top": 1.0}, "g").collect():
        own = np.array([x for i, x in enumerate(v) if i % 3 == r.g])
        assert np.allclose([r.low, r.mid, r.top], np.quantile(own, [0.013, 0.5, 1.0]))
    whole = sorted(v)
    for x in ranks.ranked(df, "v").filter("n >= 1").orderBy("v").collect()[::97]:
        assert x.upto == sum(y <= x.v for y in whole) and x.total == len(v)
    numbers = ranks.numbered(df.repartition(7), "v", "g").collect()
    assert sorted(r._n for r in numbers) == list(range(1, len(v) + 2))
    by = sorted(numbers, key=lambda r: r._n)
    assert all((a.v is None) or (b.v is not None and a.v <= b.v) for a, b in zip(by, by[1:], strict=False))
    assert ranks.numbered(df.limit(0), "v").count() == 0


def test_sift_text_with_a_short_header(spark):
    lines = spark.createDataFrame([(1, -1, "2 3"), (1, 0, "1 2 2 0 7 8 9"), (1, 1, "3 4 1 1.5707963267948966 1 2 3"), (1, 2, "9 9 9 9 9 9 9"), (2, -1, "1 4"), (2, 0, "1 1 1 1 1 1 1 1")], "image_id long, at int, value string")
    found = {r.idx: r for r in exports.read_sift(lines, 3).collect()}
    assert set(found) == {0, 1} and found[0].descriptor == [7, 8, 9]
    assert (found[0].a11, found[0].a21) == (2.0, 0.0) and abs(found[1].a21 - 1) < 1e-12 and abs(found[1].a12 + 1) < 1e-12


def test_one_to_one_matches(spark):
    c = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 2.0), (1, 1, 0, 3.0), (1, 2, 1, 0.5), (1, 2, 0, 0.1)], "pair long, idx1 int, idx2 int, distance double")
    found = rows(matching.one_to_one(c), "idx1", "idx2")
    assert found == [(0, 1), (1, 0)]  # one has a single choice and goes first


def test_approximate_matches_find_near_copies(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((60, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + 0.01 * rng.standard_normal(x.shape)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    side = lambda m: spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(m)], "pair int, idx int, descriptor array<double>")
    assert rows(matching.approximate_matches(side(x), side(y)), "idx1", "idx2") == [(i, i) for i in range(60)]


def test_trained_words_take_their_descriptors(spark):
    rng = np.random.default_rng(7)
    x = np.repeat(np.eye(4), 25, axis=0) + 0.01 * rng.standard_normal((100, 4))
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "image_id long, idx int, descriptor array<double>")
    words = matching.train_words(df, 4, seed=1)
    found = matching.nearest_words(df, words, 1).collect()
    assert {len({r.idx // 25 for r in found if r.word_id == w}) for w in {r.word_id for r in found}} == {1}


def test_cameras_reject_wrong_parameters(spark):
    with pytest.raises(ValueError):
        cameras.named("PINHOLE", [1.0, 2.0, 3.0])


def test_opposite_directions_turn_nowhere(spark):
    up, down = ((F.lit(0.0), F.lit(0.0), F.lit(z)) for z in (2.0, -1.0))
    r = geo.rotation_between(up, down)
    got = one(spark, a=r[0][0], b=r[1][2], c=r[2][2])
    assert (got.a, got.b, got.c) == (1.0, 0.0, 1.0)


def test_growing_along_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (200, 201)]
    found = dict(rows(graph.grown(spark.createDataFrame(links, "a long, b long")), "node", "root"))
    assert found == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90, 200: 200, 201: 200}


def test_cuts_of_small_graphs():
    edges = [(0, 1, 3.0), (0, 2, 2.0), (1, 2, 1.0), (1, 3, 2.0), (2, 3, 4.0)]
    assert partition.st_min_cut(edges, 0, 3) == (5.0, {0})
    assert partition.st_min_cut([(0, 1, 1.0)], 0, 9) == (0.0, {0, 1})
    two = [(i, j, 5.0) for g in (0, 4) for i in range(g, g + 4) for j in range(i + 1, g + 4)] + [(3, 4, 1.0)]
    assert partition.spectral_parts(two, 2) == {i: i // 4 for i in range(8)}
    assert partition.spectral_parts([], 3) == {}


def test_dense_formats_round_trip(tmp_path):
    values = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    assert [r[2] for r in model_binary.decode_map(model_binary.encode_map(values))] == values.reshape(6, 4).tolist()
    graph_rows = [(0, 1, [4, 5]), (1, 2, []), (1, 0, [7])]
    assert list(model_binary.decode_consistency(model_binary.encode_consistency(3, 2, 2, graph_rows))) == graph_rows
    lists = [[1, 2, 3], [], [9]]
    assert list(model_binary.decode_visibility(model_binary.encode_visibility(lists))) == list(enumerate(lists))
    assert b"element face 1" in model_binary.encode_mesh([(0, 0, 0)] * 3, [(0, 1, 2)])


def test_binary_models_win_over_text(spark, tmp_path):
    for end in ("txt", "bin"):
        for x in ("cameras", "images", "points3D"):
            (tmp_path / f"{x}.{end}").write_bytes(b"")
        assert model_binary.found_format(spark, str(tmp_path)) == {"txt": "text", "bin": "binary"}[end]
    with pytest.raises(FileNotFoundError):
        (tmp_path / "cameras.bin").unlink()
        (tmp_path / "cameras.txt").unlink()
        model_binary.found_format(spark, str(tmp_path))


def test_versions_appear_at_once_and_are_checked(spark, tmp_path):
    folder = f"file://{tmp_path}"
    one = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    first = snapshots.commit(spark, folder, {"images": one, "cameras": one.limit(0)})
    with pytest.raises(Exception):  # noqa: B017  a failed write leaves the current version
        snapshots.commit(spark, folder, {"images": one.selectExpr("id", "raise_error('no') AS name")})
    assert rows(snapshots.load(spark, folder, check=True)["images"], "id") == [(1,), (2,)]
    second = snapshots.commit(spark, folder, {"images": one.limit(1)})
    assert snapshots.load(spark, folder)["images"].count() == 1 and snapshots.load(spark, folder, first)["images"].count() == 2
    one.write.mode("overwrite").parquet(f"{folder}/versions/{second}/images")
    with pytest.raises(ValueError):
        snapshots.load(spark, folder, check=True)


def test_words_block_by_block(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((50, 8)))], "word_id long, centroid array<double>")
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(rng.standard_normal((40, 8)))], "image_id long, idx int, descriptor array<double>")
    whole = rows(matching.nearest_words(df, words, 3), "idx", "word_id")
    monkeypatch.setattr(matching, "WORD_BLOCK", 7)
    assert rows(matching.nearest_words(df, words, 3), "idx", "word_id") == whole and len(whole) == 120


def test_hierarchies_of_stars_and_edgeless_clusters_end(spark):
    star = spark.createDataFrame([(0, i, 1.0) for i in range(1, 41)], "image_id1 long, image_id2 long, weight double")
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1, 1.0) for i in range(20)], "image_id1 long, image_id2 long, weight double")
    for edges, count in ((star, 41), (pairs, 40)):
        found = partition.hierarchy(edges, 2, 10, 0).collect()
        assert len(found) == count == len({r.image_id for r in found})
        sizes = {}
        for r in found:
            sizes[r.path] = sizes.get(r.path, 0) + 1
        assert max(sizes.values()) <= 10


def test_projection_of_odd_descriptors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [None, 1.0])], "vec_id long, d array<double>")
    found = {r.vec_id: r.projected for r in matching.projected(df, "d", 2, 2).collect()}
    assert abs(sum(v * v for v in found[1]) - 1) < 1e-12 and found[2] is found[3] is found[4] is None
