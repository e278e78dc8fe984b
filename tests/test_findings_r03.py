"""What the findings of the third round were about, small."""

import random
import time
import tracemalloc

import numpy as np
from conftest import DATA
from oracle import connect, same
from pyspark.sql import functions as F

from trackloom.functions import cameras
from trackloom.operators import graph, lidar, mapping, matching, minimal, stats
from trackloom.operators import solvers as sv
from trackloom.plans import base, registry
from trackloom.plans.adapters import view
from trackloom.sources import exports, model_text


def test_rounds_as_the_sql_does(spark):
    near = [x for k in range(1, 380001, 7) if (x := float(f"{k // 10**6 + 8}.{k % 10**6:06d}5")) * 1e6 % 1 != 0.5]
    rows = spark.createDataFrame([(x,) for x in [*near[:500], float("nan"), float("inf"), 1.7e308, -2.5e-6, None]], "x double")
    con = connect(f"{DATA}/sf0.001")
    con.register("given", rows.toArrow())
    same(base.rounded(rows), "SELECT round(x, 6) AS x FROM given", con, 500)


def test_cells_on_the_edge_of_a_view(spark):
    images = view(spark, f"{DATA}/sf0.1", "images").filter("image_id IN (33, 93, 118)").join(view(spark, f"{DATA}/sf0.1", "cameras"), "camera_id")
    cells = spark.createDataFrame([(0, 0, 2), (0, 0, 9), (0, 0, 4)], "kx long, ky long, kz long")
    near = mapping.frustum_voxels(cells, lidar.view_planes(images, 40.0), 1.0, 1e-6)
    found = {tuple(r) for r in lidar.in_view(near, images, 40.0).select("image_id", "kx", "ky", "kz").collect()}
    assert {(33, 0, 0, 2), (93, 0, 0, 9), (118, 0, 0, 4)} <= found


def test_sift_text_scales_in_single_precision(spark):
    same(registry.QUERIES["s28_sift_text"](spark, f"{DATA}/sf0.1"), registry.ORACLES["s28_sift_text"], connect(f"{DATA}/sf0.1"), 2000)


def test_images_whose_words_weigh_nothing_find_themselves(spark):
    sigs = {1: (0, 255), 2: (1 << 40, 1 << 41), 3: ((1 << 30) - 1, (1 << 31) - 1)}
    p = spark.createDataFrame([(i, k, k, s) for i, two in sigs.items() for k, s in enumerate(two)], "image_id long, idx int, word_id long, sig long")
    w = matching.idf(p)
    best = matching.top_images(matching.image_scores(p, p, w, matching.image_norms(p, w), votes=True), 1)
    assert {(r.query_image, r.image_id) for r in best.collect()} == {(1, 1), (2, 2), (3, 3)}


def test_merged_position_sums_weighted_parts(spark):
    links = spark.createDataFrame([(560, 561)], "point_a long, point_b long")
    points = spark.createDataFrame([(560, 0.5, 0.0, 0.0, 17), (561, 0.5 + 1e-2, 0.0, 0.0, 15)], "point3d_id long, x double, y double, z double, len long")
    seen = spark.createDataFrame([(560,), (561,)], "point3d_id long")
    found = graph.merged_tracks(links, points, seen, F.lit(0.0), 2.0).select(base.round_to(F.col("mx")).alias("mx")).first()
    assert found.mx == 0.504687


def test_shared_points_shuffle_lists_not_pairs(spark):
    tracks = spark.createDataFrame([(p, i) for p in (1, 2, 3) for i in (5, 6, 7)] + [(4, 5), (4, 8), (4, 8), (None, 5), (None, 6)], "point3d_id long, image_id long")
    found = stats.shared_points(tracks)
    assert {tuple(r) for r in found.collect()} == {(5, 6, 3), (5, 7, 3), (6, 7, 3), (5, 8, 2)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "image_id2" not in " ".join(line for line in plan.splitlines() if "Exchange" in line)


def test_hough_votes_are_dealt_once(spark):
    votes = spark.createDataFrame([(1, 2, 0, 0, 0, 0), (1, 2, 0, 0, 0, 0), (1, 2, 1, 1, 1, 1), (1, 2, 3, 3, 3, 3), (1, 3, 5, 5, 5, 3)], "query_image long, image_id long, bx int, by int, bs int, ba int")
    found = matching.hough_bins(votes, 3, 2)
    assert {(r.image_id, r.bx, r.n, r.score, r["rank"]) for r in found.collect()} == {(2, 0, 2, 4.5, 1), (2, 1, 1, 3.5, 2), (3, 5, 1, 1.75, 1)}
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def _peak(call):
    tracemalloc.start()
    out = call()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most


def test_homography_of_many_matches_holds_no_square():
    x = np.random.default_rng(0).random((4000, 2))
    h = np.array([[1.1, 0.05, 0.3], [-0.05, 1.05, -0.1], [0.01, 0.02, 1.0]])
    y = sv.homogeneous(x) @ h.T
    found, most = _peak(lambda: sv.homography(x, y[:, :2] / y[:, 2:]))
    assert np.allclose(found / found[2, 2], h) and most < 20e6
    assert np.allclose(sv.right_vectors(np.eye(3, 9)) @ sv.right_vectors(np.eye(3, 9)).T, np.eye(9))


def test_models_meet_the_rows_a_few_at_a_time():
    rng = np.random.default_rng(0)
    world = rng.random((30000, 3)) * 4 + [0, 0, 4]
    r, t = sv.rotated_by(np.array([0.0, 0.1, 0.0])), np.array([1.0, 0.2, 0.1])
    other = world @ r.T + t
    a, b = world[:, :2] / world[:, 2:], other[:, :2] / other[:, 2:]
    b[::6] += 0.3
    (e, mask), most = _peak(lambda: minimal.robust_essential(a, b, 1e-4))
    assert (sv.sampson(e, a, b)[mask] < 1e-8).all() and mask.sum() >= 25000 and most < 300e6


def test_prints_decimals_as_the_sql_does(spark):
    ties = [float(f"{s}{k % 900}.{k * 7919 % 10**6:06d}5") for k in range(400) for s in ("", "-")]
    cells = [*ties, 0.5e-6, 2.5e-6, 1e-300, -0.0, 1.0, 3.9e9, 2.0**-20, 3 * 2.0**-7, 1.5]
    rows = spark.createDataFrame([(x,) for x in cells], "x double")
    con = connect(f"{DATA}/sf0.001")
    con.register("given", rows.toArrow())
    same(rows.select(exports._format("%f", "x").alias("x")), "SELECT printf('%.6f', x) AS x FROM given", con, 800)


def test_pixels_lead_back_to_rays_over_arrays(spark):
    rows = spark.createDataFrame([(0.1, -0.2), (0.0, 0.0), (0.4, 0.3), (None, 0.1)], "u double, v double")
    for model, own in (("FULL_OPENCV", [0.05, -0.02, 0.001, 0.002, 0.01, 0.01, 0.005, 0.001]), ("THIN_PRISM_FISHEYE", [0.05, 0.01, 0.001, 0.002, 0.001, 0.001, 0.001, 0.002]), ("FOV", [0.8]), ("OPENCV", [0.1, -0.02, 0.001, 0.002])):
        params = [500.0, F.lit(510.0), 500.0, 400.0, *own]
        x, y = cameras.world_to_image(model, params, F.col("u"), F.col("v"))
        at = rows.select("u", "v", x.alias("x"), y.alias("y"))
        u, v = cameras.image_to_world(model, params, F.col("x"), F.col("y"))
        back = at.select("u", "v", u.alias("ru"), v.alias("rv"))
        assert "aggregate(" not in back._jdf.queryExecution().optimizedPlan().toString()
        found = back.collect()
        assert all(abs(r.u - r.ru) < 1e-5 and abs(r.v - r.rv) < 1e-5 for r in found if r.u is not None)
        assert [(r.ru, r.rv) for r in found if r.u is None] == [(None, None)]


def test_match_blocks_sort_no_lines_in_one_task(spark):
    text = [f"a{k} b{k}|" + "|".join(f"{i} {i + k}" for i in range(k % 4)) for k in range(50)]
    lines = [x for block in text for x in [*block.split("|"), ""]]
    rows = spark.createDataFrame(list(enumerate(lines)), "at long, value string")
    found = model_text.match_blocks(rows, "at")
    assert {tuple(r) for r in found.collect()} == {(f"a{k}", f"b{k}", i, i + k) for k in range(50) for i in range(k % 4)}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange SinglePartition") <= 1  # the counts of ranges


def _plainly_once(rows):
    """The rule of one-to-one matches, word by word."""
    by, taken, out = {}, set(), []
    for i, d, j in rows:
        by.setdefault(i, []).append((d, j))
    while by:
        i = min(by, key=lambda k: (len([1 for _, j in by[k] if j not in taken]) or 1 << 30, k))
        left = [(d, j) for d, j in by.pop(i) if j not in taken]
        if left:
            taken.add(min(left)[1])
            out.append((i, min(left)[1], min(left)[0]))
    return out


def test_one_to_one_of_many_pairs_and_of_a_large_one(spark):
    rng = random.Random(3)
    groups = {p: [(rng.randrange(8), float(rng.randrange(4)), rng.randrange(8)) for _ in range(rng.randrange(1, 20))] for p in range(300)}
    rows = spark.createDataFrame([(p, i, j, d) for p, g in groups.items() for i, d, j in g], "pair long, idx1 int, idx2 int, distance double")
    found = {tuple(r) for r in matching.one_to_one(rows).collect()}
    assert found == {(p, *m) for p, g in groups.items() for m in _plainly_once(g)}
    large = [(i, 0.0, i + k) for i in range(20000) for k in (0, 1)]
    start = time.time()
    assert len(matching.chosen_once(large)) == 20000 and time.time() - start < 5


def test_image_lines_are_numbered_by_ranges(spark):
    lines = [x for k in range(40) for x in (f"{k} 1 0 0 0 {k} 0 0 1 name {k}", f"{k}.5 2 {k} 3 4 -1")]
    images, points = model_text.read_images(spark.createDataFrame(list(enumerate(lines)), "at long, value string"), "at")
    assert {(r.image_id, r.tx, r.name) for r in images.collect()} == {(k, float(k), f"name {k}") for k in range(40)}
    assert {(r.image_id, r.idx, r.x, r.point3d_id) for r in points.collect()} == {x for k in range(40) for x in ((k, 0, k + 0.5, k), (k, 1, 3.0, None))}
    plan = images._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    window = [x for x in plan.splitlines() if "row_number" in x]
    assert window and all("_range" in x for x in window)


def test_nearest_lidar_points_meet_by_cell_without_broadcast(spark):
    rng = np.random.default_rng(5)
    cloud = np.concatenate([np.round(rng.random((3000, 3)) * 4 - 2, 1), np.zeros((2000, 3))])  # many ties, and copies of one place
    asked = np.concatenate([np.round(rng.random((300, 3)) * 5 - 2.5, 1), [[90.0, 0.0, 0.0], [0.0, 0.0, 0.0]]])
    targets = spark.createDataFrame([(7000 - i, *map(float, p), 0.0, 1.0, 0.0) for i, p in enumerate(cloud)], "lidar_id long, x double, y double, z double, nx double, ny double, nz double")
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(asked)], "point3d_id long, x double, y double, z double")
    found = lidar.nearest_within(points, targets, 0.75)
    want = {}
    for i, p in enumerate(asked):
        d = np.sqrt((p[0] - cloud[:, 0]) ** 2 + (p[1] - cloud[:, 1]) ** 2 + (p[2] - cloud[:, 2]) ** 2)
        best = min((float(x), 7000 - k) for k, x in enumerate(d))
        if best[0] <= 0.75:
            want[i] = best
    assert {r.point3d_id: (r.dist, r.lidar_id) for r in found.collect()} == want and len(want) > 200
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def _seen_at(spark, n=40, images=9):
    rng = np.random.default_rng(2)
    centre, world = rng.random((images, 3)), rng.random((n, 3)) * 5
    rows = [(p, int(i), *map(float, centre[i]), *map(float, world[p]), float(rng.random() * 4 - 1)) for p in range(n) for i in rng.permutation(images)[: p % images]]
    return spark.createDataFrame(rows, "point3d_id long, image_id long, ox double, oy double, oz double, x double, y double, z double, depth double").repartition(3), rows


def _by_pair(rows, value):
    out = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1]:
                out.setdefault((a[1], b[1]), []).append(value(a, b))
    return out


def test_pair_angles_and_cheirality_deal_lists(spark, monkeypatch):
    monkeypatch.setattr(stats, "PAIR_BLOCK", 5)
    seen, rows = _seen_at(spark)

    def angle(a, b):
        u, v = np.array(a[5:8]) - a[2:5], np.array(a[5:8]) - b[2:5]
        t = np.arccos(np.clip(u @ v / np.linalg.norm(u) / np.linalg.norm(v), -1, 1))
        return min(t, np.pi - t)

    angles = _by_pair(rows, angle)
    found = stats.pair_angles(seen, 75)
    got = {(r.image_id1, r.image_id2): (r.shared, r.angle) for r in found.collect()}
    assert got.keys() == angles.keys()
    assert all(got[k][0] == len(v) and abs(got[k][1] - sorted(v)[int(0.75 * (len(v) - 1) + 0.5)]) < 1e-9 for k, v in angles.items())
    base = lambda a, b: float(np.linalg.norm(np.subtract(a[2:5], b[2:5])))
    front = _by_pair(rows, lambda a, b: (base(a, b), all(2.3e-16 < s[8] < 3 * base(a, b) for s in (a, b))))
    both = stats.cheirality(seen, 3.0)
    assert {(r.image_id1, r.image_id2): (round(r.baseline, 9), r.in_front) for r in both.collect()} == {k: (round(v[0][0], 9), sum(x[1] for x in v)) for k, v in front.items()}
    for df in (found, both):
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_visible_images_come_from_pairs_not_edges(spark):
    found = registry.QUERIES["v07_visibility_lists"](spark, f"{DATA}/sf0.001")
    assert "dst" not in found._jdf.queryExecution().executedPlan().toString()
    same(found, registry.ORACLES["v07_visibility_lists"], connect(f"{DATA}/sf0.001"), 10)


def test_best_association_of_classes_makes_no_table_of_candidates(spark):
    seen = [(p, i, p % 3) for p in range(40) for i in range(1 + p % 5, 30, 1 + p % 7)]
    cloud = [(k * 7 + 1, k % 4) for k in range(90)]
    rows = spark.createDataFrame([(p, i, k, i * 37 % 11) for p, i, k in seen], "point3d_id long, image_id long, key int, a long")
    there = spark.createDataFrame([(i, k, i * 5 % 11) for i, k in cloud], "lidar_id long, key int, b long")
    found = mapping.best_of_classes(rows, there, lambda a, b: (a + b) % 11 / 11 - 0.3)
    score = lambda i, j: abs((i * 37 % 11 + j * 5 % 11) % 11 / 11 - 0.3)
    want = {}
    for p, i, k in seen:
        want[p] = min(want.get(p, (9, 0, 0)), *((score(i, j), i, j) for j, q in cloud if q == k))
    assert {(r.point3d_id, r.cosine, r.image_id, r.lidar_id) for r in found.collect()} == {(p, *m) for p, m in want.items()}
    plan = registry.QUERIES["j21_best_association"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "% 50000" in plan


def test_matches_meet_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(matching, "MATCH_BLOCK", 16)
    rng = np.random.default_rng(4)
    sides = [[(p, int(i), [float(v) for v in np.round(rng.normal(size=8), 1)]) for p in (1, 2) for i in rng.permutation(70 if p == 1 else 9)] for _ in range(2)]
    sides[1][3] = (*sides[1][3][:2], sides[1][5][2])  # two alike
    a, b = (spark.createDataFrame([*s, (3, 1, None), (3, 2, [1.0])], "pair int, idx int, descriptor array<double>") for s in sides)

    def plainly(met):
        out = {}
        for p, i, x in sides[0]:
            dots = sorted((-sum(u * v for u, v in zip(x, y, strict=True)), j) for q, j, y in sides[1] if q == p and met(x, y))
            dots = [d for d in dots if d[0] < 0]
            if dots:
                best, second = (float(np.arccos(min(-d, 1.0))) for d in (dots[0][0], dots[1][0] if len(dots) > 1 else 0.0))
                if best <= 1.3 and best < 0.98 * second:
                    out[p, i] = dots[0][1]
        return out

    found = matching.best_matches(a, b, 0.98, 1.3)
    assert {(r.pair, r.idx1): r.idx2 for r in found.collect() if r.pair < 3} == plainly(lambda x, y: True)
    near = matching.approximate_matches(a, b, 0.98, 1.3, bands=4)
    assert {(r.pair, r.idx1): r.idx2 for r in near.collect() if r.pair < 3} == plainly(lambda x, y: any([v > 0 for v in x[k : k + 2]] == [v > 0 for v in y[k : k + 2]] for k in (0, 2, 4, 6)))
    plan = registry.QUERIES["j08_ratio_match"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan


def test_pairs_are_counted_once(spark):
    for name in ("j07_route", "m01_initial_pairs"):
        found = registry.QUERIES[name](spark, f"{DATA}/sf0.001")
        assert "lineitem" not in found._jdf.queryExecution().optimizedPlan().toString()  # the counts are stored before
        same(found, registry.ORACLES[name], connect(f"{DATA}/sf0.001"), 10)


def _written(spark, monkeypatch):
    """Row counts and columns of all tables that cuts writes from here on."""
    from trackloom.operators import cuts

    seen, plain = [], cuts.cut

    def counted(df):
        out = plain(df)
        seen.append((tuple(out.columns), out.count()))
        return out

    monkeypatch.setattr(cuts, "cut", counted)
    return seen


def test_rounds_of_a_least_cut_write_no_arcs(spark, monkeypatch):
    from trackloom.operators import cuts

    seen = _written(spark, monkeypatch)
    beside = [(a, b, 1.0) for a in range(10, 26) for b in range(10, 26) if a != b]
    flow, side = cuts.st_cut(spark.createDataFrame([*beside, (0, 1, 5.0), (1, 2, 3.0)], "image_id1 long, image_id2 long, weight double"), 0, 2)
    assert (flow, {r.image_id for r in side.collect()}) == (3.0, {0, 1, *range(10, 26)})
    assert sum(n >= len(beside) for _, n in seen) == 1


def test_a_normalised_cut_stores_its_edges_once(spark, monkeypatch):
    from trackloom.operators import cuts

    seen = _written(spark, monkeypatch)
    rows = [(a, b, 8.0 if a % 2 == b % 2 else 1.0) for a in range(1, 25) for b in range(a + 1, 25)]
    found = cuts.normalised_cut(spark.createDataFrame(rows, "image_id1 long, image_id2 long, weight double")).collect()
    assert {(r.image_id, r.part) for r in found} == {(i, 1 - i % 2) for i in range(1, 25)}
    assert [n for _, n in seen if n > 24] == [len(rows)]


def test_pairs_are_not_shuffled_to_meet_their_poses(spark):
    from trackloom.plans import poses

    d = f"{DATA}/sf0.001"
    plan = poses._image_pairs(spark, d)._jdf.queryExecution().executedPlan().toString()
    own = view(spark, d, "pairs")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == own.count("Exchange hashpartitioning")
