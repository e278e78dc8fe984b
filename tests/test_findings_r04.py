"""What the findings of the fourth round were about, small."""

import pathlib
import time

import duckdb
import numpy as np
from conftest import DATA
from oracle import connect, same
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import geometry as geo
from trackloom.functions import libm
from trackloom.operators import estimation as est
from trackloom.operators import minimal, partition, ranking, rounds
from trackloom.operators import solvers as sv
from trackloom.plans import registry


def test_last_bits_are_those_of_the_sql(spark):
    """sine, cosine and the square by power as DuckDB has them, and with them a sum of squares."""
    x = F.col("id") * 0.05
    turns = spark.range(3000).select("id", libm.cos(x).alias("c"), libm.sin(x).alias("s")).toPandas()
    con = duckdb.connect()
    con.register("turns", turns)
    found = con.execute("SELECT count(*) FILTER (c <> cos(5e-2*id)), count(*) FILTER (s <> sin(5e-2*id)), count(*) FROM turns").fetchall()[0]
    assert found == (0, 0, 3000)
    e2 = lambda *square: geo.squared_error((F.cos(x) * 9, F.sin(x) * 9), (F.lit(1.0), F.lit(-2.0)), F.lit(1.0), *square)
    sums = spark.range(3000).select((F.cos(x) * 9).alias("px"), (F.sin(x) * 9).alias("py"), e2().alias("plain"), e2(libm.square).alias("own")).toPandas()
    con.register("sums", sums)
    assert len(sums) == len(turns)
    off = lambda c: con.execute(f"SELECT count(*) FROM sums WHERE {c} <> power(px-1, 2)+power(py+2, 2)").fetchall()[0][0]
    assert off("own") == 0 < off("plain")


def test_odd_values_of_the_library_functions(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (1e200,), (-0.0,)], "x double")
    found = [r[0] for r in rows.select(libm.square(F.col("x"))).collect()]
    assert found[0] is None and found[1] != found[1] and found[2:] == [float("inf"), float("inf"), 0.0]


def test_an_initial_pair_of_few_matches(spark):
    """a pair of four matches has a pose under which they project where they were seen; the more there are, the more are looked at."""
    rng = np.random.default_rng(3)
    rows = []
    for pair, n in ((1, 4), (2, 5), (3, 3), (4, 30), (5, 1)):
        p = np.column_stack([rng.uniform(-2, 2, (n, 2)), rng.uniform(4, 9, n)])
        r, t = sv.rotated_by(np.array([0.05, -0.2, 0.1 * pair])), np.array([1.0, 0.3, -0.4])
        q = p @ r.T + t
        rows += [(pair, *map(float, x)) for x in np.column_stack([p[:, :2] / p[:, 2:], q[:, :2] / q[:, 2:]])]
    found = {r["pair"]: r for r in est.initial_pairs(spark.createDataFrame(rows, "pair long, x1 double, y1 double, x2 double, y2 double"), 1e-4).collect()}
    assert [found[k]["matches"] for k in sorted(found)] == [4, 5, 3, 30, 1]
    assert all(r["worst"] is not None and r["worst"] < 1e-6 and r["ahead"] >= 1 for r in found.values())
    assert found[4]["ahead"] == 30 and found[1]["ahead"] == 4


def test_overlap_is_not_broadcast(spark):
    """the ranks of all pairs stay with the executors, though Spark takes them for small."""
    images = spark.createDataFrame([(k, f"i{k}") for k in range(1, 7)], "image_id long, name string")
    overlap = spark.createDataFrame([(a, b, (b - a) % 6) for a in range(1, 7) for b in range(1, 7) if a != b], "image_id long, other_id long, rank int").withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy("rank")))
    config = spark.createDataFrame([("i2", "__auto__, 2"), ("i3", "i1, i5")], "name string, spec string")
    found = ranking.stereo_sources(config, images, overlap)
    assert sorted(map(tuple, found.collect())) == [(2, 3), (2, 4), (3, 1), (3, 5)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan


def test_local_bundles_hold_no_group(spark, monkeypatch):
    """F8: the groups are adjusted as tables; no task takes a whole group."""
    monkeypatch.setattr(DataFrame, "groupBy", lambda self, *cols, own=DataFrame.groupBy: _NoGroups(own(self, *cols)))
    same(registry.QUERIES["m08_local_bundles"](spark, f"{DATA}/sf0.001"), registry.ORACLES["m08_local_bundles"], connect(f"{DATA}/sf0.001"), 4)


class _NoGroups:
    def __init__(self, grouped):
        self.agg, self.count = grouped.agg, grouped.count


def test_clusters_are_split_a_chunk_at_a_time(spark, monkeypatch):
    """no task holds all edges of a cluster; the parts are those of the greedy rule over all of them."""
    rng = np.random.default_rng(1)
    sets = {p: [(int(a), int(b), float(rng.integers(1, 6))) for a in range(1, n) for b in range(a + 1, n + 1) if rng.random() < 0.4] for p, n in (("0", 40), ("1", 9), ("2", 2))}
    sets["2"] = [(1, 2, 1.0)]
    sets["3"] = [(1, k, 1.0) for k in range(2, 30)]
    monkeypatch.setattr(partition, "CHUNK", 16)
    rows = spark.createDataFrame([(p, a + 1000, b + 1000, w) for p, own in sets.items() for a, b, w in own], "path string, image_id1 long, image_id2 long, weight double")
    found = partition.split_clusters(rows, 2).collect()
    for p, own in sets.items():
        want = partition.greedy_clusters(own, 2)
        place = {r: k for k, r in enumerate(sorted(set(want.values())))}
        assert {r["image_id"] - 1000: r["part"] for r in found if r["path"] == p} == {i: place[r] for i, r in want.items()}


def test_tracks_are_triangulated_together(spark, monkeypatch):
    """many tracks a batch, of any number of views; one without enough views has no position."""
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for track, n in ((1, 5), (2, 5), (3, 1), (4, 14), (5, 2)):
        point = rng.uniform(-1, 1, 3) + [0, 0, 8]
        want[track] = point if n > 1 else None
        for k in range(n):
            t = np.array([k * 0.5, -k * 0.2, 0.1 * k])
            q = np.array([np.cos(0.02 * k), 0, 0, np.sin(0.02 * k)])
            seen = point @ sv.rotated_by(np.array([0, 0, 0.04 * k])).T + t
            off = 0.3 if n > 4 and k == n - 1 else 0.0
            rows.append((track, *map(float, (seen[0] / seen[2] + off, seen[1] / seen[2], *q, *t))))
    seen = spark.createDataFrame(rows, "point3d_id long, x double, y double, qw double, qx double, qy double, qz double, tx double, ty double, tz double")
    monkeypatch.setattr(DataFrame, "groupBy", lambda self, *cols, own=DataFrame.groupBy: _NoGroups(own(self, *cols)))
    found = {r["point3d_id"]: r for r in est.triangulated_tracks(seen, 1e-3).collect()}
    for track, point in want.items():
        got = [found[track][c] for c in "xyz"]
        assert got == [None] * 3 if point is None else np.allclose(got, point, atol=1e-6)
    assert {k: (r["views"], r["inliers"]) for k, r in found.items()} == {1: (5, 4), 2: (5, 4), 3: (1, 0), 4: (14, 13), 5: (2, 2)}


def test_a_focal_factor_that_cannot_win_ends_early(monkeypatch):
    """no more lots than a pose with more inliers than another factor's would need."""
    rng = np.random.default_rng(7)
    p = np.column_stack([rng.uniform(-3, 3, (60, 2)), rng.uniform(4, 12, 60)])
    x = p[:, :2] / p[:, 2:] * 1.25
    drawn = []
    lots = minimal._lots
    monkeypatch.setattr(minimal, "_lots", lambda *a: drawn.append(1) or lots(*a))
    assert minimal.robust_pose(p, x / 1.25, 1e-3)[1].sum() == 60
    first = len(drawn)
    minimal.robust_pose(p, x / 0.8, 1e-3, beat=60)
    assert first == 1 and len(drawn) == 2


def test_a_cut_leaves_no_shuffle(spark):
    """the files of the shuffles behind a stored table are deleted, not kept until the driver's memory is short."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {p for d in manager.localDirsString() for p in pathlib.Path(d).rglob("shuffle_*.data")}
    before = files()
    found = rounds.cut(spark.range(100000).repartition(4, "id").groupBy((F.col("id") % 1000).alias("k")).count())
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and found.count() == 1000
