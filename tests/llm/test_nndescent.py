import numpy as np
import pytest
from conftest import DATA

from trackloom.llm import nndescent, queries


def brute(ids, x, query, top):
    at = int(np.flatnonzero(ids == query)[0])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = unit @ unit[at]
    order = [i for i in np.lexsort((ids, -np.round(score, 12))) if ids[i] != query][:top]
    return [(int(ids[i]), float(score[i])) for i in order]


def by_query(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return found


@pytest.mark.parametrize(("sf", "least"), [("sf0.001", 0.99), ("sf0.1", 0.95)])
def test_recall(spark, sf, least):
    d = f"{DATA}/{sf}"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = by_query(queries.op3_nndescent(spark, d).collect())
    assert set(found) == {i for i in ids.tolist() if i % 50 == 0}
    hits = total = 0
    for query, own in found.items():
        want = brute(ids, x, query, 5)
        hits, total = hits + len({i for i, _ in own} & {i for i, _ in want}), total + 5
        scores = dict(brute(ids, x, query, len(ids)))
        assert all(abs(scores[i] - s) < 1e-12 for i, s in own)
        assert own == sorted(own, key=lambda p: (-p[1], p[0])) and len(own) == 5
    assert hits / total >= least


def test_odd_rows(spark):
    rng = np.random.default_rng(0)
    same = [0.5, 0.25, 1.0]
    rows = [(i, same) for i in range(0, 120)] + [(200 + i, rng.standard_normal(3).tolist()) for i in range(30)]
    rows += [(350, None), (400, []), (450, [0.0, 0.0, 0.0]), (500, [1.0, None, 2.0]), (550, [1.0, float("nan"), 0.0]), (600, [1.0, 2.0]), (None, same), (0, same)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    found = by_query(nndescent.nearest(spark, df).collect())
    assert set(found) == {0, 50, 100, 200}
    assert [i for i, _ in found[0]] == [1, 2, 3, 4, 5] and [i for i, _ in found[50]] == [0, 1, 2, 3, 4]
    few = spark.createDataFrame([(50, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert by_query(nndescent.nearest(spark, few).collect()) == {50: [(1, 0.0)]}
    assert nndescent.nearest(spark, few.limit(0)).count() == 0


def recall(spark, x, least_exact=1.0):
    """Of the walk against brute force; the exact way must find all."""
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for i in range(0, len(x), 50):
        score = unit @ unit[i]
        score[i] = -2
        want[i] = set(np.argpartition(-score, 5)[:5].tolist())
    share = lambda rows: np.mean([len(want[q] & {i for i, _ in own}) / 5 for q, own in by_query(rows).items()])
    return share(nndescent.nearest(spark, df).collect()), share(nndescent.exact_nearest(spark, df).collect())


@pytest.mark.parametrize("n", [4000, 9000])
def test_recall_beyond_one_seed_block(spark, n):
    rng = np.random.default_rng(n)
    centers = rng.standard_normal((40, 32))
    x = np.concatenate([rng.standard_normal((n // 2, 32)), centers[rng.integers(0, 40, n - n // 2)] + 0.4 * rng.standard_normal((n - n // 2, 32))])
    walk, exact = recall(spark, x)
    assert walk >= 0.9 and exact == 1.0


def test_recall_among_near_copies(spark):
    rng = np.random.default_rng(3)
    near = rng.standard_normal(64)
    x = np.concatenate([near + 5e-3 * rng.standard_normal((2000, 64)), rng.standard_normal((1000, 64))])
    walk, exact = recall(spark, x)
    assert walk >= 0.9 and exact >= 0.99


def test_exact_way_tells_the_nearest_copies_apart(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=48) + 1e-5 * rng.normal(size=(6000, 48))
    ids = np.arange(6000)
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    found = by_query(nndescent.exact_nearest(spark, rows, every=500).collect())
    assert set(found) == set(range(0, 6000, 500))
    wide = x.astype(np.longdouble)
    unit = wide / np.sqrt((wide * wide).sum(1, keepdims=True))
    for query, own in found.items():
        score = unit @ unit[query]
        score[query] = -2
        assert [i for i, _ in own] == np.argsort(-score)[:5].tolist()
        assert all(abs(float(score[i]) - s) < 1e-14 for i, s in own)


def test_lists_are_in_the_shared_folder_and_deleted(spark):
    import os

    from trackloom.llm._common import bucketed, shared_dir

    folder = shared_dir(spark).removeprefix("file://") + "/tables"
    with pytest.raises(RuntimeError, match="lost"), bucketed(spark, spark.range(10).toDF("node"), "node") as table:
        name = [n for n in os.listdir(folder) if n.startswith("trackloom_")]
        assert table.count() == 10 and len(name) == 1
        raise RuntimeError("lost")
    assert not [n for n in os.listdir(folder) if n.startswith("trackloom_")] and not spark.catalog.tableExists(name[0])
