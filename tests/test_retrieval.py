import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import vocabulary, voting

DESCRIPTOR = "image_id long, idx int, descriptor array<double>"


def described(spark, x, images=5):
    return spark.createDataFrame([(k % images, k // images, [float(v) for v in row]) for k, row in enumerate(x)], DESCRIPTOR)


def test_tree_words_are_those_of_a_plain_descent(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((9, 8)) * 5
    x = np.repeat(centres, 20, axis=0) + 0.05 * rng.standard_normal((180, 8))
    df = described(spark, x)
    nodes = vocabulary.train_tree(df, branching=3, depth=2, rounds=4).collect()
    tree = {}
    for n in nodes:
        tree.setdefault(n.parent, []).append((n.node, np.array(n.centre)))
    assert sum(n.n for n in nodes if n.level == 1) == len(x) == sum(n.n for n in nodes if n.level == 2)
    table = spark.createDataFrame(nodes)
    words = {}
    for r in vocabulary.descend(df, table).collect():
        at = 0
        while at in tree:
            at, centre = min(((k, c) for k, c in tree[at]), key=lambda kc: ((kc[1] - x[r.idx * 5 + r.image_id]) ** 2).sum())
        assert r.word_id == at and r.d2 == pytest.approx(((centre - x[r.idx * 5 + r.image_id]) ** 2).sum())
        words.setdefault(at, set()).add((r.idx * 5 + r.image_id) // 20)
    # A wide beam looks at all leaves.
    leaves = [(k, c) for n in nodes if n.level == 2 for k, c in [(n.node, np.array(n.centre))]]
    for r in vocabulary.descend(df, table, beam=9).collect():
        assert r.d2 == pytest.approx(min(((c - x[r.idx * 5 + r.image_id]) ** 2).sum() for _, c in leaves))
    plan = vocabulary.descend(df, table)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_index_is_stored_extended_and_found_again(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 64))
    df, folder = described(spark, x, 10), f"file://{tmp_path}/index"
    some = df.filter("image_id < 6")
    first = vocabulary.create_index(spark, folder, some, vocabulary.train_tree(some, 4, 2, 2))
    vocabulary.extend_index(spark, folder, df)
    index = vocabulary.open_index(spark, folder, check=True)
    assert index["postings"].count() == 200 and vocabulary.open_index(spark, folder, first)["postings"].count() == 120
    best = vocabulary.query_index(index, df, 1).collect()
    assert {(r.query_image, r.image_id) for r in best} == {(i, i) for i in range(10)}
    vocabulary.remove_images(spark, folder, spark.createDataFrame([(3,), (99,)], "image_id long"))
    left = vocabulary.open_index(spark, folder)["norms"]
    assert {r.image_id for r in left.collect()} == set(range(10)) - {3}


def test_odd_descriptors(spark):
    rows = [(0, 0, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (1, 0, [1.0, 0.0]), (1, 1, None), (2, 0, [0.0, None])]
    df = spark.createDataFrame(rows, DESCRIPTOR)
    nodes = vocabulary.train_tree(df, 4, 2, 2)
    assert [(r.level, r.n) for r in nodes.orderBy("level").collect()] == [(1, 3), (2, 3)]  # one different descriptor, one word
    assert vocabulary.descend(df.limit(3), nodes).select("word_id").distinct().count() == 1
    none = vocabulary.train_tree(df.limit(0), 4, 2, 2)
    assert none.count() == 0 and vocabulary.descend(df, none).count() == 0


def planted(spark, pairs, seed=0):
    """Features of pairs and their images under a known transformation; a third has none, and some have a second candidate."""
    rng, rows = np.random.default_rng(seed), []
    for pair, (matrix, move) in pairs.items():
        scale, turn = np.sqrt(abs(np.linalg.det(matrix))), np.arctan2(matrix[1, 0], matrix[0, 0])
        for k in range(60):
            p = rng.uniform(0, 800, 2)
            q = matrix @ p + move if k % 3 else rng.uniform(0, 800, 2)
            rows.append((pair, k, *map(float, p), 2.0, 0.3, 1000 + k, *map(float, q), float(2.0 * scale), float(0.3 + turn)))
            if k % 5 == 0:
                rows.append((pair, k, *map(float, p), 2.0, 0.3, 2000 + k, *map(float, rng.uniform(0, 800, 2)), 3.0, 1.0))
    return spark.createDataFrame(rows, "pair long, idx1 int, x1 double, y1 double, s1 double, o1 double, idx2 int, x2 double, y2 double, s2 double, o2 double")


def test_planted_transformations_are_verified(spark):
    c, s = np.cos(0.4), np.sin(0.4)
    pairs = {1: (1.3 * np.array([[c, -s], [s, c]]), np.array([30.0, -50.0])), 2: (np.array([[1.0, 0.06], [-0.04, 0.95]]), np.array([5.0, 9.0]))}
    found = {r.pair: r for r in voting.verified(planted(spark, pairs), voting.Options(error=36.0)).collect()}
    for pair, (matrix, move) in pairs.items():
        r = found[pair]
        assert 40 <= r.inliers <= 43 and r.cells <= r.inliers
        assert np.allclose([[r.a11, r.a12], [r.a21, r.a22]], matrix, atol=0.02) and np.allclose([r.tx, r.ty], move, atol=8)
    # The second is no similarity: refinement finds it exactly where no chance inlier disturbs it.
    assert np.allclose([found[2].a11, found[2].a12, found[2].a21, found[2].a22], pairs[2][0].ravel(), atol=5e-3)


def test_too_few_matches_and_odd_scales(spark):
    df = planted(spark, {1: (np.eye(2), np.zeros(2))})
    assert voting.verified(df.filter("idx1 < 3")).count() == 0 and voting.verified(df.limit(0)).count() == 0
    zero = df.withColumn("s1", F.when(F.col("idx1") % 2 == 0, 0.0).otherwise(F.col("s1")))
    assert voting.verified(zero, voting.Options(error=25.0)).first().inliers >= 15
    scores = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.9)], "query_image long, image_id long, score double")
    checked = spark.createDataFrame([(1, 2, 7)], "query_image long, image_id long, cells long")
    assert {(r.image_id, r.score) for r in voting.reranked(scores, checked).collect()} == {(2, 7.5), (3, 0.9)}
