import numpy as np
import pytest

from trackloom.operators import frames
from trackloom.operators import solvers as sv


def directions(seed, rotation, n=600, off=0.33):
    """Axes of a turned frame with jitter and random signs, gravity most often, and a share of random ones."""
    rng = np.random.default_rng(seed)
    axes = rotation.T[rng.choice([0, 1, 1, 2], n)] * rng.choice([-1, 1], n)[:, None] + 0.01 * rng.standard_normal((n, 3))
    bad = rng.random(n) < off
    return np.where(bad[:, None], rng.standard_normal((n, 3)), axes * rng.uniform(0.5, 3, n)[:, None])


@pytest.mark.parametrize("seed", range(3))
def test_a_known_turn_comes_back(spark, seed):
    rotation = sv.rotated_by(np.random.default_rng(seed).uniform(-1, 1, 3))
    df = spark.createDataFrame([tuple(map(float, d)) for d in directions(seed, rotation)], "dx double, dy double, dz double")
    gravity, weight = frames.dominant_axis(df)
    assert abs(gravity @ rotation.T[1]) > np.cos(np.radians(0.3)) and weight > 170
    r = frames.frame(df, gravity)
    assert np.allclose(r @ r.T, np.eye(3), atol=1e-9)
    near = np.abs(r @ rotation)  # the level axes may come in either order
    assert near.max(0).min() > np.cos(np.radians(0.5)) and near.max(1).min() > np.cos(np.radians(0.5))


def test_signed_weighted_and_odd_directions(spark):
    rows = [(0.0, 1.0, 0.0, 1.0)] * 5 + [(0.0, -1.0, 0.0, 1.0)] * 4 + [(0.0, 0.0, 0.0, 9.0), (None, 1.0, 0.0, 9.0), (1.0, 0.0, 0.0, -9.0), (1.0, 0.0, 0.0, 3.0)]
    df = spark.createDataFrame(rows, "dx double, dy double, dz double, w double")
    axis, weight = frames.dominant_axis(df, signed=True, weight="w")
    assert np.allclose(axis, [0, 1, 0]) and weight == 5
    axis, weight = frames.dominant_axis(df, weight="w")
    assert np.allclose(axis, [0, 1, 0]) and weight == 9
    assert frames.dominant_axis(df.limit(0)) == (None, 0.0) and frames.frame(df.limit(0), np.array([0.0, 1.0, 0.0])) is None
