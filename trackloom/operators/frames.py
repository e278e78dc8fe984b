"""Frames of a model from directions: gravity, and horizontal axes at right angles to it.

Directions vote for cells on the faces of a cube around the origin, on two grids of
which one lies half a cell beside the other, so that no axis is cut by all borders.
The cell with most weight gives a first axis; it is refined on the directions about
it, by the sums of their products, while the angle is narrowed. Only those few sums
and one cell come to the driver, whatever the number of directions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.rounds import cut, drop

D = ("dx", "dy", "dz")
PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]


def _unit(directions: DataFrame, weight: str | None) -> DataFrame:
    """Unit directions with a weight; null and zero ones are left out."""
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in D), F.lit(0.0)))
    rows = directions.select(*D, (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w")).withColumn("n", length).filter("n > 1e-12 AND w > 0")
    return rows.select(*((F.col(c) / F.col("n")).alias(c) for c in D), "w")


def _voted(unit: DataFrame, cells: int, signed: bool) -> np.ndarray | None:
    """The mean direction of the cell with most weight."""
    big = F.greatest(*(F.abs(c) for c in D))
    face = F.when(F.abs("dx") == big, 0).when(F.abs("dy") == big, 1).otherwise(2)
    own = F.when(face == 0, F.col("dx")).when(face == 1, F.col("dy")).otherwise(F.col("dz"))
    rows = unit.withColumn("face", face).withColumn("own", own)
    sign = F.when(F.col("own") < 0, -1.0).otherwise(1.0)
    # An axis has no sign: it is turned so that its largest part is positive.
    turned = rows.select("w", "face", *((F.col(c) * (F.lit(1.0) if signed else sign)).alias(c) for c in D), (sign if signed else F.lit(1.0)).alias("side"))
    u, v = F.when(F.col("face") == 0, F.col("dy")).otherwise(F.col("dx")), F.when(F.col("face") == 2, F.col("dy")).otherwise(F.col("dz"))
    top = F.greatest(*(F.abs(c) for c in D))
    grids = F.explode(F.array(F.lit(0.0), F.lit(0.5))).alias("shift")
    placed = turned.select("*", (u / top).alias("u"), (v / top).alias("v"), grids)
    cell = lambda c: F.floor((F.col(c) + 1) / 2 * cells + F.col("shift")).cast("int")
    sums = placed.groupBy("shift", "face", "side", cell("u").alias("cu"), cell("v").alias("cv")).agg(F.sum("w").alias("w"), *(F.sum(F.col(c) * F.col("w")).alias(c) for c in D))
    best = sums.orderBy(F.desc("w"), "shift", "face", "side", "cu", "cv").first()
    return None if best is None else np.array([best[c] for c in D]) / np.linalg.norm([best[c] for c in D])


def dominant_axis(directions: DataFrame, degrees: float = 5.0, cells: int = 16, rounds: int = 5, signed: bool = False, weight: str | None = None) -> tuple[np.ndarray | None, float]:
    """The axis (dx, dy, dz) that most directions lie about, and the weight of those within ``degrees``.

    Axes have no sign unless ``signed``. No direction, no axis. Directions far from it do not pull at it: from the
    second round on only those within ``degrees`` count."""
    unit = cut(_unit(directions, weight))  # it is read once a round
    axis = _voted(unit, cells, signed)
    if axis is None:
        drop(unit)
        return None, 0.0
    total = 0.0
    for k in range(rounds):
        within = np.cos(np.radians(max(degrees, 4 * degrees / (k + 1)) if k < 2 else degrees))
        cos = sum((F.col(c) * float(a) for c, a in zip(D, axis, strict=True)), F.lit(0.0))
        near = unit.filter((cos if signed else F.abs(cos)) >= float(within))
        r = near.agg(F.sum("w").alias("w"), *(F.sum(F.col(D[i]) * F.col(D[j]) * F.col("w")).alias(f"m{i}{j}") for i, j in PAIRS)).first()
        if not r["w"]:
            break
        m = np.zeros((3, 3))
        for i, j in PAIRS:
            m[i, j] = m[j, i] = r[f"m{i}{j}"]
        found = np.linalg.eigh(m)[1][:, -1]
        axis, total = found * (1 if found @ axis >= 0 else -1), float(r["w"])
    drop(unit)
    if not signed:
        axis = axis * (1 if axis[np.abs(axis).argmax()] > 0 else -1)
    return axis, total


def frame(directions: DataFrame, gravity: np.ndarray, degrees: float = 5.0, weight: str | None = None) -> np.ndarray | None:
    """Rows of the rotation into a frame whose second axis is gravity and whose first is the axis that most of the
    level directions lie about: those within ``degrees`` of a right angle to gravity, laid level. Directions of the
    two level axes count for one: they are at right angles."""
    g = gravity / np.linalg.norm(gravity)
    side = np.cross(g, np.eye(3)[np.abs(g).argmin()])
    side /= np.linalg.norm(side)
    other = np.cross(g, side)
    dot = lambda a: sum((F.col(c) * float(v) for c, v in zip(D, a, strict=True)), F.lit(0.0))
    level = _unit(directions, weight).filter(F.abs(dot(g)) <= float(np.sin(np.radians(degrees))))
    # Four times the angle about gravity is the same for all four ways of the two axes.
    angle = 4 * F.atan2(dot(other), dot(side))
    found, count = dominant_axis(level.select(F.cos(angle).alias("dx"), F.sin(angle).alias("dy"), F.lit(0.0).alias("dz"), "w"), 4 * degrees, signed=True, weight="w")
    if found is None or not count:
        return None
    turn = np.arctan2(found[1], found[0]) / 4
    first = np.cos(turn) * side + np.sin(turn) * other
    return np.stack([first, g, np.cross(first, g)])
