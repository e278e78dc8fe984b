"""Robust estimation: trial counts, supports, decisions, and RANSAC by group."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trial_count(inliers: Column, samples: Column, least: int, confidence: float = 0.99, factor: float = 3.0) -> Column:
    """Trials after which an all-inlier sample is as sure as wanted."""
    ratio = inliers / samples
    miss = 1 - F.pow(ratio, F.lit(float(least)))
    safe = F.when((miss > 0) & (miss < 1), miss).otherwise(0.5)
    count = F.ceil(F.log(F.lit(1 - confidence)) / F.log(safe) * factor).cast("long")
    return F.when(miss <= 0, 1).when(miss >= 1, F.lit((1 << 63) - 1)).otherwise(count)


def inlier_support(residuals: DataFrame, keys: list[str], most: float) -> DataFrame:
    """Inlier count and residual sum of each model; more inliers win, then the smaller sum."""
    return residuals.groupBy(*keys).agg(F.count_if(F.col("r") <= most).alias("inliers"), F.coalesce(F.sum(F.when(F.col("r") <= most, F.col("r"))), F.lit(0.0)).alias("total"))


def truncated_support(residuals: DataFrame, keys: list[str], most: float) -> DataFrame:
    return residuals.groupBy(*keys).agg(F.sum(F.least("r", F.lit(most))).alias("score"))


def best_model(supports: DataFrame, group: str, model: str) -> DataFrame:
    best = F.min(F.struct((-F.col("inliers")).alias("i"), "total", model))
    return supports.groupBy(group).agg(best.alias("m")).select(group, F.col(f"m.{model}").alias(model), (-F.col("m.i")).alias("inliers"), "m.total")


def decision_threshold(bad: float, good: float, eval_time: float = 200.0, models: float = 1.0, rounds: int = 100) -> float:
    """Likelihood ratio from which a sequential test gives a model up: A = A0 + ln A."""
    gain = (1 - bad) * math.log((1 - bad) / (1 - good)) + bad * math.log(bad / good)
    start = found = eval_time * gain / models + 1
    for _ in range(rounds):
        then = start + math.log(found)
        if abs(then - found) < 1.5e-8:
            break
        found = then
    return found


def sequential_test(residuals: DataFrame, keys: list[str], order: str, most: float, bad: float = 0.01, good: float = 0.1, decision: float | None = None) -> DataFrame:
    """Each model's residuals (r) are looked at in their order until it is surely a bad one: whether it
    stands, the inliers met and the residuals looked at. The running counts are whole numbers, so the
    result depends on no order of sums. A model's residuals are sorted in one task."""
    limit = math.log(decision or decision_threshold(bad, good))
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ok = F.abs("r") <= most
    run = residuals.select(*keys, F.count_if(ok).over(so_far).alias("met"), F.count("*").over(so_far).alias("at"))
    ratio = F.col("met") * math.log(bad / good) + (F.col("at") - F.col("met")) * math.log((1 - bad) / (1 - good))
    ended = F.struct(F.when(ratio > limit, F.col("at")).alias("at"), "met")
    rows = run.groupBy(*keys).agg(F.min(F.when(ratio > limit, ended)).alias("out"), F.max(F.struct("at", "met")).alias("all"))
    return rows.select(*keys, F.col("out").isNull().alias("stands"), F.coalesce("out.met", "all.met").alias("inliers"), F.coalesce("out.at", "all.at").alias("looked_at"))


def calibrated_config(e: Column, f: Column, h: Column, least: int = 15, ef: float = 0.95, hr: float = 0.8) -> Column:
    """Two-view configuration from inlier counts: degenerate 1, calibrated 2,
    uncalibrated 3, planar or panoramic 6."""
    best_e = (e > ef * f) & (e >= least)
    planar = F.when(best_e, h > hr * e).otherwise(h > hr * f)
    return F.when((e < least) & (f < least) & (h < least), 1).when(planar, 6).when(best_e, 2).otherwise(3)


def uncalibrated_config(f: Column, h: Column, least: int = 15, ratio: float = 0.8) -> Column:
    """Two-view configuration without calibration: degenerate 1, uncalibrated 3, planar or panoramic 6."""
    return F.when((f < least) & (h < least), 1).when(h > ratio * f, 6).otherwise(3)


def similarity_fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """4x4 similarity of least squares from x to y (closed form over the covariance)."""
    mx, my = x.mean(0), y.mean(0)
    u, s, vt = np.linalg.svd((y - my).T @ (x - mx) / len(x))
    sign = np.ones(3)
    sign[2] = np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1
    scale = (s * sign).sum() / max(((x - mx) ** 2).sum() / len(x), 1e-300)
    out = np.eye(4)
    out[:3, :3] = scale * u @ np.diag(sign) @ vt
    out[:3, 3] = my - out[:3, :3] @ mx
    return out


def residuals_of(model: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x @ model[:3, :3].T + model[:3, 3] - y) ** 2).sum(1)


def ransac(x: np.ndarray, y: np.ndarray, fit: Callable, residual: Callable, size: int, most: float, seed: int, trials: int = 200) -> tuple[np.ndarray | None, np.ndarray]:
    """Sample, fit, score; the best model is refitted on its inliers."""
    rng, best, mask = np.random.default_rng(seed), (-1, 0.0), np.zeros(len(x), bool)
    model = None
    for _ in range(trials if len(x) >= size else 0):
        chosen = rng.choice(len(x), size, replace=False)
        try:
            found = fit(x[chosen], y[chosen])
        except np.linalg.LinAlgError:
            continue
        r = residual(found, x, y)
        inside = r <= most * most
        support = (int(inside.sum()), -float(r[inside].sum()))
        if support > best:
            best, model, mask = support, found, inside
    if model is not None and mask.sum() >= size:
        model = fit(x[mask], y[mask])
        mask = residual(model, x, y) <= most * most
    return model, mask


def align_groups(rows: DataFrame, key: str, most: float, seed: int = 0) -> DataFrame:
    """RANSAC similarity of each group (x1.. to x2..): inliers and scale. A group is
    one image pair or model pair and fits in a task by definition."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[["x1", "y1", "z1"]].to_numpy(), pdf[["x2", "y2", "z2"]].to_numpy()
        model, mask = ransac(x, y, similarity_fit, residuals_of, 3, most, seed)
        scale = float(np.cbrt(np.linalg.det(model[:3, :3]))) if model is not None else None
        return pd.DataFrame({key: [pdf[key].iloc[0]], "n": [len(pdf)], "inliers": [int(mask.sum())], "scale": [scale]})

    return rows.groupBy(key).applyInPandas(kernel, f"{key} long, n long, inliers long, scale double")


def triangulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Linear two-view triangulation of rows with p1, p2 (12 numbers each) and pixels, a batch at a time."""
    from trackloom.operators.solvers import triangulated

    for pdf in batches:
        if len(pdf):
            p = np.stack([np.stack(pdf[c].to_numpy()).astype(float).reshape(-1, 3, 4) for c in ("p1", "p2")], axis=1)
            x = np.stack([pdf[["u1", "v1"]].to_numpy(float), pdf[["u2", "v2"]].to_numpy(float)], axis=1)
            found = triangulated(p, x)
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), **{c: np.where(np.isnan(found[:, i]), None, found[:, i]) for i, c in enumerate("xyz")}})
