"""Camera models: intrinsics, distortion, and the way between pixels and rays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]

#: Parameters of each model, in order. A single focal length is called f.
PARAMETERS = {
    "SIMPLE_PINHOLE": "f cx cy",
    "PINHOLE": "fx fy cx cy",
    "SIMPLE_RADIAL": "f cx cy k1",
    "RADIAL": "f cx cy k1 k2",
    "OPENCV": "fx fy cx cy k1 k2 p1 p2",
    "OPENCV_FISHEYE": "fx fy cx cy k1 k2 k3 k4",
    "FULL_OPENCV": "fx fy cx cy k1 k2 p1 p2 k3 k4 k5 k6",
    "FOV": "fx fy cx cy omega",
    "SIMPLE_RADIAL_FISHEYE": "f cx cy k1",
    "RADIAL_FISHEYE": "f cx cy k1 k2",
    "THIN_PRISM_FISHEYE": "fx fy cx cy k1 k2 p1 p2 k3 k4 sx1 sy1",
}
ROUNDS = 15


def named(model: str, params: list) -> dict[str, Column]:
    """Parameters by name, as columns; fx and fy are always there, and missing coefficients are zero."""
    return _named(model, [p if isinstance(p, Column) else F.lit(float(p)) for p in params])


def _named(model: str, params: list) -> dict:
    """Parameters by name, whatever they are."""
    names = PARAMETERS[model].split()
    if len(names) != len(params):
        raise ValueError(f"{model} has {len(names)} parameters")
    out = dict(zip(names, params, strict=True))
    out.setdefault("fx", out.get("f"))
    out.setdefault("fy", out.get("f", out["fx"]))
    return out


def focal_mean(model: str, params: list) -> Column:
    p = named(model, params)
    return (p["fx"] + p["fy"]) / 2


def calibration(model: str, params: list) -> tuple[Column, ...]:
    """Rows of the calibration matrix, end to end."""
    p, zero = named(model, params), F.lit(0.0)
    return p["fx"], zero, p["cx"], zero, p["fy"], p["cy"], zero, zero, F.lit(1.0)


def rescaled(model: str, params: list, sx, sy) -> list[Column]:
    """Parameters of the image scaled by sx and sy; a single focal length scales by their mean."""
    by = {"f": (F.lit(sx) + F.lit(sy)) / 2, "fx": F.lit(sx), "fy": F.lit(sy), "cx": F.lit(sx), "cy": F.lit(sy)}
    p = named(model, params)
    return [p[n] * by[n] if n in by else p[n] for n in PARAMETERS[model].split()]


def _radial(r2: Column, *k: Column) -> Column:
    out = 0.0
    for x in reversed(k):
        out = (out + x) * r2
    return out


def _tangential(u: Column, v: Column, r2: Column, p1: Column, p2: Column) -> Pair:
    return 2 * p1 * u * v + p2 * (r2 + 2 * u * u), 2 * p2 * u * v + p1 * (r2 + 2 * v * v)


class _Arrays:
    """The few functions that ``distortion`` takes of Spark's columns, on arrays."""

    sqrt, atan, tan, abs = np.sqrt, np.arctan, np.tan, np.abs
    choose = staticmethod(np.where)
    lit = float

    @staticmethod
    def over(a, b):
        return a / np.where(b == 0, np.nan, b)


class _Columns:
    sqrt, atan, tan, abs, lit = F.sqrt, F.atan, F.tan, F.abs, F.lit
    choose = staticmethod(lambda test, a, b: F.when(test, a).otherwise(b))
    over = staticmethod(lambda a, b: a / F.nullif(b, F.lit(0.0)))


def distortion(model: str, params: list, m: type = _Columns) -> Callable[[Column, Column], Pair]:
    """What a model adds to a point of the normalised image plane: over columns, or (``m``) over arrays."""
    p = named(model, params) if m is _Columns else _named(model, params)
    none = lambda u, v: (m.lit(0.0), m.lit(0.0))

    def fisheye(u: Column, v: Column, *k: Column) -> Pair:
        """The point at the bent angle of its ray, less the point."""
        r = m.sqrt(u * u + v * v)
        theta = m.atan(r)
        ratio = m.choose(r > 1e-12, m.over(theta * (1 + _radial(theta * theta, *k)), r), 1.0)
        return u * ratio - u, v * ratio - v

    def opencv(u: Column, v: Column) -> Pair:
        r2 = u * u + v * v
        radial = _radial(r2, p["k1"], p["k2"], *([p["k3"]] if "k3" in p else []))
        if "k4" in p:
            radial = (1 + radial) / (1 + _radial(r2, p["k4"], p["k5"], p["k6"])) - 1
        du, dv = _tangential(u, v, r2, p["p1"], p["p2"])
        return u * radial + du, v * radial + dv

    def field_of_view(u: Column, v: Column) -> Pair:
        r = m.sqrt(u * u + v * v)
        bent = m.over(m.atan(2 * r * m.tan(p["omega"] / 2)), p["omega"] * r)
        ratio = m.choose((r > 1e-12) & (m.abs(p["omega"]) > 1e-12), bent, 1.0)
        return u * ratio - u, v * ratio - v

    def thin_prism(u: Column, v: Column) -> Pair:
        """Bends the angle first; the coefficients act on the bent point."""
        du, dv = fisheye(u, v)
        x, y = u + du, v + dv
        r2 = x * x + y * y
        radial = _radial(r2, p["k1"], p["k2"], p["k3"], p["k4"])
        tx, ty = _tangential(x, y, r2, p["p1"], p["p2"])
        return x + x * radial + tx + p["sx1"] * r2 - u, y + y * radial + ty + p["sy1"] * r2 - v

    def plain_radial(u: Column, v: Column) -> Pair:
        radial = _radial(u * u + v * v, *(p[k] for k in ("k1", "k2") if k in p))
        return u * radial, v * radial

    if model in ("SIMPLE_PINHOLE", "PINHOLE"):
        return none
    if model == "THIN_PRISM_FISHEYE":
        return thin_prism
    if model.endswith("FISHEYE"):
        return lambda u, v: fisheye(u, v, *(p[k] for k in ("k1", "k2", "k3", "k4") if k in p))
    return {"OPENCV": opencv, "FULL_OPENCV": opencv, "FOV": field_of_view}.get(model, plain_radial)


def world_to_image(model: str, params: list, u: Column, v: Column) -> Pair:
    """Pixel of a ray (u, v, 1)."""
    p = named(model, params)
    du, dv = distortion(model, params)(u, v)
    return p["fx"] * (u + du) + p["cx"], p["fy"] * (v + dv) + p["cy"]


def image_to_world(model: str, params: list, x: Column, y: Column, rounds: int = ROUNDS) -> Pair:
    """Ray (u, v, 1) of a pixel; distortion is taken off by a fixed number of rounds, over arrays of pixels."""
    p = named(model, params)
    u0, v0 = (x - p["cx"]) / p["fx"], (y - p["cy"]) / p["fy"]
    if model in ("SIMPLE_PINHOLE", "PINHOLE"):
        return u0, v0
    size = len(params)

    @F.arrow_udf("u double, v double")
    def ray(*given: pa.Array) -> pa.Array:
        missing = np.logical_or.reduce([c.is_null().to_numpy(zero_copy_only=False) for c in given])
        rows = [c.to_numpy(zero_copy_only=False).astype(float) for c in given]
        with np.errstate(all="ignore"):
            own = _named(model, rows[:size])
            start = u, v = (rows[size] - own["cx"]) / own["fx"], (rows[size + 1] - own["cy"]) / own["fy"]
            bend = distortion(model, rows[:size], _Arrays)
            for _ in range(rounds):
                du, dv = bend(u, v)
                u, v = start[0] - du, start[1] - dv
        fields = [pa.array(c, mask=missing) for c in (u, v)]
        return pa.StructArray.from_arrays(fields, ["u", "v"])

    end = ray(*(c if isinstance(c, Column) else F.lit(float(c)) for c in params), x, y)
    return end["u"], end["v"]


def world_threshold(model: str, params: list, pixels) -> Column:
    """A pixel threshold on the normalised image plane."""
    return F.lit(pixels) / focal_mean(model, params)
