"""Math, statistics and string functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def sign_of(x: Column) -> Column:
    return F.signum(x).cast("int")


def clip(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def sigmoid(x: Column, alpha: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-alpha * x))


def scale_sigmoid(x: Column, alpha: float = 1.0, x0: float = 10.0) -> Column:
    """Sigmoid over [-x0, x0], rescaled so that 0 to 1 goes to 0 to 1."""
    t0, t1 = sigmoid(F.lit(-x0), alpha), sigmoid(F.lit(x0), alpha)
    return (sigmoid(2 * x0 * x - x0, alpha) - t0) / (t1 - t0)


def linear_root(a: Column, b: Column) -> Column:
    """Root of a x + b, null where a is zero."""
    return -b / F.nullif(a, F.lit(0.0))


def quadratic_roots(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """Real parts and the imaginary part of the roots of a x^2 + b x + c (a not zero),
    by the sum that loses no digits."""
    d = b * b - 4 * a * c
    q = -0.5 * (b + F.when(b < 0, -1.0).otherwise(1.0) * F.sqrt(F.greatest(d, F.lit(0.0))))
    one, two = q / F.nullif(a, F.lit(0.0)), F.when(q == 0, 0.0).otherwise(c / F.nullif(q, F.lit(0.0)))
    middle = -b / F.nullif(2 * a, F.lit(0.0))
    real = lambda x: F.when(d < 0, middle).otherwise(x)
    return real(F.least(one, two)), real(F.greatest(one, two)), F.when(d < 0, F.sqrt(F.abs(d)) / F.abs(F.nullif(2 * a, F.lit(0.0)))).otherwise(0.0)


def doubles_to_csv(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ", ")


def is_infinite(x: Column) -> Column:
    return F.abs(x) == float("inf")


def saturating_cast(x: Column, kind: str) -> Column:
    low, high = {"byte": (-(2**7), 2**7 - 1), "short": (-(2**15), 2**15 - 1), "int": (-(2**31), 2**31 - 1), "uint8": (0, 255)}[kind]
    return clip(x, low, high).cast("short" if kind == "uint8" else kind)


def choose(n: Column, k: int) -> Column:
    """Binomial coefficient by its product."""
    out = F.lit(1).cast("double")
    for i in range(1, k + 1):
        out = out * (n - k + i) / i
    return F.round(out).cast("long")


def horner(x: Column, coefficients: list[float]) -> Column:
    """A polynomial's value, highest coefficient first."""
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + c
    return out


def nearest_rank(values: Column, p: float) -> Column:
    """Percentile of an array by index round(p/100*(n-1))."""
    ordered = F.sort_array(values)
    return F.element_at(ordered, F.round((F.size(ordered) - 1) * (p / 100)).cast("int") + 1)


def at_fraction(values: Column, q: float) -> Column:
    """Element of a sorted array at index int(q*n), as the sampling statistics take it."""
    ordered = F.sort_array(values)
    return F.element_at(ordered, F.floor(F.size(ordered) * F.lit(q)).cast("int") + 1)


def text_after(text: Column, key: str) -> Column:
    """What follows the last occurrence of the key; the whole text for an empty
    key, the empty string if the key is absent."""
    if not key:
        return text
    return F.when(F.contains(text, F.lit(key)), F.substring_index(text, key, -1)).otherwise("")


def split_any(text: Column, delimiters: str) -> Column:
    return F.split(text, f"[{re.escape(delimiters)}]+")


def csv_to_doubles(text: Column) -> Column:
    """Numbers of a list split at , or ;. Empty items are dropped; one bad item empties the list."""
    items = F.filter(F.transform(F.split(text, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    numbers = F.transform(items, lambda x: x.try_cast("double"))
    return F.when(F.exists(numbers, lambda x: x.isNull()), F.array().cast("array<double>")).otherwise(numbers)


def has_duplicate(values: Column) -> Column:
    return F.size(F.array_distinct(values)) < F.size(values)


def file_parts(path: Column) -> tuple[Column, Column, Column]:
    """Parent folder, base name and extension (with its dot) of a path."""
    base = F.substring_index(path, "/", -1)
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1), base, F.regexp_extract(base, r"(\.[^.]*)$", 1)
