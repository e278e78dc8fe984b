"""Functions of the C library as columns.

DuckDB's SQL calls them; Java's own differ from them in the last bit for some arguments (its sine and
cosine for two in a thousand, a square by pow for one in a thousand), which shows where a sum lies just
off a tie of rounding.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _of(function, value: Column, far: float) -> Column:
    """``far`` is the function's value at infinity; null and NaN stay."""

    def kernel(x: pd.Series) -> pd.Series:
        return pd.Series([function(v) if math.isfinite(v) else 0.0 for v in x.tolist()], dtype=float)

    return F.when(value.isNull() | F.isnan(value), value).when(F.abs(value) == math.inf, far).otherwise(F.pandas_udf(kernel, "double")(value))


def cos(value: Column) -> Column:
    return _of(math.cos, value, math.nan)


def sin(value: Column) -> Column:
    return _of(math.sin, value, math.nan)


def _square(v: float) -> float:
    try:
        return math.pow(v, 2.0)
    except OverflowError:
        return math.inf


def square(value: Column) -> Column:
    return _of(_square, value, math.inf)
