"""Arrow-batched column functions that are made when they are used, so that importing needs no session."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def each(f: Callable, returns: str) -> Callable[[str | Column], Column]:
    """Column function that maps ``f`` over the values of one column, nulls left as they are."""

    def on(x: str | Column) -> Column:
        def run(values: pd.Series) -> pd.Series:
            return pd.Series([None if v is None else f(v) for v in values], dtype=object)

        return F.pandas_udf(run, returns)(x)

    return on


def each_pair(f: Callable, returns: str) -> Callable[[str | Column, str | Column], Column]:
    """As ``each`` over two columns; null if either is."""

    def on(x: str | Column, y: str | Column) -> Column:
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([None if v is None or w is None else f(v, w) for v, w in zip(a, b, strict=True)], dtype=object)

        return F.pandas_udf(run, returns)(x, y)

    return on
