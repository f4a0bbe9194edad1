"""Small shared helpers for operators."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, small: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Attach a table with one row per ``by`` group to every row of ``df``.

    With keys: a broadcast equi-join (size bound: one row per group).  Without keys:
    the one-row table becomes a scalar subquery — no join, no cross product."""
    if by:
        return df.join(F.broadcast(small), list(by))
    cols = small.columns
    packed = small.select(F.struct(*cols).alias("__s")).scalar()
    return df.withColumns({c: packed[c] for c in cols})
