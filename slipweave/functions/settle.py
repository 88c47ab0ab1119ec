"""Adding columns that later columns use many times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` whose results are computed once per row.

    A chain of projections whose columns feed each other is folded by the optimiser, and a filter
    pushed through it repeats every expression it needs, growing without bound. A one-row
    generator between the steps stays put and still runs inside whole-stage code.
    """
    keep = [c for c in df.columns if c not in columns]
    row = F.struct(*[v.alias(k) for k, v in columns.items()])
    return df.select(*keep, F.inline_outer(F.array(row)))
