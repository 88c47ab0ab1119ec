"""Building blocks for geometric joins and greedy folds inside a page."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipweave.functions import geometry as g


def band_pairs(
    left: DataFrame, right: DataFrame, keys: Sequence[str], lo: Column, hi: Column, at: str,
    prefix: str = "v_", step: float = 32.0,
) -> DataFrame:
    """Pairs of one page whose right coordinate ``{prefix}{at}`` may lie in the left's [lo, hi].

    The left side is repeated for each horizontal band its interval touches and both sides meet
    on (keys, band): a sort-merge join with no pair outside the neighbourhood, so a crowded page never
    forms all its pairs and its work spreads over many keys. The join is hinted, as the planner takes the
    repeated side for as small as it was before and would send it to the driver. The caller filters exactly.
    """
    lhs = left.withColumn("_band", F.explode(g.bands(lo, hi, step)))
    rhs = right.withColumn("_band", g.band(F.col(prefix + at), step))
    return lhs.join(rhs.hint("merge"), [*keys, "_band"]).drop("_band")


def meet(
    left: DataFrame, right: DataFrame, keys: Sequence[str], of_left: tuple[Column, Column], of_right: tuple[Column, Column], step: float = 128.0,
    where: Column | None = None, keep: bool = False,
) -> DataFrame:
    """Pairs of one page whose vertical intervals may touch, each pair once.

    Both sides are repeated for the bands their intervals touch and meet on (keys, band). A pair that shares several
    bands is kept in the first of them, where the later of the two intervals begins. The caller filters exactly, or by ``where``
    inside the join. With ``keep`` a left row stays, at most once for each of its bands, where nothing meets it.
    """
    def low(lo: Column, hi: Column) -> Column:
        return g.band(F.least(lo, hi), step)

    explode = F.explode_outer if keep else F.explode
    lhs = left.withColumns({"_first": low(*of_left), "_band": explode(g.bands(F.least(*of_left), F.greatest(*of_left), step))})
    rhs = right.withColumns({"_begin": low(*of_right), "_r_band": F.explode(g.bands(F.least(*of_right), F.greatest(*of_right), step))})
    rhs = rhs.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = (F.col("_band") == F.col("_r_band")) & (F.col("_band") == F.greatest("_first", "_begin"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_r_{k}"))
    pairs = lhs.join(rhs.hint("merge"), same if where is None else same & where, "left" if keep else "inner")
    return pairs.drop("_band", "_r_band", "_first", "_begin", *[f"_r_{k}" for k in keys])


def greedy_starts(values: Column, starts: Callable[[Column, Column], Column]) -> Column:
    """Sorted values kept when ``starts(value, last kept)`` holds; the first is always kept.

    A fold, because each decision depends on the last *kept* value, which no lag window knows.
    """
    empty = F.filter(values, lambda v: F.lit(False))
    return F.aggregate(
        values,
        empty,
        lambda kept, v: F.when(
            (F.size(kept) == 0) | starts(v, F.element_at(kept, -1)), F.concat(kept, F.array(v))
        ).otherwise(kept),
    )
