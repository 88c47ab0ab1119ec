"""Row numbers that never sort one big group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on equal keys, where NULL equals NULL; the keys appear once."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(named, condition).drop(*[f"_r_{k}" for k in keys])


def number_rows(
    df: DataFrame, part: list[str], levels: list[tuple[str, Column]], order: list[Column], out: str
) -> DataFrame:
    """Number rows 1..n inside ``part``, ordered by the level values and then by ``order``.

    Each level is a named, ever finer bucket that agrees with the wanted order (import block,
    source, page block). Rows are counted per finest bucket with partial aggregation, offsets are
    prefix sums over those counts, and only one finest bucket is ever sorted together. A group
    holding a third of all rows is therefore numbered by many tasks. NULL sorts first and counts
    as a value of its own, so no row is lost.
    """
    names = [n for n, _ in levels]
    rows = df.withColumns(dict(levels))
    offsets = finest = rows.groupBy(*part, *names).agg(F.count(F.lit(1)).alias("_n"))
    total = F.lit(0).cast("long")
    for depth, name in enumerate(names):
        upto = part + names[: depth + 1]
        above = part + names[:depth]
        sums = finest if depth == len(names) - 1 else finest.groupBy(*upto).agg(F.sum("_n").alias("_n"))
        w = Window.partitionBy(*above).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        step = sums.select(*upto, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias(f"_o{depth}"))
        offsets = join_same(offsets, step, upto)
        total = total + F.col(f"_o{depth}")
    offsets = offsets.select(*part, *names, total.alias("_offset"))
    local = F.row_number().over(Window.partitionBy(*part, *names).orderBy(*order))
    return (
        join_same(rows.withColumn("_local", local), offsets, part + names)
        .withColumn(out, (F.col("_offset") + F.col("_local")).cast("long"))
        .drop("_offset", "_local", *names)
    )


def page_levels(position: str = "source_position", page: str = "page", files: int = 4096, sheets: int = 256):
    """Levels for document order: block of sources, source, block of pages."""
    return [
        ("_files", F.floor(F.col(position) / files)),
        ("_file", F.col(position)),
        ("_sheets", F.floor(F.col(page) / sheets)),
    ]
