"""Quality rules: base counts and robust multivariate outliers per language and source.

Statistics of a text become a vector, transformed so that the bulk of the texts is roughly normal: logarithms of sizes and
arcsine roots of shares. For every group the minimum covariance determinant estimate is found by concentration
steps over all its rows: start from medians and absolute deviations, take the share of rows with the least
Mahalanobis distance, re-estimate centre and covariance from them, repeat; then correct for consistency and
re-weight once. Rows beyond a chi-squared quantile are rejected.

Shares that are zero in most texts would make the covariance singular; as in the regularised estimate (Boudt and
others, 2020) a fixed diagonal target is added, the variance below which a difference means nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipweave.llm.shared import pick, written

SYMBOLS = "#*$%&|<>"
FEATURES = ("size", "word", "symbols", "duplicates", "repeats", "letters")
#: Standard deviations of the regularising target, in transformed units.
FLOOR = np.array([0.5, 0.08, 0.05, 0.25, 0.2, 0.06])
_LETTERS = re.compile(r"[^\W\d_]+")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(text: str | None) -> tuple[int, int, int, int, int, int, int]:
    """The five base counts, then lines with a word and letters. Null counts as empty."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n >= 4:
        ids: dict[bytes, int] = {}
        seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        # Two steps of pair numbering keep three-word windows exact for any number of words.
        _, pairs = np.unique(seq[:-1] * len(ids) + seq[1:], return_inverse=True)
        _, windows, times = np.unique(pairs[:-1] * len(ids) + seq[2:], return_inverse=True, return_counts=True)
        often = times[windows] > 1
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift : shift + n - 2] |= often
        repeated = int(covered.sum())
    letters = sum(map(len, _LETTERS.findall(text)))
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), letters


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source``, the base counts, ``base_failed`` and the transformed vector ``x`` per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = np.array([counts(t.as_py()) for t in b.column(3)], np.int64).reshape(-1, 7)
            n, chars, symbols, dups, repeats, lines, letters = c.T
            share = lambda part, whole: np.arcsin(np.sqrt(np.clip(part / np.maximum(whole, 1), 0, 1)))
            x = np.stack([np.log1p(n), np.log1p(chars / np.maximum(n, 1)), share(symbols, chars), share(dups, lines), share(repeats, n), share(letters, chars)], axis=1)
            failed = (n < 50) | (100 * repeats > 50 * n)
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.record_batch(
                [b.column(0), b.column(1), b.column(2), *(pa.array(v) for v in (n, chars, symbols, dups, repeats)), pa.array(failed), vectors],
                ["doc_id", "lang", "source", *COUNTS, "base_failed", "x"],
            )

    docs = pick(docs, "doc_id", "lang", "source", "text").withColumns({c: F.col(c).cast("string") for c in ("lang", "source")})
    kept = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", "lang", "source"))
    return docs.mapInArrow(run, f"{kept}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, x array<double>")


def chi_tail(x: float, p: int) -> float:
    """P(chi-squared with an even number ``p`` of degrees > x)."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def chi_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_tail(mid, p) > 1 - q else (low, mid)
    return high


def _model(share: float):
    """mapInPandas function: sums of the chosen rows of each group to centre and inverse covariance.

    ``share`` is the part of a normal distribution that the rows are; it sets the consistency factor.
    """
    p = len(FEATURES)
    factor = share / (1 - chi_tail(chi_quantile(share, p), p + 2)) if share < 1 else 1.0

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for g, n, s, ss in zip(f.g, f.n, f.s, f.ss):
                mean = np.asarray(s) / n
                cov = np.asarray(ss).reshape(p, p) / n - np.outer(mean, mean)
                rows.append((g, mean.tolist(), np.linalg.inv(factor * cov + np.diag(FLOOR**2)).ravel().tolist()))
            yield pd.DataFrame(rows, columns=["g", "mean", "inv"])

    return run


def distance(x: str = "x", mean: str = "mean", inv: str = "inv"):
    """Squared Mahalanobis distance as one flat expression."""
    p = len(FEATURES)
    d = [F.col(x)[i] - F.col(mean)[i] for i in range(p)]
    total = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            total = total + d[i] * d[j] * F.col(inv)[i * p + j] * (1 if i == j else 2)
    return total


def estimates(rows: DataFrame, share: float = 0.75, steps: int = 4) -> DataFrame:
    """``g, mean, inv``: the estimate of every group of ``rows`` (``g, x``), from all its rows.

    Every step is two aggregations with map-side combine, of sums and of a distance quantile, so a hot group is
    never gathered. The tables of estimates hold one row per group.
    """
    p = len(FEATURES)
    cells = [(i, j) for i in range(p) for j in range(p)]

    def sums(chosen: DataFrame) -> DataFrame:
        half = {c: F.sum(F.col("x")[c[0]] * F.col("x")[c[1]]) for c in cells if c[0] <= c[1]}
        return chosen.groupBy("g").agg(
            F.count("*").alias("n"), F.array(*[F.sum(F.col("x")[i]) for i in range(p)]).alias("s"),
            F.array(*[half[(min(c), max(c))] for c in cells]).alias("ss"))

    schema = "g string, mean array<double>, inv array<double>"
    middle = rows.groupBy("g").agg(F.array(*[F.percentile_approx(F.col("x")[i], 0.5, 1000) for i in range(p)]).alias("mean"))
    spread = rows.join(middle, "g").groupBy("g").agg(
        F.first("mean").alias("mean"),
        F.array(*[F.percentile_approx(F.abs(F.col("x")[i] - F.col("mean")[i]), 0.5, 1000) for i in range(p)]).alias("mad"))
    start = spread.select("g", "mean", F.array(*[
        1 / (F.pow(1.4826 * F.col("mad")[i], 2) + float(FLOOR[i] ** 2)) if i == j else F.lit(0.0) for i, j in cells]).alias("inv"))
    now = written(start, "mcd")
    for _ in range(steps):
        far = rows.join(now, "g").select("g", "x", distance().alias("d"))
        cut = far.groupBy("g").agg(F.percentile_approx("d", share, 1000).alias("cut"))
        now = written(sums(far.join(cut, "g").filter("d <= cut")).mapInPandas(_model(share), schema), "mcd")
    inner = 0.975
    near = rows.join(now, "g").filter(distance() <= chi_quantile(inner, p)).select("g", "x")
    again = sums(near).mapInPandas(_model(inner), schema)
    # A group none of whose rows is near keeps the estimate of the last step.
    return written(now.join(again.select("g", F.col("mean").alias("m2"), F.col("inv").alias("i2")), "g", "left").select(
        "g", F.coalesce("m2", "mean").alias("mean"), F.coalesce("i2", "inv").alias("inv")), "mcd")


def judge(docs: DataFrame, least_rows: int = 200, quantile: float = 1 - 1e-4) -> DataFrame:
    """Base counts, ``base_failed``, ``kept`` and the ``distance`` of every row of ``docs``.

    Estimates come from all rows that pass the base rules, per (language, source); a group of fewer than
    ``least_rows`` such rows is judged by its language, a language of fewer by all rows, and nothing is rejected by distance
    when even those are fewer. Null languages and sources are groups of their own; null and empty texts
    fail the base rules. Repeated rows are judged alike and all returned; an empty table gives an empty one.
    """
    stats = written(statistics(docs), "statistics")
    tag = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    # The last is the same for all rows, but not a constant to the optimiser, which would make a loop of the join.
    level = [F.concat(F.lit("s"), F.to_json(F.array(tag("lang"), tag("source")))), F.concat(F.lit("l"), tag("lang")), F.concat(F.lit("all"), F.repeat(tag("lang"), F.lit(0)))]
    passed = stats.filter(~F.col("base_failed"))
    sizes = passed.select(F.explode(F.array(*level)).alias("g")).groupBy("g").count()
    large = written(sizes.filter(F.col("count") >= least_rows).select("g"), "groups")
    rows = passed.select(F.explode(F.array(*level)).alias("g"), "x").join(large, "g")
    model = estimates(rows)
    named = stats.withColumns({"g0": level[0], "g1": level[1], "g2": level[2]})
    for i in range(3):
        named = named.join(model.select(F.col("g").alias(f"g{i}"), F.struct("mean", "inv").alias(f"m{i}")), f"g{i}", "left")
    judged = named.withColumn("m", F.coalesce("m0", "m1", "m2")).withColumns({"mean": F.col("m.mean"), "inv": F.col("m.inv")})
    far = distance()
    return judged.select(
        "doc_id", *COUNTS, "base_failed",
        (~F.col("base_failed") & F.coalesce(far <= chi_quantile(quantile, len(FEATURES)), F.lit(True))).alias("kept"),
        F.sqrt(F.greatest(far, F.lit(0.0))).alias("distance"))
