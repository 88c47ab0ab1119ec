"""Keyword search, page filters, criteria and evidence."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipweave.functions import text as tx
from slipweave.schema import LIMITS, PAGE

Clause = tuple[str, str, str]  # query_id, keyword, role

# Field words looked up in a block, first one wins. Fixed values.
FIELD_TAGS = ("收款方", "付款方", "户名", "交易金额")
FUZZY_THRESHOLD = 0.65


def _keyword(keyword: str) -> str:
    folded = "".join(chr(ord(ch) - 0xFEE0) if 0xFF01 <= ord(ch) <= 0xFF60 else ch for ch in keyword)
    return folded.replace("\u3000", " ").replace("\u200b", "").strip()


def check_clauses(clauses: Sequence[Clause]) -> list[Clause]:
    """Reject malformed clause lists; any number of clauses of any length is constants of the plan."""
    if not clauses:
        raise ValueError("a clause is required")
    if len({q for q, _, _ in clauses}) != len(clauses) or not all(q.strip() for q, _, _ in clauses):
        raise ValueError("query ids must be non-empty and unique")
    kept = []
    for query_id, keyword, role in clauses:
        if role not in ("include", "exclude"):
            raise ValueError("role must be include or exclude")
        if not _keyword(keyword):
            raise ValueError("keywords must not be empty")
        kept.append((query_id, _keyword(keyword), role))
    return kept


def search_exact(blocks: DataFrame, keyword: str) -> DataFrame:
    """Blocks whose search form contains the keyword's; rectangle and confidence are kept."""
    word = _keyword(keyword)
    if not word:
        return blocks.filter(F.lit(False)).withColumn("matched_text", F.col("text"))
    matched = tx.norm_search(F.col("text"))
    return blocks.withColumn("matched_text", matched).filter(F.col("matched_text").contains(word))


def _char_counts(text: Column, word: str) -> Column:
    """Size of the multiset intersection of ``word`` and ``text``."""
    total = F.lit(0)
    for ch in sorted(set(word)):
        have = F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))
        total = total + F.least(F.lit(word.count(ch)), have)
    return total


def fuzzy_bound(text: Column, word: str) -> Column:
    """Upper bound of the best window ratio, from character counts alone."""
    k = len(word)
    lengths = [n for n in (k - 1, k, k + 1) if n >= (k if k <= 2 else k - 1)]

    def bound(common: Column, size: Column) -> Column:
        ratios = [
            F.when(size >= n, 2 * F.least(common, F.lit(n)) / F.lit(float(k + n))).otherwise(F.lit(0.0))
            for n in lengths
        ]
        return F.greatest(*ratios, F.lit(0.0))

    return tx.let(text, lambda t: tx.let(_char_counts(t, word), lambda common: bound(common, F.length(t))))


def _common_lengths(word: str, codes: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For each window length, how long the common subsequence of ``word`` and the window at each place is.

    One bit per character of the word, all windows in step: a carry of the addition marks one more common character.
    """
    k = len(word)
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(t).bits >= k)
    full = kind((1 << k) - 1)
    masks = np.zeros(len(codes), dtype=kind)
    for ch in set(word):
        masks[codes == ord(ch)] = kind(sum(1 << i for i, c in enumerate(word) if c == ch))
    state, out = np.full(len(codes), full, dtype=kind), []
    for i in range(min(k + 1, len(codes))):
        state = state[: len(codes) - i]
        met = state & masks[i:]
        state = ((state + met) | (state - met)) & full
        if i + 1 >= (k if k <= 2 else k - 1):
            out.append((i + 1, k - np.bitwise_count(state).astype(np.int64)))
    return out


def _common_counts(word: str, codes: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The same bound from counts of characters, for words of more than 64."""
    k = len(word)
    sums = {ch: np.concatenate(([0], np.cumsum(codes == ord(ch)))) for ch in set(word)}
    sizes = [n for n in range(k - 1, k + 2) if n <= len(codes)]
    return [(n, sum(np.minimum(c[n:] - c[:-n], word.count(ch)) for ch, c in sums.items())) for n in sizes]


def best_ratios(word: str, texts: Sequence[str], seen: dict[str, float] | None = None) -> list[float]:
    """Best match ratio of ``word`` against all windows of nearly its length, for each text; 0 below the threshold.

    Matching blocks are a common subsequence, so its length bounds a window's ratio. The texts are laid end to end and bounded
    together; windows are then scored from the best bound down until no bound can beat the best score, so the maximum is exact.
    ``seen`` remembers the scores of windows that recur.
    """
    k, seen, floor = len(word), {} if seen is None else seen, FUZZY_THRESHOLD - 1e-12
    best = [floor] * len(texts)
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(t) for t in texts])
    starts, bounds, sizes = [], [], []
    for n, common in (_common_lengths if k <= 64 else _common_counts)(word, codes):
        bound = 2.0 * common / (k + n)
        at = np.flatnonzero(bound > floor)
        starts.append(at)
        bounds.append(bound[at])
        sizes.append(np.full(len(at), n))
    if starts:
        start, bound, size = map(np.concatenate, (starts, bounds, sizes))
        owner = np.searchsorted(ends, start, side="right")
        inside = start + size <= ends[owner]
        start, bound, size, owner = start[inside], bound[inside], size[inside], owner[inside]
        order = np.argsort(-bound, kind="stable")
        for i, b, n, who in zip(*(x[order].tolist() for x in (start, bound, size, owner))):
            if b <= best[who]:
                continue
            window = joined[i : i + n]
            if window not in seen:
                seen[window] = SequenceMatcher(None, word, window).ratio()
            best[who] = max(best[who], seen[window])
    return [r if r > floor else 0.0 for r in best]


def best_ratio(word: str, text: str, seen: dict[str, float] | None = None) -> float:
    """:func:`best_ratios` of one text."""
    return best_ratios(word, [text], seen)[0]


def _in_runs(texts: pd.Series, size: int = 100_000) -> Iterator[list[str]]:
    """Texts in runs of about ``size`` characters; a longer text is a run of its own."""
    run, n = [], 0
    for t in texts:
        if run and n + len(t) > size:
            yield run
            run, n = [], 0
        run.append(t)
        n += len(t)
    if run:
        yield run


def search_fuzzy(blocks: DataFrame, keyword: str) -> DataFrame:
    """Blocks with a window at least 65 % like the keyword.

    The character-count bound discards most blocks inside the JVM; only survivors are scored by
    Python, batch by batch, on the text column alone.
    """
    word = "".join(_keyword(keyword).split())
    matched = tx.norm_search(F.col("text"))
    if not word:
        return blocks.filter(F.lit(False)).withColumn("matched_text", F.col("text"))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        seen: dict[str, float] = {}
        return pd.Series([r for run in _in_runs(texts) for r in best_ratios(word, run, seen)], dtype="float64")

    # Whoever filters by a score has it computed where the rows are, before they are dealt out, and again after, unless it is said not to repeat.
    score = score.asNondeterministic()
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    survivors = (
        blocks.filter(fuzzy_bound(tx.no_space(matched), word) >= FUZZY_THRESHOLD)
        .repartition(tasks, *PAGE, "block_index")  # scoring costs far more than moving the survivors
    )
    return (
        survivors.withColumn("matched_text", matched)
        .withColumn("_r", score(tx.no_space(F.col("matched_text"))))
        .filter(F.col("_r") >= FUZZY_THRESHOLD)
        .withColumn("confidence", F.round(F.least("_r", "confidence"), 4))
        .drop("_r")
    )


def search_clauses(blocks: DataFrame, clauses: Sequence[Clause]) -> DataFrame:
    """All clauses in one scan: each block is exploded into the clauses it contains."""
    matched = F.col("matched_text")
    hits = [
        F.when(matched.contains(k), F.struct(F.lit(q).alias("query_id"), F.lit(r).alias("role")))
        for q, k, r in check_clauses(clauses)
    ]
    found = F.filter(F.array(*hits), lambda h: h.isNotNull())
    return (
        blocks.withColumn("matched_text", tx.norm_search(F.col("text")))
        .withColumn("_hit", F.explode(found))
        .withColumn("query_id", F.col("_hit.query_id"))
        .withColumn("role", F.col("_hit.role"))
        .drop("_hit")
    )


def page_date(text: Column) -> Column:
    """First date written in the text; an impossible date is NULL."""
    folded = tx.norm_search(text)
    pattern = "(20\\d{2})[年./-](\\d{1,2})[月./-](\\d{1,2})日?"
    part = [F.regexp_extract(folded, pattern, i) for i in (1, 2, 3)]
    iso = F.concat_ws("-", part[0], F.lpad(part[1], 2, "0"), F.lpad(part[2], 2, "0"))
    return F.when(part[0] != "", F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"))


def filter_date(pages: DataFrame, first: str | None, last: str | None, text: str = "text") -> DataFrame:
    """Pages whose first date lies within the bounds; no date fails any bound."""
    if first is None and last is None:
        return pages
    at = page_date(F.col(text))
    keep = F.lit(True)
    if first is not None:
        keep = keep & (at >= F.lit(first).cast("date"))
    if last is not None:
        keep = keep & (at <= F.lit(last).cast("date"))
    return pages.filter(keep)


def page_amounts(text: Column) -> Column:
    """All numbers in the text as exact decimals."""
    found = F.regexp_extract_all(tx.norm_search(text), F.lit("(\\d[\\d,]*(?:\\.\\d{1,2})?)"), F.lit(1))
    return F.transform(found, lambda s: F.replace(s, F.lit(","), F.lit("")).cast("decimal(38,2)"))


def filter_amount(pages: DataFrame, low: float | None, high: float | None, text: str = "text") -> DataFrame:
    """Largest amount reaches ``low`` and smallest does not exceed ``high``."""
    found = page_amounts(F.col(text))
    keep = F.lit(True)
    if low is not None:
        keep = keep & (F.array_max(found) >= F.lit(low).cast("decimal(38,2)"))
    if high is not None:
        keep = keep & (F.array_min(found) <= F.lit(high).cast("decimal(38,2)"))
    return pages.filter(keep)


def tag_field(c: Column, tags: Sequence[str] = FIELD_TAGS) -> Column:
    """First field word of the list contained in the text."""
    return F.coalesce(*[F.when(c.contains(t), F.lit(t)) for t in tags])


def filter_field(matches: DataFrame, field: str, tags: Sequence[str] = FIELD_TAGS) -> DataFrame:
    return matches.filter(tag_field(F.col("matched_text"), tags) == field)


def normalize_criteria(criteria: DataFrame) -> DataFrame:
    """Many saved criteria sets at once: ``set_id, role, ordinal, keyword[, mode]`` to clause rows.

    Keywords are trimmed, empty ones dropped, repeats keep their first place, and ids are
    renumbered ``include-0``, ``include-1``, … per set.
    """
    word = tx.strip(tx.nfc(F.col("keyword")))
    first = (
        criteria.withColumn("keyword", word)
        .filter(F.col("keyword") != "")
        .groupBy("set_id", "role", "keyword")
        .agg(F.min("ordinal").alias("ordinal"), F.first("mode").alias("mode"))
    )
    w = Window.partitionBy("set_id", "role").orderBy("ordinal")
    return first.select(
        "set_id",
        F.concat(F.col("role"), F.lit("-"), (F.row_number().over(w) - 1).cast("string")).alias("query_id"),
        "keyword",
        "role",
        F.when(F.col("mode") == "any", "any").otherwise("all").alias("mode"),
    )


def eval_criteria(
    hits: DataFrame, candidate: Sequence[str], includes: Sequence[str], mode: str = "all"
) -> DataFrame:
    """Candidates meeting the include rule without any exclude hit.

    Hits are reduced to one boolean per clause before the shuffle, so a candidate holding very
    many hits costs one row per map task.
    """
    per_clause = [F.max(F.col("query_id") == q) for q in includes]
    flags = F.array(*[F.coalesce(c, F.lit(False)) for c in per_clause])
    met = F.forall(flags, lambda x: x) if mode == "all" else F.exists(flags, lambda x: x)
    return (
        hits.groupBy(*candidate)
        .agg(
            met.alias("include_met"),
            F.max(F.col("role") == "exclude").alias("excluded"),
            F.count_if(F.col("role") == "include").alias("include_hits"),
        )
        .filter(F.col("include_met") & ~F.col("excluded"))
        .drop("include_met", "excluded")
    )


def first_hits(hits: DataFrame, candidate: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First hit of each query per candidate, by partial aggregation instead of a sort."""
    rest = [c for c in hits.columns if c not in (*candidate, "query_id", *order)]
    best = F.min(F.struct(*order, *rest)).alias("_b")
    return (
        hits.groupBy(*candidate, "query_id")
        .agg(best)
        .select(*candidate, "query_id", *[F.col(f"_b.{c}").alias(c) for c in (*order, *rest)])
    )


def evidence_text(hits: DataFrame, candidate: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Matched include texts of each candidate, in order of first appearance, joined by ``、``.

    Repeats are folded by a partial aggregate before texts are gathered, so a candidate carries
    each distinct text once however often it was hit.
    """
    distinct = (
        hits.filter((F.col("role") != "exclude") & (F.col("matched_text") != ""))
        .groupBy(*candidate, "matched_text")
        .agg(F.min(F.struct(*order)).alias("_at"))
    )
    return distinct.groupBy(*candidate).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_at", "matched_text"))), lambda s: s["matched_text"]
            ),
            "、",
        ).alias("evidence"),
        F.count(F.lit(1)).alias("texts"),
    )


def limits_audit(blocks: DataFrame, matches: DataFrame | None = None, limits: dict | None = None) -> DataFrame:
    """Per page: counters against the batch tool's caps, as a report rather than an abort."""
    cap = {**LIMITS, **(limits or {})}
    size = F.length("text")
    pages = blocks.groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("blocks"),
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("characters"),
        F.coalesce(F.max(size), F.lit(0)).cast("long").alias("longest_block"),
    )
    return pages.withColumn(
        "over_limit",
        F.concat_ws(
            ",",
            F.when(F.col("blocks") > cap["blocks_per_page"], F.lit("blocks")),
            F.when(F.col("characters") > cap["page_characters"], F.lit("characters")),
            F.when(F.col("longest_block") > cap["block_characters"], F.lit("block_characters")),
        ),
    )


def job_limits(blocks: DataFrame, matches: DataFrame, limits: dict | None = None) -> DataFrame:
    """Whole-job counters against their caps, one row per counter."""
    cap = {**LIMITS, **(limits or {})}
    per_page = blocks.groupBy(*PAGE).agg(F.sum(F.length("text")).alias("c"))
    pages = per_page.agg(F.count(F.lit(1)).alias("pages"), F.sum("c").cast("long").alias("total_characters"))
    found = matches.agg(F.count(F.lit(1)).alias("matches"))

    def rows(df: DataFrame, names: list[str]) -> DataFrame:
        return df.select(
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(n).alias("counter"), F.col(n).alias("value"), F.lit(cap[n]).cast("long").alias("cap")
                        )
                        for n in names
                    ]
                )
            ).alias("r")
        ).select("r.*", (F.col("r.value") > F.col("r.cap")).alias("over"))

    return rows(pages, ["pages", "total_characters"]).unionByName(rows(found, ["matches"]))
