"""Output pages, files, mappings, scopes, gates and index rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipweave.functions import geometry as g
from slipweave.functions import text as tx
from slipweave.functions.geometry import Rect
from slipweave.functions.numbering import number_rows, page_levels
from slipweave.schema import FIELDS, PAGE, SIDES

_R = ("x0", "y0", "x1", "y1")
MODES = ("merged", "by_source", "by_counterparty", "by_counterparty_merged")
PAGE_KEY = ["group_id", *PAGE, "full_page", *_R]


def coverage(expected: DataFrame, actual: DataFrame, key: Sequence[str]) -> DataFrame:
    """Ids present on one side only: ``missing`` from or ``unexpected`` in ``actual``."""
    keys = list(key)
    lost = expected.select(*keys).distinct().join(actual.select(*keys), keys, "left_anti").withColumn("problem", F.lit("missing"))
    extra = actual.select(*keys).distinct().join(expected.select(*keys), keys, "left_anti").withColumn("problem", F.lit("unexpected"))
    return lost.unionByName(extra)


def retained(everything: DataFrame, excluded: DataFrame, key: Sequence[str]) -> DataFrame:
    """All rows but the excluded ones."""
    return everything.join(excluded.select(*key), list(key), "left_anti")


def common_keys(a: Column, b: Column) -> dict[str, Column]:
    """Shared and missing template keys of two sets, and whether the first is covered."""
    missing = F.array_except(a, b)
    return {"shared": F.array_intersect(a, b), "missing": missing, "covered": F.size(missing) == 0}


def _page_rect(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(F.col("full_page"), F.lit(-1.0)).otherwise(F.col(c)) for c in _R})


def output_pages(records: DataFrame) -> DataFrame:
    """One output page per group and distinct rectangle; a full page never merges with a crop.

    The lowest position stands for the page. Only partial aggregates cross the shuffle.
    """
    return (
        _page_rect(records)
        .groupBy(*PAGE_KEY)
        .agg(
            F.min("group_label").alias("group_label"), F.min("kind").alias("kind"), F.min("source_position").alias("source_position"),
            F.min("position_index").alias("position_index"), F.min(F.struct("position_index", "segment_id"))["segment_id"].alias("segment_id"),
            F.count(F.lit(1)).alias("slips"),
        )
    )


def merge_manual(automatic: DataFrame, manual: DataFrame) -> DataFrame:
    """Automatic and manual slip rows together; equal rectangles later share one output page."""
    return automatic.withColumn("origin", F.lit("automatic")).unionByName(manual.withColumn("origin", F.lit("manual")))


def _file_key(mode: str) -> Column:
    source = F.col("source_id").cast("string")
    return {
        "merged": F.lit("all"),
        "by_source": F.concat(F.lit("source:"), source),
        "by_counterparty": F.concat(F.lit("group:"), "group_id", F.lit(":"), source),
        "by_counterparty_merged": F.concat(F.lit("group:"), "group_id"),
    }[mode]


def output_pages_numbered(pages: DataFrame, modes: Sequence[str]) -> DataFrame:
    """Pages of every requested mode with their number in the file.

    Pages are numbered from per-block counts, so the one merged file of a run is numbered by
    many tasks. In grouped merged files pending groups come last.
    """
    keys = F.array(*[F.struct(F.lit(m).alias("mode"), _file_key(m).alias("file_key")) for m in modes])
    rows = pages.select("*", F.inline(keys)).withColumn("pending", (F.col("kind") == "counterparty_pending").cast("int"))
    order = [F.col(c) for c in ("page", "position_index", *_R, "full_page", "group_id")]
    return number_rows(rows, ["mode", "file_key"], page_levels(), order, "output_page")


def output_files(numbered: DataFrame) -> DataFrame:
    """Files with page counts; files of pending groups are flagged to come last."""
    grouped = F.col("mode").startswith("by_counterparty")
    return numbered.groupBy("mode", "file_key").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("slips").alias("slips"), F.max(F.when(grouped, F.col("pending")).otherwise(0)).alias("pending_last")
    )


def page_mappings(numbered: DataFrame, records: DataFrame) -> DataFrame:
    """Output file and page of every slip."""
    slim = numbered.select("mode", "file_key", "output_page", *PAGE_KEY)
    return _page_rect(records).select("segment_id", *PAGE_KEY).join(slim, PAGE_KEY).select("segment_id", "mode", "file_key", "output_page")


# Device names no file may carry, the name of an unnamed group, the longest file name in UTF-16 units.
RESERVED = ("con", "prn", "aux", "nul", *[f"com{i}" for i in range(1, 10)], *[f"lpt{i}" for i in range(1, 10)])
UNNAMED = "未命名分组"
LONGEST_NAME = 240
FORBIDDEN = r'[<>:"/\\|?*\p{Cc}\p{Cf}]'


def cut_units(c: Column, units: int) -> Column:
    """The longest beginning of at most ``units`` UTF-16 units that splits no character."""
    # Two bytes a unit, the higher first; the first half of a pair must not come last.
    whole = F.encode(c, "UTF-16BE")
    halved = F.hex(F.substring(whole, 2 * units - 1, 1)).rlike("^D[89AB]")
    begin = F.when(halved, F.substring(whole, 1, 2 * units - 2)).otherwise(F.substring(whole, 1, 2 * units))
    return F.when(F.length(whole) > 2 * units, F.btrim(F.decode(begin, "UTF-16BE"), F.lit(" ."))).otherwise(c)


def file_stem(composed: Column, units: int = LONGEST_NAME - 4) -> Column:
    """A name that any file system takes, without its extension, from composed text."""
    bare = F.btrim(F.regexp_replace(tx.strip(composed), FORBIDDEN, "_"), F.lit(" ."))
    marked = F.concat(bare, F.when(F.lower(bare).isin(*RESERVED), "_").otherwise(""))
    return F.coalesce(F.nullif(cut_units(marked, units), F.lit("")), F.lit(UNNAMED))


def caseless(c: Column) -> Column:
    """Equal for names that differ in case alone; sharp s is spelled out, and a final sigma is a sigma."""
    return F.replace(F.translate(F.lower(c), "ς", "σ"), F.lit("ß"), F.lit("ss"))


def unique_filenames(labels: DataFrame, key: str, label: str, suffix_units: int = 4) -> DataFrame:
    """Distinct file stems regardless of case: the first row of a stem keeps it, the others get ``-2``, ``-3``, …

    A number whose name another label spells out is passed over, so every name is given once. Stems too long for a suffix are
    numbered together with all that share the beginning left for it. Rows are numbered in key order by counts and
    prefix sums, so a stem of very many rows is spread over many tasks; no key may repeat.
    """
    room = LONGEST_NAME - suffix_units - 8
    rows = tx.composed(labels.select(key, F.coalesce(label, F.lit("")).alias("_label")), ["_label"], widths=False)
    rows = rows.select(key, file_stem(F.col("_label"), LONGEST_NAME - suffix_units).alias("stem")).withColumn("_low", caseless(F.col("stem")))
    rows = rows.withColumn("_head", cut_units(F.col("_low"), room))
    numeric = labels.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    block = F.floor(F.col(key) / 65536) if numeric else F.pmod(F.xxhash64(key), F.lit(1024))
    firsts = rows.groupBy("_low").agg(F.min(key).alias("_first"))
    named = rows.join(firsts, "_low")
    rest = number_rows(named.filter(F.col(key) != F.col("_first")), ["_head"], [("_block", block)], [F.col(key)], "_no")
    spelled = firsts.select(F.regexp_extract("_low", "^(.+)-([0-9]{1,9})$", 1).alias("_head"), F.regexp_extract("_low", "^(.+)-([0-9]{1,9})$", 2).alias("_k"))
    spelled = spelled.filter(F.col("_k").rlike("^[1-9]")).select("_head", F.col("_k").cast("long").alias("_k"))
    taken = spelled.join(rest.select("_head").distinct(), "_head", "left_semi").groupBy("_head").agg(F.array_sort(F.collect_set("_k")).alias("_taken"))
    none = F.array().cast("array<bigint>")
    number = F.aggregate(F.filter(F.coalesce("_taken", none), lambda k: k >= 2), F.col("_no") + 1, lambda n, k: F.when(k <= n, n + 1).otherwise(n))
    kept = F.when(F.col("_low") == F.col("_head"), F.col("stem")).otherwise(F.substring(F.col("stem"), F.lit(1), F.length("_head")))
    suffixed = rest.join(taken, "_head", "left").select(key, F.concat_ws("-", kept, number.cast("string")).alias("stem"))
    return named.filter(F.col(key) == F.col("_first")).select(key, "stem").unionByName(suffixed)


def extract_order(items: DataFrame) -> DataFrame:
    """Dense position in document order: source, page, position on the page."""
    return number_rows(items, [], page_levels(), [F.col("page"), F.col("position_index"), F.col("segment_id")], "position")


def resolve_scope(segments: DataFrame, wanted: DataFrame, key: str = "segment_id") -> tuple[DataFrame, DataFrame]:
    """Explicitly listed slips and what is wrong with the list (unknown or repeated ids)."""
    counted = wanted.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    chosen = segments.join(counted.select(key), key, "left_semi")
    errors = counted.join(segments.select(key).withColumn("_known", F.lit(True)), key, "left").select(
        key, F.when(F.col("_known").isNull(), "unknown").when(F.col("_n") > 1, "duplicate").alias("error")
    )
    return chosen, errors.filter("error is not null")


def scoped(segments: DataFrame, kind: str, wanted: DataFrame | None = None, key: str = "segment_id") -> tuple[DataFrame, DataFrame]:
    """The slips of a scope and its errors ``item, error``: ``all``, ``sources`` (``wanted(source_id)``) or ``list`` (``wanted`` by ``key``).

    Errors are ``unknown``, ``duplicate``, and ``empty`` (without an item) where no slip is chosen.
    """
    if kind not in ("all", "sources", "list"):
        raise ValueError("a scope is all, sources or list")
    name = "source_id" if kind == "sources" else key
    if kind == "all":
        chosen, errors = segments, None
    elif kind == "list":
        chosen, errors = resolve_scope(segments, wanted, key)
    else:
        _, errors = resolve_scope(segments.select(name).distinct(), wanted, name)
        chosen = segments.join(wanted.select(name).distinct(), name, "left_semi")
    empty = chosen.agg(F.count(F.lit(1)).alias("_n")).filter("_n = 0").select(F.lit(None).cast("string").alias("item"), F.lit("empty").alias("error"))
    if errors is None:
        return chosen, empty
    return chosen, errors.select(F.col(name).cast("string").alias("item"), "error").unionByName(empty)


def scope_counts(segments: DataFrame, selected: DataFrame, unresolved: Column, key: str = "segment_id") -> DataFrame:
    rows = segments.join(selected.select(key).distinct().withColumn("_in", F.lit(True)), key, "left")
    inside = F.coalesce("_in", F.lit(False))
    return rows.agg(
        F.count_if(inside).alias("selected"), F.count_if(~inside).alias("omitted"), F.count_if(inside & unresolved).alias("unresolved")
    )


def scope_summary(records: DataFrame) -> DataFrame:
    """Totals of an export: slips, selected, sources, excluded, distinct output pages."""
    per_page = _page_rect(records).groupBy(*PAGE_KEY).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("excluded").alias("_x"), F.max(~F.col("excluded")).alias("_live")
    )
    per_source = per_page.groupBy("source_id").agg(
        F.sum("_n").alias("_n"), F.sum("_x").alias("_x"), F.count_if("_live").alias("_p"), F.max("_live").alias("_live")
    )
    return per_source.agg(
        F.sum("_n").alias("segments"), (F.sum("_n") - F.sum("_x")).alias("selected"), F.count_if("_live").alias("sources"),
        F.sum("_x").alias("excluded"), F.sum("_p").alias("output_pages"),
    )


def _tiled(rects: DataFrame, step: float) -> DataFrame:
    """A row for each tile a rectangle touches; ``_band`` counts down the page, ``_strip`` across."""
    return rects.withColumn("_band", F.explode(g.bands(F.col("y0"), F.col("y1"), step))).withColumn("_strip", F.explode(g.bands(F.col("x0"), F.col("x1"), step)))


def excluded_conflicts(records: DataFrame, excluded: DataFrame, step: float = 64.0) -> DataFrame:
    """Slips to be exported whose rectangle materially overlaps an excluded one (``excluded(source_id, page, x0 …)``); full pages with any on their page."""
    other = _tiled(excluded.select(*PAGE, *_R), step).select(*PAGE, "_band", "_strip", *[F.col(c).alias("o_" + c) for c in _R]).distinct()
    crops = _tiled(records.filter("not full_page").select("segment_id", *PAGE, *_R), step)
    tile = [*PAGE, "_band", "_strip"]
    # Each overlap is seen in the tile where the later of both rectangles begins, down and across.
    first = (F.col("_band") == g.band(F.greatest("y0", "o_y0"), step)) & (F.col("_strip") == g.band(F.greatest("x0", "o_x0"), step))
    hit = crops.join(other, tile).filter(first & g.material_overlap(Rect(), Rect("o_"))).select("segment_id")
    whole = records.filter("full_page").join(excluded.select(*PAGE).distinct(), list(PAGE), "left_semi").select("segment_id")
    return hit.unionByName(whole).distinct()


def overlap_conflicts(records: DataFrame, step: float = 64.0) -> DataFrame:
    """Slips whose rectangle materially overlaps one of another group on the same page.

    A full page conflicts with anything of another group. Rectangles meet per tile of the page, in both directions,
    and only the fact of a conflict is kept, never the pairs.
    """
    crops = records.filter("not full_page").select("segment_id", *PAGE, "group_id", *_R)
    banded = _tiled(crops, step)
    # Equal rectangles of one group behave alike, so each is compared once.
    shapes = banded.select(*PAGE, "_band", "_strip", F.col("group_id").alias("o_group"), *[F.col(c).alias("o_" + c) for c in _R]).distinct()
    hit = banded.join(
        shapes.withColumnsRenamed({c: "o_" + c for c in (*PAGE, "_band", "_strip")}),
        (F.col("source_id") == F.col("o_source_id")) & (F.col("page") == F.col("o_page")) & (F.col("_band") == F.col("o__band")) & (F.col("_strip") == F.col("o__strip"))
        & (F.col("group_id") != F.col("o_group")) & g.material_overlap(Rect(), Rect("o_")),
        "left_semi",
    ).select("segment_id")
    groups = records.groupBy(*PAGE).agg(F.min("group_id").alias("_lo"), F.max("group_id").alias("_hi"), F.max("full_page").alias("_full"),
                                        F.min(F.when(F.col("full_page"), F.col("group_id"))).alias("_flo"), F.max(F.when(F.col("full_page"), F.col("group_id"))).alias("_fhi"))
    whole = records.join(groups.filter("_full and _lo <> _hi"), list(PAGE)).filter(
        F.when(F.col("full_page"), F.lit(True)).otherwise((F.col("_flo") != F.col("group_id")) | (F.col("_fhi") != F.col("group_id")))
    ).select("segment_id")
    return hit.unionByName(whole).distinct()


def export_gate(routed: DataFrame, reviews: DataFrame, include_pending: bool = False) -> DataFrame:
    """Everything that stops an export, one row per slip and reason."""
    rows = routed.join(reviews.select("segment_id", "review_status"), "segment_id", "left")
    out = F.coalesce(F.col("review_status") == "excluded", F.lit(False))
    checks = F.array_compact(
        F.array(
            F.when(F.col("stale"), "stale_extraction"),
            F.when(F.col("route") == "own_pending", "own_side_pending"),
            F.when((F.col("route") == "counterparty_pending") & F.lit(not include_pending), "pending_not_included"),
            F.when(out & (F.col("route") != "excluded"), "excluded_with_route"),
            F.when(~out & (F.col("route") == "excluded"), "route_excluded_without_review"),
        )
    )
    return rows.select("segment_id", F.explode(checks).alias("violation"))


def group_gate(routed: DataFrame) -> DataFrame:
    """What the groups say against an export: slips of a group that others define differently, and ``nothing_left`` (without a slip).

    ``routed(segment_id, route, group_id, group_key, group_label)``; excluded slips do not count.
    """
    live = routed.filter("route <> 'excluded'")
    told = F.struct("route", "group_key", "group_label")
    changed = live.filter("group_id is not null").groupBy("group_id").agg(F.min(told).alias("_lo"), F.max(told).alias("_hi")).filter("not (_lo <=> _hi)").select("group_id")
    slips = live.join(changed, "group_id", "left_semi").select("segment_id", F.lit("group_changed").alias("violation"))
    none = live.agg(F.count(F.lit(1)).alias("_n")).filter("_n = 0").select(F.lit(None).cast(routed.schema["segment_id"].dataType).alias("segment_id"), F.lit("nothing_left").alias("violation"))
    return slips.unionByName(none)


def exclusion_audit(reviews: DataFrame) -> DataFrame:
    """Who was left out and when, without any geometry."""
    return reviews.filter("review_status = 'excluded'").select("segment_id", "record_revision", "reviewed_at", "review_status")


# How codes read on a sheet. Fixed values.
ROUTE_TEXTS = {
    "excluded": "已排除", "own_pending": "本方待确认", "named": "交易对手", "internal": "本公司内部往来", "blank": "对方名称为空",
    "special": "特殊凭证", "counterparty_pending": "交易对手待确认",
}
STATE_TEXTS = {
    "present": "有值", "blank": "已确认空白", "missing": "未识别", "ambiguous": "有冲突", "pending": "尚未提取", "ready": "已提取", "stale": "依据已变化", "failed": "提取失败",
}
METHOD_TEXTS = {"account_match": "完整账号匹配", "manual": "人工确认", "none": "尚未确认", "automatic": "按规则归组", "batch_profile": "本批账户资料"}
SIDE_TEXTS = {"payer": "付款方", "payee": "收款方", "single": "单方凭证"}
BANK_TEXTS = {"matched": "已匹配", "manual": "人工确认", "unknown": "待确认", "mismatch": "不符"}
SHEET_TEXTS = {
    "route": ROUTE_TEXTS, "extraction_state": STATE_TEXTS, "decision_method": METHOD_TEXTS, "own_method": METHOD_TEXTS, "own_side": SIDE_TEXTS, "bank_status": BANK_TEXTS,
}
RECT_NAMES = ("x0", "y0", "x1", "y1")


def evidence_cells(evidence: DataFrame) -> DataFrame:
    """One column ``{side}_{field}_evidence`` per party field: its readings in order as JSON, with label, method and rectangles."""
    def rect(prefix: str) -> Column:
        return F.struct(*[F.col(prefix + c).alias(c) for c in RECT_NAMES])

    told = F.struct("reading", F.struct(rect("label_").alias("rect"), F.col("label").alias("text")).alias("label"), "method", F.struct(rect("").alias("rect"), F.col("raw").alias("text")).alias("value"))
    cells = [
        F.to_json(F.array_sort(F.collect_list(F.when((F.col("side") == s) & (F.col("field") == f), told)))).alias(f"{s}_{f}_evidence")
        for s in SIDES for f in FIELDS
    ]
    return evidence.groupBy("segment_id").agg(*cells)


def detail_rows(routed: DataFrame, fields: DataFrame, mappings: DataFrame | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """One wide row per slip: route columns and six party fields with raw text, value, state and evidence.

    The long field table is pivoted over its fixed (side, field) grid, in one shuffle; so is ``evidence``, where it is given. Codes among
    the route columns get a neighbour ``…_text`` as they read on a sheet, and the effective counterparty's side is named.
    """
    def pick(s: str, f: str, c: str) -> Column:
        return F.max(F.when((F.col("side") == s) & (F.col("field") == f), F.col(c))).alias(f"{s}_{f}" + ("" if c == "value" else "_" + c))

    cells = [pick(s, f, c) for s in SIDES for f in FIELDS for c in ("raw", "value", "state")]
    wide = fields.groupBy("segment_id").agg(*cells)
    rows = routed.join(wide, "segment_id", "left")
    if evidence is not None:
        names = [f"{s}_{f}_evidence" for s in SIDES for f in FIELDS]
        rows = rows.join(evidence_cells(evidence), "segment_id", "left").fillna("[]", names)
    for code, texts in SHEET_TEXTS.items():
        if code in routed.columns:
            known = F.create_map(*[F.lit(x) for kv in texts.items() for x in kv])
            rows = rows.withColumn(code + "_text", F.coalesce(F.element_at(known, F.col(code)), F.col(code), F.lit("")))
    if "own_side" in routed.columns:
        rows = rows.withColumn("counterparty_side", F.when(F.col("own_side") == "payer", "payee").when(F.col("own_side") == "payee", "payer"))
    return rows if mappings is None else rows.join(mappings, "segment_id", "left")


def draft_rows(routed: DataFrame, fields: DataFrame, sources: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Check sheet: a row per slip as of :func:`detail_rows`, and one per unfinished source."""
    slips = detail_rows(routed, fields, evidence=evidence).withColumn("row_kind", F.lit("slip"))
    open_sources = sources.filter("not finished").select("source_id", F.lit("unfinished_source").alias("row_kind"))
    return slips.unionByName(open_sources, allowMissingColumns=True)


def results_page(snapshot: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows of one stable page by dense position, with the offset of the next page."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    total = snapshot.agg(F.max("position").alias("n")).scalar()
    rows = snapshot.filter((F.col("position") > offset) & (F.col("position") <= offset + limit))
    return rows.withColumn("next_offset", F.when(total > offset + limit, F.lit(offset + limit).cast("long")))


def write_index(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write an index, mapping or audit table as parquet, csv or json files."""
    if fmt not in ("parquet", "csv", "json"):
        raise ValueError("fmt must be parquet, csv or json")
    writer = df.write.mode(mode)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
