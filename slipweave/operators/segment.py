"""Cutting pages into slips: gaps, titles, slots, seams, tables and page policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipweave.functions import geometry as g
from slipweave.functions import text as tx
from slipweave.functions.geometry import Rect
from slipweave.operators import classify
from slipweave.operators.nearby import band_pairs, greedy_starts, meet
from slipweave.schema import PAGE
from slipweave.session import stage

MARGIN = 8.0
MIN_HEIGHT = 12.0
TOLERANCE = 2.0
_R = ("x0", "y0", "x1", "y1")


def _rect(prefix: str) -> list[Column]:
    return [F.col(c).alias(prefix + c) for c in _R]


def segment_by_gap(blocks: DataFrame, separators: DataFrame | None = None) -> DataFrame:
    """Regions split where the vertical gap is large or a separator line lies in it.

    The limit is 2.2 times the page's median block height, at least 12pt.
    """
    page = Window.partitionBy(*PAGE)
    order = page.orderBy("y0", "x0", "block_index")
    height = F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
    rows = (
        blocks.withColumn("_limit", F.greatest(F.median(height).over(page) * 2.2, F.lit(12.0)))
        .withColumn("_prev", F.lag("y1").over(order))
        .withColumn("_cut", F.coalesce(F.col("y0") - F.col("_prev") > F.col("_limit"), F.lit(False)))
    )
    if separators is not None:
        gaps = rows.filter(F.col("_prev") <= F.col("y0"))
        lines = separators.select(*PAGE, F.col("y").alias("s_y"))
        crossed = (
            band_pairs(gaps, lines, PAGE, F.col("_prev"), F.col("y0"), "y", prefix="s_")
            .filter((F.col("s_y") >= F.col("_prev")) & (F.col("s_y") <= F.col("y0")))
            .select(*PAGE, "block_index")
            .distinct()
            .withColumn("_line", F.lit(True))
        )
        rows = rows.join(crossed, [*PAGE, "block_index"], "left").withColumn(
            "_cut", F.col("_cut") | F.coalesce("_line", F.lit(False))
        )
    groups = rows.withColumn("region_no", F.sum(F.col("_cut").cast("long")).over(order) + 1)
    regions = groups.groupBy(*PAGE, "region_no").agg(
        F.first("page_width").alias("page_width"), F.first("page_height").alias("page_height"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.count(F.lit(1)).alias("blocks"),
    )
    spread = Rect(x0=F.col("x0") - MARGIN, y0=F.col("y0") - MARGIN, x1=F.col("x1") + MARGIN, y1=F.col("y1") + MARGIN)
    split = F.when(F.max("region_no").over(page) > 1, 10).otherwise(0)
    # Counted in thousandths, so that no binary fraction decides the rounding.
    thousandths = F.lit(5500) + F.least(F.col("blocks"), F.lit(8)) * 375 + split * 100
    return regions.select(
        *PAGE, "region_no", "blocks",
        *g.clamp(spread, F.col("page_width"), F.col("page_height")),
        (F.floor((thousandths + 5) / 10) / 1000).alias("confidence"),
    )


def dedupe_by_gap(titles: DataFrame, gap: float = 32.0, keep: Sequence[str] = ()) -> DataFrame:
    """Greedy: a title stays only if it starts ``gap`` or more below the last title that stayed.

    Titles sharing a top edge are folded first, leftmost winning, so the fold's array holds one
    entry per distinct top edge of a page.
    """
    rest = [c for c in titles.columns if c not in (*PAGE, "y0")]
    lead = [c for c in ("x0", "block_index") if c in rest]
    payload = F.struct(*lead, *[c for c in rest if c not in lead])
    tops = titles.groupBy(*PAGE, "y0").agg(F.min(payload).alias("_p"))
    pages = tops.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("y0", "_p"))).alias("_t"))
    kept = greedy_starts(F.col("_t"), lambda t, last: t["y0"] - last["y0"] >= gap)
    return (
        pages.select(*PAGE, F.posexplode(kept).alias("_i", "_k"))
        .select(
            *PAGE, F.col("_k.y0").alias("y0"), *[F.col(f"_k._p.{c}").alias(c) for c in rest],
            (F.col("_i") + 1).cast("long").alias("title_no"),
        )
    )


def page_titles(blocks: DataFrame) -> DataFrame:
    """Deduplicated titles of each page, numbered from the top."""
    flagged = blocks.filter(~F.col("is_watermark") & classify.is_title(F.col("text")))
    return dedupe_by_gap(flagged.select(*PAGE, "block_index", "text", *_R, "page_width", "page_height"))


def title_starts(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """Where each title's slip begins: the title, its bank heading or its print-count marker."""
    lines = blocks.filter(~F.col("is_watermark"))
    heads = classify.own_masthead(titles, classify.masthead_bank(lines))
    markers = classify.own_prefix_marker(
        titles, classify.marker_groups(lines.withColumn("line_no", F.col("block_index")))
    )
    w = Window.partitionBy(*PAGE).orderBy("title_no")
    return (
        titles.join(heads.select(*PAGE, "title_no", "bank", "head_y0"), [*PAGE, "title_no"], "left")
        .join(markers, [*PAGE, "title_no"], "left")
        .withColumn("start_y", F.least("y0", "head_y0", "marker_y0"))
        .withColumn("next_start", F.lead("start_y").over(w))
        .withColumn("next_title", F.lead("y0").over(w))
        .withColumn("titles", F.count(F.lit(1)).over(Window.partitionBy(*PAGE)))
    )


def segment_by_title(blocks: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """One full-width region per title, from its start to the next one's start.

    Pages without a title fall back to :func:`segment_by_gap`; a loan notice with one title is a
    single full page at 0.89.
    """
    text = blocks.filter(~F.col("is_watermark"))
    t = title_starts(blocks, page_titles(blocks)) if starts is None else starts
    t = t.select(
        *PAGE, "title_no", "titles", "next_start", "next_title", "page_width", "page_height",
        F.greatest(F.lit(0.0), F.col("start_y") - MARGIN).alias("top"),
        F.col("y0").alias("title_y0"), F.col("y1").alias("title_y1"),
    )
    limit = F.coalesce("next_start", "page_height")
    members = text.select(
        *PAGE, *_rect("b_"),
        classify.is_page_number(F.col("page_width"), F.col("page_height")).alias("_label"),
    )
    pairs = band_pairs(t, members, PAGE, F.col("top"), limit, "y0", prefix="b_", step=64.0)
    b = Rect("b_")
    apart = F.coalesce(F.col("next_title") - F.col("title_y0") > 80, F.lit(False))
    runs_in = apart & (b.y0 < F.col("next_title")) & (F.col("next_title") <= b.y1)
    tail = F.coalesce(runs_in & ((b.y1 - F.col("next_title") < 8) | (b.height > 40)), F.lit(False))
    member = (b.y0 >= F.col("top")) & (b.y0 < limit) & ~F.col("_label") & ~tail
    edge = F.col("next_start")
    vague = F.coalesce(
        (b.y0 < edge) & (edge <= b.y1) & (b.height <= 40) & (b.y1 - edge >= 8) & ~tail, F.lit(False)
    )
    agg = pairs.groupBy(*PAGE, "title_no").agg(
        F.count_if(member).alias("blocks"),
        F.max(F.when(member, b.y1)).alias("_bottom"),
        F.max(vague).alias("_vague"),
    )
    notices = classify.detect_doc_type(text).filter(F.col("document_type").rlike("^loan_"))
    rows = t.join(agg, [*PAGE, "title_no"], "left").join(notices, list(PAGE), "left")
    whole = (F.col("titles") == 1) & F.col("document_type").isNotNull()
    bottom = F.coalesce("_bottom", "title_y1") + MARGIN
    hundredths = F.least(F.lit(98), F.lit(82) + F.least(F.coalesce("blocks", F.lit(0)), F.lit(8)) * 2)
    hundredths = F.when(F.coalesce("_vague", F.lit(False)), F.least(hundredths - 10, F.lit(89))).otherwise(hundredths)
    names = F.element_at(F.array(*[F.lit(n) for n in ("top", "middle", "bottom")]), F.least("title_no", F.lit(3)).cast("int"))
    slot = (
        F.when(whole, "single")
        .when(F.col("titles") == 3, names)
        .otherwise(F.concat(F.lit("slot-"), F.col("title_no").cast("string")))
    )
    titled = rows.select(
        *PAGE, F.col("title_no").alias("region_no"), slot.alias("slot"),
        F.lit(0.0).alias("x0"), F.when(whole, 0.0).otherwise(F.col("top")).alias("y0"),
        F.col("page_width").alias("x1"),
        F.when(whole, F.col("page_height"))
        .otherwise(F.least("page_height", F.coalesce("next_start", "page_height"), bottom))
        .alias("y1"),
        F.when(whole, 0.89).otherwise(hundredths / 100).alias("confidence"),
    )
    untitled = segment_by_gap(text.join(t.select(*PAGE).distinct(), list(PAGE), "left_anti"))
    sizes = text.groupBy(*PAGE).agg(F.max("page_width").alias("_w"))
    plain = untitled.join(sizes, list(PAGE)).select(
        *PAGE, "region_no", F.lit("single").alias("slot"), F.lit(0.0).alias("x0"), "y0",
        F.col("_w").alias("x1"), "y1", "confidence",
    )
    return titled.unionByName(plain)


def last_text_y(titles: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lowest text below each title and above the next; reaching the next title is a violation."""
    w = Window.partitionBy(*PAGE).orderBy("y0", "x0")
    t = titles.select(
        *PAGE, "title_no", F.col("y0").alias("t_y0"), F.col("y1").alias("t_y1"),
        F.lead("y0").over(w).alias("next_y"), "page_width", "page_height",
    )
    r = Rect()
    footer = (r.y0 >= F.col("page_height") * 0.9) & (r.y1 <= F.col("page_height")) & (
        r.width <= F.col("page_width") * 0.45
    )
    b = blocks.filter(~F.col("is_watermark") & ~footer).select(*PAGE, *_rect("b_"))
    end = F.coalesce("next_y", "page_height")
    pairs = band_pairs(t, b, PAGE, F.col("t_y0"), end, "y0", prefix="b_", step=64.0)
    found = (
        pairs.filter((F.col("b_y0") >= F.col("t_y0")) & (F.col("b_y0") < end))
        .groupBy(*PAGE, "title_no")
        .agg(F.max("b_y1").alias("_m"))
    )
    lowest = F.coalesce("_m", "t_y1")
    return t.join(found, [*PAGE, "title_no"], "left").select(
        *PAGE, "title_no", lowest.alias("last_y"),
        F.when(lowest >= F.col("page_height"), "invalid_geometry")
        .when(lowest >= F.col("next_y"), "crosses_next_title")
        .alias("violation"),
    )


def merge_intervals(segments: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Join collinear segments: greedy axis buckets, then overlapping runs within a bucket.

    ``segments(source_id, page, position, start, end)``. A bucket begins at the first position
    more than ``tolerance`` beyond the start of the bucket before, so positions cannot drift.
    """
    positions = segments.groupBy(*PAGE, "position").agg(F.lit(0).alias("_one"))
    axes = positions.groupBy(*PAGE).agg(F.array_sort(F.collect_list("position")).alias("_p"))
    starts = greedy_starts(F.col("_p"), lambda p, last: p - last > tolerance)
    pairs = axes.select(*PAGE, F.explode(starts).alias("axis"))
    w = Window.partitionBy(*PAGE).orderBy("position", F.col("axis").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    s = segments.select(*PAGE, "position", "start", "end").distinct()
    # Axes are positions; in order of position each segment lies on the last axis begun so far.
    both = s.unionByName(pairs.withColumns({"position": F.col("axis")}), allowMissingColumns=True)
    on_axis = both.withColumn("axis", F.last("axis", ignorenulls=True).over(w)).filter("start is not null or end is not null")
    run = Window.partitionBy(*PAGE, "axis").orderBy("start", "end")
    reach = F.max("end").over(run.rowsBetween(Window.unboundedPreceding, -1))
    islands = on_axis.withColumn("_new", F.coalesce(F.col("start") > reach + tolerance, F.lit(True))).withColumn(
        "_run", F.sum(F.col("_new").cast("int")).over(run)
    )
    return islands.groupBy(*PAGE, "axis", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(
        *PAGE, F.col("axis").alias("position"), "start", "end"
    )


def closed_tables(horizontal: DataFrame, vertical: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Closed grid envelopes: two equal-width rules at least 48pt apart, both sides covered by
    vertical rules, both side ends starting there, an inner rule across; only maximal ones stay.

    Inputs are merged rules with ``page_width, page_height``. Rules pair up through a hash of
    their left and right edges, not through all pairs of a page. The joins are sort-merge joins by hint, as the
    planner takes tables repeated per band for as small as they were before.
    """
    h = horizontal.select(
        *PAGE, "page_width", "page_height", F.col("position").alias("y"), F.col("start").alias("a"), F.col("end").alias("b")
    )
    v = vertical.select(*PAGE, F.col("position").alias("x"), F.col("start").alias("v0"), F.col("end").alias("v1"))
    step = 4 * tolerance
    top = h.filter((F.col("b") - F.col("a") >= F.col("page_width") * 0.3) & (F.col("a") >= 0) & (F.col("b") <= F.col("page_width")))
    top = top.select(*PAGE, "page_height", F.col("y").alias("y0"), F.col("a").alias("x0"), F.col("b").alias("x1"))
    top = top.withColumn("_band", F.explode(g.bands(F.col("x0") - tolerance, F.col("x0") + tolerance, step)))
    low = h.select(*PAGE, F.col("y").alias("y1"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    low = low.withColumn("_band", g.band(F.col("_a"), step))
    boxes = (
        top.hint("merge").join(low, [*PAGE, "_band"])
        .filter(
            (F.col("y1") - F.col("y0") >= 48)
            & (F.abs(F.col("_a") - F.col("x0")) <= tolerance)
            & (F.abs(F.col("_b") - F.col("x1")) <= tolerance)
            & (F.col("x0") < F.col("x1")) & (F.col("y0") >= 0) & (F.col("y1") <= F.col("page_height"))
        )
        .select(*PAGE, *_R)
        .distinct()
    )
    at_left = F.abs(F.col("x") - F.col("x0")) <= tolerance
    at_right = F.abs(F.col("x") - F.col("x1")) <= tolerance
    covers = (F.col("v0") <= F.col("y0") + tolerance) & (F.col("v1") >= F.col("y1") - tolerance)
    keys = [*PAGE, *_R]
    sides = (
        boxes.withColumn(
            "_band",
            F.explode(
                F.array_union(
                    g.bands(F.col("x0") - tolerance, F.col("x0") + tolerance, step),
                    g.bands(F.col("x1") - tolerance, F.col("x1") + tolerance, step),
                )
            ),
        )
        .join(v.withColumn("_band", g.band(F.col("x"), step)).hint("merge"), [*PAGE, "_band"])
        .filter(at_left | at_right)
        .groupBy(*keys)
        .agg(
            F.max(at_left & covers).alias("_l"), F.max(at_right & covers).alias("_r"),
            F.max(F.abs(F.col("v0") - F.col("y0")) <= tolerance).alias("_s"),
            F.max(F.abs(F.col("v1") - F.col("y1")) <= tolerance).alias("_e"),
        )
        .filter("_l and _r and _s and _e")
        .select(*keys)
    )
    rules = h.select(*PAGE, "y", "a", "b")
    inner = stage(
        band_pairs(sides, rules.withColumnsRenamed({"y": "i_y"}), PAGE, F.col("y0"), F.col("y1"), "y", prefix="i_", step=64.0)
        .filter(
            (F.col("i_y") > F.col("y0") + tolerance) & (F.col("i_y") < F.col("y1") - tolerance)
            & (F.col("a") <= F.col("x0") + tolerance) & (F.col("b") >= F.col("x1") - tolerance)
        )
        .select(*keys)
        .distinct()
    )
    outer = inner.select(*PAGE, *_rect("o_"))
    i, o = Rect(), Rect("o_")
    larger = (g.area(o) > g.area(i)) | ((g.area(o) == g.area(i)) & (F.struct(o.y0, o.x0) < F.struct(i.y0, i.x0)))
    nested = (
        (i.x0 >= o.x0 - tolerance) & (i.y0 >= o.y0 - tolerance)
        & (i.x1 <= o.x1 + tolerance) & (i.y1 <= o.y1 + tolerance) & larger
    )
    spread = outer.withColumn("_band", F.explode(g.bands(F.col("o_y0") - tolerance, F.col("o_y1") + tolerance, 64.0)))
    hit = (
        inner.withColumn("_band", g.band(F.col("y0"), 64.0))
        .join(spread.hint("merge"), [*PAGE, "_band"])
        .filter(nested)
        .select(*keys)
        .distinct()
    )
    return inner.join(hit.hint("merge"), keys, "left_anti")


def fix_seams(slots: DataFrame, blocks: DataFrame) -> DataFrame:
    """Small overlaps of neighbouring slots are split at the middle; others make the page invalid.

    Allowed are at most 12pt and 5 % of the lower height, with no text across the new boundary.
    ``slots(source_id, page, position_index, top, height)``; returned with ``valid`` per page.
    """
    w = Window.partitionBy(*PAGE).orderBy("position_index")
    page = Window.partitionBy(*PAGE)
    nxt_top, nxt_h = F.lead("top").over(w), F.lead("height").over(w)
    rows = (
        slots.withColumn("_over", F.col("top") + F.col("height") - nxt_top)
        .withColumn("_cap", F.least(F.lit(12.0), F.least("height", nxt_h) * 0.05))
        .withColumn("_mid", F.when(F.col("_over") > 0, (F.col("top") + F.col("height") + nxt_top) / 2))
    )
    seams = rows.filter("_mid is not null").select(*PAGE, "position_index", "_mid")
    text = blocks.filter(~F.col("is_watermark")).select(*PAGE, F.col("y0").alias("b_y0"), F.col("y1").alias("b_y1"))
    text = text.withColumn("_band", F.explode(g.bands(F.col("b_y0"), F.col("b_y1"), 32.0)))
    crossed = (
        seams.withColumn("_band", g.band(F.col("_mid"), 32.0))
        .join(text, [*PAGE, "_band"])
        .filter((F.col("b_y0") < F.col("_mid")) & (F.col("_mid") < F.col("b_y1")))
        .select(*PAGE, "position_index", F.lit(True).alias("_text"))
        .distinct()
    )
    rows = rows.join(crossed, [*PAGE, "position_index"], "left")
    bad = F.coalesce((F.col("_over") > F.col("_cap")) | ((F.col("_over") > 0) & F.col("_text")), F.lit(False))
    prev_mid = F.lag("_mid").over(w)
    top = F.coalesce(prev_mid, F.col("top"))
    bottom = F.coalesce("_mid", F.col("top") + F.col("height"))
    return rows.select(
        *PAGE, "position_index", top.alias("new_top"), (bottom - top).alias("new_height"),
        (~F.max(bad).over(page)).alias("valid"),
    ).withColumnsRenamed({"new_top": "top", "new_height": "height"})


def uniform_height(slots: DataFrame) -> DataFrame:
    """Give all slots the largest height where heights agree within 0.5 and every gap has room."""
    page = Window.partitionBy(*PAGE)
    w = page.orderBy("position_index")
    room = F.coalesce(F.lead("top").over(w), F.col("page_height")) - F.col("top")
    rows = slots.withColumn("_max", F.max("height").over(page)).withColumn("_room", room)
    fits = (F.col("_max") - F.col("height") <= 0.5) & (
        (F.col("_max") <= F.col("_room")) | g.near(F.col("_max"), F.col("_room"))
    )
    rows = rows.withColumn("uniform", F.bool_and(fits).over(page))
    return rows.withColumn("height", F.when(F.col("uniform"), F.col("_max")).otherwise(F.col("height"))).drop("_max", "_room")


def equal_slots(pages: DataFrame, n: int, top: float = 0.0, bottom: float = 0.0, gap: float = 0.0) -> DataFrame:
    """``n`` slots of equal height between the margins."""
    height = (F.col("page_height") - (top + bottom) - gap * (n - 1)) / n
    return pages.withColumn("position_index", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long")))).select(
        *PAGE, "position_index", F.concat(F.lit("slot-"), F.col("position_index").cast("string")).alias("slot_id"),
        (F.lit(top) + (F.col("position_index") - 1) * (height + gap)).alias("top"), height.alias("height"),
        (height >= MIN_HEIGHT).alias("valid"),
    )


def _meetings(slots: DataFrame, things: DataFrame) -> DataFrame:
    """Slot × thing rows of one page that intersect."""
    sides = [(F.col(f"{p}y0"), F.col(f"{p}y1")) for p in ("", "b_")]
    return meet(slots, things, list(PAGE), *sides).filter(g.intersects(Rect(), Rect("b_")))


def occupy_slots(slots: DataFrame, blocks: DataFrame, objects: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """What each slot holds: excluded when blank or marked empty, else occupied or uncertain.

    One row per slot with the counts the diagnostics are made from, and the columns of ``slots`` named by ``carry``. Text and
    objects meet the slots together, and a slot that meets nothing stays in that join, so slots are dealt out once.
    """
    b = blocks.filter(~F.col("is_watermark")).select(
        *PAGE, F.lit(True).alias("_text"), classify.vacant_marker(F.col("text")).alias("_mark"), F.col("confidence").alias("_conf"), *_rect("b_")
    )
    o = objects.filter((F.col("kind") == "fill-image") | ((F.col("x1") - F.col("x0") > 2) & (F.col("y1") - F.col("y0") > 2)))
    no_conf = F.lit(None).cast(b.schema["_conf"].dataType)
    o = o.select(*PAGE, F.lit(False).alias("_text"), F.lit(None).cast("boolean").alias("_mark"), no_conf.alias("_conf"), *_rect("b_"))
    keys = [*PAGE, "position_index"]
    inside = g.contains(Rect(), Rect("b_"))
    extra = [c for c in carry if c not in (*keys, *_R)]
    sides = [(F.col(f"{p}y0"), F.col(f"{p}y1")) for p in ("", "b_")]
    met = meet(slots.select(*keys, *extra, *_R), b.unionByName(o), list(PAGE), *sides, step=256.0, where=g.intersects(Rect(), Rect("b_")), keep=True)
    text, thing = F.col("_text"), ~F.col("_text")
    rows = met.groupBy(*keys, *extra, *_R).agg(
        F.count_if(text).alias("blocks"),
        F.count_if(text & F.col("_mark")).alias("markers"),
        F.count_if(text & F.col("_mark") & inside).alias("_inside_marks"),
        F.count_if(text & ~F.col("_mark") & inside).alias("complete"),
        F.count_if(text & ~F.col("_mark") & ~inside).alias("crossing"),
        F.count_if(text & ~F.col("_mark") & (F.col("_conf") < 0.9)).alias("uncertain_text"),
        F.count_if(thing).alias("objects"), F.count_if(thing & ~inside).alias("crossing_objects"),
    )
    content = F.col("blocks") - F.col("markers")
    reason = F.when((F.col("markers") > 0) & (content == 0) & (F.col("objects") == 0), "invalid").when(
        (F.col("blocks") == 0) & (F.col("objects") == 0), "blank"
    )
    return rows.select(
        *keys, *[c for c in carry if c not in keys], reason.alias("excluded_reason"),
        F.when(reason.isNotNull(), F.lit(None)).when(F.col("complete") > 0, "occupied").otherwise("uncertain").alias("occupancy"),
        "blocks", "objects", "crossing", "crossing_objects", "uncertain_text",
        (reason.isNull() & (F.col("_inside_marks") > 0) & ((content > 0) | (F.col("objects") > 0))).alias("suspected_invalid"),
    )


def outside_slots(slots: DataFrame, blocks: DataFrame) -> DataFrame:
    """Text lying in no slot of its page."""
    b = blocks.filter(~F.col("is_watermark") & ~classify.vacant_marker(F.col("text"))).select(*PAGE, "block_index", *_rect("b_"))
    met = _meetings(slots.select(*PAGE, *_R), b).select(*PAGE, "block_index").distinct()
    return b.join(met, [*PAGE, "block_index"], "left_anti").select(*PAGE, "block_index")


def split_cross_slot(blocks: DataFrame, lines: DataFrame, slots: DataFrame) -> DataFrame:
    """Replace a block touching several slots by its lines, if they fit it and spell the same text."""
    b = blocks.select(*PAGE, "block_index", F.col("text").alias("b_text"), *_rect("b_"))
    crossing = (
        _meetings(slots.select(*PAGE, *_R), b)
        .groupBy(*PAGE, "block_index")
        .agg(F.count(F.lit(1)).alias("_n"), F.first("b_text").alias("b_text"), *[F.first("b_" + c).alias("b_" + c) for c in _R])
        .filter("_n > 1")
        .drop("_n")
    )
    parts = lines.filter(tx.strip(F.col("text")) != "").join(crossing, [*PAGE, "block_index"])
    good = (
        parts.groupBy(*PAGE, "block_index")
        .agg(
            F.bool_and(g.contains(Rect("b_"), Rect())).alias("_fit"),
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: tx.no_space(s["text"])), ""
            ).alias("_joined"),
            F.first("b_text").alias("b_text"),
        )
        .filter(F.col("_fit") & (F.col("_joined") == tx.no_space(F.col("b_text"))))
        .select(*PAGE, "block_index")
    )
    keep = blocks.join(good, [*PAGE, "block_index"], "left_anti").select(
        *PAGE, "block_index", F.lit(0).cast("long").alias("line_no"), "text", *_R
    )
    new = parts.join(good, [*PAGE, "block_index"], "left_semi").select(
        *PAGE, "block_index", "line_no", tx.strip(F.col("text")).alias("text"), *_R
    )
    return keep.unionByName(new)


def number_segments(items: DataFrame, order: Sequence[str] = ("position_index",)) -> DataFrame:
    """1..n per page in position order."""
    w = Window.partitionBy(*PAGE).orderBy(*order)
    return items.withColumn("segment_no", F.row_number().over(w).cast("long"))


def layout_groups(items: DataFrame, fingerprint: Column) -> DataFrame:
    """How many items share each layout fingerprint, and over how many pages."""
    per_page = items.groupBy(fingerprint.alias("fingerprint"), *PAGE).agg(F.count(F.lit(1)).alias("_n"))
    return per_page.groupBy("fingerprint").agg(F.sum("_n").alias("items"), F.count(F.lit(1)).alias("pages"))


def page_policy_evidence(blocks: DataFrame) -> DataFrame:
    """Per page: usable title evidence, number of distinct titles, empty-slot markers."""
    several = F.size(F.filter(classify.split_lines(F.col("text")), classify.is_title)) > 1
    titled = ~F.col("is_watermark") & classify.is_title(F.col("text"))
    raw = blocks.withColumn("_t", titled).withColumn("_v", classify.vacant_marker(F.col("text")))
    # Titles at one place are read in block order, so that the one before a title does not depend on the run.
    w = Window.partitionBy(*PAGE).orderBy("y0", "x0", "block_index")
    t = raw.filter("_t").withColumn("_py", F.lag("y0").over(w)).withColumn("_px0", F.lag("x0").over(w)).withColumn("_px1", F.lag("x1").over(w))
    beside = F.coalesce(
        (F.abs(F.col("y0") - F.col("_py")) < 32) & (F.least("x1", "_px1") <= F.greatest("x0", "_px0")), F.lit(False)
    )
    heads = t.groupBy(*PAGE).agg(F.max(several | beside).alias("_odd"), F.min("y1").alias("_top"))
    counts = dedupe_by_gap(raw.filter("_t").select(*PAGE, "x0", "y0", "block_index")).groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("_n")
    )
    lowest = raw.groupBy(*PAGE).agg(F.max(F.when(F.col("_v"), F.col("y0"))).alias("_vy"))
    ok = F.coalesce(~F.col("_odd"), F.lit(False))
    return (
        lowest.join(heads, list(PAGE), "left")
        .join(counts, list(PAGE), "left")
        .select(
            *PAGE,
            F.when(ok, F.coalesce("_n", F.lit(0))).otherwise(F.lit(0)).alias("titles"),
            ok.alias("usable"),
            (ok & F.coalesce(F.col("_vy") > F.col("_top"), F.lit(False))).alias("vacant"),
        )
    )


def source_policy(evidence: DataFrame, keys: DataFrame) -> DataFrame:
    """single / multiple / unknown per page, from its own titles and the templates of its source.

    ``keys(source_id, page, template_key)`` lists known template keys; a page whose layout is
    not fully described has one NULL key. Source facts are pre-aggregated, and the keys of
    multi-slip pages are distinct per source, so a source holding a third of all pages only
    meets its own few template keys.
    """
    multi = (F.col("titles") > 1) | F.col("vacant")
    per_source = evidence.groupBy("source_id").agg(
        F.bool_and("usable").alias("_complete"), F.bool_or(multi).alias("_has_multi")
    )
    multi_keys = keys.join(evidence.filter(multi).select(*PAGE), list(PAGE), "left_semi")
    shared = multi_keys.groupBy("source_id", "template_key").agg(F.lit(True).alias("_shared"))
    unknown = multi_keys.groupBy("source_id").agg(F.bool_or(F.col("template_key").isNull()).alias("_unknown_multi"))
    mine = (
        keys.join(shared, ["source_id", "template_key"], "left")
        .groupBy(*PAGE)
        .agg(F.bool_and(F.col("template_key").isNotNull()).alias("_described"), F.bool_or("_shared").alias("_match"))
    )
    known = F.coalesce("_described", F.lit(False))
    return (
        evidence.join(per_source, "source_id")
        .join(unknown, "source_id", "left")
        .join(mine, list(PAGE), "left")
        .select(
            *PAGE,
            F.when(multi, "multiple")
            .when(~F.col("usable"), "unknown")
            .when(~F.col("_has_multi"), F.when(F.col("_complete"), "single").otherwise("unknown"))
            .when(known & F.coalesce("_match", F.lit(False)), "multiple")
            .when(known & F.col("_complete") & ~F.coalesce("_unknown_multi", F.lit(False)), "single")
            .otherwise("unknown")
            .alias("policy"),
        )
    )


def covering_forms(forms: DataFrame, refs: DataFrame) -> DataFrame:
    """``source_id, bank, keys, ref_keys``: each form with the reference forms of its source and bank that hold all its keys.

    Reference forms are listed under each of their keys; a form looks only under that of its keys with the
    shortest list, so a key that nearly all forms share is looked up by forms that have no other.
    """
    at = ["source_id", "bank"]
    listed = refs.select(*at, F.col("keys").alias("ref_keys"), F.explode("keys").alias("_k"))
    lengths = listed.groupBy(*at, "_k").agg(F.count(F.lit(1)).alias("_n"))
    shortest = F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_k").alias("key")))
    looked = (
        forms.select(*at, "keys", F.explode("keys").alias("_k"))
        .join(lengths, [*at, "_k"], "left")
        .groupBy(*at, "keys")
        .agg(shortest.alias("_r"))
        .filter("_r.n > 0")
        .select(*at, "keys", F.col("_r.key").alias("_k"))
    )
    return looked.join(listed, [*at, "_k"]).filter(F.size(F.array_except("keys", "ref_keys")) == 0).select(*at, "keys", "ref_keys")


def reference_layouts(pages: DataFrame) -> DataFrame:
    """Multi-slip layouts of a source that cover a page's template keys at the same bank.

    ``pages(source_id, page, slips, bank, keys)`` with ``keys`` a sorted array. Pages with equal
    (bank, keys) are interchangeable, so the containment join runs over distinct layouts of a
    source, not over its pages; each page then gets its lowest reference page and their number.
    """
    forms = pages.filter((F.size("keys") > 0) & F.col("bank").isNotNull())
    shape = ["source_id", "bank", "keys"]
    refs = forms.filter("slips > 1").groupBy(*shape).agg(
        F.min("page").alias("first_page"), F.count(F.lit(1)).alias("ref_pages")
    )
    found = (
        covering_forms(forms.select(*shape).distinct(), refs)
        .join(refs.withColumnRenamed("keys", "ref_keys"), ["source_id", "bank", "ref_keys"])
        .groupBy(*shape)
        .agg(F.min("first_page").alias("first_page"), F.sum("ref_pages").alias("ref_pages"))
    )
    return forms.join(found, shape).withColumn(
        "other_pages", F.col("ref_pages") - F.when(F.col("slips") > 1, 1).otherwise(0)
    ).filter("other_pages > 0").select(*PAGE, "first_page", "other_pages")


def page_forms(pages: DataFrame, headings: DataFrame) -> DataFrame:
    """``source_id, page, basis, bank, keys`` of every page that can look for reference pages.

    ``pages(source_id, page, slips, titles, vacant, bank, keys)``, ``bank`` NULL unless the page has exactly one;
    ``headings(source_id, page, heading)``. A page described in full is known by its template keys (basis
    ``template``), any other with a heading by its set of headings (basis ``heading``, no bank).
    """
    full = (F.size("keys") > 0) & F.col("bank").isNotNull()
    described = pages.filter(full).select(*PAGE, F.lit("template").alias("basis"), "bank", F.array_sort(F.array_distinct("keys")).alias("keys"))
    rest = pages.filter(~F.coalesce(full, F.lit(False))).select(*PAGE)
    titled = (
        headings.filter(F.col("heading").isNotNull())
        .join(rest, list(PAGE), "left_semi")
        .groupBy(*PAGE)
        .agg(F.array_sort(F.collect_set("heading")).alias("keys"))
    )
    return described.unionByName(titled.select(*PAGE, F.lit("heading").alias("basis"), F.lit("").alias("bank"), "keys"))


def reference_pages(pages: DataFrame, headings: DataFrame) -> DataFrame:
    """``source_id, basis, bank, keys, reference_page``: every page of several slips that a form may take its slots from.

    The first four name a form of :func:`page_forms`, whose inputs these are; a page finds its references by joining
    on them, those of basis ``template`` other than itself. Template references have several slips, the same
    bank and all keys of the form. Where the form is not known in full, a page of several titles that shares one of its headings will do.
    Pages of equal form are looked up once, so the rows grow with forms times reference pages, not with pages times pages.
    """
    forms = page_forms(pages, headings)
    shape = ["source_id", "bank", "keys"]
    known = forms.filter("basis = 'template'")
    several = pages.filter((F.col("titles") > 1) | F.col("vacant"))
    sources = known.join(several.filter("slips > 1").select(*PAGE), list(PAGE), "left_semi").select(*shape, F.col("page").alias("reference_page"))
    by_keys = (
        covering_forms(known.select(*shape).distinct(), sources.select(*shape).distinct())
        .join(sources.withColumnRenamed("keys", "ref_keys"), ["source_id", "bank", "ref_keys"])
        .select("source_id", F.lit("template").alias("basis"), "bank", "keys", "reference_page")
    )
    # Equal heading sets of references are looked up once as well.
    sets = (
        headings.filter(F.col("heading").isNotNull())
        .join(pages.filter("titles > 1").select(*PAGE), list(PAGE), "left_semi")
        .groupBy(*PAGE)
        .agg(F.array_sort(F.collect_set("heading")).alias("ref_keys"))
    )
    offered = sets.select("source_id", "ref_keys").distinct().withColumn("_k", F.explode("ref_keys"))
    wanted = forms.filter("basis = 'heading'").select("source_id", "keys").distinct().withColumn("_k", F.explode("keys"))
    by_heading = (
        wanted.join(offered, ["source_id", "_k"])
        .select("source_id", "keys", "ref_keys")
        .distinct()
        .join(sets, ["source_id", "ref_keys"])
        .select("source_id", F.lit("heading").alias("basis"), F.lit("").alias("bank"), "keys", F.col("page").alias("reference_page"))
    )
    return by_keys.unionByName(by_heading)
