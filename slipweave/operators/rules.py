"""Layout templates and field-reading rules kept as tables.

Label positions are relative to the slip (0..1). ``rule_labels(rule_id, kind, rx0, ry0, rx1,
ry1)`` belong to ``rules(rule_id, bank_name, aspect, batch_only, active)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipweave.functions import geometry as g
from slipweave.functions import text as tx
from slipweave.functions.geometry import Rect
from slipweave.operators.nearby import band_pairs

REL = ("rx0", "ry0", "rx1", "ry1")
_R = ("x0", "y0", "x1", "y1")
TOLERANCE = 0.012


def layouts(labels: DataFrame, key: str) -> DataFrame:
    """``key, labels``: the labels of each layout as one sorted array of ``(kind, rx0, ry0, rx1, ry1)``, as long as one slip has labels."""
    return labels.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("kind", *REL))).alias("labels"))


def _close(p: Column, q: Column, tol: float) -> Column:
    """Labels of one kind whose edges lie within ``tol``."""
    return F.coalesce((p["kind"] == q["kind"]) & (F.greatest(*[F.abs(p[c] - q[c]) for c in REL]) <= tol), F.lit(False))


def one_to_one(a: Column, b: Column, tol: float = TOLERANCE) -> Column:
    """Whether two label arrays pair off: each label has exactly one partner on the other side."""
    def single(some: Column, others: Column) -> Column:
        return F.forall(some, lambda p: F.size(F.filter(others, lambda q: _close(p, q, tol))) == 1)

    return (F.size(a) == F.size(b)) & single(a, b) & single(b, a)


def match_layout_one_to_one(pairs: DataFrame, left: DataFrame, right: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """Pairs ``(a_id, b_id)`` whose labels match kind by kind, edge by edge, each used once.

    ``left(a_id, kind, …)`` and ``right(b_id, kind, …)``. A layout travels as one array, so a pair stays one row.
    """
    a, b = layouts(left, "a_id").withColumnRenamed("labels", "_a"), layouts(right, "b_id").withColumnRenamed("labels", "_b")
    return pairs.join(a, "a_id").join(b, "b_id").filter(one_to_one(F.col("_a"), F.col("_b"), tol)).select("a_id", "b_id")


def _cells(low: Column, high: Column, width: float) -> Column:
    """Numbers of the cells an interval touches."""
    return F.sequence(F.floor(low / width), F.floor(high / width))


def _candidates(rules: DataFrame, shapes: DataFrame, tol: float, aspect_tol: float) -> DataFrame:
    """Rows ``(a_id, b_id, _at, _home, _a, _b)`` of rules and shapes that may match; ``_at`` and ``_home`` are the labels that met."""
    width, stretch = 4 * tol, 4 * aspect_tol
    kinds, first = F.xxhash64(F.transform("labels", lambda q: q["kind"])), F.element_at("labels", 1)
    probes = rules.select("a_id", "bank", F.col("aspect").alias("_ra"), F.col("labels").alias("_a"), kinds.alias("_kinds"), first.alias("_at")).withColumn("kind", F.col("_at.kind"))
    for c in REL:
        probes = probes.withColumn("_" + c, F.explode(_cells(F.col("_at")[c] - tol, F.col("_at")[c] + tol, width)))
    low, high = F.log(F.col("_ra") * (1 - aspect_tol)), F.log(F.col("_ra") * (1 + aspect_tol))
    probes = probes.withColumn("_aspect", F.explode(_cells(low - 1e-9, high + 1e-9, stretch)))
    home = F.explode(F.filter("labels", lambda q: q["kind"] == F.element_at("labels", 1)["kind"]))
    homes = shapes.select("b_id", "bank", F.col("aspect").alias("_sa"), F.col("labels").alias("_b"), kinds.alias("_kinds"), home.alias("_home"))
    homes = homes.withColumns({"kind": F.col("_home.kind"), **{"_" + c: F.floor(F.col("_home")[c] / width) for c in REL}, "_aspect": F.floor(F.log("_sa") / stretch)})
    met = probes.join(homes, ["bank", "_kinds", "kind", *["_" + c for c in REL], "_aspect"])
    return met.filter(F.abs(F.col("_sa") / F.col("_ra") - 1) <= aspect_tol)


def layout_candidates(rules: DataFrame, rule_labels: DataFrame, shapes: DataFrame, shape_labels: DataFrame, tol: float = TOLERANCE, aspect_tol: float = 0.015) -> DataFrame:
    """Pairs ``(a_id, b_id)`` of a rule and a shape that may match, by a grid of label boxes; a match is never left out.

    ``rules(a_id, bank, aspect)``, ``shapes(b_id, bank, aspect)`` and their labels. What matches has the same bank, the same multiset of
    kinds, and for each label of the rule one of the shape within ``tol`` on all edges. Of the first kind in order a rule takes one label: the shape's
    partner of it lies in one of the few grid cells within ``tol``, which the rule probes. A shape stands in one cell for each of its labels of that kind. The aspect
    is a fifth axis. So rules and shapes meet on a hash key, and a bank with many rules spreads over its layouts.
    """
    drawn = rules.select("a_id", "bank", "aspect").join(layouts(rule_labels, "a_id"), "a_id")
    printed = shapes.select("b_id", "bank", "aspect").join(layouts(shape_labels, "b_id"), "b_id")
    return _candidates(drawn, printed, tol, aspect_tol).select("a_id", "b_id").distinct()


def match_rules(slips: DataFrame, slip_labels: DataFrame, rules: DataFrame, rule_labels: DataFrame, tol: float = TOLERANCE, aspect_tol: float = 0.015) -> DataFrame:
    """The one active rule of a slip's bank that fits its labels, else none or multiple.

    ``slips(segment_id, bank, aspect, reliable, signature)``: equal signatures have equal labels, so the labels of one slip stand for all of
    its (bank, aspect, signature). What is matched are distinct (bank, aspect, labels), of slips and of rules, as the labels of different signatures
    may be equal too; they meet by the grid of :func:`layout_candidates`.
    """
    shape, layout = ["bank", "aspect", "signature"], ["bank", "aspect", "labels"]
    seen = slips.filter("reliable").groupBy(*shape).agg(F.min("segment_id").alias("b_id"))
    printed = seen.join(layouts(slip_labels, "segment_id").withColumnRenamed("segment_id", "b_id"), "b_id")
    shapes = printed.groupBy(*layout).agg(F.min("b_id").alias("b_id"))
    live = rules.filter("active and not batch_only").select(F.col("rule_id").alias("a_id"), F.col("bank_name").alias("bank"), "aspect")
    drawn = live.join(layouts(rule_labels, "rule_id").withColumnRenamed("rule_id", "a_id"), "a_id")
    kinds = drawn.groupBy(*layout).agg(F.min("a_id").alias("a_id"), F.count(F.lit(1)).alias("_same"))
    # A pair that fits meets once: by the one label of the shape that is the partner of the rule's first.
    met = _candidates(kinds, shapes, tol, aspect_tol).filter(_close(F.col("_at"), F.col("_home"), tol) & one_to_one(F.col("_a"), F.col("_b"), tol))
    fit = met.select("a_id", "b_id").join(kinds.select("a_id", "_same"), "a_id")
    per_shape = fit.groupBy("b_id").agg(F.sum("_same").alias("_n"), F.min("a_id").alias("_rule"))
    found = shapes.join(per_shape, "b_id").drop("b_id")
    by_shape = printed.join(found, layout).select(*shape, "_n", "_rule")
    return slips.join(by_shape, shape, "left").select(
        "segment_id", F.when(F.col("reliable") & (F.col("_n") == 1), F.col("_rule")).alias("rule_id"),
        F.when(~F.col("reliable"), "labels_unavailable").when(F.col("_n") == 1, "matched").when(F.col("_n") > 1, "multiple_rules").otherwise("no_rule").alias("reason"),
    )


def compile_rule(fields: DataFrame, labels: DataFrame) -> DataFrame:
    """Anchor label of each drawn field: left on its row or just above; near ties give none.

    ``fields(rule_id, role, field, …)`` with their region, ``labels`` of the same slip.
    """
    lab = labels.select("rule_id", F.col("kind").alias("l_kind"), *[F.col(c).alias("l_" + c) for c in REL])
    f, b = Rect(x0="rx0", y0="ry0", x1="rx1", y1="ry1"), Rect(x0="l_rx0", y0="l_ry0", x1="l_rx1", y1="l_ry1")
    same_row = (g.overlap_height(f, b) > 0) & (b.x0 <= f.x1) & (f.x0 - b.x1 <= 0.25)
    above = (f.y0 - b.y1 >= 0) & (f.y0 - b.y1 <= 0.06) & (g.overlap_width(f, b) > 0)
    fits = F.col("l_kind").isin(F.col("field")) | (F.col("l_kind") == F.concat_ws(".", "role", "field"))
    score = F.abs(f.cy - b.cy) * 3 + F.abs(f.cx - b.cx)
    key = ["rule_id", "role", "field"]
    near = fields.join(lab, "rule_id").filter(fits & (same_row | above)).withColumn("_s", score)
    w = Window.partitionBy(*key).orderBy("_s")
    best = near.withColumn("_n", F.row_number().over(w)).withColumn("_gap", F.lead("_s").over(w) - F.col("_s")).filter(
        "_n = 1 and (_gap is null or _gap >= 0.005)"
    )
    got = best.select(*key, F.col("l_kind").alias("anchor_kind"), *[F.col("l_" + c).alias("a_" + c) for c in REL])
    rows = fields.join(got, key, "left")
    return rows.withColumn("batch_only", F.bool_or(F.col("anchor_kind").isNull()).over(Window.partitionBy("rule_id")))


def read_rule(glyphs: DataFrame, regions: DataFrame, labels: DataFrame) -> DataFrame:
    """Text of the glyphs inside each configured region, with the state it deserves.

    ``glyphs(segment_id, line_no, glyph_no, c, x0…)``, ``regions(segment_id, role, field, x0…)``,
    ``labels(segment_id, kind, x0…)``. A cut glyph, a glyph running on beside the region, two
    rows or a foreign label make the field ambiguous.
    """
    key = ["segment_id", "role", "field"]
    lab = labels.select("segment_id", F.col("kind").alias("l_kind"), *[F.col(c).alias("l_" + c) for c in _R])
    r, c, b = Rect(), Rect("g_"), Rect("l_")
    foreign = (
        regions.join(lab, "segment_id")
        .filter(g.intersects(r, b) & (F.col("l_kind") != F.col("field")) & (F.col("l_kind") != F.concat_ws(".", "role", "field")))
        .select(*key).distinct().withColumn("_foreign", F.lit(True))
    )
    gl = glyphs.select("segment_id", F.col("line_no").alias("g_line"), F.col("glyph_no").alias("g_no"), F.col("c").alias("g_c"), *[F.col(x).alias("g_" + x) for x in _R])
    in_label = (
        band_pairs(gl, lab.withColumn("l_y", (F.col("l_y0") + F.col("l_y1")) / 2), ["segment_id"], c.y0 - 12, c.y1 + 12, "y", prefix="l_")
        .filter(g.intersection_area(b, c) >= g.area(c) * 0.8)
        .select("segment_id", "g_line", "g_no").distinct()
    )
    free = gl.join(in_label, ["segment_id", "g_line", "g_no"], "left_anti").filter(~F.col("g_c").isin(":", "："))
    near = band_pairs(regions, free.withColumn("g_y", c.cy), ["segment_id"], r.y0 - 12, r.y1 + 12, "y", prefix="g_")
    inside, touch = g.contains(r, c), g.intersects(r, c)
    ink = tx.strip(F.col("g_c")) != ""
    rows = near.groupBy(*key, "g_line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(inside, F.struct("g_no", "g_c")))), lambda s: s["g_c"]), "").alias("_t"),
        F.max(touch & ~inside & ink).alias("_cut"),
        F.min(F.when(inside & ink, c.x0)).alias("_left"), F.max(F.when(inside & ink, c.x1)).alias("_right"),
        F.collect_list(F.when(~touch & ink, F.struct(c.x0.alias("a"), c.x1.alias("b"), F.greatest(F.lit(1.0), c.height).alias("h")))).alias("_out"),
    )
    runs_on = F.exists(
        "_out",
        lambda o: ((F.col("_left") - o["b"] >= 0) & (F.col("_left") - o["b"] <= o["h"] * 1.2))
        | ((o["a"] - F.col("_right") >= 0) & (o["a"] - F.col("_right") <= o["h"] * 1.2)),
    )
    text = tx.strip(F.col("_t"))
    per = rows.groupBy(*key).agg(
        F.count_if(text != "").alias("_rows"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(text != "", F.struct("g_line", text.alias("t"))))), lambda s: s["t"]), "\n").alias("raw"),
        F.max(F.coalesce("_cut", F.lit(False)) | F.coalesce(runs_on, F.lit(False))).alias("_bad"),
    )
    full = regions.select(*key).join(per, key, "left").join(foreign, key, "left")
    conflict = (F.coalesce("_rows", F.lit(0)) > 1) | F.coalesce("_bad", F.lit(False)) | F.coalesce("_foreign", F.lit(False))
    raw = F.coalesce("raw", F.lit(""))
    value = F.when(F.col("field") == "account", tx.norm_account(raw)).otherwise(tx.norm_name(raw))
    odd_account = (F.col("field") == "account") & (value != "") & (
        ~value.rlike("^[0-9A-Za-z-]{6,80}$") | value.rlike("[*＊×xX]") | ~value.rlike("[0-9]")
    )
    blank = value.isin("-", "—", "--", "无", "空")
    state = F.when(conflict, "ambiguous").when(blank, "blank").when(odd_account, "ambiguous").when(value == "", "missing").otherwise("present")
    return full.select(*key, raw.alias("raw"), F.when(blank, "").otherwise(value).alias("value"), state.alias("state"))


def resolve_auto_roles(slots: DataFrame, own_account: str, own_name: str) -> DataFrame:
    """Which side each neutral region of a two-region rule belongs to.

    ``slots(segment_id, slot, anchor_role, name, account, own_side)``: an anchored role decides;
    else the one slot with our account (or, without account, our name) is ours and the other is
    the counterparty; on slips with a known side they become payer and payee.
    """
    seg = Window.partitionBy("segment_id")
    acc, name = F.coalesce("account", F.lit("")), F.coalesce("name", F.lit(""))
    ours = ((acc == own_account) & name.isin("", own_name)) | ((acc == "") & (name == own_name))
    rows = slots.withColumn("_ours", ours).withColumns(
        {"_n": F.count_if("_ours").over(seg), "_slots": F.count(F.lit(1)).over(seg), "_acc": F.count_if(acc == own_account).over(seg)}
    )
    other = F.when(F.col("own_side") == "payer", "payee").when(F.col("own_side") == "payee", "payer")
    by_own = F.when(F.col("_ours"), F.coalesce("own_side", F.lit("own"))).otherwise(F.coalesce(other, F.lit("counterparty")))
    role = F.when(F.col("_acc") > 1, F.lit(None).cast("string")).when(F.col("anchor_role").isNotNull(), F.col("anchor_role")).when(
        (F.col("_n") == 1) & (F.col("_slots") == 2), by_own
    )
    return rows.withColumn("role", role).withColumn("resolved", F.bool_and(F.col("role").isNotNull()).over(seg)).select("segment_id", "slot", "role", "resolved")


def merge_rule(base: DataFrame, read: DataFrame) -> DataFrame:
    """Rule readings over the automatic ones: a certain value beats an uncertain reading, two
    certain different ones are ambiguous, a missing reading changes nothing."""
    key = ["segment_id", "side", "field"]
    r = read.select(*key, *[F.col(c).alias("r_" + c) for c in ("raw", "value", "state")])
    rows = base.join(r, key, "full")
    old, new = F.coalesce("state", F.lit("missing")), F.coalesce("r_state", F.lit("missing"))
    sure, unsure = old.isin("present", "blank"), new.isin("missing", "ambiguous")
    differ = (old != new) | (tx.no_space(F.col("value")) != tx.no_space(F.col("r_value")))
    action = (
        F.when(F.col("r_state").isNull(), "keep").when(sure & unsure, "protect")
        .when((old != "missing") & (new != "missing"), F.when(differ, "conflict").otherwise("take"))
        .when(new == "missing", "keep").otherwise("take")
    )
    rows = rows.withColumn("_a", action)

    def pick(c: str, conflict: Column, empty: str = "") -> Column:
        return F.when(F.col("_a") == "take", F.col("r_" + c)).when(F.col("_a") == "conflict", conflict).otherwise(F.coalesce(c, F.lit(empty))).alias(c)

    return rows.select(
        *key, pick("raw", F.concat_ws(" | ", "raw", "r_raw")), pick("value", F.concat_ws(" | ", "value", "r_value")),
        pick("state", F.lit("ambiguous"), "missing"),
        F.when(F.col("_a") == "protect", "rule_incompatible").when(F.col("_a") == "conflict", "conflicting_field").alias("issue"),
    )


def trial_rule(before: DataFrame, after: DataFrame, protected: DataFrame) -> DataFrame:
    """Dry run of a rule per slip: changed, unchanged, pending or skipped with the reason.

    ``before``/``after(segment_id, name, route)``; ``protected(segment_id, reason)``.
    """
    rows = before.join(after.select("segment_id", F.col("name").alias("after_name"), F.col("route").alias("after_route")), "segment_id", "left").join(
        protected.groupBy("segment_id").agg(F.min("reason").alias("skip_reason")), "segment_id", "left"
    )
    same = F.col("name").eqNullSafe(F.col("after_name")) & F.col("route").eqNullSafe(F.col("after_route"))
    outcome = (
        F.when(F.col("skip_reason").isNotNull(), "skipped").when(F.col("after_route").isNull(), "skipped")
        .when(F.col("after_route") == "counterparty_pending", "pending").when(same, "unchanged").otherwise("changed")
    )
    return rows.select("segment_id", "name", "route", "after_name", "after_route", outcome.alias("outcome"), F.coalesce("skip_reason", F.when(F.col("after_route").isNull(), "rule_incompatible")).alias("skip_reason"))


def apply_rule(current: DataFrame, trial: DataFrame) -> DataFrame:
    """Publish only the changed slips of a trial, at their next revision."""
    new = trial.filter("outcome = 'changed'").select("segment_id", "after_name", "after_route", F.lit(True).alias("_c"))
    hit = F.coalesce("_c", F.lit(False))
    return current.join(new, "segment_id", "left").select(
        "segment_id", F.when(hit, F.col("after_name")).otherwise(F.col("name")).alias("name"), F.when(hit, F.col("after_route")).otherwise(F.col("route")).alias("route"),
        (F.col("revision") + hit.cast("int")).alias("revision"),
    )


def match_template(pages: DataFrame, templates: DataFrame, exact: bool = True) -> DataFrame:
    """The one active template of a page: full key when ``exact``, else only the slot shape."""
    keys = ["scope", "fingerprint", "geometry", "slot_shape"] if exact else ["slot_shape"]
    per_key = templates.filter("active").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("template_id").alias("_t"))
    return pages.join(per_key, keys, "left").select(
        "page", F.when(F.col("_n") == 1, F.col("_t")).alias("template_id"),
        F.when(F.col("_n") == 1, "matched").when(F.col("_n") > 1, "multiple").otherwise("none").alias("reason"),
    )


COMPATIBILITY = ("workspace", "page_geometry", "issuer", "family", "slot_structure")


def layout_compatibility(sample: DataFrame, targets: DataFrame) -> DataFrame:
    """First property in which a target differs from its sample, NULL when none does."""
    s = sample.select("sample_id", *[F.col(c).alias("s_" + c) for c in COMPATIBILITY])
    rows = targets.join(s, "sample_id")
    reason = F.lit(None).cast("string")
    for c in reversed(COMPATIBILITY):
        reason = F.when(~F.col(c).eqNullSafe(F.col("s_" + c)), c).otherwise(reason)
    unverified = F.col("issuer").isNull() & F.col("family").isNull()
    return rows.withColumn("reason", F.coalesce(reason, F.when(unverified, "unverified")))


def apply_reference_series(layouts: DataFrame, refs: DataFrame) -> DataFrame:
    """Slot positions from confirmed references: newest version per slot wins, one series only.

    ``layouts(layout_id, shape, margins, position_index, top, height)``;
    ``refs(series, shape, margins, version, position_index, top, height)``. A series applies to
    a shape when its margins agree; several applicable series leave the layout alone.
    """
    newest = refs.groupBy("shape", "margins", "series", "position_index").agg(F.max(F.struct("version", "top", "height")).alias("_p"))
    single = newest.groupBy("shape", "margins").agg(F.count_distinct("series").alias("_n")).filter("_n = 1").select("shape", "margins")
    chosen = newest.join(single, ["shape", "margins"], "left_semi").select("shape", "margins", "position_index", "_p")
    hit = F.col("_p").isNotNull()
    return layouts.join(chosen, ["shape", "margins", "position_index"], "left").select(
        "layout_id", "position_index", F.when(hit, F.col("_p.top")).otherwise(F.col("top")).alias("top"),
        F.when(hit, F.col("_p.height")).otherwise(F.col("height")).alias("height"), hit.alias("from_reference"),
    )


def current_templates(templates: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """Newest version of every series, if it is active and not withdrawn; never an older one."""
    rest = [c for c in templates.columns if c not in ("series", "version")]
    newest = templates.groupBy("series").agg(F.max(F.struct("version", *rest)).alias("_t")).select("series", "_t.*")
    return newest.join(withdrawals.select("series", "version"), ["series", "version"], "left_anti").filter("active")


def withdraw_templates(templates: DataFrame, undone: DataFrame) -> DataFrame:
    """Deactivate templates produced by, or composed from, an undone operation."""
    gone = (
        templates.select("template_id", F.explode_outer(F.array_union(F.array("operation_id"), F.coalesce("sources", F.array().cast("array<bigint>")))).alias("operation_id"))
        .join(undone.select("operation_id").distinct(), "operation_id", "left_semi")
        .select("template_id").distinct().withColumn("_gone", F.lit(True))
    )
    return templates.join(gone, "template_id", "left").withColumn("active", F.col("active") & F.col("_gone").isNull()).drop("_gone")


def template_fingerprint(lines: DataFrame, labels: DataFrame, keys: Sequence[str] = ("segment_id",)) -> DataFrame:
    """Hash of ruling lines and fixed labels relative to the title, values left out.

    Positions keep one decimal; two lines or three labels are the least evidence.
    """
    def rel(c: str, base: str) -> Column:
        return F.format_string("%.1f", F.round(F.col(c) - F.col(base), 1))

    rule = lines.select(*keys, F.concat_ws("|", F.lit("line"), rel("x0", "title_x"), rel("y0", "title_y"), rel("x1", "title_x"), rel("y1", "title_y")).alias("_e"), F.lit(1).alias("_l"), F.lit(0).alias("_b"))
    mark = labels.select(*keys, F.concat_ws("|", F.lit("label"), "kind", rel("x0", "title_x"), rel("y0", "title_y")).alias("_e"), F.lit(0).alias("_l"), F.lit(1).alias("_b"))
    parts = rule.unionByName(mark).groupBy(*keys, "_e").agg(F.max("_l").alias("_l"), F.max("_b").alias("_b"))
    return parts.groupBy(*keys).agg(
        F.when((F.sum("_l") >= 2) | (F.sum("_b") >= 3), F.sha2(F.array_join(F.array_sort(F.collect_list("_e")), "\n"), 256)).alias("fingerprint")
    )


def adjust_slots(slots: DataFrame, edits: DataFrame, uniform: bool = False) -> DataFrame:
    """Slots with edited top and height (``uniform``: one edited height for the whole page), and
    whether the page is still valid."""
    e = edits.select("source_id", "page", "position_index", F.col("top").alias("_t"), F.col("height").alias("_h"))
    page = Window.partitionBy("source_id", "page")
    rows = slots.join(e, ["source_id", "page", "position_index"], "left")
    height = F.coalesce(F.max("_h").over(page), F.col("height")) if uniform else F.coalesce("_h", "height")
    rows = rows.withColumn("_nt", F.coalesce("_t", "top")).withColumn("_nh", height)
    nxt = F.lead("_nt").over(page.orderBy("position_index"))
    end = F.col("_nt") + F.col("_nh")
    bad = (F.col("_nh") < 12) | (F.col("_nt") < 0) | ((end > F.col("page_height")) & ~g.near(end, F.col("page_height"))) | F.coalesce((end > nxt) & ~g.near(end, nxt), F.lit(False))
    return rows.withColumn("_bad", bad).withColumn("valid", ~F.max("_bad").over(page)).select(
        "source_id", "page", "position_index", F.col("_nt").alias("top"), F.col("_nh").alias("height"), "valid"
    )


def affected_slots(before: DataFrame, after: DataFrame) -> DataFrame:
    """Positions whose rectangle changed; all of a page whose slot list changed."""
    key = ["source_id", "page", "position_index"]
    b = before.select(*key, F.col("top").alias("_t0"), F.col("height").alias("_h0"))
    a = after.select(*key, F.col("top").alias("_t1"), F.col("height").alias("_h1"))
    rows = b.join(a, key, "full")
    lists = F.max(F.col("_t0").isNull() | F.col("_t1").isNull()).over(Window.partitionBy("source_id", "page"))
    moved = ~(g.near(F.col("_t0"), F.col("_t1")) & g.near(F.col("_h0"), F.col("_h1")))
    return rows.withColumn("_all", lists).filter(F.col("_all") | F.coalesce(moved, F.lit(True))).select(*key)


def preview_layout_change(before: DataFrame, after: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per slot of every page: added, removed, changed, unchanged or kept by hand, with what it risks.

    ``before``/``after(source_id, page, position_index, x0…, occupancy)``; ``reviews`` hold the
    kept manual rectangles and statuses of the same slots.
    """
    key = ["source_id", "page", "position_index"]
    b = before.select(*key, *[F.col(c).alias("b_" + c) for c in _R], F.lit(True).alias("_b"))
    a = after.select(*key, *[F.col(c).alias("a_" + c) for c in _R], "occupancy", F.lit(True).alias("_a"))
    m = reviews.select(*key, *[F.col(c).alias("m_" + c) for c in _R], "manual_adjusted", "review_status")
    rows = b.join(a, key, "full").join(m, key, "left")
    same = F.lit(True)
    for c in _R:
        same = same & g.near(F.col("a_" + c), F.col("b_" + c))
    manual = F.coalesce("manual_adjusted", F.lit(False))
    change = (
        F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(manual, "retained_manual").when(same, "unchanged").otherwise("changed")
    )
    blocker = F.when(manual & F.col("_a").isNotNull() & ~g.contains(Rect("a_"), Rect("m_")), "manual_crop_outside")
    risk = F.when(F.col("occupancy") == "uncertain", "uncertain_content").when((F.col("review_status") == "excluded") & (change != "unchanged"), "exclusion_reset")
    return rows.select(*key, change.alias("change"), blocker.alias("blocker"), risk.alias("risk"))
