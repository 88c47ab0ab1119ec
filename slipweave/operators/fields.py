"""Reading labelled fields out of the text lines of a slip.

Lines meet labels through (segment, horizontal band) keys, so a crowded slip never forms all
its pairs. Field states are always a column of their own; absence of text is never ``blank``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipweave.functions import geometry as g
from slipweave.functions import text as tx
from slipweave.functions.geometry import Rect
from slipweave.functions.settle import settle
from slipweave.operators.nearby import band_pairs, meet
from slipweave.schema import FIELDS, SIDES
from slipweave.session import dealt, stage

SEG = ["segment_id"]
CELL = ["segment_id", "line_no", "cell_no"]
_R = ("x0", "y0", "x1", "y1")
# Texts that begin a row of their own inside a party table. Fixed values.
ROW_BOUNDARIES = (
    "金额", "金额大写", "币种", "摘要", "备注", "用途", "附言", "客户附言",
    "交易流水号", "交易日期", "记账时间", "开户行号", "银行行号", "业务类型",
)
ROLE_WORDS = {"付款人": "payer", "付款方": "payer", "收款人": "payee", "收款方": "payee"}


def prefixed(prefix: str, cols=_R) -> list[Column]:
    return [F.col(c).alias(prefix + c) for c in cols]


def clip_lines(lines: DataFrame, scopes: DataFrame, slack: float = 0.5) -> DataFrame:
    """Lines of a page against the slips of that page: kept inside, reported when cut.

    Returns ``segment_id`` with ``clip`` = ``inside`` or ``crosses``; other lines are dropped.
    """
    s = scopes.select("source_id", "page", "segment_id", *prefixed("s"))
    r, o = Rect(), Rect("s")
    inside = (r.x0 >= o.x0 - slack) & (r.y0 >= o.y0 - slack) & (r.x1 <= o.x1 + slack) & (r.y1 <= o.y1 + slack)
    clip = F.when(inside, "inside").when((g.intersection_area(r, o) > 0) & (g.area(r) > 0), "crosses")
    pairs = meet(lines, s, ["source_id", "page"], (F.col("y0") - slack, F.col("y1") + slack), (F.col("sy0"), F.col("sy1")))
    return pairs.withColumn("clip", clip).filter("clip is not null")


def column_centers(cells: DataFrame) -> DataFrame:
    """Mean x centre of each side's labels per slip."""
    mid = (F.col("x0") + F.col("x1")) / 2
    return cells.groupBy(*SEG).agg(*[F.avg(F.when(F.col("side") == s, mid)).alias(f"{s}_x") for s in SIDES])


def nearest_side(x: Column) -> Column:
    """Side whose column centre is nearest; the payer on a tie, NULL without any centre."""
    pay, rec = F.abs(x - F.col("payer_x")), F.abs(x - F.col("payee_x"))
    return F.when(pay.isNull() & rec.isNull(), F.lit(None).cast("string")).when(
        rec.isNull() | (pay <= rec), "payer"
    ).otherwise("payee")


def column_side(generic: DataFrame, anchors: DataFrame) -> DataFrame:
    """Side of labels that name only a field.

    Columns side by side: the nearest column centre. Stacked blocks (centres within four label
    heights): the closest preceding role in the same column, if it is one role.
    """
    r = Rect()
    h = F.greatest(F.lit(1.0), r.height)
    lab = generic.join(dealt(column_centers(anchors)), SEG, "left").withColumn(
        "_stacked", F.coalesce(F.abs(F.col("payer_x") - F.col("payee_x")) <= h * 4, F.lit(False))
    )
    a = anchors.select(*SEG, F.col("side").alias("a_side"), F.col("x0").alias("a_x0"), F.col("y0").alias("a_y0"))
    before = (
        lab.filter("_stacked")
        .join(dealt(a), SEG)
        .filter((F.col("a_y0") <= r.y0 + h * 0.25) & (F.abs(F.col("a_x0") - r.x0) <= h * 4))
        .groupBy(*CELL)
        .agg(
            F.max("a_y0").alias("_y"), F.first(h).alias("_h"),
            F.max(F.when(F.col("a_side") == "payer", F.col("a_y0"))).alias("_pay"),
            F.max(F.when(F.col("a_side") == "payee", F.col("a_y0"))).alias("_rec"),
        )
    )
    close = F.col("_y") - F.col("_h") * 0.25
    pay, rec = F.coalesce(F.col("_pay") >= close, F.lit(False)), F.coalesce(F.col("_rec") >= close, F.lit(False))
    role = before.select(*CELL, F.when(pay & ~rec, "payer").when(rec & ~pay, "payee").alias("_role"))
    return (
        lab.join(dealt(role), CELL, "left")
        .withColumn("side", F.when(F.col("_stacked"), F.col("_role")).otherwise(nearest_side(r.cx)))
        .drop("_stacked", "_role", "payer_x", "payee_x")
    )


def role_headers(lines: DataFrame, generic: DataFrame) -> DataFrame:
    """The payer and payee column headers of a party table, where a slip has exactly one pair.

    Headers are written across or one character per line. Each needs a name and an account
    label of its own close by and aligned, so stray role words never make a table.
    """
    one = settle(lines.select(*SEG, "line_no", "text", *_R), {"_c": tx.no_space(F.col("text"))})
    # Read once for each character of a header, so only what may be one is kept.
    one = stage(one.filter(F.col("_c").isin(*ROLE_WORDS, "付", "收", "款", "人", "方")).drop("text"))
    r = Rect()
    flat = one.filter(F.col("_c").isin(*ROLE_WORDS)).select(
        *SEG, F.when(F.col("_c").startswith("付"), "payer").otherwise("payee").alias("side"), *_R,
        F.col("line_no").alias("first_line"), r.height.alias("unit"),
        F.array("line_no").alias("line_nos"),
    )
    first = one.filter(F.col("_c").isin("付", "收") & (r.width >= r.height * 0.5) & (r.width <= r.height * 1.8))
    chain = first.select(
        *SEG, F.when(F.col("_c") == "付", "payer").otherwise("payee").alias("side"), *_R,
        F.col("line_no").alias("first_line"), r.height.alias("unit"), r.width.alias("_w"),
        F.col("x0").alias("_x0"), F.array("line_no").alias("line_nos"),
    )
    for words in (("款",), ("人", "方")):
        nxt = one.filter(F.col("_c").isin(*words)).select(*SEG, F.col("line_no").alias("n_line"), *prefixed("n_"))
        n = Rect("n_")
        fits = (
            (F.abs(n.x0 - F.col("_x0")) <= F.greatest(F.lit(1.0), F.col("_w") * 0.15))
            & (F.abs(n.width - F.col("_w")) <= F.col("_w") * 0.25)
            & (F.abs(n.height - F.col("unit")) <= F.col("unit") * 0.25)
            & (n.y0 - F.col("y1") >= -0.25) & (n.y0 - F.col("y1") <= F.col("unit") * 1.6)
        )
        chain = (
            band_pairs(chain, nxt, SEG, F.col("y1") - 0.25, F.col("y1") + F.col("unit") * 1.6, "y0", prefix="n_")
            .filter(fits)
            .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*SEG, "first_line")))
            .filter("_n = 1")
            .select(
                *SEG, "side", F.least("x0", "n_x0").alias("x0"), "y0", F.greatest("x1", "n_x1").alias("x1"),
                F.col("n_y1").alias("y1"), "first_line", "unit", "_w", "_x0",
                F.concat("line_nos", F.array("n_line")).alias("line_nos"),
            )
        )
    heads = flat.unionByName(chain.drop("_w", "_x0"))
    cols = [*_R, "unit", "first_line", "line_nos"]
    pay = heads.filter("side = 'payer'").select(*SEG, *prefixed("p_", cols))
    rec = heads.filter("side = 'payee'").select(*SEG, *prefixed("q_", cols))
    low = F.least("p_unit", "q_unit")
    pairs = pay.join(dealt(rec), SEG).filter(
        (F.abs(F.col("p_x0") - F.col("q_x0")) > low * 4) & (F.abs(F.col("p_y0") - F.col("q_y0")) <= low * 0.5)
    )
    lab = generic.select(*SEG, "field", *prefixed("l_"))
    own = pairs.join(dealt(lab), SEG).withColumn("_head", field_header("l_")).filter("_head is not null")
    aligned = []
    for s, p in (("payer", "p_"), ("payee", "q_")):
        names = F.collect_set(F.when((F.col("_head") == s) & (F.col("field") == "name"), F.col("l_x0")))
        accounts = F.collect_set(F.when((F.col("_head") == s) & (F.col("field") == "account"), F.col("l_x0")))
        reach = F.first(p + "unit") * 2
        aligned.append(_any_close(names, accounts, reach))
    key = [*SEG, "p_first_line", "q_first_line"]
    keep = [c for c in pairs.columns if c not in key]
    valid = (
        own.groupBy(*key)
        .agg(F.first(F.struct(*keep)).alias("_h"), (aligned[0] & aligned[1]).alias("_ok"))
        .filter("_ok")
        .select(*key, "_h.*")
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*SEG)))
    )
    return valid.filter("_n = 1").drop("_n")


def _any_close(a: Column, b: Column, reach: Column) -> Column:
    return F.exists(a, lambda x: F.exists(b, lambda y: F.abs(x - y) <= reach))


def field_header(prefix: str = "") -> Column:
    """Side of the table header a label belongs to, given the pair columns ``p_…`` and ``q_…``."""
    lab = Rect(prefix)
    width = F.abs(F.col("p_x0") - F.col("q_x0"))

    def belongs(me: str, other: str) -> Column:
        h = F.col(me + "unit")
        reach = F.greatest(h * 5, width * 0.5)
        before_next = F.when(F.col(other + "x0") > F.col(me + "x0"), lab.x1 < F.col(other + "x0")).otherwise(F.lit(True))
        return (
            (lab.x0 >= F.col(me + "x1")) & (lab.x0 <= F.col(me + "x1") + reach) & before_next
            & (lab.y0 >= F.col(me + "y0") - h * 3) & (lab.y0 <= F.col(me + "y1") + h * 3)
        )

    pay, rec = belongs("p_", "q_"), belongs("q_", "p_")
    return F.when(pay & ~rec, "payer").when(rec & ~pay, "payee")


def table_values(cells: DataFrame, lines: DataFrame, heads: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Value cells of table labels: right of the label, in its column, between its neighbours.

    ``cells`` are the labels that want values, ``labels`` all labels of the slip. One row per
    label and value line comes back, the directly wrapped neighbour line included.
    """
    lab = Rect()
    h = F.greatest(F.lit(1.0), lab.height)
    placed = cells.join(dealt(heads), SEG).withColumn("side", field_header()).filter("side is not null")
    mine, other = F.col("side") == "payer", F.col("side") == "payee"
    placed = placed.withColumns(
        {
            "_right": F.when(mine & (F.col("q_x0") > F.col("p_x0")), F.col("q_x0")).when(
                other & (F.col("p_x0") > F.col("q_x0")), F.col("p_x0")
            ),
            "_head_mid": F.when(mine, F.col("p_x0") + F.col("p_x1")).otherwise(F.col("q_x0") + F.col("q_x1")) / 2,
            "_divider": (F.col("p_x0") + F.col("p_x1") + F.col("q_x0") + F.col("q_x1")) / 4,
        }
    )
    heads_lines = heads.select(*SEG, F.explode(F.concat("p_line_nos", "q_line_nos")).alias("line_no"))
    nb = (cells if labels is None else labels).join(dealt(heads_lines), [*SEG, "line_no"], "left_anti").select(
        *SEG, F.col("line_no").alias("n_line"), F.col("x0").alias("n_x0"), ((F.col("y0") + F.col("y1")) / 2).alias("n_cy")
    )
    near = (
        band_pairs(placed, nb, SEG, lab.cy - h * 6, lab.cy + h * 6, "cy", prefix="n_")
        .filter((F.col("n_line") != F.col("line_no")) & (F.abs(F.col("n_x0") - lab.x0) <= h * 2))
        .groupBy(*CELL)
        .agg(
            F.max(F.when(F.col("n_cy") < lab.cy - h * 0.5, (F.col("n_cy") + lab.cy) / 2)).alias("_up"),
            F.min(F.when(F.col("n_cy") > lab.cy + h * 0.5, (F.col("n_cy") + lab.cy) / 2)).alias("_lo"),
        )
    )
    stops = lines.filter(F.substring_index(F.translate(tx.no_space(F.col("text")), "：", ":"), ":", 1).isin(*ROW_BOUNDARIES))
    stops = stops.select(*SEG, *prefixed("b_"))
    left_col = F.col("_head_mid") < F.col("_divider")
    in_column = F.when(left_col, F.col("b_x0") < F.col("_divider")).otherwise(F.col("b_x1") > F.col("_divider"))
    walls = (
        band_pairs(placed, stops, SEG, lab.cy - h * 6, lab.cy + h * 6, "y0", prefix="b_")
        .filter(in_column)
        .groupBy(*CELL)
        .agg(
            F.max(F.when(F.col("b_y1") < lab.cy, F.col("b_y1"))).alias("_wup"),
            F.min(F.when(F.col("b_y0") > lab.cy, F.col("b_y0"))).alias("_wlo"),
        )
    )
    rows = placed.join(dealt(near), CELL, "left").join(dealt(walls), CELL, "left")
    v = Rect("v_")
    val = lines.join(dealt(heads_lines), [*SEG, "line_no"], "left_anti").select(
        *SEG, F.col("line_no").alias("v_line"), F.col("text").alias("v_text"),
        ((F.col("y0") + F.col("y1")) / 2).alias("v_cy"), *prefixed("v_"),
    )
    in_cell = (
        (F.col("v_line") != F.col("line_no")) & (v.x0 >= lab.x1)
        & (F.col("_right").isNull() | (v.x1 <= F.col("_right")))
        & (F.greatest("_up", "_wup").isNull() | (F.col("v_cy") > F.greatest("_up", "_wup")))
        & (F.least("_lo", "_wlo").isNull() | (F.col("v_cy") < F.least("_lo", "_wlo")))
    )
    nearby = (
        band_pairs(rows, val, SEG, lab.cy - h * 3, lab.cy + h * 3, "cy", prefix="v_")
        .filter(in_cell)
        .withColumn("_hit", g.same_row(lab, v, True))
    )
    w = Window.partitionBy(*CELL)
    cols = {c: F.max(F.when(F.col("_hit"), F.col("v_" + c))).over(w) for c in _R}
    counted = nearby.withColumn("_hits", F.count_if("_hit").over(w)).withColumns({f"_s_{c}": e for c, e in cols.items()})
    seed = Rect("_s_")
    extra = (
        (F.col("field") != "account") & (F.col("_hits") == 1)
        & (F.abs(F.col("v_cy") - lab.cy) <= h * 2) & (g.wrapped(seed, v) | g.wrapped(v, seed))
    )
    return counted.filter(F.col("_hit") | extra).select(
        *CELL, "side", "field", "label", F.col("v_line").alias("value_line"),
        tx.strip(F.col("v_text")).alias("text"), *[F.col("v_" + c).alias(c) for c in _R],
    )


def nearest_right(cells: DataFrame, labels: DataFrame, lines: DataFrame) -> DataFrame:
    """Values printed to the right of a label on its row, up to the next label of the row.

    ``cells`` want a value, ``labels`` are all label cells, ``lines`` the lines without label.
    Neighbouring labels of the same column halve the space above and below.
    """
    lab = Rect()
    h = F.greatest(F.lit(1.0), lab.height)
    o = Rect("o_")
    others = labels.select(
        *SEG, F.col("line_no").alias("o_line"), F.col("side").alias("o_side"),
        ((F.col("y0") + F.col("y1")) / 2).alias("o_cy"), *prefixed("o_"),
    )
    same_col = (F.col("o_side") == F.col("side")) & (F.abs(o.x0 - lab.x0) <= h)
    near = (
        band_pairs(cells, others, SEG, lab.cy - h * 2, lab.cy + h * 2, "cy", prefix="o_")
        .filter(F.col("o_line") != F.col("line_no"))
        .groupBy(*CELL)
        .agg(
            F.min(F.when((o.x0 >= lab.x1) & g.same_row(lab, o), o.x0)).alias("_right"),
            F.max(F.when(same_col & (F.col("o_cy") < lab.cy - h * 0.5), (F.col("o_cy") + lab.cy) / 2)).alias("_up"),
            F.min(F.when(same_col & (F.col("o_cy") > lab.cy + h * 0.5), (F.col("o_cy") + lab.cy) / 2)).alias("_lo"),
        )
    )
    v = Rect("v_")
    val = lines.select(
        *SEG, F.col("line_no").alias("v_line"), F.col("text").alias("v_text"),
        ((F.col("y0") + F.col("y1")) / 2).alias("v_cy"), *prefixed("v_"),
    )
    ok = (
        (F.col("v_line") != F.col("line_no"))
        & (v.x0 >= lab.x1) & (v.x0 <= lab.x1 + h * 12)
        & (F.col("_right").isNull() | (v.x1 <= F.col("_right")))
        & (F.col("_up").isNull() | (F.col("v_cy") > F.col("_up")))
        & (F.col("_lo").isNull() | (F.col("v_cy") < F.col("_lo")))
        & g.same_row(lab, v, F.col("field") != "account")
    )
    return (
        band_pairs(cells.join(dealt(near), CELL, "left"), val, SEG, lab.cy - h, lab.cy + h, "cy", prefix="v_")
        .filter(ok)
        .select(
            *CELL, "side", "field", "label", F.col("v_line").alias("value_line"),
            tx.strip(F.col("v_text")).alias("text"), *[F.col("v_" + c).alias(c) for c in _R],
        )
    )


def join_wrapped(values: DataFrame) -> DataFrame:
    """Values of one label that continue each other line by line become one text.

    Account numbers and texts with Latin letters never join; one broken step keeps all apart. ``x0 … y1`` is the
    rectangle around the lines of a text.
    """
    w = Window.partitionBy(*CELL).orderBy("y0", "x0", "value_line")
    whole = Window.partitionBy(*CELL)
    prev = values.withColumns({f"_p_{c}": F.lag(c).over(w) for c in _R})
    step = F.col("_p_y0").isNull() | g.wrapped(Rect("_p_"), Rect())
    latin = F.col("text").rlike("[A-Za-z]")
    rows = prev.withColumn(
        "_join", F.bool_and(step & ~latin).over(whole) & (F.count(F.lit(1)).over(whole) > 1) & (F.col("field") != "account")
    ).withColumn("_rank", F.row_number().over(w))
    part = F.when(F.col("_join"), F.lit(1)).otherwise(F.col("_rank"))
    ordered = F.array_sort(F.collect_list(F.struct("_rank", "text")))
    return (
        rows.withColumn("value_no", part.cast("long"))
        .groupBy(*CELL, "side", "field", "label", "value_no")
        .agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "").alias("text"),
             *[(F.min if c[1] == "0" else F.max)(c).alias(c) for c in _R])
    )


def next_line_value(cells: DataFrame, lines: DataFrame, labels: DataFrame, centers: DataFrame) -> DataFrame:
    """Value on one of the next two lines of the reading order.

    A line that is too far below, or labelled for the same side, ends the search; a line of the
    other column is skipped. ``cross_column`` on a cell lifts the column test.
    """
    mid = (F.col("x0") + F.col("x1")) / 2
    side_of = F.coalesce(F.when(F.col("side") != "", F.col("side")), nearest_side(mid))
    sides = (
        labels.join(dealt(centers), SEG, "left")
        .groupBy(*SEG, "line_no")
        .agg(F.lit(True).alias("_lab"), F.max(side_of == "payer").alias("_lp"), F.max(side_of == "payee").alias("_lq"))
    )
    w = Window.partitionBy(*SEG).orderBy("line_no")
    state = F.struct(
        "text", *_R, mid.alias("cx"), F.coalesce("_lab", F.lit(False)).alias("lab"),
        F.coalesce("_lp", F.lit(False)).alias("payer"), F.coalesce("_lq", F.lit(False)).alias("payee"),
    )
    ahead = lines.select(*SEG, "line_no", "text", *_R).join(dealt(sides), [*SEG, "line_no"], "left").select(
        *SEG, "line_no", F.lead(state, 1).over(w).alias("n1"), F.lead(state, 2).over(w).alias("n2")
    )
    rows = cells.join(dealt(ahead), [*SEG, "line_no"]).join(dealt(centers), SEG, "left")
    h = F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
    known = F.when(F.col("side") == "payer", F.col("payer_x").isNotNull()).otherwise(F.col("payee_x").isNotNull())
    both = F.col("payer_x").isNotNull() & F.col("payee_x").isNotNull()

    def verdict(n: str) -> Column:
        far = F.col(f"{n}.y0") - F.col("y1") > F.greatest(F.lit(18.0), h * 2.5)
        mine = F.when(F.col("side") == "payer", F.col(f"{n}.payer")).otherwise(F.col(f"{n}.payee"))
        any_side = F.col(f"{n}.payer") | F.col(f"{n}.payee")
        other_col = ~F.col("cross_column") & both & known & (nearest_side(F.col(f"{n}.cx")) != F.col("side"))
        return (
            F.when(F.col(n).isNull() | far, "stop")
            .when(F.col(f"{n}.lab"), F.when(known & any_side & ~mine, "skip").otherwise("stop"))
            .when(other_col, "skip")
            .otherwise("take")
        )

    first, second = verdict("n1"), verdict("n2")
    got = F.when(first == "take", F.col("n1")).when((first == "skip") & (second == "take"), F.col("n2"))
    return (
        rows.withColumn("_got", got)
        .filter("_got is not null")
        .select(*CELL, "side", "field", "label", F.lit(1).cast("long").alias("value_no"), tx.strip(F.col("_got.text")).alias("text"), *[F.col("_got." + c).alias(c) for c in _R])
    )


def merge_field_values(candidates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One value per field: missing readings count for nothing, different readings conflict.

    Equal readings fold by partial aggregation first; a conflict shows all its different values, in order.
    """
    seen = candidates.filter("state <> 'missing'")
    distinct = seen.groupBy(*keys, "value", "state").agg(F.min(F.struct(*order, "raw")).alias("_o"))
    ranked = distinct.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_o", "value", "state"))).alias("_v"))
    single = F.size("_v") == 1
    first = F.element_at("_v", 1)
    joined = lambda f: F.array_join(F.transform("_v", f), " | ")
    return ranked.select(
        *keys,
        F.when(single, first["_o"]["raw"]).otherwise(joined(lambda s: s["_o"]["raw"])).alias("raw"),
        F.when(single, first["value"]).otherwise(joined(lambda s: s["value"])).alias("value"),
        F.when(single, first["state"]).otherwise(F.lit("ambiguous")).alias("state"),
        F.size("_v").cast("long").alias("readings"),
    )


def all_fields(segments: DataFrame, found: DataFrame, roles: tuple[str, ...] = SIDES) -> DataFrame:
    """Every role and field of every slip; what was not found is ``missing``."""
    slots = F.array(*[F.struct(F.lit(r).alias("side"), F.lit(f).alias("field")) for r in roles for f in FIELDS])
    grid = segments.select(*SEG).distinct().select(*SEG, F.explode(slots).alias("_s")).select(*SEG, "_s.*")
    return grid.join(dealt(found), [*SEG, "side", "field"], "left").select(
        *SEG, "side", "field", F.coalesce("raw", F.lit("")).alias("raw"), F.coalesce("value", F.lit("")).alias("value"),
        F.coalesce("state", F.lit("missing")).alias("state"),
    )


def combine_observed(current: DataFrame, observed: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """Counterparty fields with what was printed about it: gaps are filled, conflicts are kept.

    Both tables hold ``segment_id, field, raw, value, state``; ``protected`` lists
    ``segment_id, field`` rows that stay as they are.
    """
    keys = [*SEG, "field"]
    new = observed.select(*keys, *prefixed("n_", ("raw", "value", "state")))
    rows = current.join(new, keys, "left")
    if protected is not None:
        rows = rows.join(protected.select(*keys).distinct().withColumn("_keep", F.lit(True)), keys, "left")
    else:
        rows = rows.withColumn("_keep", F.lit(None).cast("boolean"))
    same = (F.col("state") == F.col("n_state")) & (tx.no_space(F.col("value")) == tx.no_space(F.col("n_value")))
    action = (
        F.when(F.coalesce("_keep", F.lit(False)) | (F.coalesce("n_state", F.lit("missing")) == "missing"), "keep")
        .when(F.col("state") == "missing", "fill")
        .when(same, "keep")
        .otherwise("conflict")
    )
    rows = rows.withColumn("_a", action)

    def pick(c: str, conflict: Column) -> Column:
        return F.when(F.col("_a") == "fill", F.col("n_" + c)).when(F.col("_a") == "conflict", conflict).otherwise(F.col(c)).alias(c)

    return rows.select(
        *keys, pick("raw", F.concat_ws(" | ", "raw", "n_raw")), pick("value", F.concat_ws(" | ", "value", "n_value")),
        pick("state", F.lit("ambiguous")),
    )
