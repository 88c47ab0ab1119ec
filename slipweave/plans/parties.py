"""From the text lines of slips to payer and payee fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipweave.functions import geometry as g
from slipweave.functions import text as tx
from slipweave.functions.geometry import Rect
from slipweave.functions.settle import settle
from slipweave.operators import fields as fd
from slipweave.operators import labels as lb
from slipweave.operators.fields import CELL, SEG
from slipweave.session import dealt, stage

_RECT = ("x0", "y0", "x1", "y1")
FIELD = [*SEG, "side", "field"]
ORDER = ["line_no", "cell_no", "value_no"]
# Forms whose labels need the form to be known. Fixed values.
TAX_TITLES = ("电子缴税付款凭证", "上海银行电子缴税付款凭证")
TABLE_TITLES = ("宁波银行客户回单",)
TABLE_DIRECTIONS = {"转账存入": "payee", "转账支取": "payer"}
ONLINE_TITLE = "客户回单网上支付跨行清算业务"
ONLINE_DIRECTIONS = {"借": "payer", "贷": "payee"}
ONLINE_LABELS = {
    "名称": ("own", "name"),
    "账号": ("own", "account"),
    "交易对方名称": ("other", "name"),
    "交易对方账号": ("other", "account"),
    "交易对方银行名称": ("other", "bank"),
}
ONLINE_REQUIRED = ("名称", "账号", "交易对方名称")
SMALL_TITLE = "客户回单小额支付系统业务"
SMALL_KIND = "普通贷记"
SMALL_LABELS = {
    "发起人名称": ("payer", "name"),
    "发起人账号": ("payer", "account"),
    "发起行名称": ("payer", "bank"),
    "接收人名称": ("payee", "name"),
    "接收人账号": ("payee", "account"),
    "接收行名称": ("payee", "bank"),
}
SMALL_REQUIRED = ("发起人名称", "发起人账号", "接收人名称", "接收人账号")
FORM_BOUNDARIES = (
    "交易对方银行行号", "交易机构", "币种", "发生额", "交易流水号", "来源或用途", "摘要",
    "借贷标志", "交易种类", "业务类型", "发起人开户行行号", "发起行行号", "接收人开户行行号", "接收行行号",
)


def _compact(c: Column) -> Column:
    return F.translate(tx.no_space(c), "：（）", ":()")


def _bare(c: Column) -> Column:
    return F.btrim(_compact(c), F.lit(lb.VALUE_SEPARATORS))


def detect_forms(lines: DataFrame) -> DataFrame:
    """Form and direction of the slips that have a form's title, from one aggregation over their lines.

    ``lines`` carry the slip's top and bottom as ``sy0, sy1``. A form needs its title alone near
    the top, one known direction, and all required labels below the title. Slips without any title have no form and no row.
    """
    lines = settle(lines, {"_c": _compact(F.col("text"))})
    c = F.col("_c")
    taxed = F.btrim(c, F.lit(lb.VALUE_SEPARATORS)).isin(*TAX_TITLES)
    lines = lines.join(dealt(lines.filter(c.startswith("客户回单") | taxed).select(*SEG).distinct()), SEG, "left_semi")
    top = F.col("sy0") + F.greatest(F.lit(40.0), (F.col("sy1") - F.col("sy0")) * 0.2)
    title = c.startswith("客户回单")
    colon = c.contains(":")
    online = F.when(colon, lb.colon_cells(F.col("text"), [*ONLINE_LABELS, *FORM_BOUNDARIES]))
    small = F.when(colon, lb.colon_cells(F.col("text"), [*SMALL_LABELS, *FORM_BOUNDARIES]))
    online, small = (F.transform(cells, lambda k: k["label"]) for cells in (online, small))
    rows = settle(lines, {"_on": online, "_sm": small}).withColumn("_top", top)

    def lowest(cells: str, alias: str) -> Column:
        return F.max(F.when(F.array_contains(cells, alias), F.col("y0")))

    def meta(label: str) -> tuple[Column, Column]:
        value = F.when(F.col("_c").startswith(label + ":"), F.substr(F.col("_c"), F.lit(len(label) + 2)))
        return F.count(value), F.max(value)

    debit_n, debit = meta("借贷标志")
    kind_n, kind = meta("交易种类")
    per = rows.groupBy(*SEG).agg(
        F.max((F.col("y0") <= F.col("_top")) & taxed).alias("_tax"),
        F.count_if(title).alias("_titles"), F.max(F.when(title, F.col("_c"))).alias("_title"),
        F.max(F.when(title, F.col("y0") <= F.col("_top"))).alias("_high"), F.max(F.when(title, F.col("y1"))).alias("title_y1"),
        debit_n.alias("_dn"), debit.alias("_d"), kind_n.alias("_kn"), kind.alias("_k"),
        F.array(*[lowest("_on", a) for a in ONLINE_REQUIRED]).alias("_on"),
        F.array(*[lowest("_sm", a) for a in SMALL_REQUIRED]).alias("_sm"),
    )

    def all_below(ys: str) -> Column:
        return F.forall(ys, lambda y: F.coalesce(y > F.col("title_y1"), F.lit(False)))

    headed = (F.col("_titles") == 1) & F.col("_high")
    is_online = headed & (F.col("_title") == ONLINE_TITLE) & (F.col("_dn") == 1) & F.col("_d").isin(*ONLINE_DIRECTIONS) & all_below("_on")
    is_small = headed & (F.col("_title") == SMALL_TITLE) & (F.col("_kn") == 1) & (F.col("_k") == SMALL_KIND) & all_below("_sm")
    form = F.when(is_online, "online").when(is_small, "small").when(F.col("_tax"), "tax").otherwise("")
    direction = F.when(F.col("_d") == "借", "payer").when(F.col("_d") == "贷", "payee")
    return per.select(*SEG, form.alias("form"), direction.alias("own_side"), "title_y1")


def form_labels(lines: DataFrame, forms: DataFrame) -> DataFrame:
    """Label cells of every line, read with the vocabulary of the slip's form."""
    text, below = F.col("text"), F.col("y0") > F.col("title_y1")
    form = F.coalesce("form", F.lit(""))
    form = F.when((form == "online") & below, form).when((form == "small") & below, form).when(form == "tax", form).when(form != "", "plain").otherwise("")
    place = [*SEG, "line_no", "text", "x0", "y0", "x1", "y1", "own_side"]
    # One search of the text per vocabulary, and of each only where the one before found nothing.
    rows = settle(lines.join(dealt(forms), SEG, "left").select(*place, "title_y1", "form"), {"_f": form}).select(*place, "_f")
    own = {"online": ONLINE_LABELS, "small": SMALL_LABELS}
    rows = settle(rows, {f"_{f}": F.when(F.col("_f") == f, lb.colon_marks(text, [*words, *FORM_BOUNDARIES])) for f, words in own.items()})

    def special(f: str) -> Column:
        return F.when(F.col(f"_{f}") != text, lb.tagged(lb.marked_cells(F.col(f"_{f}")), True, True))

    rows = settle(rows, {"_s": F.coalesce(*[special(f) for f in own])}).drop(*[f"_{f}" for f in own])
    known = F.exists("_s", lambda x: F.when(F.col("_f") == "online", x["label"].isin(*ONLINE_LABELS)).otherwise(x["label"].isin(*SMALL_LABELS)))
    rows = settle(rows, {"_s": F.when(known, F.col("_s"))})
    taxed = F.when(_bare(text).isin(*TAX_TITLES), text).otherwise(lb.bounded_marks(text, lb.side_labels(tax=True)))
    rows = settle(rows, {"_e": F.when(F.col("_s").isNull(), F.when(F.col("_f") == "tax", taxed).otherwise(lb.bounded_marks(text, lb.side_labels())))})
    rows = settle(rows, {"_g": F.when((F.col("_f") == "") & (F.col("_e") == text), lb.bounded_marks(text, lb.field_labels()))})
    cells = (
        F.when(F.col("_s").isNotNull(), F.col("_s"))
        .when(F.col("_e") != text, lb.tagged(lb.marked_cells(F.col("_e")), True))
        .when(F.col("_g") != text, lb.tagged(lb.marked_cells(F.col("_g")), False))
        .otherwise(lb.no_cells(lb.TAGGED))
    )
    rows = settle(rows, {"_cells": cells}).select(*place, F.posexplode_outer("_cells").alias("cell_no", "_k"))
    usual = {**lb.field_labels(), **lb.side_labels(tax=True)}
    words = {**SMALL_LABELS, **ONLINE_LABELS}
    label, mapped = F.col("_k.label"), F.col("_k.mapped")
    rows = settle(rows, {"_m": F.when(mapped, lb.meanings(words, label)).otherwise(lb.meanings(usual, label))}).filter("_m is not null")
    other = F.when(F.col("own_side") == "payer", "payee").otherwise("payer")
    return (
        rows.withColumns(
            {
                "label": label, "value": F.col("_k.value"), "explicit": F.col("_k.explicit"), "inline_only": mapped,
                "_side": F.substring_index("_m", "/", 1), "field": F.substring_index("_m", "/", -1),
            }
        )
        .withColumn("side", F.when(F.col("_side") == "own", F.col("own_side")).when(F.col("_side") == "other", other).otherwise(F.col("_side")))
        .select(*CELL, "label", "value", "side", "field", "explicit", "inline_only", "text", "x0", "y0", "x1", "y1")
    )


def table_form(lines: DataFrame, generic: DataFrame) -> DataFrame:
    """Slips whose upper account table belongs to the side named by one direction line."""
    b = _bare(F.col("text"))
    top = F.col("sy0") + F.greatest(F.lit(40.0), (F.col("sy1") - F.col("sy0")) * 0.2)
    table = F.create_map(*[F.lit(v) for kv in TABLE_DIRECTIONS.items() for v in kv])
    title, way = b.isin(*TABLE_TITLES), b.isin(*TABLE_DIRECTIONS)
    found = (
        lines.filter(title | way)
        .groupBy(*SEG)
        .agg(
            F.count_if(title).alias("_tn"), F.count_if(way).alias("_wn"),
            F.max(F.when(title, F.col("y0"))).alias("_ty0"), F.max(F.when(title, F.col("y1"))).alias("_ty1"),
            F.max(F.when(way, F.col("y0"))).alias("_wy"), F.max(F.when(way, F.element_at(table, b))).alias("upper_side"),
            F.max(top).alias("_top"),
        )
        .filter("_tn = 1 and _wn = 1 and _ty0 <= _top and _wy > _ty1 and _wy - _ty0 <= 160")
        .select(*SEG, "upper_side", F.col("_ty1").alias("upper_top"), F.col("_wy").alias("upper_bottom"))
    )
    between = (F.col("y0") > F.col("upper_top")) & (F.col("y0") < F.col("upper_bottom"))
    complete = (
        generic.join(dealt(found), SEG)
        .filter(between)
        .groupBy(*SEG)
        .agg(F.count_distinct("field").alias("_n"))
        .filter("_n = 3")
        .select(*SEG)
    )
    return found.join(dealt(complete), SEG, "left_semi")


@dataclass(frozen=True)
class Readings:
    """``found``: every reading with the method and the rectangle of its value; ``labels``: the labels whose side is known;
    ``sideless``: those that name a field and no side, where nothing tells the side."""

    found: DataFrame
    labels: DataFrame
    sideless: DataFrame


def candidates(lines: DataFrame) -> DataFrame:
    """Every reading of a party field, in reading order, before conflicts are resolved."""
    return readings(lines).found.select(*CELL, "side", "field", "value_no", "text")


def readings(lines: DataFrame) -> Readings:
    """Labels of party fields and what is read behind, beside or below them.

    A reading is known by its label's place (``CELL``) and ``value_no``; evidence and issues are joined to it by that, at the end.
    """
    # Every step below reads the lines; dealt by line, so a slip of very many lines is no large task.
    text = settle(lines.select(*SEG, "line_no", "text", *_RECT, "sy0", "sy1"), {"text": F.col("text")})
    text = stage(text.filter(tx.strip(F.col("text")) != "").repartition(*SEG, "line_no"))
    cells = stage(form_labels(text, detect_forms(text)))
    generic = cells.filter("not explicit")
    heads = stage(fd.role_headers(text, generic))
    placed = stage(fd.table_values(generic, text, heads, cells))
    whole = generic.filter(_bare(F.col("text")) == F.col("label")).select(*CELL)
    cleared = (
        placed.join(dealt(whole), CELL, "left_semi").select(*SEG, F.col("value_line").alias("line_no"))
        .unionByName(heads.select(*SEG, F.explode(F.concat("p_line_nos", "q_line_nos")).alias("line_no")))
        .distinct()
    )
    kept = stage(cells.join(dealt(cleared), [*SEG, "line_no"], "left_anti"))
    upper = table_form(text, kept.filter("not explicit"))
    rows = kept.join(dealt(upper), SEG, "left")
    between = (F.col("y0") > F.col("upper_top")) & (F.col("y0") < F.col("upper_bottom"))
    in_upper = F.coalesce(~F.col("explicit") & between, F.lit(False))
    rows = stage(
        rows.withColumn("side", F.when(in_upper, F.col("upper_side")).otherwise(F.col("side")))
        .filter(F.col("upper_side").isNull() | (F.col("side") != ""))
        .withColumn("cross_column", in_upper)
        .drop("upper_side", "upper_top", "upper_bottom")
    )
    anchors = rows.filter("side <> ''")
    centers = fd.column_centers(anchors)
    loose = rows.filter("side = ''")
    in_table = loose.join(dealt(heads), SEG).withColumn("_h", fd.field_header()).filter("_h is not null").select(*CELL, F.col("_h").alias("_head"))
    marked = loose.join(dealt(in_table), CELL, "left")
    by_table = marked.filter("_head is not null").withColumn("side", F.col("_head"))
    by_column = fd.column_side(marked.filter("_head is null").drop("side"), anchors)
    told = stage(anchors.withColumn("_head", F.lit(None).cast("string")).unionByName(by_table).unionByName(by_column))
    resolved = told.filter("side is not null")
    inline = resolved.filter("value <> ''").select(
        *CELL, "side", "field", F.lit(1).cast("long").alias("value_no"), F.col("value").alias("text"), *_RECT, F.lit("same_line").alias("method")
    )
    open_cells = resolved.filter("value = '' and not inline_only")
    free = text.join(dealt(rows.select(*SEG, "line_no").distinct()), [*SEG, "line_no"], "left_anti")
    labelled_lines = rows.select(*SEG, F.col("line_no").alias("value_line")).distinct()
    from_table = placed.drop("side").join(
        dealt(open_cells.filter("_head is not null").select(*CELL, "side")), CELL
    ).join(dealt(labelled_lines), [*SEG, "value_line"], "left_anti")
    beside = fd.nearest_right(open_cells.filter("_head is null"), resolved, free)
    read = stage(fd.join_wrapped(from_table.unionByName(beside.select(from_table.columns))))
    waiting = open_cells.filter("_head is null").join(dealt(read.select(*CELL).distinct()), CELL, "left_anti")
    below = fd.next_line_value(waiting, text, rows, centers)
    cols = [*CELL, "side", "field", "value_no", "text", *_RECT, "method"]
    beside_or_table = read.withColumn("method", F.lit("same_row")).select(cols)
    found = inline.select(cols).unionByName(beside_or_table).unionByName(below.withColumn("method", F.lit("next_line")).select(cols))
    place = [*CELL, "label", "field", *_RECT]
    return Readings(found, resolved.select(*place, "side"), told.filter("side is null").select(place))


def _valued(found: DataFrame) -> DataFrame:
    """Readings with ``raw``, ``value`` and ``state``."""
    found = tx.compatible(stage(found.withColumn("raw", tx.strip(F.col("text")))), "raw", "_n")
    found = settle(found, {"_v": tx.spaced_field(F.col("field"), F.col("_n"))}).drop("_n")
    return settle(found, {"state": tx.labelled_state(F.col("field"), F.col("_v"))}).withColumn(
        "value", F.when(F.col("state") == "blank", "").otherwise(F.col("_v")))


def extract_parties(lines: DataFrame) -> DataFrame:
    """Payer and payee name, account and bank of every slip, with state.

    ``lines(segment_id, line_no, text, x0, y0, x1, y1, sy0, sy1)`` are clipped to the slip and
    numbered in reading order. Two different readings of a field make it ambiguous.
    """
    merged = fd.merge_field_values(_valued(candidates(lines)), FIELD, ORDER)
    return fd.all_fields(lines, merged)


@dataclass(frozen=True)
class Parties:
    """``fields`` as of :func:`extract_parties`; ``evidence``: a row per reading; ``issues``: a row per doubt; ``status``: per slip."""

    fields: DataFrame
    evidence: DataFrame
    issues: DataFrame
    status: DataFrame


def explained_parties(lines: DataFrame, slips: DataFrame | None = None) -> Parties:
    """Party fields with where they were read and what speaks against them.

    ``evidence`` has, for each reading of a field in order (``reading`` from 1), its method (same_line, same_row, next_line), the label and its
    rectangle, raw text, value and state, and the value's rectangle. ``issues`` are ``field_ambiguous`` (one reading, not safe to use),
    ``conflicting_field_values``, ``label_without_value`` (a label was found and nothing to read), ``generic_label_side_unknown`` and, for those of ``slips``
    that have no line at all, ``no_text_in_scope``; each with the rectangle to look at. A slip with an issue needs review.
    """
    r = readings(lines)
    found = _valued(r.found)
    fields = fd.all_fields(lines if slips is None else slips, fd.merge_field_values(found, FIELD, ORDER))
    labels = r.labels.select(*CELL, "label", *[F.col(c).alias("label_" + c) for c in _RECT])
    order = Window.partitionBy(*FIELD).orderBy(*ORDER)
    evidence = found.join(dealt(labels), CELL).select(
        *FIELD, F.row_number().over(order).cast("long").alias("reading"), "method", "label", *["label_" + c for c in _RECT], "raw", "value", "state", *_RECT)
    # One pass per field: how many different readings, and the rectangle of the first.
    seen = found.filter("state <> 'missing'").groupBy(*FIELD).agg(
        F.count_distinct("value", "state").alias("_n"), F.min("state").alias("_state"),
        F.min(F.struct(*ORDER, *_RECT)).alias("_at"))
    doubt = F.when(F.col("_n") > 1, "conflicting_field_values").when(F.col("_state") == "ambiguous", "field_ambiguous")
    unsure = seen.withColumn("code", doubt).filter("code is not null").select(*FIELD, "code", *[F.col("_at." + c).alias(c) for c in _RECT])
    # A label all of whose field stays unread; the first such label is shown.
    unread = r.labels.join(dealt(seen.select(*FIELD)), FIELD, "left_anti").groupBy(*FIELD).agg(F.min(F.struct("line_no", "cell_no", *_RECT)).alias("_at"))
    unread = unread.select(*FIELD, F.lit("label_without_value").alias("code"), *[F.col("_at." + c).alias(c) for c in _RECT])
    nobody = F.lit(None).cast("string").alias("side")
    sideless = r.sideless.select(*SEG, nobody, "field", F.lit("generic_label_side_unknown").alias("code"), *_RECT)
    issues = unsure.unionByName(unread).unionByName(sideless)
    every = lines.select(*SEG).distinct()
    if slips is not None:
        every = slips.select(*SEG).distinct()
        empty = every.join(dealt(lines.filter(tx.strip(F.col("text")) != "").select(*SEG).distinct()), SEG, "left_anti")
        nothing = [F.lit(None).cast("double").alias(c) for c in _RECT]
        issues = issues.unionByName(empty.select(*SEG, nobody, F.lit(None).cast("string").alias("field"), F.lit("no_text_in_scope").alias("code"), *nothing))
    counted = issues.groupBy(*SEG).agg(F.count(F.lit(1)).alias("issues"))
    status = every.join(dealt(counted), SEG, "left").select(*SEG, F.coalesce("issues", F.lit(0)).alias("issues"), F.when(F.col("issues") > 0, "needs_review").otherwise("ok").alias("status"))
    return Parties(fields, evidence, issues, status)


def extract_direct(lines: DataFrame) -> DataFrame:
    """Fields printed with own/counterparty labels, for slips that have a counterparty label.

    Says nothing about who pays. A label alone may take the aligned next line, if that line has
    no label of its own.
    """
    read = stage(_direct_readings(lines))
    merged = fd.merge_field_values(read, FIELD, ["line_no", "cell_no"])
    return fd.all_fields(read, merged, ("own", "counterparty"))


def explained_direct(lines: DataFrame) -> Parties:
    """The fields of :func:`extract_direct` with evidence, issues and status, as :func:`explained_parties` gives them.

    Issues are ``missing_field`` (a label without a value, and a counterparty without a name), ``invalid_text`` (lost characters, a name without letter
    or digit), ``incomplete_account`` and ``conflicting_field``.
    """
    read = stage(_direct_readings(lines))
    fields = fd.all_fields(read, fd.merge_field_values(read, FIELD, ["line_no", "cell_no"]), ("own", "counterparty"))
    order = Window.partitionBy(*FIELD).orderBy("line_no", "cell_no")
    evidence = read.select(
        *FIELD, F.row_number().over(order).cast("long").alias("reading"), "method", "label", *["label_" + c for c in _RECT], "raw", "value", "state", *_RECT)
    per = read.groupBy(*FIELD).agg(
        F.count(F.lit(1)).alias("_all"), F.count_distinct(F.when(F.col("state") != "missing", F.struct("value", "state"))).alias("_n"),
        F.max(F.when(F.col("state") != "missing", F.col("state"))).alias("_state"),
        F.max(F.col("value").contains("\ufffd")).alias("_lost"), F.max(F.col("value").rlike(r"[\p{L}\p{N}]")).alias("_said"),
        F.min(F.struct("line_no", "cell_no", *["label_" + c for c in _RECT])).alias("_at"))
    ambiguous = (F.col("_n") > 1) | ((F.col("_n") == 1) & (F.col("_state") == "ambiguous"))
    unfit = F.col("_lost") | ((F.col("field") == "name") & ~F.col("_said"))
    code = F.when(ambiguous, F.when(unfit, "invalid_text").when((F.col("field") == "account") & (F.col("_all") == 1), "incomplete_account").otherwise("conflicting_field"))
    at = [F.col("_at.label_" + c).alias(c) for c in _RECT]
    unsure = per.withColumn("code", code).filter("code is not null").select(*FIELD, "code", *at)
    lacking = read.filter("state = 'missing'").select(*FIELD, F.lit("missing_field").alias("code"), *[F.col("label_" + c).alias(c) for c in _RECT])
    nameless = fields.filter("side = 'counterparty' and field = 'name' and state = 'missing'").select(*FIELD, F.lit("missing_field").alias("code"), *[F.lit(None).cast("double").alias(c) for c in _RECT])
    issues = unsure.unionByName(lacking).unionByName(nameless)
    counted = issues.groupBy(*SEG).agg(F.count(F.lit(1)).alias("issues"))
    status = fields.select(*SEG).distinct().join(dealt(counted), SEG, "left").select(
        *SEG, F.coalesce("issues", F.lit(0)).alias("issues"), F.when(F.col("issues") > 0, "needs_review").otherwise("ok").alias("status"))
    return Parties(fields, evidence, issues, status)


def _direct_readings(lines: DataFrame) -> DataFrame:
    """Readings behind own/counterparty labels, with their method, the label's rectangle and the value's (NULL without one)."""
    known = {
        **lb.field_labels(), **lb.side_labels(tax=True), **{b: ("meta", "boundary") for b in lb.BOUNDARY_LABELS},
        **lb.OBSERVED_LABELS,
    }
    # A label of any kind closes the value before it; only own/counterparty labels are read.
    text = F.col("text")
    # By slip, as the next line is needed; a table of one row group would else be searched by one task.
    lines = settle(lines, {"text": text}).repartition(*SEG)
    rows = settle(lines, {"_bare": tx.no_space(text)})
    rows = settle(rows, {"_whole": F.col("_bare").isin(*known)})
    rows = settle(rows, {"_m": F.when(~F.col("_whole") & F.col("_bare").rlike("[:：]"), lb.colon_marks(text, list(known))).otherwise(text)})
    whole = F.array(F.struct(F.col("_bare").alias("label"), F.lit("").alias("value")))
    cells = F.when(F.col("_whole"), whole).when(F.col("_m") != text, lb.marked_cells(F.col("_m"))).otherwise(lb.no_cells())
    rows = settle(rows, {"_c": lb.tagged(cells, True)}).drop("_bare", "_whole", "_m")
    w = Window.partitionBy(*SEG).orderBy("line_no")
    nxt = F.lead(F.struct("text", "x0", "y0", "x1", "y1", (F.size("_c") > 0).alias("lab"))).over(w)
    rows = rows.withColumn("_next", nxt).withColumn("_n", F.size("_c")).withColumnRenamed("_c", "_cells")
    cells = lb.explode_cells(rows, known).filter(F.col("side").isin("own", "counterparty"))
    h = F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
    n = Rect(x0=F.col("_next.x0"), y0=F.col("_next.y0"), x1=F.col("_next.x1"), y1=F.col("_next.y1"))
    wraps = (
        (F.col("value") == "") & (F.col("cell_no") == F.col("_n") - 1) & ~F.col("_next.lab")
        & (n.y0 >= F.col("y1")) & (n.y0 - F.col("y1") <= h * 1.2) & (F.abs(n.x0 - F.col("x0")) <= h * 2)
    )
    raw = F.when(F.coalesce(wraps, F.lit(False)), tx.strip(F.col("_next.text"))).otherwise(F.col("value"))
    wrapped = F.coalesce(wraps, F.lit(False))
    method = F.when(wrapped, "next_line").when(F.col("value") != "", "same_line")
    rect = [F.when(wrapped, F.col("_next." + c)).when(F.col("value") != "", F.col(c)).alias(c) for c in _RECT]
    # The lines of a slip are together here already, so what it has is seen without reading its labels again.
    with_cp = F.max(F.col("side") == "counterparty").over(Window.partitionBy(*SEG))
    return (
        cells.withColumn("_cp", with_cp)
        .filter("_cp")
        .select(*CELL, "side", "field", "label", raw.alias("raw"), method.alias("method"), *[F.col(c).alias("label_" + c) for c in _RECT], *rect)
        .withColumn("_v", tx.norm_field(F.col("field"), F.col("raw")))
        .withColumn("state", tx.field_state(F.col("field"), F.col("_v")))
        .withColumn("value", F.when(F.col("state") == "blank", "").otherwise(F.col("_v")))
    )


def layout_signature(cells: DataFrame, scopes: DataFrame) -> DataFrame:
    """Labels of a slip at positions relative to it, and one hash over them.

    Returns the label table with ``rx0 … ry1`` (four decimals) plus ``signature`` and
    ``reliable`` (at least two labels of at least two kinds).
    """
    s = scopes.select(*SEG, *fd.prefixed("s"))
    w, hgt = F.col("sx1") - F.col("sx0"), F.col("sy1") - F.col("sy0")
    rel = {
        "rx0": F.round((F.col("x0") - F.col("sx0")) / w, 4), "ry0": F.round((F.col("y0") - F.col("sy0")) / hgt, 4),
        "rx1": F.round((F.col("x1") - F.col("sx0")) / w, 4), "ry1": F.round((F.col("y1") - F.col("sy0")) / hgt, 4),
    }
    kind = F.when(F.col("side") == "", F.col("field")).otherwise(F.concat_ws(".", "side", "field"))
    at = cells.select(*SEG, "side", "field", "x0", "y0", "x1", "y1").join(dealt(s), SEG).withColumns({**rel, "kind": kind}).select(*SEG, "kind", "rx0", "ry0", "rx1", "ry1")
    at = stage(at)
    text = F.concat_ws("|", "kind", *[F.format_string("%.4f", c) for c in ("rx0", "ry0", "rx1", "ry1")])
    hashed = at.groupBy(*SEG).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "\n"), 256).alias("signature"),
        ((F.count(F.lit(1)) >= 2) & (F.count_distinct("kind") >= 2)).alias("reliable"),
    )
    return at.join(dealt(hashed), SEG)
