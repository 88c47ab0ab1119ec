"""Recognising titles, markers, document kinds and issuing banks in positioned text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipweave.functions import geometry as g
from slipweave.functions import text as tx
from slipweave.functions.geometry import Rect
from slipweave.functions.settle import settle
from slipweave.operators.nearby import band_pairs, greedy_starts, meet
from slipweave.schema import PAGE

_CJK = "[\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff]"

# Vocabularies. Fixed values.
VACANT_MARKERS = ("此处白纸无效", "此处空白无效", "此处白页无效", "空白区域无效", "此空白联无效")
TITLE_PREFIX_WORDS = (
    "银行", "客户", "业务", "入账", "出账", "收款", "付款", "支取", "存入",
    "付费", "收费", "利息", "借记", "贷记", "通用", "电子",
)
TITLE_SUFFIXES = ("网上支付跨行清算业务", "小额支付系统业务", "大额支付系统业务", "电子缴税付款业务", "存款利息", "通用")
EXACT_TITLES = ("上海银行电子缴税付款凭证", "宁波银行网上交易凭证")
#: One of these stands in every title: 回单, 利息单, 通知, 凭证.
TITLE_MARKS = "单知证"
BODY_WORDS = (
    "备注", "凭证", "信息", "通过", "校验", "管理", "打印",
    "费用", "时间戳", "摘要", "重要提示", "验证", "下载",
)
FIELD_WORDS = ("编号", "种类", "类型", "日期")
DOCUMENT_TITLES = {
    "贷款利息到期通知书": "loan_interest_notice",
    "贷款清算通知书": "loan_settlement_notice",
    "电子缴税付款凭证": "electronic_tax_payment",
    "上海银行电子缴税付款凭证": "electronic_tax_payment",
}
SERVICE_TITLES = {
    "客户付费回单": "bank_fee",
    "银行收费凭证": "bank_fee",
    "银行收费回单": "bank_fee",
    "收费回单": "bank_fee",
    "存款结息凭证": "deposit_interest",
    "存款结息回单": "deposit_interest",
    "存款利息单": "deposit_interest",
}
SERVICE_VALUES = {
    "业务类型": {
        "企业银行收费": "bank_fee", "银行收费": "bank_fee",
        "活期结息": "deposit_interest", "存款结息": "deposit_interest",
    },
    "业务种类": {
        "银行收费": "bank_fee", "存款结息": "deposit_interest", "贷方利息资本化(系统结息)": "deposit_interest",
    },
    "摘要": {
        "自助交易费": "bank_fee", "费用外收": "bank_fee", "开户手续费扣收": "bank_fee",
        "汇款费": "bank_fee", "季度结息": "deposit_interest", "结息转入": "deposit_interest",
    },
    "回单类型": {"业务收费凭证": "bank_fee"},
}
ACCOUNT_WORDS = (
    "开户", "付款人", "收款人", "付款方", "收款方", "付款行", "收款行", "付款银行", "收款银行",
    "付方银行", "收方银行", "银行行号", "银行名称", "账号", "户名", "对方银行", "对手银行",
    "付款：", "付款:", "收款：", "收款:", "行名：", "行名:",
)


def lookup(table: Mapping[str, str], key: Column) -> Column:
    return F.element_at(tx.table(table), key)


def alternatives(words: Sequence[str]) -> str:
    """Regex alternation, longest first, every word taken literally."""
    return "(?:" + "|".join(f"\\Q{w}\\E" for w in sorted(words, key=len, reverse=True)) + ")"


def split_lines(c: Column) -> Column:
    """Text lines as Python's splitlines() gives them, at least one."""
    ends = "(?:\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029])"
    return F.split(F.regexp_replace(c, ends + "\\z", ""), ends)


def vacant_marker(c: Column, markers: Sequence[str] = VACANT_MARKERS) -> Column:
    """The whole block is an 'empty slot' marker, punctuation aside."""
    return F.regexp_replace(tx.no_space(c), "[!！。.]+$", "").isin(*markers)


def _title_line(line: Column) -> Column:
    words, suffixes = "|".join(TITLE_PREFIX_WORDS), "|".join(TITLE_SUFFIXES)
    form = f"(?:回单|.*(?:{words}).*回单)(?:{suffixes})*"
    plain = line.rlike(f"^{form}$")
    bracketed = line.rlike(f"^{form}\\s*(?:（[^（）]{{1,8}}）|\\([^()]{{1,8}}\\))$")
    exact = line.isin(*EXACT_TITLES) | tx.no_space(line).isin(*DOCUMENT_TITLES)
    barred = (F.length(line) > 40) | line.rlike("[:：]") | line.rlike("|".join(FIELD_WORDS))
    body = line.rlike("|".join(BODY_WORDS))
    ends = line.rlike("利息单$") | (line.rlike("(?:贷记通知|借记通知)$") & line.contains("银行")) | bracketed
    not_label = ~(line.startswith("回单") & ~line.endswith("回单"))
    return ~barred & (exact | (~body & (plain | (not_label & ends))))


def is_title(c: Column) -> Column:
    """Slip-title grammar over the lines of one block; a line before a seal label does not count."""
    lines = F.transform(
        split_lines(c), lambda s: F.regexp_replace(tx.squeeze(s), f"(?<={_CJK})\\s+(?={_CJK})", "")
    )
    lines = F.filter(lines, lambda s: s != "")
    pairs = F.arrays_zip(lines.alias("a"), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))).alias("b"))
    named = F.transform(pairs, lambda p: F.struct(p["a"].alias("line"), F.coalesce(p["b"], F.lit("")).alias("next")))
    # The grammar is tried on the few blocks that hold a character every title ends its form with.
    found = F.exists(named, lambda p: ~p["next"].contains("专用章") & _title_line(p["line"]))
    return F.coalesce(F.when(c.rlike(f"[{TITLE_MARKS}]"), found), F.lit(False))


def flag_titles(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("is_title", is_title(F.col("text")))


def drop_vacant(blocks: DataFrame) -> DataFrame:
    """Remove empty-slot markers from pages that have a title above one of them."""
    w = Window.partitionBy(*PAGE)
    title_bottom = F.min(F.when(is_title(F.col("text")) & ~F.col("is_watermark"), F.col("y1"))).over(w)
    marked = (
        blocks.withColumn("_m", vacant_marker(F.col("text")))
        .withColumn("_t", title_bottom)
        .withColumn("_any", F.max(F.col("_m") & (F.col("y0") > F.col("_t"))).over(w))
    )
    return marked.filter(~(F.col("_m") & F.coalesce("_any", F.lit(False)))).drop("_m", "_t", "_any")


def flag_watermarks(blocks: DataFrame) -> DataFrame:
    """Diagonal bank-name backgrounds: at least three places over at least three rows of a page.

    ``dx, dy`` give the text direction. Places are made distinct by partial aggregation first,
    so the row fold sees one entry per distinct top edge of one name on one page.
    """
    name = tx.no_space(F.col("text"))
    shaped = (
        name.rlike("^[\\u3400-\\u4dbf\\u4e00-\\u9fff]{2,18}银行$")
        & (F.length("text") <= 80)
        & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
        & F.abs("dx").between(0.2000001, 1.0) & F.abs("dy").between(0.2000001, 1.0)
    )
    places = (
        blocks.filter(shaped)
        .select(*PAGE, name.alias("_name"), *[F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")])
        .groupBy(*PAGE, "_name", "y0")
        .agg(
            F.count_distinct(F.struct("x0", "x1", "y1")).alias("_n"),
            F.max(F.col("y1") - F.col("y0")).alias("_h"),
        )
    )
    groups = places.groupBy(*PAGE, "_name").agg(
        F.sum("_n").alias("_n"), F.max("_h").alias("_h"), F.array_sort(F.collect_list("y0")).alias("_ys")
    )
    rows = F.size(greedy_starts(F.col("_ys"), lambda y, last: y - last > F.col("_h")))
    marks = groups.filter((F.col("_n") >= 3) & (rows >= 3)).select(*PAGE, "_name", F.lit(True).alias("_hit"))
    return (
        blocks.withColumn("_name", F.when(shaped, name))
        .join(marks, [*PAGE, "_name"], "left")
        .withColumn("is_watermark", F.coalesce("_hit", F.lit(False)))
        .drop("_name", "_hit")
    )


def page_label(c: Column) -> Column:
    compact = F.lower(tx.no_space(c))
    return compact.rlike(
        "^(?:第\\d{1,6}页(?:[,，]?共\\d{1,6}页)?|\\d{1,6}[/／]\\d{1,6}"
        "|page\\d{1,6}(?:of\\d{1,6}|[/／]\\d{1,6})?|[-—–]\\d{1,6}[-—–])$"
    )


def is_page_number(width: Column, height: Column) -> Column:
    """Page label alone in the bottom tenth, at most 45 % of the page wide."""
    r = Rect()
    return (
        (r.y0 >= height * 0.9) & (r.y1 <= height) & (r.width <= width * 0.45) & page_label(F.col("text"))
    )


def drop_page_numbers(blocks: DataFrame) -> DataFrame:
    return blocks.filter(~is_page_number(F.col("page_width"), F.col("page_height")))


def detect_doc_type(blocks: DataFrame, titles: Mapping[str, str] | None = None) -> DataFrame:
    """Exact special heading in the top fifth; one distinct kind per page or none."""
    kind = lookup(titles or DOCUMENT_TITLES, tx.no_space(F.col("text")))
    in_top = ~F.col("is_watermark") & (F.col("y0") >= 0) & (F.col("y0") < F.col("page_height") * 0.2)
    found = F.when(in_top & (F.length("text") <= 128), kind)
    return blocks.groupBy(*PAGE).agg(
        F.when(F.min(found) == F.max(found), F.min(found)).alias("document_type")
    )


def nearest_right_unique(
    labels: DataFrame, lines: DataFrame, keys: Sequence[str], label_id: str = "line_no", span: str = "span"
) -> DataFrame:
    """Closest cell to the right on the label's row; two equally close cells mean none.

    ``span`` is the width of the slip on the label row. Only rows within a few points meet.
    """
    left = Rect()
    drift = F.greatest(F.lit(2.0), left.height * 0.25)
    pairs = band_pairs(labels, lines, keys, left.y0 - drift, left.y0 + drift, "y0", prefix="v_")
    value = Rect("v_")
    ok = (
        (value.x0 >= left.x1)
        & (value.x0 - left.x1 <= F.least(F.lit(120.0), F.col(span) * 0.3))
        & (g.overlap_height(left, value) > 0)
        & (F.abs(value.y0 - left.y0) <= drift)
    )
    w = Window.partitionBy(*keys, label_id)
    return (
        pairs.filter(ok)
        .withColumn("_min", F.min("v_x0").over(w))
        .filter(F.abs(F.col("v_x0") - F.col("_min")) <= 0.1)
        .withColumn("_n", F.count(F.lit(1)).over(w))
        .filter("_n = 1")
        .drop("_min", "_n")
    )


def detect_service_type(lines: DataFrame, keys: Sequence[str] = ("segment_id",)) -> DataFrame:
    """Service kind of a slip from its heading or one exact label/value pair; one kind or none.

    ``lines`` are clipped to the slip, whose rectangle is repeated as ``sx0, sy0, sx1, sy1``.
    """
    compact = F.translate(tx.no_space(F.col("text")), "（）", "()")
    rows = lines.withColumn("_c", compact).filter(F.col("_c") != "")
    top = F.col("sy0") + F.least(F.lit(100.0), (F.col("sy1") - F.col("sy0")) * 0.3)
    bare = F.regexp_replace("_c", "[:：]+$", "")
    heading = F.when(F.col("y0") <= top, lookup(SERVICE_TITLES, F.col("_c")))
    pair_table = {f"{label}\t{v}": k for label, vs in SERVICE_VALUES.items() for v, k in vs.items()}
    label = F.regexp_extract("_c", f"^({alternatives(list(SERVICE_VALUES))})[:：].+", 1)
    value = F.regexp_replace("_c", f"^{alternatives(list(SERVICE_VALUES))}[:：]", "")
    inline = F.when(label != "", lookup(pair_table, F.concat_ws("\t", label, value)))
    direct = rows.select(*keys, F.explode(F.array_compact(F.array(heading, inline))).alias("kind"))
    labels = rows.filter(bare.isin(*SERVICE_VALUES)).withColumn("span", F.col("sx1") - F.col("sx0"))
    near = nearest_right_unique(
        labels, rows.select(*keys, F.col("_c").alias("v_c"), *_prefixed("v_")), keys
    )
    paired = near.select(*keys, lookup(pair_table, F.concat_ws("\t", bare, F.col("v_c"))).alias("kind"))
    return (
        direct.unionByName(paired.filter("kind is not null"))
        .groupBy(*keys)
        .agg(F.when(F.min("kind") == F.max("kind"), F.min("kind")).alias("service_type"))
    )


def _prefixed(prefix: str) -> list[Column]:
    return [F.col(c).alias(prefix + c) for c in ("x0", "y0", "x1", "y1")]


def masthead_bank(lines: DataFrame, line_id: str = "block_index") -> DataFrame:
    """Bank headings that are not the value of an account label on their row or just above."""
    heads = settle(lines, {"bank": tx.canonical_bank(F.col("text"))}).filter("bank is not null")
    words = tx.no_space(F.col("text")).rlike(alternatives(ACCOUNT_WORDS))
    labels = lines.filter(words).select(*PAGE, *_prefixed("a_"))
    r, a = Rect(), Rect("a_")
    labels = labels.withColumn("_b", F.explode(g.bands(a.y0 - 2, a.y1 + 20, 32.0)))
    spread = heads.withColumn("_b", F.explode(g.bands(r.y0, r.y1, 32.0)))
    hit = (
        (g.overlap_height(r, a) > 0)
        | (F.abs(a.y0 - r.y0) <= 2)
        | ((r.y0 - a.y1 >= 0) & (r.y0 - a.y1 <= 20))
    )
    rejected = spread.join(labels, [*PAGE, "_b"]).filter(hit).select(*PAGE, line_id).distinct()
    return heads.join(rejected, [*PAGE, line_id], "left_anti")


def source_heading(lines: DataFrame, slips: DataFrame, headings: DataFrame | None = None) -> DataFrame:
    """Issuing bank per slip: one bank among the headings in its top part, else unknown."""
    heads = masthead_bank(lines) if headings is None else headings
    top = F.col("s_y0") + F.least(F.lit(100.0), (F.col("s_y1") - F.col("s_y0")) * 0.3)
    r, s = Rect(), Rect("s_")
    inside = (r.x0 >= s.x0) & (r.y0 >= s.y0) & (r.x1 <= s.x1) & (r.y1 <= s.y1) & (r.y0 <= top)
    frames = slips.select(*PAGE, "segment_id", *_prefixed("s_"))
    found = (
        meet(frames, heads.select(*PAGE, "bank", "x0", "y0", "x1", "y1"), list(PAGE), (F.col("s_y0"), F.col("s_y1")), (F.col("y0"), F.col("y1")))
        .filter(inside)
        .groupBy("segment_id")
        .agg(F.min("bank").alias("_lo"), F.max("bank").alias("_hi"))
    )
    one = F.col("_lo") == F.col("_hi")
    return slips.join(found, "segment_id", "left").select(
        "segment_id",
        F.when(one, F.col("_lo")).otherwise(F.lit("")).alias("source_bank"),
        F.when(one, "present").otherwise("unknown").alias("source_state"),
    )


def own_masthead(titles: DataFrame, heads: DataFrame) -> DataFrame:
    """Bank headings up to 64pt above a title, below the title before it, if they name one bank.

    The title's own bank counts. ``titles`` carry ``title_no``; one row per title with headings.
    """
    w = Window.partitionBy(*PAGE).orderBy("y0", "x0")
    t = titles.withColumn("_prev", F.coalesce(F.lag("y1").over(w), F.lit(0.0))).select(
        *PAGE, "title_no", "_prev", F.col("text").alias("t_text"), *_prefixed("t_")
    )
    lower = F.greatest("_prev", F.col("t_y0") - 64)
    named = F.regexp_extract("t_text", "^(.*?银行)", 1)
    own = F.when(named != "", tx.canonical_bank(named))
    pairs = band_pairs(
        t, heads.select(*PAGE, F.col("bank").alias("h_bank"), *_prefixed("h_")), PAGE,
        lower, F.col("t_y1"), "y0", prefix="h_",
    )
    ok = (F.col("h_y0") >= lower) & (F.col("h_y0") <= F.col("t_y1")) & (F.col("h_y1") <= F.col("t_y1") + 3)
    lo, hi = F.least(F.min("h_bank"), F.first(own)), F.greatest(F.max("h_bank"), F.first(own))
    return (
        pairs.filter(ok)
        .groupBy(*PAGE, "title_no")
        .agg(lo.alias("bank"), hi.alias("_hi"), F.min("h_y0").alias("head_y0"), F.count(F.lit(1)).alias("headings"))
        .filter("bank = _hi")
        .drop("_hi")
    )


def pair_split_labels(lines: DataFrame) -> DataFrame:
    """Marker label and value printed as two texts: aligned, close, one-to-one, nothing between."""
    keep = [*PAGE, "line_no"]
    a, b, c = Rect("l_"), Rect("v_"), Rect("o_")
    labels = lines.filter(tx.is_marker_label(F.col("text")))
    labels = labels.groupBy(*PAGE, "x0", "y0", "x1", "y1").agg(F.min("line_no").alias("line_no"))
    labels = labels.select(*PAGE, F.col("line_no").alias("label_no"), *_prefixed("l_"))
    values = lines.filter(tx.is_marker_value(F.col("text")))
    values = values.groupBy(*PAGE, "x0", "y0", "x1", "y1").agg(F.min("line_no").alias("line_no"))
    values = values.select(*PAGE, F.col("line_no").alias("value_no"), *_prefixed("v_"))
    fits = (
        (a.height > 0) & (b.height > 0) & (b.width > 0)
        & (F.abs(a.y0 - b.y0) <= 2) & (F.abs(a.y1 - b.y1) <= 2) & (F.abs(a.height - b.height) <= 2)
        & (b.x0 >= a.x1 - 2) & (b.x0 - a.x1 <= 16)
        & (b.width <= F.greatest(a.width, a.height * 4))
    )
    near = band_pairs(labels, values, PAGE, a.y0 - 2, a.y0 + 2, "y0", prefix="v_").filter(fits)
    one_to_one = (
        near.withColumn("_nl", F.count(F.lit(1)).over(Window.partitionBy(*PAGE, "label_no")))
        .withColumn("_nv", F.count(F.lit(1)).over(Window.partitionBy(*PAGE, "value_no")))
        .filter("_nl = 1 and _nv = 1")
        .drop("_nl", "_nv")
    )
    others = lines.select(*PAGE, F.col("line_no").alias("o_no"), *_prefixed("o_"))
    between = (
        ~((c.x0 == a.x0) & (c.y0 == a.y0) & (c.x1 == a.x1) & (c.y1 == a.y1))
        & ~((c.x0 == b.x0) & (c.y0 == b.y0) & (c.x1 == b.x1) & (c.y1 == b.y1))
        & (F.abs(c.y0 - a.y0) <= 2) & (F.abs(c.y1 - a.y1) <= 2)
        & (c.x0 < b.x0 + 2) & (c.x1 > a.x1 - 2)
    )
    blocked = (
        band_pairs(one_to_one, others, PAGE, a.y0 - 2, a.y0 + 2, "y0", prefix="o_")
        .filter(between)
        .select(*PAGE, "label_no")
        .distinct()
    )
    return one_to_one.join(blocked, [*PAGE, "label_no"], "left_anti").select(
        *keep[:-1], "label_no", "value_no",
        F.least(a.y0, b.y0).alias("start_y"), F.greatest(a.y1, b.y1).alias("end_y"),
    )


def marker_groups(lines: DataFrame) -> DataFrame:
    """Print-count markers of a page: whole lines and split label/value pairs."""
    whole = lines.filter(tx.is_marker_line(F.col("text"))).select(*PAGE, "x0", "x1", F.col("y0").alias("start_y"), F.col("y1").alias("end_y"))
    whole = whole.distinct().select(*PAGE, "start_y", "end_y")
    return whole.unionByName(pair_split_labels(lines).select(*PAGE, "start_y", "end_y"))


def own_prefix_marker(titles: DataFrame, markers: DataFrame) -> DataFrame:
    """The only marker ending at most 16pt above a title, below the title before it, is the title's."""
    w = Window.partitionBy(*PAGE).orderBy("y0", "x0")
    t = titles.withColumn("_prev", F.coalesce(F.lag("y1").over(w), F.lit(0.0))).select(
        *PAGE, "title_no", "_prev", F.col("y0").alias("t_y0")
    )
    m = markers.select(*PAGE, F.col("start_y").alias("m_start"), F.col("end_y").alias("m_end"))
    pairs = band_pairs(t, m, PAGE, F.col("t_y0") - 16, F.col("t_y0") + 2, "end", prefix="m_")
    gap = F.col("t_y0") - F.col("m_end")
    return (
        pairs.filter((F.col("m_start") >= F.col("_prev") - 2) & (gap >= -2) & (gap <= 16))
        .groupBy(*PAGE, "title_no")
        .agg(F.min("m_start").alias("marker_y0"), F.count(F.lit(1)).alias("_n"))
        .filter("_n = 1")
        .drop("_n")
    )


def confidence_band(confidence: Column, usable: Column) -> Column:
    """Status a result starts with: blocked, needs_review or confirmed."""
    return (
        F.when((confidence < 0.7) | ~usable, "blocked").when(confidence < 0.9, "needs_review").otherwise("confirmed")
    )


def usable_rect(r: Rect, width: Column, height: Column, smallest: float = 24.0) -> Column:
    """Inside the page and, where the page allows it, at least ``smallest`` each way."""
    inside = (r.x0 >= 0) & (r.x0 < r.x1) & (r.x1 <= width) & (r.y0 >= 0) & (r.y0 < r.y1) & (r.y1 <= height)
    wide = F.when(width >= smallest, r.width >= smallest).otherwise((r.x0 == 0) & (r.x1 == width))
    tall = F.when(height >= smallest, r.height >= smallest).otherwise((r.y0 == 0) & (r.y1 == height))
    return F.coalesce(inside & wide & tall, F.lit(False))
