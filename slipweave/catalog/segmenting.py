"""Queries that recognise titles and markers and cut pages into slips."""

from pyspark.sql import functions as F

from slipweave.catalog.registry import query
from slipweave.functions import identity
from slipweave.functions import text as tx
from slipweave.operators import classify, segment
from slipweave.operators.nearby import band_pairs  # noqa: F401

_TITLES = """raw as (select * from block_truth where title and not is_watermark),
tops as (select * from (select *, row_number() over (partition by page, y0 order by x0, block_index) as rn from raw) where rn=1),
ord as (select *, row_number() over (partition by page order by y0) as i from tops),
kept as (select page, i, y0 as last from ord where i=1
  union all select o.page, o.i, case when o.y0-k.last>=32 then o.y0 else k.last end from kept k join ord o on o.page=k.page and o.i=k.i+1),
titles as (select o.*, row_number() over (partition by o.page order by o.y0) as title_no,
    lag(o.y1, 1, 0) over (partition by o.page order by o.y0) as prev_y1, lead(o.y0) over (partition by o.page order by o.y0) as next_title
  from ord o join kept k on o.page=k.page and o.i=k.i and o.y0=k.last)"""


@query(
    "flag_titles",
    "blocks block_truth",
    "select source_id, page, block_index, title as is_title from block_truth",
)
def _(t):
    return classify.flag_titles(t.blocks).select("source_id", "page", "block_index", "is_title")


@query(
    "dedupe_titles_by_gap",
    "blocks block_truth",
    f"with {_TITLES} select source_id, page, block_index, y0, cast(title_no as bigint) as title_no from titles",
)
def _(t):
    return segment.page_titles(t.blocks).select("source_id", "page", "block_index", "y0", "title_no")


@query(
    "drop_vacant",
    "blocks block_truth",
    """with top as (select page, min(y1) as top from block_truth where title and not is_watermark group by 1),
    vac as (select distinct b.page from block_truth b join top using (page) where text='此处空白无效！' and y0>top)
    select source_id, page, block_index from block_truth where not (text='此处空白无效！' and page in (select page from vac))""",
)
def _(t):
    return classify.drop_vacant(t.blocks).select("source_id", "page", "block_index")


@query(
    "flag_watermarks",
    "boxes",
    """with b as (select *, page%3000 as sheet, case tag when 'A' then '中国银行' when 'N' then '招商 银行' else '银行' end as text, block_index%4<>0 as slanted from boxes),
    d as (select distinct sheet, tag, x0, y0, x1, y1 from b where slanted and tag<>'R'),
    h as (select sheet, tag, max(y1-y0) as h, count(*) as n from d group by 1, 2),
    o as (select sheet, tag, y0, row_number() over (partition by sheet, tag order by y0) as i from (select distinct sheet, tag, y0 from d)),
    k as (select o.sheet, o.tag, i, y0 as last, 1 as n from o where i=1
      union all select o.sheet, o.tag, o.i, case when o.y0-k.last>h.h then o.y0 else k.last end, k.n + (o.y0-k.last>h.h)::int
      from k join o on o.sheet=k.sheet and o.tag=k.tag and o.i=k.i+1 join h on h.sheet=k.sheet and h.tag=k.tag),
    hit as (select sheet, tag from k join h using (sheet, tag) group by 1, 2 having max(k.n)>=3 and max(h.n)>=3)
    select cast(0 as bigint) as source_id, sheet as page, b.page as order_page, block_index, b.slanted and hit.sheet is not null as is_watermark
    from b left join hit using (sheet, tag)""",
)
def _(t):
    b = t.boxes.withColumns(
        {
            "order_page": F.col("page"), "page": F.col("page") % 3000, "source_id": F.lit(0).cast("long"),
            "text": F.when(F.col("tag") == "A", "中国银行").when(F.col("tag") == "N", "招商 银行").otherwise("银行"),
            "dx": F.when(F.col("block_index") % 4 != 0, 0.7).otherwise(1.0),
            "dy": F.when(F.col("block_index") % 4 != 0, -0.7).otherwise(0.0),
        }
    )
    return classify.flag_watermarks(b).select("source_id", "page", "order_page", "block_index", "is_watermark")


@query(
    "drop_page_numbers",
    "blocks",
    "select source_id, page, block_index from blocks where not (y0>=100*0.9 and y1<=1000 and x1-x0<=260*0.2 and text='第1页')",
)
def _(t):
    b = t.blocks.withColumn("page_height", F.lit(1000.0)).withColumn("y0", F.col("y0") + 810).withColumn("y1", F.col("y1") + 810)
    return b.filter(~classify.is_page_number(F.lit(260.0 * 0.2 / 0.45), F.col("page_height"))).select("source_id", "page", "block_index")


@query(
    "detect_doc_type",
    "blocks",
    """with k as (select source_id, page, case when not is_watermark and y0>=0 and y0<32 then case text when '电子缴税付款凭证' then 'electronic_tax_payment'
       when '贷款清算通知书' then 'loan_settlement_notice' end end as kind from blocks)
    select source_id, page, case when count(distinct kind)=1 then min(kind) end as document_type from k group by 1, 2""",
)
def _(t):
    return classify.detect_doc_type(t.blocks)


_SEG = "select page as segment_id, block_index as line_no, text, x0, y0, x1, y1, cast(0 as double) as sx0, cast(0 as double) as sy0, page_width as sx1, page_height as sy1 from blocks"


def _segments(t):
    return t.blocks.select(
        F.col("page").alias("segment_id"), F.col("block_index").alias("line_no"), "text", "x0", "y0", "x1", "y1",
        F.lit(0.0).alias("sx0"), F.lit(0.0).alias("sy0"), F.col("page_width").alias("sx1"), F.col("page_height").alias("sy1"),
    )


@query(
    "detect_service_type",
    "blocks",
    f"""with l as ({_SEG}),
    near as (select a.segment_id, a.line_no, b.text, b.x0, min(b.x0) over (partition by a.segment_id, a.line_no) as mx
      from l a join l b on a.segment_id=b.segment_id and a.text='摘要' and b.x0>=a.x1 and b.x0-a.x1<=78 and b.y0<a.y1 and b.y1>a.y0 and abs(a.y0-b.y0)<=3),
    one as (select segment_id, line_no, min(text) as text from near where abs(x0-mx)<=0.1 group by 1, 2 having count(*)=1),
    kinds as (select segment_id, 'bank_fee' as kind from l where text='银行收费凭证' and y0<=48
      union all select segment_id, 'bank_fee' from l where text='业务类型：银行收费'
      union all select segment_id, 'bank_fee' from one where text='汇款费')
    select segment_id, case when count(distinct kind)=1 then min(kind) end as service_type from kinds group by 1""",
)
def _(t):
    return classify.detect_service_type(_segments(t))


@query(
    "nearest_right_unique",
    "boxes",
    """with l as (select page, block_index, x0, y0, x1, y1 from boxes where tag='A'),
    near as (select a.page, a.block_index, b.block_index as value_index, b.x0, min(b.x0) over (partition by a.page, a.block_index) as mx
      from l a join boxes b on a.page=b.page and b.x0>=a.x1 and b.x0-a.x1<=78 and b.y0<a.y1 and b.y1>a.y0 and abs(a.y0-b.y0)<=3)
    select page as segment_id, block_index as line_no, min(value_index) as value_no from near where abs(x0-mx)<=0.1 group by 1, 2 having count(*)=1""",
)
def _(t):
    cells = t.boxes.select(F.col("page").alias("segment_id"), F.col("block_index").alias("line_no"), "tag", "x0", "y0", "x1", "y1")
    values = cells.select("segment_id", F.col("line_no").alias("value_no"), *[F.col(c).alias("v_" + c) for c in ("x0", "y0", "x1", "y1")])
    labels = cells.filter("tag = 'A'").withColumn("span", F.lit(260.0))
    return classify.nearest_right_unique(labels, values, ["segment_id"]).select("segment_id", "line_no", "value_no")


_HEADS = """heads as (select * from block_truth h where bank is not null and not exists (
  select 1 from block_truth a where a.page=h.page and a.text in ('付款人账号：123')
    and ((least(h.y1,a.y1)>greatest(h.y0,a.y0)) or abs(a.y0-h.y0)<=2 or (h.y0-a.y1 between 0 and 20))))"""


_NAMED = "from (select * replace (case when text in ('中国银行','农商银行') then text end as bank) from block_truth) h where bank is not null"


@query("masthead_bank", "blocks block_truth", f"with {_HEADS.replace('from block_truth h where bank is not null', _NAMED)} select source_id, page, block_index, bank from heads")
def _(t):
    return classify.masthead_bank(t.blocks).select("source_id", "page", "block_index", "bank")


@query(
    "own_masthead",
    "blocks block_truth",
    f"""with {_TITLES}, {_HEADS.replace("from block_truth h where bank is not null", "from (select * replace (case when text in ('中国银行','农商银行') then text end as bank) from block_truth where not is_watermark) h where bank is not null").replace("from block_truth a where", "from block_truth a where not a.is_watermark and")},
    p as (select t.source_id, t.page, t.title_no, case t.text when '招商银行借记通知' then '招商银行' end as own, h.bank, h.y0
      from titles t join heads h on h.page=t.page and h.y0>=greatest(t.prev_y1, t.y0-64) and h.y0<=t.y1 and h.y1<=t.y1+3)
    select source_id, page, cast(title_no as bigint) as title_no, min(least(bank, own)) as bank, min(y0) as head_y0, cast(count(*) as bigint) as headings
    from p group by 1, 2, 3 having min(least(bank, own))=max(greatest(bank, own))""",
)
def _(t):
    heads = classify.masthead_bank(t.blocks.filter("not is_watermark"))
    return classify.own_masthead(segment.page_titles(t.blocks), heads)


_MARKERS = """labels as (select distinct page, x0, y0, x1, y1 from blocks where text='打印次数：' and not is_watermark),
vals as (select distinct page, x0, y0, x1, y1 from blocks where text='7' and not is_watermark),
near as (select l.page, l.x0 as lx0, l.y0 as ly0, l.x1 as lx1, l.y1 as ly1, v.x0, v.y0, v.x1, v.y1 from labels l join vals v on l.page=v.page
  and abs(l.y0-v.y0)<=2 and abs(l.y1-v.y1)<=2 and v.x0>=l.x1-2 and v.x0-l.x1<=16 and v.x1-v.x0<=greatest(l.x1-l.x0, 48)),
uni as (select * from (select *, count(*) over (partition by page, lx0, ly0, lx1, ly1) as a, count(*) over (partition by page, x0, y0, x1, y1) as b from near) where a=1 and b=1),
split_pairs as (select page, least(ly0,y0) as start_y, greatest(ly1,y1) as end_y from uni u where not exists (
  select 1 from blocks o where o.page=u.page and not o.is_watermark and not (o.x0=u.lx0 and o.y0=u.ly0 and o.x1=u.lx1 and o.y1=u.ly1)
   and not (o.x0=u.x0 and o.y0=u.y0 and o.x1=u.x1 and o.y1=u.y1) and abs(o.y0-u.ly0)<=2 and abs(o.y1-u.ly1)<=2 and o.x0<u.x0+2 and o.x1>u.lx1-2)),
markers as (select page, start_y, end_y from (select distinct page, x0, x1, y0 as start_y, y1 as end_y from blocks where text='打印次数：3' and not is_watermark) w
  union all select * from split_pairs)"""


def _marker_lines(t):
    return t.blocks.filter("not is_watermark").withColumn("line_no", F.col("block_index"))


@query(
    "pair_split_labels",
    "blocks",
    f"with {_MARKERS} select page%100 as source_id, page, start_y, end_y from split_pairs",
)
def _(t):
    return classify.pair_split_labels(_marker_lines(t)).select("source_id", "page", "start_y", "end_y")


@query(
    "own_prefix_marker",
    "blocks block_truth",
    f"""with {_TITLES}, {_MARKERS}
    select t.source_id, t.page, cast(title_no as bigint) as title_no, min(start_y) as marker_y0 from titles t join markers m on m.page=t.page
      and m.start_y>=t.prev_y1-2 and t.y0-m.end_y between -2 and 16 group by 1, 2, 3 having count(*)=1""",
)
def _(t):
    return classify.own_prefix_marker(segment.page_titles(t.blocks), classify.marker_groups(_marker_lines(t)))


@query(
    "source_heading",
    "blocks block_truth slots",
    f"""with {_HEADS.replace("from block_truth h where bank is not null", "from (select * replace (case when text in ('中国银行','农商银行') then text end as bank) from block_truth) h where bank is not null")},
    f as (select s.instance_id, min(h.bank) as lo, max(h.bank) as hi from slots s join heads h on h.page=s.page
      and h.x0>=s.x0 and h.y0>=s.y0 and h.x1<=s.x1 and h.y1<=s.y1 and h.y0<=s.y0+15 group by 1)
    select s.instance_id as segment_id, case when lo=hi then lo else '' end as source_bank, case when lo=hi then 'present' else 'unknown' end as source_state
    from slots s left join f using (instance_id)""",
)
def _(t):
    slips = t.slots.withColumnsRenamed({"instance_id": "segment_id", **{c: "s_" + c for c in ("x0", "y0", "x1", "y1")}})
    slips = slips.select("source_id", "page", "segment_id", *[F.col("s_" + c).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return classify.source_heading(t.blocks, slips)


_REGION = """b as (select *, median(y1-y0) over (partition by page) as m, lag(y1) over (partition by page order by y0, x0, block_index) as prev from boxes),
c as (select *, prev is not null and (y0-prev>greatest(m*2.2,12) {sep}) as cut from b),
r as (select *, 1+sum(cut::int) over (partition by page order by y0, x0, block_index) as region_no from c),
a as (select source_id, page, region_no, count(*) as n, min(x0)-8 as a, min(y0)-8 as b, max(x1)+8 as c, max(y1)+8 as d from r group by 1, 2, 3)
select source_id, page, cast(region_no as bigint) as region_no, cast(n as bigint) as blocks, greatest(0,a) as x0, greatest(0,b) as y0, least(260,c) as x1, greatest(least(160,d), greatest(0,b)+24) as y1,
  floor((5500+least(n,8)*375+case when max(region_no) over (partition by page)>1 then 1000 else 0 end+5)/10)/1000 as confidence from a"""


def _sized(t):
    return t.boxes.withColumn("page_width", F.lit(260.0)).withColumn("page_height", F.lit(160.0))


@query("segment_by_gap", "boxes", "with " + _REGION.format(sep=""))
def _(t):
    return segment.segment_by_gap(_sized(t))


@query(
    "segment_by_gap_separators",
    "boxes",
    "with seps as (select o_orderkey as page, 20+20.0::double*(o_custkey%5) as y from orders), "
    + _REGION.format(sep="or exists (select 1 from seps s where s.page=b.page and s.y>=prev and s.y<=b.y0)"),
)
def _(t):
    seps = t.orders.select(
        (F.col("o_orderkey") % 100).alias("source_id"), F.col("o_orderkey").alias("page"),
        (F.lit(20.0) + 20.0 * (F.col("o_custkey") % 5)).alias("y"),
    )
    return segment.segment_by_gap(_sized(t), seps)


@query("segment_by_title")
def _(t):
    return segment.segment_by_title(t.blocks)


_LAST = """select t.source_id, t.page, cast(t.title_no as bigint) as title_no, coalesce(max(b.y1), any_value(t.y1)) as last_y,
  case when coalesce(max(b.y1), any_value(t.y1))>=160 then 'invalid_geometry' when coalesce(max(b.y1), any_value(t.y1))>=any_value(t.next_title) then 'crosses_next_title' end as violation
  from titles t left join blocks b on b.page=t.page and not b.is_watermark and not (b.y0>=144 and b.y1<=160 and b.x1-b.x0<=117) and b.y0>=t.y0 and b.y0<coalesce(t.next_title,160) group by 1, 2, 3"""


@query("last_text_y", "blocks block_truth", f"with {_TITLES} {_LAST}")
def _(t):
    return segment.last_text_y(segment.page_titles(t.blocks), t.blocks)


_SEGMENTS = "segs as (select distinct cast(l_suppkey%50 as bigint) as source_id, cast(l_orderkey%500 as bigint) as page, cast(l_partkey%60 as double) as position, cast(l_quantity*4 as double) as s0, cast(l_quantity*4+l_linenumber*6 as double) as s1 from lineitem)"


def _segs(t):
    li = t.lineitem
    return li.select(
        (F.col("l_suppkey") % 50).alias("source_id"), (F.col("l_orderkey") % 500).alias("page"),
        (F.col("l_partkey") % 60).cast("double").alias("position"), (F.col("l_quantity") * 4).alias("start"),
        (F.col("l_quantity") * 4 + F.col("l_linenumber") * 6).alias("end"),
    )


@query(
    "merge_intervals",
    "",
    f"""with {_SEGMENTS}, o as (select source_id, page, position, row_number() over (partition by source_id, page order by position) as i from (select distinct source_id, page, position from segs)),
    k as (select source_id, page, i, position, position as axis from o where i=1 union all
      select o.source_id, o.page, o.i, o.position, case when o.position-k.axis>2 then o.position else k.axis end from k join o on o.source_id=k.source_id and o.page=k.page and o.i=k.i+1),
    r as (select s.*, k.axis, max(s1) over (partition by s.source_id, s.page, axis order by s0, s1 rows between unbounded preceding and 1 preceding) as reach
      from segs s join k using (source_id, page, position)),
    g as (select *, sum(case when reach is null or s0>reach+2 then 1 else 0 end) over (partition by source_id, page, axis order by s0, s1 rows unbounded preceding) as run from r)
    select source_id, page, axis as position, min(s0) as "start", max(s1) as "end" from g group by source_id, page, axis, run""",
)
def _(t):
    return segment.merge_intervals(_segs(t))


@query(
    "closed_tables",
    "",
    """with h as (select o_orderkey as page, y, a, b from (select o_orderkey, cast(20+o_custkey%5 as double) as a, cast(220+o_custkey%7 as double) as b, unnest([0, 20+o_orderkey%20, 45+o_orderkey%10, 100])::double as y from orders)),
    v as (select o_orderkey as page, unnest([20+o_custkey%5, 220+o_custkey%7, 120])::double as x, cast(0 as double) as v0, cast(case when o_orderkey%4=0 then 30 when o_orderkey%4=1 then 45+o_orderkey%10 else 100 end as double) as v1 from orders),
    e as (select t.page, t.a as x0, t.y as y0, t.b as x1, l.y as y1 from h t join h l on l.page=t.page and l.y-t.y>=48 and abs(l.a-t.a)<=2 and abs(l.b-t.b)<=2
      where t.b-t.a>=90
       and exists (select 1 from v where v.page=t.page and abs(x-t.a)<=2 and v0<=t.y+2 and v1>=l.y-2) and exists (select 1 from v where v.page=t.page and abs(x-t.b)<=2 and v0<=t.y+2 and v1>=l.y-2)
       and exists (select 1 from v where v.page=t.page and (abs(x-t.a)<=2 or abs(x-t.b)<=2) and abs(v0-t.y)<=2) and exists (select 1 from v where v.page=t.page and (abs(x-t.a)<=2 or abs(x-t.b)<=2) and abs(v1-l.y)<=2)
       and exists (select 1 from h i where i.page=t.page and i.y>t.y+2 and i.y<l.y-2 and i.a<=t.a+2 and i.b>=t.b-2))
    select page%100 as source_id, page, x0, y0, x1, y1 from e""",
)
def _(t):
    a, b = (F.lit(20) + F.col("o_custkey") % 5).cast("double"), (F.lit(220) + F.col("o_custkey") % 7).cast("double")
    k = F.col("o_orderkey")
    page = [(k % 100).alias("source_id"), k.alias("page"), F.lit(300.0).alias("page_width"), F.lit(400.0).alias("page_height")]
    ys = F.array(F.lit(0.0), (20 + k % 20).cast("double"), (45 + k % 10).cast("double"), F.lit(100.0))
    h = t.orders.select(*page, F.explode(ys).alias("position"), a.alias("start"), b.alias("end"))
    end = F.when(k % 4 == 0, 30).when(k % 4 == 1, 45 + k % 10).otherwise(100).cast("double")
    v = t.orders.select(*page[:2], F.explode(F.array(a, b, F.lit(120.0))).alias("position"), F.lit(0.0).alias("start"), end.alias("end"))
    return segment.closed_tables(h, v)


@query(
    "fix_seams",
    "loose_slots boxes",
    """with s as (select *, top+height-lead(top) over w as over_, lead(top) over w as nt from loose_slots window w as (partition by page order by position_index)),
    m as (select *, case when over_>0 then (top+height+nt)/2 end as mid from s),
    c as (select *, coalesce(over_>2.5 or (over_>0 and exists (select 1 from boxes b where b.page=m.page and b.y0<mid and mid<b.y1)), false) as bad from m),
    f as (select *, lag(mid) over (partition by page order by position_index) as pm, bool_or(bad) over (partition by page) as inv from c)
    select source_id, page, position_index, coalesce(pm, top) as top, coalesce(mid, top+height)-coalesce(pm, top) as height, not inv as valid from f""",
)
def _(t):
    return segment.fix_seams(t.loose_slots, t.boxes.withColumn("is_watermark", F.lit(False)))


@query(
    "uniform_height",
    "loose_slots",
    """with h as (select * replace (height - case when position_index=2 then (page%3)*0.25 else 0 end as height) from loose_slots),
    m as (select *, max(height) over (partition by page) as mx, coalesce(lead(top) over (partition by page order by position_index), page_height)-top as room from h),
    u as (select *, bool_and(mx-height<=0.5 and mx<=room) over (partition by page) as uniform from m)
    select source_id, page, position_index, top, case when uniform then mx else height end as height, uniform from u""",
)
def _(t):
    s = t.loose_slots.withColumn(
        "height", F.col("height") - F.when(F.col("position_index") == 2, (F.col("page") % 3) * 0.25).otherwise(0.0)
    )
    return segment.uniform_height(s).select("source_id", "page", "position_index", "top", "height", "uniform")


@query(
    "equal_slots",
    "",
    """select o_custkey%100 as source_id, o_orderkey as page, cast(i as bigint) as position_index, concat('slot-', i) as slot_id,
      10+(i-1)*((700+o_orderkey%100-30-10)/3+5) as top, (700+o_orderkey%100-30-10)/3 as height, true as valid
      from (select o_custkey, o_orderkey::double as ok, o_orderkey, unnest(range(1,4)) as i from orders)""",
)
def _(t):
    pages = t.orders.select(
        (F.col("o_custkey") % 100).alias("source_id"), F.col("o_orderkey").alias("page"),
        (700 + F.col("o_orderkey") % 100).cast("double").alias("page_height"),
    )
    return segment.equal_slots(pages, 3, 10, 20, 5)


@query(
    "occupy_slots",
    "blocks slots boxes",
    """with o as (select page, block_index, x0, y0, x1, y1 from boxes where tag='R'),
    t as (select s.page, s.position_index, count(*) as blocks, count(*) filter (where mark) as markers, count(*) filter (where mark and inside) as im,
      count(*) filter (where not mark and inside) as complete, count(*) filter (where not mark and not inside) as crossing, count(*) filter (where not mark and confidence<0.9) as ut
      from (select s.page, s.position_index, b.text='此处空白无效！' as mark, b.x0>=s.x0 and b.y0>=s.y0 and b.x1<=s.x1 and b.y1<=s.y1 as inside, b.confidence
        from slots s join blocks b on b.page=s.page and not b.is_watermark and s.x0<b.x1 and s.x1>b.x0 and s.y0<b.y1 and s.y1>b.y0) s group by 1, 2),
    v as (select s.page, s.position_index, count(*) as objects, count(*) filter (where not (b.x0>=s.x0 and b.y0>=s.y0 and b.x1<=s.x1 and b.y1<=s.y1)) as co
      from slots s join o b on b.page=s.page and s.x0<b.x1 and s.x1>b.x0 and s.y0<b.y1 and s.y1>b.y0 group by 1, 2),
    j as (select s.source_id, s.page, s.position_index, coalesce(blocks,0) as blocks, coalesce(markers,0) as markers, coalesce(im,0) as im, coalesce(complete,0) as complete,
       coalesce(crossing,0) as crossing, coalesce(ut,0) as ut, coalesce(objects,0) as objects, coalesce(co,0) as co from slots s left join t using (page, position_index) left join v using (page, position_index)),
    e as (select *, case when markers>0 and blocks=markers and objects=0 then 'invalid' when blocks=0 and objects=0 then 'blank' end as reason from j)
    select source_id, page, position_index, reason as excluded_reason, case when reason is not null then null when complete>0 then 'occupied' else 'uncertain' end as occupancy,
      cast(blocks as bigint) as blocks, cast(objects as bigint) as objects, cast(crossing as bigint) as crossing, cast(co as bigint) as crossing_objects, cast(ut as bigint) as uncertain_text,
      reason is null and im>0 and (blocks>markers or objects>0) as suspected_invalid from e""",
)
def _(t):
    objects = t.boxes.filter("tag = 'R'").withColumn("kind", F.lit("stroke-path"))
    return segment.occupy_slots(t.slots, t.blocks, objects)


@query(
    "outside_slots",
    "blocks slots",
    """select source_id, page, block_index from blocks b where not is_watermark and text<>'此处空白无效！' and not exists (
      select 1 from (select * replace (y0+case when position_index=3 then 9000 else 0 end as y0, y1+case when position_index=3 then 9000 else 0 end as y1) from slots) s where s.page=b.page and s.x0<b.x1 and s.x1>b.x0 and s.y0<b.y1 and s.y1>b.y0)""",
)
def _(t):
    # The third slot lies below the page, so that some text is outside.
    low = F.when(F.col("position_index") == 3, 9000).otherwise(0)
    return segment.outside_slots(t.slots.withColumns({c: F.col(c) + low for c in ("y0", "y1")}), t.blocks)


@query(
    "number_segments",
    "regions",
    "select source_id, page, region_no, cast(row_number() over (partition by page order by y0, region_no) as bigint) as segment_no from regions",
)
def _(t):
    return segment.number_segments(t.regions, ["y0", "region_no"]).select("source_id", "page", "region_no", "segment_no")


@query(
    "layout_groups",
    "regions",
    """select concat('geometry:260x160:', case when x0>0 then x0::bigint::varchar else 'unknown' end, ',', case when y0>0 then (y0+0.25)::varchar else '0.25' end, ',', x1::bigint, ',', y1::bigint) as fingerprint,
      cast(count(*) as bigint) as items, cast(count(distinct (source_id, page)) as bigint) as pages from regions group by 1""",
)
def _(t):
    r = t.regions.withColumn("y0", F.col("y0") + 0.25)
    return segment.layout_groups(
        r, identity.geometry_fingerprint(F.col("page_width"), F.col("page_height"), [F.col(c) for c in ("x0", "y0", "x1", "y1")])
    )


_EVIDENCE = _TITLES + """,
seq as (select *, lag(y0) over w as py, lag(x0) over w as px0, lag(x1) over w as px1 from raw window w as (partition by page order by y0, x0)),
odd as (select page, bool_or(coalesce(abs(y0-py)<32 and least(x1,px1)<=greatest(x0,px0), false)) as odd, min(y1) as top from seq group by 1),
n as (select page, count(*) as n from titles group by 1),
vac as (select source_id, page, max(case when text='此处空白无效！' then y0 end) as vy from blocks group by 1, 2),
ev as (select v.source_id, v.page, case when o.odd is false then coalesce(n,0) else 0 end as titles, coalesce(not o.odd, false) as usable,
  coalesce(not o.odd, false) and coalesce(vy>top, false) as vacant from vac v left join odd o using (page) left join n using (page))"""


@query(
    "page_policy_evidence",
    "blocks block_truth",
    f"with {_EVIDENCE} select source_id, page, cast(titles as bigint) as titles, usable, vacant from ev",
)
def _(t):
    return segment.page_policy_evidence(t.blocks)


@query(
    "source_policy",
    "blocks block_truth",
    f"""with {_EVIDENCE}, ev2 as (select * replace (page%7 + source_id*10 as source_id, usable or page%7<>3 as usable) from ev), keys as (select page%7 + source_id*10 as source_id, page, case when page%41=0 then null else concat('k', titles, '-', page%5) end as template_key from ev),
    src as (select source_id, bool_and(usable) as complete, bool_or(titles>1 or vacant) as multi from ev2 group by 1),
    mk as (select k.* from keys k join ev2 e using (source_id, page) where e.titles>1 or e.vacant),
    um as (select source_id, bool_or(template_key is null) as u from mk group by 1)
    select e.source_id, e.page, case when e.titles>1 or e.vacant then 'multiple' when not e.usable then 'unknown' when not s.multi then case when s.complete then 'single' else 'unknown' end
      when k.template_key is not null and exists (select 1 from mk where mk.source_id=e.source_id and mk.template_key=k.template_key) then 'multiple'
      when k.template_key is not null and s.complete and not coalesce(um.u, false) then 'single' else 'unknown' end as policy
    from ev2 e join src s using (source_id) join keys k on k.source_id=e.source_id and k.page=e.page left join um on um.source_id=e.source_id""",
)
def _(t):
    ev = segment.page_policy_evidence(t.blocks)
    keys = ev.select(
        (F.col("page") % 7 + F.col("source_id") * 10).alias("source_id"), "page",
        F.when(F.col("page") % 41 != 0, F.concat(F.lit("k"), F.col("titles").cast("string"), F.lit("-"), (F.col("page") % 5).cast("string"))).alias("template_key"),
    )
    ev = ev.withColumn("source_id", F.col("page") % 7 + F.col("source_id") * 10).withColumn("usable", F.col("usable") | (F.col("page") % 7 != 3))
    return segment.source_policy(ev, keys)


@query(
    "reference_layouts",
    "",
    """with p as (select o_custkey%200 as source_id, o_orderkey as page, o_orderkey%3 as slips, case when o_orderkey%11>0 then concat('b', o_orderkey%2) end as bank,
      list_sort(list_distinct([concat('k', o_orderkey%4), concat('k', o_orderkey%6)])) as keys from orders)
    select a.source_id, a.page, cast(min(b.page) as bigint) as first_page, cast(count(*) filter (where a.page<>b.page) as bigint) as other_pages from p a join p b on a.source_id=b.source_id and a.bank=b.bank
      and b.slips>1 and list_has_all(b.keys, a.keys) group by 1, 2 having count(*) filter (where a.page<>b.page)>0""",
)
def _(t):
    k = F.col("o_orderkey")
    pages = t.orders.select(
        (F.col("o_custkey") % 200).alias("source_id"), k.alias("page"), (k % 3).alias("slips"),
        F.when(k % 11 > 0, F.concat(F.lit("b"), (k % 2).cast("string"))).alias("bank"),
        F.array_sort(F.array_distinct(F.array(*[F.concat(F.lit("k"), (k % n).cast("string")) for n in (4, 6)]))).alias("keys"),
    )
    return segment.reference_layouts(pages)


def _reference_tables(t):
    k = F.col("o_orderkey")
    source = F.floor(F.col("o_custkey") / 4).cast("long").alias("source_id")
    names = lambda prefix, *ns: F.array_sort(F.array_distinct(F.array(*[F.concat(F.lit(prefix), n.cast("string")) for n in ns])))
    pages = t.orders.select(
        source, k.alias("page"), (k % 3).alias("slips"), (k % 4).alias("titles"), (k % 10 == 0).alias("vacant"),
        F.when(k % 11 > 0, F.concat(F.lit("b"), (k % 2).cast("string"))).alias("bank"),
        F.when(k % 7 > 0, names("k", k % 4, k % 6)).otherwise(F.array().cast("array<string>")).alias("keys"),
    )
    return pages, t.orders.filter(k % 13 > 0).select(source, k.alias("page"), F.explode(names("h", k % 5, k % 3 + 2)).alias("heading"))


@query(
    "reference_pages",
    "",
    """with p as (select o_custkey//4 as source_id, o_orderkey as page, o_orderkey%3 as slips, o_orderkey%4 as titles, o_orderkey%10=0 as vacant, case when o_orderkey%11>0 then concat('b', o_orderkey%2) end as bank,
      case when o_orderkey%7>0 then [concat('k', o_orderkey%4), concat('k', o_orderkey%6)] else [] end as keys from orders),
    h as (select source_id, page, unnest([concat('h', page%5), concat('h', page%3+2)]) as heading from p where page%13>0)
    select a.source_id, a.page, 'template' as basis, b.page as reference_page from p a join p b on a.source_id=b.source_id and a.bank=b.bank and a.page<>b.page
      and len(a.keys)>0 and b.slips>1 and (b.titles>1 or b.vacant) and list_has_all(b.keys, a.keys)
    union all
    select distinct a.source_id, a.page, 'heading', b.page from p a join h x on x.page=a.page join h y on y.source_id=a.source_id and y.heading=x.heading join p b on b.page=y.page and b.titles>1
      where a.bank is null or len(a.keys)=0""",
)
def _(t):
    tables = _reference_tables(t)
    found = segment.page_forms(*tables).join(segment.reference_pages(*tables), ["source_id", "basis", "bank", "keys"])
    return found.filter("basis = 'heading' or page <> reference_page").select("source_id", "page", "basis", "reference_page")


@query(
    "bank_names",
    "",
    """with n as (select o_orderkey, case o_orderkey%8 when 0 then '中国工商银行' when 1 then '工商银行' when 2 then 'ICBC 工商 银行' when 3 then '农商银行' when 4 then '江苏农商银行' when 5 then '网上银行' when 6 then '付款银行' else 'Acme Co' end as name from orders)
    select o_orderkey, case o_orderkey%8 when 0 then '中国工商银行' when 1 then '中国工商银行' when 2 then '中国工商银行' when 3 then '农商银行' when 4 then '江苏农商银行' end as bank,
      o_orderkey%8 in (3,4) as rural from n""",
)
def _(t):
    names = ["中国工商银行", "工商银行", "ICBC 工商 银行", "农商银行", "江苏农商银行", "网上银行", "付款银行", "Acme Co"]
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return t.orders.select(
        "o_orderkey", tx.canonical_bank(name).alias("bank"), tx.rural_unspecified(name, F.lit("农商银行")).alias("rural")
    )


@query(
    "confidence_band",
    "regions",
    "select source_id, page, region_no, case when confidence<0.7 or y1-y0<100 and page%2=0 then 'blocked' when confidence<0.9 then 'needs_review' else 'confirmed' end as status from regions",
)
def _(t):
    usable = ~((F.col("y1") - F.col("y0") < 100) & (F.col("page") % 2 == 0))
    return t.regions.select("source_id", "page", "region_no", classify.confidence_band(F.col("confidence"), usable).alias("status"))
