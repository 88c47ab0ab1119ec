"""Geometric queries: assignment, selection, containers, regions, rectangle algebra."""

from pyspark.sql import functions as F

from slipweave.catalog.registry import query
from slipweave.functions import geometry as g
from slipweave.functions.geometry import Rect
from slipweave.operators import assign

INCLUDES = ["include-0", "include-1"]
_ASSIGNED = """assigned as (
  select h.*, s.instance_id, s.occupancy, count(s.instance_id) over (partition by h.page, h.block_index) as touched,
    h.x0>=s.x0 and h.y0>=s.y0 and h.x1<=s.x1 and h.y1<=s.y1 as inside
  from box_hits h left join slots s on h.page=s.page and s.x0<h.x1 and s.x1>h.x0 and s.y0<h.y1 and s.y1>h.y0),
out as (select *, case when touched=0 then 'unassigned' when touched>1 then 'ambiguous' when inside then 'contained' else 'cross_boundary' end as outcome from assigned)"""


@query(
    "assign_matches",
    "box_hits slots",
    f"with {_ASSIGNED} select source_id, page, block_index, query_id, instance_id, cast(touched as bigint) as touched, outcome from out",
)
def _(t):
    return assign.assign_matches(t.box_hits, t.slots).select(
        "source_id", "page", "block_index", "query_id", "instance_id", "touched", "outcome"
    )


_SELECT = """select source_id, page, instance_id, 'keyword' as selection_basis,
  cast(count(distinct case when role='include' then (query_id, x0, y0, x1, y1) end) as bigint) as evidence,
  bool_or(outcome<>'contained' or confidence<0.9) or occupancy='uncertain' as needs_review
  from out where instance_id is not null group by source_id, page, instance_id, occupancy
  having {met} and not bool_or(role='exclude' and outcome='contained' and confidence>=0.9)"""


@query(
    "select_instances_all",
    "box_hits slots",
    f"with {_ASSIGNED} " + _SELECT.format(met="bool_or(query_id='include-0') and bool_or(query_id='include-1')"),
)
def _(t):
    return assign.select_instances(assign.assign_matches(t.box_hits, t.slots), INCLUDES)


@query(
    "select_instances_any",
    "box_hits slots",
    f"with {_ASSIGNED} " + _SELECT.format(met="bool_or(role='include')"),
)
def _(t):
    return assign.select_instances(assign.assign_matches(t.box_hits, t.slots), INCLUDES, "any")


@query(
    "selection_evidence",
    "box_hits slots",
    f"with {_ASSIGNED}, chosen as (" + _SELECT.format(met="bool_or(query_id='include-0') and bool_or(query_id='include-1')") + """)
    select source_id, page, instance_id, query_id, x0, y0, x1, y1, max(confidence) as confidence, bool_and(outcome='contained') as certain
    from out join chosen using (source_id, page, instance_id) where role='include' group by 1, 2, 3, 4, 5, 6, 7, 8""",
)
def _(t):
    assigned = assign.assign_matches(t.box_hits, t.slots)
    return assign.selection_evidence(assigned, assign.select_instances(assigned, INCLUDES))


@query(
    "split_all",
    "slots",
    "select source_id, page, instance_id, 'occupied_slot' as selection_basis, cast(0 as bigint) as evidence, occupancy='uncertain' as needs_review from slots",
)
def _(t):
    return assign.split_all(t.slots)


@query(
    "selection_diagnostics",
    "box_hits slots",
    f"""with {_ASSIGNED} select distinct source_id, page, block_index, query_id, cast(touched as bigint) as touched, code from (
      select *, case outcome when 'unassigned' then 'unassigned_block' when 'ambiguous' then 'ambiguous_block' when 'cross_boundary' then 'cross_boundary_block' end as code from out
      union all select *, 'low_confidence_exclude' from out where role='exclude' and confidence<0.9 and touched>0) where code is not null""",
)
def _(t):
    return assign.selection_diagnostics(assign.assign_matches(t.box_hits, t.slots))


_LOCATED = """located as (select * from (
  select h.*, r.region_no, r.confidence as rc, row_number() over (partition by h.page, h.block_index
    order by (r.x1-r.x0)*(r.y1-r.y0), r.confidence desc, r.region_no) as rn
  from box_hits h left join regions r on h.page=r.page and r.x0<=h.x0 and r.y0<=h.y0 and r.x1>=h.x1 and r.y1>=h.y1) where rn=1)"""


@query(
    "smallest_container",
    "box_hits regions",
    f"with {_LOCATED} select source_id, page, block_index, query_id, region_no, rc as region_confidence from located",
)
def _(t):
    return assign.smallest_container(t.box_hits, t.regions).select(
        "source_id", "page", "block_index", "query_id", "region_no", "region_confidence"
    )


def _policies(t):
    return t.orders.select(
        (F.col("o_orderkey") % 100).alias("source_id"), F.col("o_orderkey").alias("page"),
        F.when(F.col("o_orderkey") % 3 == 0, "unknown").when(F.col("o_orderkey") % 3 == 1, "single").otherwise("multiple").alias("policy"),
    )


_CHOSEN = _LOCATED + """,
chosen as (select l.*, coalesce(case when n.n=1 and l.page%3=0 then least(coalesce(rc,0), 0.89::double) else rc end, 0) as sc,
  coalesce(n.n=1, false) and l.page%3<>2 and bool_and(l.region_no is not null) over (partition by l.page) as full_page
  from located l left join (select page, count(*) as n from regions group by 1) n on l.page=n.page)"""


@query(
    "select_regions",
    "box_hits regions",
    f"""with {_CHOSEN} select source_id, page, block_index, region_no, sc as selection_confidence, full_page as page_fully_matched,
      region_no is null or sc<0.9 as needs_review from chosen""",
)
def _(t):
    located = assign.smallest_container(t.box_hits, t.regions)
    return assign.select_regions(located, t.regions, _policies(t)).select(
        "source_id", "page", "block_index", "region_no", "selection_confidence", "page_fully_matched", "needs_review"
    )


@query(
    "assemble_matches",
    "box_hits regions",
    f"""with {_CHOSEN}, kept as (select source_id, page, region_no, min(block_index) filter (where role='include') as representative,
      cast(count(*) as bigint) as hits, min(least(confidence, sc)) filter (where role='include') as confidence
      from chosen where region_no is not null group by 1,2,3
      having bool_or(role='include') and not bool_or(role='exclude'))
    select source_id, page, region_no, cast(row_number() over (partition by page order by region_no) as bigint) as segment_no,
      representative, hits, confidence,
      case when confidence<0.7 then 'blocked' when confidence<0.9 then 'needs_review' else 'confirmed' end as review_status from kept""",
)
def _(t):
    chosen = assign.select_regions(assign.smallest_container(t.box_hits, t.regions), t.regions, _policies(t))
    return assign.assemble_matches(chosen, t.regions, INCLUDES, "any")


@query(
    "assemble_single_keyword",
    "box_hits regions",
    f"""with {_CHOSEN} select source_id, page, region_no, cast(row_number() over (partition by page order by block_index) as bigint) as segment_no,
      block_index as representative, cast(1 as bigint) as hits, sc as confidence,
      case when sc<0.7 or region_no is null then 'blocked' when sc<0.9 then 'needs_review' else 'confirmed' end as review_status from chosen""",
)
def _(t):
    chosen = assign.select_regions(assign.smallest_container(t.box_hits, t.regions), t.regions, _policies(t))
    return assign.assemble_matches(chosen, t.regions, INCLUDES, single=True)


_NEXT = """pairs as (select *, lead(x0) over w as bx0, lead(y0) over w as by0, lead(x1) over w as bx1, lead(y1) over w as by1
  from boxes window w as (partition by page order by block_index))"""


@query(
    "rectangle_algebra",
    "boxes",
    f"""with {_NEXT}, o as (select *, greatest(0, least(x1,bx1)-greatest(x0,bx0))*greatest(0, least(y1,by1)-greatest(y0,by0)) as both_area,
       (x1-x0)*(y1-y0) as a, (bx1-bx0)*(by1-by0) as b from pairs where bx0 is not null)
    select source_id, page, block_index, a as area, both_area as shared, both_area/(a+b-both_area) as iou,
      x0<bx1 and x1>bx0 and y0<by1 and y1>by0 as meets, bx0>=x0 and by0>=y0 and bx1<=x1 and by1<=y1 as holds,
      both_area>0 as material, y0=by0 as level, least(x0,bx0) as ux0, greatest(y1,by1) as uy1 from o""",
)
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("source_id", "page").orderBy("block_index")
    df = t.boxes.withColumns({"b" + c: F.lead(c).over(w) for c in ("x0", "y0", "x1", "y1")}).filter("bx0 is not null")
    a, b = Rect(), Rect("b")
    u = g.union(a, b)
    return df.select(
        "source_id", "page", "block_index", g.area(a).alias("area"), g.intersection_area(a, b).alias("shared"),
        g.iou(a, b).alias("iou"), g.intersects(a, b).alias("meets"), g.contains(a, b).alias("holds"),
        g.material_overlap(a, b).alias("material"), g.near(a.y0, b.y0).alias("level"), u[0].alias("ux0"), u[3].alias("uy1"),
    )


@query(
    "near",
    "",
    """select l_orderkey, l_partkey, l_suppkey, l_extendedprice, abs(l_extendedprice*1.1::double - l_extendedprice - l_extendedprice*0.1::double)
       <= 64*2.220446049250313e-16::double*greatest(1, l_extendedprice*1.1::double) as same,
       l_discount=0 as zero from lineitem""",
)
def _(t):
    p = F.col("l_extendedprice")
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice",
        g.near(p * 1.1, p + p * 0.1).alias("same"), g.near(F.col("l_discount"), F.lit(0.0)).alias("zero"),
    )


@query(
    "clamp_rect",
    "boxes",
    """with m as (select source_id, page, block_index, least(greatest(x1-60,0),90) as lo, least(greatest(x0-60,0),90) as hi, y0, y1 from boxes),
    o as (select *, least(lo,hi) as a, greatest(lo,hi) as b, least(y0,70) as c, least(y1,70) as d from m),
    h as (select *, case when b-a<24 then least(90, a+24) else b end as b2, case when d-c<24 then least(70, c+24) else d end as d2 from o)
    select source_id, page, block_index, cast(case when b-a<24 then greatest(0, b2-24) else a end as double) as x0, cast(case when d-c<24 then greatest(0, d2-24) else c end as double) as y0,
      cast(b2 as double) as x1, cast(d2 as double) as y1 from h""",
)
def _(t):
    r = Rect(x0=F.col("x1") - 60, y0=F.col("y0"), x1=F.col("x0") - 60, y1=F.col("y1"))
    return t.boxes.select("source_id", "page", "block_index", *g.clamp(r, F.lit(90.0), F.lit(70.0)))


@query(
    "rotate_and_visible",
    "boxes",
    """with r as (select *, (page%4)*90 as rot, x0-5 as a, y0-3 as b, x1-5 as c, y1-3 as d from boxes)
    select source_id, page, block_index,
      2*case rot when 90 then 150-d when 180 then 280-c when 270 then b else a end as x0,
      2*case rot when 90 then a when 180 then 150-d when 270 then 280-c else b end as y0,
      2*case rot when 90 then 150-b when 180 then 280-a when 270 then d else c end as x1,
      2*case rot when 90 then c when 180 then 150-b when 270 then 280-a else d end as y1,
      true as round_trip from r""",
)
def _(t):
    box = (F.lit(5.0), F.lit(3.0), F.lit(280.0), F.lit(150.0), ((F.col("page") % 4) * 90).cast("int"), F.lit(2.0))
    seen = t.boxes.withColumns({"v" + c.lower(): col for c, col in zip(("x0", "y0", "x1", "y1"), g.to_visible(Rect(), *box))})
    back = g.from_visible(Rect("v"), *box)
    same = F.lit(True)
    for c, b in zip(("x0", "y0", "x1", "y1"), back):
        same = same & g.near(F.col(c), b)
    return seen.select(
        "source_id", "page", "block_index", *[F.col("v" + c).alias(c) for c in ("x0", "y0", "x1", "y1")], same.alias("round_trip")
    )


@query(
    "slot_rect_and_instance_id",
    "slots",
    """select concat('receipt-v1:', sha256(cast(source_id as varchar)), ':', page, ':layout-a:', 3, ':slot-', position_index) as instance_id,
      cast(12 as double) as x0, y0, x1-8 as x1, y1, y0*25.4::double/72 as top_mm from slots""",
)
def _(t):
    from slipweave.functions import identity

    rect = g.slot_rect(F.lit(12.0), F.lit(8.0), F.col("x1"), F.col("y0"), F.col("y1") - F.col("y0"))
    ident = identity.instance_id(
        F.sha2(F.col("source_id").cast("string"), 256), F.col("page"), F.lit("layout-a"), F.lit(3),
        F.concat(F.lit("slot-"), F.col("position_index").cast("string")),
    )
    return t.slots.select(ident.alias("instance_id"), *rect, g.pt_to_mm(F.col("y0")).alias("top_mm"))
