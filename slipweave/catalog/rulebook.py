"""Template and field-rule queries, and the streaming twins."""

from pyspark.sql import functions as F

from slipweave.catalog.registry import query
from slipweave.operators import preview, rules

def _k():
    return F.col("o_orderkey")


def _s(prefix, n):
    return F.concat(F.lit(prefix), n.cast("string"))


# Every fifth template takes the key of its neighbour, so that some keys have two.
_TEMPLATES = "t as (select c_custkey as template_id, case when c_custkey%5=0 then c_custkey+1 else c_custkey end as k from customer where c_custkey%4>0), n as (select k, count(*) as n, min(template_id) as t from t group by 1)"
_MATCHED = f"with {_TEMPLATES} select o_orderkey as page, case when n=1 then t end as template_id, case when n=1 then 'matched' when n>1 then 'multiple' else 'none' end as reason from orders left join n on k=o_custkey"


def _templates(t):
    c, page = F.col("c_custkey"), F.col("o_custkey")
    key = F.when(c % 5 == 0, c + 1).otherwise(c)

    def shape(k):
        return [_s("sc", k % 3).alias("scope"), _s("f", k).alias("fingerprint"), _s("g", k % 2).alias("geometry"), _s("s", k).alias("slot_shape")]

    templates = t.customer.select(c.alias("template_id"), *shape(key), (c % 4 > 0).alias("active"))
    return t.orders.select(_k().alias("page"), *shape(page)), templates


@query("match_template_exact", "", _MATCHED)
def _(t):
    return rules.match_template(*_templates(t))


@query("match_template_reference", "", _MATCHED)
def _(t):
    pages, templates = _templates(t)
    # A reference template knows the shape of its slots alone.
    return rules.match_template(pages.withColumn("fingerprint", F.lit("other")), templates, exact=False)


@query(
    "layout_compatibility", "",
    """select o_orderkey as target_id, case when o_orderkey%11=0 then 'workspace' when o_orderkey%7=0 then 'page_geometry' when o_orderkey%5=0 or o_custkey%3=2 then 'issuer' when o_orderkey%4=0 then 'family' when o_orderkey%9=0 then 'slot_structure' end as reason
    from orders""",
)
def _(t):
    target = t.orders.select(
        _k().alias("target_id"), (F.col("o_custkey") % 3).alias("sample_id"), F.when(_k() % 11 == 0, "x").otherwise("w").alias("workspace"), F.when(_k() % 7 == 0, "x").otherwise("g").alias("page_geometry"),
        F.when(_k() % 5 == 0, "x").when(F.col("o_custkey") % 3 == 2, None).otherwise("bank").alias("issuer"), F.when(_k() % 4 == 0, "x").otherwise("f").alias("family"), F.when(_k() % 9 == 0, "x").otherwise("s").alias("slot_structure"),
    )
    sample = t.region.select(F.col("r_regionkey").cast("long").alias("sample_id"), *[F.lit(v).alias(c) for c, v in zip(rules.COMPATIBILITY, ("w", "g", "bank", "f", "s"))])
    return rules.layout_compatibility(sample, target).select("target_id", "reason")


@query(
    "apply_reference_series", "loose_slots",
    """with r as (select concat('sh', c_custkey%40) as shape, c_custkey%3 as margins, case when c_custkey%40<30 then 'a' else concat('x', c_custkey%7) end as series, c_custkey as version, 1+c_custkey%2 as position_index, cast(c_custkey as double) as top, cast(40 as double) as height from customer),
    ok as (select shape, margins from r group by 1, 2 having count(distinct series)=1), n as (select shape, margins, position_index, max(version) as v from r join ok using (shape, margins) group by 1, 2, 3)
    select l.page as layout_id, l.position_index, coalesce(v::double, l.top) as top, case when v is not null then 40::double else l.height end as height, v is not null as from_reference from loose_slots l left join n on n.shape=concat('sh', l.page%40) and n.margins=l.page%3 and n.position_index=l.position_index""",
)
def _(t):
    c, p = F.col("c_custkey"), F.col("page")
    refs = t.customer.select(
        _s("sh", c % 40).alias("shape"), (c % 3).alias("margins"), F.when(c % 40 < 30, "a").otherwise(_s("x", c % 7)).alias("series"), c.alias("version"), (1 + c % 2).alias("position_index"), c.cast("double").alias("top"), F.lit(40.0).alias("height")
    )
    layouts = t.loose_slots.select(p.alias("layout_id"), _s("sh", p % 40).alias("shape"), (p % 3).alias("margins"), "position_index", "top", "height")
    return rules.apply_reference_series(layouts, refs)


def _versions(t):
    return t.orders.select(F.col("o_custkey").alias("series"), _k().alias("version"), _k().alias("template_id"), (F.col("o_orderstatus") != "P").alias("active"), (_k() % 500).alias("operation_id"), F.when(_k() % 3 == 0, F.array(_k() % 7, _k() % 11)).alias("sources"))


@query(
    "current_templates", "",
    "with n as (select o_custkey as series, max(o_orderkey) as version from orders group by 1) select series, version from n join orders on o_orderkey=version where o_orderstatus<>'P' and version not in (select event_id from events where event_id%3=0)",
)
def _(t):
    gone = t.orders.join(t.events.filter("event_id % 3 = 0").select(F.col("event_id").alias("o_orderkey")), "o_orderkey").select(F.col("o_custkey").alias("series"), _k().alias("version"))
    return rules.current_templates(_versions(t), gone).select("series", "version")


@query(
    "withdraw_templates", "",
    "select o_orderkey as template_id, o_orderstatus<>'P' and not (o_orderkey%500%50=3 or (o_orderkey%3=0 and (o_orderkey%7 in (3) or o_orderkey%11 in (3)))) as active from orders",
)
def _(t):
    undone = t.events.filter("event_id % 50 = 3").select(F.col("event_id").alias("operation_id"))
    return rules.withdraw_templates(_versions(t), undone).select("template_id", "active")


def _fingerprints(t):
    x, y = 10.0 + _k() % 5, 20.0 + _k() % 7
    kind = _k() % 4
    base = t.orders.select(_k().alias("segment_id"), x.cast("double").alias("title_x"), y.cast("double").alias("title_y"), kind.alias("kind_no"))
    n = F.explode(F.sequence(F.lit(1), F.lit(2)))
    lines = base.filter("kind_no < 2").withColumn("n", n).withColumns({"x0": F.col("title_x") + 5, "x1": F.col("title_x") + 205, "y0": F.col("title_y") + 10 * F.col("n") + F.col("kind_no"), "y1": F.col("title_y") + 10 * F.col("n")})
    labels = base.filter("kind_no <> 3").withColumn("n", n).withColumns({"kind": F.concat(F.lit("k"), F.col("n").cast("string")), "x0": F.col("title_x"), "y0": F.col("title_y") + F.col("n")})
    return lines, labels


@query("template_fingerprint", "", "select o_orderkey%4 as kind_no, cast(count(*) as bigint) as slips, cast(case when o_orderkey%4<2 then 1 else 0 end as bigint) as prints from orders where o_orderkey%4<3 group by 1, 3")
def _(t):
    # Slips of one kind differ only in where the title stands, so they share one fingerprint.
    f = rules.template_fingerprint(*_fingerprints(t))
    return f.groupBy((F.col("segment_id") % 4).alias("kind_no")).agg(F.count(F.lit(1)).alias("slips"), F.count_distinct("fingerprint").alias("prints"))


_EDIT = "with e as (select o_orderkey as page, 1+o_orderkey%3 as position_index, case when o_orderkey%5=0 then 3.0::double+50*(o_orderkey%3) end as t, case when o_orderkey%7=0 then 46.0::double when o_orderkey%11=0 then 60.0::double end as h from orders where o_orderkey%2=0),"


def _slot_edits(t):
    e = t.orders.filter(_k() % 2 == 0).select(
        (_k() % 100).alias("source_id"), _k().alias("page"), (1 + _k() % 3).alias("position_index"), F.when(_k() % 5 == 0, 3.0 + 50 * (_k() % 3)).alias("top"), F.when(_k() % 7 == 0, 46.0).when(_k() % 11 == 0, 60.0).alias("height")
    )
    return t.slots.select("source_id", "page", "position_index", F.col("y0").alias("top"), F.lit(50.0).alias("height"), F.lit(160.0).alias("page_height")), e


@query(
    "adjust_slots", "slots",
    _EDIT + """n as (select s.source_id, s.page, s.position_index, coalesce(t, y0) as nt, coalesce(h, 50) as nh from slots s left join e on e.page=s.page and e.position_index=s.position_index),
    b as (select *, nh<12 or nt<0 or nt+nh>160 or coalesce(nt+nh>lead(nt) over (partition by page order by position_index), false) as bad from n)
    select source_id, page, position_index, nt as top, nh as height, not bool_or(bad) over (partition by page) as valid from b""",
)
def _(t):
    return rules.adjust_slots(*_slot_edits(t))


@query(
    "affected_slots", "slots",
    _EDIT + "x as (select 1) select s.source_id, s.page, s.position_index from slots s left join e on e.page=s.page and e.position_index=s.position_index where coalesce(t, y0)<>y0 or coalesce(h, 50)<>50 or s.page%25=0",
)
def _(t):
    slots, edits = _slot_edits(t)
    after = rules.adjust_slots(slots, edits).filter("not (page % 25 = 0 and position_index = 3)")
    return rules.affected_slots(slots, after)


@query(
    "preview_layout_change", "slots",
    _EDIT + """a as (select s.*, coalesce(t, y0) as ny, coalesce(t, y0)+coalesce(h, 50) as ny1, s.page%25=0 and s.position_index=3 as gone from slots s left join e on e.page=s.page and e.position_index=s.position_index)
    select source_id, page, position_index, case when gone then 'removed' when page%13=0 then 'retained_manual' when ny=y0 and ny1=y1 then 'unchanged' else 'changed' end as change,
    case when page%13=0 and not gone and not (ny<=y0+1 and ny1>=y1-1) then 'manual_crop_outside' end as blocker,
    case when not gone and occupancy='uncertain' then 'uncertain_content' when page%17=0 and (gone or page%13=0 or ny<>y0 or ny1<>y1) then 'exclusion_reset' end as risk from a""",
)
def _(t):
    slots, edits = _slot_edits(t)
    moved = rules.adjust_slots(slots, edits).filter("not (page % 25 = 0 and position_index = 3)").select("source_id", "page", "position_index", "top", "height")
    after = moved.join(t.slots.select("source_id", "page", "position_index", "x0", "x1", "occupancy"), ["source_id", "page", "position_index"]).withColumns({"y0": F.col("top"), "y1": F.col("top") + F.col("height")})
    reviews = t.slots.withColumns(
        {"y0": F.col("y0") + 1, "y1": F.col("y1") - 1, "manual_adjusted": F.col("page") % 13 == 0, "review_status": F.when(F.col("page") % 17 == 0, "excluded").otherwise("confirmed")}
    )
    return rules.preview_layout_change(t.slots, after, reviews)


def _rerun(n, slots):
    """Occupancy, assignment and selection of one layout in SQL, as tables ``i{n}``, ``o{n}`` and ``r{n}``."""
    meets = lambda b: f"{b}.page=s.page and s.x0<{b}.x1 and s.x1>{b}.x0 and s.y0<{b}.y1 and s.y1>{b}.y0"
    inside = lambda b: f"{b}.x0>=s.x0 and {b}.y0>=s.y0 and {b}.x1<=s.x1 and {b}.y1<=s.y1"
    return f"""
    t{n} as (select page, position_index, count(*) as blocks, count(*) filter (where mark) as markers, count(*) filter (where mark and fits) as im, count(*) filter (where not mark and fits) as complete
      from (select s.page, s.position_index, b.text='此处空白无效！' as mark, {inside('b')} as fits from {slots} s join blocks b on not b.is_watermark and {meets('b')}) group by 1, 2),
    v{n} as (select s.page, s.position_index, count(*) as objects from {slots} s join boxes b on b.tag='R' and {meets('b')} group by 1, 2),
    i{n} as (select s.source_id, s.page, s.position_index, s.instance_id, s.x0, s.y0, s.x1, s.y1, case when complete>0 then 'occupied' else 'uncertain' end as occupancy,
      coalesce(im, 0)>0 and (blocks>markers or objects is not null) as suspected
      from {slots} s left join t{n} using (page, position_index) left join v{n} using (page, position_index) where objects is not null or coalesce(blocks, 0)<>coalesce(markers, 0)),
    g{n} as (select h.*, s.instance_id, s.occupancy, count(s.instance_id) over (partition by h.page, h.block_index) as touched, {inside('h')} as fits from box_hits h left join i{n} s on {meets('h')}),
    o{n} as (select *, case when touched=0 then 'unassigned' when touched>1 then 'ambiguous' when fits then 'contained' else 'cross_boundary' end as outcome from g{n}),
    r{n} as (select i.* exclude (suspected), needs_review from i{n} i join (select page, instance_id, bool_or(outcome<>'contained' or confidence<0.9) or any_value(occupancy)='uncertain' as needs_review
      from o{n} where instance_id is not null group by 1, 2 having bool_or(role='include') and not bool_or(role='exclude' and outcome='contained' and confidence>=0.9)) using (page, instance_id))"""


_NEW = """with after as (select source_id, page, position_index, x0, y0 + case when page%4=0 and position_index=2 then 6 else 0 end as y0, x1, y1 + case when page%4=0 and position_index=2 then 6 else 0 end as y1,
      concat(instance_id, case when page%16=0 then '-n' else '' end) as instance_id from slots where not (page%8=0 and position_index=3)),"""
_BOTH = _NEW + _rerun(0, "slots") + "," + _rerun(1, "after") + """,
    m as (select source_id, page, position_index, x0, y0+case when page%6=0 then 10 else 1 end as y0, x1, y1-1 as y1, case when page%5=0 and position_index>2 or page%25=0 then 'excluded' else 'confirmed' end as review_status,
      page%3=0 as manual_adjusted, page%21=0 as full_page, case when page%24=0 then 'loan' end as document_type, page%9=0 as accept from slots),
    q as (select s.source_id, s.page, s.position_index, b.instance_id as b_id, a.instance_id as a_id, b.page is not null as was, a.page is not null as now, a.x0 as ax0, a.y0 as ay0, a.x1 as ax1, a.y1 as ay1,
      b.x0 as bx0, b.y0 as by0, b.x1 as bx1, b.y1 as by1, n.page is null or n.y0<>s.y0 as moved, (a.page is null)<>(b.page is null) or (a.instance_id, a.y0, a.occupancy, a.needs_review) is distinct from (b.instance_id, b.y0, b.occupancy, b.needs_review) as differs,
      m.x0 as mx0, m.y0 as my0, m.x1 as mx1, m.y1 as my1, review_status='excluded' as gone, full_page, document_type, b.page is not null and (n.page is null or n.y0<>s.y0) and review_status<>'excluded' and (manual_adjusted or full_page) and not accept as manual
      from slots s left join after n using (page, position_index) left join r0 b using (page, position_index) left join r1 a using (page, position_index) join m using (page, position_index) where s.page%4=0)"""


def _preview(t):
    page, at = F.col("page"), F.col("position_index")
    low = F.when((page % 4 == 0) & (at == 2), 6).otherwise(0)
    after = t.slots.filter(~((page % 8 == 0) & (at == 3))).withColumns(
        {"y0": F.col("y0") + low, "y1": F.col("y1") + low, "instance_id": F.concat("instance_id", F.when(page % 16 == 0, "-n").otherwise(""))})
    reviews = t.slots.withColumns({
        "y0": F.col("y0") + F.when(page % 6 == 0, 10).otherwise(1), "y1": F.col("y1") - 1, "review_status": F.when((page % 5 == 0) & (at > 2) | (page % 25 == 0), "excluded").otherwise("confirmed"),
        "manual_adjusted": page % 3 == 0, "full_page": page % 21 == 0, "document_type": F.when(page % 24 == 0, "loan"), "accept": page % 9 == 0})
    objects, includes = t.boxes.filter("tag = 'R'").withColumn("kind", F.lit("stroke-path")), ["include-0", "include-1"]
    previous = preview.results(t.slots, t.blocks, objects, t.box_hits, includes, "any")
    return preview.preview(t.slots, after, previous, t.blocks, objects, t.box_hits, reviews, includes, "any")


@query("preview_rerun_result", "slots blocks boxes box_hits", _NEW + _rerun(1, "after") + " select * from r1")
def _(t):
    return _preview(t).result


@query(
    "preview_rerun_slots", "slots blocks boxes box_hits",
    _BOTH + """ select source_id, page, position_index, case when manual then 'retained_manual' when not was then 'added' when not now then 'removed' else 'updated' end as change, b_id as previous_id, a_id as instance_id,
      case when manual then mx0 else ax0 end as x0, case when manual then my0 else ay0 end as y0, case when manual then mx1 else ax1 end as x1, case when manual then my1 else ay1 end as y1
      from q where (was or now) and (moved or was<>now)""",
)
def _(t):
    return _preview(t).slots


@query(
    "preview_rerun_issues", "slots blocks boxes box_hits",
    _BOTH + """, hits as (select distinct source_id, page, block_index, unnest([case outcome when 'unassigned' then 'unassigned_block' when 'ambiguous' then 'ambiguous_block' when 'cross_boundary' then 'cross_boundary_block' end,
        case when role='exclude' and confidence<0.9 and touched>0 then 'low_confidence_exclude' end]) as code from o1 where page%4=0)
    select source_id, page, cast(null as bigint) as position_index, block_index, code, true as blocking from hits where code is not null
    union all select source_id, page, position_index, null, 'manual_exception_conflict', true from q where manual and (not now or full_page or not (mx0>=ax0 and my0>=ay0 and mx1<=ax1 and my1<=ay1))
    union all select source_id, page, position_index, null, 'manual_classification_membership', true from q where document_type is not null and not now
    union all select source_id, page, position_index, null, 'uncertain_content', false from i1 where page%4=0 and occupancy='uncertain'
    union all select source_id, page, position_index, null, 'suspected_invalid', false from i1 where page%4=0 and suspected
    union all select source_id, page, position_index, null, 'excluded_decision_reset', false from q where gone and now and differs
    union all select distinct x.source_id, x.page, x.position_index, null, 'excluded_decision_reset', false from q x join q e on e.page=x.page and e.gone and e.was
      and x.ax0<e.bx1 and x.ax1>e.bx0 and x.ay0<e.by1 and x.ay1>e.by0 where x.now and not x.gone and x.differs""",
)
def _(t):
    return _preview(t).issues


def _rule_tables(t):
    """A rule for every customer; slips of the orders print their customer's layout, moved a little or too far."""
    def spec(key):
        return {
            "x": 0.1 + 0.03 * (key % 17), "y": 0.1 + 0.05 * (F.floor(key / 17) % 11), "third": key % 6 < 3,
            "bank": F.concat(F.lit("Bank "), (key % 7).cast("string")), "aspect": 1.5 + 0.1 * (key % 10)}

    def labels(s, shift):
        box = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("rx0"), y.alias("ry0"), (x + 0.1).alias("rx1"), (y + 0.05).alias("ry1"))
        third = F.when(s["third"], box("account", F.lit(0.1), F.lit(0.5)))
        return F.inline(F.array_compact(F.array(box("name", s["x"], s["y"] + shift), box("bank", s["x"] + 0.2, s["y"] + shift), third)))

    c, k = F.col("c_custkey"), _k()
    drawn = spec(F.when(c % 25 == 0, c + 1).otherwise(c))
    rule = t.customer.select(c.alias("rule_id"), drawn["bank"].alias("bank_name"), drawn["aspect"].alias("aspect"), F.lit(False).alias("batch_only"), (c % 9 != 4).alias("active"))
    rule_labels = t.customer.select(c.alias("rule_id"), labels(drawn, F.lit(0.0)))
    printed, shift = spec(F.col("o_custkey")), F.when(k % 10 == 0, 0.02).otherwise(0.01)
    slips = t.orders.select(
        k.alias("segment_id"), F.when(k % 7 == 0, "Bank X").otherwise(printed["bank"]).alias("bank"), (printed["aspect"] * F.when(k % 11 == 0, 1.05).otherwise(1.01)).alias("aspect"), (k % 13 != 0).alias("reliable"),
        F.concat_ws("-", F.col("o_custkey").cast("string"), (k % 10 == 0).cast("string")).alias("signature"),
    )
    return slips, t.orders.select(k.alias("segment_id"), labels(printed, shift)), rule, rule_labels


# Every rule against every slip.
_LAYOUT = "0.1::double+0.03::double*({k}%17) as x, 0.1::double+0.05::double*(({k}//17)%11) as y, {k}%6<3 as third, {k}%7 as bank, 1.5::double+0.1::double*({k}%10) as aspect"
_RULES = f"""rl as (select rid, active, {_LAYOUT.format(k="k")} from (select c_custkey as rid, case when c_custkey%25=0 then c_custkey+1 else c_custkey end as k, c_custkey%9<>4 as active from customer)),
sl as (select o_orderkey, o_custkey, case when o_orderkey%7=0 then -1 else o_custkey%7 end as shown_bank, case when o_orderkey%10=0 then 0.02::double else 0.01::double end as shift, {_LAYOUT.format(k="o_custkey")} from orders),
fit as (select o_orderkey, o_custkey, rid, active, rl.bank=shown_bank and abs(sl.aspect*case when o_orderkey%11=0 then 1.05::double else 1.01::double end/rl.aspect-1)<=0.015::double as same
  from rl, sl where rl.third=sl.third and abs(rl.x-sl.x)<=0.012::double and abs(sl.y+shift-rl.y)<=0.012::double)"""


@query(
    "match_rules", "",
    f"""with {_RULES}, n as (select o_orderkey, count(*) as n, min(rid) as rid from fit where active and same group by 1)
    select o.o_orderkey as segment_id, case when o.o_orderkey%13<>0 and n=1 then rid end as rule_id, case when o.o_orderkey%13=0 then 'labels_unavailable' when n=1 then 'matched' when n>1 then 'multiple_rules' else 'no_rule' end as reason
    from orders o left join n using (o_orderkey)""",
)
def _(t):
    return rules.match_rules(*_rule_tables(t))


@query("match_layout_one_to_one", "", f"with {_RULES} select rid as a_id, o_orderkey as b_id from fit where rid in (o_custkey, o_custkey-1, o_custkey+1)")
def _(t):
    """Each slip against the rules of its customer and of the neighbours."""
    _, b, _, a = _rule_tables(t)
    near = F.explode(F.array(*[F.col("o_custkey") + i for i in (-1, 0, 1)]))
    pairs = t.orders.select(near.alias("a_id"), _k().alias("b_id"))
    return rules.match_layout_one_to_one(pairs, a.withColumnRenamed("rule_id", "a_id"), b.withColumnRenamed("segment_id", "b_id"))


@query(
    "compile_rule", "",
    "select o_orderkey as rule_id, f as field, case when f='name' then 'payer.name' when o_orderkey%3=0 then 'account' end as anchor_kind, o_orderkey%3<>0 as batch_only from orders cross join (values ('name'),('account')) v(f)",
)
def _(t):
    box = lambda x0, y0, x1, y1: [F.lit(v).alias(c) for c, v in zip(rules.REL, (x0, y0, x1, y1))]
    fields = t.orders.select(_k().alias("rule_id"), F.inline(F.array(
        F.struct(F.lit("payer").alias("role"), F.lit("name").alias("field"), *box(0.3, 0.1, 0.6, 0.15)), F.struct(F.lit("payer").alias("role"), F.lit("account").alias("field"), *box(0.3, 0.3, 0.6, 0.35)))))
    # The account label stands left on the row (one in three slips), twice, or too far off.
    acc = F.when(_k() % 3 == 0, F.array(F.struct(F.lit("account").alias("kind"), *box(0.1, 0.3, 0.2, 0.35)))).when(
        _k() % 3 == 1, F.array(F.struct(F.lit("account").alias("kind"), *box(0.1, 0.3, 0.2, 0.35)), F.struct(F.lit("payer.account").alias("kind"), *box(0.1, 0.301, 0.2, 0.351)))
    ).otherwise(F.array(F.struct(F.lit("account").alias("kind"), *box(0.1, 0.6, 0.2, 0.65))))
    name = F.array(F.struct(F.lit("payer.name").alias("kind"), *box(0.1, 0.1, 0.2, 0.15)), F.struct(F.lit("payee.name").alias("kind"), *box(0.15, 0.1, 0.25, 0.15)))
    labels = t.orders.select(_k().alias("rule_id"), F.inline(F.concat(name, acc)))
    return rules.compile_rule(fields, labels).select("rule_id", "field", "anchor_kind", "batch_only")


@query(
    "read_rule", "slips",
    """select segment_id, 'name' as field, case when segment_id%5=0 then substr(cp_name, 1, 8) else cp_name end as value, case when segment_id%5=0 and length(cp_name)>8 then 'ambiguous' when segment_id%7=0 and segment_id%5<>0 then 'ambiguous' else 'present' end as state from slips""",
)
def _(t):
    # One glyph every 6pt behind the label; a short region cuts the name off in one slip of five.
    s = t.slips
    glyph = s.select("segment_id", F.posexplode(F.split("cp_name", "")).alias("glyph_no", "c")).filter("c <> ''")
    x = 100 + 6 * F.col("glyph_no")
    glyph = glyph.select("segment_id", F.lit(1).alias("line_no"), "glyph_no", "c", x.cast("double").alias("x0"), F.lit(20.0).alias("y0"), (x + 6).cast("double").alias("x1"), F.lit(30.0).alias("y1"))
    regions = s.select("segment_id", F.lit("payee").alias("role"), F.lit("name").alias("field"), F.lit(98.0).alias("x0"), F.lit(18.0).alias("y0"), F.when(F.col("segment_id") % 5 == 0, 148.0).otherwise(400.0).alias("x1"), F.lit(32.0).alias("y1"))
    labels = s.select(
        "segment_id", F.when(F.col("segment_id") % 7 == 0, "payer.bank").otherwise("payee.name").alias("kind"),
        F.when(F.col("segment_id") % 7 == 0, 390.0).otherwise(40.0).alias("x0"), F.lit(20.0).alias("y0"), F.when(F.col("segment_id") % 7 == 0, 420.0).otherwise(90.0).alias("x1"), F.lit(30.0).alias("y1"),
    ).filter("segment_id % 35 <> 0")
    return rules.read_rule(glyph, regions, labels).select("segment_id", "field", "value", "state")


@query(
    "resolve_auto_roles", "slips",
    """with b as (select segment_id, slot, case when slot='a' then own_account else cp_account end as account, case when slot='a' then own_name else cp_name end as name, segment_id%3=0 as sided, segment_id%10=0 and slot='b' as anchored, own_role from slips cross join (values ('a'),('b')) v(slot)),
    o as (select *, (account='0000000001' and name in ('','Own Co')) or (account='' and name='Own Co') as ours from b), c as (select *, count(*) filter (where ours) over (partition by segment_id) as n, count(*) filter (where account='0000000001') over (partition by segment_id) as na from o),
    r as (select *, case when na>1 then null when anchored then 'payee' when n=1 then case when ours then case when sided then own_role else 'own' end else case when sided then case own_role when 'payer' then 'payee' else 'payer' end else 'counterparty' end end end as role from c)
    select segment_id, slot, role, bool_and(role is not null) over (partition by segment_id) as resolved from r""",
)
def _(t):
    s = t.slips.select(
        "segment_id", F.when(F.col("segment_id") % 3 == 0, F.col("own_role")).alias("own_side"),
        F.inline(F.array(
            F.struct(F.lit("a").alias("slot"), F.lit(None).cast("string").alias("anchor_role"), F.col("own_name").alias("name"), F.col("own_account").alias("account")),
            F.struct(F.lit("b").alias("slot"), F.when(F.col("segment_id") % 10 == 0, "payee").alias("anchor_role"), F.col("cp_name").alias("name"), F.col("cp_account").alias("account")),
        )),
    )
    return rules.resolve_auto_roles(s, "0000000001", "Own Co")


@query(
    "merge_rule", "slips",
    """with r as (select segment_id, case when segment_id%4=0 then 'missing' when segment_id%4=1 then 'ambiguous' else 'present' end as ns, case when segment_id%4=2 then cp_name when segment_id%4=3 then 'Else' when segment_id%4=1 then '*' else '' end as nv, case when cp_state in ('present') then cp_name else '' end as v, cp_state as s from slips),
    a as (select *, case when s in ('present','blank') and ns in ('missing','ambiguous') then 'protect' when s<>'missing' and ns<>'missing' then case when s<>ns or v<>nv then 'conflict' else 'take' end when ns='missing' then 'keep' else 'take' end as act from r)
    select segment_id, case act when 'take' then nv when 'conflict' then concat(v, ' | ', nv) else v end as value, case act when 'take' then ns when 'conflict' then 'ambiguous' else s end as state, case act when 'protect' then 'rule_incompatible' when 'conflict' then 'conflicting_field' end as issue from a""",
)
def _(t):
    k = F.col("segment_id") % 4
    v = F.when(F.col("cp_state") == "present", F.col("cp_name")).otherwise("")
    nv = F.when(k == 2, F.col("cp_name")).when(k == 3, "Else").when(k == 1, "*").otherwise("")
    key = ["segment_id", F.lit("payee").alias("side"), F.lit("name").alias("field")]
    base = t.slips.select(*key, v.alias("raw"), v.alias("value"), F.col("cp_state").alias("state"))
    read = t.slips.select(*key, nv.alias("raw"), nv.alias("value"), F.when(k == 0, "missing").when(k == 1, "ambiguous").otherwise("present").alias("state"))
    return rules.merge_rule(base, read).select("segment_id", "value", "state", "issue")


_TRIAL = "t as (select segment_id, cp_name as name, case when cp_state='present' then 'named' else 'counterparty_pending' end as route, case when segment_id%6=0 then 'New' else cp_name end as an, case when segment_id%9=0 then null when segment_id%5=0 then 'counterparty_pending' when cp_state='present' or segment_id%6=0 then 'named' else 'counterparty_pending' end as ar, segment_id%8=0 as prot from slips), o as (select *, case when prot or ar is null then 'skipped' when ar='counterparty_pending' then 'pending' when name=an and route=ar then 'unchanged' else 'changed' end as outcome from t)"


def _trial(t):
    k = F.col("segment_id")
    ok = F.col("cp_state") == "present"
    before = t.slips.select("segment_id", F.col("cp_name").alias("name"), F.when(ok, "named").otherwise("counterparty_pending").alias("route"))
    after = t.slips.filter(k % 9 != 0).select("segment_id", F.when(k % 6 == 0, "New").otherwise(F.col("cp_name")).alias("name"), F.when(k % 5 == 0, "counterparty_pending").when(ok | (k % 6 == 0), "named").otherwise("counterparty_pending").alias("route"))
    return before, rules.trial_rule(before, after, t.slips.filter(k % 8 == 0).select("segment_id", F.lit("manual").alias("reason")))


@query("trial_rule", "slips", f"with {_TRIAL} select segment_id, outcome, case when prot then 'manual' when ar is null then 'rule_incompatible' end as skip_reason from o")
def _(t):
    return _trial(t)[1].select("segment_id", "outcome", "skip_reason")


@query("apply_rule", "slips", f"with {_TRIAL} select segment_id, case when outcome='changed' then an else name end as name, case when outcome='changed' then ar else route end as route, cast(case when outcome='changed' then 4 else 3 end as int) as revision from o")
def _(t):
    before, trial = _trial(t)
    return rules.apply_rule(before.withColumn("revision", F.lit(3)), trial)


@query(
    "merge_progress", "page_status",
    "select source_id, page, case when page%3=0 then 'succeeded' else status end as status, case when page%3=0 then 2 else 1 end as attempt from page_status",
)
def _(t):
    from slipweave.streaming.progress import merge_progress

    first = t.page_status.select("source_id", "page", F.lit(1).alias("attempt"), F.lit(1).alias("event_id"), "status")
    second = first.filter("page % 3 = 0").withColumns({"attempt": F.lit(2), "event_id": F.lit(2), "status": F.lit("succeeded")})
    return merge_progress(first, second.unionByName(first)).select("source_id", "page", "status", "attempt")
