"""Review queries over the append-only decision log."""

from pyspark.sql import functions as F

from slipweave.catalog.registry import query
from slipweave.operators import review

_LOG = "log as (select segment_id%700 as item_id, segment_id%50 as shared_key, record_revision%40 as revision, concat('s', segment_id%3) as signature, case when record_revision%9=0 then 'shared' else 'item' end as scope, review_status from review_log)"


def _log(t):
    s, r = F.col("segment_id"), F.col("record_revision")
    return t.review_log.select(
        (s % 700).alias("item_id"), (s % 50).alias("shared_key"), (r % 40).alias("revision"), F.concat(F.lit("s"), (s % 3).cast("string")).alias("signature"),
        F.when(r % 9 == 0, "shared").otherwise("item").alias("scope"), "review_status",
    )


@query(
    "carry_forward_reviews", "review_log",
    f"""with {_LOG}, o as (select c_custkey as item_id, c_custkey%50 as shared_key, c_custkey%40 as revision, concat('s', c_custkey%3) as signature from customer),
    own as (select o.item_id, max(struct_pack(r:=l.revision, s:=l.review_status)) as b from o join log l on l.scope='item' and l.item_id=o.item_id and l.signature=o.signature and l.revision<=o.revision group by 1),
    sh as (select shared_key, signature, max(struct_pack(r:=revision, s:=review_status)) as b from log where scope='shared' group by 1, 2)
    select o.item_id, o.revision, coalesce(own.b, sh.b).s as review_status, coalesce(own.b, sh.b).r as log_revision, case when own.b is null then case when sh.b is not null then 'shared' end when own.b.r=o.revision then 'exact' else 'earlier' end as basis
    from o left join own on own.item_id=o.item_id left join sh on sh.shared_key=o.shared_key and sh.signature=o.signature""",
)
def _(t):
    k = F.col("c_custkey")
    o = t.customer.select(k.alias("item_id"), (k % 50).alias("shared_key"), (k % 40).alias("revision"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("signature"))
    return review.carry_forward_reviews(o, _log(t))


@query(
    "suggest_legacy", "review_log",
    """with o as (select min(c_custkey) as segment_id, c_custkey%1300 as k from customer group by 2 having count(*)=1), l as (select record_revision%9000 as k, min(review_status) as s from review_log group by 1 having count(*)=1 and bool_and(record_revision%5<>0))
    select segment_id, s as suggested from o join l using (k)""",
)
def _(t):
    o = t.customer.select(F.col("c_custkey").alias("segment_id"), (F.col("c_custkey") % 1300).alias("k"))
    old = t.review_log.select((F.col("record_revision") % 9000).alias("k"), "review_status", (F.col("record_revision") % 5 != 0).alias("valid"))
    return review.suggest_legacy(o, old, ["k"])


_APPLY = """c as (select o_orderkey as segment_id, o_orderkey%3 as revision, case o_orderkey%4 when 0 then 'blocked' when 1 then 'excluded' when 2 then 'confirmed' else 'needs_review' end as st, o_orderkey%8<>0 as rect_ok from orders),
e as (select (record_revision*3)%16000 as segment_id, count(*) as n, any_value(record_revision%3) as er, any_value(case when review_status='pending' then null else review_status end) as wanted, any_value(record_revision%5=0) as nr from review_log group by 1),
j as (select *, coalesce(wanted, st) as w, coalesce(nr,false) or coalesce(rect_ok,false) as geo from e left join c using (segment_id)),
k as (select *, case when n>1 then 'duplicate_edit' when revision is null then 'unknown_segment' when er<>revision then 'revision_changed' when st='blocked' and not geo and w<>'excluded' then 'needs_calibration'
   when st='excluded' and w not in ('needs_review','excluded') then 'restore_first' when w not in ('needs_review','confirmed','page_confirmed','excluded') then 'unknown_status' end as conflict from j)"""


def _applied(t):
    k = F.col("o_orderkey")
    cur = t.orders.select(
        k.alias("segment_id"), (k % 3).alias("revision"),
        F.when(k % 4 == 0, "blocked").when(k % 4 == 1, "excluded").when(k % 4 == 2, "confirmed").otherwise("needs_review").alias("review_status"),
        (k % 8 != 0).alias("rect_ok"), F.lit("ordinary").alias("document_type"),
    )
    r = F.col("record_revision")
    edits = t.review_log.select(
        ((r * 3) % 16000).alias("segment_id"), (r % 3).alias("expected_revision"), F.when(F.col("review_status") != "pending", F.col("review_status")).alias("review_status"),
        (r % 5 == 0).alias("new_rect_ok"), F.lit(None).cast("string").alias("document_type"),
    )
    return review.apply_review(cur, edits)


@query("apply_review_accepted", "review_log", f"with {_APPLY} select segment_id, revision+1 as revision, w as review_status, case when wanted is null then rect_ok else geo end as rect_ok from k where conflict is null")
def _(t):
    return _applied(t)[0].select("segment_id", "revision", "review_status", "rect_ok")


@query("apply_review_conflicts", "review_log", f"with {_APPLY} select segment_id, conflict from k where conflict is not null")
def _(t):
    return _applied(t)[1]


@query("latest_reviews", "review_log", "select segment_id, max(record_revision) as record_revision, arg_max(review_status, record_revision) as review_status from review_log group by 1")
def _(t):
    return review.latest_reviews(t.review_log).select("segment_id", "record_revision", "review_status")


def _before_after(t):
    k = F.col("o_orderkey")
    before = t.orders.select(k.alias("segment_id"), F.col("o_orderstatus").alias("route"), F.col("o_orderpriority").alias("label"))
    after = before.filter("segment_id % 20 <> 3").withColumn("route", F.when(F.col("segment_id") % 6 == 0, "F").otherwise(F.col("route")))
    return before, after


@query(
    "history", "",
    "select cast(8 as int) as history_revision, 'save' as reason, o_orderkey as segment_id, o_orderstatus as route, o_orderpriority as label from orders where o_orderkey%20=3 or (o_orderkey%6=0 and o_orderstatus<>'F')",
)
def _(t):
    before, after = _before_after(t)
    return review.history(before, after, "segment_id", F.lit(8), "save")


_UNDO = "cur as (select o_orderkey as segment_id, case when o_orderkey%9=0 then 9 else 8 end as revision, case when o_orderkey%6=0 then 'F' else o_orderstatus end as route, o_orderstatus as old, o_orderkey%6=0 and o_orderstatus<>'F' as img from orders where o_orderkey%20<>3)"


def _undone(t):
    before, after = _before_after(t)
    images = review.history(before, after, "segment_id", F.lit(8), "save")
    cur = after.withColumn("revision", F.when(F.col("segment_id") % 9 == 0, 9).otherwise(8))
    return review.undo(cur, images, "segment_id", 8)


@query("undo_restored", "", f"with {_UNDO} select segment_id, case when img and revision=8 then 9 else revision end as revision, case when img and revision=8 then old else route end as route from cur")
def _(t):
    return _undone(t)[0].select("segment_id", "revision", "route")


@query(
    "undo_conflicts", "",
    f"with {_UNDO} select segment_id, 'revision_changed' as conflict from cur where img and revision<>8 union all select o_orderkey, 'row_missing' from orders where o_orderkey%20=3",
)
def _(t):
    return _undone(t)[1]


_VIEW = "v as (select o_orderkey as segment_id, o_custkey%30 as source_id, case when o_orderkey%50=7 then 'nan'::double else (o_orderkey*7919%10007)/10007.0::double end as confidence, case o_orderkey%4 when 0 then 'blocked' when 1 then 'needs_review' else 'confirmed' end as review_status, o_orderkey%10=0 as manual_adjusted from orders)"


def _view(t):
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("segment_id"), (F.col("o_custkey") % 30).alias("source_id"), F.when(k % 50 == 7, float("nan")).otherwise((k * 7919 % 10007) / F.lit(10007.0)).alias("confidence"),
        F.when(k % 4 == 0, "blocked").when(k % 4 == 1, "needs_review").otherwise("confirmed").alias("review_status"), (k % 10 == 0).alias("manual_adjusted"),
    )


@query(
    "review_view", "",
    f"with {_VIEW} select segment_id, cast(row_number() over (order by isnan(confidence), case when isnan(confidence) then 0 else confidence end, segment_id) as bigint) as position from v where review_status in ('needs_review','blocked')",
)
def _(t):
    return review.review_view(_view(t), "needs_review").select("segment_id", "position")


@query(
    "review_facets", "",
    f"""with {_VIEW} select source_id, cast(count(*) as bigint) as "all", cast(count(*) filter (where review_status<>'confirmed') as bigint) as needs_review, cast(count(*) filter (where manual_adjusted) as bigint) as manual, cast(count(*) filter (where review_status='blocked') as bigint) as blocked from v group by rollup(source_id)""",
)
def _(t):
    return review.review_facets(_view(t))


_SEGS = "s as (select o_orderkey as segment_id, o_custkey%30 as source_id, case when o_orderkey%5>0 then concat('bank', o_custkey%4) end as issuer, case when o_orderkey%7>0 then concat('t', o_orderkey%3) end as template, o_orderkey%3 as position_index, o_orderstatus='F' as confirmed from orders)"


def _segs(t):
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("segment_id"), (F.col("o_custkey") % 30).alias("source_id"), F.when(k % 5 > 0, F.concat(F.lit("bank"), (F.col("o_custkey") % 4).cast("string"))).alias("issuer"),
        F.when(k % 7 > 0, F.concat(F.lit("t"), (k % 3).cast("string"))).alias("template"), (k % 3).alias("position_index"), (F.col("o_orderstatus") == "F").alias("confirmed"),
    )


@query(
    "review_groups", "",
    f"with {_SEGS} select case when issuer is not null and template is not null then concat(issuer,'|',template,'|',position_index) else concat('single|', segment_id) end as review_key, cast(count(*) as bigint) as slips, cast(count(*) filter (where confirmed) as bigint) as confirmed, max(issuer is not null and template is not null) as verified, min(source_id) as first_source from s group by 1",
)
def _(t):
    return review.review_groups(_segs(t))


@query(
    "review_members", "",
    f"with {_SEGS} select case when issuer is not null and template is not null then concat(issuer,'|',template,'|',position_index) else concat('single|', segment_id) end as review_key, segment_id, source_id, confirmed from s",
)
def _(t):
    return review.review_members(_segs(t))


@query(
    "review_rollup", "",
    f"with {_SEGS} select case when issuer is not null and template is not null then concat('bank|', issuer) else concat('source|', source_id) end as bucket, cast(count(*) as bigint) as slips, cast(count(*) filter (where not confirmed) as bigint) as \"open\" from s group by 1",
)
def _(t):
    return review.review_rollup(_segs(t))


@query(
    "group_complete", "",
    "select c_custkey as group_id, coalesce(bool_and(o_orderstatus='F' and o_orderkey%100<>1), false) as complete from customer left join orders on o_custkey=c_custkey group by 1",
)
def _(t):
    members = t.orders.select(
        F.col("o_orderkey").alias("segment_id"), F.col("o_custkey").alias("group_id"), F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("needs_review").alias("review_status")
    )
    listed = t.orders.filter("o_orderkey % 100 <> 1").select(F.col("o_orderkey").alias("segment_id"))
    return review.group_complete(t.customer.select(F.col("c_custkey").alias("group_id")), members, listed)


@query(
    "batch_crop_plan", "",
    """with t as (select *, o_custkey%5 as k, o_orderkey%3 as p, case when o_orderkey%17>0 then 100.0::double+o_orderkey%40 end as a from orders)
    select o_orderkey as segment_id, case when k=4 then 'no_sample' when o_orderstatus='P' then 'excluded' when o_orderkey%11=0 then 'manual' when a is null then 'no_anchor' when a-110+200>325 then 'outside_page' end as skip_reason,
     case when not (k=4 or o_orderstatus='P' or o_orderkey%11=0 or a is null or a+90>325) then 12.0::double end as x0, case when not (k=4 or o_orderstatus='P' or o_orderkey%11=0 or a is null or a+90>325) then a-110+100 end as y0 from t""",
)
def _(t):
    k = F.col("o_orderkey")
    targets = t.orders.select(
        k.alias("segment_id"), F.concat(F.lit("b"), (F.col("o_custkey") % 5).cast("string")).alias("issuer"), F.lit("t").alias("template"), (k % 3).alias("position_index"),
        F.when(k % 17 > 0, F.lit(100.0) + k % 40).alias("anchor_y"), F.when(F.col("o_orderstatus") == "P", "excluded").otherwise("confirmed").alias("review_status"),
        (k % 11 == 0).alias("manual_adjusted"), F.lit(325.0).alias("page_height"),
    )
    sample = targets.filter("issuer <> 'b4'").select("issuer", "template", "position_index").distinct().withColumns(
        {"anchor_y": F.lit(110.0), "x0": F.lit(12.0), "y0": F.lit(100.0), "x1": F.lit(500.0), "y1": F.lit(200.0)}
    )
    return review.batch_crop_plan(sample, targets).select("segment_id", "skip_reason", "x0", "y0")


@query(
    "review_set_integrity", "",
    """with seg as (select o_custkey as source_id, o_orderkey%4 as page, row_number() over (partition by o_custkey, o_orderkey%4 order by o_orderkey) + case when o_orderkey%500=3 then 1 else 0 end as segment_no, case when o_orderkey%400=9 then 'x' else 'sha' end as sha from orders),
    n as (select source_id, count(*) as n, min(sha) as s0, max(sha) as s1 from seg group by 1), pg as (select source_id, page, count(*) as n, count(distinct segment_no) as d, min(segment_no) as lo, max(segment_no) as hi from seg group by 1, 2),
    bad as (select source_id, bool_or(n<>d or lo<>1 or hi<>n) as bad from pg group by 1), h as (select o_custkey as source_id, count(*) as h from orders group by 1),
    d as (select c_custkey as source_id, (select count(*) from orders where o_custkey=c_custkey) + case when c_custkey%90=1 then 1 else 0 end as hc, (select count(*) from orders where o_custkey=c_custkey) + case when c_custkey%80=1 then 1 else 0 end as sc from customer where c_custkey%100<>5),
    r as (select source_id, d.hc, d.sc, h, n, s0, s1, bad, d.source_id is null as unk from d full join n using (source_id) full join h using (source_id) full join bad using (source_id))
    select source_id, unnest(list_filter([case when hc is null then 'unknown_source' end, case when hc<>coalesce(h,0) then 'hit_count' end, case when sc<>coalesce(n,0) then 'segment_count' end, case when hc is not null and (s0<>'sha' or s1<>'sha') then 'source_hash' end, case when bad then 'segment_numbers' end], lambda x: x is not null)) as violation from r""",
)
def _(t):
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    w = Window.partitionBy("source_id", "page").orderBy("o_orderkey")
    seg = t.orders.select(F.col("o_custkey").alias("source_id"), (k % 4).alias("page"), "o_orderkey", F.when(k % 400 == 9, "x").otherwise("sha").alias("sha256"))
    seg = seg.withColumn("segment_no", F.row_number().over(w) + F.when(k % 500 == 3, 1).otherwise(0))
    hits = t.orders.select(F.col("o_custkey").alias("source_id"))
    counts = t.orders.groupBy(F.col("o_custkey").alias("source_id")).agg(F.count(F.lit(1)).alias("h"), F.count(F.lit(1)).alias("n"))
    c = F.col("source_id")
    docs = t.customer.select(F.col("c_custkey").alias("source_id")).filter("source_id % 100 <> 5").join(counts, "source_id", "left").select(
        "source_id", F.lit("sha").alias("sha256"), (F.coalesce("h", F.lit(0)) + F.when(c % 90 == 1, 1).otherwise(0)).alias("hit_count"),
        (F.coalesce("n", F.lit(0)) + F.when(c % 80 == 1, 1).otherwise(0)).alias("segment_count"),
    )
    return review.review_set_integrity(docs, hits, seg)
