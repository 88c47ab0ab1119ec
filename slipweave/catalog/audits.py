"""Progress, completeness, diagnostic and snapshot queries."""

import uuid

from pyspark.sql import functions as F

from slipweave.catalog.registry import query
from slipweave.operators import audit
from slipweave.session import shared_folder
from slipweave.streaming.progress import PageState

_COUNTS = "cast(count(*) filter (where status='pending') as bigint) as pending, cast(0 as bigint) as running, cast(count(*) filter (where status='succeeded') as bigint) as succeeded, cast(count(*) filter (where status='failed') as bigint) as failed, cast(count(*) as bigint) as total"


@query("progress", "page_status", f"select {_COUNTS} from page_status")
def _(t):
    return audit.progress(t.page_status)


@query("progress_per_source", "page_status", f"select source_id, {_COUNTS} from page_status group by 1")
def _(t):
    return audit.progress(t.page_status, ["source_id"])


_LOST = """src as (select source_id, count(*) + case when source_id%9=1 then 1 else 0 end - case when source_id%9=2 then 1 else 0 end as page_count from page_status group by 1),
pg as (select source_id, page from page_status where page%50<>7 union all select source_id, page from page_status where page%50=9),
problems as (select source_id, page, 'missing' as problem from (select source_id, unnest(range(1, cast(page_count as bigint)+1)) as page from src) w where not exists (select 1 from pg where pg.source_id=w.source_id and pg.page=w.page)
 union all select source_id, page, case when page>page_count then 'out_of_range' else 'duplicate' end from (select source_id, page, count(*) as n from pg group by 1, 2) join src using (source_id) where page>page_count or n>1)"""


def _snapshot(t):
    s = F.col("source_id")
    sources = t.page_status.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).select(
        "source_id", (F.col("n") + F.when(s % 9 == 1, 1).otherwise(0) - F.when(s % 9 == 2, 1).otherwise(0)).alias("page_count"),
        F.lit("sha").alias("sha256"), s.alias("source_position"),
    )
    p = t.page_status.select("source_id", "page")
    return sources, p.filter("page % 50 <> 7").unionByName(p.filter("page % 50 = 9"))


@query("snapshot_complete", "page_status", f"with {_LOST} select source_id, page, problem from problems")
def _(t):
    return audit.snapshot_complete(*_snapshot(t))


@query(
    "publish_snapshot", "page_status",
    f"""with {_LOST} select o_orderkey as segment_id, cast(row_number() over (order by o_custkey, p.page, o_orderkey) as bigint) as position, case when o_orderkey%4=0 then 'needs_review' else 'confirmed' end as review_status
    from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as page from orders) p where o_custkey not in (select source_id from problems)""",
)
def _(t):
    from pyspark.sql import Window

    sources, pages = _snapshot(t)
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    cand = t.orders.select(
        F.col("o_custkey").alias("source_id"), page.cast("long").alias("page"), F.col("o_orderkey").alias("segment_id"), F.lit(1).alias("position_index"),
        (F.col("o_orderkey") % 4 == 0).alias("needs_review"), *[F.lit(float(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))],
    )
    return audit.publish_snapshot(sources, pages, cand).select("segment_id", "position", "review_status")


@query(
    "dedupe_failures", "",
    "select user_id as source_id, event_id%4 as page, event_type as stage, 'E1' as code, 'm' as message, cast(user_id*2 as bigint) as source_position, cast(count(*) as bigint) as seen from events group by 1, 2, 3",
)
def _(t):
    f = t.events.select(
        F.col("user_id").alias("source_id"), (F.col("event_id") % 4).alias("page"), F.col("event_type").alias("stage"), F.lit("E1").alias("code"), F.lit("m").alias("message"), (F.col("user_id") * 2).alias("source_position")
    )
    return audit.dedupe_failures(f)


@query("retry_set", "page_status", "select source_id, page, 'pending' as status, page%5+1 as retry_count from page_status where status='failed' and page%5<3")
def _(t):
    return audit.retry_set(t.page_status.withColumn("retry_count", F.col("page") % 5), 3)


@query(
    "accept_events", "seq_events",
    """with j as (select job_id, list(seq order by arrival) as s from seq_events group by 1),
    r as (select job_id, 0 as i, cast(0 as bigint) as last_seq, cast(null as varchar) as verdict, cast(0 as bigint) as before_ from j
      union all select r.job_id, r.i+1, case when j.s[r.i+1]=r.last_seq+1 then j.s[r.i+1] else r.last_seq end, case when j.s[r.i+1]=r.last_seq+1 then 'accepted' when j.s[r.i+1]<1 then 'invalid' when j.s[r.i+1]<=r.last_seq then 'duplicate' else 'out_of_order' end, r.last_seq from r join j on j.job_id=r.job_id where r.i<len(j.s))
    select job_id, cast(i as bigint) as arrival, verdict from r where i>0""",
)
def _(t):
    return audit.accept_events(t.seq_events).select("job_id", "arrival", "verdict")


@query(
    "accept_generations", "seq_events",
    """with e as (select job_id, (arrival-1)//12 as generation, arrival, case when arrival%29=7 then null else seq-12*((arrival-1)//12) end as seq, case when event_type='purchase' and arrival%5=0 then 'completed' else 'progress' end as type from seq_events),
    j as (select job_id, generation, list(struct_pack(a:=arrival, s:=seq, t:=type) order by arrival) as l from e group by 1, 2),
    r as (select job_id, generation, 0 as i, cast(0 as bigint) as last, false as over_, false as lost, cast(null as varchar) as verdict from j
      union all select job_id, generation, i+1, case when v='accepted' then s else last end, over_ or v='accepted' and t='completed', lost or s is null, v from (
        select r.*, x.s, x.t, case when x.s is null then 'snapshot_required' when x.s<1 then 'invalid' when lost then 'snapshot_required' when over_ then 'completed' when x.s=last+1 then 'accepted' when x.s<=last then 'duplicate' else 'out_of_order' end as v
        from (select r.*, j.l[r.i+1] as x from r join j using (job_id, generation) where r.i<len(j.l)) r))
    select job_id, generation, j.l[i].a as arrival, verdict from r join j using (job_id, generation) where i>0""",
)
def _(t):
    """Numbers that begin anew in each generation, with completions and lost numbers."""
    g = F.floor((F.col("arrival") - 1) / 12)
    e = t.seq_events.select(
        "job_id", g.alias("generation"), "arrival", F.when(F.col("arrival") % 29 != 7, F.col("seq") - 12 * g).alias("seq"),
        F.when((F.col("event_type") == "purchase") & (F.col("arrival") % 5 == 0), "completed").otherwise("progress").alias("type"))
    return audit.accept_events(e).select("job_id", "generation", "arrival", "verdict")


@query(
    "page_progress", "page_status",
    """with n as (select source_id, count(*) as n from page_status group by 1),
    f as (select source_id, page, case when status='failed' and page%2=0 then 'succeeded' else status end as status, case when status='failed' then (page+2)%3 else (page+1)%3 end as b from page_status)
    select source_id, cast(count(*) as bigint) as pages, cast(count(*) filter (where status='succeeded') as bigint) as succeeded, cast(count(*) filter (where status='failed') as bigint) as failed,
      cast(case when bool_and(status='succeeded') then max(b) end as bigint) as published from f group by 1""",
)
def _(t):
    """Page events in three batches, failed pages of even number tried again; counts per source and the batch that made it full."""
    p = t.page_status
    again = p.filter("status = 'failed' and page % 2 = 0").select("source_id", "page", F.lit("succeeded").alias("status"), F.lit(2).alias("attempt"))
    events = p.select("source_id", "page", "status", F.lit(1).alias("attempt")).unionByName(again).withColumn("event_id", F.col("page") * 10 + F.col("attempt"))
    state = PageState(f"{shared_folder(t.spark)}/progress-{uuid.uuid4().hex}", p.groupBy("source_id").agg(F.count(F.lit(1)).alias("page_count")))
    for batch in range(3):
        state.fold(events.filter((F.col("page") + F.col("attempt")) % 3 == batch), batch)
    return state.counts(t.spark, 2).select("source_id", "pages", "succeeded", "failed", "published")


_ISSUES = "i as (select o_orderkey as segment_id, case o_orderkey%4 when 0 then 'own_company_mismatch' when 1 then 'missing_field' when 2 then 'own_account_mismatch' else 'conflicting_field' end as code, case when o_orderkey%2=0 then 'name' else 'account' end as field, case when o_orderkey%3=0 then 'payer' else 'payee' end as role, case when o_orderkey%5=0 then 'missing' else 'ambiguous' end as state, o_custkey as layout from orders)"


def _issues(t):
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("segment_id"), F.when(k % 4 == 0, "own_company_mismatch").when(k % 4 == 1, "missing_field").when(k % 4 == 2, "own_account_mismatch").otherwise("conflicting_field").alias("code"),
        F.when(k % 2 == 0, "name").otherwise("account").alias("field"), F.when(k % 3 == 0, "payer").otherwise("payee").alias("role"), F.when(k % 5 == 0, "missing").otherwise("ambiguous").alias("state"), F.col("o_custkey").alias("layout"),
    )


@query(
    "diagnostic_summary", "",
    f"""with {_ISSUES}, two as (select * from i union all select * from i where code='own_company_mismatch' union all select segment_id, 'source_conflict', field, role, state, layout from i where segment_id%8=0
      union all select segment_id, 'both_sides_match_our_account', null, null, null, layout from i where segment_id%7=1),
    own as (select *, code in ('source_bank_mismatch', 'own_company_mismatch', 'own_account_mismatch', 'both_sides_match_our_account', 'own_side_conflict') as mine from two),
    c as (select segment_id, greatest(count(*) filter (where code='source_conflict'), 1) as n from own where mine or code='source_conflict' group by 1),
    l as (select case when segment_id%9=2 then 'unknown' else cast(layout as varchar) end as layout, segment_id from i),
    g as (select layout, count(*) as n, min(segment_id) as first from l group by 1)
    select 'code' as kind, code as name, cast(count(*) as bigint) as n from own where not mine and code<>'source_conflict' group by 2
    union all select 'code', 'source_conflict', cast(sum(n) as bigint) from c
    union all select 'field', concat_ws('/', field, role, state), cast(count(*) as bigint) from two where state is not null group by field, role, state
    union all select 'layout', concat('layout-', row_number() over (order by first, layout)), cast(n as bigint) from g
    union all select 'total', '', cast(count(*) as bigint) from i""",
)
def _(t):
    i, k = _issues(t), F.col("segment_id")
    none = F.lit(None).cast("string")
    more = i.filter(k % 7 == 1).withColumns({"code": F.lit("both_sides_match_our_account"), "field": none, "role": none, "state": none})
    issues = i.unionByName(i.filter("code = 'own_company_mismatch'")).unionByName(i.filter(k % 8 == 0).withColumn("code", F.lit("source_conflict"))).unionByName(more)
    return audit.diagnostic_summary(issues, i.select("segment_id", F.when(k % 9 != 2, F.col("layout")).alias("layout")))


_MEMBERS = """m as (select distinct segment_id, case when segment_id%6=0 then 'unsupported_layout' else code end as issue, concat('b', layout%3) as bank,
  case when segment_id%6<>0 then field end as field, case when segment_id%6<>0 then role else 'unknown' end as role, 'ordinary' as document_type, layout%5 as layout from i where segment_id%10<>3)"""


def _collected(t):
    i, k = _issues(t), F.col("segment_id")
    one = F.struct("code", "field", "role")
    route = F.when(k % 10 == 3, "named").when(k % 2 == 0, "own_pending").otherwise("counterparty_pending")
    return i.select(
        "segment_id", F.when(k % 6 != 0, F.array(one, one)).alias("issues"), F.concat(F.lit(" b"), (F.col("layout") % 3).cast("string")).alias("bank"),
        F.lit("ordinary").alias("document_type"), (F.col("layout") % 5).alias("layout"), route.alias("route"),
    )


@query("issue_collections", "", f"with {_ISSUES}, {_MEMBERS} select issue, bank, field, role, document_type, layout, cast(count(*) as bigint) as items, min(segment_id) as first_item from m group by 1, 2, 3, 4, 5, 6")
def _(t):
    return audit.issue_collections(_collected(t))


@query("issue_members", "", f"with {_ISSUES}, {_MEMBERS} select * from m")
def _(t):
    return audit.issue_members(_collected(t))


@query(
    "validate_layouts", "loose_slots",
    """with s as (select *, case when page%13=0 then position_index+1 else position_index end as pi, case when page%17=0 and position_index=2 then 'slot-1' else concat('slot-', position_index) end as sid, case when page%19=0 and position_index=3 then 10 else height end as h from loose_slots),
    l as (select *, lag(top+h) over (partition by page order by position_index) as pe, count(*) over (partition by page, sid) as n, max(h) over (partition by page)-min(h) over (partition by page) as dh from s)
    select page as layout_id, sid as slot_id, unnest(list_filter([case when pi<>position_index then 'order' end, case when n>1 then 'duplicate_id' end, case when h<12 then 'too_small' end, case when top<0 or top+h>145 then 'outside_page' end, case when top<pe then 'overlap' end, case when page%2=0 and dh>0 then 'not_uniform' end], lambda x: x is not null)) as violation from l""",
)
def _(t):
    p, i = F.col("page"), F.col("position_index")
    slot = F.struct(
        i.alias("_o"), F.when((p % 17 == 0) & (i == 2), "slot-1").otherwise(F.concat(F.lit("slot-"), i.cast("string"))).alias("slot_id"),
        F.when(p % 13 == 0, i + 1).otherwise(i).alias("position_index"), "top", F.when((p % 19 == 0) & (i == 3), 10.0).otherwise(F.col("height")).alias("height"),
    )
    layouts = t.loose_slots.groupBy(p.alias("layout_id")).agg(F.array_sort(F.collect_list(slot)).alias("slots")).withColumns(
        {"page_height": F.lit(145.0), "uniform": F.col("layout_id") % 2 == 0}
    )
    return audit.validate_layouts(layouts)


@query(
    "rule_result_summary", "",
    "select case when o_orderkey%7=0 then 'skipped' when o_orderkey%5=0 then 'pending' else 'success' end as bucket, concat('n', o_custkey%20) as after_name, case when o_orderkey%5=0 then 'counterparty_pending' else 'named' end as after_route, cast(count(*) as bigint) as slips from orders group by 1, 2, 3",
)
def _(t):
    k = F.col("o_orderkey")
    return audit.rule_result_summary(
        t.orders.select(F.when(k % 7 == 0, "skipped").otherwise("changed").alias("outcome"), F.concat(F.lit("n"), (F.col("o_custkey") % 20).cast("string")).alias("after_name"), F.when(k % 5 == 0, "counterparty_pending").otherwise("named").alias("after_route"))
    )
