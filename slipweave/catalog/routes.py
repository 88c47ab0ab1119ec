"""Routing queries over the slips view."""

from pyspark.sql import functions as F

from slipweave.catalog.registry import query
from slipweave.functions import identity
from slipweave.functions import text as tx
from slipweave.operators import route

ACCOUNT = {"company_name": "Own Co", "bank_name": "Bank A", "account_number": "0000000001"}


def wide(t):
    """Slips with payer and payee columns taken from own and counterparty values."""
    s = t.slips
    cols = {}
    for side in ("payer", "payee"):
        own = F.col("own_role") == side
        cp_name = F.when(F.col("cp_state") == "present", F.col("cp_name")).when(F.col("cp_state") == "ambiguous", "***").otherwise("")
        cols[f"{side}_name"] = F.when(own, F.col("own_name")).otherwise(cp_name)
        cols[f"{side}_name_state"] = F.when(own, "present").otherwise(F.col("cp_state"))
        cols[f"{side}_account"] = F.when(own, F.col("own_account")).otherwise(F.col("cp_account"))
        cols[f"{side}_account_state"] = F.when(own & (F.col("own_account") == ""), "missing").otherwise("present")
        cols[f"{side}_bank"] = F.lit("")
        cols[f"{side}_bank_state"] = F.lit("missing")
    cols["source_state"] = F.when(F.col("source_bank") == "", "unknown").otherwise("present")
    cols["job_id"] = F.lit("job")
    return s.withColumns(cols)


# own side: the counterparty never carries our account; names decide where the account is absent or wrong.
TRUTH = """p as (select *, cp_account='0000000001' as cpm, own_account='0000000001' as ownm, own_name='Own Co' as on_, cp_state='present' and cp_name='Own Co' as cn,
   case own_role when 'payer' then 'payee' else 'payer' end as cp_role from slips),
q as (select *, case when ownm and cpm then null when ownm then own_role when cpm then cp_role when on_ and not cn then own_role when cn and not on_ then cp_role end as side,
   case when source_bank='' then 'unknown' when source_bank='Bank A' then 'matched' else 'mismatch' end as bank_status from p),
r as (select *, side=own_role as home, concat_ws(',',
   case when bank_status='mismatch' then 'source_bank_mismatch' end, case when bank_status='unknown' then 'source_bank_unknown' end,
   case when ownm and cpm then 'both_sides_match_our_account' end,
   case when not ownm and not cpm and own_account='' then 'own_account_missing' end,
   case when not ownm and not cpm and (own_account<>'' or side=cp_role) then 'own_account_mismatch' end,
   case when side=own_role and not on_ or side=cp_role and cp_state='present' and not cn then 'own_company_mismatch' end,
   case when side=cp_role and cp_state='ambiguous' then 'own_company_ambiguous' end) as reasons from q),
v as (select *, case when side=own_role then cp_state when side=cp_role then 'present' when on_ and cn then 'present' else 'missing' end as ns,
   case when side=own_role then case cp_state when 'present' then cp_name when 'ambiguous' then '***' else '' end when side=cp_role then own_name when on_ and cn then 'Own Co' else '' end as nm from r),
w as (select *, case when excluded then 'excluded'
   when contains(reasons,'source_bank_mismatch') or contains(reasons,'own_company_mismatch') or contains(reasons,'own_account_mismatch') or (contains(reasons,'both_sides_match') and not (on_ and cn)) then 'conflict'
   when ns='present' and nm='Own Co' then 'internal' when ns='blank' then 'blank' when ns<>'present' then 'unnamed' else 'named' end as rule from v),
routed_slips as (select segment_id, source_id, side as own_side, bank_status, reasons, case when rule in ('conflict','unnamed') then 'counterparty_pending' else rule end as route,
  case rule when 'excluded' then 'excluded_by_review' when 'conflict' then 'batch_identity_conflict' when 'unnamed' then case when ns='ambiguous' then 'counterparty_name_ambiguous' else 'counterparty_name_missing' end else '' end as route_reason,
  case rule when 'excluded' then null when 'internal' then 'internal:Own Co' when 'blank' then 'blank' when 'named' then concat('counterparty:', nm) else 'counterparty_pending' end as group_key,
  case rule when 'excluded' then '已排除' when 'internal' then 'Own Co' when 'blank' then '对方名称为空' when 'named' then nm else '对手待确认' end as group_label, nm, ns,
  case when rule in ('excluded','conflict','unnamed') then 'none' else 'automatic' end as decision_method from w)"""
_COLS = ["segment_id", "own_side", "bank_status", "reasons", "route", "route_reason", "group_key", "group_label", "decision_method"]


@query("derive_route", "slips", f"with {TRUTH} select {', '.join(_COLS)} from routed_slips")
def _(t):
    return route.derive_route(wide(t), ACCOUNT).select(*_COLS)


@query("derive_route_counterparty", "slips", f"with {TRUTH} select segment_id, nm as counterparty_name, ns as counterparty_name_state from routed_slips")
def _(t):
    return route.derive_route(wide(t), ACCOUNT).select("segment_id", "counterparty_name", "counterparty_name_state")


@query(
    "derive_route_special",
    "slips",
    f"""with {TRUTH} select segment_id, case when route='excluded' then 'excluded' when segment_id%6=0 then 'special'
     when route_reason='batch_identity_conflict' then route when ns in ('missing','blank') and segment_id%6=1 and own_side is not null then 'special' else route end as route,
     case when route='excluded' then null when segment_id%6=0 then 'special:loan_interest_notice' when route_reason='batch_identity_conflict' then group_key
       when ns in ('missing','blank') and segment_id%6=1 and own_side is not null then 'special:bank_fee' else group_key end as group_key from routed_slips""",
)
def _(t):
    k = F.col("segment_id") % 6
    s = wide(t).withColumns(
        {
            "document_type": F.when(k == 0, "loan_interest_notice").otherwise("ordinary"), "type_confirmed": k == 0,
            "service_type": F.when(k == 1, "bank_fee"),
        }
    )
    return route.derive_route(s, ACCOUNT).select("segment_id", "route", "group_key")


@query(
    "group_identity",
    "slips",
    """select segment_id, concat('group_', substr(sha256(concat('{"job":"job","key":"', cp_name, '","kind":"named"}')), 1, 32)) as group_id,
     sha256(concat('{"page":', segment_id, ',"semantic":null,"sha":"', source_bank, '"}')) as digest from slips""",
)
def _(t):
    return t.slips.select(
        "segment_id", identity.group_id(F.lit("job"), F.lit("named"), F.col("cp_name")).alias("group_id"),
        identity.digest(sha=F.col("source_bank"), page=F.col("segment_id"), semantic=F.lit(None).cast("string")).alias("digest"),
    )


@query(
    "stable_identity",
    "slots",
    """select instance_id, sha256(concat('{"page":', page, ',"segment_no":', position_index, ',"semantic":"","sha":"s","slot":"slot-', position_index, '","source_id":', source_id,
      ',"x0":', x0, ',"x1":', x1, ',"y0":', y0, ',"y1":', y1, '}')) as identity from slots""",
)
def _(t):
    c = F.col
    return t.slots.select(
        "instance_id",
        identity.stable_identity(
            c("source_id"), F.lit("s"), c("page"), c("position_index"), F.concat(F.lit("slot-"), c("position_index").cast("string")),
            [c("x0"), c("y0"), c("x1"), c("y1")], F.lit(""),
        ).alias("identity"),
    )


@query(
    "effective_type",
    "",
    """select o_orderkey, case when o_orderkey%3=0 then 'other_special' when o_orderkey%4=0 then 'electronic_tax_payment' else 'ordinary' end as effective,
     case when o_orderkey%3=0 then '其他特殊单证' when o_orderkey%4=0 then '电子缴税付款凭证' else '普通回单' end as label from orders""",
)
def _(t):
    k = F.col("o_orderkey")
    e = tx.effective_type(F.when(k % 3 == 0, "other_special"), F.when(k % 4 == 0, "electronic_tax_payment").when(k % 4 == 1, "bank_fee"))
    return t.orders.select("o_orderkey", e.alias("effective"), tx.type_label(e).alias("label"))


@query(
    "build_groups",
    "slips",
    f"""with {TRUTH} select concat('group_', substr(sha256(concat('{{"job":"job","key":"', group_key, '","kind":"', route, '"}}')), 1, 32)) as group_id, route as kind, group_key,
      case when group_key like 'counterparty:%7' then 'Renamed' else min(group_label) end as label, cast(count(*) as bigint) as slips, coalesce(group_key like 'counterparty:%7', false) as manual
      from routed_slips where route<>'excluded' group by route, group_key""",
)
def _(t):
    routed = route.derive_route(wide(t), ACCOUNT)
    key = F.concat(F.lit("counterparty:"), F.col("c_name"))
    manual = t.customer.filter(F.col("c_name").endswith("7")).select(
        identity.group_id(F.lit("job"), F.lit("named"), key).alias("group_id"), F.lit("Renamed").alias("display_name")
    )
    return route.build_groups(routed, manual)


_COUNTS = """cast(count(*) as bigint) as total, cast(count(*) filter (where route='excluded') as bigint) as excluded,
      cast(count(*) filter (where route<>'excluded' and state in ('pending', 'failed')) as bigint) as extraction_pending,
      cast(count(*) filter (where route<>'excluded' and not coalesce(own_side is not null and reasons='' and bank_status='matched', false)) as bigint) as own_pending,
      cast(count(*) filter (where route='counterparty_pending') as bigint) as counterparty_pending,
      cast(count(*) filter (where route not in ('excluded', 'counterparty_pending', 'own_pending')) as bigint) as assigned,
      cast(count(*) filter (where route<>'excluded' and state='stale') as bigint) as stale"""


@query(
    "route_counts",
    "slips",
    f"""with {TRUTH}, x as (select *, case when segment_id%7=0 then 'stale' when segment_id%11=0 then 'pending' when segment_id%13=0 then 'failed' else 'ready' end as state from routed_slips),
    k as (select {_COUNTS} from x)
    select *, case when extraction_pending+own_pending+counterparty_pending+stale=0 then 'ready' else 'needs_confirmation' end as status from k""",
)
def _(t):
    k = F.col("segment_id")
    state = F.when(k % 7 == 0, "stale").when(k % 11 == 0, "pending").when(k % 13 == 0, "failed").otherwise("ready")
    return route.route_counts(route.derive_route(wide(t), ACCOUNT).withColumn("extraction_state", state))


@query(
    "switch_account",
    "slips",
    f"""with {TRUTH.replace("from slips)", "from (select * replace (replace(own_name,'Other Co','X') as own_name) from slips))")} select {', '.join(_COLS)} from routed_slips""",
)
def _(t):
    s = wide(t)
    # The old decision carried a manual side; switching drops it and decides afresh.
    s = s.withColumn("confirm_side", F.lit("payer")).withColumns(
        {f"{x}_name": F.regexp_replace(f"{x}_name", "^Other Co$", "X") for x in ("payer", "payee")}
    )
    return route.switch_account(s, ACCOUNT).select(*_COLS)


@query(
    "refresh_stale",
    "slips",
    f"""with {TRUTH} select segment_id, case when segment_id%4=0 or segment_id%10=7 or segment_id%9=1 then route else 'old' end as route, 'v2' as version, segment_id%4=0 or segment_id%10=7 or segment_id%9=1 as recomputed
      from routed_slips where true""",
)
def _(t):
    s = wide(t)
    stale = F.col("segment_id") % 4 == 0
    old = s.select(
        "segment_id", *[F.lit("old").alias(c) for c in route.ROUTED], F.when(F.col("segment_id") % 9 == 1, F.lit(None)).when(stale, "v1").otherwise("v2").alias("version")
    )
    picked = s.filter("segment_id % 10 = 7").select("segment_id")
    return route.refresh(old, s, ACCOUNT, "v2", picked).select("segment_id", "route", "version", "recomputed")


_EDITS = TRUTH + """, e as (select *, segment_id%5=0 as edited, segment_id%15=0 as assigns, segment_id%10=0 as names, segment_id%40=0 as stale from routed_slips),
x as (select *, case when names then 'New Co' else nm end as nm2, case when names then 'present' else ns end as ns2 from e where edited),
y as (select *, case when route='excluded' then 'excluded' when route_reason='batch_identity_conflict' then 'conflict' when nm2='Own Co' and ns2='present' then 'internal' else 'open' end as base from x),
z as (select *, case when stale then 'basis_changed' when base='excluded' and (assigns or names) then 'excluded_slip' when (assigns or names) and base='conflict' then 'identity_conflict'
  when assigns and base='internal' then 'not_assignable' end as conflict from y)"""


def _edited(t):
    k = F.col("segment_id")
    s = wide(t).withColumns({"basis": F.lit("b"), "extraction_ready": F.lit(True)})
    edits = t.slips.filter(k % 5 == 0).select(
        "segment_id", F.when(k % 40 == 0, "old").otherwise("b").alias("expected_basis"),
        F.when(k % 10 == 0, "New Co").alias("name_value"), F.when(k % 10 == 0, "present").alias("name_state"),
        F.lit(False).alias("clear_name"), F.when(k % 15 == 0, "manual-1").alias("assign_group"), F.lit(False).alias("clear_assignment"),
    )
    groups = t.region.select(
        F.concat(F.lit("manual-"), (F.col("r_regionkey") + 1).cast("string")).alias("group_id"), F.lit("named").alias("kind"), F.lit(None).cast("string").alias("group_key"), F.lit("Chosen").alias("label")
    )
    return route.apply_edits(s, edits, groups, ACCOUNT)


@query("apply_edits_conflicts", "slips", f"with {_EDITS} select segment_id, conflict from z where conflict is not null")
def _(t):
    return _edited(t)[1]


@query(
    "apply_edits_routes",
    "slips",
    f"""with {_EDITS} select segment_id, route, group_label from routed_slips where segment_id%5<>0
    union all select segment_id, case when conflict is not null or base='excluded' or base='conflict' then route when base='internal' then 'internal' when assigns then 'named' when names then 'named' else route end,
      case when conflict is not null or base='excluded' or base='conflict' then group_label when base='internal' then 'Own Co' when assigns then 'Chosen' when names then 'New Co' else group_label end
    from z""",
)
def _(t):
    return _edited(t)[0].select("segment_id", "route", "group_label")


@query(
    "guidance",
    "slips",
    f"""with {TRUTH} select segment_id, case when contains(reasons,'source_bank_mismatch') then 'source_bank_mismatch' when contains(reasons,'both_sides') then 'both_sides_match_our_account' when contains(reasons,'own_account_mismatch') then 'own_account_mismatch'
      when contains(reasons,'own_company_mismatch') then 'own_company_mismatch' else route_reason end as guidance from routed_slips where route='counterparty_pending'""",
)
def _(t):
    return route.guidance(route.derive_route(wide(t), ACCOUNT)).select("segment_id", "guidance")
