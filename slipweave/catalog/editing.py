"""Edit-log queries: every kind of edit over all slips."""

from pyspark.sql import functions as F

from slipweave.catalog.registry import query
from slipweave.catalog.routes import ACCOUNT, TRUTH, wide
from slipweave.functions import identity
from slipweave.operators import edits as ed
from slipweave.operators import route



def _number():
    return F.col("segment_id")


def _other_role():
    return F.when(F.col("own_role") == "payer", "payee").otherwise("payer")


# The route truth table with a confirmed side, and with own and counterparty values as columns of any relation.
CONFIRMED = (
    TRUTH.replace("when ownm and cpm then null when ownm then own_role when cpm then cp_role when", "when ownm and cpm then null when ownm then own_role when cpm then cp_role when confirm is not null then confirm when")
    .replace("case when source_bank='' then 'unknown'", "case when source_bank='' and confirm is not null then 'manual' when source_bank='' then 'unknown'")
    .replace("case when not ownm and not cpm and own_account='' then", "case when ownm<>cpm and confirm<>case when ownm then own_role else cp_role end then 'own_side_conflict' end,\n   case when not ownm and not cpm and confirm is null and own_account='' then")
    .replace("case when not ownm and not cpm and (own_account<>'' or side=cp_role) then", "case when not ownm and not cpm and (case confirm when own_role then own_account<>'' when cp_role then true when 'single' then true else own_account<>'' or side=cp_role end) then")
    .replace("when on_ and cn then 'present' else 'missing'", "when side is null and on_ and cn then 'present' else 'missing'")
    .replace("when on_ and cn then 'Own Co' else ''", "when side is null and on_ and cn then 'Own Co' else ''")
    .replace("contains(reasons,'own_account_mismatch') or", "contains(reasons,'own_account_mismatch') or contains(reasons,'own_side_conflict') or")
)
_SHOWN = ["segment_id", "own_side", "bank_status", "reasons", "route", "route_reason", "group_key", "group_label", "decision_method"]


def _truth(name: str, relation: str, text: str = CONFIRMED) -> str:
    """The truth table under names of its own, over another relation than the slips."""
    out = text.replace("from slips)", f"from {relation})")
    for c in ("p", "q", "r", "v", "w"):
        out = out.replace(f"{c} as (", f"{name}_{c} as (").replace(f"from {c})", f"from {name}_{c})")
    return out.replace("routed_slips as (", f"{name} as (")


def _base(t):
    return wide(t).withColumns({"basis": F.lit("b"), "extraction_ready": F.lit(True)})


def _rows(slips, *decisions):
    """An edit log: ``decisions`` are (condition, values by column); every slip makes those whose condition holds."""
    names = ("seq", "kind", "expected_basis", "side", "field", "value", "state", "group_id")
    made = []
    for cond, values in decisions:
        row = {"expected_basis": F.lit("b"), **values}
        cells = [(row.get(n) if row.get(n) is not None else F.lit(None)) for n in names]
        cells = [F.lit(c) if isinstance(c, (str, int)) else c for c in cells]
        made.append(F.when(cond, F.struct(*[c.cast("long" if n == "seq" else "string").alias(n) for n, c in zip(names, cells)])))
    rows = F.filter(F.array(*made), lambda r: r.isNotNull())
    return slips.select("segment_id", F.inline(rows))


def _groups(t):
    return t.region.select(
        F.concat(F.lit("manual-"), (F.col("r_regionkey") + 1).cast("string")).alias("group_id"), F.lit("named").alias("kind"),
        F.lit(None).cast("string").alias("group_key"), F.lit("Chosen").alias("label"))


def _apply(t, log, slips=None, group_edits=None, groups=None):
    s = _base(t) if slips is None else slips
    before = route.keep_routed(route.derive_route(s, ACCOUNT))
    return ed.apply_edit_log(s, before, log, _groups(t) if groups is None else groups, ACCOUNT, group_edits)


_FIELD_EDITS = """x as (select segment_id, source_id, own_role, cast(null as varchar) as confirm,
    case when k=2 then 'Own Co' else own_name end as own_name, case when k=1 then '0000000001' else own_account end as own_account,
    case when k in (3,4) then 'present' when k=5 then 'blank' else cp_state end as cp_state, case when k=3 then 'New Co' when k=4 then 'Newer Co' else cp_name end as cp_name,
    cp_account, source_bank, excluded, k>0 as edited from (select *, case when excluded then 0 else segment_id%7 end as k from slips) s)"""


@query("edits_fields", "slips", f"with {_FIELD_EDITS}, {_truth('now', 'x')}, {_truth('old', '(select *, cast(null as varchar) as confirm from slips)')} "
       f"select {', '.join('now.' + c for c in _SHOWN)}, now.reasons<>old.reasons or now.route<>old.route or now.nm<>old.nm or now.ns<>old.ns or now.own_side is distinct from old.own_side "
       "as changed from now join old using (segment_id)")
def _(t):
    """Corrections of our account and name and of the other side's name: an earlier, a later, a repeated one."""
    k = _number() % 7
    put = {"kind": "field", "state": "present"}
    log = _rows(
        t.slips, (k == 1, {**put, "seq": 1, "side": F.col("own_role"), "field": "account", "value": "0000000001"}),
        (k == 2, {**put, "seq": 1, "side": F.col("own_role"), "field": "name", "value": " Own Co "}),
        (k.isin(3, 4), {**put, "seq": 1, "side": _other_role(), "field": "name", "value": "New Co"}),
        (k == 3, {**put, "seq": 1, "side": _other_role(), "field": "name", "value": "New Co"}),
        (k == 4, {**put, "seq": 2, "side": _other_role(), "field": "name", "value": "Newer Co"}),
        (k == 5, {"kind": "field", "state": "blank", "seq": 1, "side": _other_role(), "field": "name", "value": ""}))
    return _apply(t, log).routed.select(*_SHOWN, "changed")


_CONFIRM_EDITS = """x as (select * replace (case when k=4 and not excluded then 'Own Co' else own_name end as own_name),
    case when excluded then null when k=1 then own_role when k=2 then case own_role when 'payer' then 'payee' else 'payer' end when k=3 then 'single'
      when k=4 and own_name='Own Co' then own_role end as confirm from (select *, segment_id%6 as k from slips) s)"""


@query("edits_confirmations", "slips", f"with {_CONFIRM_EDITS}, {_truth('now', 'x')} select {', '.join(_SHOWN)} from now")
def _(t):
    """Sides confirmed; where our own name is corrected after the confirmation, that is taken back if the name was another one."""
    k = _number() % 6
    log = _rows(
        t.slips, (k.isin(1, 4), {"kind": "confirm", "seq": 5, "side": F.col("own_role")}), (k == 2, {"kind": "confirm", "seq": 5, "side": _other_role()}),
        (k == 3, {"kind": "confirm", "seq": 5, "side": "single"}), (k == 3, {"kind": "confirm", "seq": 4, "side": "payer"}),
        (k == 4, {"kind": "field", "state": "present", "seq": 6, "side": F.col("own_role"), "field": "name", "value": "Own Co"}))
    own = F.when(F.col("own_role") == "payer", "payer").otherwise("payee")
    # A correction equal to a stored one changes nothing: all whose name is right have it stored already.
    s = _base(t).withColumns({c: F.when((own == s_) & (F.col("own_name") == "Own Co") & (k == 4), v) for s_ in ("payer", "payee") for c, v in ((f"o_{s_}_name", "Own Co"), (f"o_{s_}_name_state", "present"))})
    return _apply(t, log, s).routed.select(*_SHOWN)


_OLD = f"{_truth('old', '(select *, cast(null as varchar) as confirm from slips)')}"


@query(
    "edits_assignments", "slips",
    f"""with {_OLD} select segment_id, case when hit then 'named' else route end as route, case when hit then concat('manual-', segment_id%5+1) else null end as assigned,
      case when hit then 'Chosen' else group_label end as group_label, case when hit then 'manual' else decision_method end as decision_method
      from (select *, segment_id%3<>0 and route not in ('excluded','internal') and route_reason<>'batch_identity_conflict' as hit from old)""")
def _(t):
    """Two slips in three are assigned, the same group sent twice; who may not be keeps its route."""
    to = F.concat(F.lit("manual-"), (_number() % 5 + 1).cast("string"))
    log = _rows(t.slips, (_number() % 3 != 0, {"kind": "assign", "seq": 2, "group_id": to}), (_number() % 3 != 0, {"kind": "assign", "seq": 2, "group_id": to}),
                (_number() % 3 == 2, {"kind": "assign", "seq": 1, "group_id": "manual-9"}))
    found = _apply(t, log).routed
    return found.select("segment_id", "route", F.when(F.col("group_id").startswith("manual-"), F.col("group_id")).alias("assigned"), "group_label", "decision_method")


@query(
    "edits_clearings", "slips",
    """select segment_id, case when k<>1 then 'Stored Co' end as counterparty_name, case when k not in (2, 3) then own_role end as confirm_side, case when k=4 then 'manual-1' end as assigned_group
      from (select *, segment_id%5 as k from slips) where not excluded and k<>0""")
def _(t):
    """What a stored manual layer is after taking back corrections, the confirmation, or the assignment; sent-again values keep all."""
    k = _number() % 5
    s = _base(t).withColumns({
        "o_counterparty_name": F.lit("Stored Co"), "o_counterparty_name_state": F.lit("present"), "confirm_side": F.col("own_role"),
        "assigned_group": F.lit("manual-1"), "assigned_kind": F.lit("named"), "assigned_label": F.lit("Chosen"),
        "o_payer_bank": F.when(k == 2, "B"), "o_payer_bank_state": F.when(k == 2, "present")})
    log = _rows(
        t.slips, (k == 1, {"kind": "clear_fields", "seq": 1}), (k == 2, {"kind": "clear_field", "seq": 1, "side": "payer", "field": "bank"}),
        (k == 3, {"kind": "clear_confirm", "seq": 1}), (k == 3, {"kind": "clear_assign", "seq": 1}),
        (k == 4, {"kind": "field", "seq": 1, "state": "present", "side": "counterparty", "field": "name", "value": "Stored Co"}))
    # An entered name needs a slip without identity conflict; the names here are stored or cleared.
    return _apply(t, log, s).manual.select("segment_id", F.col("o_counterparty_name").alias("counterparty_name"), "confirm_side", "assigned_group")


@query(
    "edits_groups", "slips",
    f"""with {_OLD} select concat('group_', substr(sha256(concat('{{"job":"job","key":"', group_key, '","kind":"', route, '"}}')), 1, 32)) as group_id, route as kind,
      case when route='named' and group_key like '%7' then concat('Renamed ', group_label) else group_label end as label, route='named' and group_key like '%7' as manual
      from (select distinct route, group_key, group_label from old where route<>'excluded')
    union all select concat('manual-', r_regionkey), 'named', case r_regionkey when 3 then 'Second' else 'First' end, true from region where r_regionkey in (2,3)""")
def _(t):
    """Groups created, created and renamed, renamed; refused ones stay out."""
    groups = route.build_groups(route.derive_route(_base(t), ACCOUNT)).select("group_id", "kind", "group_key", "label")
    return ed.edit_groups(groups, _group_edits(t, groups))[0].select("group_id", "kind", "label", "manual")


def _group_edits(t, groups):
    r = F.col("r_regionkey")
    made = t.region.filter(r < 4).select(
        F.when(r == 1, "own-1").otherwise(F.concat(F.lit("manual-"), r.cast("string"))).alias("group_id"), F.lit(2).cast("long").alias("seq"), F.lit("create").alias("kind"),
        F.when(r == 0, " ").otherwise("First").alias("display_name"))
    again = t.region.filter(r >= 3).select(F.concat(F.lit("manual-"), r.cast("string")).alias("group_id"), F.lit(3).cast("long").alias("seq"), F.lit("rename").alias("kind"), F.lit("Second").alias("display_name"))
    named = groups.filter(F.col("group_key").endswith("7") | ~F.col("kind").isin("named")).select(
        "group_id", F.lit(1).cast("long").alias("seq"), F.lit("rename").alias("kind"), F.concat(F.lit("Renamed "), "label").alias("display_name"))
    return made.unionByName(again).unionByName(named)


@query(
    "edits_group_conflicts", "slips",
    f"""with {_OLD} select case when r_regionkey=1 then 'own-1' else concat('manual-', r_regionkey) end as group_id,
      case r_regionkey when 0 then 'invalid_edit' when 1 then 'invalid_group_id' else 'unknown_group' end as conflict from region where r_regionkey in (0,1,4)
    union all select concat('group_', substr(sha256(concat('{{"job":"job","key":"', group_key, '","kind":"', route, '"}}')), 1, 32)), 'fixed_group'
      from (select distinct route, group_key from old where route not in ('excluded','named'))""")
def _(t):
    groups = route.build_groups(route.derive_route(_base(t), ACCOUNT)).select("group_id", "kind", "group_key", "label")
    return ed.edit_groups(groups, _group_edits(t, groups))[1]


@query(
    "edits_conflicts", "slips",
    f"""with {_OLD}, m as (select *, segment_id%8 as k from old), c as (
      select segment_id, case when k=0 then 'basis_changed' when k=1 then 'duplicate_edit' when k=2 then 'invalid_edit'
        when route='excluded' and k in (3,4) then 'excluded_slip' when k=5 and route<>'excluded' then 'extraction_pending'
        when k=5 then 'excluded_slip'
        when k in (3,4) and route_reason='batch_identity_conflict' then 'identity_conflict'
        when k=3 and segment_id%3=0 then 'unknown_group' when k=3 and route='internal' then 'not_assignable' end as conflict from m where k<=5)
    select segment_id, conflict from c where conflict is not null union all select -o_orderkey, 'unknown_slip' from orders where o_orderkey%8=6""")
def _(t):
    """A refusal of every sort: old basis, contradiction, nonsense, excluded, unread, conflicting, and unknown slips and groups."""
    k = _number() % 8
    name = {"kind": "field", "state": "present", "side": "counterparty", "field": "name"}
    slips = t.slips.unionByName(t.slips.filter(k == 6).withColumn("segment_id", -_number()))
    log = _rows(
        slips, (k == 0, {"kind": "clear_confirm", "seq": 1, "expected_basis": "old"}), (k == 0, {"kind": "clear_assign", "seq": 2}),
        (k == 1, {**name, "seq": 1, "value": "A"}), (k == 1, {**name, "seq": 1, "value": "B"}), (k == 2, {**name, "seq": 1, "value": ""}),
        (k == 3, {"kind": "assign", "seq": 1, "group_id": F.when(_number() % 3 == 0, "manual-9").otherwise("manual-1")}),
        (k == 4, {**name, "seq": 3, "value": "Third Co"}), (k == 5, {**name, "seq": 3, "value": "Third Co"}), (_number() < 0, {"kind": "clear_fields", "seq": 1}))
    return _apply(t, log, _base(t).withColumn("extraction_ready", k != 5)).conflicts
