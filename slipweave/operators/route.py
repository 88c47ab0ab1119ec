"""Own side, counterparty, route and group of every slip.

A slip is one wide row: ``{payer,payee}_{name,account,bank}`` with ``…_state``, ``source_bank``,
``source_state``, ``excluded``, ``document_type``, ``type_confirmed``, ``service_type`` and the
manual layer ``confirm_side``, ``assigned_group`` and ``o_{side}_{field}[_state]`` overrides.
Missing optional columns count as NULL. The decision is one projection without a shuffle.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipweave.functions import identity
from slipweave.functions import text as tx
from slipweave.functions.settle import settle
from slipweave.schema import FIELDS, SIDES

OPTIONAL = {
    "document_type": "string", "type_confirmed": "boolean", "service_type": "string", "confirm_side": "string",
    "assigned_group": "string", "assigned_kind": "string", "assigned_key": "string", "assigned_label": "string",
    "excluded": "boolean", "job_id": "string",
    **{f"o_{s}_{f}{e}": "string" for s in (*SIDES, "counterparty") for f in FIELDS for e in ("", "_state")},
    **{f"{s}_observed_{f}{e}": "string" for s in ("own", "counterparty") for f in FIELDS for e in ("", "_state")},
}
HARD_CONFLICTS = (
    "source_bank_mismatch", "own_company_mismatch", "own_account_mismatch", "both_sides_match_our_account", "own_side_conflict",
)
SERVICE_TYPES = ("bank_fee", "deposit_interest")
ROUTED = ("own_side", "own_method", "bank_status", "reasons", "route", "route_reason", "group_id", "group_key", "group_label", "decision_method",
          "counterparty_name", "counterparty_name_state", "counterparty_account", "counterparty_account_state", "counterparty_bank", "counterparty_bank_state")


def with_optional(slips: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in slips.columns}
    return slips.withColumns(missing) if missing else slips


def _merge(cur: Column, cur_state: Column, new: Column, new_state: Column, keep: Column) -> tuple[Column, Column]:
    """Printed counterparty text over the read one: fills gaps, keeps agreement, marks conflict."""
    skip = keep | F.coalesce(new_state == "missing", F.lit(True))
    same = (cur_state == new_state) & (tx.no_space(cur) == tx.no_space(new))
    value = F.when(skip, cur).when(cur_state == "missing", new).when(same, cur).otherwise(F.concat_ws(" | ", cur, new))
    state = F.when(skip, cur_state).when(cur_state == "missing", new_state).when(same, cur_state).otherwise(F.lit("ambiguous"))
    return value, state


def normal_account(account: Mapping[str, str]) -> dict[str, str]:
    """The own profile in the normal form of the fields it is compared with: widths folded, composed, spaces collapsed or removed."""

    def text(value: str) -> str:
        narrow = "".join(chr(ord(ch) - 0xFEE0) if 0xFF01 <= ord(ch) <= 0xFF5E else " " if ch == "\u3000" else ch for ch in value)
        return " ".join(unicodedata.normalize("NFC", narrow).split())

    return {**account, "company_name": text(account["company_name"]), "bank_name": text(account["bank_name"]), "account_number": text(account["account_number"]).replace(" ", "")}


def composed_slips(slips: DataFrame) -> DataFrame:
    """``slips`` with all texts a decision reads composed; they are read twice."""
    texts = [c for c in (*[f"{p}{s}_{f}" for s in SIDES for f in FIELDS for p in ("", "o_")], *[f"o_counterparty_{f}" for f in FIELDS],
                         *[f"{s}_observed_{f}" for s in ("own", "counterparty") for f in FIELDS], "source_bank") if c in slips.columns]
    return tx.composed(slips, texts)


def derive_route(slips: DataFrame, account: Mapping[str, str], compose: bool = True) -> DataFrame:
    """Decide own side, reasons, route and group of each slip against one own account.

    ``compose`` runs NFC on the texts; leave it off for text composed on the way in. One look per slip tells
    whether any of its texts needs it; the others stay in the JVM, and ``slips`` is read twice.
    """
    account = normal_account(account)
    if compose:
        slips = composed_slips(slips)
        compose = False
    have = set(slips.columns)

    def col(name: str) -> Column:
        """A column, or a typed NULL for an absent optional one, which then folds away."""
        return F.lit(None).cast(OPTIONAL[name]) if name in OPTIONAL and name not in have else F.col(name)

    df = slips
    company = F.lit(account["company_name"])
    number = F.lit(account["account_number"])

    # Overrides onto the party fields, then one normal form per field.
    steps: dict[str, Column] = {}
    for s in SIDES:
        for f in FIELDS:
            raw = F.coalesce(col(f"o_{s}_{f}"), f"{s}_{f}", F.lit(""))
            state = F.coalesce(col(f"o_{s}_{f}_state"), f"{s}_{f}_state")
            value = tx.norm_account(raw, compose) if f == "account" else tx.norm_name(raw, compose)
            steps[f"_{s}_{f}"] = value
            steps[f"_{s}_{f}_state"] = state
    df = settle(df, steps)
    partial = {f"_{s}_account_state": F.when((col(f"_{s}_account_state") == "present") & ~tx.full_account(col(f"_{s}_account")), "ambiguous").otherwise(col(f"_{s}_account_state")) for s in SIDES}
    df = settle(df, partial)

    present = {(s, f): (col(f"_{s}_{f}_state") == "present") & (col(f"_{s}_{f}") != "") for s in SIDES for f in FIELDS}
    full = {s: F.when(present[s, "account"], col(f"_{s}_account")) for s in SIDES}
    match = {s: F.coalesce(full[s] == number, F.lit(False)) for s in SIDES}
    named = {s: F.coalesce(present[s, "name"] & (col(f"_{s}_name") == company), F.lit(False)) for s in SIDES}
    confirm = col("confirm_side")

    # Source bank.
    bank = tx.norm_name(F.coalesce("source_bank", F.lit("")), compose)
    known = col("source_state").isin("present", "confirmed") & (bank != "") & ~tx.no_space(bank).isin(*tx.BANK_CHANNELS)
    ours = F.lit(account["bank_name"])
    bank_status = (
        F.when(col("source_state") == "mismatch", "mismatch")
        .when(
            known,
            F.when(tx.rural_unspecified(bank, ours), "unknown")
            .when(tx.bank_key(bank, False) == tx.bank_key(ours, False), "matched")
            .otherwise("mismatch"),
        )
        .when(confirm.isNotNull(), "manual")
        .otherwise("unknown")
    )

    # Own side: account first, then the manual side, then a unique company name.
    both, one = match["payer"] & match["payee"], match["payer"] != match["payee"]
    by_account = F.when(match["payer"], "payer").otherwise("payee")
    one_name = named["payer"] != named["payee"]
    by_name = F.when(named["payer"], "payer").otherwise("payee")
    none = ~match["payer"] & ~match["payee"]
    side = (
        F.when(both, F.lit(None).cast("string")).when(one, by_account).when(confirm.isNotNull(), confirm)
        .when(none & one_name, by_name)
    )
    method = (
        F.when(both, "none").when(one, F.when(confirm.isNotNull(), "manual").otherwise("account_match"))
        .when(confirm.isNotNull(), "manual").when(none & one_name, "batch_profile").otherwise("none")
    )
    df = settle(df, {"bank_status": bank_status, "own_side": side, "_method": method, "_both_names": named["payer"] & named["payee"]})

    def mine(f: str) -> Column:
        return F.when(col("own_side") == "payer", col(f"_payer_{f}")).when(col("own_side") == "payee", col(f"_payee_{f}"))

    my_account = F.when(col("own_side") == "payer", full["payer"]).when(col("own_side") == "payee", full["payee"])
    by_manual = none & confirm.isNotNull()
    undecided = none & confirm.isNull()
    all_full = full["payer"].isNotNull() & full["payee"].isNotNull()
    any_full = full["payer"].isNotNull() | full["payee"].isNotNull()
    found_by_name = undecided & one_name & F.coalesce(my_account != number, F.lit(False))
    wrong_account = (by_manual & F.when(confirm == "single", any_full).otherwise(F.coalesce(my_account != number, F.lit(False)))) | (
        undecided & all_full
    ) | found_by_name
    own_key = tx.no_space(F.coalesce(col("own_observed_name"), F.lit("")))
    seen_account = tx.no_space(F.coalesce(col("own_observed_account"), F.lit("")))
    seen_name_differs = (col("own_observed_name_state") == "present") & (own_key != tx.no_space(company))
    seen_account_differs = (col("own_observed_account_state") == "present") & seen_account.rlike("^[0-9]+$") & (seen_account != number)
    company_differs = (mine("name_state") == "present") & (mine("name") != "") & (mine("name") != company)
    reason = lambda name, cond: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    reasons = F.array_distinct(
        F.array_compact(
            F.array(
                reason("source_bank_mismatch", col("bank_status") == "mismatch"),
                reason("source_bank_unknown", col("bank_status") == "unknown"),
                reason("both_sides_match_our_account", both),
                reason("own_side_conflict", one & confirm.isNotNull() & (confirm != by_account)),
                reason("own_account_missing", undecided & ~all_full),
                reason("own_account_mismatch", wrong_account),
                reason("own_company_mismatch", company_differs),
                reason("own_company_ambiguous", mine("name_state") == "ambiguous"),
                reason("own_company_mismatch", seen_name_differs),
                reason("own_account_mismatch", seen_account_differs),
            )
        )
    )
    df = settle(df, {"reasons": reasons})
    sure = col("own_side").isNotNull() & (F.size("reasons") == 0) & col("bank_status").isin("matched", "manual")

    # Counterparty: the other side, then what was printed about it, then its overrides.
    cp: dict[str, Column] = {}
    for f in FIELDS:
        other = F.when(col("own_side") == "payer", col(f"_payee_{f}")).when(col("own_side") == "payee", col(f"_payer_{f}"))
        other_state = F.when(col("own_side") == "payer", col(f"_payee_{f}_state")).when(col("own_side") == "payee", col(f"_payer_{f}_state"))
        lone, lone_state = F.coalesce(col(f"o_counterparty_{f}"), F.lit("")), F.coalesce(col(f"o_counterparty_{f}_state"), F.lit("missing"))
        if f == "name":
            both_ours = col("own_side").isNull() & col("_both_names")
            lone = F.when(both_ours, col("_payer_name")).otherwise(lone)
            lone_state = F.when(both_ours, "present").otherwise(lone_state)
        sided = col("own_side").isin("payer", "payee")
        base, base_state = F.when(sided, other).otherwise(lone), F.when(sided, other_state).otherwise(lone_state)
        other_over = F.when(col("own_side") == "payer", col(f"o_payee_{f}_state")).when(col("own_side") == "payee", col(f"o_payer_{f}_state"))
        guarded = other_over.isNotNull() | col(f"o_counterparty_{f}_state").isNotNull()
        value, state = _merge(base, base_state, F.coalesce(col(f"counterparty_observed_{f}"), F.lit("")), col(f"counterparty_observed_{f}_state"), guarded)
        value = F.when(col(f"o_counterparty_{f}_state").isNotNull(), col(f"o_counterparty_{f}")).otherwise(value)
        state = F.coalesce(col(f"o_counterparty_{f}_state"), state)
        cp[f"counterparty_{f}"] = tx.norm_account(value, False) if f == "account" else tx.norm_name(value, False)
        cp[f"counterparty_{f}_state"] = state
    df = settle(df, {**cp, "_renamed": F.coalesce(col("o_counterparty_name_state"), F.when(col("own_side") == "payer", col("o_payee_name_state")).when(col("own_side") == "payee", col("o_payer_name_state"))).isNotNull()})
    name, name_state = col("counterparty_name"), col("counterparty_name_state")

    # Route: the first rule that applies.
    special = F.when(col("document_type").isin("", "ordinary"), F.lit(None)).otherwise(col("document_type"))
    conflicts = F.filter("reasons", lambda r: r.isin(*HARD_CONFLICTS) & ~((r == "both_sides_match_our_account") & col("_both_names")))
    loose_name = ~F.coalesce(col("own_side").isin(*SIDES), F.lit(False)) & (
        col("_payer_name_state").isin("present", "ambiguous") | col("_payee_name_state").isin("present", "ambiguous")
    )
    service = (
        col("service_type").isin(*SERVICE_TYPES) & special.isNull() & name_state.isin("missing", "blank") & ~loose_name & ~col("_renamed")
    )
    has_name = (name_state == "present") & (name != "")
    rule = (
        F.when(F.coalesce(col("excluded"), F.lit(False)), "excluded")
        .when(special.isNotNull() & F.coalesce(col("type_confirmed"), F.lit(False)), "special")
        .when(F.size(conflicts) > 0, "conflict")
        .when(has_name & (name == company), "internal")
        .when(col("assigned_group").isNotNull() & (col("assigned_kind") == "named"), "assigned")
        .when(service, "service")
        .when((name_state == "blank") & (name == ""), "blank")
        .when(~has_name, "unnamed")
        .otherwise("named")
    )
    df = settle(df, {"_rule": rule})
    r = col("_rule")
    pending = r.isin("conflict", "unnamed")
    route = F.when(pending, "counterparty_pending").when(r == "assigned", "named").when(r == "service", "special").otherwise(r)
    kind = F.when(r == "service", col("service_type")).otherwise(special)
    key = (
        F.when(r == "excluded", F.lit(None).cast("string"))
        .when(r.isin("special", "service"), F.concat(F.lit("special:"), kind))
        .when(pending, "counterparty_pending").when(r == "internal", F.concat(F.lit("internal:"), company))
        .when(r == "assigned", col("assigned_key")).when(r == "blank", "blank").otherwise(F.concat(F.lit("counterparty:"), name))
    )
    label = (
        F.when(r == "excluded", "已排除").when(r.isin("special", "service"), tx.type_label(kind)).when(pending, "对手待确认")
        .when(r == "internal", company).when(r == "assigned", col("assigned_label")).when(r == "blank", "对方名称为空").otherwise(name)
    )
    why = (
        F.when(r == "excluded", "excluded_by_review").when(r == "conflict", "batch_identity_conflict")
        .when(r == "unnamed", F.when(name_state == "ambiguous", "counterparty_name_ambiguous").otherwise("counterparty_name_missing"))
        .otherwise("")
    )
    df = settle(df, {"route": route, "group_key": key, "group_label": label, "route_reason": why})
    return settle(
        df,
        {
            "own_method": F.when(sure, col("_method")).otherwise("batch_profile"),
            "reasons": F.array_join("reasons", ","),
            "decision_method": F.when(r == "assigned", "manual").when(r.isin("excluded", "conflict", "unnamed"), "none").otherwise("automatic"),
            "group_id": F.when(r == "assigned", col("assigned_group")).when(
                r != "excluded", identity.group_id(F.coalesce(col("job_id"), F.lit("")), col("route"), col("group_key"))
            ),
        },
    ).drop(*[c for c in df.columns if c.startswith("_")])


def keep_routed(df: DataFrame, keys: Sequence[str] = ("segment_id",)) -> DataFrame:
    return df.select(*keys, *ROUTED)


def build_groups(routed: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Distinct groups with their sizes; a manual rename changes the label, never the key."""
    groups = (
        routed.filter("group_id is not null")
        .groupBy("group_id")
        .agg(F.min("route").alias("kind"), F.min("group_key").alias("group_key"), F.min("group_label").alias("label"), F.count(F.lit(1)).alias("slips"))
    )
    if manual is None:
        return groups.withColumn("manual", F.lit(False))
    names = manual.select("group_id", F.col("display_name").alias("_name"))
    fixed = F.col("kind").isin("internal", "special", "counterparty_pending", "blank")
    renamed = F.col("_name").isNotNull() & ~fixed
    return groups.join(names, "group_id", "left").select(
        "group_id", "kind", "group_key", F.when(renamed, F.col("_name")).otherwise(F.col("label")).alias("label"), "slips", renamed.alias("manual")
    )


def route_counts(routed: DataFrame) -> DataFrame:
    """Totals of a run and whether it is ready.

    An own side is confirmed where it is decided without a reason against it and the bank fits. Assigned
    are all slips with a route of their own. ``extraction_state`` is optional; without it nothing is pending or stale.
    """
    state = F.col("extraction_state") if "extraction_state" in routed.columns else F.lit("ready")
    live = F.col("route") != "excluded"
    confirmed = F.col("own_side").isNotNull() & (F.col("reasons") == "") & F.col("bank_status").isin("matched", "manual")
    counts = routed.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~live).alias("excluded"),
        F.count_if(live & state.isin("pending", "failed")).alias("extraction_pending"),
        F.count_if(live & ~F.coalesce(confirmed, F.lit(False))).alias("own_pending"),
        F.count_if(F.col("route") == "counterparty_pending").alias("counterparty_pending"),
        F.count_if(~F.col("route").isin("excluded", "counterparty_pending", "own_pending")).alias("assigned"),
        F.count_if(live & (state == "stale")).alias("stale"),
    )
    open_ = F.col("extraction_pending") + F.col("own_pending") + F.col("counterparty_pending") + F.col("stale")
    return counts.withColumn("status", F.when(open_ == 0, "ready").otherwise("needs_confirmation"))


def switch_account(slips: DataFrame, account: Mapping[str, str]) -> DataFrame:
    """Decide again for another own account; extraction stays, the manual layer goes."""
    manual = [c for c in slips.columns if c.startswith(("o_", "assigned_")) or c == "confirm_side"]
    return derive_route(slips.drop(*manual), account)


def refresh(routed: DataFrame, slips: DataFrame, account: Mapping[str, str], version: str, selected: DataFrame | None = None) -> DataFrame:
    """Recompute rows of another or no version (or listed ones); the rest pass through untouched."""
    stale = ~F.col("version").eqNullSafe(F.lit(version))
    if selected is not None:
        routed = routed.join(selected.select("segment_id").distinct().withColumn("_sel", F.lit(True)), "segment_id", "left")
        stale = stale | F.coalesce("_sel", F.lit(False))
    old = routed.filter(stale).select("segment_id").distinct()
    fresh = keep_routed(derive_route(slips.join(old, "segment_id", "left_semi"), account)).withColumn("version", F.lit(version))
    kept = routed.filter(~stale).drop("_sel")
    cols = ["segment_id", *[c for c in ROUTED if c in kept.columns], "version"]
    return kept.select(*cols, F.lit(False).alias("recomputed")).unionByName(fresh.select(*cols, F.lit(True).alias("recomputed")))


def apply_edits(slips: DataFrame, edits: DataFrame, groups: DataFrame, account: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Apply one counterparty-name correction and/or assignment per slip.

    ``edits(segment_id, expected_basis, name_value, name_state, clear_name, assign_group, clear_assignment)``
    against ``slips`` with ``basis`` and ``extraction_ready``. Returns (routed, conflicts). A
    changed name drops the earlier assignment; re-sending an equal one drops nothing. Excluded
    slips reject names and assignments; internal and special slips cannot be assigned. ``routed`` holds every
    slip: those whose edit is refused, and excluded ones, as they were.
    """
    # Texts are composed once, before the slips are joined and decided; whether a name changed is told by the texts as they came.
    columns = with_optional(slips).columns
    kept = slips.withColumn("e_was_name", F.col("o_counterparty_name") if "o_counterparty_name" in slips.columns else F.lit(None).cast("string"))
    df = with_optional(composed_slips(kept))
    e = tx.composed(edits.withColumn("name_text", F.col("name_value")), ["name_text"])
    e = e.select("segment_id", *[F.col(c).alias("e_" + c) for c in e.columns if c != "segment_id"])
    many = e.groupBy("segment_id").agg(F.count(F.lit(1)).alias("_edits"))
    # Only edited slips are decided twice. Of several edits of one slip none is taken, so it does not matter which stands for them.
    rows = df.join(e.dropDuplicates(["segment_id"]), "segment_id").join(many, "segment_id")
    untouched = df.join(many.select("segment_id"), "segment_id", "left_anti")
    g = groups.select(F.col("group_id").alias("e_assign_group"), F.col("kind").alias("_kind"), F.col("group_key").alias("_key"), F.col("label").alias("_label"))
    rows = rows.join(g, "e_assign_group", "left")
    new, came = [F.when(F.coalesce("e_clear_name", F.lit(False)), F.lit(None)).otherwise(F.coalesce(*c)) for c in (("e_name_text", "o_counterparty_name"), ("e_name_value", "e_was_name"))]
    new_state = F.when(F.coalesce("e_clear_name", F.lit(False)), F.lit(None)).otherwise(F.coalesce("e_name_state", "o_counterparty_name_state"))
    changed = ~came.eqNullSafe(F.col("e_was_name")) | ~new_state.eqNullSafe(F.col("o_counterparty_name_state"))
    edited = F.col("_edits").isNotNull()
    named = edited & changed & (new_state == "present")
    assign = F.col("e_assign_group").isNotNull()
    drop = changed | F.coalesce("e_clear_assignment", F.lit(False))
    tried = rows.withColumns(
        {
            "e_named": F.coalesce(named, F.lit(False)), "e_assign": assign, "e_drop": F.coalesce(drop, F.lit(False)) & edited,
            "e_edits": F.col("_edits"), "e_kind": F.col("_kind"), "e_key": F.col("_key"), "e_label": F.col("_label"),
            "e_old_group": F.col("assigned_group"), "e_old_name": F.col("o_counterparty_name"), "e_old_state": F.col("o_counterparty_name_state"),
            "e_new_name": new, "e_new_state": new_state,
        }
    ).withColumns({"o_counterparty_name": F.col("e_new_name"), "o_counterparty_name_state": F.col("e_new_state"), "assigned_group": F.lit(None).cast("string")})
    basis = derive_route(tried, account, compose=False)
    wants = F.col("e_named") | F.col("e_assign")
    auto_service = (F.col("route") == "special") & F.coalesce(F.col("document_type").isin("", "ordinary"), F.lit(True)) & (F.col("counterparty_name_state") == "blank")
    problem = (
        F.when(F.col("e_edits") > 1, "duplicate_edit")
        .when(F.col("e_edits").isNotNull() & ~F.col("e_expected_basis").eqNullSafe(F.col("basis")), "basis_changed")
        .when((F.col("route") == "excluded") & (F.col("e_assign") | (F.col("e_name_state") == "present")), "excluded_slip")
        .when(wants & ~F.col("extraction_ready") & (F.col("route") != "excluded"), "extraction_pending")
        .when(wants & (F.col("route_reason") == "batch_identity_conflict"), "identity_conflict")
        .when(F.col("e_named") & (F.col("route") == "special"), "special_not_renamed")
        .when(F.col("e_assign") & F.col("e_kind").isNull(), "unknown_group")
        .when(F.col("e_assign") & ((F.col("route") == "internal") | ((F.col("route") == "special") & ~auto_service) | (F.col("e_kind") != "named")), "not_assignable")
    )
    judged = basis.withColumn("conflict", problem)
    conflicts = judged.filter("conflict is not null").select("segment_id", "conflict")
    # What is refused, and what an edit cannot change, stays as it was.
    taken = F.col("conflict").isNull() & (F.col("route") != "excluded")
    group = F.when(F.col("e_assign"), F.col("e_assign_group")).when(~F.col("e_drop"), F.col("e_old_group"))
    assigned = taken & F.col("e_assign")
    resolved = judged.withColumns(
        {
            "o_counterparty_name": F.when(taken, F.col("e_new_name")).otherwise(F.col("e_old_name")),
            "o_counterparty_name_state": F.when(taken, F.col("e_new_state")).otherwise(F.col("e_old_state")),
            "assigned_group": F.when(taken, group).otherwise(F.col("e_old_group")),
            "assigned_kind": F.when(assigned, F.col("e_kind")).otherwise(F.col("assigned_kind")),
            "assigned_key": F.when(assigned, F.col("e_key")).otherwise(F.col("assigned_key")),
            "assigned_label": F.when(assigned, F.col("e_label")).otherwise(F.col("assigned_label")),
        }
    ).select(*columns)
    return derive_route(untouched.select(*columns).unionByName(resolved), account, compose=False), conflicts


GUIDANCE = (
    ("excluded", "route = 'excluded'", "none"),
    ("source_bank_mismatch", "reasons like '%source_bank_mismatch%'", "check_source_bank"),
    ("both_sides_match_our_account", "reasons like '%both_sides_match_our_account%'", "check_accounts"),
    ("own_side_conflict", "reasons like '%own_side_conflict%'", "check_own_side"),
    ("own_account_mismatch", "reasons like '%own_account_mismatch%'", "check_own_account"),
    ("own_company_mismatch", "reasons like '%own_company_mismatch%'", "check_own_name"),
    ("counterparty_name_ambiguous", "route_reason = 'counterparty_name_ambiguous'", "choose_name"),
    ("counterparty_name_missing", "route_reason = 'counterparty_name_missing'", "enter_name"),
)


def guidance(routed: DataFrame) -> DataFrame:
    """First applicable reason of a pending slip and what to do about it."""
    pending = routed.filter("route in ('counterparty_pending', 'own_pending')")
    reason, action = F.lit("other"), F.lit("review")
    for name, cond, act in reversed(GUIDANCE):
        reason = F.when(F.expr(cond), name).otherwise(reason)
        action = F.when(F.expr(cond), act).otherwise(action)
    return pending.withColumns({"guidance": reason, "action": action})
