"""Many edits of many slips, folded into one state each.

An edit log is a long table, one row per decision: ``segment_id, seq, kind, expected_basis, side, field, value, state,
group_id``. Kinds are

* ``field`` (``side, field, value, state``): a correction; ``clear_field`` (``side, field``) and ``clear_fields`` take corrections back;
* ``confirm`` (``side`` is payer, payee or single) and ``clear_confirm``: whose side is ours;
* ``assign`` (``group_id``) and ``clear_assign``: the group of the slip.

Every decision writes a register, and the last write by ``seq`` is what a register holds. The largest of (seq, content) is
associative and commutative and does not mind repeats, so the whole log folds in one aggregation with partial sums on
the map side: a slip with a great share of all edits is folded where its rows lie. Whether two different contents have the same last
``seq`` is folded along: the largest and the smallest content hash of that ``seq`` must be one. The rows of a slip are one
request, taken or refused as a whole; refusals are rows with a reason.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipweave.functions import text as tx
from slipweave.operators.route import ROUTED, SERVICE_TYPES, derive_route, with_optional
from slipweave.schema import FIELDS, SIDES

PARTIES = (*SIDES, "counterparty")
REGISTERS = [(s, f) for s in PARTIES for f in FIELDS]
#: Kinds of group whose name follows from a rule. Fixed values.
FIXED_KINDS = ("internal", "special", "counterparty_pending", "blank")
CREATED = "manual-"


@dataclass(frozen=True)
class Edited:
    """``routed``: every slip with its decision and ``changed``; ``manual``: the new manual layer of the slips taken;
    ``conflicts``: slips refused; ``groups`` and ``group_conflicts``: the groups after the edits, and group edits refused."""

    routed: DataFrame
    manual: DataFrame
    conflicts: DataFrame
    groups: DataFrame
    group_conflicts: DataFrame


def _last(of: Column, *content: Column) -> tuple[Column, Column]:
    """What the last row among ``of`` says, and whether two rows disagree about it."""
    hashed = F.xxhash64(*content)
    top = F.max(F.when(of, F.struct(F.col("seq"), hashed.alias("h"), F.struct(*content).alias("is"))))
    # Bitwise negation turns the order round, so this largest is the smallest hash of the last seq.
    low = F.max(F.when(of, F.struct(F.col("seq"), F.bitwise_not(hashed).alias("h"))))
    return top, F.coalesce(top["h"] != F.bitwise_not(low["h"]), F.lit(False))


def fold(edits: DataFrame) -> DataFrame:
    """One row per slip: ``w_{side}_{field}``, ``w_confirm``, ``w_assign`` are structs of ``seq`` and ``is``, NULL where nothing was written.

    ``f_basis`` is the basis all rows expect, NULL if they differ; ``f_invalid`` and ``f_clash`` tell of rows that make no sense
    or contradict each other at one ``seq``; ``f_names`` of a counterparty name entered, whatever becomes of it.
    """
    kind, side, field, state = F.col("kind"), F.col("side"), F.col("field"), F.col("state")
    value = tx.strip(F.coalesce("value", F.lit("")))
    place = side.isin(*PARTIES) & field.isin(*FIELDS)
    good = (
        F.when(kind == "field", place & ((state == "present") & (value != "") | (state == "blank") & (value == "")))
        .when(kind == "clear_field", place).when(kind == "confirm", side.isin(*SIDES, "single")).when(kind == "assign", F.col("group_id").isNotNull())
        .otherwise(kind.isin("clear_fields", "clear_confirm", "clear_assign"))
    )
    writes = kind == "field"
    said, says = F.when(writes, value).alias("value"), F.when(writes, state).alias("state")
    found = {}
    for s, f in REGISTERS:
        found[f"w_{s}_{f}"] = _last((kind == "clear_fields") | kind.isin("field", "clear_field") & (side == s) & (field == f), said, says)
    found["w_confirm"] = _last(kind.isin("confirm", "clear_confirm"), F.when(kind == "confirm", side).alias("side"))
    found["w_assign"] = _last(kind.isin("assign", "clear_assign"), F.when(kind == "assign", F.col("group_id")).alias("group_id"))
    basis = F.col("expected_basis")
    folded = edits.groupBy("segment_id").agg(
        *[top.alias(name) for name, (top, _) in found.items()],
        F.array(*[clash for _, clash in found.values()]).alias("_clash"),
        F.when((F.min(basis) == F.max(basis)) & (F.count(basis) == F.count(F.lit(1))), F.min(basis)).alias("f_basis"),
        F.max(~F.coalesce(good, F.lit(False))).alias("f_invalid"),
        F.max(F.coalesce(writes & (side == "counterparty") & (field == "name") & (state == "present"), F.lit(False))).alias("f_names"),
    )
    return folded.withColumn("f_clash", F.array_contains("_clash", True)).drop("_clash")


def edit_groups(groups: DataFrame, edits: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``groups(group_id, kind, group_key, label[, manual])`` with groups created and renamed, and the refusals.

    ``edits(group_id, seq, kind, display_name)`` has kinds ``create`` and ``rename``. A created id begins with ``manual-`` and is new;
    a rename changes the label, never the key, and not that of a kind named by a rule. The last rename counts.
    """
    if "manual" not in groups.columns:
        groups = groups.withColumn("manual", F.lit(False))
    groups = groups.select("group_id", "kind", "group_key", "label", "manual")
    if edits is None:
        return groups, groups.sparkSession.createDataFrame([], "group_id string, conflict string")
    name = tx.strip(F.coalesce("display_name", F.lit("")))
    created, clash = _last(F.col("kind") == "create", name.alias("name"))
    renamed, blurred = _last(F.col("kind") == "rename", name.alias("name"))
    told = edits.groupBy("group_id").agg(
        created.alias("_made"), renamed.alias("_named"), (clash | blurred).alias("_clash"),
        F.max((name == "") | ~F.coalesce(F.col("kind").isin("create", "rename"), F.lit(False))).alias("_invalid"),
    ).withColumnRenamed("group_id", "_id")
    both = groups.join(told, groups.group_id == told["_id"], "full").withColumn("_was", F.col("group_id").isNotNull())
    making = F.col("_made").isNotNull()
    problem = F.when(
        F.col("_id").isNotNull(),
        F.when(F.col("_invalid"), "invalid_edit").when(F.col("_clash"), "duplicate_edit")
        .when(making & F.col("_was"), "group_exists").when(making & ~F.col("_id").startswith(CREATED), "invalid_group_id")
        .when(~F.col("_was") & (~making | (F.col("_named.seq") < F.col("_made.seq"))), "unknown_group")
        .when(F.col("_was") & F.col("kind").isin(*FIXED_KINDS), "fixed_group"),
    )
    judged = both.withColumn("conflict", problem)
    ok = F.col("_id").isNotNull() & F.col("conflict").isNull()
    after = judged.filter(F.col("_was") | ok).select(
        F.coalesce("group_id", "_id").alias("group_id"), F.coalesce("kind", F.lit("named")).alias("kind"), "group_key",
        F.when(ok, F.coalesce("_named.is.name", "_made.is.name")).otherwise(F.col("label")).alias("label"), (ok | F.coalesce("manual", F.lit(False))).alias("manual"),
    )
    return after, judged.filter("conflict is not null").select(F.col("_id").alias("group_id"), "conflict")


def _judged(slips: DataFrame, edits: DataFrame, groups: DataFrame, account: Mapping[str, str]) -> DataFrame:
    """The edited slips decided once, without an assignment, with the new manual layer in ``n_*`` columns and ``conflict``."""
    df = with_optional(slips)
    rows = df.join(fold(edits), "segment_id")
    new: dict[str, Column] = {}
    changed: dict[tuple[str, str], Column] = {}
    for s, f in REGISTERS:
        o, w = f"o_{s}_{f}", F.col(f"w_{s}_{f}")
        new[f"n_{o}"] = F.when(w.isNotNull(), w["is"]["value"]).otherwise(F.col(o))
        new[f"n_{o}_state"] = F.when(w.isNotNull(), w["is"]["state"]).otherwise(F.col(o + "_state"))
        same = F.col(o + "_state").eqNullSafe(w["is"]["state"]) & F.coalesce(o, F.lit("")).eqNullSafe(F.coalesce(w["is"]["value"], F.lit("")))
        changed[s, f] = w.isNotNull() & ~same

    def when_changed(keys: list[tuple[str, str]]) -> Column:
        """The last seq that changed one of these registers."""
        last = [F.when(changed[k], F.coalesce(F.col(f"w_{k[0]}_{k[1]}.seq"), F.lit(0))) for k in keys]
        return F.greatest(*last)

    # A confirmation stands on the payer's and payee's fields, an assignment on all: what changes them later takes it back.
    sides, all_ = when_changed([k for k in REGISTERS if k[0] in SIDES]), when_changed(REGISTERS)
    confirm, assign = F.col("w_confirm"), F.col("w_assign")
    new["n_confirm_side"] = F.when(confirm.isNotNull(), F.when(sides.isNull() | (sides <= confirm["seq"]), confirm["is"]["side"])).when(sides.isNull(), F.col("confirm_side"))
    wanted = F.when(assign.isNotNull() & (all_.isNull() | (all_ <= assign["seq"])), assign["is"]["group_id"])
    new["n_assigned_group"] = F.when(assign.isNotNull(), wanted).when(all_.isNull(), F.col("assigned_group"))
    new["e_assign"] = wanted.isNotNull()
    new["e_named"] = changed["counterparty", "name"] & F.coalesce(F.col("w_counterparty_name.is.state") == "present", F.lit(False))
    rows = rows.withColumns(new)
    names = groups.select(F.col("group_id").alias("n_assigned_group"), F.col("kind").alias("e_kind"), F.col("group_key").alias("e_key"), F.col("label").alias("e_label"))
    rows = rows.join(names, "n_assigned_group", "left")
    layer = [f"o_{s}_{f}{e}" for s, f in REGISTERS for e in ("", "_state")]
    tried = rows.withColumns({**{c: F.col("n_" + c) for c in layer}, "confirm_side": F.col("n_confirm_side"), "assigned_group": F.lit(None).cast("string")})
    basis = derive_route(tried, account)
    ordinary = F.coalesce(F.col("document_type").isin("", "ordinary"), F.lit(True))
    service = (F.col("route") == "special") & ordinary & F.coalesce(F.col("service_type").isin(*SERVICE_TYPES), F.lit(False))
    out, wants = F.col("route") == "excluded", F.col("e_named") | F.col("e_assign")
    fixed = (F.col("route") == "internal") | ((F.col("route") == "special") & ~(service & (F.col("counterparty_name_state") == "blank")))
    problem = (
        F.when(F.col("f_invalid"), "invalid_edit").when(F.col("f_clash"), "duplicate_edit")
        .when(~F.coalesce(F.col("f_basis").eqNullSafe(F.col("basis")) & F.col("f_basis").isNotNull(), F.lit(False)), "basis_changed")
        .when(out & (F.col("w_assign.is.group_id").isNotNull() | F.col("f_names")), "excluded_slip")
        .when(wants & ~out & ~F.coalesce("extraction_ready", F.lit(False)), "extraction_pending")
        .when(wants & (F.col("route_reason") == "batch_identity_conflict"), "identity_conflict")
        .when(F.col("e_named") & (F.col("route") == "special"), "special_not_renamed")
        .when(F.col("e_assign") & F.col("e_kind").isNull(), "unknown_group")
        .when(F.col("e_assign") & (fixed | (F.col("e_kind") != "named")), "not_assignable")
    )
    return basis.withColumns({"conflict": problem, "e_moved": (F.col("e_kind") == "named") & ~out & (F.col("route") != "internal") & ((F.col("route") != "special") | service) & (F.col("route_reason") != "batch_identity_conflict")})


def apply_edit_log(
    slips: DataFrame, routed: DataFrame, edits: DataFrame, groups: DataFrame, account: Mapping[str, str], group_edits: DataFrame | None = None,
) -> Edited:
    """Apply an edit log to decided slips.

    ``slips`` have ``basis``, ``extraction_ready`` and the manual layer so far; ``routed`` is their present decision (``segment_id`` and
    the route columns). Only edited slips are decided again, once; an assignment is laid over that decision. All others, and
    those refused, keep their row of ``routed``. A correction that changes a payer or payee field takes an earlier confirmation back,
    any change an earlier assignment; equal values sent again change nothing. Excluded slips take no assignment and no counterparty name and
    ignore all else. Renamed groups show their new label on every slip.
    """
    after, group_conflicts = edit_groups(groups, group_edits)
    judged = _judged(slips, edits, after, account)
    taken = judged.filter("conflict is null and route <> 'excluded'")
    moved = F.coalesce("e_moved", F.lit(False))
    over = {
        "route": F.lit("named"), "route_reason": F.lit(""), "group_id": F.col("n_assigned_group"), "group_key": F.col("e_key"),
        "group_label": F.col("e_label"), "decision_method": F.lit("manual"),
    }
    shown = taken.select("segment_id", F.struct(*[F.when(moved, over[c]).otherwise(F.col(c)).alias(c) if c in over else F.col(c) for c in ROUTED]).alias("_new"))
    rows = routed.join(shown, "segment_id", "left")
    now = {c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in ROUTED}
    if group_edits is not None:
        labels = after.filter(F.col("manual") & ~F.col("kind").isin("internal", "special")).select(F.col("group_id").alias("_gid"), F.col("label").alias("_shown"))
        rows = rows.select("*", now["group_id"].alias("_gid")).join(labels, "_gid", "left")
        now["group_label"] = F.coalesce("_shown", now["group_label"])
    same = [F.col(c).eqNullSafe(v) for c, v in now.items()]
    changed = ~same[0]
    for s in same[1:]:
        changed = changed | ~s
    others = [c for c in routed.columns if c not in ROUTED]
    result = rows.select(*others, *[v.alias(c) for c, v in now.items()], changed.alias("changed"))
    layer = [f"o_{s}_{f}{e}" for s, f in REGISTERS for e in ("", "_state")]
    manual = taken.select("segment_id", *[F.col("n_" + c).alias(c) for c in layer], F.col("n_confirm_side").alias("confirm_side"), F.col("n_assigned_group").alias("assigned_group"))
    unknown = edits.select("segment_id").distinct().join(slips.select("segment_id"), "segment_id", "left_anti").withColumn("conflict", F.lit("unknown_slip"))
    conflicts = judged.filter("conflict is not null").select("segment_id", "conflict").unionByName(unknown)
    found = result.filter("changed and route = 'named' and group_id is not null").groupBy("group_id").agg(
        F.min("route").alias("kind"), F.min("group_key").alias("group_key"), F.min("group_label").alias("label"))
    fresh = found.join(after.select("group_id"), "group_id", "left_anti").withColumn("manual", F.lit(False))
    return Edited(result, manual, conflicts, after.unionByName(fresh.select(after.columns)), group_conflicts)
