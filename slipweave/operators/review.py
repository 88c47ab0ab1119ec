"""Applying append-only review decisions, histories, undo and review views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipweave.functions import identity
from slipweave.functions.numbering import number_rows


def carry_forward_reviews(originals: DataFrame, log: DataFrame) -> DataFrame:
    """Newest applicable decision per slip at its revision.

    ``originals(item_id, shared_key, revision, signature)`` meet
    ``log(item_id, shared_key, revision, signature, scope, review_status)``: the item's row at
    exactly this revision, else its latest earlier one, else the latest ``shared`` row — and
    only while the immutable signature is unchanged. The log is folded before it meets the slips, in one
    ordered pass per item and signature; no row of it is paired with every slip.
    """
    rank = F.struct(F.col("log_revision"), F.col("review_status"))
    own = log.filter("scope = 'item'").select("item_id", "signature", F.col("revision").alias("log_revision"), "review_status")
    # Log rows and slips of an item in order of revision; each slip takes the greatest row passed so far.
    folded = own.groupBy("item_id", "signature", F.col("log_revision").alias("revision")).agg(F.max(rank).alias("_row"))
    asked = originals.select("item_id", "signature", "revision").distinct().withColumn("_asks", F.lit(1))
    order = Window.partitionBy("item_id", "signature").orderBy("revision", F.coalesce("_asks", F.lit(0)))
    passed = folded.unionByName(asked, allowMissingColumns=True).withColumn("_own", F.max("_row").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    asof = passed.filter("_asks = 1").select("item_id", "signature", "revision", "_own")
    shared = (
        log.filter("scope = 'shared'")
        .groupBy("shared_key", "signature")
        .agg(F.max(F.struct(F.col("revision").alias("log_revision"), "review_status")).alias("_shared"))
    )
    rows = originals.join(asof, ["item_id", "signature", "revision"], "left").join(shared, ["shared_key", "signature"], "left")
    best = F.coalesce("_own", "_shared")
    return rows.select(
        "item_id", "revision", best["review_status"].alias("review_status"), best["log_revision"].alias("log_revision"),
        F.when(F.col("_own").isNull(), F.when(F.col("_shared").isNotNull(), "shared"))
        .when(F.col("_own.log_revision") == F.col("revision"), "exact").otherwise("earlier").alias("basis"),
    )


def suggest_legacy(originals: DataFrame, old: DataFrame, key: Sequence[str]) -> DataFrame:
    """Old decisions suggested for new slips where the key is unique on both sides and usable."""
    keys = list(key)
    left = originals.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("segment_id").alias("segment_id")).filter("_n = 1").drop("_n")
    right = old.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"), F.min("review_status").alias("suggested"), F.bool_and("valid").alias("_v"))
    return left.join(right.filter("_m = 1 and _v").drop("_m", "_v"), keys).select("segment_id", "suggested")


def transition(status: Column, wanted: Column, has_geometry: Column) -> Column:
    """Reason a status change is refused, NULL when it is allowed."""
    return (
        F.when((status == "blocked") & ~has_geometry & (wanted != "excluded"), "needs_calibration")
        .when((status == "excluded") & ~wanted.isin("needs_review", "excluded"), "restore_first")
        .when(~wanted.isin("needs_review", "confirmed", "page_confirmed", "excluded"), "unknown_status")
    )


def apply_review(current: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows at their next revision, and refused edits with the reason.

    ``current(segment_id, revision, review_status, rect_ok, document_type)``;
    ``edits(segment_id, expected_revision, review_status, new_rect_ok, document_type)``. A
    change of kind alone keeps the status and the geometry. Two edits of one slip conflict.
    """
    e = edits.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.first(F.struct("expected_revision", F.col("review_status").alias("wanted"), "new_rect_ok", F.col("document_type").alias("new_type"))).alias("_e"),
    )
    rows = e.join(current, "segment_id", "left").select("*", "_e.*")
    wanted = F.coalesce("wanted", "review_status")
    geometry = F.coalesce("new_rect_ok", F.lit(False)) | F.coalesce("rect_ok", F.lit(False))
    refused = (
        F.when(F.col("_n") > 1, "duplicate_edit")
        .when(F.col("revision").isNull(), "unknown_segment")
        .when(F.col("expected_revision") != F.col("revision"), "revision_changed")
        .otherwise(transition(F.col("review_status"), wanted, geometry))
    )
    judged = rows.withColumn("conflict", refused)
    accepted = judged.filter("conflict is null").select(
        "segment_id", (F.col("revision") + 1).alias("revision"), wanted.alias("review_status"),
        F.when(F.col("wanted").isNull(), F.col("rect_ok")).otherwise(geometry).alias("rect_ok"),
        F.coalesce("new_type", "document_type").alias("document_type"),
    )
    return accepted, judged.filter("conflict is not null").select("segment_id", "conflict")


def latest_reviews(log: DataFrame, key: str = "segment_id", revision: str = "record_revision") -> DataFrame:
    """Last row per slip of the append-only log, by partial aggregation."""
    rest = [c for c in log.columns if c not in (key, revision)]
    return log.groupBy(key).agg(F.max(F.struct(revision, *rest)).alias("_r")).select(key, "_r.*")


def history(before: DataFrame, after: DataFrame, key: str, revision: Column, reason: str) -> DataFrame:
    """Before-images of rows that really changed or vanished, stamped with revision and reason."""
    cols = [c for c in before.columns if c != key]
    same = after.select(key, *[F.col(c).alias("_n_" + c) for c in cols], F.lit(True).alias("_there"))
    rows = before.join(same, key, "left")
    equal = F.coalesce("_there", F.lit(False))
    for c in cols:
        equal = equal & F.col(c).eqNullSafe(F.col("_n_" + c))
    return rows.filter(~equal).select(revision.alias("history_revision"), F.lit(reason).alias("reason"), *before.columns)


def undo(current: DataFrame, images: DataFrame, key: str, applied_revision: int) -> tuple[DataFrame, DataFrame]:
    """Restore before-images only where a row still has the applied revision; else a conflict."""
    cols = [c for c in current.columns if c not in (key, "revision")]
    img = images.select(key, *[F.col(c).alias("_b_" + c) for c in cols], F.lit(True).alias("_img"))
    rows = current.join(img, key, "left")
    can = F.coalesce("_img", F.lit(False)) & (F.col("revision") == applied_revision)
    restored = rows.select(
        key, F.when(can, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"),
        *[F.when(can, F.col("_b_" + c)).otherwise(F.col(c)).alias(c) for c in cols],
    )
    moved = rows.filter(F.coalesce("_img", F.lit(False)) & (F.col("revision") != applied_revision)).select(key, F.lit("revision_changed").alias("conflict"))
    gone = images.join(current.select(key), key, "left_anti").select(key, F.lit("row_missing").alias("conflict"))
    return restored, moved.unionByName(gone)


def history_digest(*cols: Column) -> Column:
    return identity.digest(**{f"c{i:02d}": c for i, c in enumerate(cols)})


FILTERS = {
    "all": "true", "needs_review": "review_status in ('needs_review', 'blocked')", "manual": "manual_adjusted", "blocked": "review_status = 'blocked'",
}


def review_view(rows: DataFrame, show: str = "all", source: int | None = None) -> DataFrame:
    """Rows of one filter with a position by confidence, lowest first, non-finite last.

    The order is numbered from counts per confidence band, so no task sorts the whole view.
    """
    kept = rows.filter(FILTERS[show])
    if source is not None:
        kept = kept.filter(F.col("source_id") == source)
    odd = F.isnan("confidence") | F.col("confidence").isNull() | (F.abs("confidence") == float("inf"))
    band = F.when(odd, F.lit(1 << 20)).otherwise(F.floor(F.col("confidence") * 1000))
    levels = [("_band", band), ("_part", F.floor(F.col("segment_id") / 65536))]
    exact = kept.withColumn("_key", F.when(odd, F.lit(0.0)).otherwise(F.col("confidence") * 1000 - F.floor(F.col("confidence") * 1000)))
    # Inside a band finer confidences come first, so the band is cut by them before the id.
    levels.insert(1, ("_fine", F.floor(F.col("_key") * 1024)))
    return number_rows(exact, [], levels, [F.col("_key"), F.col("segment_id")], "position").drop("_key")


def review_facets(rows: DataFrame) -> DataFrame:
    """Counts per filter for every source and for all together (``source_id`` NULL)."""
    return rows.rollup("source_id").agg(*[F.count_if(F.expr(cond)).alias(name) for name, cond in FILTERS.items()])


def _review_key() -> tuple[Column, Column]:
    known = F.col("issuer").isNotNull() & F.col("template").isNotNull()
    key = F.when(known, F.concat_ws("|", "issuer", "template", F.col("position_index").cast("string"))).otherwise(
        F.concat(F.lit("single|"), F.col("segment_id").cast("string"))
    )
    return known, key


def review_members(segments: DataFrame) -> DataFrame:
    """The review group of every slip, with what decides whether the group is done."""
    return segments.select(_review_key()[1].alias("review_key"), "segment_id", "source_id", "confirmed")


def review_groups(segments: DataFrame) -> DataFrame:
    """Groups to check together: same issuer, template and position, or each slip alone.

    Slips without verified layout stay single. Members are rows of :func:`review_members`; here are their counts.
    """
    known, key = _review_key()
    return segments.groupBy(key.alias("review_key")).agg(
        F.count(F.lit(1)).alias("slips"), F.count_if("confirmed").alias("confirmed"), F.max(known).alias("verified"), F.min("source_id").alias("first_source")
    )


def review_rollup(segments: DataFrame) -> DataFrame:
    """Per bank for verified layouts, per source for unknown ones: slips and open slips."""
    known = F.col("issuer").isNotNull() & F.col("template").isNotNull()
    bucket = F.when(known, F.concat(F.lit("bank|"), "issuer")).otherwise(F.concat(F.lit("source|"), F.col("source_id").cast("string")))
    return segments.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("slips"), F.count_if(~F.col("confirmed")).alias("open"))


def group_complete(groups: DataFrame, members: DataFrame, confirmed: DataFrame) -> DataFrame:
    """A group is complete when it has members and all are confirmed and explicitly listed."""
    marks = confirmed.select("segment_id").distinct().withColumn("_listed", F.lit(True))
    state = (
        members.join(marks, "segment_id", "left")
        .groupBy("group_id")
        .agg(F.bool_and((F.col("review_status") == "confirmed") & F.coalesce("_listed", F.lit(False))).alias("_all"))
    )
    return groups.join(state, "group_id", "left").select("group_id", F.coalesce("_all", F.lit(False)).alias("complete"))


def batch_crop_plan(sample: DataFrame, targets: DataFrame) -> DataFrame:
    """Move a sample's corrected rectangle to the slips it fits, relative to their title.

    A sample is one row per (issuer, template, position); protected targets are skipped with
    the first reason that applies.
    """
    s = sample.groupBy("issuer", "template", "position_index").agg(
        F.first(F.struct(F.col("anchor_y").alias("s_anchor"), F.col("x0").alias("s_x0"), F.col("y0").alias("s_y0"), F.col("x1").alias("s_x1"), F.col("y1").alias("s_y1"))).alias("_s")
    )
    rows = targets.join(s, ["issuer", "template", "position_index"], "left").select("*", "_s.*")
    dy = F.col("anchor_y") - F.col("s_anchor")
    top, bottom = F.col("s_y0") + dy, F.col("s_y1") + dy
    reason = (
        F.when(F.col("_s").isNull(), "no_sample").when(F.col("review_status") == "excluded", "excluded").when(F.col("manual_adjusted"), "manual")
        .when(F.col("anchor_y").isNull(), "no_anchor").when((top < 0) | (bottom > F.col("page_height")), "outside_page")
    )
    ok = reason.isNull()
    return rows.select(
        "segment_id", reason.alias("skip_reason"), F.when(ok, F.col("s_x0")).alias("x0"), F.when(ok, top).alias("y0"),
        F.when(ok, F.col("s_x1")).alias("x1"), F.when(ok, bottom).alias("y1"),
    )


def review_set_integrity(documents: DataFrame, hits: DataFrame, segments: DataFrame) -> DataFrame:
    """Violations of a stored review set: counts, identities and per-page numbering."""
    d = documents.select("source_id", "sha256", "hit_count", "segment_count")
    h = hits.groupBy("source_id").agg(F.count(F.lit(1)).alias("_h"))
    per_page = segments.groupBy("source_id", "page").agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct("segment_no").alias("_d"), F.min("segment_no").alias("_lo"), F.max("segment_no").alias("_hi"),
        F.min("sha256").alias("_s0"), F.max("sha256").alias("_s1"),
    )
    s = per_page.groupBy("source_id").agg(
        F.sum("_n").alias("_s"), F.bool_or((F.col("_n") != F.col("_d")) | (F.col("_lo") != 1) | (F.col("_hi") != F.col("_n"))).alias("_bad"),
        F.min("_s0").alias("_s0"), F.max("_s1").alias("_s1"),
    )
    rows = d.join(h, "source_id", "full").join(s, "source_id", "full")
    checks = F.array_compact(
        F.array(
            F.when(F.col("sha256").isNull(), "unknown_source"),
            F.when(F.col("hit_count") != F.coalesce("_h", F.lit(0)), "hit_count"),
            F.when(F.col("segment_count") != F.coalesce("_s", F.lit(0)), "segment_count"),
            F.when((F.col("sha256") != F.col("_s0")) | (F.col("sha256") != F.col("_s1")), "source_hash"),
            F.when(F.col("_bad"), "segment_numbers"),
        )
    )
    return rows.select("source_id", F.explode(checks).alias("violation"))
