"""Progress, completeness, failures, diagnostics and snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipweave.functions import geometry as g
from slipweave.functions import identity
from slipweave.functions.numbering import number_rows
from slipweave.operators.export import extract_order
from slipweave.session import stage

STATUSES = ("pending", "running", "succeeded", "failed")


def progress(pages: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pages per status, zeros included, and their total; per ``keys`` if given."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return pages.groupBy(*keys).agg(*counts, F.count(F.lit(1)).alias("total"))


def snapshot_complete(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages missing from, repeated in, or outside 1..page_count of their source."""
    seen = pages.groupBy("source_id", "page").agg(F.count(F.lit(1)).alias("_n"))
    wanted = sources.filter("page_count > 0").select("source_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("page_count").cast("long"))).alias("page"))
    lost = wanted.join(seen, ["source_id", "page"], "left_anti").withColumn("problem", F.lit("missing"))
    sized = seen.join(sources.select("source_id", "page_count"), "source_id", "left")
    outside = F.col("page_count").isNull() | (F.col("page") < 1) | (F.col("page") > F.col("page_count"))
    odd = sized.withColumn("problem", F.when(outside, "out_of_range").when(F.col("_n") > 1, "duplicate")).filter("problem is not null")
    return lost.unionByName(odd.select("source_id", "page", "problem"))


def dedupe_failures(failures: DataFrame) -> DataFrame:
    """One row per (source, page, stage, code, message), with the source's import position."""
    return failures.groupBy("source_id", "page", "stage", "code", "message").agg(
        F.min("source_position").alias("source_position"), F.count(F.lit(1)).alias("seen")
    )


def retry_set(pages: DataFrame, max_retries: int) -> DataFrame:
    """Failed pages with retries left, reset to pending with one more attempt counted."""
    again = (F.col("status") == "failed") & (F.col("retry_count") < max_retries)
    return pages.filter(again).withColumns({"status": F.lit("pending"), "retry_count": F.col("retry_count") + 1})


def accept_events(events: DataFrame) -> DataFrame:
    """Judge numbered events in arrival order: only the next number is accepted, none buffered.

    ``events(job_id, arrival, seq[, generation, type])``; every generation of a job counts for itself, and arrivals are unique in it. Verdicts are
    ``accepted``; ``duplicate`` (the number was accepted before); ``out_of_order``; ``completed`` for all that follows an accepted event of that type; ``snapshot_required``
    for an event without a number and all that follows it; ``invalid`` for numbers below one, which change nothing.

    As long as first arrivals come in number order, each number is accepted at its first arrival; that is checked by
    joining each number with its predecessor. Where a number came too early and was sent again, its followers are found by
    doubling pointers (:func:`_followed`). Either way a busy job spreads over many tasks.
    """
    job = ["job_id", "generation"] if "generation" in events.columns else ["job_id"]
    keys = [*job, "seq"]
    first = events.filter("seq >= 1").groupBy(*keys).agg(F.min("arrival").alias("accepted_at"))
    before = first.select(*job, (F.col("seq") + 1).alias("seq"), F.col("accepted_at").alias("_prev"))
    steps = first.join(before, keys, "left").withColumn(
        "_ok", (F.col("seq") == 1) | F.coalesce(F.col("accepted_at") > F.col("_prev"), F.lit(False))
    )
    broken = steps.filter("not _ok").groupBy(*job).agg(F.min(F.struct("seq", "_prev")).alias("_b"))
    chain = steps.join(broken, job, "left").filter(F.col("_b").isNull() | (F.col("seq") < F.col("_b.seq"))).select(*keys, "accepted_at")
    resent = broken.filter("_b._prev is not null").select(*job, F.col("_b.seq").alias("_next"), F.col("_b._prev").alias("_since"))
    # A break counts as re-sent only where the chain really reaches the number before it.
    resent = resent.join(chain.select(*job, (F.col("seq") + 1).alias("_next")), [*job, "_next"], "left_semi")
    late = events.join(resent, job).filter((F.col("arrival") > F.col("_since")) & (F.col("seq") >= F.col("_next")))
    marks = events.join(chain.unionByName(_followed(late.select(*keys, "arrival", "_next"), job)), keys, "left")
    taken = F.coalesce(F.col("arrival") == F.col("accepted_at"), F.lit(False))
    verdict = (
        F.when(F.col("seq").isNull(), "snapshot_required").when(F.col("seq") < 1, "invalid").when(taken, "accepted")
        .when(F.col("accepted_at") < F.col("arrival"), "duplicate").otherwise("out_of_order")
    )
    lost = F.min(F.when(F.col("seq").isNull(), F.col("arrival")))
    over = F.col("type") == "completed" if "type" in events.columns else F.lit(False)
    ends = marks.groupBy(*job).agg(lost.alias("_lost"), F.min(F.when(taken & over, F.col("arrival"))).alias("_over")).filter("_lost is not null or _over is not null")
    after = marks.join(ends, job, "left").withColumn("verdict", verdict)
    cut = F.col("_lost").isNull() | (F.col("_over") < F.col("_lost"))
    closed = F.when(F.col("seq").isNull() | (F.col("arrival") > F.col("_lost")), "snapshot_required").when(cut & (F.col("arrival") > F.col("_over")), "completed")
    return after.withColumn("verdict", F.when(F.col("verdict") == "invalid", "invalid").otherwise(F.coalesce(closed, F.col("verdict")))).drop("accepted_at", "_lost", "_over")


def _followed(late: DataFrame, job: list[str]) -> DataFrame:
    """``seq, accepted_at`` of the numbers accepted from ``_next`` on, for the events that come after the chain so far.

    Every event points to the first later arrival of the next number. The accepted chain starts at the first arrival of ``_next``; it
    is marked by jumping: in each round what is marked marks its pointer's end, and pointers are replaced by their pointers' pointers. So a
    chain of n numbers takes about log2(n) rounds of joins on (job, arrival), whose rows spread over all tasks whatever the job.
    """
    node = [*job, "arrival"]
    late = stage(late)
    starts = late.filter("seq = _next").groupBy(*job, "seq").agg(F.min("arrival").alias("arrival"))
    asked = late.select(*node, (F.col("seq") + 1).alias("_of"), F.lit(False).alias("_is")).unionByName(late.select(*node, F.col("seq").alias("_of"), F.lit(True).alias("_is")))
    ahead = Window.partitionBy(*job, "_of").orderBy("arrival").rowsBetween(1, Window.unboundedFollowing)
    pointers = asked.withColumn("_to", F.min(F.when(F.col("_is"), F.col("arrival"))).over(ahead)).filter("not _is and _to is not null").select(*node, "_to")
    pointers = stage(pointers)
    marked = starts.select(*node)
    while not pointers.isEmpty():
        marked = stage(marked.unionByName(marked.join(pointers, node).select(*job, F.col("_to").alias("arrival"))))
        onward = pointers.select(*job, F.col("arrival").alias("_to"), F.col("_to").alias("_far"))
        pointers = stage(pointers.join(onward, [*job, "_to"]).select(*node, F.col("_far").alias("_to")))
    return late.join(marked, node, "left_semi").select(*job, "seq", F.col("arrival").alias("accepted_at"))


# Reasons that set a slip against our own identity.
IDENTITY_CONFLICTS = ("source_bank_mismatch", "own_company_mismatch", "own_account_mismatch", "both_sides_match_our_account", "own_side_conflict")


def diagnostic_summary(issues: DataFrame, items: DataFrame) -> DataFrame:
    """Counts per issue code, per (field, role, state), per layout, and of all slips.

    ``issues(segment_id, code, field, role, state)``, ``items(segment_id, layout)``. A slip with reasons against our
    own identity and no ``source_conflict`` of its reader counts once as one. Layouts get numbers in the order
    of their first slip, which name them without telling what they are; slips without a layout share ``unknown``.
    """
    identity = F.col("code").isin(*IDENTITY_CONFLICTS)
    read = F.count_if(F.col("code") == "source_conflict")
    conflicts = issues.filter(identity | (F.col("code") == "source_conflict")).groupBy("segment_id").agg(F.greatest(read, F.lit(1)).alias("_n"))
    codes = (
        issues.filter(~identity & (F.col("code") != "source_conflict")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
        .unionByName(conflicts.agg(F.sum("_n").alias("n")).filter("n is not null").select(F.lit("source_conflict").alias("code"), "n"))
    )
    states = issues.filter("state is not null").groupBy("field", "role", "state").agg(F.count(F.lit(1)).alias("n"))
    layouts = items.groupBy(F.coalesce(F.col("layout").cast("string"), F.lit("unknown")).alias("layout")).agg(F.count(F.lit(1)).alias("n"), F.min("segment_id").alias("first"))
    numbered = number_rows(layouts, [], [("_block", F.floor(F.col("first") / 65536))], [F.col("first"), F.col("layout")], "no")
    return (
        codes.select(F.lit("code").alias("kind"), F.col("code").alias("name"), "n")
        .unionByName(states.select(F.lit("field").alias("kind"), F.concat_ws("/", "field", "role", "state").alias("name"), "n"))
        .unionByName(numbered.select(F.lit("layout").alias("kind"), F.concat(F.lit("layout-"), F.col("no").cast("string")).alias("name"), "n"))
        .unionByName(items.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("kind"), F.lit("").alias("name"), "n"))
    )


COLLECTION = ("issue", "bank", "field", "role", "document_type", "layout")


def issue_members(items: DataFrame) -> DataFrame:
    """A row per pending slip and collection it belongs to; a slip without issues has an unsupported layout."""
    pending = items.filter(F.col("route").isin("counterparty_pending", "own_pending"))
    votes = pending.select("segment_id", F.explode_outer("issues").alias("_i"), F.trim("bank").alias("bank"), "document_type", "layout")
    none = F.col("_i").isNull()
    return votes.select(
        "segment_id", F.when(none, "unsupported_layout").otherwise(F.col("_i.code")).alias("issue"), "bank", F.col("_i.field").alias("field"),
        F.when(none, "unknown").otherwise(F.col("_i.role")).alias("role"), "document_type", "layout",
    ).distinct()


def issue_collections(items: DataFrame) -> DataFrame:
    """Collections of pending slips by (issue, bank, field, role, kind, layout), largest first; see :func:`issue_members`."""
    sized = issue_members(items).groupBy(*COLLECTION).agg(F.count(F.lit(1)).alias("items"), F.min("segment_id").alias("first_item"))
    return sized.orderBy(F.desc("items"), "first_item", *COLLECTION)


def rule_result_summary(rows: DataFrame) -> DataFrame:
    """Trial results in the buckets success, pending and skipped, by new name and route."""
    bucket = F.when(F.col("outcome") == "skipped", "skipped").when(F.col("after_route") == "counterparty_pending", "pending").otherwise("success")
    return rows.groupBy(bucket.alias("bucket"), "after_name", "after_route").agg(F.count(F.lit(1)).alias("slips"))


def publish_snapshot(sources: DataFrame, pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """Ordered, identified result rows of complete sources; incomplete sources publish nothing.

    Each row gets its dense position, an id from its identity, a signature of the page analysis
    and the review status it starts with.
    """
    open_sources = snapshot_complete(sources, pages).select("source_id").distinct()
    ready = candidates.join(open_sources, "source_id", "left_anti").join(sources.select("source_id", "sha256", "source_position"), "source_id")
    named = ready.withColumns(
        {
            "item_id": F.substring(identity.digest(sha=F.col("sha256"), page=F.col("page"), position=F.col("position_index"), segment=F.col("segment_id")), 1, 32),
            "analysis": identity.digest(page=F.col("page"), needs_review=F.col("needs_review"), x0=F.col("x0"), y0=F.col("y0"), x1=F.col("x1"), y1=F.col("y1")),
            "review_status": F.when(F.col("needs_review"), "needs_review").otherwise("confirmed"),
        }
    )
    return extract_order(named)


def validate_layouts(layouts: DataFrame) -> DataFrame:
    """Violations of layouts ``(layout_id, page_height, uniform, slots)`` with slots an array of
    ``(slot_id, position_index, top, height)``."""
    rows = layouts.select("layout_id", "page_height", "uniform", F.posexplode("slots").alias("_i", "_s")).select("layout_id", "page_height", "uniform", "_i", "_s.*")
    w = Window.partitionBy("layout_id").orderBy("_i")
    whole = Window.partitionBy("layout_id")
    end = F.col("top") + F.col("height")
    prev = F.lag(end).over(w)
    same_id = F.count(F.lit(1)).over(Window.partitionBy("layout_id", "slot_id")) > 1
    equal = g.near(F.max("height").over(whole), F.min("height").over(whole))
    checks = F.array_compact(
        F.array(
            F.when(F.col("position_index") != F.col("_i") + 1, "order"),
            F.when(same_id, "duplicate_id"),
            F.when(F.col("height") < 12, "too_small"),
            F.when((F.col("top") < 0) | ((end > F.col("page_height")) & ~g.near(end, F.col("page_height"))), "outside_page"),
            F.when((F.col("top") < prev) & ~g.near(F.col("top"), prev), "overlap"),
            F.when(F.col("uniform") & ~equal, "not_uniform"),
        )
    )
    return rows.withColumn("violation", checks).select("layout_id", "slot_id", F.explode("violation").alias("violation"))
