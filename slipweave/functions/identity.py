"""Content digests and stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(**parts: Column) -> Column:
    """SHA-256 of canonical JSON: keys in order, NULLs kept."""
    ordered = F.struct(*[parts[k].alias(k) for k in sorted(parts)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def instance_id(sha: Column, page: Column, layout: Column, revision: Column, slot: Column) -> Column:
    return F.concat_ws(":", F.lit("receipt-v1"), sha, page.cast("string"), layout, revision.cast("string"), slot)


def stable_identity(
    source_id: Column, sha: Column, page: Column, segment_no: Column, slot: Column, rect: list[Column], semantic: Column
) -> Column:
    """Identity that survives a layout revision of the same slip."""
    x0, y0, x1, y1 = rect
    return digest(
        source_id=source_id, sha=sha, page=page, segment_no=segment_no, slot=slot,
        x0=x0, y0=y0, x1=x1, y1=y1, semantic=semantic,
    )


def group_id(job: Column, kind: Column, key: Column) -> Column:
    return F.concat(F.lit("group_"), F.substring(digest(job=job, kind=kind, key=key), 1, 32))


def geometry_fingerprint(width: Column, height: Column, rect: list[Column]) -> Column:
    """Page size and rectangle rounded to .001 as text; a value that is not positive is ``unknown``."""

    def rounded(c: Column) -> Column:
        r = F.floor(c * 1000 + 0.5) / 1000
        text = F.when(r == F.floor(r), F.floor(r).cast("string")).otherwise(r.cast("string"))
        return F.when(c > 0, text).otherwise(F.lit("unknown"))

    return F.concat(
        F.lit("geometry:"), rounded(width), F.lit("x"), rounded(height), F.lit(":"),
        F.concat_ws(",", *[rounded(c) for c in rect]),
    )
