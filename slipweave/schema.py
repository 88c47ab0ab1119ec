"""Explicit table schemas; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

RECT = ("x0", "y0", "x1", "y1")
PAGE = ("source_id", "page")
SIDES = ("payer", "payee")
FIELDS = ("name", "account", "bank")
STATES = ("present", "blank", "missing", "ambiguous")

_RECT_FIELDS = [T.StructField(c, T.DoubleType(), False) for c in RECT]

BLOCKS = T.StructType(
    [
        T.StructField("source_id", T.StringType(), False),
        T.StructField("page", T.LongType(), False),
        T.StructField("block_index", T.LongType(), False),
        T.StructField("text", T.StringType(), True),
        *_RECT_FIELDS,
        T.StructField("confidence", T.DoubleType(), True),
        T.StructField("is_watermark", T.BooleanType(), True),
    ]
)

SOURCES = T.StructType(
    [
        T.StructField("source_id", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("sha256", T.StringType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("page_count", T.LongType(), False),
    ]
)

ACCOUNTS = T.StructType(
    [
        T.StructField("account_id", T.LongType(), False),
        T.StructField("company_name", T.StringType(), False),
        T.StructField("bank_name", T.StringType(), False),
        T.StructField("branch_name", T.StringType(), True),
        T.StructField("account_number", T.StringType(), False),
        T.StructField("active", T.BooleanType(), False),
    ]
)

# Caps the batch tool enforces per run; here they are thresholds of a report.
# Fixed values.
LIMITS = {
    "keyword_characters": 512,
    "clauses": 32,
    "pages": 5_000,
    "blocks_per_page": 4_096,
    "page_characters": 4_000_000,
    "total_characters": 64_000_000,
    "block_characters": 65_536,
    "matches": 10_000,
}
