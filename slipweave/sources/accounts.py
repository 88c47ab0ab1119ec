"""Own-account profiles: import preview, commit and listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipweave.functions import text as tx

KEYS = ("company_name", "bank_name", "branch_name", "account_number")


def _shape(df: DataFrame, compose: bool) -> DataFrame:
    parts = [tx.norm_name(F.coalesce(c, F.lit("")), compose) for c in KEYS]
    return df.withColumns(
        {
            "_bank": tx.norm_bank(F.col("bank_name"), compose), "_number": tx.norm_account(F.col("account_number"), compose),
            "_sig": F.concat_ws("\x1f", *parts),
        }
    )


def _valid(compose: bool) -> Column:
    full = [tx.norm_name(F.coalesce(c, F.lit("")), compose) != "" for c in ("company_name", "bank_name")]
    return full[0] & full[1] & F.coalesce(F.col("_number").rlike("^[0-9]{1,128}$"), F.lit(False))


def preview_accounts(rows: DataFrame, existing: DataFrame, compose: bool = True) -> DataFrame:
    """Each import row as ready, duplicate or error.

    Rows of one (bank, account) compare with the accounts on file, active or not, else with the
    first valid row. Both sides are folded to one row per key before the join, and invalid rows
    stay out of it, so a key holding very many rows only widens a split join.
    """
    shaped = _shape(rows, compose).withColumn("_ok", _valid(compose))
    known = _shape(existing, compose).groupBy("_bank", "_number").agg(F.min("_sig").alias("_e0"), F.max("_sig").alias("_e1"))
    first = shaped.filter("_ok").groupBy("_bank", "_number").agg(F.min(F.struct("row_number", "_sig")).alias("_f"))
    keyed = shaped.filter("_ok").join(first.join(known, ["_bank", "_number"], "left"), ["_bank", "_number"])
    on_file = F.col("_e0").isNotNull()
    same_as_file = (F.col("_e0") == F.col("_sig")) & (F.col("_e1") == F.col("_sig"))
    status = (
        F.when(on_file, F.when(same_as_file, "duplicate").otherwise("error"))
        .when(F.col("row_number") == F.col("_f.row_number"), "ready")
        .when(F.col("_sig") == F.col("_f._sig"), "duplicate")
        .otherwise("error")
    )
    judged = keyed.select(*rows.columns, status.alias("status"), F.when(status == "error", "conflict").otherwise("").alias("message"))
    invalid = shaped.filter("not _ok").select(*rows.columns, F.lit("error").alias("status"), F.lit("invalid").alias("message"))
    return judged.unionByName(invalid)


def commit_accounts(rows: DataFrame, existing: DataFrame, compose: bool = True) -> DataFrame:
    """Rows to append; none at all when any row is an error."""
    preview = preview_accounts(rows, existing, compose)
    errors = preview.agg(F.count_if(F.col("status") == "error").alias("n")).scalar()
    return preview.filter((F.col("status") == "ready") & (errors == 0)).drop("status", "message")


def commit_counts(rows: DataFrame, existing: DataFrame, compose: bool = True) -> DataFrame:
    p = preview_accounts(rows, existing, compose).agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("ready", "duplicate", "error")]
    )
    clean = F.col("error") == 0
    return p.select(F.when(clean, F.col("ready")).otherwise(0).alias("created"), F.when(clean, F.col("duplicate")).otherwise(0).alias("skipped"), "error")


def list_accounts(accounts: DataFrame, active_only: bool = True, offset: int = 0, limit: int = 50) -> DataFrame:
    """One ordered page (company, bank, id) with total and next offset."""
    rows = accounts.filter("active") if active_only else accounts
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    page = rows.orderBy("company_name", "bank_name", "account_id").offset(offset).limit(limit)
    return page.withColumns({"total": total, "next_offset": F.when(total > offset + limit, F.lit(offset + limit).cast("long"))})
