"""Reading positioned text, splitting it into lines, and the source manifest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipweave.functions import text as tx
from slipweave.functions.numbering import number_rows
from slipweave.operators.classify import split_lines
from slipweave.schema import BLOCKS


def read_blocks(spark: SparkSession, path: str, fmt: str = "parquet", columns: Mapping[str, str] | None = None) -> DataFrame:
    """Blocks with the fixed schema; ``columns`` maps block columns to SQL over a foreign table.

    Projections and filters on the result reach the file scan.
    """
    if columns is None:
        return spark.read.schema(BLOCKS).format(fmt).load(path)
    raw = spark.read.format(fmt).load(path)
    return raw.select(*[F.expr(columns.get(f.name, "NULL")).cast(f.dataType).alias(f.name) for f in BLOCKS])


def blocks_to_lines(blocks: DataFrame) -> DataFrame:
    """One row per text line; a block's rectangle is cut into equal heights.

    Watermarks and empty lines are dropped; ``line_no`` keeps its place in the block.
    """
    lines = blocks.filter(~F.col("is_watermark")).withColumn("_l", split_lines(F.col("text")))
    step = (F.col("y1") - F.col("y0")) / F.greatest(F.size("_l"), F.lit(1))
    rest = [c for c in blocks.columns if c not in ("text", "y0", "y1")]
    rows = lines.withColumn("_h", step).select(*rest, "y0", "_h", F.posexplode_outer("_l").alias("_i", "_t"))
    return rows.select(
        *rest, (F.col("_i") + 1).cast("long").alias("line_no"), tx.strip(F.col("_t")).alias("text"),
        (F.col("y0") + F.col("_i") * F.col("_h")).alias("y0"), (F.col("y0") + (F.col("_i") + 1) * F.col("_h")).alias("y1"),
    ).filter("text <> ''")


def words_to_lines(words: DataFrame, keys: Sequence[str] = ("source_id", "page", "block_no", "line_no")) -> DataFrame:
    """Word boxes of one text line joined from left to right under their common rectangle."""
    ordered = F.array_sort(F.collect_list(F.struct("y0", "x0", "word_no", "text")))
    return words.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda w: w["text"]), "").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("words"),
    )


def register_sources(files: DataFrame) -> DataFrame:
    """Manifest of the files of a run: content hash, size and dense import position.

    ``files(path, arrival, content, page_count)``; a logical key (the path, case folded) counts
    once, its first arrival.
    """
    hashed = files.select(
        F.lower("path").alias("source_key"), "path", "arrival", F.sha2(F.col("content"), 256).alias("sha256"),
        F.octet_length("content").cast("long").alias("size"), "page_count",
    )
    first = hashed.groupBy("source_key").agg(F.min(F.struct("arrival", "path", "sha256", "size", "page_count")).alias("_f"), F.count(F.lit(1)).alias("listed"))
    rows = first.select("source_key", "listed", "_f.*")
    return number_rows(rows, [], [("_part", F.floor(F.col("arrival") / 4096))], [F.col("arrival"), F.col("source_key")], "import_position")


def source_integrity(sources: DataFrame, observed: DataFrame) -> DataFrame:
    """Sources that changed, vanished, appeared or occur twice since they were registered."""
    s = sources.groupBy("source_id").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in ("sha256", "size", "page_count")])
    o = observed.groupBy("source_id").agg(*[F.first(c).alias("o_" + c) for c in ("sha256", "size", "page_count")], F.lit(True).alias("_seen"))
    rows = s.join(o, "source_id", "full")
    reason = (
        F.when(F.col("_n").isNull(), "unregistered").when(F.col("_n") > 1, "duplicate").when(F.col("_seen").isNull(), "missing")
        .when(F.col("sha256") != F.col("o_sha256"), "content_changed").when(F.col("size") != F.col("o_size"), "size_changed")
        .when(F.col("page_count") != F.col("o_page_count"), "page_count_changed")
    )
    return rows.select("source_id", reason.alias("reason")).filter("reason is not null")
