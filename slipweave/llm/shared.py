"""Helpers of the training-data operators: column picking, written tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The first column of each exact name, whatever other columns the table has.

    Columns that differ in case only, repeat a name or hold dots would make ``df["text"]`` ambiguous, so the
    columns are taken by position.
    """
    places = [df.columns.index(n) if n in df.columns else -1 for n in names]
    if -1 in places:
        raise ValueError(f"missing columns: {[n for n, p in zip(names, places) if p < 0]}")
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return numbered.select(*[F.col(f"c{p}").alias(n) for n, p in zip(names, places)])


@cache
def _own_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only a local session, whose executors are threads of this process, may do without the setting.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder(spark.sparkContext.applicationId)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, no lineage behind it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are few; beyond that the join shuffles both sides. For written tables of short rows."""
    return F.broadcast(df) if df.count() <= most_rows else dealt(df)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` marked to be dealt out by its join's key instead of being broadcast, whatever size the planner takes it for.

    For tables that grow with the documents. The planner knows a compressed file's bytes and takes a replicated or exploded table for as
    small as its source, so it would send millions of short rows to the driver.
    """
    return df.hint("merge")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` of every node that has an edge; ``root`` is the smallest node of its component.

    ``edges`` has columns ``a, b`` of one comparable type. Large-star and small-star rounds alternate (Kiveris and
    others, 2014): every round is joins and aggregates, the edge table never grows, and it is written to the shared
    folder after each round. A node of very many edges is handled by the aggregate's map-side combine and by the
    join, which may split it. The loop ends when a round changes nothing; that takes about the logarithm of the longest path.
    """
    pairs = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: larger neighbours of a node are hung on the least of its neighbourhood.
        large = both.filter("b > a").join(dealt(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours are hung on the least of them.
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(dealt(small), "a")
        pairs = written(
            linked.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).distinct(),
            "edges",
        )
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        # A forest of stars: every node hangs on one root, and no root hangs on another node.
        if now == before or now[0] == 0:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
