"""Pages and progress events as streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from slipweave.operators.search import Clause, search_clauses


def stream_search(blocks: DataFrame, clauses: Sequence[Clause]) -> DataFrame:
    """Tag blocks of newly landed pages; the clauses are constants of the plan, so no join or state."""
    if not blocks.isStreaming:
        raise ValueError("a streaming table of blocks is expected")
    return search_clauses(blocks, clauses)


def _judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of a micro-batch come in any order, so a job's are put in order of arrival first.

    What one trigger brings for one job must fit in memory; ``maxFilesPerTrigger`` bounds it.
    """
    last, over, lost = state.get if state.exists else (0, False, False)
    pdf = pd.concat(list(batches), ignore_index=True).sort_values("arrival", kind="stable")
    verdicts = []
    for seq, kind in zip(pdf["seq"], pdf["type"]):
        if pd.isna(seq):
            lost, verdict = True, "snapshot_required"
        elif seq < 1:
            verdict = "invalid"
        elif lost or over:
            verdict = "snapshot_required" if lost else "completed"
        elif seq == last + 1:
            last, over, verdict = int(seq), kind == "completed", "accepted"
        else:
            verdict = "duplicate" if seq <= last else "out_of_order"
        verdicts.append(verdict)
    yield pdf[["job_id", "generation", "arrival", "seq"]].assign(seq=pdf["seq"].astype("Int64"), verdict=verdicts)
    state.update((last, over, lost))


def accept_stream(events: DataFrame) -> DataFrame:
    """Accept only the next number of each job and generation, as :func:`audit.accept_events` does; three values of state, nothing is buffered.

    ``events(job_id, arrival, seq[, generation, type])``; without a generation it is 1.
    """
    missing = {c: v for c, v in (("generation", F.lit(1).cast("long")), ("type", F.lit(""))) if c not in events.columns}
    return events.withColumns(missing).groupBy("job_id", "generation").applyInPandasWithState(
        _judge, "job_id long, generation long, arrival long, seq long, verdict string", "last long, over boolean, lost boolean", "append", "NoTimeout"
    )


def merge_progress(latest: DataFrame | None, updates: DataFrame) -> DataFrame:
    """Latest state per page: the highest attempt wins, then the later event."""
    rows = updates if latest is None else latest.unionByName(updates)
    rest = [c for c in rows.columns if c not in ("source_id", "page")]
    return rows.groupBy("source_id", "page").agg(F.max(F.struct("attempt", "event_id", *[c for c in rest if c not in ("attempt", "event_id")])).alias("_s")).select("source_id", "page", "_s.*")


PAGE_RANGE = 4_096


class PageState:
    """Latest state per page and counts per source, as versioned tables of which a batch rewrites only the buckets it touches.

    Under ``path``: ``pages`` (bucketed by source and range of pages, so a giant file spreads), ``sources`` (bucketed by source: pages seen, pages per status,
    the batch that published it), ``published`` (the sources that became full, per batch) and ``manifest`` (which version of each bucket is
    valid). A batch reads the versions its predecessor left and writes its own, the manifest last. So a batch that is run again finds what it
    found before and overwrites what it wrote before, and a source is published by one batch only. Versions that no manifest needs any more are dropped.
    """

    KINDS = ("pages", "sources")
    STATUSES = ("pending", "running", "succeeded", "failed")

    def __init__(self, path: str, sources: DataFrame | None = None, buckets: int = 64):
        self.path, self.sources, self.buckets = path.rstrip("/"), sources, buckets

    def _versions(self, spark: SparkSession, batch_id: int) -> dict[tuple[str, int], int]:
        """(kind, bucket) -> version after ``batch_id``; at most two rows per bucket."""
        if batch_id < 0:
            return {}
        rows = spark.read.schema("kind string, bucket int, v long").parquet(f"{self.path}/manifest/v={batch_id}").collect()
        return {(r.kind, r.bucket): r.v for r in rows}

    def _read(self, spark: SparkSession, kind: str, versions: dict, buckets: Sequence[int] | None = None) -> DataFrame | None:
        named = [f"{self.path}/{kind}/bucket={b}/v={v}" for (k, b), v in sorted(versions.items()) if k == kind and (buckets is None or b in buckets)]
        return spark.read.option("basePath", f"{self.path}/{kind}").parquet(*named).drop("v") if named else None

    def _write(self, df: DataFrame, kind: str, batch_id: int) -> None:
        rows = df.withColumn("v", F.lit(batch_id).cast("long"))
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "v").parquet(f"{self.path}/{kind}")

    def _drop(self, spark: SparkSession, kept: dict, before: dict) -> None:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for (kind, bucket), v in before.items():
            if kept.get((kind, bucket)) != v:
                at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/bucket={bucket}/v={v}")
                at.getFileSystem(conf).delete(at, True)

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        """Take in the page events ``source_id, page, attempt, event_id, status`` of one micro-batch."""
        spark = batch.sparkSession
        versions = self._versions(spark, batch_id - 1)
        if batch_id > 1:
            self._drop(spark, versions, self._versions(spark, batch_id - 2))
        bucket = F.pmod(F.xxhash64("source_id", F.floor(F.col("page") / PAGE_RANGE)), F.lit(self.buckets)).cast("int")
        updates = batch.withColumn("bucket", bucket).persist()
        touched = sorted(r.bucket for r in updates.select("bucket").distinct().collect())
        now = dict(versions)
        if touched:
            old = self._read(spark, "pages", versions, touched)
            self._write(merge_progress(old, updates), "pages", batch_id)
            now.update({("pages", b): batch_id for b in touched})
            new = self._read(spark, "pages", now, touched)
            told = self._counts(new, 1) if old is None else self._counts(new, 1).unionByName(self._counts(old, -1))
            now.update(self._fold_sources(spark, told, versions, batch_id))
        updates.unpersist()
        rows = [(k, b, v) for (k, b), v in now.items()]
        spark.createDataFrame(rows, "kind string, bucket int, v long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={batch_id}")

    def _counts(self, pages: DataFrame, sign: int) -> DataFrame:
        each = [F.count_if(F.col("status") == s).cast("long").alias(s) for s in self.STATUSES]
        counted = pages.groupBy("source_id").agg(F.count(F.lit(1)).alias("pages"), *each)
        return counted.select("source_id", *[(F.col(c) * sign).alias(c) for c in ("pages", *self.STATUSES)])

    def _fold_sources(self, spark: SparkSession, changes: DataFrame, versions: dict, batch_id: int) -> dict[tuple[str, int], int]:
        """Add changed counts to the sources they belong to and publish those that are full now."""
        bucket = F.pmod(F.xxhash64("source_id"), F.lit(self.buckets)).cast("int")
        changes = changes.groupBy("source_id").agg(*[F.sum(c).alias(c) for c in ("pages", *self.STATUSES)])
        # Sources that only share a bucket of pages with those of the batch have not changed.
        changes = changes.filter(" or ".join(f"{c} <> 0" for c in ("pages", *self.STATUSES))).withColumn("bucket", bucket).persist()
        touched = sorted(r.bucket for r in changes.select("bucket").distinct().collect())
        old = self._read(spark, "sources", versions, touched)
        rows = changes.withColumn("published", F.lit(None).cast("long"))
        rows = rows if old is None else rows.unionByName(old)
        sums = rows.groupBy("source_id", "bucket").agg(*[F.sum(c).alias(c) for c in ("pages", *self.STATUSES)], F.max("published").alias("published"))
        if self.sources is not None:
            size = self.sources.select("source_id", "page_count")
            full = F.col("published").isNull() & (F.col("succeeded") == F.col("page_count"))
            sums = sums.join(size, "source_id", "left").withColumn("published", F.when(full, F.lit(batch_id).cast("long")).otherwise(F.col("published"))).drop("page_count")
        self._write(sums, "sources", batch_id)
        now = {("sources", b): batch_id for b in touched}
        written = self._read(spark, "sources", now)
        fresh = (sums if written is None else written).filter(F.col("published") == batch_id).drop("bucket")
        fresh.write.mode("overwrite").parquet(f"{self.path}/published/v={batch_id}")
        changes.unpersist()
        return now

    def pages(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Latest state per page after a batch."""
        return self._read(spark, "pages", self._versions(spark, batch_id)).drop("bucket")

    def counts(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Pages seen and pages per status of every source after a batch, and the batch that published it."""
        return self._read(spark, "sources", self._versions(spark, batch_id)).drop("bucket")


def stream_progress(events: DataFrame, path: str, checkpoint: str, sources: DataFrame | None = None, buckets: int = 64):
    """Fold page events into a :class:`PageState` under ``path``; ``sources(source_id, page_count)`` tell when a source is full.

    Returns the started query.
    """
    state = PageState(path, sources, buckets)
    return events.writeStream.foreachBatch(state.fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
