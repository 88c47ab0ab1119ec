from pyspark.sql import functions as F

from slipweave.operators import audit, search
from slipweave.streaming import progress

CLAUSES = [("include-0", "ab", "include"), ("exclude-0", "z", "exclude")]


def drain(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_stream_search_equals_batch(spark, tmp_path):
    rows = [(1, 1, i, t, 1.0) for i, t in enumerate(["ab", "zab", "none", "ａb"])]
    schema = "source_id long, page long, block_index long, text string, confidence double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    out = progress.stream_search(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), CLAUSES)
    drain(
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True).start()
    )
    key = ["block_index", "query_id"]
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*key).collect()}
    want = {tuple(r) for r in search.search_clauses(spark.createDataFrame(rows, schema), CLAUSES).select(*key).collect()}
    assert got == want and len(want) == 4


def test_accept_stream_equals_batch(spark, tmp_path):
    schema = "job_id long, arrival long, seq long"
    parts = [[(1, 1, 1), (1, 2, 3), (2, 1, 2)], [(1, 3, 2), (2, 2, 1), (1, 4, 2), (1, 5, 3)]]
    out = []
    src = tmp_path / "in"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = progress.accept_stream(spark.readStream.schema(schema).parquet(str(src)))
        drain(
            q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
            .outputMode("append").trigger(availableNow=True).start()
        )
    got = sorted((r.job_id, r.arrival, r.verdict) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = audit.accept_events(spark.createDataFrame(sum(parts, []), schema))
    assert got == sorted((r.job_id, r.arrival, r.verdict) for r in batch.collect())


def test_stream_progress_keeps_latest_attempt(spark, tmp_path):
    schema = "source_id long, page long, attempt int, event_id long, status string"
    src = tmp_path / "in"
    batches = [[(1, 1, 1, 1, "failed"), (1, 2, 1, 2, "succeeded")], [(1, 1, 2, 3, "succeeded"), (1, 2, 1, 2, "succeeded")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        drain(progress.stream_progress(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "t"), str(tmp_path / "c")))
    final = progress.PageState(str(tmp_path / "t")).pages(spark, 1)
    assert sorted((r.page, r.attempt, r.status) for r in final.collect()) == [(1, 2, "succeeded"), (2, 1, "succeeded")]
    counts = audit.progress(final, ["source_id"]).select(F.col("succeeded")).first()
    assert counts.succeeded == 2


def test_accept_stream_orders_a_shuffled_batch(spark, tmp_path):
    schema = "job_id long, arrival long, seq long"
    rows = [(1, i, i) for i in range(1, 401)]
    rows = rows[::-1][:150] + rows[:100][::-1] + rows[100:250]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    drain(
        progress.accept_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    )
    assert {r.verdict for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"accepted"}


def plain_verdicts(rows):
    """The state machine over (job, generation, arrival, seq, type), one event after the other."""
    out, state = {}, {}
    for job, gen, at, seq, kind in sorted(rows, key=lambda r: r[2]):
        last, over, lost = state.get((job, gen), (0, False, False))
        if seq is None:
            v, lost = "snapshot_required", True
        elif seq < 1:
            v = "invalid"
        elif lost or over:
            v = "snapshot_required" if lost else "completed"
        elif seq == last + 1:
            v, last, over = "accepted", seq, kind == "completed"
        else:
            v = "duplicate" if seq <= last else "out_of_order"
        out[job, gen, at], state[job, gen] = v, (last, over, lost)
    return out


EVENTS = "job_id long, generation long, arrival long, seq long, type string"


def test_accepted_events_equal_the_state_machine(spark, tmp_path):
    import random

    rng = random.Random(61)
    rows = []
    for job in range(60):
        for gen in range(2):
            n = rng.randint(1, 40)
            numbers = [rng.randint(0, 8) if rng.random() < 0.5 else i // 2 + 1 for i in range(n)]
            rows += [(job, gen, i, None if rng.random() < 0.01 else s, "completed" if rng.random() < 0.03 else "progress") for i, s in enumerate(numbers)]
    # A busy job whose numbers come three at a time in false order, so that the chain is one of re-sent numbers.
    rows += [(99, 0, 9 * b + 3 * r + k, 3 * b + 3 - k, "progress") for b in range(300) for r in range(3) for k in range(3)]
    want = plain_verdicts(rows)
    assert {v for (j, *_), v in want.items() if j == 99} == {"accepted", "duplicate", "out_of_order"}
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, EVENTS)
    found = {(r.job_id, r.generation, r.arrival): r.verdict for r in audit.accept_events(table).collect()}
    assert found == want
    table.write.parquet(str(tmp_path / "in"))
    drain(progress.accept_stream(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out"))
          .option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start())
    streamed = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.job_id, r.generation, r.arrival): r.verdict for r in streamed} == want
    assert audit.accept_events(table.filter("false")).count() == 0


def test_a_batch_rewrites_what_it_touches_and_publishes_once(spark, tmp_path):
    import glob

    schema = "source_id long, page long, attempt int, event_id long, status string"
    sources = spark.createDataFrame([(i, 3) for i in range(40)] + [(77, 10_000)], "source_id long, page_count long")
    state = progress.PageState(str(tmp_path / "t"), sources, buckets=16)
    batches = [
        [(i, p, 1, 10 * i + p, "failed" if i == 5 and p == 2 else "succeeded") for i in range(40) for p in (1, 2)] + [(77, p, 1, p, "succeeded") for p in range(1, 10_001, 2)],
        [(3, 3, 1, 1, "succeeded"), (5, 3, 1, 1, "succeeded")],
        [(5, 2, 2, 2, "succeeded"), (3, 3, 1, 1, "succeeded"), (3, 1, 2, 9, "succeeded")],
        [(77, p, 1, p, "succeeded") for p in range(2, 10_001, 2)],
    ]
    frames = [spark.createDataFrame(b, schema) for b in batches]
    for i, b in enumerate(frames):
        state.fold(b, i)
        first = sorted(map(tuple, state.counts(spark, i).collect()), key=str)
        touched = {k: len(glob.glob(f"{tmp_path}/t/{k}/bucket=*/v={i}")) for k in ("pages", "sources")}
        # The batch runs again, as after a lost driver: same tables, nothing published twice.
        state.fold(b, i)
        assert first == sorted(map(tuple, state.counts(spark, i).collect()), key=str)
        if i in (1, 2):
            assert touched["pages"] <= 2 and touched["sources"] <= 2
    published = [sorted(r.source_id for r in spark.read.parquet(f"{tmp_path}/t/published/v={i}").collect()) for i in range(4)]
    assert published == [[], [3], [5], [77]]
    counts = {r.source_id: (r.pages, r.succeeded, r.failed, r.published) for r in state.counts(spark, 3).collect()}
    assert counts[3] == (3, 3, 0, 1) and counts[5] == (3, 3, 0, 2) and counts[77] == (10_000, 10_000, 0, 3) and counts[0] == (2, 2, 0, None)
    assert state.pages(spark, 3).filter("source_id = 77").count() == 10_000
    # Of each bucket only versions that a manifest may still need are left.
    assert max(len(glob.glob(f"{d}/v=*")) for d in glob.glob(f"{tmp_path}/t/*/bucket=*")) <= 2
