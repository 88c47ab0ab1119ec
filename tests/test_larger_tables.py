"""Queries on small tables shaped like larger ones, where keys and ties meet that the smallest test tables do not have."""

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from slipweave import catalog as registered
from slipweave import session
from slipweave.operators import fields, labels, nearby, segment
from slipweave.plans import parties


def beside_sql(spark, folder, name, tables):
    """Rows of a query and of its SQL over tables given as lists of rows."""
    con = duckdb.connect()
    for table, rows in tables.items():
        spark.createDataFrame(rows).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    df = registered.QUERIES[name](spark, str(folder))
    cols = ", ".join(df.columns)
    return sorted(map(tuple, df.collect())), sorted(con.execute(f"select {cols} from ({registered.ORACLES[name]})").fetchall())


def test_coverage_with_orders_beyond_a_million(spark, tmp_path):
    keys = [7, 14, 13, 1000007, 1000014, 1000021]
    tables = {"orders": [Row(o_orderkey=k) for k in keys], "lineitem": [Row(l_orderkey=k) for k in (7, 14, 13, 1000007)]}
    got, want = beside_sql(spark, tmp_path, "coverage", tables)
    assert (1000007, "unexpected") in got and got == want


def test_titles_at_one_place_are_read_in_block_order(spark):
    cols = "source_id long, page long, block_index long, text string, x0 double, y0 double, x1 double, y1 double, confidence double, is_watermark boolean, page_width double, page_height double"
    size = (12.0, 1.0, False, 260.0, 160.0)
    rows = [(1, page, 3, "客户回单", 30.0, 5.0, 60.0, *size) for page in (1, 2)]
    # Block 2 is the one before block 3 and ends left of it, whichever row comes first.
    pair = [(1, "客户回单", 0.0, 0.0, 50.0), (2, "客户回单", 0.0, 0.0, 20.0)]
    for page, blocks in ((1, pair), (2, pair[::-1])):
        rows = [(1, page, b, t, x0, y0, x1, *size) for b, t, x0, y0, x1 in blocks] + rows
    got = segment.page_policy_evidence(spark.createDataFrame(rows, cols).coalesce(1)).collect()
    assert sorted((r.page, r.usable) for r in got) == [(1, False), (2, False)]


def test_tables_repeated_per_band_are_not_broadcast(spark):
    left = spark.range(4).selectExpr("id as k", "0.0d as lo", "100.0d as hi")
    right = spark.range(4).selectExpr("id as k", "50.0d as v_y", "60.0d as v_z")
    pairs = nearby.band_pairs(left, right, ["k"], F.col("lo"), F.col("hi"), "y")
    met = nearby.meet(left, right, ["k"], (F.col("lo"), F.col("hi")), (F.col("v_y"), F.col("v_z")))
    h = spark.range(4).selectExpr("id as source_id", "1L as page", "300.0d as page_width", "400.0d as page_height", "explode(array(0.0d, 50.0d, 100.0d)) as position", "10.0d as start", "200.0d as end")
    v = spark.range(4).selectExpr("id as source_id", "1L as page", "explode(array(10.0d, 200.0d)) as position", "0.0d as start", "100.0d as end")
    tables = segment.closed_tables(h, v)
    assert tables.count() == 4
    for df in (pairs, met, tables):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()


def test_direct_labels_are_searched_once(spark):
    cols = "segment_id long, line_no long, text string, x0 double, y0 double, x1 double, y1 double"
    raw = spark.createDataFrame([(1, 1, "对方户名：甲", 40.0, 14.0, 240.0, 26.0), (2, 1, "本方户名：乙", 40.0, 14.0, 240.0, 26.0)], cols)
    read = parties._direct_readings(raw)
    assert [(r.segment_id, r.value) for r in read.collect()] == [(1, "甲")]
    assert read._jdf.queryExecution().optimizedPlan().toString().count("*[:：])") == 1


def test_labels_are_searched_by_many_tasks_and_once_per_vocabulary(spark):
    cols = "segment_id long, line_no long, text string, x0 double, y0 double, x1 double, y1 double"
    texts = ["付款人名称：甲", "付 款 人 账 号:1 收款人名称：乙", "户名：丙", "\x1c户　名 = 丁", "付款人名称甲", "", None, "x付款人名称：甲"]
    raw = spark.createDataFrame([(1, i, t, 0.0, 0.0, 1.0, 1.0) for i, t in enumerate(texts)], cols).coalesce(1)
    found = labels.match_labels(raw)
    assert sorted((r.line_no, r.cell_no, r.label, r.value, r.side, r.explicit) for r in found.collect()) == [
        (0, 0, "付款人名称", "甲", "payer", True), (1, 0, "付款人账号", "1", "payer", True), (1, 1, "收款人名称", "乙", "payee", True),
        (2, 0, "户名", "丙", "", False), (3, 0, "户名", "丁", "", False)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?=[") == 2 and "RepartitionByExpression" in plan


def test_party_tables_are_not_broadcast(spark):
    cols = "segment_id long, line_no long, text string, x0 double, y0 double, x1 double, y1 double, sy0 double, sy1 double"
    texts = [("付款人名称", 40.0, 20.0), ("甲", 120.0, 21.0), ("收款人名称", 340.0, 20.0), ("乙", 420.0, 21.0)]
    raw = spark.createDataFrame([(1, i, t, x, y, x + 70, y + 12, 0.0, 140.0) for i, (t, x, y) in enumerate(texts)], cols)
    seen = []
    def staged(df):
        seen.append(df._jdf.queryExecution().sparkPlan().toString())
        return session.stage(df)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(parties, "stage", staged)
        m.setattr(fields, "stage", staged)
        got = parties.extract_parties(raw)
    found = {(r.side, r.field): r.value for r in got.collect()}
    assert found["payer", "name"] == "甲" and found["payee", "name"] == "乙" and len(found) == 6
    for plan in [*seen, got._jdf.queryExecution().sparkPlan().toString()]:
        # Plans of cached tables stand inside the later ones, as they were planned with their own sizes.
        assert "BroadcastHashJoin" not in plan
