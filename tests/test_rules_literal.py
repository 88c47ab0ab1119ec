"""Literal cases and brute-force twins of rules SQL cannot express well."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from slipweave.functions import text as tx
from slipweave.functions.numbering import number_rows
from slipweave.operators import audit, classify, export, route, search, segment

ACCOUNT = {"company_name": "Own Co", "bank_name": "中国银行", "account_number": "001"}
BLOCK = "source_id long, page long, block_index long, text string, x0 double, y0 double, x1 double, y1 double, confidence double, is_watermark boolean"


def brute_ratio(word, text):
    k, best = len(word), 0.0
    for n in range(k if k <= 2 else k - 1, k + 2):
        for s in range(len(text) - n + 1):
            best = max(best, SequenceMatcher(None, word, text[s : s + n]).ratio())
    return best


def test_fuzzy_equals_brute_force(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("reciptab ") for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["receipt", "re", "", "rec eipt x"]
    rows = [(1, 1, i, t, 0.0, 0.0, 9.0, 9.0, 1.0, False) for i, t in enumerate(texts)]
    for word in ("receipt", "re", "r", "abc"):
        got = {r.block_index: r.confidence for r in search.search_fuzzy(spark.createDataFrame(rows, BLOCK), word).collect()}
        want = {}
        for i, t in enumerate(texts):
            r = brute_ratio(word, "".join(t.split()))
            if r >= 0.65:
                want[i] = round(r, 4)
        assert got == want


def test_impossible_date_and_open_bounds(spark):
    df = spark.createDataFrame([("2024-13-40",), ("2024年2月9日",), ("none",)], "text string")
    assert [r.text for r in search.filter_date(df, "2024-01-01", None).collect()] == ["2024年2月9日"]
    assert search.filter_date(df, None, None).count() == 3


def test_amount_bounds_overlap(spark):
    df = spark.createDataFrame([("1 and 1,000.50",), ("5",), ("no digits",)], "text string")
    assert [r.text for r in search.filter_amount(df, 10, 2).collect()] == ["1 and 1,000.50"]


def test_normal_forms(spark):
    df = spark.createDataFrame([("  Ａ１　b​ ", "é①", "ⅣＡ")], "a string, b string, c string")
    row = df.select(
        tx.norm_search(F.col("a")).alias("s"), tx.norm_name(F.col("b")).alias("n"), tx.norm_field(F.lit("name"), F.col("c")).alias("f"),
        tx.norm_account(F.col("a")).alias("acc"),
    ).first()
    assert (row.s, row.n, row.f) == ("A1 b", "é①", "IVA")
    assert row.acc == "A1b​"


def test_title_grammar(spark):
    yes = ["回单", "客户回单", "中国银行 业务 回单", "业务回单（付款）", "电子缴税付款凭证", "存款利息单", "招商银行借记通知", "客户回单通用"]
    no = ["备注回单", "回单编号", "电子回单\n专用章", "客户回单：1", "某回单", "凭证", "业务回单（这是一个非常长的后缀）"]
    df = spark.createDataFrame([(t,) for t in yes + no], "text string")
    got = {r.text: r.t for r in df.select("text", classify.is_title(F.col("text")).alias("t")).collect()}
    assert [t for t in yes if not got[t]] == [] and [t for t in no if got[t]] == []


def test_segments_by_title(spark):
    rows = [
        (1, 1, 1, "客户回单", 10.0, 100.0, 90.0, 112.0, 1.0, False), (1, 1, 2, "付款", 10.0, 130.0, 90.0, 142.0, 1.0, False),
        (1, 1, 3, "中国银行", 10.0, 270.0, 90.0, 282.0, 1.0, False), (1, 1, 4, "业务回单", 10.0, 300.0, 90.0, 312.0, 1.0, False),
        (1, 1, 5, "金额", 10.0, 330.0, 90.0, 342.0, 1.0, False), (1, 1, 6, "第1页", 10.0, 780.0, 90.0, 792.0, 1.0, False),
        (1, 2, 1, "plain", 10.0, 100.0, 90.0, 112.0, 1.0, False), (1, 2, 2, "far", 10.0, 400.0, 90.0, 412.0, 1.0, False),
        (1, 3, 1, "贷款清算通知书", 10.0, 20.0, 90.0, 32.0, 1.0, False),
    ]
    b = spark.createDataFrame(rows, BLOCK).withColumns({"page_width": F.lit(600.0), "page_height": F.lit(800.0)})
    got = sorted((r.page, r.region_no, r.slot, r.y0, r.y1, round(r.confidence, 3)) for r in segment.segment_by_title(b).collect())
    assert got == [
        (1, 1, "slot-1", 92.0, 150.0, 0.86), (1, 2, "slot-2", 262.0, 350.0, 0.88), (2, 1, "single", 92.0, 120.0, 0.688),
        (2, 2, "single", 392.0, 420.0, 0.688), (3, 1, "single", 0.0, 800.0, 0.89),
    ]


def wide(spark, **over):
    base = {
        "segment_id": 1, "payer_name": "Own Co", "payer_name_state": "present", "payer_account": "001", "payer_account_state": "present",
        "payer_bank": "", "payer_bank_state": "missing", "payee_name": "Acme", "payee_name_state": "present", "payee_account": "9", "payee_account_state": "present",
        "payee_bank": "", "payee_bank_state": "missing", "source_bank": "中国银行", "source_state": "present", **over,
    }
    return spark.createDataFrame([tuple(base.values())], ", ".join(f"`{k}` {'long' if isinstance(v, int) else 'string'}" for k, v in base.items()))


def test_route_truth_table(spark):
    cases = [
        ({}, ("named", "payer", "", "account_match")),
        ({"payer_account": "", "payer_account_state": "missing"}, ("named", "payer", "own_account_missing", "batch_profile")),
        ({"payee_account": "001"}, ("counterparty_pending", None, "both_sides_match_our_account", "batch_profile")),
        ({"payee_name": "Own Co", "payee_account": "001"}, ("internal", None, "both_sides_match_our_account", "batch_profile")),
        ({"payee_name": "", "payee_name_state": "blank"}, ("blank", "payer", "", "account_match")),
        ({"source_bank": "农商银行"}, ("counterparty_pending", "payer", "source_bank_mismatch", "batch_profile")),
        ({"source_bank": "网上银行"}, ("named", "payer", "source_bank_unknown", "batch_profile")),
        ({"payer_name": "Other"}, ("counterparty_pending", "payer", "own_company_mismatch", "batch_profile")),
        ({"confirm_side": "payee"}, ("counterparty_pending", "payer", "own_side_conflict", "batch_profile")),
        ({"payer_account": "0*1", "payer_account_state": "present"}, ("named", "payer", "own_account_missing", "batch_profile")),
        ({"o_counterparty_name": "Own Co", "o_counterparty_name_state": "present"}, ("internal", "payer", "", "account_match")),
    ]
    for over, want in cases:
        r = route.derive_route(wide(spark, **over), ACCOUNT).first()
        assert (r.route, r.own_side, r.reasons, r.own_method) == want, over


def test_swapped_sides_flip_own_side(spark):
    a = wide(spark)
    b = a.withColumnsRenamed({c: c.replace("payer", "tmp") for c in a.columns if c.startswith("payer")})
    b = b.withColumnsRenamed({c: c.replace("payee", "payer") for c in b.columns if c.startswith("payee")})
    b = b.withColumnsRenamed({c: c.replace("tmp", "payee") for c in b.columns if c.startswith("tmp")})
    x, y = route.derive_route(a, ACCOUNT).first(), route.derive_route(b, ACCOUNT).first()
    assert (x.own_side, y.own_side, x.group_id) == ("payer", "payee", y.group_id)


def fold(events):
    last, out = {}, []
    for job, arrival, seq in sorted(events):
        n = last.get(job, 0)
        if seq == n + 1:
            last[job] = seq
            out.append((job, arrival, "accepted"))
        else:
            out.append((job, arrival, "duplicate" if seq <= n else "out_of_order"))
    return sorted(out)


def test_events_with_one_hot_job_equal_fold(spark):
    rng, events = random.Random(3), []
    for job in range(30):
        n, seq = (3000 if job == 0 else 20), 1
        for arrival in range(n):
            r = rng.random()
            events.append((job, arrival, seq if r < 0.9 else max(0, seq + rng.randint(-3, 3))))
            if r < 0.9:
                seq += 1 if rng.random() < 0.97 else 2
                seq = seq if rng.random() < 0.98 else max(1, seq - 4)
    df = spark.createDataFrame(events, "job_id long, arrival long, seq long").repartition(5)
    got = sorted((r.job_id, r.arrival, r.verdict) for r in audit.accept_events(df).collect())
    assert got == fold(events)


def test_number_rows_with_a_hot_source(spark):
    rows = [(0 if i % 3 else i % 7, i * 37 % 1000, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "source_position long, page long, segment_id long").withColumn("position_index", F.lit(1))
    got = [(r.source_position, r.page, r.segment_id) for r in export.extract_order(df).orderBy("position").collect()]
    assert got == sorted(rows)
    part = number_rows(df, ["source_position"], [("_b", F.floor(F.col("page") / 10))], [F.col("page"), F.col("segment_id")], "n")
    assert part.groupBy("source_position").agg((F.max("n") == F.count(F.lit(1))).alias("ok")).filter("not ok").count() == 0


def test_filenames_cascade(spark):
    df = spark.createDataFrame([(1, "a"), (2, "A"), (3, "a-2"), (4, "a/b"), (5, "nul.txt"), (6, "  ")], "id long, label string")
    stems = [r.stem for r in export.unique_filenames(df, "id", "label").orderBy("id").collect()]
    assert len({s.lower() for s in stems}) == 6 and stems[0] == "a" and stems[3] == "a_b" and stems[4] == "nul.txt" and stems[5] == "未命名分组"


def test_merge_keeps_every_reading(spark):
    from slipweave.operators import fields

    rows = [(1, "name", i, f"v{i:02d}" * 500, "present") for i in range(40)]
    df = spark.createDataFrame(rows, "segment_id long, field string, no long, value string, state string").withColumn("raw", F.col("value"))
    r = fields.merge_field_values(df, ["segment_id", "field"], ["no"]).first()
    assert r.readings == 40 and r.state == "ambiguous" and r.value == r.raw == " | ".join(v for _, _, _, v, _ in rows)


def test_numbers_keep_null_positions(spark):
    df = spark.createDataFrame([(None, 1, 1), (2, None, 2), (2, 1, 3), (None, None, 4)], "p long, page long, k long")
    found = {r.k: r.no for r in number_rows(df, ["p"], [("_b", F.col("page"))], [F.col("k")], "no").collect()}
    assert found == {4: 1, 1: 2, 2: 1, 3: 2}


def test_stamp_rule_far_down(spark):
    far = "\n".join(["行"] * 70_000 + ["客户回单", "业务专用章"])
    df = spark.createDataFrame([(far,), ("\n".join(["行"] * 70_000 + ["客户回单", "x"]),)], "text string")
    assert [r.t for r in df.select(classify.is_title(F.col("text")).alias("t")).collect()] == [False, True]


def test_any_number_of_clauses():
    clauses = [(f"q{i}", "k" * (600 + i), "include") for i in range(100)]
    assert len(search.check_clauses(clauses)) == 100


def test_file_stems(spark):
    cases = {"CON": "CON_", " ..a  b. ": "a  b", "": "未命名分组", "a/b​c": "a_b_c", "é": "é", "x" * 300: "x" * 236, "\U0001F600" * 130: "\U0001F600" * 118}
    cases |= {"x" * 235 + "\U0001F600": "x" * 235, "x" * 235 + " y": "x" * 235, "e\u0301": "é", "com1": "com1_", "\n\t": "未命名分组", "???": "___"}
    df = spark.createDataFrame(list(enumerate(cases)), "k long, label string")
    # Case by case, as names that are equal would be numbered.
    ready = df.select("k", export.file_stem(tx.nfc(F.col("label"))).alias("stem"))
    assert [r.stem for r in ready.orderBy("k").collect()] == list(cases.values())
    names = ["Straße", "STRASSE", "ΟΔΟΣ", "οδος", "Ａ", "A"]
    found = spark.createDataFrame([(v,) for v in names], "v string").select(export.caseless(F.col("v"))).collect()
    assert found[0] == found[1] and found[2] == found[3] and found[4] != found[5]


def test_file_names_are_unique(spark):
    labels = ["A", "a", "A-2", "A", "A-2", "b" * 236, "B" * 236, "b" * 235 + "c", "b" * 235 + "c", "A-2-2"]
    df = spark.createDataFrame(list(enumerate(labels)), "k long, label string")
    found = [r.stem for r in sorted(export.unique_filenames(df, "k", "label").collect())]
    assert len({s.casefold() for s in found}) == len(labels) and all(len(s) <= 236 for s in found)
    assert found[:5] == ["A", "a-3", "A-2", "A-4", "A-2-3"] and found[5] == "b" * 236


WIDE = ["payer_name", "payer_account", "payer_bank", "payee_name", "payee_account", "payee_bank"]


def wide_slip(spark, **over):
    base = {c: "" for c in WIDE} | {f"{c}_state": "missing" for c in WIDE} | {"segment_id": 1, "source_bank": "中国银行", "source_state": "present", "excluded": False}
    return spark.createDataFrame([base | over])


def test_own_profile_is_folded(spark):
    profile = {"company_name": "Ｏｗｎ　Café", "bank_name": "中国银行", "account_number": "０ ０1"}
    slip = wide_slip(
        spark, payer_name="Own Café", payer_name_state="present", payer_account="001", payer_account_state="present",
        payee_name="Café Ltd", payee_name_state="present", payee_account="9", payee_account_state="present")
    r = route.derive_route(slip, profile).first()
    assert (r.own_side, r.reasons, r.route, r.group_key) == ("payer", "", "named", "counterparty:Café Ltd")


def test_refresh_keeps_rows_without_version(spark):
    slips = wide_slip(spark).unionByName(wide_slip(spark, segment_id=2)).unionByName(wide_slip(spark, segment_id=3))
    old = slips.select("segment_id", *[F.lit("old").alias(c) for c in route.ROUTED], F.when(F.col("segment_id") == 1, "v2").when(F.col("segment_id") == 2, "v1").alias("version"))
    found = {r.segment_id: r.recomputed for r in route.refresh(old, slips, ACCOUNT, "v2").collect()}
    assert found == {1: False, 2: True, 3: True}
