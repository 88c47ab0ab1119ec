"""Bank names and titles: every text's name is worked out once, the title grammar only where a title may be."""

from slipweave.operators import classify


def test_bank_names_are_worked_out_once(spark):
    cols = "source_id long, page long, block_index long, text string, x0 double, y0 double, x1 double, y1 double"
    at = (0.0, 0.0, 50.0, 10.0)
    texts = ["中国银行", "A 农商银行", "网上银行", None, "摘要"]
    found = classify.masthead_bank(spark.createDataFrame([(1, i, 1, t, *at) for i, t in enumerate(texts)], cols))
    assert {r.page for r in found.collect()} >= {0, 1} and not {3, 4} & {r.page for r in found.collect()}
    # Once where headings are looked for, once more where those beside an account label are.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("[A-Za-z·.") == 2


def test_every_title_holds_a_mark(spark):
    fixed = [*classify.EXACT_TITLES, *classify.DOCUMENT_TITLES, "客户回单", "回 单", "存款利息单", "招商银行借记通知", "招商银行贷 记 通 知", "业务 回单（付款）", "摘要\n客户回单"]
    rows = spark.createDataFrame([(t,) for t in [*fixed, "摘要", "备注"]], "text string")
    got = {r.text: r.is_title for r in classify.flag_titles(rows).collect()}
    assert all(got[t] for t in fixed) and not got["摘要"] and not got["备注"]
    assert all(any(m in t for m in classify.TITLE_MARKS) for t in fixed)
