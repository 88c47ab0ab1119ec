"""Only slips with a form's title are gathered to find their form."""

from slipweave.plans.parties import detect_forms


def test_slips_without_a_title_have_no_form_row(spark):
    rows = [(1, 1, "电子缴税 付款凭证", 4.0), (1, 2, "付款人账号：1", 20.0), (2, 1, "付款人账号：1", 4.0), (2, 2, "借贷标志：借", 20.0)]
    lines = spark.createDataFrame([(s, n, t, 40.0, y, 240.0, y + 12, 0.0, 140.0) for s, n, t, y in rows],
                                  "segment_id long, line_no long, text string, x0 double, y0 double, x1 double, y1 double, sy0 double, sy1 double")
    assert [(r.segment_id, r.form) for r in detect_forms(lines).collect()] == [(1, "tax")]
