"""Layout previews against a full computation, and reference pages against sets compared one by one."""

import random

from slipweave.operators import preview, segment

BOX = "x0 double, y0 double, x1 double, y1 double"


def layout(rng, pages):
    rows = []
    for page in range(pages):
        top = 0.0
        for i in range(1, rng.randint(2, 4)):
            height = float(rng.choice([40, 50, 60]))
            rows.append((page % 3, page, i, 0.0, top, 200.0, top + height, f"{page}-{i}"))
            top += height
    return rows


def test_changed_pages_alone_give_the_full_result(spark):
    rng = random.Random(61)
    before = layout(rng, 60)
    after = [r for r in before if r[1] % 4] + [r for r in layout(random.Random(62), 60) if r[1] % 4 == 0 and r[1] != 8]
    things = [(p % 3, p, b, x, y, x + 30, y + 10) for p in range(60) for b in range(6) for x, y in [(float(rng.randint(0, 180)), float(rng.randint(0, 170)))]]
    table = lambda rows, kind: spark.createDataFrame(rows, kind)
    slots = lambda rows: table(rows, f"source_id long, page long, position_index long, {BOX}, instance_id string")
    blocks = table([(*r, "text", False, rng.choice([0.8, 1.0])) for r in things], f"source_id long, page long, block_index long, {BOX}, text string, is_watermark boolean, confidence double")
    objects = table([(*r[:3], *r[3:], "stroke-path") for r in things[::3]], f"source_id long, page long, block_index long, {BOX}, kind string")
    matches = table([(*r, rng.choice([0.8, 1.0]), *rng.choice([("include-0", "include"), ("exclude-0", "exclude")])) for r in things], f"source_id long, page long, block_index long, {BOX}, confidence double, query_id string, role string")
    reviews = table([], f"source_id long, page long, position_index long, {BOX}, review_status string, manual_adjusted boolean, full_page boolean, document_type string, accept boolean")
    given = (blocks, objects, matches)
    old = preview.results(slots(before), *given, ["include-0"])
    got = preview.preview(slots(before), slots(after), old, *given, reviews, ["include-0"])
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(preview.results(slots(after), *given, ["include-0"]))
    assert key(got.result) == want and want and {r[1] % 4 for r in want} == {0, 1, 2, 3}
    assert {r.page % 4 for r in preview.changed_pages(slots(before), slots(after)).collect()} == {0}
    assert {r.page % 4 for r in got.slots.collect()} <= {0} and got.slots.filter("change = 'removed' and page = 8").count() == len([r for r in key(old) if r[1] == 8])
    same = preview.preview(slots(before), slots(before), old, *given, reviews, ["include-0"])
    assert key(same.result) == key(old) and not same.slots.count() and not same.issues.count()


def test_kept_decisions_block_or_warn(spark):
    table = lambda rows, kind: spark.createDataFrame(rows, kind)
    slots = lambda rows: table(rows, f"source_id long, page long, position_index long, instance_id string, {BOX}")
    pages = range(1, 7)
    before = slots([(0, p, i, f"{p}-{i}", 0.0, 50.0 * (i - 1), 100.0, 50.0 * i) for p in pages for i in (1, 2)])
    after = slots([(0, p, i, f"{p}-{i}", 0.0, (40.0 if i == 2 else 0.0), 100.0, 100.0 if i == 2 else 40.0) for p in pages for i in (1, 2) if (p, i) != (4, 1)])
    at = [(0, p, i, 10.0, 50.0 * i - 45, 40.0, 50.0 * i - 35) for p in pages for i in (1, 2)]
    blocks = table([(*r, "text", False, 1.0) for r in at], f"source_id long, page long, block_index long, {BOX}, text string, is_watermark boolean, confidence double")
    objects = table([], f"source_id long, page long, {BOX}, kind string")
    matches = table([(*r, 1.0, "include-0", "include") for r in at], f"source_id long, page long, block_index long, {BOX}, confidence double, query_id string, role string")
    shape = f"source_id long, page long, position_index long, {BOX}, review_status string, manual_adjusted boolean, full_page boolean, document_type string, accept boolean"
    fits, wide = (0.0, 2.0, 100.0, 38.0), (0.0, 2.0, 100.0, 48.0)
    reviews = table([
        (0, 1, 1, *fits, "confirmed", True, False, None, False), (0, 2, 1, *wide, "confirmed", True, False, None, False), (0, 3, 1, *wide, "confirmed", True, False, None, True),
        (0, 4, 1, *wide, "confirmed", False, False, "loan", False), (0, 5, 1, *wide, "excluded", True, False, None, False), (0, 6, 1, *fits, "confirmed", False, True, None, False)], shape)
    given = (blocks, objects, matches)
    got = preview.preview(before, after, preview.results(before, *given, ["include-0"]), *given, reviews, ["include-0"])
    change = {(r.page, r.position_index): (r.change, r.y1) for r in got.slots.collect()}
    assert [change[p, 1] for p in pages] == [("retained_manual", 38.0), ("retained_manual", 48.0), ("updated", 40.0), ("removed", None), ("updated", 40.0), ("retained_manual", 38.0)]
    issues = {(r.page, r.position_index, r.code, r.blocking) for r in got.issues.collect()}
    assert issues == {
        (2, 1, "manual_exception_conflict", True), (6, 1, "manual_exception_conflict", True), (4, 1, "manual_classification_membership", True), (4, None, "unassigned_block", True),
        (5, 1, "excluded_decision_reset", False), (5, 2, "excluded_decision_reset", False)}


def test_reference_pages_by_sets(spark):
    rng = random.Random(63)
    pick = lambda names, n: sorted(rng.sample(names, rng.randint(0, n)))
    pages = [(rng.randint(0, 2), p, rng.randint(0, 3), rng.randint(0, 3), rng.random() < 0.1, rng.choice(["A", "A", "B", None]), pick("abcdef", 4)) for p in range(150)]
    heads = {p[1]: pick("xyz", 2) for p in pages}
    df = spark.createDataFrame(pages, "source_id long, page long, slips long, titles long, vacant boolean, bank string, keys array<string>")
    headings = spark.createDataFrame([(p[0], p[1], h) for p in pages for h in heads[p[1]]] + [(0, 0, None)], "source_id long, page long, heading string")
    found = {tuple(r) for r in segment.page_forms(df, headings).join(segment.reference_pages(df, headings), ["source_id", "basis", "bank", "keys"]).select("page", "basis", "reference_page").collect()}
    want = set()
    for s, p, _, _, _, bank, keys in pages:
        for rs, r, slips, titles, vacant, rbank, rkeys in pages:
            if rs != s:
                continue
            if bank and keys:
                if (titles > 1 or vacant) and slips > 1 and rbank == bank and rkeys and set(keys) <= set(rkeys):
                    want.add((p, "template", r))
            elif titles > 1 and set(heads[p]) & set(heads[r]):
                want.add((p, "heading", r))
    assert found == want and len({b for _, b, _ in want}) == 2


def test_a_common_key_is_not_looked_up(spark):
    """Every form holds one common key: forms meet few references, not all."""
    n = 400
    forms = spark.createDataFrame([(0, "A", ["all", f"k{i}"]) for i in range(n)], "source_id long, bank string, keys array<string>")
    plan = segment.covering_forms(forms, forms)
    assert plan.count() == n
    listed = forms.selectExpr("source_id", "bank", "explode(keys) as k").groupBy("k").count()
    assert listed.filter("k = 'all'").first()["count"] == n


def test_previews_deal_out_text_and_hits_once(spark):
    """No table of a page is sorted or shuffled again for each step: the plan of the result holds few exchanges."""
    box = ["0.0D as x0", "10.0D * id as y0", "50.0D as x1", "10.0D * id + 8 as y1"]
    at = spark.range(4).selectExpr("0L as source_id", "1L as page", "id as block_index", *box)
    slots = spark.range(2).selectExpr("0L as source_id", "1L as page", "id as position_index", "'s' || id as instance_id", "0.0D as x0", "20.0D * id as y0", "60.0D as x1", "20.0D * (id + 1) as y1")
    blocks = at.selectExpr("*", "'text' as text", "false as is_watermark", "1.0D as confidence")
    matches = at.selectExpr("*", "1.0D as confidence", "'include-0' as query_id", "'include' as role")
    found = preview.results(slots, blocks, at.selectExpr("*", "'stroke-path' as kind"), matches, ["include-0"])
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 2 and plan.count("HashAggregate") <= 4
    assert sorted((r.instance_id, r.y0, r.y1, r.needs_review) for r in found.collect()) == [("s0", 0.0, 20.0, False), ("s1", 20.0, 40.0, False)]


def test_slots_without_things_or_places_stay(spark):
    """A slot that meets nothing keeps one row, whether it spans several bands or has no height at all."""
    shape = f"source_id long, page long, position_index long, {BOX}, instance_id string"
    slots = spark.createDataFrame([(0, 1, 1, 0.0, 0.0, 50.0, 900.0, "a"), (0, 1, 2, 0.0, None, 50.0, None, "b"), (0, 2, 1, 0.0, 0.0, 50.0, 900.0, "c")], shape)
    blocks = spark.createDataFrame([(0, 2, 1, 5.0, 200.0, 9.0, 300.0, "text", False, 0.5), (0, 2, 2, 5.0, 600.0, 9.0, 700.0, "text", False, 1.0)], f"source_id long, page long, block_index long, {BOX}, text string, is_watermark boolean, confidence double")
    objects = spark.createDataFrame([(0, 2, 5.0, 250.0, 9.0, 880.0, "stroke-path")], f"source_id long, page long, {BOX}, kind string")
    got = {(r.page, r.position_index): (r.instance_id, r.excluded_reason, r.blocks, r.uncertain_text, r.objects) for r in segment.occupy_slots(slots, blocks, objects, ("instance_id",)).collect()}
    assert got == {(1, 1): ("a", "blank", 0, 0, 0), (1, 2): ("b", "blank", 0, 0, 0), (2, 1): ("c", None, 2, 1, 1)}
