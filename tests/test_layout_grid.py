"""Rules met by the grid of label boxes against every rule tried on every slip."""

import random

from slipweave.operators import rules

REL = rules.REL


def layouts(rng, n, spots):
    """Labels of few kinds at few spots, so that many layouts nearly agree."""
    out = []
    for _ in range(n):
        chosen = [(rng.choice("ab"), rng.choice(spots), rng.choice(spots)) for _ in range(rng.randint(2, 4))]
        out.append([(k, x, y, x + 0.1, y + 0.03) for k, x, y in chosen])
    return out


def fits(a, b, tol=rules.TOLERANCE):
    if sorted(k for k, *_ in a) != sorted(k for k, *_ in b):
        return False
    near = [[i for i, q in enumerate(b) if q[0] == p[0] and max(abs(u - v) for u, v in zip(p[1:], q[1:])) <= tol] for p in a]
    return all(len(n) == 1 for n in near) and len({n[0] for n in near}) == len(b)


def test_grid_loses_no_match(spark):
    rng = random.Random(51)
    spots = [0.1, 0.104, 0.2, 0.4, 0.4119, 0.424]
    drawn = layouts(rng, 100, spots)
    drawn += [[(k, *[v + rng.choice([0, 0.004]) for v in box]) for k, *box in d] for d in drawn[:60]] + drawn[60:70]
    # Slips print rules with a shift of every label, up to and over the tolerance, or something else.
    printed = [[(k, *[v + rng.choice([-0.0115, -0.006, 0, 0.006, 0.0115, 0.0125]) * (rng.random() < 0.5) for v in box]) for k, *box in rng.choice(drawn)] for _ in range(250)]
    bank = lambda: "B" if rng.random() < 0.8 else "C"
    rule = [(i, bank(), rng.choice([1.5, 1.52, 1.6]), rng.random() < 0.1, rng.random() < 0.9) for i in range(len(drawn))]
    slip = [(i, bank(), rng.choice([1.5, 1.521, 1.58]), rng.random() < 0.9, f"s{i}") for i in range(len(printed))]
    table = lambda rows, kind: spark.createDataFrame(rows, kind)
    boxes = ", ".join(f"{c} double" for c in REL)
    found = rules.match_rules(
        table(slip, "segment_id long, bank string, aspect double, reliable boolean, signature string"), table([(i, *x) for i, xs in enumerate(printed) for x in xs], f"segment_id long, kind string, {boxes}"),
        table(rule, "rule_id long, bank_name string, aspect double, batch_only boolean, active boolean"), table([(i, *x) for i, xs in enumerate(drawn) for x in xs], f"rule_id long, kind string, {boxes}"))
    seen = set()
    for r in found.collect():
        _, own, aspect, reliable, _ = slip[r.segment_id]
        hits = [i for i, b, ra, only, active in rule if active and not only and b == own and abs(aspect / ra - 1) <= 0.015 and fits(drawn[i], printed[r.segment_id])]
        want = ("labels_unavailable", None) if not reliable else ("matched", hits[0]) if len(hits) == 1 else ("multiple_rules" if hits else "no_rule", None)
        assert (r.reason, r.rule_id) == want
        seen.add(r.reason)
    assert len(seen) == 4


def test_no_product_of_rules_and_shapes(spark):
    """A bank of many rules: candidates grow with the slips, not with rules times slips."""
    n = 2_000
    rule = [(i, "B", 1.5) for i in range(n)]
    labels = [(i, k, 0.05 * (i % 18) + d, 0.002 + 0.0008 * (i // 18 * 7 % 1000), 0.05 * (i % 18) + 0.04 + d, 0.9) for i in range(n) for k, d in (("a", 0.0), ("b", 0.001))]
    boxes = ", ".join(f"{c} double" for c in REL)
    a = spark.createDataFrame(rule, "a_id long, bank string, aspect double")
    la = spark.createDataFrame(labels, f"a_id long, kind string, {boxes}")
    pairs = rules.layout_candidates(a, la, a.withColumnRenamed("a_id", "b_id"), la.withColumnRenamed("a_id", "b_id")).count()
    assert n <= pairs < n * n / 30


def test_equal_labels_of_many_signatures_meet_once(spark, monkeypatch):
    """Slips of other signatures that print the same labels are one shape, and no label of a pair becomes a row of its own."""
    n, met = 500, []
    grid = rules._candidates
    monkeypatch.setattr(rules, "_candidates", lambda *a: met.append(grid(*a)) or met[-1])
    boxes = ", ".join(f"{c} double" for c in REL)
    at = lambda i: [(i, k, x, 0.1, x + 0.1, 0.15) for k, x in (("a", 0.1), ("b", 0.3))]
    slips = spark.createDataFrame([(i, "B", 1.5, True, f"s{i}") for i in range(n)], "segment_id long, bank string, aspect double, reliable boolean, signature string")
    printed = spark.createDataFrame([x for i in range(n) for x in at(i)], f"segment_id long, kind string, {boxes}")
    drawn = spark.createDataFrame([(i, "B", 1.5, False, True) for i in range(2)], "rule_id long, bank_name string, aspect double, batch_only boolean, active boolean")
    far = [(1, k, x + 0.02, *rest) for _, k, x, *rest in at(1)]
    found = rules.match_rules(slips, printed, drawn, spark.createDataFrame(at(0) + far, f"rule_id long, kind string, {boxes}"))
    assert {(r.rule_id, r.reason) for r in found.collect()} == {(0, "matched")} and found.count() == n
    assert met[0].count() <= 2
