"""The fold of an edit log against a plain reading of it."""

import random

from slipweave.operators import edits as ed

KINDS = "segment_id long, seq long, kind string, expected_basis string, side string, field string, value string, state string, group_id string"


def plain(rows):
    """Registers after reading a slip's rows by seq; None for a contradiction."""
    out, by_seq = {}, {}
    for _, seq, kind, _, side, field, value, state, group in rows:
        keys = {"clear_fields": ed.REGISTERS, "confirm": ["confirm"], "clear_confirm": ["confirm"], "assign": ["assign"], "clear_assign": ["assign"]}.get(kind, [(side, field)])
        said = {"field": (value, state), "confirm": side, "assign": group}.get(kind)
        for k in keys:
            by_seq.setdefault((k, seq), set()).add(said)
            if seq >= out.get(k, (-1, None))[0]:
                out[k] = seq, said
    clash = any(len(by_seq[k, out[k][0]]) > 1 for k in out)
    return out, clash


def test_fold_is_the_last_word_in_any_order(spark):
    rng = random.Random(41)
    rows = []
    for slip in range(120):
        for _ in range(rng.randint(1, 12)):
            kind = rng.choice(["field"] * 4 + ["clear_field", "clear_fields", "confirm", "clear_confirm", "assign", "clear_assign"])
            side, field = rng.choice(ed.PARTIES), rng.choice(["name", "account"])
            row = (slip, rng.randint(1, 6), kind, "b", side if kind in ("field", "clear_field", "confirm") else None, field if "field" in kind else None,
                   rng.choice("AB") if kind == "field" else None, "present" if kind == "field" else None, rng.choice("gh") if kind == "assign" else None)
            rows += [row] * rng.choice([1, 1, 2])
    # One slip with most of all rows.
    rows += [(7, 1_000 + i, "field", "b", "payee", "bank", f"v{i}", "present", None) for i in range(3_000)]
    seen = []
    for parts in (1, 7):
        rng.shuffle(rows)
        seen.append({r.segment_id: r for r in ed.fold(spark.createDataFrame(rows, KINDS).repartition(parts)).collect()})
    for slip in range(120):
        own = [r for r in rows if r[0] == slip]
        want, clash = plain(own)
        for found in seen:
            r = found[slip]
            assert r.f_clash == clash and r.f_basis == "b"
            for s, f in ed.REGISTERS:
                w = r[f"w_{s}_{f}"]
                assert (w is None) == ((s, f) not in want)
                if w is not None and not clash:
                    assert (w.seq, (w["is"].value, w["is"].state) if w["is"].state else None) == want[s, f]
            for k in ("confirm", "assign"):
                w = r[f"w_{k}"]
                assert (w is None) == (k not in want)
                if w is not None and not clash:
                    assert (w.seq, w["is"][0]) == (want[k][0], want[k][1])
    assert {r: (a.f_clash, a.f_invalid) for r, a in seen[0].items()} == {r: (a.f_clash, a.f_invalid) for r, a in seen[1].items()}


def test_what_makes_no_sense_is_invalid(spark):
    rows = [
        (1, 1, "field", "b", "payer", "name", " ", "present", None), (2, 1, "field", "b", "payer", "name", "x", "blank", None), (3, 1, "field", "b", "nobody", "name", "x", "present", None),
        (4, 1, "confirm", "b", "counterparty", None, None, None, None), (5, 1, "assign", "b", None, None, None, None, None), (6, 1, "erase", "b", None, None, None, None, None),
        (7, 1, None, "b", None, None, None, None, None), (8, 1, "clear_assign", None, None, None, None, None, None), (8, 2, "clear_assign", "b", None, None, None, None, None), (9, 1, "confirm", "b", "single", None, None, None, None)]
    found = {r.segment_id: (r.f_invalid, r.f_basis) for r in ed.fold(spark.createDataFrame(rows, KINDS)).collect()}
    assert found == {**{i: (True, "b") for i in range(1, 8)}, 8: (False, None), 9: (False, "b")}
    assert ed.fold(spark.createDataFrame([], KINDS)).count() == 0
