"""Fuzzy search: windows bounded by common subsequences, lines scored once and where they were dealt to."""

import random
from difflib import SequenceMatcher

from slipweave.operators import search


def brute(word, text):
    k = len(word)
    sizes = range(k if k <= 2 else k - 1, k + 2)
    best = max([SequenceMatcher(None, word, text[i : i + n]).ratio() for n in sizes for i in range(len(text) - n + 1)], default=0.0)
    return best if best >= search.FUZZY_THRESHOLD else 0.0


def test_best_ratios_equal_all_windows_scored():
    rng = random.Random(4)
    for word in ("a", "ab", "aab", "回单付款", "receipt", "abcabcab", "abcabcabcab", "x" * 5 + "y" * 70):
        letters = [*sorted(set(word)), "z"]
        texts = ["".join(rng.choice(letters) for _ in range(rng.choice((0, 1, 3, 30, 90)))) for _ in range(60)] + [word, "z" + word]
        assert search.best_ratios(word, texts) == [brute(word, t) for t in texts]


def test_windows_out_of_order_are_not_scored(monkeypatch):
    """All letters of the keyword in another order: counts say nothing, so this was scored window by window."""
    scored = []
    monkeypatch.setattr(search, "SequenceMatcher", lambda *a: scored.append(a) or SequenceMatcher(*a))
    assert search.best_ratio("receipt", "tpiecer" * 40) == 0.0 and not scored


def test_lines_are_scored_once_after_they_are_dealt_out(spark):
    cols = "source_id long, page long, block_index long, text string, confidence double"
    found = search.search_fuzzy(spark.createDataFrame([(1, 1, 1, "a receipt", 1.0), (1, 1, 2, "other", 1.0)], cols), "receipt")
    assert [(r.block_index, r.matched_text) for r in found.collect()] == [(1, "a receipt")]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Exchange")
