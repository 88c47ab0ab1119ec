"""The null of written language, the pipeline's first candidates and the bounds of the transducer."""

import math
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from slipweave.llm import anchors, copies, decontaminate, secrets
from slipweave.llm.shared import written
from slipweave.llm.transducer import Transducer, ranks_of


def test_null_counts_every_word(spark):
    rng = random.Random(31)
    words = {"".join(rng.choices("abcdefghij", k=rng.randint(6, 12))) for _ in range(30_000)}
    table, mean, spread = secrets.language_null(spark.createDataFrame([(w,) for w in words], "text string"))
    size = len(secrets.SIGNS)
    counts = np.full((size, size), 0.5)
    for w in words | set(secrets.KNOWN):
        at = ["0123456789".find(c) >= 0 and secrets.SIGNS.index("0") or secrets.SIGNS.find(c if c.isalpha() else "-") for c in w.lower()]
        for x, y in zip(at, at[1:]):
            counts[x, y] += 1
    assert np.allclose(table, np.log(counts / counts.sum(axis=1, keepdims=True)).ravel())
    # Nearly every word is of letters drawn alike, so a pair costs about log(10) and a word's sum hardly spreads.
    assert abs(mean + math.log(10)) < 0.05 and 0 < spread < 1


def test_anchors_bring_near_fingerprints_together(spark):
    rng = random.Random(32)
    rows = []
    for g in range(30):
        words = [f"w{rng.getrandbits(30)}" for _ in range(400)]
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join([*words[:399], "end"])), (10 * g + 2, " ".join(words[:-2]))]
    each = copies.classes(spark.createDataFrame(rows, "doc_id long, text string")).select("c", "fp").distinct()
    fps = {r.c: r.fp for r in each.collect()}
    got = {tuple(r) for r in copies.anchored(each).collect()}
    near = {(a, b) for a in fps for b in fps if a < b and bin((fps[a] ^ fps[b]) & (1 << 64) - 1).count("1") <= 3}
    assert got and got <= near
    # Each fingerprint is stood for by its smallest class; all pairs of those are there.
    first = {fp: min(c for c in fps if fps[c] == fp) for fp in fps.values()}
    assert {p for p in near if all(first[fps[c]] == c for c in p)} <= got


def test_known_pairs_are_bounded():
    ranks = ranks_of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rng = random.Random(33)
    texts = [" ".join("".join(rng.choices("abcdeéßñ字0123", k=rng.randint(1, 14))) for _ in range(60)) for _ in range(20)]
    free = Transducer(ranks, public_tokenizers.PATTERN)
    tight = Transducer(ranks, public_tokenizers.PATTERN, most_states=200, most_pieces=50, most_pairs=100)
    assert [tight.encode(t) for t in texts] == [free.encode(t) for t in texts]
    assert len(tight.fits) <= 100 < len(free.fits)


def test_tables_that_grow_with_the_documents_are_not_broadcast(spark):
    few = written(spark.range(50).select(F.xxhash64("id").alias("fp")), "few")
    pairs = anchors.links(few)
    sets = spark.range(4).selectExpr("id as c", "2L as n", "array(1L, 2L) as set")
    alike = copies.similar(spark.createDataFrame([(0, 1), (2, 3)], "a long, b long"), sets, 0.8)
    assert sorted(map(tuple, alike.collect())) == [(0, 1), (2, 3)]
    docs = spark.createDataFrame([(i, f"one two three four five {i % 2}") for i in range(4)], "doc_id long, text string")
    for df in (pairs, alike, anchors.near_duplicates(docs), anchors.one_of_each(docs)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()


def test_equal_items_are_searched_once_and_blocks_one_after_another(spark):
    words = [f"word{i}" for i in range(60)]
    items = [(i, " ".join(words[:25])) for i in range(40)] + [(40, " ".join(words[30:55])), (3, " ".join(words[30:55])), (41, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "nothing of it")], "doc_id long, text string")
    parts = 80 * len(decontaminate.MASKS)
    whole, dealt = decontaminate.overlaps(docs, bench), decontaminate.overlaps(docs, bench, block_rows=parts)
    rows = sorted(map(tuple, whole.collect()))
    assert rows == sorted(map(tuple, dealt.collect())) and [r[1] for r in rows] == list(range(41))
    assert {r.item_id: r.n_hits for r in whole.collect()}[3] == rows[0][2] + rows[40][2]
    # 1,050 tokens of items, 50 of them different: one block, and where there are several their tables are not in one plan.
    assert "BroadcastExchange" in whole._jdf.queryExecution().executedPlan().toString()
    several = decontaminate.overlaps(docs, bench, block_rows=25 * len(decontaminate.MASKS))
    assert "xxhash64(0" in whole._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(0" in dealt._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(0" not in several._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, several.collect())) == rows
