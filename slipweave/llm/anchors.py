"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits. Two fingerprints that differ in at most three bits differ in at most one bit of either
their lower or their upper half. Each half is covered by anchors: the words of the perfect [31, 26] Hamming code
(over the lower 31 bits of the half), whose balls of radius one fill the space. A fingerprint is replicated to
every anchor within covering radius plus threshold, 1 + 1 = 2 bits: to 16 anchors, or to one if its half is an
anchor itself. Of two fingerprints within one bit the first one's nearest anchor (radius one) is then always
among the anchors of the second (two bits), so comparing per anchor what is *at home* there with what was replicated there misses nothing.

The anchors of 2**26 cells per half are known by the syndrome; no table of them exists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipweave.llm.shared import components, dealt, pick, written

BITS, SEED = 64, 42


def simhash(text: str | None, width: int = 3) -> int:
    """Signed 64-bit fingerprint: majority of the bits of XXH64 over the word shingles, repeats included.

    Letters A-Z are lower-cased and words are runs without ASCII white space. Fewer words than ``width`` make one
    shingle; no word (also null) gives zero.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    return majority(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles)))


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit number whose bits are those set in over half of ``hashes``."""
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[start : start + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, text_hash, fp`` (signed long) of every row of ``docs`` (``doc_id, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [simhash(t.as_py(), width) for t in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_hash", "fp"])

    docs = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def syndrome(half: np.ndarray) -> np.ndarray:
    """Syndrome of the lower 31 bits: zero for an anchor, else the (1-based) bit whose flip gives one."""
    s = np.zeros(len(half), np.int64)
    for i in range(31):
        s ^= np.where((half >> i) & 1, i + 1, 0)
    return s


def within(half: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(rows, anchor, home)`` for all anchors within two bits of each half; ``home`` marks the nearest one."""
    x = half & 0x7FFFFFFF
    s = syndrome(x)
    near = x ^ np.where(s > 0, np.left_shift(1, np.maximum(s - 1, 0)), 0)
    out = [(np.arange(len(x)), near, np.ones(len(x), bool))]
    for i in range(1, 32):
        j = s ^ i
        # Bits i and j together have the same syndrome as the nearest anchor's bit.
        rows = np.flatnonzero((s > 0) & (j > i))
        out.append((rows, x[rows] ^ (1 << (i - 1)) ^ np.left_shift(1, j[rows] - 1), np.zeros(len(rows), bool)))
    return out


def replicate(fps: DataFrame) -> DataFrame:
    """``cell, home, fp``: a row for each anchor within reach; ``cell`` joins the half's number and the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Room for 34 rows per fingerprint at most.
            for at in range(0, b.num_rows, 1 << 15):
                fp = b.column(0).slice(at, 1 << 15).to_numpy(zero_copy_only=False)
                for part in (0, 1):
                    half = (fp.view(np.uint64) >> np.uint64(32 * part)).astype(np.int64) & 0xFFFFFFFF
                    for rows, anchor, home in within(half):
                        yield pa.record_batch(
                            [pa.array(anchor | (part << 31)), pa.array(home), pa.array(fp[rows])], ["cell", "home", "fp"])

    return fps.select("fp").mapInArrow(run, "cell long, home boolean, fp long")


def links(fps: DataFrame, threshold: int = 3) -> DataFrame:
    """``a, b``: pairs of different fingerprints that differ in at most ``threshold`` (0 to 3) bits."""
    if not 0 <= threshold <= 3:
        raise ValueError("the two halves cover thresholds up to three bits")
    cells = replicate(fps)
    home = cells.filter("home").select("cell", F.col("fp").alias("a"))
    away = cells.select("cell", F.col("fp").alias("b"))
    return (
        home.join(dealt(away), "cell")
        .filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, threshold: int = 3, width: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id, fp, text_hash, root`` per row of ``docs`` (``doc_id, text``).

    ``component_id`` is the smallest id that can be reached over links of at most ``threshold`` bits, ``root`` the
    smallest fingerprint of the component. Equal fingerprints meet once, as one class, before anything is compared.
    Null and empty texts have fingerprint zero and link like any other. Rows without an id take part; a component
    of such rows alone has a null id. Repeated rows come back as often as they went in; an empty table gives none.
    """
    prints = written(fingerprints(docs, width), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(classes, threshold))
    rooted = classes.join(dealt(roots), classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(dealt(firsts), "root").select("fp", "root", "component_id")
    return prints.join(dealt(named), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp", "text_hash", "root")


def one_of_each(docs: DataFrame, threshold: int = 3, width: int = 3) -> DataFrame:
    """The row of the smallest id of every component, with all columns of ``docs``.

    Of rows that share that id the one of the smallest text hash stays, once. Rows without an id stay only where
    no row of their component has one.
    """
    return first_of_each(docs, near_duplicates(docs, threshold, width))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows ``one_of_each`` keeps, by the components of ``found`` (``doc_id, text_hash, root`` per row of ``docs``)."""
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("s"))
    chosen = F.col("doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("text_hash") == F.col("s.text_hash"))
    stay = written(
        found.join(dealt(first), "root").filter(chosen).groupBy("doc_id", "text_hash").agg(F.count("*").alias("times"))
        .select(F.col("doc_id").alias("stay_id"), F.col("text_hash").alias("stay_hash"), "times"), "stay")
    keys = pick(docs, "doc_id", "text")
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own, text = (f"c{docs.columns.index(c)}" for c in keys.columns)
    hashed = numbered.withColumn("hash", F.xxhash64(text))
    kept = hashed.join(dealt(stay), F.col(own).eqNullSafe(F.col("stay_id")) & (F.col("hash") == F.col("stay_hash"))).drop("stay_id", "stay_hash")
    # Only rows that stand there several times are gathered to keep one of them.
    once = kept.filter("times = 1").drop("times")
    if not stay.filter("times > 1").isEmpty():
        once = once.union(kept.filter("times > 1").drop("times").dropDuplicates([own, "hash"]))
    return once.drop("hash").toDF(*docs.columns)
