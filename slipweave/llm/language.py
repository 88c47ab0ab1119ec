"""Language identification by nearest centroid.

A text becomes a vector of hashed character n-grams (one to three, over lower-case letters with spaces between words),
weighted by log counts times inverse document frequency and normalised. Each language has several centroids, found
by spherical k-means among its own texts. A text gets the language of the most similar centroid; one that is farther
from it than nearly all of that centroid's own texts are is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipweave.llm.shared import pick

BINS = 1 << 13
#: So many texts of a cluster, or else of its language, tell how far its own texts lie.
FEW = 30
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Lower-case code of every letter, a space for all else; built once per worker."""
    lower = (c.lower() if (c := chr(i)).isalpha() else " " for i in range(0x110000))
    return np.fromiter((ord(c[0]) for c in lower), np.uint32, 0x110000)


def gram_bins(text: str | None) -> np.ndarray:
    """Counts of the hashed n-grams of the whole text; no letter gives zeros."""
    total = np.zeros(BINS, np.float32)
    codes = np.frombuffer(f" {text or ''} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    # In pieces, with an overlap of two, so that a text of any length needs little memory.
    tail = np.empty(0, np.uint64)
    for at in range(0, len(codes), 1 << 18):
        c = _letters()[codes[at : at + (1 << 18)]].astype(np.uint64)
        space = c == 32
        before = np.empty(len(c), bool)
        before[0], before[1:] = len(tail) > 0 and tail[-1] == 32, space[:-1]
        c = np.concatenate([tail, c[~(space & before)]])
        if len(c) < 3:
            tail = c
            continue
        pair = c[:-1] * np.uint64(0x1F123BB5) + c[1:]
        triple = pair[:-1] * np.uint64(0x1F123BB5) + c[2:]
        grams = np.concatenate([c[len(tail) :] + np.uint64(1), pair[max(0, len(tail) - 1) :] + np.uint64(2), triple + np.uint64(3)])
        total += np.bincount(((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(51)).view(np.int64), minlength=BINS)
        tail = c[-2:]
    return total


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors, written over ``counts``."""
    v = np.log1p(counts, out=counts)
    v *= idf
    v /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-12)[:, None]
    return v


@dataclass
class Centroids:
    """``langs`` and ``reach`` (least accepted cosine) by centroid; rows of ``matrix`` are unit vectors."""

    idf: np.ndarray
    langs: list[str]
    matrix: np.ndarray
    reach: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and rejection of every text; null or letterless texts are unknown, zero and rejected."""
        counts = np.stack([gram_bins(t) for t in texts]) if texts else np.zeros((0, BINS), np.float32)
        known, grams = counts.any(axis=1), counts.sum(axis=1)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = vectors(counts, self.idf) @ self.matrix.T
        best = cosine.argmax(axis=1)
        # Rounded to what single precision holds, so that a text's score does not depend on its neighbours in the batch.
        score = np.where(known, np.clip(cosine.max(axis=1), 0, 1), 0.0).astype(np.float64).round(6)
        langs = [self.langs[i] if k else UNKNOWN for i, k in zip(best, known)]
        # Few n-grams leave a vector far from any centroid, so the bound loosens with length.
        few = np.minimum(1, np.sqrt(grams / 1500))
        return langs, score, ~known | (score < self.reach[best] * few)


def cluster(counts: np.ndarray, idf: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart starts, and the cosine that one text in 1,000 of each cluster stays under, less a margin.

    A cluster of few texts takes the bound of all texts given here; where these are few too, nothing is known of the distance of
    further texts, and the bound is zero. ``counts`` are overwritten: a sample of some thousand texts is held once.
    """
    v = vectors(counts, idf)
    starts = [int((v @ v.mean(axis=0)).argmax())]
    while len(starts) < min(k, len(v)):
        starts.append(int((v @ v[starts].T).max(axis=1).argmin()))
    centres = v[starts]
    for _ in range(rounds):
        own = (v @ centres.T).argmax(axis=1)
        members = (own == np.arange(len(centres))[:, None]).astype(np.float32)
        size = members.sum(axis=1, keepdims=True)
        centres = np.where(size > 0, members @ v / np.maximum(size, 1), centres)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    cosine = v @ centres.T
    own = cosine.argmax(axis=1)
    least = lambda x, other: np.quantile(x, 0.001) * 0.8 if len(x) >= FEW else other
    pooled = least(cosine.max(axis=1), 0.0)
    reach = [least(cosine[own == c, c], pooled) for c in range(len(centres))]
    return centres.astype(np.float32), np.array(reach)


def fit(labelled: DataFrame, k: int = 3, sample: int = 2000) -> Centroids:
    """Centroids of every language of ``labelled`` (``text, lang``); rows without a language or a letter teach nothing.

    Document frequencies are counted over all labelled rows. The clusters of a language are fitted on about ``sample``
    of its distinct texts, chosen by a hash of the text (all of them, if it has no more), by one task per language. Copies
    take no part in that share. What reaches the driver is ``k`` vectors per language.
    """

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(BINS, np.int64)
        for b in batches:
            for t in b.column(0):
                seen = gram_bins(t.as_py()) > 0
                df += seen
                n += bool(seen.any())
        yield pa.record_batch([pa.array(np.arange(BINS + 1)), pa.array(np.append(df, n))], ["bin", "n"])

    rows = pick(labelled, "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    by_bin = {r["bin"]: r["n"] for r in rows.select("text").mapInArrow(frequencies, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    docs = by_bin.get(BINS, 0)
    if not docs:
        return Centroids(np.ones(BINS, np.float32), [], np.zeros((0, BINS), np.float32), np.zeros(0))
    idf = np.array([np.log((1 + docs) / (1 + by_bin.get(i, 0))) + 0.05 for i in range(BINS)], np.float32)

    def clusters(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        counts, n = np.empty((len(frame), BINS), np.float32), 0
        for t in frame.text:
            counts[n] = gram_bins(t)
            n += bool(counts[n].any())
        counts = counts[:n]
        if not n:
            return pd.DataFrame({"lang": [], "centre": [], "reach": []})
        centres, reach = cluster(counts, idf, k)
        return pd.DataFrame({"lang": key[0], "centre": [c.tolist() for c in centres], "reach": reach})

    distinct = rows.select("lang", F.xxhash64("text", F.lit(17)).alias("h")).distinct()
    sizes = {r["lang"]: r["count"] for r in distinct.groupBy("lang").count().collect()}
    shares = {lang: min(1.0, sample / n) for lang, n in sizes.items()}
    share = F.create_map(*[F.lit(x) for item in shares.items() for x in item])[F.col("lang")]
    # Equal texts have equal hashes, so the sample holds a text with all its copies or not at all.
    chosen = rows.filter(F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1 << 20)) < share * (1 << 20)).dropDuplicates(["text", "lang"])
    found = chosen.groupBy("lang").applyInPandas(clusters, "lang string, centre array<float>, reach double").orderBy("lang", "reach").collect()
    return Centroids(idf, [r["lang"] for r in found], np.array([r["centre"] for r in found], np.float32).reshape(-1, BINS), np.array([r["reach"] for r in found]))


def predict(docs: DataFrame, model: Centroids) -> DataFrame:
    """All columns of ``docs``, then ``lang_pred, score, rejected`` read from its column ``text`` alone.

    A column of ``docs`` of one of the three names is replaced. Repeated rows are judged alike; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # bounded by the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                langs, score, rejected = sent.value.predict(part.column(part.num_columns - 1).to_pylist())
                yield pa.record_batch(
                    [*part.columns[:-1], pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)],
                    [*part.schema.names[:-1], "lang_pred", "score", "rejected"])

    text = docs.columns.index("text")
    kept = [i for i, c in enumerate(docs.columns) if c not in ("lang_pred", "score", "rejected")]
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    out = numbered.select(*[f"c{i}" for i in kept], F.col(f"c{text}").alias("text_read"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in out.schema.fields[:-1]), "lang_pred string", "score double", "rejected boolean"])
    return out.mapInArrow(run, schema).toDF(*[docs.columns[i] for i in kept], "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, model: Centroids) -> DataFrame:
    """The rows of ``docs`` whose text is not rejected, with all their columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    found = predict(docs.toDF(*names[:at], "text", *names[at + 1 :]), model)
    return found.filter(~F.col("rejected")).drop("lang_pred", "score", "rejected").toDF(*docs.columns)


def held_out(doc_id: str = "doc_id"):
    """Whether the id belongs to the third that is never learned from; a null id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame) -> Centroids:
    """The model of the texts of ``docs`` (``doc_id, text, lang``) that are not held out."""
    return fit(pick(docs, "doc_id", "text", "lang").filter(~held_out()))
