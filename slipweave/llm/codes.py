"""Product codes of vectors, nearest codebook entries found by Orchard's search.

Components become whole numbers, so distances, ties and sums are exact. Vectors are cut into equal parts; each part
position has its own codebook, first taken from the vectors of the smallest ids, then moved to the means of what was
assigned to it. A codebook keeps, for every entry, the list of all entries by distance from it. A search begins at
some entry and goes down that entry's list; where it meets an entry closer to the query it jumps to that one's
list. Entries already compared are marked and not compared again. It stops at the first entry
further from the current one than twice the query's distance: by the triangle inequality none behind it
can be closer, and equally close ones lie at twice the distance at most, so ties are settled exactly too.

The searches of one batch go in step. Tasks return sums and counts per entry; vectors are never moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipweave.llm.shared import pick, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Scaled components reach no further: squared distances of 64 components beyond it would not fit a long.
REACH = 1 << 27


class Book:
    """One codebook: ``entries`` is an array of whole numbers, one row for each entry."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        self.lists = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.lists, axis=1)

    def search(self, queries: np.ndarray, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry (of equal ones the lowest) and its squared distance, for each query."""
        n, k = len(queries), len(self.entries)
        current, place = np.full(n, start), np.zeros(n, np.int64)
        distance = ((queries - self.entries[start]) ** 2).sum(axis=1)
        marked = np.zeros((n, k), bool)
        marked[:, start] = True
        live = np.arange(n)
        while len(live):
            at = current[live], place[live]
            # Squared: further than twice the distance.
            live = live[self.apart[at] <= 4 * distance[live]]
            entry = self.lists[current[live], place[live]]
            place[live] += 1
            fresh = ~marked[live, entry]
            rows, entry = live[fresh], entry[fresh]
            marked[rows, entry] = True
            found = ((queries[rows] - self.entries[entry]) ** 2).sum(axis=1)
            better = (found < distance[rows]) | ((found == distance[rows]) & (entry < current[rows]))
            rows, entry = rows[better], entry[better]
            current[rows], distance[rows], place[rows] = entry, found[better], 0
            live = live[place[live] < k]
        return current, distance


def whole(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """``vec_id, label, x`` of the fit rows; ``x`` are the components as whole numbers, all of one length.

    Unfit are null vectors, those with a null or non-finite component, and those whose length is not a multiple of
    the number of parts, or differs from that of the smallest id (of rows of one id, of the smallest vector).
    """
    rows = pick(vectors, "vec_id", "embedding", "label")
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(good & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    scaled = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(float(-REACH))), F.lit(float(REACH)))))
    rows = rows.select("vec_id", "label", scaled.alias("x"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").first()
    return rows if first is None else rows.filter(F.size("x") == len(first.x))


def _parts(column: pa.Array, parts: int) -> np.ndarray:
    """The vectors of a batch as part x row x component."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(len(column), parts, -1).transpose(1, 0, 2)


def _sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``part, entry, n, s0, s1, ...``: counts and sums of what is nearest to each used entry."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Book(b) for b in books]
        count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for b in batches:
            for p, queries in enumerate(_parts(b.column(0), len(books))):
                nearest, _ = own[p].search(queries)
                count[p] += np.bincount(nearest, minlength=books.shape[1])
                np.add.at(total[p], nearest, queries)
        part, entry = np.nonzero(count)
        yield pa.record_batch([pa.array(part), pa.array(entry), pa.array(count[part, entry]), *(pa.array(total[part, entry, i]) for i in range(width))],
                              ["part", "entry", "n", *(f"s{i}" for i in range(width))])

    names = [f"s{i}" for i in range(width)]
    found = rows.select("x").mapInArrow(run, "part long, entry long, n long, " + ", ".join(f"{s} long" for s in names))
    exact = [F.sum(F.col(s).cast("decimal(38,0)")).alias(s) for s in names]
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *exact)


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after ``rounds``, part x entry x component, from ``rows`` of :func:`whole`.

    The driver holds ``entries`` vectors and one sum for each entry, however many rows there are. Fewer rows give fewer entries.
    """
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 1), np.int64)
    books = np.array([r.x for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for r in _sums(rows, books).collect():
            books[r.part, r.entry] = [int(s) // r.n for s in r[3:]]
    return books


def assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of every row of ``rows``."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Book(b) for b in books]
        for b in batches:
            error, codes = np.zeros(b.num_rows, np.int64), []
            for p, queries in enumerate(_parts(b.column(2), len(books))):
                nearest, distance = own[p].search(queries)
                codes.append(nearest)
                error += distance
            told = ["".join(f"{c:02x}" for c in code) for code in np.array(codes).T.tolist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(told, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_totals(coded: DataFrame, share: int = 10_000) -> DataFrame:
    """``coded`` (a written table) with ``label_error``, the error summed over equal labels, nulls together.

    At most ``share`` labels can each hold more than one row in ``share``: these are broadcast. The rows of all others
    are joined by label, none of which is frequent. A sum beyond a long is null.
    """
    n = coded.count()
    totals = written(coded.groupBy("label").agg(F.count("*").alias("of"), F.try_sum("error").alias("label_error")), "label-errors")

    def met(left: DataFrame, side: DataFrame, how: str) -> DataFrame:
        side = side.select(F.col("label").alias("its"), "label_error", F.lit(True).alias("met"))
        return left.join(side, F.col("label").eqNullSafe(F.col("its")), how).drop("its")

    often = F.col("of") * share > n
    frequent = met(coded, F.broadcast(totals.filter(often)), "left")
    done = frequent.filter("met")
    if not totals.filter(~often).isEmpty():
        done = done.unionByName(met(frequent.filter("met is null").select(coded.columns), totals.filter(~often), "inner"))
    return done.drop("met")


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every fit row of ``vectors`` (``vec_id, embedding, label``).

    What is fit, :func:`whole` says; an empty table, or one without a fit row, gives no rows. Repeated rows count as often as they stand there and
    come back as often. Components from 2**19 on count as 2**19, as squared errors beyond would not fit a long.
    Ties go to the lower entry. Other columns are not read.
    """
    rows = whole(vectors, parts)
    books = fit(rows, parts, entries, rounds)
    coded = written(assigned(rows, books), "codes")
    return with_totals(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
