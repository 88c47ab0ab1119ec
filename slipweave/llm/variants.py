"""Spelling variants: pairs of words at one edit, found by composing automata.

The words, sorted, are dealt by ranges of the vocabulary acceptor's initial paths; a range holds a bounded number of words.
Of each range the minimal acceptor A is built, and A o E o A is enumerated, E being the transducer that
inserts, deletes or replaces exactly one symbol. It starts at the states whose paths lie in one range alone, once per
state however many paths lead there; a path's words then follow from the numbers of words before each arc
(the acceptor is its own perfect hash).

A path that runs over the border of two ranges is an initial part: edits there are met by equality of what is left, one
key for each place of the initial part. So every pair is found once, by the place of its edit, which
is the length of the common prefix. Words of more than ``LONGEST`` code points have no
acceptor; all their places are keyed, by a rolling hash, and the pairs compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipweave.llm.shared import pick, written

LONGEST = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TIMES = 0x9E3779B97F4A7C15


def vocabulary(docs: DataFrame, shortest: int = 7, least: int = 2) -> DataFrame:
    """``word, n`` of all words of ``docs`` (``doc_id, text``): runs of Latin letters, A-Z lower-cased.

    A run loses one code point where 31 divides the crc32 of ``<doc_id>:<run>``. Counted are results of at least ``shortest``
    code points, kept those of at least ``least`` occurrences. A null text has no words; a null id reads as empty.
    """
    docs = pick(docs, "doc_id", "text")
    runs = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(r"[a-zÀ-ÿ]+"), F.lit(0))
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.filter(runs, lambda r: F.char_length(r) >= shortest)).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    word = F.when(h % 31 == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).filter(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least)


def common(a: Column, b: Column) -> Column:
    """Length of the common prefix of ``a`` and a border ``b``; no border has -1."""
    places = F.sequence(F.lit(1), F.greatest(F.least(F.char_length(a), F.char_length(b)), F.lit(1)))
    return F.when(b.isNull(), -1).otherwise(F.size(F.filter(places, lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i))))


class Acceptor:
    """The minimal acceptor of sorted distinct words, as arrays; states are numbers, arcs are sorted by state and symbol."""

    def __init__(self, words: list[str]):
        size = np.array([len(w) for w in words])
        wide = int(size.max())
        codes = np.zeros((len(words), wide), np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        codes[np.arange(wide) < size[:, None]] = flat
        same = np.zeros(len(words), np.int64)
        if len(words) > 1:
            equal = (codes[1:] == codes[:-1]) & (codes[1:] > 0)
            same[1:] = np.where(equal.all(axis=1), wide, np.argmin(equal, axis=1))
        self.size, self.same = size, same
        # Nodes of the tree of prefixes, level by level: the first word of each and the level.
        firsts, levels, parents, symbols, before = [], [], [], [], None
        total = 0
        for level in range(wide + 1):
            rows = np.flatnonzero((size >= level) & ((same < level) | (np.arange(len(words)) == 0)))
            firsts.append(rows)
            levels.append(np.full(len(rows), level))
            if level:
                parents.append(total - len(before) + np.searchsorted(before, rows, "right") - 1)
                symbols.append(codes[rows, level - 1])
            before = rows
            total += len(rows)
        self.first, self.level = np.concatenate(firsts), np.concatenate(levels)
        parent = np.concatenate(parents)  # of nodes 1, 2, ...
        self.symbols, symbol = np.unique(np.concatenate(symbols), return_inverse=True)
        final = size[self.first] == self.level
        # Height and number of words below, from the deepest level up.
        height, below = np.zeros(total, np.int64), final.astype(np.int64)
        starts = np.searchsorted(self.level, np.arange(wide + 2))
        for level in range(wide, 0, -1):
            own = np.arange(starts[level], starts[level + 1])
            np.maximum.at(height, parent[own - 1], height[own] + 1)
            np.add.at(below, parent[own - 1], below[own])
        arity = np.bincount(parent, minlength=total)
        child = np.argsort(parent, kind="stable") + 1  # children by parent, symbols ascending
        at = np.concatenate([[0], np.cumsum(arity)])
        # Equal states: a node is folded over its arcs, nodes of equal height together.
        state, n_states, chosen = np.empty(total, np.int64), 0, []
        for h in range(int(height.max()) + 1):
            nodes = np.flatnonzero(height == h)
            fold, used = final[nodes].astype(np.int64), 2
            for k in range(int(arity[nodes].max())):
                live = np.flatnonzero(arity[nodes] > k)
                arc = child[at[nodes[live]] + k]
                _, number = np.unique((fold[live] * len(self.symbols) + symbol[arc - 1]) * total + state[arc], return_inverse=True)
                fold[live] = used + number
                used += int(number.max()) + 1
            _, one, number = np.unique(fold, return_index=True, return_inverse=True)
            state[nodes] = n_states + number
            chosen.append(nodes[one])
            n_states += len(one)
        self.state = state
        nodes = np.concatenate(chosen)
        self.final = final[nodes]
        self.arity = arity[nodes]
        self.at = np.concatenate([[0], np.cumsum(self.arity)])
        arc = child[spread(at[nodes], self.arity)]
        self.symbol, self.target = symbol[arc - 1], state[arc]
        # Words of the state that come before those of the arc.
        skip = np.cumsum(below[arc]) - below[arc]
        self.skip = skip - np.repeat(skip[np.minimum(self.at[:-1], max(len(arc) - 1, 0))] if len(arc) else 0, self.arity) + np.repeat(self.final.astype(np.int64), self.arity)
        self.keys = np.repeat(np.arange(n_states), self.arity) * len(self.symbols) + self.symbol
        # Lengths a state can still accept, as bits.
        self.lengths = self.final.astype(np.uint64)
        order = height[nodes]
        for h in range(1, int(order.max()) + 1):
            own = np.flatnonzero(order == h)
            arcs = spread(self.at[own], self.arity[own])
            np.bitwise_or.at(self.lengths, np.repeat(own, self.arity[own]), self.lengths[self.target[arcs]] << np.uint64(1))

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The arc of each state for each symbol, -1 where there is none."""
        key = state * len(self.symbols) + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)


def spread(start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """``start[i], start[i] + 1, ...``, ``width[i]`` of them for every i."""
    total = int(width.sum())
    return np.repeat(start - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(total)


def composed(a: Acceptor, states: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``state, i, j``: words number i and j of the state's language that one edit of their first symbol turns into each other.

    Starts are taken in lots whose pairs of arcs number about ``most``.
    """
    cost = np.cumsum(a.arity[states] * (a.arity[states] + 1) // 2)
    for lot in np.split(states, np.searchsorted(cost, np.arange(most, int(cost[-1]) if len(cost) else 0, most), "right")):
        arcs = spread(a.at[lot], a.arity[lot])
        owner = np.repeat(lot, a.arity[lot])
        # Replaced: an arc of the state against each later one.
        later = a.at[owner + 1] - arcs - 1
        one, two = np.repeat(arcs, later), spread(arcs + 1, later)
        # Inserted: the state itself against each of its arcs; it may not read the inserted symbol next.
        start = np.concatenate([np.repeat(owner, later), owner])
        i = np.concatenate([a.skip[one], np.zeros(len(arcs), np.int64)])
        p = np.concatenate([a.target[one], owner])
        j = np.concatenate([a.skip[two], a.skip[arcs]])
        q = np.concatenate([a.target[two], a.target[arcs]])
        barred = np.concatenate([np.full(len(one), -1), a.symbol[arcs]])
        while len(start):
            both = (a.lengths[p] & a.lengths[q]) > 0
            start, i, p, j, q, barred = (x[both] for x in (start, i, p, j, q, barred))
            ends = a.final[p] & a.final[q]
            if ends.any():
                yield start[ends], i[ends], j[ends]
            arcs = spread(a.at[p], a.arity[p])
            row = np.repeat(np.arange(len(p)), a.arity[p])
            fits = a.symbol[arcs] != barred[row]
            arcs, row = arcs[fits], row[fits]
            other = a.step(q[row], a.symbol[arcs])
            fits = other >= 0
            arcs, row, other = arcs[fits], row[fits], other[fits]
            start, i, p = start[row], i[row] + a.skip[arcs], a.target[arcs]
            j, q, barred = j[row] + a.skip[other], a.target[other], np.full(len(row), -1)


def near_in(words: list[str], n: np.ndarray, borders: tuple[str | None, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Number of near words and place of the best one (-1: none) for sorted ``words``, but for edits on a path of ``borders``."""
    a = Acceptor(words)
    open_from = np.zeros(len(words), np.int64)
    for border in borders:
        if border is not None:
            shared = np.zeros(len(words), np.int64)
            for k in range(1, len(border) + 1):
                hits = [w[:k] == border[:k] for w in words]
                if not any(hits):
                    break
                shared += hits
            open_from = np.maximum(open_from, shared + 1)
    nodes = np.flatnonzero(a.level >= open_from[a.first])
    nodes = nodes[np.argsort(a.state[nodes], kind="stable")]
    states, paths = np.unique(a.state[nodes], return_counts=True)
    at = np.concatenate([[0], np.cumsum(paths)])
    near, best = np.zeros(len(words), np.int64), np.full(len(words), -1)
    order = np.lexsort((np.arange(len(words)), -n))
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    least = np.full(len(words), len(words))
    for start, i, j in composed(a, states):
        s = np.searchsorted(states, start)
        base = a.first[nodes[spread(at[s], paths[s])]]
        one, two = base + np.repeat(i, paths[s]), base + np.repeat(j, paths[s])
        near += np.bincount(one, minlength=len(words)) + np.bincount(two, minlength=len(words))
        np.minimum.at(least, one, place[two])
        np.minimum.at(least, two, place[one])
    some = least < len(words)
    best[some] = order[least[some]]
    return near, best


_FOUND = "word string, n long, near long, best struct<least: long, word: string>"


def _inside(group: pa.Table) -> pa.Table:
    """What the composition finds in one range."""
    group = group.sort_by("word")
    words, n = group["word"].to_pylist(), group["n"].to_numpy()
    near, best = near_in(words, n, (group["before"][0].as_py(), group["behind"][0].as_py()))
    rows = np.flatnonzero(near)
    told = [{"least": -int(n[b]), "word": words[b]} for b in best[rows]]
    kind = pa.struct([("least", pa.int64()), ("word", pa.string())])
    return pa.table({"word": pa.array([words[r] for r in rows], pa.string()), "n": pa.array(n[rows]), "near": pa.array(near[rows]), "best": pa.array(told, kind)})


def _contribution(word: str, n: str, other: str, other_n: str, near: Column | None = None) -> list[Column]:
    best = F.struct((-F.col(other_n)).alias("least"), F.col(other).alias("word")).alias("best")
    return [F.col(word).alias("word"), F.col(n).alias("n"), (F.lit(1).cast("long") if near is None else near).alias("near"), best]


def _initial(words: DataFrame) -> DataFrame:
    """Near words whose edit lies in the first ``depth`` code points; ``words`` has ``word, n, depth``."""
    placed = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.least(F.col("depth"), F.char_length("word")) - 1)).alias("at"))
    head, tail, lost = F.substr("word", F.lit(1), F.col("at")), F.substr("word", F.col("at") + 2), F.substr("word", F.col("at") + 1, F.lit(1))
    # Replaced: words alike but for one place. A key has at most one word for each letter there.
    members = placed.groupBy(F.concat(head, F.lit("*"), tail).alias("key")).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("least"), "word"))).alias("m"))
    each = members.filter(F.size("m") > 1).select("m", F.explode("m").alias("own"))
    best = F.when(F.col("own.word") == F.col("m")[0]["word"], F.col("m")[1]).otherwise(F.col("m")[0])
    replaced = each.select(F.col("own.word").alias("word"), (-F.col("own.least")).alias("n"), (F.size("m") - 1).cast("long").alias("near"), best.alias("best"))
    # Deleted: the last of a run of equal letters stands for the run. An edit at the very end is a place of the longer word.
    shorter = placed.filter(lost != F.substr("word", F.col("at") + 2, F.lit(1))).select(F.concat(head, tail).alias("key"), F.col("word").alias("longer"), F.col("n").alias("longer_n"))
    met = shorter.join(words.select(F.col("word").alias("key"), F.col("n").alias("key_n")), "key")
    return replaced.unionByName(met.select(*_contribution("longer", "longer_n", "key", "key_n"))).unionByName(met.select(*_contribution("key", "key_n", "longer", "longer_n")))


def rolled(word: str) -> tuple[np.ndarray, int]:
    """Hashes of the word without each of its code points, and of the whole word."""
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(codes) - 1, _TIMES, np.uint64)]), dtype=np.uint64)
    sums = np.cumsum(codes * powers, dtype=np.uint64)
    back = np.uint64(pow(_TIMES, -1, 1 << 64))
    return sums - codes * powers + (sums[-1] - sums) * back, int(sums[-1])


def _long(words: DataFrame) -> DataFrame:
    """Near words of which one has more than ``LONGEST`` code points; ``words`` has ``word, n`` of at least ``LONGEST``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w, name in zip(b.column(0), b.column(1)):
                lost, whole = rolled(w.as_py())
                hashes = np.concatenate([[np.uint64(whole)], lost]).view(np.int64)
                for at in range(0, len(hashes), 1 << 16):
                    part = hashes[at : at + (1 << 16)]
                    # Place -1 is the whole word.
                    yield pa.record_batch([pa.repeat(name, len(part)), pa.array(part), pa.array(np.arange(at, at + len(part)) - 1)], ["id", "key", "at"])

    words = words.select("word", F.xxhash64("word").alias("id"), "n")
    keys = written(words.select("word", "id").mapInArrow(run, "id long, key long, at long"), "long-keys")
    lost, whole = keys.filter("at >= 0"), keys.filter("at < 0").select("key", F.col("id").alias("a"))
    replaced = lost.select("key", "at", F.col("id").alias("a")).join(lost.select("key", "at", F.col("id").alias("b")), ["key", "at"]).filter("a < b").select("a", "b")
    deleted = lost.select("key", F.col("id").alias("b")).join(whole, "key").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = replaced.union(deleted).distinct()
    one = words.select(F.col("id").alias("a"), F.col("word").alias("u"), F.col("n").alias("nu"))
    two = words.select(F.col("id").alias("b"), F.col("word").alias("v"), F.col("n").alias("nv"))
    met = pairs.join(one, "a").join(two, "b").filter(F.greatest(F.char_length("u"), F.char_length("v")) > LONGEST).filter(F.levenshtein("u", "v", 1) == 1)
    return met.select(*_contribution("u", "nu", "v", "nv")).unionByName(met.select(*_contribution("v", "nv", "u", "nu")))


def neighbours(words: DataFrame, block: int = 20_000) -> DataFrame:
    """``word, n, near, best`` per row of ``words`` (``word, n``, distinct): near words and the most frequent of them.

    ``best`` is ``least`` (minus the near word's n) and ``word``; of equal n the first in code-point order. A range holds about ``block`` words.
    """
    words = written(words.select("word", "n"), "words")
    short = words.filter(F.char_length("word") <= LONGEST)
    ranges = max(1, -(-short.count() // block))
    placed = written(short.repartitionByRange(ranges, "word").withColumn("part", F.spark_partition_id()), "ranges")
    # One row for each range; paths over a border are prefixes of what its two words share.
    ends = sorted(placed.groupBy("part").agg(F.min("word").alias("low"), F.max("word").alias("high")).collect())
    shared = [next((b.low[:k] for k in range(min(len(a.high), len(b.low)), 0, -1) if a.high[:k] == b.low[:k]), "") for a, b in zip(ends, ends[1:])]
    spark = words.sparkSession
    borders = [(e.part, before, behind) for e, before, behind in zip(ends, [None, *shared], [*shared, None])]
    borders = spark.createDataFrame(borders, "part int, before string, behind string")
    placed = placed.join(F.broadcast(borders), "part")
    inside = placed.groupBy("part").applyInArrow(_inside, _FOUND)
    depth = F.greatest(common(F.col("word"), F.col("before")), common(F.col("word"), F.col("behind"))) + 1
    initial = _initial(placed.select("word", "n", depth.alias("depth")).filter("depth > 0"))
    found = inside.unionByName(initial).unionByName(words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<least: long, word: string>").alias("best")))
    long = words.filter(F.char_length("word") >= LONGEST)
    if not long.filter(F.char_length("word") > LONGEST).isEmpty():
        found = found.unionByName(_long(long))
    return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("near"), F.min("best").alias("best"))


def _light(pointers: DataFrame, most_bytes: int = 1 << 23) -> DataFrame:
    """``pointers`` marked for broadcast if their counted bytes are few; beyond that the join shuffles, and may split a frequent root."""
    size = pointers.agg(F.sum(sum(F.octet_length(c) + 40 for c in pointers.columns))).first()[0] or 0
    return F.broadcast(pointers) if size <= most_bytes else pointers


def variants(docs: DataFrame, times: int = 10, shortest: int = 7, least: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs`` (``doc_id, text``), see :func:`vocabulary`.

    ``form`` is the near word of largest n (of equal ones the first in code-point order), if it occurs at least ``times`` as
    often; ``root`` is the last word that forms lead to. As n grows by ``times`` with each form, pointers are doubled
    a few times only. Null texts have no words, repeated rows count again, an empty table gives no rows, and
    other columns are not read. Very long words are compared like any other.
    """
    found = neighbours(vocabulary(docs, shortest, least))
    fits = -F.col("best.least") >= times * F.col("n")
    found = written(found.select(
        "word", F.when(fits, F.col("best.word")).alias("form"), "n", F.col("near").alias("n_near"), F.when(fits, -F.col("best.least")).alias("form_n")), "variants")
    roots = written(found.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = roots.join(_light(further), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = written(moved, "roots")
        roots = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    out = found.join(_light(roots), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
