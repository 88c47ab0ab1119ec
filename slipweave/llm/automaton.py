"""Language-model scoring with a weighted backoff automaton.

The model is a bigram model with Dirichlet smoothing towards add-one unigrams: with c the training counts, N all
tokens, V the distinct ones and ``mass`` the weight of the prior,

    P(w) = (c(w) + 1) / (N + V + 1)            P(w | h) = (c(h w) + mass P(w)) / (c(h) + mass)

which sums to one over the known words and one unknown. As an automaton: a root and a state per known word; an arc per seen pair
from its first word's state; from each state a failure arc to the root, which consumes nothing and weighs
mass / (c(h) + mass); from the root an arc per known word and a loop for unknown ones. A text is
read once from left to right, carrying the state and adding log-probabilities.

No machine holds the model. Documents are dealt into blocks of bounded size by hash. A block asks for the counts of
just the words and pairs it holds: sorted 64-bit hashes, sent as gaps, cut into shards by their upper bits, with its own training counts. A shard
adds up what the blocks bring and answers each in the order it asked. So a word of whatever frequency is one entry per block,
and the automaton of a block has the states and arcs its own texts can reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipweave.llm.shared import pick, written

#: The end of a text; no word holds a space.
END = b" end"


class Block:
    """The tokens of the texts of one block as numbers, and its distinct words and pairs in order of hash."""

    def __init__(self, texts: list[str | None]):
        ids: dict[bytes, int] = {END: 0}
        parts, self.lengths = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = (text or "").encode().lower().split()
            parts.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)))
            parts.append(np.zeros(1, np.int64))
            self.lengths[i] = len(words) + 1
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, ids), np.uint64, len(ids))
        order = np.argsort(hashes)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.words = hashes[order]
        self.tokens = place[np.concatenate(parts)] if parts else np.zeros(0, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.second = np.ones(len(self.tokens), bool)
        self.second[self.starts] = False
        self.at = np.flatnonzero(self.second)
        h = self.words
        with np.errstate(over="ignore"):
            pairs = (h[self.tokens[self.at - 1]] * np.uint64(0x9E3779B97F4A7C15) ^ h[self.tokens[self.at]]) * np.uint64(0xC2B2AE3D27D4EB4F)
            pairs ^= pairs >> np.uint64(29)
        self.pairs, first, self.pair_of = np.unique(pairs, return_index=True, return_inverse=True)
        self.heads, self.tails = self.tokens[self.at[first] - 1], self.tokens[self.at[first]]

    def counts(self, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often the words and the pairs occur in the texts marked as training texts."""
        of_token = np.repeat(trained, self.lengths)
        return (
            np.bincount(self.tokens[of_token], minlength=len(self.words)),
            np.bincount(self.pair_of[of_token[self.at]], minlength=len(self.pairs)),
        )


class Automaton:
    """States are the root (0) and word + 1 for known words; ``arcs`` holds state and word in one sorted number."""

    def __init__(self, block: Block, words: np.ndarray, pairs: np.ndarray, n: int, v: int, mass: float):
        p = (words + 1) / (n + v + 1)
        seen = np.flatnonzero(pairs > 0)
        head, tail = block.heads[seen], block.tails[seen]
        keys = (head + 1) << 32 | tail
        order = np.argsort(keys)
        self.arcs = np.append(keys[order], np.iinfo(np.int64).max)
        self.weights = np.append(np.log10((pairs[seen] + mass * p[tail]) / (words[head] + mass))[order], 0.0)
        self.root = np.log10(p)
        self.fail = np.concatenate([[0.0], np.log10(mass / (words + mass))])
        self.enter = np.where(words > 0, np.arange(1, len(words) + 1), 0)

    def read(self, block: Block) -> np.ndarray:
        """Log-probability of every text; all texts of the block take their steps side by side, longest first."""
        order = np.argsort(-block.lengths, kind="stable")
        starts, lengths = block.starts[order], block.lengths[order]
        total, state = np.zeros(len(order)), np.zeros(len(order), np.int64)
        active = len(order)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            while lengths[active - 1] <= step:
                active -= 1
            word = block.tokens[starts[:active] + step]
            key = state[:active] << 32 | word
            at = np.searchsorted(self.arcs, key)
            total[:active] += np.where(self.arcs[at] == key, self.weights[at], self.fail[state[:active]] + self.root[word])
            state[:active] = self.enter[word]
        out = np.empty(len(order))
        out[order] = total
        return out


def cut(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins in sorted keys; shards are equal ranges of the upper 32 bits."""
    edges = [-(-(s << 32) // shards) << 32 for s in range(shards)]
    return np.append(np.searchsorted(keys, np.array(edges, np.uint64)), len(keys))


def gaps(keys: np.ndarray) -> bytes:
    """Sorted keys as the first one and the gaps between them, in as many bytes as the widest gap needs."""
    gap = np.diff(keys)
    width = (int(gap.max()).bit_length() + 7) // 8 if len(gap) else 0
    return bytes([width]) + keys[:1].tobytes() + gap.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def ungapped(raw: bytes) -> np.ndarray:
    width, first = raw[0], np.frombuffer(raw, np.uint64, 1, offset=1)
    if not width:
        return first
    rest = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    gap = np.zeros((len(rest), 8), np.uint8)
    gap[:, :width] = rest
    return np.cumsum(np.append(first, gap.view(np.uint64).ravel()), dtype=np.uint64)


def held_out(doc_id: str = "doc_id"):
    """Whether the id belongs to the seventh that is never learned from; a null id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


def scores(docs: DataFrame, mass: float = 2.0, block_bytes: int = 8 << 20) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs`` (``doc_id, text``).

    Training texts are those not held out. A null text is empty: its only token is the end. With no training text
    every token is unknown and has probability one. Repeated rows count as often as they stand; an empty table gives an empty one.
    """
    rows = pick(docs, "doc_id", "text").select("doc_id", held_out().alias("held_out"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // block_bytes + 1
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    def ask(group: pa.Table) -> pa.Table:
        block = Block(group["text"].to_pylist())
        trained = ~np.array(group["held_out"].to_pylist(), bool)
        out = []
        for level, (keys, counts) in enumerate(zip((block.words, block.pairs), block.counts(trained))):
            edges = cut(keys, blocks)
            for shard in np.flatnonzero(np.diff(edges)):
                a, z = edges[shard], edges[shard + 1]
                out.append((group["block"][0].as_py(), int(shard), level, gaps(keys[a:z]), counts[a:z].astype(np.int32).tobytes()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["block", "shard", "level", "keys", "counts"])

    def answer(group: pa.Table) -> pa.Table:
        """Totals in each asking block's own order; the first row also says how many words the shard knows and how often they occur."""
        keys = [ungapped(k) for k in group["keys"].to_pylist()]
        counts = [np.frombuffer(c, np.int32) for c in group["counts"].to_pylist()]
        level = group["level"][0].as_py()
        found, place = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(place, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)
        back = np.split(totals[place], np.cumsum([len(k) for k in keys])[:-1])
        words = (int((totals > 0).sum()), int(totals.sum())) if level == 0 else (0, 0)
        n = group.num_rows
        return pa.Table.from_arrays(
            [group["block"], group["shard"], group["level"], pa.array([t.tobytes() for t in back], pa.binary()),
             pa.array([words[0]] + [0] * (n - 1)), pa.array([words[1]] + [0] * (n - 1))],
            ["block", "shard", "level", "totals", "known", "tokens"])

    asked = dealt.groupBy("block").applyInArrow(ask, "block long, shard long, level int, keys binary, counts binary")
    answers = written(
        asked.groupBy("shard", "level").applyInArrow(answer, "block long, shard long, level int, totals binary, known long, tokens long"), "counts")
    v, n = answers.agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()

    def read(texts: pa.Table, told: pa.Table) -> pa.Table:
        block = Block(texts["text"].to_pylist())
        parts = sorted(zip(told["level"].to_pylist(), told["shard"].to_pylist(), told["totals"].to_pylist()))
        words, pairs = (np.frombuffer(b"".join(t for at, _, t in parts if at == level), np.int64) for level in (0, 1))
        fsa = Automaton(block, words, pairs, n, v, mass)
        per_text = lambda x: np.add.reduceat(x[block.tokens], block.starts)
        return pa.Table.from_arrays(
            [texts["doc_id"], texts["held_out"], pa.array(block.lengths), pa.array(per_text((words > 0).astype(np.int64))),
             pa.array(np.full(len(block.lengths), n)), pa.array(per_text(fsa.root)), pa.array(fsa.read(block))],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        read, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
