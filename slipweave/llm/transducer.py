"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decode.

Reading a piece byte by byte, the encoding of every prefix has one last token. That token begins at an earlier
prefix end whose own last token it is *compatible* with: the merges split the two tokens' bytes into just these two.
Such local compatibility makes a whole sequence the encoding of its bytes (Berglund and van der Merwe, 2023), so the encoding of
the prefixes is all a reader must carry. Of those only the ones matter from which a token still being read may
start. A state is that set: the unread suffix and, for each start in it, the tokens not yet written.
What all of them share can no longer change and is written at once, so lookahead is bounded by the longest token.
States and arcs come into being when first needed and are dropped together when there are too many.

Decoding feeds token bytes to an incremental UTF-8 machine that holds back at most three bytes of an unfinished character.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from slipweave.llm.shared import pick


_NONE: dict = {}
#: Bytes from which on a piece is written to a list; below, growing a tuple is faster.
LONG = 4_096


class State:
    """``packed`` holds what the state stands for, in one small object: see :func:`pack`."""

    __slots__ = ("arcs", "packed", "rest")

    def __init__(self, packed: bytes, rest: tuple[int, ...]):
        self.arcs: dict[int, tuple[State, tuple[int, ...]]] = _NONE
        self.packed, self.rest = packed, rest


def pack(suffix: bytes, live: list[tuple[int, tuple[int, ...]]], before: int) -> bytes:
    """``live``: (bytes since a possible start, tokens up to it not yet written), longest first, the whole prefix last."""
    numbers = [before, len(live)]
    for width, tokens in live:
        numbers += (width, len(tokens), *tokens)
    return array("i", [len(numbers), *numbers]).tobytes() + suffix


def unpack(packed: bytes) -> tuple[bytes, list[tuple[int, tuple[int, ...]]], int]:
    size = int.from_bytes(packed[:4], sys.byteorder)
    numbers = array("i")
    numbers.frombytes(packed[4 : 4 + 4 * size])
    live, at = [], 2
    for _ in range(numbers[1]):
        width, n = numbers[at], numbers[at + 1]
        live.append((width, tuple(numbers[at + 2 : at + 2 + n])))
        at += 2 + n
    return packed[4 + 4 * size :], live, numbers[0]


class Transducer:
    def __init__(self, ranks: dict[bytes, int], pattern: str, most_states: int = 400_000, most_pieces: int = 200_000, most_pairs: int = 500_000):
        self.ranks, self.most_states, self.most_pieces, self.most_pairs = ranks, most_states, most_pieces, most_pairs
        self.bytes_of = {i: t for t, i in ranks.items()}
        # White space as Unicode has it; the engine's own \s holds four control characters more.
        self.pieces = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.open = {t[:k] for t in ranks for k in range(1, len(t))}
        self.fits: dict[int, bool] = {}
        self.splits: dict[int, tuple[int, ...] | None] = {}
        #: Tokens made of one of a later rank, at any depth.
        self.odd: set[int] = set()
        self.reset()

    def reset(self) -> None:
        self.states: dict[bytes, State] = {}
        #: Pieces met lately, and those of the time before: a piece met again moves up, so frequent ones stay when others are dropped.
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.start = State(pack(b"", [(0, ())], -1), ())

    def forget(self) -> None:
        """Drops all that was learned from texts, so that an idle worker holds the vocabulary alone."""
        self.fits = {}
        self.reset()

    def merge(self, raw: bytes, least_parts: int = 1) -> list[int]:
        """The merges as defined: always the pair of least rank, leftmost first, down to ``least_parts``. Used on one or two tokens only."""
        rank, none = self.ranks.get, 1 << 60
        parts = [raw[i : i + 1] for i in range(len(raw))]
        pairs = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while len(pairs) >= least_parts and (least := min(pairs)) < none:
            at = pairs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def split(self, token: int) -> tuple[int, ...] | None:
        """The two tokens whose merge makes this one; ``()`` for a byte, None where no merges lead to the token."""
        found = self.splits.get(token, False)
        if found is False:
            raw = self.bytes_of[token]
            parts = self.merge(raw, 2) if len(raw) > 1 else []
            found = self.splits[token] = None if len(parts) > 2 else tuple(parts)
            for part in found or ():
                self.split(part)
                if part > token or part in self.odd:
                    self.odd.add(token)
        return found

    def stands(self, left: int, right: int) -> bool:
        """Whether the merges leave the border between the two tokens open.

        Their last merges are undone one by one, the later one first; a pair at the border that would have been merged before that is met on the way.
        """
        rank, bytes_of = self.ranks.get, self.bytes_of
        if self.split(left) is None or self.split(right) is None:
            return False
        if left in self.odd or right in self.odd:
            return self.merge(bytes_of[left] + bytes_of[right]) == [left, right]
        none = limit = 1 << 60
        while True:
            if rank(bytes_of[left] + bytes_of[right], none) < limit:
                return False
            a, b = self.split(left), self.split(right)
            if not a and not b:
                return True
            # Of equal ranks the left one is merged first, so a pair at the border comes before an equal one of the right token and after one of the left.
            if b and (not a or right >= left):
                limit, right = right + 1, b[0]
            else:
                limit, left = left, a[1]

    def compatible(self, left: int, right: int) -> bool:
        key = (left + 2) << 32 | right
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= self.most_pairs:
                self.fits = {}
            found = self.fits[key] = self.split(right) is not None if left < 0 else self.stands(left, right)
        return found

    def expand(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """The arc for ``byte``: next state and the tokens it writes."""
        suffix, live, before = unpack(state.packed)
        suffix += bytes([byte])
        size = len(suffix)
        for width, tokens in live:
            token = self.ranks.get(suffix[size - width - 1 :])
            if token is not None and self.compatible(tokens[-1] if tokens else before, token):
                whole = (*tokens, token)
                break
        else:
            raise ValueError(f"the vocabulary cannot spell {suffix!r}")
        live = [(w + 1, t) for w, t in live if suffix[size - w - 1 :] in self.open]
        live.append((0, whole))
        first, same = live[0][1], 0
        while same < len(first) and all(len(t) > same and t[same] == first[same] for _, t in live):
            same += 1
        written = first[:same]
        live = [(w, t[same:]) for w, t in live]
        before = written[-1] if written else before
        if all(t for _, t in live):
            before = -2  # no start reaches back to what is written
        packed = pack(suffix[size - live[0][0] :] if live[0][0] else b"", live, before)
        following = self.states.get(packed)
        if following is None:
            following = self.states[packed] = State(packed, live[-1][1])
        if state.arcs is _NONE:
            state.arcs = {}
        arc = state.arcs[byte] = (following, written)
        return arc

    def encode_piece(self, raw: bytes) -> tuple[int, ...]:
        if len(raw) > LONG:
            return self.encode_long(raw)
        state, out = self.start, ()
        for byte in raw:
            arc = state.arcs.get(byte) or self.expand(state, byte)
            state = arc[0]
            if arc[1]:
                out += arc[1]
        out += state.rest
        # A piece that is itself in the vocabulary is one token even where no merges lead to it.
        return (self.ranks[raw],) if len(out) > 1 and raw in self.ranks else out

    def encode_long(self, raw: bytes) -> tuple[int, ...]:
        """The same in time that grows with the length; states are dropped on the way when there are too many."""
        out: list[int] = []
        state = self.start
        for at in range(0, len(raw), LONG):
            for byte in raw[at : at + LONG]:
                arc = state.arcs.get(byte) or self.expand(state, byte)
                state = arc[0]
                out += arc[1]
            if len(self.states) > self.most_states:
                self.states = {}
                self.start = State(pack(b"", [(0, ())], -1), ())
                state = State(state.packed, state.rest)
        out += state.rest
        return (self.ranks[raw],) if len(out) > 1 and raw in self.ranks else tuple(out)

    def encode(self, text: str) -> array:
        """Ids of a whole text, each match of the pattern by itself."""
        if len(self.states) > self.most_states:
            self.reset()
        half = self.most_pieces // 2
        ids, words, older = array("I"), self.words, self.older
        for piece in self.pieces(text):
            found = words.get(piece)
            if found is None:
                found = older.get(piece) or self.encode_piece(piece.encode())
                if len(piece) <= 64:
                    if len(words) >= half:
                        words, older = {}, words
                    words[piece] = found
            ids.extend(found)
        self.words, self.older = words, older
        return ids


#: What may follow in an unfinished character: state -> (least byte, greatest byte, next state). State 0 is between characters.
_FOLLOW = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}


def utf8_step(state: int, byte: int) -> int:
    """The next state of the UTF-8 machine; -1 where the bytes cannot be UTF-8."""
    if state:
        low, high, then = _FOLLOW[state]
        return then if low <= byte <= high else -1
    if byte < 0x80:
        return 0
    special = {0xE0: 4, 0xED: 5, 0xF0: 6, 0xF4: 7}
    return special.get(byte, 1 if 0xC2 <= byte <= 0xDF else 2 if 0xE1 <= byte <= 0xEF else 3 if 0xF1 <= byte <= 0xF3 else -1)


class Decoder:
    """Feeds of ids in, whole characters out; a token's way through the machine is looked up after its first run."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.ways: dict[int, tuple[int, int]] = {}
        self.state, self.held = 0, b""

    def way(self, token: int) -> tuple[int, int]:
        """State after the token, and how many of its bytes end whole characters (-1: none does)."""
        state, whole = self.state, -1
        for n, byte in enumerate(self.bytes_of[token], 1):
            state = utf8_step(state, byte)
            if state < 0:
                raise ValueError(f"token {token} does not continue UTF-8")
            whole = n if state == 0 else whole
        self.ways[self.state << 32 | token] = state, whole
        return state, whole

    def feed(self, ids: Iterable[int]) -> bytes:
        """The bytes of all characters finished by these ids."""
        out, ways, bytes_of = [self.held], self.ways, self.bytes_of
        held = len(self.held)
        for token in ids:
            self.state, whole = ways.get(self.state << 32 | token) or self.way(token)
            raw = bytes_of[token]
            out.append(raw)
            held = held + len(raw) if whole < 0 else len(raw) - whole
        raw = b"".join(out)
        self.held = raw[len(raw) - held :] if held else b""
        return raw[: len(raw) - held]

    def close(self) -> None:
        if self.state:
            raise ValueError("the ids end inside a character")
        self.state, self.held = 0, b""


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def transducer(path: str, pattern: str, most_states: int = 400_000) -> Transducer:
    """One per worker process; its states serve all tasks the worker runs."""
    return Transducer(ranks_of(path), pattern, most_states, max(100_000, most_states // 2), min(500_000, most_states * 5))


def encoded(docs: DataFrame, path: str, pattern: str, ids: bool = True, most_states: int = 400_000, keep: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded_sha256`` of every row of ``docs`` (``doc_id, text``).

    ``ids`` are left out on request. A null text counts as empty and has no tokens; repeated rows are encoded alike and an empty table
    gives an empty one. ``path`` is that of a rank file on every executor. A worker keeps about ``most_states`` states, also after its tasks
    unless ``keep`` is off.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(path, pattern, most_states)
        try:
            yield from told(batches, fst)
        finally:
            if not keep:
                fst.forget()
                pa.default_memory_pool().release_unused()

    def told(batches: Iterator[pa.RecordBatch], fst: Transducer) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(fst.bytes_of)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                counts, lists, shas, backs = [], [], [], []
                for t in part.column(1):
                    found = fst.encode(t.as_py() or "")
                    digest = hashlib.sha256()
                    for k in range(0, len(found), 1 << 16):
                        digest.update(decoder.feed(found[k : k + (1 << 16)]))
                    decoder.close()
                    counts.append(len(found))
                    lists.append(found)
                    shas.append(hashlib.sha256(found.tobytes()).hexdigest())
                    backs.append(digest.hexdigest())
                columns = {"doc_id": part.column(0), "n_tokens": pa.array(counts, pa.int64())}
                if ids:
                    columns["ids"] = pa.array([x.tolist() for x in lists], pa.list_(pa.int32()))
                columns |= {"ids_sha256": pa.array(shas), "decoded_sha256": pa.array(backs)}
                yield pa.record_batch(list(columns.values()), list(columns))

    docs = pick(docs, "doc_id", "text")
    kept = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    return docs.mapInArrow(run, f"{kept}, n_tokens long, {'ids array<int>, ' * ids}ids_sha256 string, decoded_sha256 string")
