"""Token counts of whole texts, most of them without merging.

A vocabulary of byte-level merges holds many strings that merge into themselves: read alone, they come out as one
token. Which ones is proved once per worker, by running the merges on every vocabulary string. A pre-token found among the proved
strings counts one. Only the rest is merged, and remembered while short.

Long pre-tokens are merged in windows. Two neighbouring tokens that the merges leave as they are when read together may stand
together in any text (Berglund and van der Merwe, 2023). So a window is cut at a token border, the next window
begins there, and the border holds if its two tokens are such neighbours; if not, reading goes back to the border before it, with
a longer window. Time grows with the length, memory does not.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipweave.llm.shared import pick

#: The pre-token pattern of byte-level vocabularies; white space is Unicode's.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
LIMIT, WINDOW, SLICE = 512, 1_024, 1 << 20
#: Up to so many bytes scanning all pairs is faster than a heap of them.
SHORT = 48
#: What the regex engine has as letters or numbers and the library's tables (Unicode 16) have not yet.
NEWER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA "
    "18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE "
    "1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)


def spelled() -> dict[str, int]:
    """The byte each character of a vocabulary string stands for: printable Latin-1 for itself, the others from U+0100 on in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Counter:
    def __init__(self, path: str, most_pieces: int = 1_000_000):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        if model["type"] != "BPE" or told["normalizer"] or told["pre_tokenizer"]["type"] != "ByteLevel" or told["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a plain byte-level vocabulary")
        to_byte, vocabulary = spelled(), model["vocab"]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault((vocabulary[left], vocabulary[right]), (rank, vocabulary[left + right]))
        self.bytes_of = {i: bytes(to_byte[c] for c in t) for t, i in vocabulary.items() if all(c in to_byte for c in t)}
        self.byte = [vocabulary[c] for c in sorted(to_byte, key=to_byte.get)]
        self.special = [t["content"] for t in told["added_tokens"] if not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])]
        if len(self.special) < len(told["added_tokens"]):
            raise ValueError("an added token takes more than its own characters")
        newer = "".join("-".join(chr(int(c, 16)) for c in span.split("-")) for span in NEWER.split())
        # The first of them is far up, so one range settles most texts.
        self.far, self.newer = re.compile(f"[{newer[0]}-\U0010ffff]").search, regex.compile(f"[{newer}]").search
        self.all_pieces = regex.compile(PATTERN).findall
        older = PATTERN.replace(r"[^\p{White_Space}\p{L}\p{N}]", rf"(?:[^\p{{White_Space}}\p{{L}}\p{{N}}]|[{newer}])")
        for kind in (r"\p{L}+", r"\p{N}+"):
            older = older.replace(kind, f"(?:(?![{newer}]){kind[:-1]})+")
        self.older_pieces = regex.compile(older).findall
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.most_pieces, self.known = most_pieces, {}
        self.alone = self.prove()

    def prove(self) -> frozenset[str]:
        """The vocabulary strings that are texts and that the merges make one token."""
        proved = set()
        for raw in self.bytes_of.values():
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                continue
            if len(self.merge(raw)) == 1:
                proved.add(text)
        return frozenset(proved)

    def merge(self, raw: bytes) -> list[int]:
        """Tokens of ``raw`` by the merges as defined: the pair of least rank first, of equal ones the leftmost."""
        pairs, tokens = self.pairs, [self.byte[b] for b in raw]
        n = len(tokens)
        if n <= SHORT:
            none = (1 << 60, -1)
            found = [pairs.get(p, none) for p in zip(tokens, tokens[1:])]
            while found and (least := min(found)) is not none:
                i = found.index(least)
                tokens[i : i + 2] = [least[1]]
                del found[i]
                if i:
                    found[i - 1] = pairs.get((tokens[i - 1], tokens[i]), none)
                if i < len(found):
                    found[i] = pairs.get((tokens[i], tokens[i + 1]), none)
            return tokens
        following, previous = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*found, i) for i in range(n - 1) if (found := pairs.get((tokens[i], tokens[i + 1])))]
        # By rank, then place; an entry is void once either of its tokens has changed.
        heap = [(rank, i, new) for rank, new, i in heap]
        heapq.heapify(heap)
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = following[i]
            if j < 0 or tokens[i] < 0 or pairs.get((tokens[i], tokens[j])) != (rank, new):
                continue
            tokens[i], tokens[j] = new, -1
            k = following[i] = following[j]
            if k >= 0:
                previous[k] = i
                if found := pairs.get((new, tokens[k])):
                    heapq.heappush(heap, (found[0], i, found[1]))
            if (h := previous[i]) >= 0 and (found := pairs.get((tokens[h], new))):
                heapq.heappush(heap, (found[0], h, found[1]))
        return [t for t in tokens if t >= 0]

    def neighbours(self, left: int, right: int) -> bool:
        return self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def merged(self, raw: bytes, window: int = WINDOW) -> int:
        """Number of tokens of one pre-token of any length."""
        borders, size = [(0, 0, -1)], window
        while True:
            at, count, last = borders[-1]
            tokens = self.merge(raw[at : at + size])
            if last >= 0 and not self.neighbours(last, tokens[0]):
                # The border does not hold: back to the one before, with a longer window.
                borders.pop()
                size *= 2
                continue
            if at + size >= len(raw):
                return count + len(tokens)
            # The last tokens may still change, so the window is cut before its end.
            stop, n = at, 0
            while stop - at < size - size // 4:
                stop += len(self.bytes_of[tokens[n]])
                n += 1
            borders.append((stop, count + n, tokens[n - 1]))

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of ``text``."""
        return self.older_pieces(text) if self.far(text) and self.newer(text) else self.all_pieces(text)

    def piece(self, piece: str) -> int:
        found = self.known.get(piece)
        if found is None:
            found = self.merged(piece.encode())
            if len(piece) <= 64:
                if len(self.known) >= self.most_pieces:
                    self.known.clear()
                self.known[piece] = found
        return found

    def slices(self, text: str) -> Iterator[str]:
        """``text`` in slices that no pre-token crosses: cut before a blank between two ASCII letters."""
        at = 0
        while len(text) - at > SLICE:
            cut = self.cuts.search(text, at + SLICE)
            if cut is None:
                break
            yield text[at : cut.start() + 1]
            at = cut.start() + 1
        yield text[at:] if at else text

    cuts = regex.compile("[A-Za-z](?= [A-Za-z])")

    def plain(self, text: str) -> int:
        total = 0
        for part in self.slices(text):
            found = self.pieces(part)
            rest = [p for p in found if p not in self.alone]
            counts = list(map(self.known.get, rest))
            total += len(found) - len(rest) + (sum(map(self.piece, rest)) if None in counts else sum(counts))
        return total

    def count(self, text: str) -> int:
        """Tokens of a whole text; a special string in it is one token, as the library reads it by default."""
        if self.specials is None or not any(s in text for s in self.special):
            return self.plain(text)
        total, at = 0, 0
        for m in self.specials.finditer(text):
            total += self.plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self.plain(text[at:])


@cache
def counter(path: str) -> Counter:
    """One per worker process."""
    return Counter(path)


def counted(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs`` (``doc_id, text``).

    ``path`` is that of a byte-level vocabulary file on every executor. A null text counts as empty: no bytes, no
    tokens. Texts of any length are counted whole, in slices. Repeated rows come back as often as they stand there; an empty table
    gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for b in batches:
            counts = [own.count(t.as_py() or "") for t in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    docs = pick(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return sized.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
