"""Token counts, vector codes and spelling variants against plain versions of what they compute."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from slipweave.llm import codes, counts, variants

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_every_code_point_is_split_as_the_library_does(library):
    own = counts.counter(PATH)
    for cp in range(0x110000):
        if not 0xD800 <= cp < 0xE000:
            text = f"a{chr(cp)}1{chr(cp)} {chr(cp)}"
            assert [len(p) for p in own.pieces(text)] == [b - a for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], hex(cp)


def test_proved_strings_are_one_token(library):
    own = counts.counter(PATH)
    some = sorted(own.alone)[::7]
    pieces = [s for s in some if own.pieces(s) == [s]]
    assert len(own.alone) > 40_000 and len(pieces) > 5_000
    assert {len(e.ids) for e in library.encode_batch(pieces)} == {1}


def test_counts_equal_the_library(library):
    own, rng = counts.counter(PATH), random.Random(31)
    bits = ["a", "e", "th", "ing", " ", "  ", "\n", "é", "中", "1", "<|endoftext|>", "<|endoftext|", "'s", "!", "\x85", "　", "zz", "\U0003d000", "\x1c"]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 200)))
        assert own.count(text) == len(library.encode(text).ids)


def test_long_pieces_in_windows(library):
    own, rng = counts.counter(PATH), random.Random(32)
    for i in range(30):
        text = "".join(rng.choices("etaoinshr" if i % 2 else "abcdefghijklmnopqrstuvwxyzé", k=5_000))
        if i % 3 == 0:
            text = text[: rng.randint(1, 9)] * 900
        want = len(library.encode(text).ids)
        for window in (4, 16, 64, 1024):
            assert own.merged(text.encode(), window) == want


def test_slices_change_nothing(library, monkeypatch):
    own, rng = counts.counter(PATH), random.Random(33)
    text = " ".join(rng.choice(["the", "thing's", "  12", "é", "\n\n", "x", "-", "ok ok"]) for _ in range(3_000))
    monkeypatch.setattr(counts, "SLICE", 50)
    assert "".join(own.slices(text)) == text and len(list(own.slices(text))) > 50
    assert own.count(text) == len(library.encode(text).ids)


def clash(df):
    """More columns, whose names differ in case only or repeat what operators make."""
    names = ["Text", "word", "n", "n_bytes", "x", "code", "label_error", "part", "a.b", "Vec_ID"]
    return df.select("*", *[F.lit(i).alias(f"y{i}") for i in range(len(names))]).toDF(*df.columns, *names)


def test_token_counts_of_odd_rows(spark, library):
    long = "word " * 400_000 + "x" * 100_000
    rows = [(1, "some words"), (1, "some words"), (2, None), (None, ""), (3, long), (4, "<|endoftext|> é\x00"), (5, " ".join(["the"] * 512)), (6, " ".join(["the"] * 513))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for table in (docs, clash(docs)):
        found = [tuple(r) for r in counts.counted(table, PATH).collect()]
        want = [(i, len((t or "").encode()), n := len(library.encode(t or "").ids), n > 512) for i, t in rows]
        assert sorted(found, key=str) == sorted(want, key=str)
    assert counts.counted(docs.filter("false"), PATH).count() == 0


def test_search_finds_the_nearest_and_the_lowest():
    rng = np.random.default_rng(34)
    for _ in range(200):
        entries, queries = rng.integers(-4, 5, (rng.integers(1, 50), 3)), rng.integers(-6, 7, (100, 3))
        apart = ((queries[:, None] - entries[None]) ** 2).sum(axis=2)
        nearest, distance = codes.Book(entries).search(queries, int(rng.integers(len(entries))))
        assert (nearest == apart.argmin(axis=1)).all() and (distance == apart.min(axis=1)).all()


def test_search_compares_few_entries():
    """The lists end the search early: far fewer distances than entries."""
    rng = np.random.default_rng(35)
    entries = rng.integers(-10_000, 10_000, (500, 2))
    book, queries = codes.Book(entries), entries[rng.integers(0, 500, 300)] + rng.integers(-20, 20, (300, 2))
    compared = []

    class Counting(np.ndarray):
        def __getitem__(self, key):
            out = super().__getitem__(key)
            compared.append(len(out) if np.ndim(out) == 2 else 1)
            return out

    book.entries = entries.view(Counting)
    nearest, _ = book.search(queries)
    assert (nearest == ((queries[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert sum(compared) < 300 * 500 / 4


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted((i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(p, q):
        return min((sum((a - b) ** 2 for a, b in zip(q, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(nearest(p, c[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(members[k]) for x in zip(*members[k])] if k in members else e for k, e in enumerate(books[p])]
    out = [(i, "".join(f"{nearest(p, c[p])[1]:02x}" for p in range(parts)), sum(nearest(p, c[p])[0] for p in range(parts))) for (i, _), c in zip(kept, cut)]
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("n", [300, 20])
def test_codes_equal_plain_rounds(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 32)], int(i) % 3 if i % 5 else None) for i in rng.permutation(n)]
    rows += [(-1, None, 1), (-2, [None] * 32, 1), (-3, [float("nan")] * 32, 0), (-4, [float("inf")] + [0.0] * 31, 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    labels = {i: lab for i, _, lab in rows}
    as_float = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v, _ in rows]
    plain, sha = plain_codes(as_float)
    sums = Counter()
    for i, _, e in plain:
        sums[labels[i]] += e
    want = sorted((i, c, e, sums[labels[i]], sha) for i, c, e in plain)
    for table in (vectors, clash(vectors)):
        assert sorted(tuple(r) for r in codes.compressed(table).collect()) == want


def test_codes_of_odd_rows(spark):
    kind = "vec_id long, embedding array<double>, label string"
    rows = [(1, [1e300] * 16, None), (1, [1e300] * 16, None), (2, [-1e300] * 16, "a"), (3, [0.0] * 15, "a"), (4, [], "a"), (5, [0.0] * 32, "a"), (None, [0.5] * 16, "b")]
    found = codes.compressed(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.vec_id or 0, r.error) for r in found) == [(0, 0), (1, 0), (1, 0), (2, 0)]
    assert codes.compressed(spark.createDataFrame([], kind)).count() == 0
    assert codes.compressed(spark.createDataFrame([(1, None, "a")], kind)).count() == 0


def test_label_totals_of_rare_labels(spark):
    rows = [(i, "c", i, "x" if i % 2 else None if i % 4 else f"l{i // 8}") for i in range(400)]
    coded = spark.createDataFrame(rows, "vec_id long, code string, error long, label string")
    want = Counter()
    for _, _, e, lab in rows:
        want[lab] += e
    for share in (1, 4, 10_000):
        found = codes.with_totals(coded, share).collect()
        assert sorted((r.vec_id, r.label_error) for r in found) == [(i, want[lab]) for i, _, _, lab in rows]


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(count, times=10):
    best, out = {}, {}
    for w in count:
        around = [v for v in count if v != w and near(v, w)]
        top = min(around, key=lambda v: (-count[v], v), default=None)
        best[w] = top if top and count[top] >= times * count[w] else None, len(around)
    for w, (form, n_near) in best.items():
        root = w
        while best[root][0]:
            root = best[root][0]
        out[w] = form, root, count[w], n_near, count[form] if form else None
    return out


def test_composition_on_small_alphabets():
    rng = random.Random(36)
    for _ in range(200):
        words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 60))})
        n = np.array([rng.randint(1, 5) for _ in words])
        found, best = variants.near_in(words, n)
        assert found.tolist() == [sum(a != b and near(a, b) for b in words) for a in words]
        assert best.tolist() == [min([(-n[j], j) for j, b in enumerate(words) if a != b and near(a, b)], default=(0, -1))[1] for a in words]


def test_the_acceptor_is_minimal():
    a = variants.Acceptor(sorted(x + y for x in ("ab", "cd", "xyz") for y in ("ing", "ed", "s")))
    # All three stems lead to one state: the endings share it and the final state.
    assert len(a.final) == 10 and a.final.sum() == 1
    for w in ("abing", "xyzs"):
        state = a.state[0]
        for c in w:
            arc = a.step(np.array([state]), np.searchsorted(a.symbols, [ord(c)]))[0]
            state = a.target[arc]
        assert a.final[state]


@pytest.mark.parametrize("block", [7, 60, 100_000])
def test_neighbours_in_ranges(spark, block):
    """Ranges cut anywhere, a prefix that holds most words, and words about the bound of the acceptor."""
    rng = random.Random(37)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 6))) for _ in range(150)}
    words |= {"gemein" + "".join(rng.choice("abö") for _ in range(rng.randint(0, 5))) for _ in range(150)}
    stem = "".join(rng.choice("abc") for _ in range(66))
    words |= {stem[:63], stem[:64], stem[:65], stem[:66], "z" + stem[:64], "z" + stem[1:64], stem[:30] + "q" + stem[31:65], stem[:63] + "q", "a" * 3000, "a" * 3001, "a" * 1500 + "b" + "a" * 1500}
    count = {w: rng.choice([1, 2, 30, 500]) for w in words}
    table = spark.createDataFrame(list(count.items()), "word string, n long")
    found = {r.word: r for r in variants.neighbours(table, block).collect()}
    want = plain_variants(count)
    assert set(found) == words
    for w in words:
        assert (found[w].n, found[w].near) == want[w][2:4], w
        top = min([(-count[v], v) for v in words if v != w and near(v, w)], default=None)
        assert (tuple(found[w].best) if found[w].best else None) == top


def test_variants_of_texts(spark):
    rng = random.Random(38)
    base = ["gemeinde", "GEMEINDE", "straße", "strasse", "ciudades", "école×÷", "wonderful", "wonderfull", "wonderfu"]
    rows = [(i, " ".join(rng.choices(base, weights=[40, 20, 9, 9, 9, 9, 30, 3, 2], k=rng.randint(0, 300))) + f" {'q' * rng.choice([7, 8, 9])}!") for i in range(60)]
    rows += [(None, "gemeinde 12gemeindex gemeindex"), (3, None), (4, ""), (5, "Ärger-ärgern ÄRGERNIS ärgernis ÄRGERNIS")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    want = plain_variants({w: n for w, n in count.items() if len(w) >= 7 and n >= 2})
    assert any(form and root != form for form, root, *_ in want.values())
    for table in (docs, clash(docs)):
        found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.variants(table).collect()}
        assert found == want
    assert variants.variants(docs.filter("false")).count() == 0
