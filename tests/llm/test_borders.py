"""The transducer's borders between tokens and its memory of pieces, against the merges as defined."""

import random

from slipweave.llm.transducer import Transducer


def made_up(rng, letters, merges):
    """A vocabulary of single bytes and random concatenations; some of its tokens no merges lead to."""
    tokens = [bytes([b]) for b in letters]
    while len(tokens) < len(letters) + merges:
        token = rng.choice(tokens) + rng.choice(tokens)
        if len(token) <= 8 and token not in tokens:
            tokens.append(token)
    head, tail = tokens[: len(letters)], tokens[len(letters) :]
    rng.shuffle(tail)
    return {t: i for i, t in enumerate(head + tail)}


def test_borders_stand_where_the_merges_leave_them():
    rng = random.Random(8)
    for _ in range(60):
        ranks = made_up(rng, b"abc"[: rng.randint(2, 3)], rng.randint(1, 14))
        fst = Transducer(ranks, r"\S+|\s+")
        for left in ranks.values():
            assert (fst.split(left) is not None) == (fst.merge(fst.bytes_of[left]) == [left])
            for right in ranks.values():
                assert fst.stands(left, right) == (fst.merge(fst.bytes_of[left] + fst.bytes_of[right]) == [left, right])


def test_frequent_pieces_stay_when_others_are_dropped():
    ranks = {bytes([b]): b for b in range(256)}
    fst = Transducer(ranks, r"\S+|\s+", most_pieces=40)
    met, encode_piece = [], fst.encode_piece
    fst.encode_piece = lambda raw: met.append(raw) or encode_piece(raw)
    for i in range(300):
        assert fst.encode(f"often {i}").tolist() == list(f"often {i}".encode())
    assert met.count(b"often") == 1 and len(fst.words) + len(fst.older) <= 40


def test_a_worker_may_forget_what_it_learned():
    """What was learned from texts is dropped on request, and the same ids come out afterwards."""
    import public_tokenizers

    from slipweave.llm.transducer import Transducer, ranks_of

    fst = Transducer(ranks_of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    text = "Überraschung! naïve 12345 tokens, pneumonoultramicroscopic" * 3
    first = fst.encode(text).tolist()
    assert fst.states and fst.words and fst.fits
    fst.forget()
    assert not fst.states and not fst.words and not fst.older and not fst.fits
    assert fst.encode(text).tolist() == first
