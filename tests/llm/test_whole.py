"""Cases in which an operator once did less than its whole job."""

import random

from pyspark.sql import functions as F

from slipweave.llm import copies, language, secrets


def changed(rng, words, n):
    """``words`` with ``n`` of them replaced, at least five apart."""
    out = list(words)
    for at in rng.sample(range(2, len(words) - 2, 6), n):
        out[at] = f"new{rng.getrandbits(40)}"
    return out


def jaccard(a, b):
    a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_from_similarity_four_fifths_on_are_dropped(spark):
    rng = random.Random(21)
    rows, kept = [], set()
    for g in range(60):
        size, n = [(300, 3), (300, 6), (100, 1), (100, 2)][g % 4]
        words = [f"w{rng.getrandbits(40)}" for _ in range(size)]
        near, far = changed(rng, words, n), changed(rng, words, size // 20)
        assert jaccard(words, near) >= 0.8 > jaccard(words, far) and jaccard(near, far) < 0.8
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join(near)), (10 * g + 2, " ".join(far))]
        kept |= {10 * g, 10 * g + 2}
    # A chain and a large group: linked, though its ends and most of its pairs are never compared.
    words = [f"c{i}" for i in range(200)]
    for i in range(8):
        rows.append((1000 + i, " ".join(words[i * 10 : i * 10 + 106])))
    base = [f"b{i}" for i in range(300)]
    rows += [(2000 + i, " ".join(changed(rng, base, 2))) for i in range(300)]
    found = {r.doc_id for r in copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == kept | {1000, 2000}


def test_copies_do_not_shrink_the_language_sample(spark):
    rng = random.Random(22)
    texts = [" ".join("".join(rng.choices(["ka", "lo", "mi", "tu", "re", "so"], k=rng.randint(1, 4))) for _ in range(40)) for _ in range(200)]
    labelled = spark.createDataFrame([(t, "aa") for t in texts], "text string, lang string")
    copied = labelled.union(labelled.limit(1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(40_000)))).drop("n"))
    model = language.fit(copied, sample=300)
    # All 200 distinct texts are learned from, as without the copies; then their own reach takes them in.
    assert sorted(model.langs) == ["aa"] * 3
    assert not any(model.predict(texts)[2])


def test_few_texts_give_no_reach(spark):
    rng = random.Random(23)
    sounds = [a + b for a in "bcdfghjklmnpqrstvwxz" for b in "aeiou"]
    texts = [" ".join("".join(rng.choices(sounds, k=rng.randint(1, 4))) for _ in range(100)) for _ in range(40)]
    model = language.fit(spark.createDataFrame([(t, "aa") for t in texts[:3]], "text string, lang string"))
    assert not any(model.predict(texts)[2])


def test_identifiers_are_no_secrets_and_keys_without_digits_are(spark):
    rng = random.Random(24)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    keys = ["".join(rng.choice(letters) for _ in range(32)) for _ in range(20)] + ["".join(rng.choice(letters + "0123456789") for _ in range(32)) for _ in range(20)]
    plain = ["getUserById2AndReturnName", "Donaudampfschifffahrtsgesellschaft", "readTableColumn3IntoTheIndexList", "src/pages/account/update_user_name2", "x" * 40, "a-b-" * 10]
    rows = list(enumerate([f"see {k} there" for k in keys + plain]))
    found = {r.doc_id: [s.kind for s in r.spans] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[i] == ["random"] for i in range(20)) >= 17 and sum(found[i] == ["random"] for i in range(20, 40)) >= 19
    assert not any(found[i] for i in range(40, len(rows)))
