"""Secret scans: fixed patterns, and a battery of randomness tests for strings of no known form, in DataFrame operations alone.

A candidate is a run of 20 or more key characters with a letter. From its characters an encoding (alphabet of
size k) is inferred, and three tests ask whether it could be uniformly random over that alphabet:

* chi-squared of the character counts, against the exact mean k - 1 and variance 2(k - 1)(1 - 1/n) for n characters,
* the runs test of characters above and below the middle of the alphabet,
* serial correlation of neighbouring places in the alphabet.

Fisher's method combines the three. Written language fails: its characters are uneven and ordered. The decision
is length-aware twice: a length at which a string as uneven as language would be told from a random one too rarely is
not judged at all, and Benjamini-Hochberg control runs within each stratum of encoding and length, over the
distinct strings of the whole table, so that at most the share ``q`` of the strings rejected as not random is random.

What stays random is not yet a secret. For that claim the null is written language: pairs of characters are counted in words of
the table itself, and a string's p-value says how rarely a word of its length is made of pairs so unusual. Benjamini-Hochberg control over
these p-values bounds the share of language among the strings that are reported.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipweave.llm.shared import pick, small, written

# The three known kinds in their order, with the least length of the part that counts.
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: Runs of key characters with a letter, taken from their first character on.
RANDOM = r"(?<![A-Za-z0-9+/_-])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}"
#: Encodings from the narrowest: name, characters, places in order.
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("hex", "[0-9a-f]+", _DIGITS + "abcdef"),
    ("HEX", "[0-9A-F]+", _DIGITS + "ABCDEF"),
    ("base32", "[A-Z2-7]+=*", _LOWER.upper() + "234567"),
    ("base36", "[a-z0-9]+", _DIGITS + _LOWER),
    ("BASE36", "[A-Z0-9]+", _DIGITS + _LOWER.upper()),
    ("base62", "[A-Za-z0-9]+", _DIGITS + _LOWER.upper() + _LOWER),
    ("base64", "[A-Za-z0-9+/]+=*", _LOWER.upper() + _LOWER + _DIGITS + "+/"),
    ("base64url", "[A-Za-z0-9_-]+=*", _LOWER.upper() + _LOWER + _DIGITS + "-_"),
    ("mixed", ".*", _LOWER.upper() + _LOWER + _DIGITS + "+/-_"),
)
#: Chance that two characters of written language are equal.
LANGUAGE_REPEAT = 0.066
#: Words the null is fitted on, and characters as it sees them: letters without case, any digit, any sign.
WORDS, SIGNS = "[A-Za-z0-9+/_-]{5,}", "abcdefghijklmnopqrstuvwxyz0-"
#: Known words, so that a table of few words has a null too.
KNOWN = (
    "about after again against because before being between could different does during every first found great house large later little might "
    "never number other people place point right should small state still their there these thing think three through under water where which "
    "while without world would years nicht werden haben diese einen wird auch nach beim aber oder wenn schon noch mehr ueber zwischen gegen "
    "durch immer jahre leben arbeit para como pero este esta todos tiempo donde desde hasta entre sobre mucho nuevo parte dans avec pour plus "
    "comme tout cette leur sans nous vous etre faire aussi encore get set user name return value index count list file path read write open "
    "close start end begin next last find make create update delete insert select table column row key item node page text account identifier "
    "getuser byid2 page1 item12 part-2 user_name file_path read/write 2024-01-01 v2 chapter7 section-4 http www com html index_page").split()


def found(text: str, kind: str) -> Column:
    """``kind, pos, gap, width, held, key`` of every match; ``gap`` is what lies between it and the one before.

    The pieces between matches come from a split by the same expression, so lengths add up to offsets.
    """
    pattern = F.lit(PATTERNS.get(kind, RANDOM))
    # Runs under 32 digits would be found and dropped one by one; the longer ones are the same runs either way.
    pattern = F.lit("[0-9a-f]{32,}") if kind == "hex" else pattern
    gaps, whole = F.split(F.col(text), pattern, -1), F.regexp_extract_all(text, pattern, 0)
    counted = F.regexp_extract_all(text, pattern, 2) if kind == "assign" else whole
    return F.transform(whole, lambda m, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("pos"), F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("width"),
        F.length(F.get(counted, i)).alias("held"), F.when(F.lit(kind == "random"), m).alias("key")))


def tail(z: Column) -> Column:
    """P(normal > z), by the usual five-term approximation (error below 1e-7)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    p = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, p).otherwise(1 - p)


def battery(candidates: DataFrame) -> DataFrame:
    """``key`` with its ``encoding``, ``n``, ``k``, the three p-values and their combination ``p``; all linear in its length."""
    encoding = F.coalesce(*[F.when(F.col("key").rlike(f"^{chars}$"), F.lit(i)) for i, (_, chars, _) in enumerate(ENCODINGS)])
    alphabet = F.get(F.array(*[F.lit(a) for _, _, a in ENCODINGS]), F.col("e"))
    at, n, k = F.col("at"), F.col("n"), F.col("k")
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    # The j-th equal character in order adds 2j - 1, which sums to the square of each count.
    squares = F.aggregate(
        F.array_sort(at), F.struct(F.lit(-1).alias("last"), F.lit(0).alias("run"), F.lit(0).cast("long").alias("sum")),
        lambda s, x: F.struct(
            x.alias("last"), F.when(x == s["last"], s["run"] + 1).otherwise(1).alias("run"),
            (s["sum"] + 2 * F.when(x == s["last"], s["run"] + 1).otherwise(1) - 1).cast("long").alias("sum")),
        lambda s: s["sum"])
    pairs = lambda f: F.zip_with(F.slice(at, 1, n - 1), F.slice(at, 2, n - 1), f)
    mean = F.col("sum") / n
    high, turns, even = F.col("high"), F.col("turns"), F.lit(1e-300)
    expected = 2 * high * (n - high) / n + 1
    scale = F.sqrt((expected - 1) * (expected - 2) / (n - 1))
    both = lambda z: F.greatest(even, F.coalesce(2 * tail(F.abs(z)), F.lit(0.0)))
    half = -F.log("p_chi") - F.log("p_runs") - F.log("p_serial")
    return (
        candidates.withColumns({"e": encoding, "body": F.regexp_replace("key", "=+$", "")})
        .withColumns({"n": F.length("body"), "k": F.length(alphabet)})
        .withColumn("at", F.transform(F.slice(F.split("body", ""), 1, n), lambda c: F.instr(alphabet, c) - 1))
        .withColumns({
            "squares": squares, "sum": total(at), "square": total(F.transform(at, lambda x: (x * x).cast("double"))),
            "product": total(pairs(lambda x, y: (x * y).cast("double"))),
            "ends": F.get(at, F.lit(0)) + F.get(at, n - 1),
            "high": F.size(F.filter(at, lambda x: 2 * x >= k)).cast("double"),
            "turns": 1 + total(pairs(lambda x, y: ((2 * x >= k) != (2 * y >= k)).cast("double"))),
        })
        .withColumns({
            "p_chi": F.greatest(even, tail((F.col("squares") * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n)))),
            "p_runs": both(F.when(scale > 0, (turns - expected) / scale)),
            "p_serial": both(F.when(
                F.col("square") > n * mean * mean,
                ((F.col("product") - mean * (2 * F.col("sum") - F.col("ends")) + (n - 1) * mean * mean) / (F.col("square") - n * mean * mean) + 1 / n) * F.sqrt(n))),
        })
        .select("key", F.get(F.array(*[F.lit(e[0]) for e in ENCODINGS]), F.col("e")).alias("encoding"), "n", "k", "p_chi", "p_runs", "p_serial",
                F.greatest(even, F.exp(-half) * (1 + half + half * half / 2)).alias("p"))
    )


def random_keys(tested: DataFrame, q: float = 0.01) -> DataFrame:
    """``key`` of the distinct tested strings that stay random under false-discovery control.

    P-values fall into steps of a tenth of a decade, so the control needs one small table of counts: at most the
    encodings times twenty lengths times some three thousand steps, whatever the number of strings.
    """
    repeat = F.greatest(F.lit(LANGUAGE_REPEAT), 2 / F.col("k"))
    telling = F.col("n") * (F.col("k") * repeat - 1) >= 5 * F.sqrt(2 * (F.col("k") - 1))
    rows = tested.filter(telling).select("key", "encoding", F.floor(F.log2("n")).alias("octave"), F.floor(-10 * F.log10("p")).cast("int").alias("step"))
    counts = rows.groupBy("encoding", "octave", "step").count()
    stratum = Window.partitionBy("encoding", "octave")
    ranked = counts.withColumns({
        "rank": F.sum("count").over(stratum.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)),
        "m": F.sum("count").over(stratum)})
    # The upper end of a step stands for all its p-values.
    cut = ranked.filter(F.pow(F.lit(10.0), -F.col("step") / 10) <= F.col("rank") * q / F.col("m")).groupBy("encoding", "octave").agg(F.min("step").alias("cut"))
    judged = rows.join(cut, ["encoding", "octave"], "left")
    return judged.filter(F.col("cut").isNull() | (F.col("step") < F.col("cut"))).select("key")


def language_null(text: DataFrame) -> tuple[list[float], float, float]:
    """Log probability of a character after another, by place in ``SIGNS``; its mean per pair, and the spread of a word's sum per root of its pairs.

    Taken from every distinct word of ``text`` too short to be a candidate itself, and from the known words. What comes to the driver are counts of
    pairs of ``SIGNS`` and sums, whatever the number of words.
    """
    size = len(SIGNS)
    words = text.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORDS), 0))).alias("word")).filter("length(word) < 20")
    known = text.sparkSession.range(1).select(F.explode(F.array(*[F.lit(w) for w in KNOWN])).alias("word"))
    body = F.translate(F.lower("word"), "123456789+/_", "0" * 9 + "-" * 3)
    at = F.filter(F.transform(F.split(body, ""), lambda c: F.instr(F.lit(SIGNS), c) - 1), lambda x: x >= 0)
    pairs = F.zip_with(F.slice("at", 1, F.size("at") - 1), F.slice("at", 2, F.size("at") - 1), lambda x, y: x * size + y)
    # Each half is scored by the other one, as words that took part in the fit look more usual than new ones.
    half = F.pmod(F.xxhash64("word", F.lit(7)), F.lit(2)).cast("int")
    rows = written(words.union(known).distinct().select(half.alias("half"), at.alias("at")).select("half", pairs.alias("pairs")), "words")
    counts = np.zeros((2, size * size))
    for r in rows.select("half", F.explode("pairs").alias("pair")).groupBy("half", "pair").count().collect():
        counts[r["half"], r["pair"]] = r["count"]

    def fitted(counts: np.ndarray) -> list[float]:
        table = counts.reshape(size, size) + 0.5
        return np.log(table / table.sum(axis=1, keepdims=True)).ravel().tolist()

    other = F.array(*[F.array(*[F.lit(x) for x in fitted(c)]) for c in counts[::-1]])
    scored = rows.select(F.size("pairs").alias("n"), F.aggregate(F.transform("pairs", lambda x: F.get(F.get(other, F.col("half")), x)), F.lit(0.0), lambda s, x: s + x).alias("sum"))
    total, places, number, squares = scored.agg(F.sum("sum"), F.sum("n"), F.count("*"), F.sum(F.col("sum") * F.col("sum") / F.col("n"))).first()
    mean = total / places
    # The mean of (sum - n * mean)^2 / n, written out.
    return fitted(counts.sum(axis=0)), mean, math.sqrt(max(1e-12, (squares - 2 * mean * total + mean * mean * places) / number))


def unlike_language(keys: DataFrame, null: tuple[list[float], float, float], q: float = 0.01) -> DataFrame:
    """``key`` of the distinct strings whose p-value under ``null`` passes false-discovery control; steps as in ``random_keys``."""
    score, mean, spread = null
    body = F.translate(F.lower(F.regexp_replace("key", "=+$", "")), "123456789+/_", "0" * 9 + "-" * 3)
    table, size = F.array(*[F.lit(x) for x in score]), len(SIGNS)
    at, n = F.col("at"), F.size("at")
    pairs = F.zip_with(F.slice(at, 1, n - 1), F.slice(at, 2, n - 1), lambda x, y: F.get(table, x * size + y))
    rows = (
        keys.select("key", F.filter(F.transform(F.split(body, ""), lambda c: F.instr(F.lit(SIGNS), c) - 1), lambda x: x >= 0).alias("at"))
        .withColumn("sum", F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))
        .withColumn("p", F.greatest(F.lit(1e-300), tail((F.lit(mean) * (n - 1) - F.col("sum")) / (F.lit(spread) * F.sqrt(n - 1)))))
        .select("key", F.floor(-10 * F.log10("p")).cast("int").alias("step")))
    rank, cut, counts = 0, 1 << 30, sorted(((r["step"], r["count"]) for r in rows.groupBy("step").count().collect()), reverse=True)
    m = sum(c for _, c in counts)
    for step, count in counts:
        rank += count
        if 10.0 ** (-step / 10) <= rank * q / m:
            cut = step
    return rows.filter(F.col("step") >= cut).select("key")


def scan(docs: DataFrame, q: float = 0.01) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base, spans`` of every row of ``docs`` (``doc_id, text``).

    ``base`` and ``spans`` are arrays of ``start, rank, kind, end`` (code points, end exclusive) in order; ``spans`` adds to
    the three known kinds the ``random`` ones that lie in none of them. Matches of the known kinds that are too short
    are dropped, together with what they covered. A null text is empty; a text without a span has empty arrays;
    repeated rows come back as often as they went in and an empty table gives an empty one.
    """
    text = pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kinds = [*KINDS, "random"]
    # Rows without any match keep one row of nulls, so that every input row is returned.
    each = text.select("row", "doc_id", F.explode_outer(F.concat(*[found("text", k) for k in kinds])).alias("m")).select("row", "doc_id", "m.*")
    matches = written(each, "matches")
    keys = matches.filter("kind = 'random'").select("key").distinct()
    stay = written(random_keys(battery(keys), q), "random")
    keep = unlike_language(stay, language_null(text), q).withColumn("random", F.lit(True))
    before = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = matches.withColumn("end", F.sum(F.col("gap") + F.col("width")).over(before)).withColumn("start", F.col("end") - F.col("width"))
    least = F.create_map(*[x for k in KINDS for x in (F.lit(k), F.lit(LEAST[k]))])
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    marked = placed.join(keep, "key", "left").select(
        "row", "doc_id", "kind", "start", "end", rank[F.col("kind")].alias("rank"),
        F.when(F.col("kind") == "random", F.coalesce("random", F.lit(False))).otherwise(F.col("held") >= least[F.col("kind")]).alias("good"))
    # A random span that ends within the farthest known span begun so far lies inside it.
    reach = Window.partitionBy("row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, 0)
    known = F.max(F.when(F.col("good") & (F.col("kind") != "random"), F.col("end"))).over(reach)
    good = marked.withColumn("good", F.col("good") & ((F.col("kind") != "random") | F.coalesce(F.col("end") > known, F.lit(True))))
    counted = [F.count_if(F.col("good") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS]
    span = F.struct("start", "rank", "kind", "end")
    return good.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), *counted, F.sort_array(F.collect_list(F.when(F.col("good"), span))).alias("spans"),
    ).select("doc_id", *[f"n_{k}" for k in KINDS], F.filter("spans", lambda s: s["kind"] != "random").alias("base"), "spans")


def joined(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, q: float = 0.01, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mark`` and ``n_chars`` counted anew; all rows stay.

    Overlapping spans become one mark. The other columns, and texts without a span, are returned as they are.
    """
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = F.col(f"c{docs.columns.index('text')}")
    hashed = numbered.withColumn("digest", F.sha2(text, 256))
    # Equal texts have equal spans, so the digest of a text names it.
    found = scan(hashed.select(F.col("digest").alias("doc_id"), text.alias("text")), q).filter((F.size("spans") > 0) & F.col("doc_id").isNotNull())
    spans = written(found.groupBy(F.col("doc_id").alias("digest")).agg(F.first("spans").alias("spans")), "spans")
    empty = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("to"))

    def step(s: Column, x: Column) -> Column:
        between = F.substring(text, (s["to"] + 1).cast("int"), (x["start"] - s["to"]).cast("int"))
        parts = F.when(x["start"] < s["to"], s["parts"]).otherwise(F.concat(s["parts"], F.array(between, F.lit(mark))))
        return F.struct(parts.alias("parts"), F.greatest(s["to"], x["end"]).alias("to"))

    hidden = F.aggregate("spans", empty, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, (s["to"] + 1).cast("int"), F.length(text))))
    joined_to = hashed.join(small(spans), "digest", "left").withColumn("hidden", F.when(F.col("spans").isNotNull(), hidden))
    columns = []
    for i, name in enumerate(docs.columns):
        own = F.col(f"c{i}")
        if i == docs.columns.index("text"):
            own = F.coalesce("hidden", own)
        elif name == "n_chars":
            own = F.coalesce(F.length("hidden").cast(docs.schema[i].dataType), own)
        columns.append(own.alias(name))
    return joined_to.select(*columns)
