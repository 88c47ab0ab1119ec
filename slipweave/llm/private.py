"""Personal data: candidate spans, boosted trees, calibrated thresholds.

Strict patterns with their checks give the base spans. Loose generators propose more, overlapping, spans of the four
kinds. Gradient-boosted trees learn from format and context to tell checked spans from decoys, the same spans in their places with
what makes them valid broken. On documents kept apart from training the scores are calibrated to a precision
for each kind, and candidates above the threshold are added where they touch no base span. Such candidates are
never examples of either side: nobody knows what they are.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipweave.llm.shared import pick, written

# The four kinds in their order.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run that starts no address starts none at its later digits either, so it is passed over at once.
_IP = re.compile(r"[0-9]++(?:\.([0-9]++)\.([0-9]++)\.([0-9]+))?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = (
    (0, re.compile(r"(?<![^\s<>()\[\]\"',;:])[^\s@<>()\[\]\"',;:]{1,64}@[^\s@<>()\[\]\"',;:]{1,255}")),
    (1, re.compile(r"(?<![0-9a-fA-F:.])(?:[0-9a-fA-F]{1,4}:){4,7}[0-9a-fA-F]{1,4}(?![0-9a-fA-F:])|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])")),
    (2, re.compile(r"(?<![0-9])[0-9]{12,19}(?![0-9])|(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9])")),
    (3, re.compile(r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20./-][0-9]{2,4}[\x20./-][0-9]{2,5}(?:[\x20./-][0-9]{2,5})?(?![0-9])")),
)
#: Words that go before each kind; part of the context features, not of any rule.
_CUES = tuple(re.compile(p, re.IGNORECASE) for p in (
    r"mail|contact|write|@", r"\bip\b|host|server|address|client", r"card|visa|master|credit|pay|iban|account", r"phone|tel\b|tel\.|call|fax|mobil|whatsapp"))
FEATURES = (
    *(f"is_{k}" for k in KINDS), "chars", "digits", "letters", "groups", "longest_group", "separators", "dots", "plus",
    "luhn", "largest_part", "dotted_domain", "touches_before", "touches_after", *(f"cue_{k}" for k in KINDS), "digits_around",
)


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the checked matches, leftmost and non-overlapping per kind, by kind and start."""
    out, at, last = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        last = domain.end() if domain else at + 1
        if domain:
            out.append((0, start, last))
        at = text.find("@", last)
    for m in _IP.finditer(text):
        if m[1] is not None and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0]) if m.end() - m.start() >= 16 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Distinct base and loosely matched spans; they may overlap."""
    found = dict.fromkeys(base)
    if "@" in text or re.search("[0-9]", text):
        for kind, pattern in _LOOSE:
            if kind or "@" in text:
                found |= dict.fromkeys((kind, m.start(), m.end()) for m in pattern.finditer(text))
    return list(found)


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    span, before, around = text[start:end], text[max(0, start - 40) : start], text[max(0, start - 40) : end + 40]
    groups = re.findall(r"\d+", span)
    digits = "".join(g for g in groups if g.isascii())
    return [
        *(float(kind == k) for k in range(len(KINDS))), float(len(span)), float(len(digits)), float(sum(map(str.isalpha, span))), float(len(groups)),
        float(max(map(len, groups), default=0)), float(sum(c in " -()/" for c in span)), float(span.count(".")), float(span.startswith("+")),
        float(bool(digits) and luhn(digits)), float(min(1e6, max((int(g[:7]) for g in groups if g.isascii()), default=0))),
        float(bool(re.search(r"@[A-Za-z0-9-]+\.[A-Za-z]", span))), float(text[start - 1 : start].isalnum()), float(text[end : end + 1].isalnum()),
        *(float(bool(c.search(before))) for c in _CUES), sum(map(str.isdigit, around)) / max(1, len(around)),
    ]


def decoy(text: str, kind: int, start: int, end: int) -> tuple[str, int, int]:
    """The text with a span made invalid, and where it then stands."""
    span = text[start:end]
    if kind == 0:
        span = span.partition("@")[0] + "@" + span.partition("@")[2].replace(".", "-")
    elif kind == 1:
        span = f"{300 + int(span.split('.')[0][:3])}." + span.split(".", 1)[1]
    elif kind == 2:
        span = span[:-1] + str((int(span[-1]) + 1) % 10)
    else:
        span = span[1:7]
    return text[max(0, start - 60) : start] + span + text[end : end + 60], min(start, 60), min(start, 60) + len(span)


_SPAN = "array<struct<kind:int,start:long,end:long>>"
#: Roles of a candidate: decoy, open, checked, part of or wider than a checked one.
DECOY, OPEN, CHECKED, ENTANGLED = -1, 0, 1, 2


def proposals(docs: DataFrame) -> DataFrame:
    """``row, doc_id, base, candidates, text_hash`` per row; candidates carry their role and features."""
    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
    more = pa.struct([*span, ("role", pa.int32()), ("x", pa.list_(pa.float64()))])
    names = ("kind", "start", "end", "role", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bases, all_spans = [], []
            for t in b.column(2):
                text = t.as_py() or ""
                base = base_spans(text)
                bases.append([dict(zip(("kind", "start", "end"), s)) for s in base])
                known, out, at = set(base), [], sorted((a, z) for _, a, z in base)
                starts = [a for a, _ in at]
                # Spans of different kinds may overlap, so ends are made to rise with the starts.
                ends = list(accumulate((z for _, z in at), max))
                for s in candidates(text, base):
                    before = bisect_left(starts, s[2])
                    role = CHECKED if s in known else ENTANGLED if before and ends[before - 1] > s[1] else OPEN
                    out.append(dict(zip(names, (*s, role, features(text, *s)))))
                for k, a, z in base:
                    out.append(dict(zip(names, (k, a, z, DECOY, features((d := decoy(text, k, a, z))[0], k, d[1], d[2])))))
                all_spans.append(out)
            columns = [b.column(0), b.column(1), pa.array(bases, pa.list_(span)), pa.array(all_spans, pa.list_(more)), b.column(3)]
            yield pa.record_batch(columns, ["row", "doc_id", "base", "candidates", "text_hash"])

    rows = pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.xxhash64("text").alias("text_hash"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, doc_id {kind}, base {_SPAN}, candidates array<struct<kind:int,start:long,end:long,role:int,x:array<double>>>, text_hash long")


def fit(spans: DataFrame, sample: int = 20_000, precision: float = 0.99, least: int = 10) -> tuple[GBTClassificationModel, dict[int, float]] | None:
    """Trees and the score threshold of each kind, or None where there are fewer than ``least`` checked spans.

    ``spans`` are exploded candidates. The trees are fitted on about ``sample`` checked spans and decoys of four fifths of the distinct
    texts, chosen by hash of the text, however files are split; thresholds come from all those of the last fifth, by counts in steps of a
    hundredth made monotone. Equal texts teach once. A kind without a step of enough precision gets no additions.
    """
    fold = F.pmod(F.xxhash64("text_hash"), F.lit(5))
    labelled = spans.filter(F.col("role").isin(DECOY, CHECKED)).withColumn("checked", F.col("role") == CHECKED)
    labelled = labelled.dropDuplicates(["text_hash", "kind", "start", "end", "role"])
    size = labelled.filter((fold < 4) & F.col("checked")).count()
    if size < least:
        return None
    share = min(1.0, sample / (2 * size))
    chosen = labelled.filter((fold < 4) & (F.pmod(F.xxhash64("text_hash", "start", "end"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
    model = GBTClassifier(featuresCol="v", labelCol="label", maxIter=20, maxDepth=4, stepSize=0.2, seed=7).fit(
        chosen.select(array_to_vector("x").alias("v"), F.col("checked").cast("double").alias("label")))
    steps = scored(labelled.filter(fold == 4), model).groupBy("kind", F.floor(F.col("score") * 100).alias("step")).agg(F.count_if("checked").alias("good"), F.count("*").alias("n"))
    thresholds = {}
    for kind in range(len(KINDS)):
        bins = sorted((r["step"], r["good"], r["n"]) for r in steps.filter(F.col("kind") == kind).collect())
        pooled: list[list[float]] = []
        for step, good, n in bins:
            pooled.append([step, good, n])
            # Neighbouring steps are pooled until precision rises with the score.
            while len(pooled) > 1 and pooled[-2][1] * pooled[-1][2] >= pooled[-1][1] * pooled[-2][2]:
                _, g, m = pooled.pop()
                pooled[-1][1] += g
                pooled[-1][2] += m
        enough = [s for s, g, m in pooled if g >= precision * m]
        if enough:
            thresholds[kind] = min(enough) / 100
    return model, thresholds


def scored(spans: DataFrame, model: GBTClassificationModel) -> DataFrame:
    with_vector = spans.withColumn("v", array_to_vector("x"))
    out = model.transform(with_vector)
    return out.withColumn("score", vector_to_array("probability")[1]).drop("v", "rawPrediction", "probability", "prediction")


def find(docs: DataFrame, sample: int = 20_000, precision: float = 0.99) -> DataFrame:
    """``doc_id, base, spans`` of every row of ``docs`` (``doc_id, text``); arrays of kind number, start and end by kind and start.

    ``spans`` are the base spans and the candidates added to them. Where too few candidates exist to learn from, nothing is added. A null text is
    empty; a text without a span has empty arrays; repeated rows come back as often as they went in and an empty
    table gives an empty one.
    """
    rows = written(proposals(docs), "proposals")
    spans = rows.select("row", "text_hash", F.explode("candidates").alias("c")).select("row", "text_hash", "c.*")
    fitted = fit(spans, sample, precision)
    none = F.array().cast(_SPAN)
    if fitted is None or not fitted[1]:
        return rows.select("doc_id", "base", F.col("base").alias("spans"))
    model, thresholds = fitted
    limit = F.create_map(*[x for k, t in thresholds.items() for x in (F.lit(k), F.lit(t))])[F.col("kind")]
    added = scored(spans.filter(F.col("role") == OPEN), model).filter(F.col("score") >= limit)
    added = added.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    return rows.join(added, "row", "left").select("doc_id", "base", F.sort_array(F.concat("base", F.coalesce("more", none))).alias("spans"))


def joined(spans: str):
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
