"""Nulls, repeated rows, empty tables, very long texts and clashing columns for every operator and stage; the pipeline."""

import os
import re

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slipweave.llm import anchors, automaton, catalog, chat, decontaminate, language, outliers, private, secrets, transducer, wrappers

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(spark):
    text = "some words that are told here for the sake of the test and nothing more of it"
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, None, None, None, None), (None, "", "en", None, 0), (None, text + " x", None, "s", 1), (3, "a" * 200_000 + " é" * 50_000, "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS)


def with_clashes(df):
    """Columns that differ in case or share a name with what operators make."""
    names = ["Text", "score", "kept", "fp", "row", "c0", "spans", "digest", "hash", "a.b"]
    return df.toDF(*[f"x{i}" for i in range(5)]).select("*", *[F.lit(i).alias(f"y{i}") for i in range(len(names))]).toDF(*df.columns, *names)


def operators(spark, folder=FOLDER):
    bench = spark.createDataFrame([(1, "some words that are told here for the sake of the test"), (None, "x")], "item_id long, text string")
    vocabulary = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return {
        "outliers": outliers.judge, "overlaps": lambda d: decontaminate.overlaps(d, bench), "automaton": automaton.scores, "secrets": secrets.scan,
        "language": lambda d: language.predict(d, language.learn(d)), "private": private.find, "encoded": lambda d: transducer.encoded(d, *vocabulary), "anchors": anchors.near_duplicates,
    }


@pytest.mark.parametrize("name", ["outliers", "overlaps", "automaton", "secrets", "language", "private", "encoded", "anchors"])
def test_odd_rows(spark, name):
    operator, docs = operators(spark)[name], rows_of(spark)
    own = [c for c in operator(docs).columns if c not in docs.columns or c == "doc_id"]
    found = operator(docs).select(own).collect()
    if name == "overlaps":
        assert [(r.doc_id, r.item_id) for r in found] == [(1, 1)]
    else:
        assert sorted((r.doc_id for r in found), key=str) == sorted([1, 1, 2, None, None, 3], key=str)
        ones = [r for r in found if r.doc_id == 1]
        assert ones[0] == ones[1]
    assert operator(docs.filter("false")).count() == 0
    clashing = operator(with_clashes(docs))
    assert len(clashing.collect()) == len(found)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = with_clashes(rows_of(spark))
    out = stage(spark, docs, FOLDER)
    if name != "encoding":
        assert out.columns == docs.columns
        assert stage(spark, rows_of(spark), FOLDER).columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    out.collect()
    assert stage(spark, docs.filter("false"), FOLDER).count() == 0


def test_pages_and_conversations(spark):
    pages = spark.createDataFrame([(None, None, None), (1, "http://a/b", "<p>x" * 3), (1, "http://a/b", "<p>x" * 3)], "page_id long, url string, html string")
    assert sorted(r.text for r in wrappers.extract(pages).collect()) == ["", "x\nx\nx", "x\nx\nx"]
    assert wrappers.extract(pages.filter("false")).count() == 0
    assert wrappers.extract(pages.toDF("page_id", "url", "html").withColumn("HTML2", F.lit(1)).toDF("page_id", "url", "html", "HTML")).count() == 3
    turns = spark.createDataFrame([(None, None, None, None), (1, 1, "user", "x"), (1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r.n_turns for r in chat.digests(chat.formatted(turns)).collect()}
    assert found == {None: 1, 1: 2}
    assert chat.digests(chat.formatted(turns.filter("false"))).count() == 0


def shingle_set(text, width=5):
    """Five-word shingles of a text; fewer words are one shingle."""
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall("[^\\x20\\x09-\\x0D]+", text or "")]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")
def test_pipeline_step_by_step(spark):
    """The stages' decisions, taken again in plain code from the documents."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    langs = language.predict(docs, language.learn(docs)).collect()
    left = {r.doc_id for r in langs if not r.rejected}
    sets = {i: shingle_set(texts[i]) for i in left}
    root = {i: i for i in left}
    for i in sorted(left):
        for j in sorted(left):
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    left = {i for i in left if root[i] == i}
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    left -= {r[0] for r in con.execute(catalog.ORACLES["op2_spaced_seeds"]).fetchall()}
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(found) == left
    spans = {r.doc_id: r.spans for r in secrets.scan(docs.filter(F.col("doc_id").isin(sorted(left)))).collect()}
    fst = transducer.transducer(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for i in left:
        text, to = "", 0
        for s in spans[i]:
            text += "" if s.start < to else texts[i][to : s.start] + "[SECRET]"
            to = max(to, s.end)
        assert found[i].ids == fst.encode(text + texts[i][to:]).tolist()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_registered_queries(spark, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    got = df.collect()
    assert got
    if name in catalog.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "benchmark", "conversations", "embeddings"):
            con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
        cur = con.execute(catalog.ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(r[c] for c in names)) for r in got)
