"""The queries of the training-data operators, with their SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipweave.llm import anchors, automaton, chat, codes, counts, decontaminate, language, outliers, private, secrets, transducer, variants, wrappers
from slipweave.llm.shared import pick

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_robust_outliers(spark, folder):
    return outliers.judge(table(spark, folder, "documents"))


@query
def op7_boosted_candidates(spark, folder):
    found = private.find(table(spark, folder, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(i).__eq__)).cast("long").alias(f"n_{k}") for i, k in enumerate(private.KINDS)]
    return found.select("doc_id", *counts, F.sha2(private.joined("base"), 256).alias("base_sha256"), private.joined("spans").alias("spans"))


@query
def op8_bpe_transducer(spark, folder, vocabulary="byte_bpe_multi_50k.tiktoken"):
    docs = table(spark, folder, "documents")
    return transducer.encoded(docs, public_tokenizers.path(vocabulary), public_tokenizers.PATTERN, ids=False)


@query
def op9_simhash_anchors(spark, folder):
    return anchors.near_duplicates(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


@query
def op2_spaced_seeds(spark, folder):
    return decontaminate.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op3_wrapper_induction(spark, folder):
    return wrappers.extract(table(spark, folder, "pages"))


@query
def op4_backoff_automaton(spark, folder):
    return automaton.scores(table(spark, folder, "documents"))


@query
def op5_randomness_battery(spark, folder):
    found = secrets.scan(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"))


@query
def op6_nearest_centroid(spark, folder):
    docs = pick(table(spark, folder, "documents"), "doc_id", "text", "lang")
    found = language.predict(docs.select("doc_id", "text"), language.learn(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query
def op10_incremental_rendering(spark, folder):
    """All conversations and one more whose texts hold control strings."""
    said = spark.sql("select -7L as conv_id, id as turn, if(id = 0, 'user', 'assistant') as role, '</s>[INST] ok [/INST]' as text from range(2)")
    rows = pick(table(spark, folder, "conversations"), "conv_id", "turn", "role", "text").unionByName(said)
    return chat.digests(chat.formatted(rows))


#: Escapes of a text in SQL: backslashes are doubled, each mark gets two characters more.
_MARKS = "'<s>|</s>|\\[/?INST\\]|<</?SYS>>|\\[/?ROLE\\]'"
_LONGER = f"(length({{0}}) - length(replace({{0}}, chr(92), '')) + 2 * len(regexp_extract_all({{0}}, {_MARKS})))"
ORACLES["op10_incremental_rendering"] = f"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, i, case i when 0 then 'user' else 'assistant' end, '</s>[INST] ok [/INST]' from range(2) t(i)),
sized as (
  select *, length(text) + {_LONGER.format("text")} + case role when 'system' then 18 when 'user' then 18
    when 'assistant' then 6 else 24 + length(role) + {_LONGER.format("role")} end as width from said)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(width) as bigint) as formatted_chars, cast(null as bigint) as rewritten_at
from sized group by conv_id
"""


#: Masked tokens joined as text take the place of hashes; every hit is compared position by position.
_LOOKED = ", ".join(
    f"({m}, {len(mask)}, {[i for i, c in enumerate(mask) if c == '1']})" for m, mask in enumerate(decontaminate.MASKS))
_SPLIT = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}\p{M}]+'), lambda w: w <> '')"
ORACLES["op2_spaced_seeds"] = f"""
with masks(m, width, looked) as (values {_LOOKED}),
d as (select doc_id, {_SPLIT} as t from documents),
b as (select distinct item_id, {_SPLIT} as t from benchmark),
dk as (select doc_id, m, pos, list_transform(looked, lambda o: t[pos + o + 1]) as k from d, masks, unnest(range(0, len(t) - width + 1)) u(pos)),
bk as (select item_id, m, pos, list_transform(looked, lambda o: t[pos + o + 1]) as k from b, masks, unnest(range(0, len(t) - width + 1)) u(pos)),
hits as (select doc_id, item_id, dk.pos as doc_hit, bk.pos as item_hit from dk join bk using (m, k)),
placed as (
  select doc_id, item_id, d.t, b.t as g, doc_hit - item_hit as shift, least(len(b.t), 20) as size,
    greatest(0, least(item_hit - 4, len(b.t) - least(len(b.t), 20))) as start
  from hits join d using (doc_id) join b using (item_id)),
compared as (
  select doc_id, item_id, size, start, start + shift as doc_at,
    len(list_filter(range(start, start + size), lambda i: i + shift >= 0 and t[i + shift + 1] = g[i + 1])) as equal from placed),
good as (select *, row_number() over (partition by doc_id, item_id order by equal / size desc, equal desc, start, doc_at, size desc) as place,
    count(*) over (partition by doc_id, item_id) as n_hits from compared where equal >= ceil(size * 0.8))
select doc_id, item_id, n_hits, equal as matched, size as compared, doc_at, start as item_at from good where place = 1
"""


@query
def op11_whole_tokens(spark, folder, vocabulary="byte_bpe_50k.json"):
    return counts.counted(table(spark, folder, "documents"), public_tokenizers.path(vocabulary))


@query
def op12_orchard_codes(spark, folder):
    return codes.compressed(table(spark, folder, "embeddings"))


@query
def op13_composed_variants(spark, folder):
    return variants.variants(table(spark, folder, "documents"))


def _codes_sql() -> str:
    """Every distance to every entry, and the rounds written out one after the other."""
    apart = "list_sum(list_transform(range(1, len(q) + 1), lambda i: (q[i] - e[i]) * (q[i] - e[i])))"
    parts = [f"""
kept as materialized (
  select row_number() over (order by vec_id, embedding) - 1 as r, vec_id, label,
    list_transform(embedding, lambda x: cast(floor({codes.SCALE} * cast(x as double)) as bigint)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pieces as materialized (
  select r, part, list_slice(v, part * (len(v) // {codes.PARTS}) + 1, (part + 1) * (len(v) // {codes.PARTS})) as q from kept, range({codes.PARTS}) t(part)),
book0 as materialized (select part, r as entry, q as e from pieces where r < {codes.ENTRIES})"""]
    for k in range(codes.ROUNDS + 1):
        parts.append(f"""
near{k} as materialized (
  select r, part, any_value(q) as q, arg_min(entry, d * {codes.ENTRIES} + entry) as entry, min(d) as d
  from (select r, part, q, entry, cast({apart} as hugeint) as d from pieces join book{k} using (part)) group by r, part)""")
        if k < codes.ROUNDS:
            parts.append(f"""
book{k + 1} as materialized (
  select part, entry, coalesce(m.e, b.e) as e from book{k} b left join (
    select part, entry, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as e from (
      select part, entry, i, sum(q[i]) as s, count(*) as n from near{k}, unnest(range(1, len(q) + 1)) t(i) group by part, entry, i)
    group by part, entry) m using (part, entry))""")
    k = codes.ROUNDS
    return f"""with {",".join(parts)},
coded as (select r, string_agg(format('{{:02x}}', entry), '' order by part) as code, cast(sum(d) as bigint) as error from near{k} group by r)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(cast(e[i] as varchar), ',' order by part, entry, i)) from book{k}, unnest(range(1, len(e) + 1)) t(i)) as codebooks_sha256
from kept join coded using (r)
"""


ORACLES["op12_orchard_codes"] = _codes_sql()


#: Keys with one place left open take the composition's place; the checksum is computed byte by byte.
ORACLES["op13_composed_variants"] = """
with recursive folds as (
  select list(c order by i) as t from (select i, list_reduce(list_concat([i], range(8)), lambda c, k:
    case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as c from range(256) r(i))),
runs as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents),
hashed as (
  select run, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)) as x from runs where length(run) >= 7),
summed as (
  select run, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(0, length(x) // 2), lambda i:
    16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c // 256))) as h from hashed, folds),
words as materialized (
  select word, count(*) as n from (
    select case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word from summed)
  where length(word) >= 7 group by word having count(*) >= 2),
places as materialized (
  select word, n, substr(word, 1, spot) as head, substr(word, spot + 2) as tail from words, unnest(range(0, length(word))) u(spot)),
cut as (select distinct word, n, head || tail as rest from places),
pairs as materialized (
  select a.word, b.word as other, b.n as other_n from places a join places b on a.head = b.head and a.tail = b.tail and a.word <> b.word
  union all select c.word, w.word, w.n from cut c join words w on c.rest = w.word
  union all select w.word, c.word, c.n from cut c join words w on c.rest = w.word),
best as (select word, count(*) as n_near, arg_min(other, {'a': -other_n, 'b': other}) as other, max(other_n) as other_n from pairs group by word),
forms as materialized (
  select w.word, case when other_n >= 10 * n then other end as form, n, coalesce(n_near, 0) as n_near,
    case when other_n >= 10 * n then other_n end as form_n from words w left join best using (word)),
chain as (
  select word, word as last, 0 as steps from forms
  union all select c.word, f.form, steps + 1 from chain c join forms f on f.word = c.last where f.form is not null)
select word, form, root, n, n_near, form_n from forms join (select word, arg_max(last, steps) as root from chain group by word) using (word)
"""
