"""Search, criteria and evidence queries over document lines."""

import uuid

from pyspark.sql import functions as F

from slipweave.catalog.registry import query
from slipweave.functions import text as tx
from slipweave.operators import search
from slipweave.session import shared_folder
from slipweave.streaming.progress import stream_search

CLAUSES = [("include-0", "the", "include"), ("include-1", "tion", "include"), ("exclude-0", "nnt", "exclude")]
_VALUES = "(values ('include-0','the','include'),('include-1','tion','include'),('exclude-0','nnt','exclude')) c(query_id, keyword, role)"
_HITS = f"""hits as (
  select l.source_id, l.page, l.block_index, l.y0, trim(l.text) as matched_text, c.query_id, c.role
  from doc_lines l join {_VALUES} on contains(l.text, c.keyword))"""


@query(
    "search_exact",
    "doc_lines",
    "select source_id, block_index, trim(text) as matched_text, x0, y0, x1, y1, confidence from doc_lines where contains(text, 'ation')",
)
def _(t):
    return search.search_exact(t.doc_lines, "ａｔｉｏｎ").select(
        "source_id", "block_index", "matched_text", "x0", "y0", "x1", "y1", "confidence"
    )


@query("search_fuzzy")
def _(t):
    return search.search_fuzzy(t.doc_lines, "receipt").select("source_id", "block_index", "confidence")


@query(
    "search_clauses",
    "doc_lines",
    f"with {_HITS} select source_id, block_index, query_id, role, matched_text from hits",
)
def _(t):
    return search.search_clauses(t.doc_lines, CLAUSES).select(
        "source_id", "block_index", "query_id", "role", "matched_text"
    )


@query("stream_search", "doc_lines", f"with {_HITS} select source_id, block_index, query_id, role, matched_text from hits")
def _(t):
    """The same search over lines that land as a stream, read back from its sink."""
    root = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    t.doc_lines.write.parquet(f"{root}/landed")
    landed = t.spark.readStream.schema(t.doc_lines.schema).parquet(f"{root}/landed")
    hits = stream_search(landed, CLAUSES).select("source_id", "block_index", "query_id", "role", "matched_text")
    sink = hits.writeStream.format("parquet").option("path", f"{root}/hits").option("checkpointLocation", f"{root}/progress")
    sink.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(hits.schema).parquet(f"{root}/hits")


@query(
    "criteria_search_documents",
    "doc_lines",
    f"""with {_HITS}, ok as (
      select source_id, cast(count(*) filter (where role='include') as bigint) as include_hits from hits group by source_id
      having count(distinct case when role='include' then query_id end)=2 and count(*) filter (where role='exclude')=0),
    texts as (select source_id, matched_text, min(block_index) as first_at from hits where role='include' group by all)
    select ok.source_id, ok.include_hits, cast(count(*) as bigint) as texts, string_agg(matched_text, '、' order by first_at) as evidence
    from ok join texts using (source_id) group by all""",
)
def _(t):
    hits = search.search_clauses(t.doc_lines, CLAUSES)
    kept = search.eval_criteria(hits, ["source_id"], ["include-0", "include-1"])
    return kept.join(search.evidence_text(hits, ["source_id"], ["block_index"]), "source_id")


@query(
    "criteria_any_mode",
    "doc_lines",
    f"""with {_HITS} select source_id, cast(count(*) filter (where role='include') as bigint) as include_hits
    from hits group by source_id
    having count(*) filter (where role='include')>0 and count(*) filter (where role='exclude')=0""",
)
def _(t):
    hits = search.search_clauses(t.doc_lines, CLAUSES)
    return search.eval_criteria(hits, ["source_id"], ["include-0", "include-1"], "any")


_DATED = """select o_orderkey, concat('No ', cast(o_orderkey as varchar), ' 交易日期：', cast(year(o_orderdate)+10 as varchar), '年',
  cast(month(o_orderdate) as varchar), '月', cast(day(o_orderdate) as varchar), '日 金额 ', cast(o_custkey as varchar), ',', lpad(cast(o_orderkey%1000 as varchar),3,'0'), '.5') as text
  from orders"""


def _dated(t):
    day = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        F.concat(
            F.lit("No "), F.col("o_orderkey").cast("string"), F.lit(" 交易日期："),
            (F.year(day) + 10).cast("string"), F.lit("年"), F.month(day).cast("string"), F.lit("月"),
            F.dayofmonth(day).cast("string"), F.lit("日 金额 "), F.col("o_custkey").cast("string"), F.lit(","),
            F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit(".5"),
        ).alias("text"),
    )


@query(
    "filter_date",
    "",
    f"""select o_orderkey from ({_DATED}) d join orders using (o_orderkey)
    where year(o_orderdate)+10 between 2000 and 2099
      and make_date(year(o_orderdate)+10, month(o_orderdate), least(day(o_orderdate), 28)) + (day(o_orderdate) - least(day(o_orderdate), 28))::int
          between date '2006-03-05' and date '2008-02-10'
      and not (month(o_orderdate)=2 and day(o_orderdate)=29 and (year(o_orderdate)+10)%4<>0)""",
)
def _(t):
    return search.filter_date(_dated(t), "2006-03-05", "2008-02-10").select("o_orderkey")


@query(
    "filter_amount",
    "",
    """select o_orderkey from (select o_orderkey, o_custkey*1000.0 + o_orderkey%1000 + 0.5 as amount,
       least(o_orderkey, month(o_orderdate), day(o_orderdate)) as lo, greatest(o_orderkey, year(o_orderdate)+10) as hi from orders)
    where greatest(amount, hi) >= 900000 and least(amount, lo) <= 3""",
)
def _(t):
    return search.filter_amount(_dated(t), 900000, 3).select("o_orderkey")


@query(
    "tag_field",
    "doc_lines",
    """select source_id, block_index, case when contains(text,'tion') then 'tion' when contains(text,'ent') then 'ent'
    when contains(text,'der') then 'der' end as matched_field from doc_lines""",
)
def _(t):
    return t.doc_lines.select(
        "source_id", "block_index", search.tag_field(F.col("text"), ["tion", "ent", "der"]).alias("matched_field")
    )


@query(
    "filter_field",
    "doc_lines",
    """select source_id, block_index from doc_lines where contains(text,'an') and not contains(text,'tion') and contains(text,'ent')""",
)
def _(t):
    found = search.search_exact(t.doc_lines, "an")
    return search.filter_field(found, "ent", ["tion", "ent", "der"]).select("source_id", "block_index")


@query(
    "normalize_criteria",
    "",
    """with raw as (select o_custkey as set_id, case when o_orderkey%3=0 then 'exclude' else 'include' end as role, o_orderkey as ordinal,
      case when o_orderkey%10=4 then '  ' else concat(' ', o_orderpriority, ' ') end as keyword, case when o_custkey%2=0 then 'any' end as mode from orders),
    f as (select set_id, role, trim(keyword) as keyword, min(ordinal) as ordinal, any_value(mode) as mode from raw where trim(keyword)<>'' group by 1,2,3)
    select set_id, concat(role, '-', cast(row_number() over (partition by set_id, role order by ordinal)-1 as varchar)) as query_id,
      keyword, role, case when mode='any' then 'any' else 'all' end as mode from f""",
)
def _(t):
    raw = t.orders.select(
        F.col("o_custkey").alias("set_id"),
        F.when(F.col("o_orderkey") % 3 == 0, "exclude").otherwise("include").alias("role"),
        F.col("o_orderkey").alias("ordinal"),
        F.when(F.col("o_orderkey") % 10 == 4, "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit("\u3000"))).alias("keyword"),
        F.when(F.col("o_custkey") % 2 == 0, "any").alias("mode"),
    )
    return search.normalize_criteria(raw)


@query(
    "first_hit_per_query",
    "doc_lines",
    f"""with {_HITS} select source_id, query_id, block_index, matched_text from (
      select *, row_number() over (partition by source_id, query_id order by block_index) as rn from hits) where rn=1""",
)
def _(t):
    hits = search.search_clauses(t.doc_lines, CLAUSES).select("source_id", "query_id", "block_index", "matched_text")
    return search.first_hits(hits, ["source_id"], ["block_index"])


@query(
    "evidence_text",
    "doc_lines",
    """with texts as (select source_id, trim(text) as matched_text, min(block_index) as first_at from doc_lines where contains(text, 'ent') and trim(text)<>'' group by 1, 2)
    select source_id, string_agg(matched_text, '、' order by first_at) as evidence, cast(count(*) as bigint) as texts from texts group by 1""",
)
def _(t):
    hits = search.search_clauses(t.doc_lines, [("include-0", "ent", "include"), ("exclude-0", "der", "exclude")])
    return search.evidence_text(hits, ["source_id"], ["block_index"])


@query(
    "limits_audit",
    "doc_lines",
    """select source_id, page, cast(count(*) as bigint) as blocks, cast(sum(length(text)) as bigint) as characters,
    cast(max(length(text)) as bigint) as longest_block,
    concat_ws(',', case when count(*)>20 then 'blocks' end, case when sum(length(text))>2000 then 'characters' end,
      case when max(length(text))>900 then 'block_characters' end) as over_limit from doc_lines group by 1, 2""",
)
def _(t):
    caps = {"blocks_per_page": 20, "page_characters": 2000, "block_characters": 900}
    return search.limits_audit(t.doc_lines, limits=caps)


@query(
    "job_limits",
    "doc_lines",
    """select 'pages' as counter, cast(count(distinct source_id) as bigint) as value, cast(100 as bigint) as cap, count(distinct source_id)>100 as over from doc_lines
    union all select 'total_characters', cast(sum(length(text)) as bigint), cast(64000000 as bigint), sum(length(text))>64000000 from doc_lines
    union all select 'matches', cast(count(*) as bigint), cast(10000 as bigint), count(*)>10000 from doc_lines where contains(text, 'the')""",
)
def _(t):
    return search.job_limits(t.doc_lines, search.search_exact(t.doc_lines, "the"), {"pages": 100})


@query(
    "norm_search",
    "doc_lines",
    "select source_id, block_index, trim(replace(text, 'q', '(')) as normal from doc_lines",
)
def _(t):
    widened = F.concat(F.lit("\u3000"), F.translate("text", "abcxyzq", "ａｂｃｘｙｚ（"), F.lit(" \u200b\u3000"))
    return t.doc_lines.select("source_id", "block_index", tx.norm_search(widened).alias("normal"))


@query(
    "norm_name",
    "doc_lines",
    r"select source_id, block_index, trim(regexp_replace(nfc_normalize(text), '[ \t\r]+', ' ', 'g')) as normal from doc_lines",
)
def _(t):
    split_up = F.replace("text", F.lit("\u00e9"), F.lit("e\u0301"))
    widened = F.concat(F.lit(" "), F.translate(split_up, "abc ", "ａｂｃ\u3000"), F.lit("\u3000\t "))
    return t.doc_lines.select("source_id", "block_index", tx.norm_name(widened).alias("normal"))


@query(
    "norm_account_and_bank",
    "slips",
    """select segment_id, cp_account as account, lower(trim(cp_name)) as bank from slips""",
)
def _(t):
    wide = F.translate("cp_account", "0123456789", "０１２３４５６７８９")
    spaced = F.concat_ws(" ", F.substring(wide, 1, 4), F.substring(wide, 5, 6))
    return t.slips.select(
        "segment_id", tx.norm_account(spaced).alias("account"), tx.norm_bank(F.concat(F.lit(" "), "cp_name")).alias("bank")
    )


@query("norm_field")
def _(t):
    return t.doc_lines.select(
        "source_id", "block_index", tx.norm_field(F.lit("name"), F.translate("text", "abc", "ａｂⅣ")).alias("normal")
    )
