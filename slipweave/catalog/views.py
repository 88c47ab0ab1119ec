"""Deterministic views that give the base tables the shapes the operators expect.

Each view has a Spark and a DuckDB text. Where one text serves both it is written once, with
``{table}`` marking a table for Spark.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


@dataclass(frozen=True)
class View:
    spark: str
    duck: str

    @property
    def uses(self) -> list[str]:
        return sorted(set(re.findall(r"\{(\w+)\}", self.spark)))


def both(sql: str) -> View:
    """One text for both engines; ``EACH(i,n)`` repeats every row for i = 1..n."""
    each = r"EACH\((\w+),(\d+)\)"
    spark = re.sub(r"varchar\(\d+\)", "string", sql)
    return View(
        re.sub(each, r"lateral view explode(sequence(1, \2)) each_\1 as \1", spark),
        re.sub(
            each,
            lambda m: f"cross join (select unnest(range(1, {int(m[2]) + 1})) as {m[1]}) each_{m[1]}",
            re.sub(r"\{(\w+)\}", r"\1", sql),
        ),
    )


VIEWS: dict[str, View] = {}

# Text lines of the documents with geometry; one document is one page.
VIEWS["doc_lines"] = View(
    """select doc_id as source_id, cast(1 as bigint) as page, cast(pos+1 as bigint) as block_index, col as text,
       cast(40 as double) as x0, cast(14*pos as double) as y0,
       cast(40+6*least(length(col),90) as double) as x1, cast(14*pos+10 as double) as y1,
       cast(1 as double) - (doc_id%5)*cast(0.05 as double) as confidence, doc_id%50=7 as is_watermark
       from {documents} lateral view posexplode(split(text, '\\n')) t as pos, col""",
    """select doc_id as source_id, cast(1 as bigint) as page, cast(i as bigint) as block_index, parts[i] as text,
       cast(40 as double) as x0, cast(14*(i-1) as double) as y0,
       cast(40+6*least(length(parts[i]),90) as double) as x1, cast(14*(i-1)+10 as double) as y1,
       cast(1 as double) - (doc_id%5)*cast(0.05 as double) as confidence, doc_id%50=7 as is_watermark
       from (select doc_id, string_split(text, chr(10)) as parts from documents), unnest(range(1, len(parts)+1)) t(i)""",
)

# Whole documents as one multi-line block per page.
VIEWS["doc_blocks"] = both(
    """select doc_id as source_id, cast(1 as bigint) as page, cast(1 as bigint) as block_index, text,
       cast(40 as double) as x0, cast(20 as double) as y0, cast(500 as double) as x1,
       cast(20+12*(1+length(text)-length(replace(text, chr(10), ''))) as double) as y1,
       cast(1 as double) as confidence, doc_id%50=7 as is_watermark
       from {documents}"""
)

# Positioned blocks without text; page number is the order key.
VIEWS["boxes"] = both(
    """select cast(l_orderkey%100 as bigint) as source_id, l_orderkey as page,
       cast(row_number() over (partition by l_orderkey
          order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_shipdate) as bigint) as block_index,
       cast(10*(l_suppkey%20) as double) as x0,
       cast(20*(l_linenumber-1)+cast(l_quantity as int)%7 as double) as y0,
       cast(10*(l_suppkey%20)+20+l_partkey%40 as double) as x1,
       cast(20*(l_linenumber-1)+cast(l_quantity as int)%7+12 as double) as y1,
       l_returnflag as tag, 1-l_discount as confidence
       from {lineitem}"""
)

VIEWS["slots"] = both(
    """select cast(o_orderkey%100 as bigint) as source_id, o_orderkey as page, cast(i as bigint) as position_index,
       cast(0 as double) as x0, cast(50*(i-1) as double) as y0, cast(260 as double) as x1, cast(50*i as double) as y1,
       concat(cast(o_orderkey as varchar(20)), '-', cast(i as varchar(2))) as instance_id,
       case when o_orderkey%9=0 then 'uncertain' else 'occupied' end as occupancy
       from {orders} EACH(i,3)"""
)

VIEWS["slips"] = both(
    """select o_orderkey as segment_id, o_custkey as source_id,
       case when o_orderkey%2=0 then 'payer' else 'payee' end as own_role,
       case when o_orderkey%13=0 then 'Other Co' else 'Own Co' end as own_name,
       case when o_orderkey%7=0 then '' when o_orderkey%29=0 then '0000009999' else '0000000001' end as own_account,
       case when o_orderkey%11=0 then 'blank' when o_orderkey%11=1 then 'missing'
            when o_orderkey%11=2 then 'ambiguous' else 'present' end as cp_state,
       case when o_orderkey%17=0 then 'Own Co' else c_name end as cp_name,
       lpad(cast(c_custkey as varchar(20)),10,'0') as cp_account,
       case when o_orderkey%19=0 then 'Bank B' when o_orderkey%23=0 then '' else 'Bank A' end as source_bank,
       o_orderkey%31=0 as excluded
       from {orders} join {customer} on o_custkey=c_custkey"""
)

VIEWS["review_log"] = both(
    """select user_id as segment_id, event_id as record_revision, ts as reviewed_at,
       case event_type when 'view' then 'needs_review' when 'click' then 'confirmed' when 'purchase' then 'page_confirmed'
            when 'signup' then 'pending' else 'excluded' end as review_status
       from {events}"""
)

VIEWS["account_rows"] = both(
    """select c_custkey as row_number, c_mktsegment as company_name,
       concat('Bank', cast(c_nationkey as varchar(5))) as bank_name, cast('' as varchar(1)) as branch_name,
       case when c_custkey%17=0 then null else lpad(cast(c_custkey%97 as varchar(5)),6,'0') end as account_number
       from {customer}"""
)

# Accounts already on file: some equal to import rows, some with another company.
VIEWS["accounts_on_file"] = both(
    """select s_suppkey as account_id, case when s_suppkey%3=0 then 'BUILDING' else 'MACHINERY' end as company_name,
       concat('BANK', cast(s_nationkey as varchar(5))) as bank_name, cast('' as varchar(1)) as branch_name,
       lpad(cast(s_suppkey%97 as varchar(5)),6,'0') as account_number, s_suppkey%4<>0 as active
       from {supplier}"""
)

VIEWS["page_status"] = both(
    """select o_custkey as source_id,
       cast(row_number() over (partition by o_custkey order by o_orderkey) as bigint) as page,
       case o_orderstatus when 'F' then 'succeeded' when 'O' then 'pending' else 'failed' end as status
       from {orders}"""
)

VIEWS["seq_events"] = both(
    """select user_id as job_id,
       cast(row_number() over (partition by user_id order by ts, event_id) as bigint) as arrival,
       cast(row_number() over (partition by user_id order by ts, event_id)
         - sum(case when event_id%10=3 then 1 else 0 end) over (partition by user_id order by ts, event_id
             rows between unbounded preceding and current row)
         + case when event_id%997=7 then 5 else 0 end as bigint) as seq, event_type
       from {events}"""
)

# Six label lines per slip, the field values written behind their labels.
_SLIP_TEXT = """
  case when k=1 then concat('付款人名称：', case when own_role='payer' then own_name else cp_shown end)
       when k=2 then concat('付款人账号：', case when own_role='payer' then own_account else cp_account end)
       when k=3 then concat('付款人开户行：', case when own_role='payer' then 'Bank A' else concat('Bank ', cp_account) end)
       when k=4 then concat('收款人名称：', case when own_role='payee' then own_name else cp_shown end)
       when k=5 then concat('收款人账号：', case when own_role='payee' then own_account else cp_account end)
       else concat('收款人开户行：', case when own_role='payee' then 'Bank A' else concat('Bank ', cp_account) end) end"""
VIEWS["slip_lines"] = both(
    f"""select segment_id, cast(k as bigint) as line_no, {_SLIP_TEXT} as text,
        cast(40 as double) as x0, cast(20*k as double) as y0, cast(240 as double) as x1, cast(20*k+12 as double) as y1
        from (select s.*, case cp_state when 'blank' then '无' when 'missing' then '' when 'ambiguous' then '***'
                     else cp_name end as cp_shown from {{slips}} s) s
        EACH(k,6)"""
)

# The same fields printed as separate label and value cells, two columns of three rows.
VIEWS["cell_lines"] = both(
    f"""select segment_id, cast(2*k-1 as bigint) as line_no, split_part(text, '：', 1) as text,
        cast(case when k<=3 then 40 else 340 end as double) as x0, cast(20*((k-1)%3+1) as double) as y0,
        cast(case when k<=3 then 110 else 410 end as double) as x1, cast(20*((k-1)%3+1)+12 as double) as y1
        from (select segment_id, line_no as k, text from {{slip_lines}}) a
        union all
        select segment_id, cast(2*k as bigint), split_part(text, '：', 2),
        cast(case when k<=3 then 120 else 420 end as double), cast(20*((k-1)%3+1)+1 as double),
        cast(case when k<=3 then 260 else 560 end as double), cast(20*((k-1)%3+1)+11 as double)
        from (select segment_id, line_no as k, text from {{slip_lines}}) b where split_part(text, '：', 2) <> ''"""
)

# Routed slips with a page position and a cut-out, for grouping into output files.
VIEWS["routed"] = both(
    """select o_orderkey as segment_id, cast(o_custkey%50 as bigint) as source_id,
       cast(o_custkey%50 as bigint) as source_position, cast(o_orderkey%400 as bigint) as page,
       cast(o_orderkey%3+1 as bigint) as position_index,
       case when o_orderkey%9=0 then 'counterparty_pending' else 'named' end as kind,
       case when o_orderkey%9=0 then 'pending' else concat('g', cast(o_custkey%7 as varchar(5))) end as group_id,
       case when o_orderkey%9=0 then 'Pending' when o_custkey%7=3 then 'Group g2' 
            else concat('Group g', cast(o_custkey%7 as varchar(5))) end as group_label,
       o_orderkey%5=0 as full_page,
       cast(0 as double) as x0, cast(50*(o_orderkey%3) as double) as y0, cast(260 as double) as x1,
       cast(50*(o_orderkey%3)+50 as double) as y1, o_orderkey%31=0 as excluded
       from {orders}"""
)

# Blocks with slip-like text: titles, headings, labels, markers, page labels, values.
_BLOCK_TEXT = """
  case l_partkey%18 when 0 then '客户回单' when 1 then '业务 回单（付款）' when 2 then '中国银行' when 3 then '付款人账号：123'
    when 4 then '此处空白无效！' when 5 then '第1页' when 6 then '打印次数：3' when 7 then '电子缴税付款凭证'
    when 8 then '备注回单' when 9 then '银行收费凭证' when 10 then '业务类型：银行收费' when 11 then '贷款清算通知书'
    when 12 then '招商银行借记通知' when 13 then '农商银行' when 14 then '打印次数：' when 15 then '7'
    when 16 then '摘要' else '汇款费' end"""
VIEWS["blocks"] = both(
    f"""select b.source_id, b.page, b.block_index, {_BLOCK_TEXT} as text, b.x0, b.y0, b.x1, b.y1, b.confidence,
        b.tag='R' and b.block_index%5=4 as is_watermark,
        cast(260 as double) as page_width, cast(160 as double) as page_height
        from (select cast(l_orderkey%100 as bigint) as source_id, l_orderkey as page, l_partkey,
          cast(row_number() over (partition by l_orderkey
            order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_shipdate) as bigint) as block_index,
          cast(10*(l_suppkey%10) as double) as x0,
          cast(20*(l_linenumber-1)+cast(l_quantity as int)%7 as double) as y0,
          cast(10*(l_suppkey%10)+20+l_partkey%40 as double) as x1,
          cast(20*(l_linenumber-1)+cast(l_quantity as int)%7+12 as double) as y1,
          l_returnflag as tag, 1-l_discount as confidence from {{lineitem}}) b"""
)

# Truth of the block texts above, for the SQL side.
VIEWS["block_truth"] = View(
    "select 1",
    """select *, text in ('客户回单','业务 回单（付款）','电子缴税付款凭证','贷款清算通知书','招商银行借记通知') as title,
       case text when '中国银行' then '中国银行' end as bank
       from blocks""",
)
VIEWS["pairs_of_boxes"] = both("select * from {boxes}")

# Slots whose tops drift so that some neighbours overlap a little or a lot.
VIEWS["loose_slots"] = both(
    """select source_id, page, position_index, x0, x1,
       y0 - case when position_index>1 and page%4=1 then 2 when position_index>1 and page%4=2 then 9 else 0 end as top,
       cast(50 as double) as height, cast(160 as double) as page_height, cast(260 as double) as page_width
       from {slots}"""
)

# Search regions: two or three stacked areas per page with a confidence.
VIEWS["regions"] = both(
    """select cast(o_orderkey%100 as bigint) as source_id, o_orderkey as page, cast(i as bigint) as region_no,
       cast(0 as double) as x0, cast(case when i=3 then 0 else 60*(i-1) end as double) as y0, cast(260 as double) as x1,
       cast(case when i=3 then 130 else 60*i end as double) as y1,
       case when (o_orderkey+i)%4=0 then cast(0.65 as double) when (o_orderkey+i)%4=1 then cast(0.85 as double)
            else cast(0.95 as double) end as confidence,
       cast(260 as double) as page_width, cast(160 as double) as page_height
       from {orders} EACH(i,3) where i=1 or o_orderkey%5<>0"""
)

# Keyword hits on the boxes: the return flag stands for the keyword that was found.
VIEWS["box_hits"] = both(
    """select source_id, page, block_index, x0, y0, x1, y1, confidence,
       case tag when 'A' then 'include-0' when 'N' then 'include-1' else 'exclude-0' end as query_id,
       case tag when 'R' then 'exclude' else 'include' end as role
       from {boxes}"""
)
