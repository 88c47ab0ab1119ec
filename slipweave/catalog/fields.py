"""Queries that read labelled fields back out of rendered slips."""

from pyspark.sql import functions as F

from slipweave.catalog.registry import query
from slipweave.functions import text as tx
from slipweave.operators import fields as fd
from slipweave.operators import labels as lb
from slipweave.plans import parties
from slipweave.session import stage


def _scoped(df, width=600.0, height=140.0):
    return df.withColumns({"sx0": F.lit(0.0), "sy0": F.lit(0.0), "sx1": F.lit(width), "sy1": F.lit(height)})


_TRUTH = """truth as (select segment_id, side, field, case field
    when 'name' then case when side=own_role then own_name else case cp_state when 'blank' then '无' when 'missing' then '' when 'ambiguous' then '***' else cp_name end end
    when 'account' then case when side=own_role then own_account else cp_account end
    else case when side=own_role then 'Bank A' else concat('Bank ', cp_account) end end as printed
  from slips cross join (values ('payer'),('payee')) s(side) cross join (values ('name'),('account'),('bank')) f(field))"""
_STATES = f"""with {_TRUTH} select segment_id, side, field, printed as raw, case when printed='无' then '' else printed end as value,
  case when printed='' then 'missing' when printed='无' then 'blank' when printed='***' then 'ambiguous' else 'present' end as state from truth"""


@query("extract_parties_inline", "slips", _STATES)
def _(t):
    return parties.extract_parties(_scoped(t.slip_lines))


@query("extract_parties_cells", "slips", _STATES)
def _(t):
    return parties.extract_parties(_scoped(t.cell_lines))


@query(
    "match_labels",
    "slips",
    f"""with {_TRUTH} select segment_id, case side when 'payer' then 0 else 3 end + case field when 'name' then 1 when 'account' then 2 else 3 end as line_no,
    concat(case side when 'payer' then '付款人' else '收款人' end, case field when 'name' then '名称' when 'account' then '账号' else '开户行' end) as label, printed as value, side, field, true as explicit from truth""",
)
def _(t):
    return lb.match_labels(t.slip_lines).select(
        "segment_id", F.col("line_no").cast("int").alias("line_no"), "label", "value", "side", "field", "explicit"
    )


# Two columns of bare field labels under one role word each.
_COLUMNS = """select segment_id, cast(1 as bigint) as line_no, {payer_head} as text, cast(40 as double) as x0, cast(20 as double) as y0, cast(80 as double) as x1, cast(32 as double) as y1"""


def _columns(t, table=False):
    s = t.slips
    rows = []
    for k, side, x in ((0, "payer", 40.0), (1, "payee", 340.0)):
        own = F.col("own_role") == side
        name = F.when(own, F.col("own_name")).otherwise(F.col("cp_name"))
        acc = F.when(own, F.lit("0000000001")).otherwise(F.col("cp_account"))
        word = "付款人" if side == "payer" else "收款人"
        head_y = 40.0 if table else 20.0
        rows.append((1 + k, F.lit(word), x, head_y, x + 36, head_y + 12))
        for j, (label, value) in enumerate((("户名", name), ("账号", acc))):
            y = 40.0 + 20 * j
            rows.append((3 + 4 * j + 2 * k, F.lit(label), x + 50, y, x + 74, y + 12))
            rows.append((4 + 4 * j + 2 * k, value, x + 80, y + 1, x + 220, y + 11))
    structs = [
        F.struct(
            F.lit(n).cast("long").alias("line_no"), v.cast("string").alias("text"), F.lit(x0).alias("x0"), F.lit(y0).alias("y0"),
            F.lit(x1).alias("x1"), F.lit(y1).alias("y1"),
        )
        for n, v, x0, y0, x1, y1 in rows
    ]
    return _scoped(s.select("segment_id", F.explode(F.array(*structs)).alias("r")).select("segment_id", "r.*"))


_COLUMN_TRUTH = """select segment_id, side, field, raw, raw as value, case when raw='' then 'missing' else 'present' end as state from (
  select segment_id, side, field, case field when 'name' then case when side=own_role then own_name else cp_name end
   when 'account' then case when side=own_role then '0000000001' else cp_account end else '' end as raw
  from slips cross join (values ('payer'),('payee')) s(side) cross join (values ('name'),('account'),('bank')) f(field))"""


@query("extract_parties_columns", "slips", _COLUMN_TRUTH.replace("when 'name' then case", "when 'name' then case"))
def _(t):
    # Role words stand above their columns; they are headers, so they carry no value themselves.
    return parties.extract_parties(_columns(t, table=True))


@query(
    "role_headers",
    "slips",
    "select segment_id, cast(40 as double) as payer_x0, cast(340 as double) as payee_x0, cast(1 as bigint) as payer_line, cast(2 as bigint) as payee_line from slips",
)
def _(t):
    lines = _columns(t, table=True)
    generic = lb.match_labels(lines).filter("side = ''")
    return fd.role_headers(lines, generic).select(
        "segment_id", F.col("p_x0").alias("payer_x0"), F.col("q_x0").alias("payee_x0"),
        F.col("p_first_line").alias("payer_line"), F.col("q_first_line").alias("payee_line"),
    )


@query(
    "table_values",
    "slips",
    "select segment_id, side, field, text from (" + _COLUMN_TRUTH.replace("raw, raw as value", "raw as text").replace(", case when raw='' then 'missing' else 'present' end as state", "") + ") where text<>''",
)
def _(t):
    lines = _columns(t, table=True)
    generic = stage(lb.match_labels(lines).filter("side = ''"))
    return fd.table_values(generic, lines, stage(fd.role_headers(lines, generic))).select("segment_id", "side", "field", "text")


@query(
    "column_side",
    "slips",
    "select segment_id, field, case when x=0 then 'payer' else 'payee' end as side from slips cross join (values (0),(1)) c(x) cross join (values ('name'),('account')) f(field)",
)
def _(t):
    lines = _columns(t)
    cells = stage(lb.match_labels(lines))
    return fd.column_side(cells.filter("side = ''").drop("side"), cells.filter("side <> ''")).select("segment_id", "field", "side")


_BOX_LABELS = """lab as (select page as segment_id, block_index as line_no, case when tag='A' then 'payer' else 'payee' end as side, case when block_index%2=0 then 'name' else 'account' end as field,
   x0, y0, x1, y1, (y0+y1)/2 as cy, y1-y0 as h from boxes where tag<>'R'),
val as (select page as segment_id, block_index as line_no, concat('值', block_index) as text, x0, y0+1 as y0, x1, y1 as y1, (y0+1+y1)/2 as cy, y1-y0-1 as h from boxes where tag='R'),
bounds as (select a.segment_id, a.line_no,
   min(case when b.x0>=a.x1 and b.h>=a.h*0.35 and b.h<=a.h*1.5 and least(a.y1,b.y1)-greatest(a.y0,b.y0)>=least(a.h,b.h)*0.45 and abs(a.y0+a.y1-b.y0-b.y1)<=a.h*1.2 then b.x0 end) as rt,
   max(case when a.side=b.side and abs(b.x0-a.x0)<=a.h and b.cy<a.cy-a.h*0.5 then (a.cy+b.cy)/2 end) as up,
   min(case when a.side=b.side and abs(b.x0-a.x0)<=a.h and b.cy>a.cy+a.h*0.5 then (a.cy+b.cy)/2 end) as lo
   from lab a left join lab b on a.segment_id=b.segment_id and a.line_no<>b.line_no group by 1, 2),
near as (select a.segment_id, a.line_no, a.field, v.line_no as value_line, v.text, v.x0, v.y0, v.x1, v.y1 from lab a join bounds b using (segment_id, line_no) join val v on v.segment_id=a.segment_id
  and v.x0>=a.x1 and v.x0<=a.x1+12*a.h and (rt is null or v.x1<=rt) and (up is null or v.cy>up) and (lo is null or v.cy<lo)
  and v.h>=a.h*0.35 and v.h<=a.h*1.5 and least(a.y1,v.y1)-greatest(a.y0,v.y0)>=least(a.h,v.h)*case when a.field='account' then 0.45 else 0.15 end
  and abs(a.y0+a.y1-v.y0-v.y1)<=a.h*case when a.field='account' then 1.2 else 1.8 end)"""


def _box_cells(t):
    b = t.boxes
    side = F.when(F.col("tag") == "A", "payer").otherwise("payee")
    lab = b.filter("tag <> 'R'").select(
        F.col("page").alias("segment_id"), F.col("block_index").alias("line_no"), F.lit(0).alias("cell_no"), side.alias("side"),
        F.when(F.col("block_index") % 2 == 0, "name").otherwise("account").alias("field"), F.lit("x").alias("label"), "x0", "y0", "x1", "y1",
    )
    val = b.filter("tag = 'R'").select(
        F.col("page").alias("segment_id"), F.col("block_index").alias("line_no"),
        F.concat(F.lit("值"), F.col("block_index").cast("string")).alias("text"), "x0", (F.col("y0") + 1).alias("y0"), "x1", "y1",
    )
    return lab, val


@query("nearest_right", "boxes", f"with {_BOX_LABELS} select segment_id, line_no, field, value_line, text from near")
def _(t):
    lab, val = _box_cells(t)
    return fd.nearest_right(lab, lab, val).select("segment_id", "line_no", "field", "value_line", "text")


@query(
    "join_wrapped",
    "boxes",
    """with v as (select page as segment_id, block_index as line_no, case when page%5=0 then 'account' else 'name' end as field, concat(case when block_index=3 and page%7=0 then 'x' else '字' end, block_index) as text, x0, y0, x1, y1,
        lag(x0) over w as px0, lag(y0) over w as py0, lag(x1) over w as px1, lag(y1) over w as py1, row_number() over w as rn, count(*) over (partition by page) as n
      from (select page, block_index, 40.0::double as x0, 14.0::double*block_index + case when page%3=0 and block_index=2 then 9 else 0 end as y0, x1-x0+40 as x1, 14.0::double*block_index + case when page%3=0 and block_index=2 then 9 else 0 end + 12 as y1 from boxes)
      window w as (partition by page order by y0, x0, block_index)),
    j as (select *, bool_and((py0 is null or (y0-py0>=8.4::double and y0-py0<=18)) and not regexp_matches(text, '[A-Za-z]')) over (partition by segment_id) and n>1 and field<>'account' as ok from v)
    select segment_id, field, cast(case when ok then 1 else rn end as bigint) as value_no, string_agg(text, '' order by rn) as text from j group by 1, 2, 3""",
)
def _(t):
    i = F.col("block_index")
    y = F.lit(14.0) * i + F.when((F.col("page") % 3 == 0) & (i == 2), 9).otherwise(0)
    v = t.boxes.select(
        F.col("page").alias("segment_id"), F.lit(1).alias("line_no"), F.lit(0).alias("cell_no"), F.lit("payer").alias("side"),
        F.when(F.col("page") % 5 == 0, "account").otherwise("name").alias("field"), F.lit("x").alias("label"), i.alias("value_line"),
        F.concat(F.when((i == 3) & (F.col("page") % 7 == 0), "x").otherwise("字"), i.cast("string")).alias("text"),
        F.lit(40.0).alias("x0"), y.alias("y0"), (F.col("x1") - F.col("x0") + 40).alias("x1"), (y + 12).alias("y1"),
    )
    return fd.join_wrapped(v).select("segment_id", "field", "value_no", "text")


@query(
    "next_line_value",
    "boxes",
    """with l as (select page as segment_id, block_index as line_no, tag<>'R' as lab, case when tag='A' then 'payer' else 'payee' end as side, concat('值', block_index) as text, x0, y0, x1, y1, (x0+x1)/2 as cx from boxes),
    c as (select segment_id, avg(case when side='payer' then cx end) as px, avg(case when side='payee' then cx end) as qx from l where lab group by 1),
    r as (select l.*, px, qx, case when px is null and qx is null then null when qx is null or abs(cx-px)<=abs(cx-qx) then 'payer' else 'payee' end as near_side from l left join c using (segment_id)),
    a as (select *, lead(struct_pack(text:=text, y0:=y0, lab:=lab, side:=side, near_side:=near_side), 1) over w as n1, lead(struct_pack(text:=text, y0:=y0, lab:=lab, side:=side, near_side:=near_side), 2) over w as n2 from r window w as (partition by segment_id order by line_no)),
    v as (select *, case when n1 is null or n1.y0-y1>30 then 'stop' when n1.lab then case when n1.side<>side then 'skip' else 'stop' end when px is not null and qx is not null and n1.near_side<>side then 'skip' else 'take' end as a1,
       case when n2 is null or n2.y0-y1>30 then 'stop' when n2.lab then case when n2.side<>side then 'skip' else 'stop' end when px is not null and qx is not null and n2.near_side<>side then 'skip' else 'take' end as a2 from a where lab)
    select segment_id, line_no, side, case when a1='take' then n1.text else n2.text end as text from v where a1='take' or (a1='skip' and a2='take')""",
)
def _(t):
    lines = t.boxes.select(
        F.col("page").alias("segment_id"), F.col("block_index").alias("line_no"), "tag",
        F.concat(F.lit("值"), F.col("block_index").cast("string")).alias("text"), "x0", "y0", "x1", "y1",
    )
    cells = lines.filter("tag <> 'R'").withColumns(
        {
            "side": F.when(F.col("tag") == "A", "payer").otherwise("payee"), "field": F.lit("name"), "label": F.lit("x"),
            "cell_no": F.lit(0), "cross_column": F.lit(False),
        }
    ).drop("text")
    return fd.next_line_value(cells, lines, cells, fd.column_centers(cells)).select("segment_id", "line_no", "side", "text")


@query(
    "merge_field_values",
    "slips",
    """with c as (select source_id, segment_id, case when cp_state='present' then case when segment_id%3=0 then 'A' else concat('V', segment_id%4) end else '' end as value, case when cp_state='ambiguous' then 'missing' else cp_state end as state from slips),
    d as (select source_id%400 as source_id, value, state, min(segment_id) as o from c where state<>'missing' group by 1, 2, 3)
    select source_id, case when count(*)=1 then min(value) else string_agg(value, ' | ' order by o) end as value, case when count(*)=1 then min(state) else 'ambiguous' end as state, cast(count(*) as bigint) as readings from d group by 1""",
)
def _(t):
    value = F.when(F.col("cp_state") == "present", F.when(F.col("segment_id") % 3 == 0, "A").otherwise(F.concat(F.lit("V"), (F.col("segment_id") % 4).cast("string")))).otherwise("")
    c = t.slips.select(
        (F.col("source_id") % 400).alias("source_id"), "segment_id", value.alias("value"), value.alias("raw"),
        F.when(F.col("cp_state") == "ambiguous", "missing").otherwise(F.col("cp_state")).alias("state"),
    )
    return fd.merge_field_values(c, ["source_id"], ["segment_id"]).select("source_id", "value", "state", "readings")


@query(
    "clip_lines",
    "box_hits slots",
    """select b.page, block_index, s.instance_id as segment_id, case when b.x0>=s.x0-0.5 and b.y0>=s.y0-0.5 and b.x1<=s.x1+0.5 and b.y1<=s.y1+0.5 then 'inside' else 'crosses' end as clip
    from box_hits b join slots s on b.page=s.page where (b.x0>=s.x0-0.5 and b.y0>=s.y0-0.5 and b.x1<=s.x1+0.5 and b.y1<=s.y1+0.5)
     or (least(b.x1,s.x1)>greatest(b.x0,s.x0) and least(b.y1,s.y1)>greatest(b.y0,s.y0))""",
)
def _(t):
    scopes = t.slots.withColumnRenamed("instance_id", "segment_id")
    return fd.clip_lines(t.box_hits, scopes).select("page", "block_index", "segment_id", "clip")


_DIRECT_TEXTS = """case k when 1 then concat('对方户名：', case when cp_state='missing' then '' else cp_name end) when 2 then concat('对方账号：', cp_account, ' 摘要：x') when 3 then concat('本方户名：', own_name)
  when 4 then '对方开户行' else concat('银行', cp_account) end"""


def _direct_lines(t):
    s = t.slips.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(5))))
    k = F.col("k")
    text = (
        F.when(k == 1, F.concat(F.lit("对方户名："), F.when(F.col("cp_state") == "missing", "").otherwise(F.col("cp_name"))))
        .when(k == 2, F.concat(F.lit("对方账号："), "cp_account", F.lit(" 摘要：x")))
        .when(k == 3, F.concat(F.lit("本方户名："), "own_name"))
        .when(k == 4, "对方开户行").otherwise(F.concat(F.lit("银行"), "cp_account"))
    )
    return s.select(
        "segment_id", k.cast("long").alias("line_no"), text.alias("text"), F.lit(40.0).alias("x0"), (k * 14).cast("double").alias("y0"),
        F.lit(240.0).alias("x1"), (k * 14 + 12).cast("double").alias("y1"),
    )


@query(
    "extract_direct",
    "slips",
    """select segment_id, side, field, raw, raw as value, case when raw='' then 'missing' else 'present' end as state from (
    select segment_id, side, field, case when side='own' then case when field='name' then own_name else '' end
      when field='name' then case when cp_state='missing' then '' else cp_name end when field='account' then cp_account else concat('银行', cp_account) end as raw
    from slips cross join (values ('own'),('counterparty')) s(side) cross join (values ('name'),('account'),('bank')) f(field))""",
)
def _(t):
    return parties.extract_direct(_direct_lines(t))


_R = "x0 y0 x1 y1".split()
_DOUBTFUL = """d as (select *, segment_id%9 as k9, case when segment_id%9=4 then concat(chr(65533), 'x') when cp_state='missing' then '' else cp_name end as shown,
   case when segment_id%5=0 then concat('6222*', cp_account) else cp_account end as acc from slips),
read as (select segment_id, 'counterparty' as side, 'name' as field, 1 as line, '对方户名' as label, shown as raw, case when shown='' then 'missing' when k9=4 then 'ambiguous' else 'present' end as state from d
  union all select segment_id, 'counterparty', 'name', 6, '对方户名', 'Other', 'present' from d where k9=5
  union all select segment_id, 'counterparty', 'account', 2, '对方账号', acc, case when segment_id%5=0 then 'ambiguous' else 'present' end from d
  union all select segment_id, 'own', 'name', 3, '本方户名', own_name, 'present' from d
  union all select segment_id, 'counterparty', 'bank', 4, '对方开户行', concat('银行', cp_account), 'present' from d)"""


def _doubtful_lines(t):
    """Direct labels with lost characters, incomplete accounts and second names among them."""
    k, i = F.col("segment_id"), F.col("line_no")
    lines = _direct_lines(t).join(t.slips.select("segment_id", "cp_account"), "segment_id")
    text = (
        F.when((i == 1) & (k % 9 == 4), "对方户名：\ufffdx").when((i == 2) & (k % 5 == 0), F.concat(F.lit("对方账号：6222*"), "cp_account"))
        .otherwise(F.col("text"))
    )
    more = t.slips.select("segment_id", F.lit(6).cast("long").alias("line_no"), F.when(k % 9 == 5, "对方户名：Other").otherwise("").alias("text"),
                          *[F.lit(v).alias(c) for c, v in zip(_R, (40.0, 84.0, 240.0, 96.0))])
    return lines.withColumn("text", text).select(more.columns).unionByName(more)


@query(
    "direct_evidence", "slips",
    f"""with {_DOUBTFUL} select segment_id, side, field, cast(row_number() over (partition by segment_id, side, field order by line) as bigint) as reading,
      case when state='missing' then null when line=4 then 'next_line' else 'same_line' end as method, label, cast(40 as double) as label_x0, cast(14*line as double) as label_y0, cast(240 as double) as label_x1, cast(14*line+12 as double) as label_y1,
      raw, raw as value, state, case when state<>'missing' then 40::double end as x0, case when state<>'missing' then (case line when 4 then 70 else 14*line end)::double end as y0,
      case when state<>'missing' then 240::double end as x1, case when state<>'missing' then (case line when 4 then 82 else 14*line+12 end)::double end as y1 from read""")
def _(t):
    return parties.explained_direct(_doubtful_lines(t)).evidence


_DIRECT_ISSUES = _DOUBTFUL + """, i as (
  select segment_id, side, field, 'missing_field' as code, line from read where state='missing'
  union all select segment_id, 'counterparty', 'name', 'missing_field', null from d where shown='' and k9<>5
  union all select segment_id, 'counterparty', 'name', 'invalid_text', 1 from d where k9=4
  union all select segment_id, 'counterparty', 'name', 'conflicting_field', 1 from d where k9=5 and shown<>''
  union all select segment_id, 'counterparty', 'account', 'incomplete_account', 2 from d where segment_id%5=0)"""


@query("direct_issues", "slips", f"with {_DIRECT_ISSUES} select segment_id, side, field, code, (case when line is not null then 40 end)::double as x0, (14*line)::double as y0, (case when line is not null then 240 end)::double as x1, (14*line+12)::double as y1 from i")
def _(t):
    return parties.explained_direct(_doubtful_lines(t)).issues


@query("direct_status", "slips", f"with {_DIRECT_ISSUES} select segment_id, cast(count(code) as bigint) as issues, case when count(code)>0 then 'needs_review' else 'ok' end as status from slips left join i using (segment_id) group by 1")
def _(t):
    return parties.explained_direct(_doubtful_lines(t)).status


_PLACED = """placed as (select *, case side when 'payer' then 0 else 3 end + case field when 'name' then 1 when 'account' then 2 else 3 end as line,
   concat(case side when 'payer' then '付款人' else '收款人' end, case field when 'name' then '名称' when 'account' then '账号' else '开户行' end) as label,
   case when printed='无' then '' else printed end as value, case when printed='无' then 'blank' when printed='***' then 'ambiguous' else 'present' end as state from truth)"""


@query(
    "party_evidence", "slips",
    f"""with {_TRUTH}, {_PLACED} select segment_id, side, field, cast(1 as bigint) as reading, 'same_line' as method, label, 40::double as label_x0, (20*line)::double as label_y0, 240::double as label_x1, (20*line+12)::double as label_y1,
      printed as raw, value, state, 40::double as x0, (20*line)::double as y0, 240::double as x1, (20*line+12)::double as y1 from placed where printed<>''""")
def _(t):
    return parties.explained_parties(_scoped(t.slip_lines)).evidence


@query(
    "party_evidence_cells", "slips",
    f"""with {_TRUTH}, {_PLACED}, c as (select *, case side when 'payer' then 0 else 300 end as dx, 20*((line-1)%3+1) as y from placed where printed<>'')
    select segment_id, side, field, cast(1 as bigint) as reading, 'same_row' as method, label, (40+dx)::double as label_x0, y::double as label_y0, (110+dx)::double as label_x1, (y+12)::double as label_y1,
      printed as raw, value, state, (120+dx)::double as x0, (y+1)::double as y0, (260+dx)::double as x1, (y+11)::double as y1 from c""")
def _(t):
    return parties.explained_parties(_scoped(t.cell_lines)).evidence


_ISSUES = f"""{_TRUTH}, {_PLACED}, i as (
  select segment_id, cast(null as varchar) as side, cast(null as varchar) as field, 'no_text_in_scope' as code, cast(null as int) as line from slips where segment_id%7=0
  union all select segment_id, null, 'name', 'generic_label_side_unknown', 1 from slips where segment_id%7=1
  union all select segment_id, side, field, case when printed='' then 'label_without_value' when line=1 and segment_id%7=2 then 'conflicting_field_values' else 'field_ambiguous' end, line
    from placed where segment_id%7>1 and case when line=1 and segment_id%7=2 then printed<>'' else printed in ('', '***') end)"""


def _unclear_lines(t):
    """Slips without text, with a label of no side, and with two payer names among the plain ones."""
    k, i = F.col("segment_id"), F.col("line_no")
    text = F.when(k % 7 == 0, " ").when(k % 7 == 1, F.when(i == 1, "户名：x").otherwise("")).otherwise(F.col("text"))
    more = t.slips.select("segment_id", F.lit(7).cast("long").alias("line_no"), F.when(k % 7 == 2, "付款人名称：Else").otherwise("").alias("text"),
                          *[F.lit(v).alias(c) for c, v in zip(_R, (40.0, 140.0, 240.0, 152.0))])
    return _scoped(t.slip_lines.withColumn("text", text).select(more.columns).unionByName(more), height=160.0)


@query("party_issues", "slips", f"with {_ISSUES} select segment_id, side, field, code, (case when line is not null then 40 end)::double as x0, (20*line)::double as y0, (case when line is not null then 240 end)::double as x1, (20*line+12)::double as y1 from i")
def _(t):
    return parties.explained_parties(_unclear_lines(t), t.slips).issues


@query("party_status", "slips", f"with {_ISSUES} select segment_id, cast(count(code) as bigint) as issues, case when count(code)>0 then 'needs_review' else 'ok' end as status from slips left join i using (segment_id) group by 1")
def _(t):
    return parties.explained_parties(_unclear_lines(t), t.slips).status


def _form_lines(t):
    """Three forms in turn: online transfer, small payment, tax voucher."""
    n = F.col("segment_id") % 3
    k = F.col("k")
    online = [
        F.lit("客户回单 网上支付跨行清算业务"), F.concat(F.lit("借贷标志："), F.when(F.col("own_role") == "payer", "借").otherwise("贷")),
        F.concat(F.lit("名称："), "own_name", F.lit(" 账号：0000000001")),
        F.concat(F.lit("交易对方名称："), "cp_name", F.lit(" 交易对方银行行号：77")), F.concat(F.lit("交易对方账号："), "cp_account"),
        F.lit("交易对方银行名称："), F.lit("业务类型：x"),
    ]
    small = [
        F.lit("客户回单小额支付系统业务"), F.lit("交易种类：普通贷记"), F.concat(F.lit("发起人名称："), "own_name"), F.lit("发起人账号：0000000001"),
        F.concat(F.lit("接收人名称："), "cp_name"), F.concat(F.lit("接收人账号："), "cp_account"), F.lit("发起行名称：Bank A"),
    ]
    tax = [
        F.lit("电子缴税付款凭证"), F.concat(F.lit("付款人全称："), "own_name"), F.lit("付款人账号：0000000001"), F.lit("付款人开户银行：Bank A"),
        F.concat(F.lit("征收机关名称："), "cp_name"), F.lit("收款国库（银行）名称：Bank T"), F.lit("名称：ignored"),
    ]
    pick = lambda rows: F.element_at(F.array(*rows), k)
    text = F.when(n == 0, pick(online)).when(n == 1, pick(small)).otherwise(pick(tax))
    s = t.slips.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(7))))
    return _scoped(
        s.select(
            "segment_id", k.cast("long").alias("line_no"), text.alias("text"), F.lit(40.0).alias("x0"), ((k - 1) * 16 + 4).cast("double").alias("y0"),
            F.lit(340.0).alias("x1"), ((k - 1) * 16 + 16).cast("double").alias("y1"),
        )
    )


@query(
    "form_rules",
    "slips",
    """with g as (select *, case segment_id%3 when 0 then own_role else 'payer' end as mine, segment_id%3 as form from slips cross join (values ('payer'),('payee')) s(side) cross join (values ('name'),('account'),('bank')) f(field)),
    r as (select segment_id, side, field, case
       when field='name' then case when side=mine then own_name else cp_name end
       when field='account' then case when side=mine then '0000000001' when form=2 then '' else cp_account end
       when form=0 then '' when form=1 then case when side=mine then 'Bank A' else '' end else case when side=mine then 'Bank A' else 'Bank T' end end as raw from g)
    select segment_id, side, field, raw, raw as value, case when raw='' then 'missing' else 'present' end as state from r""",
)
def _(t):
    return parties.extract_parties(_form_lines(t))


@query(
    "layout_signature",
    "slips",
    """select segment_id, kind, round(40/600.0::double, 4) as rx0, round((20*k)/140.0::double, 4) as ry0, cast('true' as boolean) as reliable, cast(1 as bigint) as signatures from slips
    cross join (values (1,'payer.name'),(2,'payer.account'),(3,'payer.bank'),(4,'payee.name'),(5,'payee.account'),(6,'payee.bank')) v(k, kind)""",
)
def _(t):
    lines = _scoped(t.slip_lines)
    sig = parties.layout_signature(lb.match_labels(lines), lines.select("segment_id", *[F.col("s" + c).alias(c) for c in ("x0", "y0", "x1", "y1")]).distinct())
    n = sig.agg(F.count_distinct("signature").alias("n")).scalar()
    return sig.select("segment_id", "kind", "rx0", "ry0", "reliable", n.alias("signatures"))


@query(
    "combine_observed",
    "slips",
    """with o as (select segment_id, case when segment_id%4=0 then 'missing' when segment_id%4=1 then 'blank' else 'present' end as ns, case when segment_id%4=2 then cp_name when segment_id%4=3 then 'Else' else '' end as nv from slips),
    c as (select segment_id, case when cp_state='present' then cp_name else '' end as v, cp_state as s, ns, nv from slips join o using (segment_id)),
    a as (select *, case when segment_id%10=0 or ns='missing' then 'keep' when s='missing' then 'fill' when s=ns and v=nv then 'keep' else 'conflict' end as act from c)
    select segment_id, 'name' as field, case act when 'fill' then nv when 'conflict' then concat(v, ' | ', nv) else v end as value, case act when 'fill' then ns when 'conflict' then 'ambiguous' else s end as state from a""",
)
def _(t):
    k = F.col("segment_id") % 4
    v = F.when(F.col("cp_state") == "present", F.col("cp_name")).otherwise("")
    cur = t.slips.select("segment_id", F.lit("name").alias("field"), v.alias("raw"), v.alias("value"), F.col("cp_state").alias("state"))
    nv = F.when(k == 2, F.col("cp_name")).when(k == 3, "Else").otherwise("")
    obs = t.slips.select("segment_id", F.lit("name").alias("field"), nv.alias("raw"), nv.alias("value"), F.when(k == 0, "missing").when(k == 1, "blank").otherwise("present").alias("state"))
    keep = t.slips.filter("segment_id % 10 = 0").select("segment_id", F.lit("name").alias("field"))
    return fd.combine_observed(cur, obs, keep).select("segment_id", "field", "value", "state")


@query(
    "account_and_field_state",
    "slips",
    """with a as (select segment_id, case segment_id%6 when 0 then '' when 1 then concat('6222*', cp_account) when 2 then '尾号 1234' when 3 then 'abc' when 4 then '无' else cp_account end as v from slips)
    select segment_id, case segment_id%6 when 0 then 'blank' when 1 then 'ambiguous' when 2 then 'ambiguous' when 3 then 'ambiguous' when 4 then 'ambiguous' else 'present' end as account_state,
      case segment_id%6 when 0 then 'missing' when 4 then 'blank' when 5 then 'present' else 'ambiguous' end as candidate_state,
      case segment_id%6 when 0 then 'missing' when 4 then 'blank' else 'present' end as name_state, segment_id%6=5 or segment_id%6=3 and false as full_account from a""",
)
def _(t):
    k = F.col("segment_id") % 6
    v = F.when(k == 0, "").when(k == 1, F.concat(F.lit("6222*"), "cp_account")).when(k == 2, "尾号 1234").when(k == 3, "abc").when(k == 4, "无").otherwise(F.col("cp_account"))
    return t.slips.select(
        "segment_id", tx.account_state(v).alias("account_state"), tx.field_state(F.lit("account"), v).alias("candidate_state"),
        tx.field_state(F.lit("name"), v).alias("name_state"), tx.full_account(v).alias("full_account"),
    )


@query(
    "marker_lines",
    "",
    """select o_orderkey, o_orderkey%4=0 as marker_line, o_orderkey%4=1 as marker_label, o_orderkey%4=2 as marker_value from orders""",
)
def _(t):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, "打印 次数：3").when(k == 1, "打印次数:").when(k == 2, " 12 ").otherwise("备注：打印次数：0")
    return t.orders.select(
        "o_orderkey", tx.is_marker_line(text).alias("marker_line"), tx.is_marker_label(text).alias("marker_label"), tx.is_marker_value(text).alias("marker_value")
    )
