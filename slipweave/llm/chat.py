"""Chat formatting: incremental black-box rendering.

A template is any function from a list of turns to text; nothing of it is parsed. Successive turn prefixes are
rendered and consecutive outputs compared: what a turn adds behind its forerunner's output is its span, and an
earlier output that is no longer a prefix shows a template that rewrites history. Where in its span a turn's text lies is asked of the
template too: two renderings with different one-character texts agree exactly up to the text and from its end.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipweave.llm.shared import pick

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

# The marks of the instruction format.
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
_MARK = re.compile("|".join(map(re.escape, MARKS)))
_TURN = re.compile(
    r"<<SYS>> (?P<system>.*?) <</SYS>>\n|<s>\[INST\] (?P<user>.*?) \[/INST\]"
    r"|<s>\[ROLE\] (?P<role>.*?) \[/ROLE\] (?P<other>.*?) </s>| (?P<assistant>.*?) </s>",
    re.DOTALL,
)


def escape(text: str) -> str:
    r"""Double every backslash, then break every mark by ``\:`` behind its first character."""
    return _MARK.sub(lambda m: f"{m[0][0]}\\:{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\([\\:])", lambda m: m[1].replace(":", ""), text)


@lru_cache(maxsize=4096)
def _turn(role: str, text: str) -> str:
    t = escape(text)
    if role == "system":
        return f"<<SYS>> {t} <</SYS>>\n"
    if role == "user":
        return f"<s>[INST] {t} [/INST]"
    if role == "assistant":
        return f" {t} </s>"
    return f"<s>[ROLE] {escape(role)} [/ROLE] {t} </s>"


def instruction_template(turns: list[Turn]) -> str:
    """System, user and assistant turns in their own marks, any other role by name."""
    return "".join([_turn(*t) for t in turns])


def read_back(formatted: str) -> list[Turn]:
    """The turns of an output of :func:`instruction_template`; inside texts no mark is left to mislead it."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        at = m.end()
        if m["role"] is not None:
            turns.append((unescape(m["role"]), unescape(m["other"])))
        else:
            turns.append((m.lastgroup, unescape(m[m.lastgroup])))
    return turns


def locate(turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int, int, int]], int | None]:
    """The whole output, ``(start, end, text_start, text_end)`` of each turn, and the first turn that rewrites history.

    After such a turn earlier offsets mean nothing, so the spans are then empty.
    """
    before, spans = "", []
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        if not now.startswith(before):
            return template(turns), [], k - 1
        role = turns[k - 1][0]
        one, two = (template([*turns[: k - 1], (role, probe)]) for probe in "xy")
        # What all outputs share from before need not be compared sign by sign.
        known = len(before) if one.startswith(before) and two.startswith(before) else 0
        head = known + len(commonprefix([one[known:], two[known:]]))
        tail = len(commonprefix([one[head:][::-1], two[head:][::-1]]))
        spans.append((len(before), len(now), head, len(now) - tail))
        before = now
    return before, spans, None


def formatted(conversations: DataFrame, template: Template = instruction_template, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id, formatted, spans, loss, rewritten_at`` per conversation.

    ``spans`` has role and offsets (code points) of each turn and its text, ``loss`` the offsets of the texts of
    the ``learned`` roles, ``rewritten_at`` the number of the first turn that changes earlier output (null: none;
    otherwise both lists are empty). Turns are ordered by turn, role and text; repeated rows are repeated turns; a null text or role is empty and
    rows of a null conversation form one. An empty table gives an empty one. One conversation is one value, so it
    is gathered in one row; prefixes cost the square of its turns.
    """
    span = pa.struct([("role", pa.string()), *((c, pa.int64()) for c in ("start", "end", "text_start", "text_end"))])
    pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans, loss, broken = [], [], [], []
            for rows in b.column(1):
                turns = [(r["role"], r["text"]) for r in rows.as_py()]
                text, found, at = locate(turns, template)
                texts.append(text)
                spans.append([{"role": t[0], "start": a, "end": z, "text_start": c, "text_end": d} for t, (a, z, c, d) in zip(turns, found)])
                loss.append([{"start": c, "end": d} for t, (_, _, c, d) in zip(turns, found) if t[0] in learned])
                broken.append(at)
            yield pa.record_batch(
                [b.column(0), pa.array(texts, pa.string()), pa.array(spans, pa.list_(span)), pa.array(loss, pa.list_(pair)), pa.array(broken, pa.int64())],
                ["conv_id", "formatted", "spans", "loss", "rewritten_at"],
            )

    rows = pick(conversations, "conv_id", "turn", "role", "text")
    turns = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    place = "start:bigint,end:bigint"
    return turns.mapInArrow(
        run,
        f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, formatted string, "
        f"spans array<struct<role:string,{place},text_start:bigint,text_end:bigint>>, loss array<struct<{place}>>, rewritten_at bigint")


def digests(rows: DataFrame) -> DataFrame:
    """Digest columns read back from outputs of :func:`formatted` with the instruction template."""
    turns_of = F.udf(read_back, "array<struct<role:string,text:string>>", useArrow=True)
    plain = F.udf(unescape, "string", useArrow=True)
    read = rows.withColumns({
        "turns": turns_of("formatted"),
        # Lengths and offsets count code points, as substring does.
        "learned": plain(F.array_join(F.transform("loss", lambda s: F.substring("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), "")),
    })
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "rewritten_at",
    )
