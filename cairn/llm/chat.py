"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string.  The first i turns are rendered for every i; the i-th output less
the (i-1)-th gives the i-th turn's span.  Output i - 1 is a head that output i begins with and a foot that it ends with where the
template only inserts the new turn; otherwise the template rewrites history: spans found so far don't hold in the final string, and the
turn where that happened is reported.  The spans of the other turns are then still those of the final string if they lie in what
all later outputs share; the rest is null.

Defined results: turns are in order of `turn`, then role, then text, with nulls first.  Null roles and texts are rendered as empty strings, but reported as they are;
rows without conv_id form a conversation of their own.  Repeated rows are repeated turns.  Empty turns have the span that the template gives
them.  A turn that a template drops has an empty span where it would stand.  A template may raise: a prefix that it refuses is left out, its turn has no span
and is in failed_at, and the span of the next turn that renders holds both; where it refuses the whole conversation, text is null and error says why; the
job goes on.  An id that isn't a number keeps its type.  Other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_of, tuned

Turns = Sequence[tuple[str, str]]
RESULT = "struct<text:string,spans:array<struct<turn:bigint,role:string,start:bigint,end:bigint>>,rewrites:boolean,rewritten_at:array<bigint>,failed_at:array<bigint>,error:string>"


def chatml(turns: Turns) -> str:
    return "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in turns)


def bracketed(turns: Turns) -> str:
    """User turns in [INST], the system prompt in the first of them, a sentence end after every answer."""
    out, system = "<s>", ""
    for role, text in turns:
        if role == "system":
            system = f"<<SYS>>\n{text}\n<</SYS>>\n\n"
        elif role == "user":
            out += f"[INST] {system}{text} [/INST]"
            system = ""
        else:
            out += f" {text} </s><s>"
    return out


def last_answer_only(turns: Turns) -> str:
    """Keeps of earlier answers only the last line, as templates that strip reasoning do: it rewrites history."""
    answers = [i for i, (role, _) in enumerate(turns) if role == "assistant"]
    return "".join(f"<{role}>{text if i not in answers[:-1] else text.rsplit(chr(10), 1)[-1]}</{role}>" for i, (role, text) in enumerate(turns)) + "<end>"


TEMPLATES: dict[str, Callable[[Turns], str]] = {"chatml": chatml, "bracketed": bracketed, "last_answer_only": last_answer_only}


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        at = (lo + hi) // 2
        if a[lo:at] == b[lo:at]:
            lo = at
        else:
            hi = at
    return lo


def common_suffix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return common_prefix(a[len(a) - n :][::-1], b[len(b) - n :][::-1])


def render(turns: Turns, template: Callable[[Turns], str]) -> tuple[str, list[tuple[int, int] | None], list[int]]:
    """The final string, each turn's span in it and the turns whose addition rewrote what stood before; the template's errors go through."""
    text, spans, rewritten, _, error = attempt(turns, template)
    if error is not None:
        raise error
    return text, spans, rewritten  # type: ignore[return-value]


def attempt(turns: Turns, template: Callable[[Turns], str]) -> tuple[str | None, list[tuple[int, int] | None], list[int], list[int], Exception | None]:
    """As render(), with the turns whose prefixes the template refused, and its error if it refused the whole."""
    try:
        final = template(turns)
    except Exception as e:  # noqa: BLE001  a template is anyone's code
        return None, [None] * len(turns), [], list(range(len(turns))), e
    outputs: list[str | None] = []
    for i in range(len(turns)):
        try:
            outputs.append(template(turns[:i]))
        except Exception:  # noqa: BLE001
            outputs.append(None)
    outputs.append(final)
    before = outputs[0] or ""
    end = min((common_suffix(x, final) for x in outputs[:2] if x is not None), default=0)  # a foot that the template ends every output with
    spans: list[tuple[int, int] | None] = []
    rewritten, failed = [], []
    for i in range(len(turns)):
        now = outputs[i + 1]
        if now is None:
            failed.append(i)
            spans.append(None)
            continue
        head = common_prefix(before, now)
        foot = common_suffix(before[head:], now[head:])
        if head + foot < len(before):
            rewritten.append(i)
        elif len(now) > len(before):  # an insertion; where several places give the same string, the one before the foot
            shift = max(0, min(head, min(end, len(before)) - foot))
            if shift and before[head - shift : head] == now[len(now) - foot - shift : len(now) - foot]:
                head, foot = head - shift, foot + shift
        # what stood before `head` stays; what stood in the foot moves to the end; the rest of the old output is gone
        moved = len(now) - len(before)
        for j, s in enumerate(spans):
            if s and s[1] > head:
                spans[j] = (s[0] + moved, s[1] + moved) if s[0] >= len(before) - foot and s[1] > s[0] else None
        spans.append((head, len(now) - foot))
        before = now
    return final, spans, rewritten, failed, None


def rendered(template: Callable[[Turns], str]):  # noqa: ANN201
    of = pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))), ("rewrites", pa.bool_()), ("rewritten_at", pa.list_(pa.int64())), ("failed_at", pa.list_(pa.int64())), ("error", pa.string())])

    def one(conversations: pa.Array) -> pa.Array:
        out = []
        for c in conversations:
            rows = c.as_py() or []
            turns = [(r["role"] or "", r["text"] or "") for r in rows]
            text, spans, rewritten, failed, error = attempt(turns, template)
            out.append({"text": text, "spans": [{"turn": r["turn"], "role": r["role"], "start": s[0] if s else None, "end": s[1] if s else None} for r, s in zip(rows, spans, strict=True)], "rewrites": bool(rewritten), "rewritten_at": [rows[i]["turn"] for i in rewritten], "failed_at": [rows[i]["turn"] for i in failed], "error": None if error is None else f"{type(error).__name__}: {error}"})
        return pa.array(out, of)

    return F.arrow_udf(one, RESULT)


def formatted(conversations: DataFrame, template: Callable[[Turns], str] = chatml) -> DataFrame:
    """A row for each conversation: conv_id, text, spans, rewrites, rewritten_at, failed_at, error."""
    tuned(conversations.sparkSession)
    c = conversations
    turn = F.struct(c["turn"].cast("long").alias("turn"), c["role"].cast("string").alias("role"), c["text"].cast("string").alias("text"))
    grouped = c.groupBy(id_of(c, "conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select("conv_id", rendered(template)("turns").alias("r")).select("conv_id", "r.*")


def turns(conversations: DataFrame, template: Callable[[Turns], str] = chatml) -> DataFrame:
    """A row for each turn: conv_id, place from 0, turn, role, start, end, rewrites, error; text, the whole string, in the first of them."""
    own = formatted(conversations, template)
    every = own.select("conv_id", "text", "rewrites", "error", F.posexplode("spans").alias("place", "s"))
    return every.select("conv_id", F.col("place").cast("long").alias("place"), "s.*", "rewrites", "error", F.when(F.col("place") == 0, F.col("text")).alias("text"))
