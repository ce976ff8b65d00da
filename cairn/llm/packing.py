"""Order-preserving packing by dynamic programming.

Documents in order of doc_id are one sequence of sentences, each document followed by an end token.  The sequence is cut into windows
of at most `capacity` tokens.  A cut costs the padding of the window that it ends, plus a penalty for the truncation if it stands inside a
document: `split_penalty` between sentences, `break_penalty` inside a sentence, which is possible only where a sentence is longer than a
window.  The least total cost is

    cost[i] = min over j with length[i] - length[j] <= capacity of cost[j] + capacity - (length[i] - length[j]) + penalty[i]

whose minimum over j of cost[j] + length[j] is taken from a monotone queue, so time is linear in the number of sentences.

The sequence is cut beforehand into runs of `docs_per_run` documents, by their rank in order of (doc_id, hash of the text) whatever the ids are, the
last window of each being padded: runs are packed in parallel, and what a run gives doesn't depend on the others.  Ranks come from a sort by ranges
and the ranges' counts, which alone go to the driver.  Tokens are those of a byte-level BPE vocabulary file.  Its pre-tokeniser begins a new piece
at every single space, so counts are looked up word by word and add up to those of the whole text; a text with other white space, or with a sentence that fills a
window, is encoded whole, and each token counts for the sentence that it ends in.

Defined results: null and empty texts have no tokens and are in no window.  Rows without doc_id come last, in runs of their own.  Rows with
equal doc_id are packed each, in order of a hash of the text.  Equal costs take the longest window.  Texts are packed whole; other columns aren't looked at.
"""

from __future__ import annotations

import base64
import re
from collections import deque
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, id_of, id_type, pieces, tuned, utf8

PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
UNITS = "struct<tokens:array<int>,chars:array<int>,kinds:array<int>>"
WINDOWS = "run bigint, window bigint, doc_ids array<bigint>, spans array<struct<doc_id:bigint,start:bigint,end:bigint,tokens:bigint>>, tokens bigint, padding bigint, cut string"
DOCUMENT, SENTENCE, BREAK = 0, 1, 2
CUTS = ("document", "sentence", "break")


@dataclass(frozen=True)
class Params:
    capacity: int = 2048
    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = PATTERN
    split_penalty: int = 96
    break_penalty: int = 512
    docs_per_run: int = 2048
    remembered: int = 400_000  # words whose counts a worker keeps at once


_ENCODINGS: dict[tuple[str, str], tuple[tiktoken.Encoding, dict, dict]] = {}


def encoding(p: Params) -> tuple[tiktoken.Encoding, dict[bytes, int], dict[bytes, int]]:
    """The encoding, and this process's counts of words with and without a space before them."""
    if (key := (p.vocabulary, p.pattern)) not in _ENCODINGS:
        with open(p.vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[key] = tiktoken.Encoding("file", pat_str=p.pattern, mergeable_ranks=ranks, special_tokens={}), {}, {}
    return _ENCODINGS[key]


def _counts(words: list[bytes], known: dict[bytes, int], space: str, e: tiktoken.Encoding, p: Params) -> np.ndarray:
    """Tokens of each word; -2 for one with white space of its own."""
    n = np.fromiter(map(known.get, words, repeat(-1)), np.int32, len(words))
    missing = np.flatnonzero(n == -1)
    if len(missing):
        if len(known) > p.remembered:
            known.clear()
        new = list({words[i] for i in missing.tolist()})
        texts = [w.decode("utf-8", "replace") for w in new]
        known.update((w, -2 if t.split() != [t] else len(e.encode_ordinary(space + t))) for w, t in zip(new, texts, strict=True))
        n[missing] = [known[words[i]] for i in missing.tolist()]
    return n


_END = re.compile(r"[.!?]+(?=\s)|\n+")
_CONTROL = (np.arange(256) < 32) & (np.arange(256) != 10)
_STOP = np.isin(np.arange(256), list(b".!?"))


def token_ends(text: str, e: tiktoken.Encoding) -> np.ndarray:
    """Where each token of the text ends, in characters; one that ends inside a character ends before it.

    Long texts are encoded in blocks, cut where white space follows something else, as no piece of the pre-tokeniser goes across.
    """
    known = _LENGTHS.get(id(e))
    if known is None:
        known = np.zeros(e.n_vocab, np.int64)
        for x in e.token_byte_values():
            known[e.encode_single_token(x)] = len(x)
        _LENGTHS[id(e)] = known
    out, at, chars = [], 0, 0
    while at < len(text):
        end = len(text)
        if end - at > _BLOCK and (cut := _EDGE.search(text, at + _BLOCK)):
            end = cut.start() + 1
        raw = np.frombuffer(text[at:end].encode("utf-8", "replace"), np.uint8)
        ends = np.cumsum(known[np.array(e.encode_ordinary(text[at:end]), np.int64)])
        begins = np.append((raw & 0xC0) != 0x80, True)
        seen = np.append(0, np.cumsum(begins[:-1]))
        out.append(seen[ends] - ~begins[ends] + chars)
        at, chars = end, end
    return np.concatenate(out) if out else np.zeros(0, np.int64)


_LENGTHS: dict[int, np.ndarray] = {}
_BLOCK = 1 << 18
_EDGE = re.compile(r"\S(?=\s)")


def slow_units(text: str, e: tiktoken.Encoding, p: Params) -> tuple[list[int], list[int], list[int]]:
    """Tokens, characters and kinds of the units of a text, encoded whole; without the end token.  A sentence of a window's size is cut after every capacity // 8 tokens."""
    ends = token_ends(text, e)
    tokens, chars, kinds = [], [], []
    at = first = 0
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        if end == at:
            continue
        last = int(np.searchsorted(ends, end, "right")) if end < len(text) else len(ends)
        n = last - first
        if n < p.capacity:
            tokens.append(n)
            chars.append(end - at)
            kinds.append(SENTENCE)
        else:
            step = max(1, p.capacity // 8)
            for k in range(first, last, step):
                stop = int(ends[k + step - 1]) if k + step < last else end
                tokens.append(min(step, last - k))
                chars.append(stop - at)
                kinds.append(BREAK if k + step < last else SENTENCE)
                at = stop
        at, first = end, last
    return tokens, chars, kinds


def units_of(texts: list[bytes], p: Params) -> list[tuple[list[int], list[int], list[int]]]:
    """Units of texts, none empty; the last unit of each has the end token."""
    e, after_space, at_start = encoding(p)
    joined = b"\n".join(texts)
    raw = np.frombuffer(joined, np.uint8)
    size = np.array([len(t) for t in texts])
    start = np.cumsum(size + 1) - size - 1
    separator = (raw == 32) | (raw == 10)
    odd = _CONTROL[raw]
    odd[1:] |= separator[1:] & separator[:-1]
    odd[start] |= separator[start]
    odd[start + size - 1] |= separator[start + size - 1]
    slow = np.add.reduceat(odd, start) > 0
    ends = np.append(np.flatnonzero(separator), len(raw))
    words = joined.replace(b"\n", b" ").split(b" ")
    doc = np.searchsorted(start, ends, "right") - 1  # a word's, by its end; at a text's end stands the separator or the very end
    line_end = np.append(raw[ends[:-1]] == 10, True)
    line_start = np.append(True, line_end[:-1])
    n = _counts(words, after_space, " ", e, p)
    firsts = np.flatnonzero(line_start)
    n[firsts] = _counts([words[i] for i in firsts.tolist()], at_start, "", e, p)
    slow[doc[n == -2]] = True
    text_end = np.zeros(len(ends), bool)
    text_end[np.searchsorted(ends, start + size)] = True
    n = n + (line_end & ~text_end)  # the line break is a token
    closes = line_end | _STOP[raw[np.maximum(ends - 1, 0)]]
    last = np.flatnonzero(closes)
    first = np.append(0, last[:-1] + 1)
    tokens = np.add.reduceat(n, first)
    seen = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    # a line break belongs to the sentence before it, a space to the one after it; the separator between two texts to none
    stop = ends[last] + (line_end[last] & ~text_end[last])
    chars = np.diff(seen[stop], prepend=0)
    opens = np.append(False, text_end[last[:-1]])
    chars[opens] -= 1
    of = doc[last]
    cut = np.searchsorted(of, np.arange(len(texts) + 1))
    too_long = np.zeros(len(texts), bool)
    too_long[of[tokens >= p.capacity]] = True
    out = []
    for i, t in enumerate(texts):
        if slow[i] or too_long[i]:
            own = slow_units(t.decode("utf-8", "replace"), e, p)
        else:
            a, b = int(cut[i]), int(cut[i + 1])
            own = tokens[a:b].tolist(), chars[a:b].tolist(), [SENTENCE] * (b - a)
        own[0][-1] += 1
        own[2][-1] = DOCUMENT
        out.append(own)
    return out


def units(p: Params):  # noqa: ANN201
    of = pa.struct([("tokens", pa.list_(pa.int32())), ("chars", pa.list_(pa.int32())), ("kinds", pa.list_(pa.int32()))])

    def one(text: pa.Array) -> pa.Array:
        empty = {"tokens": [], "chars": [], "kinds": []}
        out = [empty] * len(text)
        data, offsets = utf8(text)
        for a, b in pieces(offsets):
            some = [i for i in range(a, b) if offsets[i + 1] > offsets[i]]
            if some:
                for i, (n, c, k) in zip(some, units_of([data[offsets[i] : offsets[i + 1]].tobytes() for i in some], p), strict=True):
                    out[i] = {"tokens": n, "chars": c, "kinds": k}
        return pa.array(out, of)

    return F.arrow_udf(one, UNITS)


def cuts(tokens: list[int], kinds: list[int], p: Params) -> list[int]:
    """The ends of the windows, in units, of least total cost."""
    penalty = (0, p.split_penalty, p.break_penalty)
    capacity = p.capacity
    length, costs, back = [0], [0], [0]
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # cost + length, ascending; length; unit
    total = 0
    for i, (n, kind) in enumerate(zip(tokens, kinds, strict=True), 1):
        total += n
        least = total - capacity
        while queue[0][1] < least:
            queue.popleft()
        best = queue[0]
        cost = best[0] + capacity - total + penalty[kind]
        length.append(total)
        costs.append(cost)
        back.append(best[2])
        key = cost + total
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, total, i))
    out = []
    at = len(tokens)
    while at:
        out.append(at)
        at = back[at]
    return out[::-1]


def pack_run(run: int | None, docs: list[tuple[int | None, list[int], list[int], list[int]]], p: Params) -> list[tuple]:
    """Rows of WINDOWS for documents in order."""
    tokens, kinds, chars, owner = [], [], [], []
    for k, (_, n, c, kind) in enumerate(docs):
        tokens += n
        chars += c
        kinds += kind
        owner += [k] * len(n)
    out = []
    at = 0
    place = 0  # in the text of the document that holds the unit
    for w, end in enumerate(cuts(tokens, kinds, p)):
        spans, total = [], 0
        while at < end:
            k, start, n = owner[at], place, 0
            while at < end and owner[at] == k:
                n += tokens[at]
                place += chars[at]
                at += 1
            spans.append({"doc_id": docs[k][0], "start": start, "end": place, "tokens": n})
            total += n
            if at == len(owner) or owner[at] != k:
                place = 0
        out.append((run, w, [s["doc_id"] for s in spans], spans, total, p.capacity - total, CUTS[kinds[end - 1]]))
    return out


def _whole(x: object) -> int | None:
    return None if pd.isna(x) else int(x)


def in_runs(counted: DataFrame, p: Params, tables: Written) -> DataFrame:
    """counted (doc_id, h, at, …) with its run: docs_per_run rows each in order of (doc_id, h), those without doc_id last and in runs of their own."""
    spark = counted.sparkSession
    named = counted.withColumn("without", F.col("doc_id").isNull())
    # `at` tells equal rows apart, so that ranges can part them
    ordered = named.repartitionByRange("without", "doc_id", "h", "at").sortWithinPartitions("without", "doc_id", "h", "at")
    # the id holds the partition and, in its lower 33 bits, the row's place
    placed = tables.write(ordered.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33)), "placed")
    counts = {(r["without"], r["part"]): r["n"] for r in placed.groupBy("without", "part").agg(F.count("*").alias("n")).collect()}  # as many as ranges
    starts, total = [], {False: 0, True: 0}
    for without, part in sorted(counts):
        here = counts.get((False, part), 0) if without else 0  # those with doc_id stand before those without
        starts.append((without, part, total[without] - here))
        total[without] += counts[without, part]
    # from Arrow, as rows would be read by Python workers of another kind, which stay beside those of the functions
    columns = zip(*starts, strict=True) if starts else ([], [], [])
    known = spark.createDataFrame(pa.table([pa.array(x, kind) for x, kind in zip(columns, (pa.bool_(), pa.int64(), pa.int64()), strict=True)], ["without", "part", "start"]))
    before = -(-total[False] // p.docs_per_run)  # runs of rows with doc_id
    rank = F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    run = F.floor(rank / p.docs_per_run) + F.when(F.col("without"), F.lit(before)).otherwise(0)
    return placed.join(F.broadcast(known), ["without", "part"]).select(run.cast("long").alias("run"), "doc_id", "h", "tokens", "chars", "kinds")


def packed(docs: DataFrame, p: Params = Params(), text: str = "text") -> DataFrame:
    """A row for each window: run, window, doc_ids, spans (doc_id, first and end character, tokens), tokens, padding, kind of cut."""
    tables = Written(tuned(docs.sparkSession))
    kind = id_type(docs).simpleString()
    own = docs.select(id_of(docs), docs[text].cast("string").alias("t")).where(F.length("t") > 0)
    # counted once; the sort reads its input twice, to find the ranges
    counted = tables.write(own.select("doc_id", F.xxhash64("t").alias("h"), F.monotonically_increasing_id().alias("at"), units(p)("t").alias("u")).select("doc_id", "h", "at", "u.*"), "counted")
    names = [x.split()[0] for x in ("run", "window", "doc_ids", "spans", "tokens", "padding", "cut")]
    whole = kind == "bigint"

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "h"], na_position="last")
        runs = [(_whole(i) if whole else i, list(n), list(c), list(k)) for i, n, c, k in zip(rows["doc_id"], rows["tokens"], rows["chars"], rows["kinds"], strict=True)]
        return pd.DataFrame(pack_run(_whole(key[0]), runs, p), columns=names)

    return in_runs(counted, p, tables).groupBy("run").applyInPandas(one, WINDOWS.replace("doc_ids array<bigint>", f"doc_ids array<{kind}>").replace("doc_id:bigint", f"doc_id:{kind}"))
