"""Benchmark decontamination: BM25 over an inverted index of the test items, searched by block-max WAND.

The items are the indexed side and every passage of every document is a query.  Items are indexed by classes of length, each twice as long as the one
before, so that long items change nothing for short ones.  A passage is two half-windows of as many words as the longest item of a class
has, and the next begins one half-window later, so any stretch that an item could fill lies whole in a passage.  A term's
impact on an item is its BM25 weight divided by the sum over the item's own terms: the score is the share of the item's weight that
the passage has, and all items that reach `threshold` are retrieved.

Items stand in blocks; for every term and block the greatest impact is kept.  A passage is given up where its terms' greatest impacts don't
reach the threshold together, a block where its terms' greatest impacts in the block don't, and what is left is searched with WAND
pivots over the posting lists.  None of the bounds loses an item.  What is retrieved is then verified: the share of the question's
n-grams of words, and of the answer's, that stand together in one stretch of the passage, of `spread` times the item's own words and `loose` more.  The answer
is an item's last line, else its last sentence; an item of one sentence has none.

Defined results: null or wordless texts and items match nothing.  Words are compared without ASCII case and punctuation.  Equal items are all
reported.  A document that holds an item several times has one row for it, of the best passage, on ties the first.  Rows with the same
doc_id are documents each.  An empty benchmark has no leaks.  Texts are searched whole; other columns aren't looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_of, pieces, rows_of, tuned, utf8

LEAKS = "array<struct<item_id:bigint,passage:bigint,score:double,question_overlap:double,answer_overlap:double>>"
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Params:
    threshold: float = 0.5  # of an item's own score
    k1: float = 1.2
    b: float = 0.75
    n: int = 3  # words in the verified n-grams
    overlap: float = 0.6  # of question and answer
    question_alone: float = 0.9  # enough without the answer
    least_words: int = 32  # of a half-window; items of up to twice as many words are the first class
    spread: float = 1.5  # words of a verified stretch, of the item's
    loose: int = 8
    blocks: int = 128  # the items' blocks, at most
    items_per_index: int = 50_000  # larger benchmarks are searched in several indexes, one after the other
    most_bytes: int = 1 << 30  # of the items' text, which the driver holds and every worker gets; more is an error


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def split_item(text: str) -> tuple[str, str | None]:
    """(question, answer)."""
    lines = [x for x in text.split("\n") if tokens(x.encode())]
    if len(lines) > 1:
        return "\n".join(lines[:-1]), lines[-1]
    sentences = [x for x in re.split(r"(?<=[.!?])\s+", text) if tokens(x.encode())]
    return (" ".join(sentences[:-1]), sentences[-1]) if len(sentences) > 1 else (text, None)


def grams(ids: list[int], n: int) -> list[tuple[int, ...]]:
    n = min(n, len(ids))
    return [tuple(ids[i : i + n]) for i in range(len(ids) - n + 1)] if n else []


@dataclass
class Index:
    ids: list[int | None]
    terms: dict[bytes, int]
    postings: list[tuple[list[int], list[float]]]  # by term: items ascending, impacts
    best: np.ndarray  # by term
    block_best: np.ndarray  # (terms, blocks)
    block: int  # items in a block
    half: int  # words of a half-window
    questions: list[list[int]]
    answers: list[list[int] | None]
    sizes: list[int]  # words of the items


def indexes(items: list[tuple[int | None, str | None]], p: Params = Params()) -> list[Index]:
    """An index of each class of length, several of a large class.  Document frequencies and mean length are those of all items."""
    items = sorted(((i, t) for i, t in items if t and tokens(t.encode())), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    words = [tokens(t.encode()) for _, t in items]
    df = Counter(w for own in words for w in set(own))
    mean = sum(map(len, words)) / max(1, len(words))
    classes: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        classes.setdefault(max(0, (-(-len(w) // (2 * p.least_words)) - 1).bit_length()), []).append(i)
    out = []
    for _, members in sorted(classes.items()):
        half = max(p.least_words, *(len(words[i]) for i in members)) if members else p.least_words
        for at in range(0, len(members), p.items_per_index):
            own = members[at : at + p.items_per_index]
            out.append(_index([items[i] for i in own], [words[i] for i in own], df, len(items), mean, half, p))
    return out


def _index(some: list[tuple], own: list[list[bytes]], df: Counter, every: int, mean: float, half: int, p: Params) -> Index:
    terms: dict[bytes, int] = {}
    lists: list[tuple[list[int], list[float]]] = []
    for i, w in enumerate(own):
        weight = {t: np.log(1 + (every - df[t] + 0.5) / (df[t] + 0.5)) * n * (p.k1 + 1) / (n + p.k1 * (1 - p.b + p.b * len(w) / mean)) for t, n in Counter(w).items()}
        total = sum(weight.values())
        for t, x in weight.items():
            if (k := terms.setdefault(t, len(terms))) == len(lists):
                lists.append(([], []))
            lists[k][0].append(i)
            lists[k][1].append(x / total)
    block = max(2, -(-len(some) // p.blocks))
    block_best = np.zeros((len(terms), -(-len(some) // block)), np.float32)
    for k, (docs, impacts) in enumerate(lists):
        np.maximum.at(block_best[k], np.array(docs) // block, np.array(impacts))
    number = [tuple([terms[x] for x in tokens(part.encode())] if part is not None else None for part in split_item(t)) for _, t in some]
    block_best = np.nextafter(block_best, np.float32(2))  # bounds stay bounds in single precision
    return Index([i for i, _ in some], terms, lists, block_best.max(1), block_best, block, half, [q for q, _ in number], [a for _, a in number], [len(w) for w in own])


def together(words: list[int], question: list[int], answer: list[int] | None, size: int, p: Params) -> tuple[float, float | None] | None:
    """(question's, answer's) overlap in the stretch of `size` words where they are enough, the best such stretch; None if there is none."""
    weight: list[dict[tuple[int, ...], float]] = []
    for side in (question, answer):
        g = grams(side, p.n) if side else []
        weight.append({x: n / len(g) for x, n in Counter(g).items()})
    lengths = [min(p.n, len(question)), min(p.n, len(answer)) if answer else 0]
    hits = []  # (end, start, side, gram)
    for side in (0, 1):
        n, own = lengths[side], weight[side]
        hits += [(i + n, i, side, g) for i in range(len(words) - n + 1) if (g := tuple(words[i : i + n])) in own] if n else []
    hits.sort(key=lambda x: x[:3])
    best: tuple[float, float | None] | None = None
    inside: list[Counter] = [Counter(), Counter()]
    share = [0.0, 0.0]
    low = 0
    queue = sorted(hits, key=lambda x: (x[1], x[0], x[2]))  # by start, as they leave
    for end, _, side, g in hits:
        inside[side][g] += 1
        if inside[side][g] == 1:
            share[side] += weight[side][g]
        while queue[low][1] < end - size:
            _, _, s, x = queue[low]
            inside[s][x] -= 1
            if not inside[s][x]:
                share[s] -= weight[s][x]
            low += 1
        q, a = min(1.0, share[0] + 1e-12), min(1.0, share[1] + 1e-12) if answer else None
        if (q >= p.overlap and (a is None or a >= p.overlap)) or q >= p.question_alone:
            best = max(best, (q, a), key=lambda x: (x[0], -1.0 if x[1] is None else x[1])) if best else (q, a)
    return best


def wand(ix: Index, query: list[int], threshold: float) -> list[tuple[int, float]]:
    """(item, score) of all items that reach the threshold for the terms of query, by block-max WAND."""
    out = []
    lists = [ix.postings[t] for t in query]
    best = [float(ix.best[t]) for t in query]
    at = [0] * len(query)
    size = [len(x[0]) for x in lists]
    live = list(range(len(query)))
    slack = 1e-6
    while True:
        live = [c for c in live if at[c] < size[c]]
        live.sort(key=lambda c: lists[c][0][at[c]])
        bound, pivot = 0.0, -1
        for k, c in enumerate(live):
            bound += best[c]
            if bound >= threshold - slack:
                pivot = k
                break
        if pivot < 0:
            return out
        item = lists[live[pivot]][0][at[live[pivot]]]
        while pivot + 1 < len(live) and lists[live[pivot + 1]][0][at[live[pivot + 1]]] == item:
            pivot += 1
        block = item // ix.block
        if sum(float(ix.block_best[query[c], block]) for c in live[: pivot + 1]) < threshold - slack:
            to = (block + 1) * ix.block  # nothing before the block's end or the next list's item can reach it
            if pivot + 1 < len(live):
                to = min(to, lists[live[pivot + 1]][0][at[live[pivot + 1]]])
            for c in live[: pivot + 1]:
                own = lists[c][0]
                while at[c] < size[c] and own[at[c]] < to:
                    at[c] += 1
        elif lists[live[0]][0][at[live[0]]] == item:
            score = 0.0
            for c in live[: pivot + 1]:
                score += lists[c][1][at[c]]
                at[c] += 1
            if score >= threshold - slack:
                out.append((item, score))
        else:
            for c in live[: pivot + 1]:
                own = lists[c][0]
                while at[c] < size[c] and own[at[c]] < item:
                    at[c] += 1


def search(ix: Index, texts: list[list[bytes]], p: Params) -> list[tuple[int, int, int, float, float, float | None]]:
    """(text, item, passage, score, question's overlap, answer's overlap) of the leaks in tokenised texts, for every passage that has one."""
    get, none = ix.terms.get, repeat(-1)
    ids = [np.fromiter(map(get, t, none), np.int32, len(t)) for t in texts]
    count = np.array([len(x) for x in ids])
    halves = -(-count // ix.half)
    first_half = np.cumsum(halves) - halves
    all_ids = np.concatenate([np.zeros(0, np.int32), *ids])
    within = np.arange(len(all_ids)) - np.repeat(np.cumsum(count) - count, count)
    known = np.flatnonzero(all_ids >= 0)
    half = np.repeat(first_half, count)[known] + within[known] // ix.half
    term = all_ids[known].astype(np.int64)
    # passage h is half-windows h and h + 1 of one text; the last half-window is a passage only where it is the text's only one
    starts_text = np.zeros(int(halves.sum()) + 1, bool)
    starts_text[first_half[halves > 0]] = True
    terms_n = max(1, len(ix.terms))
    own = half * terms_n + term
    back = ((half - 1) * terms_n + term)[~starts_text[half]]
    keys = np.concatenate([own, back])
    keys.sort()  # np.unique hashes, which takes thirty times as long
    keys = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]
    passage, term = np.divmod(keys, terms_n)
    if not len(keys):
        return []
    first = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    size = np.diff(np.append(first, len(passage)))
    maybe = np.add.reduceat(ix.best[term], first) >= p.threshold - 1e-4
    out = []
    text_of = np.repeat(np.arange(len(texts)), halves)
    chosen = np.flatnonzero(maybe)
    for part in range(0, len(chosen), 32):  # as many rows of bounds as the processor's cache holds
        own_p = chosen[part : part + 32]
        at = np.repeat(first[own_p] - np.cumsum(size[own_p]) + size[own_p], size[own_p]) + np.arange(size[own_p].sum())
        bounds = np.add.reduceat(ix.block_best[term[at]], np.cumsum(size[own_p]) - size[own_p], axis=0)
        for k in np.flatnonzero((bounds >= p.threshold - 1e-4).any(1)).tolist():
            j = int(own_p[k])
            open_blocks = np.flatnonzero(bounds[k] >= p.threshold - 1e-4)
            query = term[first[j] : first[j] + size[j]]
            query = query[ix.block_best[query][:, open_blocks].max(1) > 1e-30].tolist()
            hits = wand(ix, query, p.threshold)
            if not hits:
                continue
            h = int(passage[first[j]])
            text = int(text_of[h])
            nth = h - int(first_half[text])
            words = ids[text][nth * ix.half : (nth + 2) * ix.half].tolist()
            for item, score in hits:
                found = together(words, ix.questions[item], ix.answers[item], int(ix.sizes[item] * p.spread) + p.loose, p)
                if found:
                    out.append((text, item, nth, min(1.0, score), *found))
    return out


def best_of(found: list[tuple[int, int, int, float, float, float | None]]) -> dict[tuple[int, int], tuple]:
    """Of each text and item the best passage."""
    best: dict[tuple[int, int], tuple] = {}
    for x in found:
        rank = (x[4], -1.0 if x[5] is None else x[5], x[3], -x[2])
        if (x[0], x[1]) not in best or rank > best[x[0], x[1]][0]:
            best[x[0], x[1]] = (rank, x)
    return {k: x for k, (_, x) in best.items()}


def leaks(ix: Index, p: Params):  # noqa: ANN201
    of = pa.list_(pa.struct([("item_id", pa.int64()), ("passage", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))

    def one(text: pa.Array) -> pa.Array:
        out: list[list[dict]] = [[] for _ in range(len(text))]
        data, offsets = utf8(text)
        for a, b in pieces(offsets):
            plain = data[offsets[a] : offsets[b]].tobytes().translate(_PLAIN)
            cut = (offsets[a : b + 1] - offsets[a]).tolist()
            texts = [plain[x:y].split() for x, y in zip(cut[:-1], cut[1:], strict=True)]
            for (t, item), x in sorted(best_of(search(ix, texts, p)).items()):
                out[a + t].append({"item_id": ix.ids[item], "passage": x[2], "score": x[3], "question_overlap": x[4], "answer_overlap": x[5]})
        return pa.array(out, of)

    return F.arrow_udf(one, LEAKS)


def load(benchmark: DataFrame, p: Params = Params()) -> list[Index]:
    """Test sets don't grow with the corpus; the index goes to the executors with the query, if the items' text is within `most_bytes`."""
    own = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    if size > p.most_bytes:
        raise ValueError(f"{size} bytes of items; split the benchmark, or raise most_bytes")
    return indexes([(r["i"], r["t"]) for r in rows_of(own)], p)


def contaminated(docs: DataFrame, benchmark: DataFrame, p: Params = Params(), text: str = "text") -> DataFrame:
    """A row for each document and item that it leaks: doc_id, item_id, passage, score, question_overlap, answer_overlap."""
    tuned(docs.sparkSession)
    own = docs.select(id_of(docs), docs[text].cast("string").alias("t"))
    found = [leaks(ix, p)("t") for ix in load(benchmark, p)] or [F.lit(None).cast(LEAKS)]
    every = found[0] if len(found) == 1 else F.flatten(F.array(*found))
    return own.select("doc_id", F.explode(every).alias("x")).select("doc_id", "x.*")


def clean(docs: DataFrame, benchmark: DataFrame, p: Params = Params(), text: str = "text") -> DataFrame:
    """The rows of docs, all their columns, that leak no item."""
    tuned(docs.sparkSession)
    for ix in load(benchmark, p):
        docs = docs.where(F.size(leaks(ix, p)(docs[text].cast("string"))) == 0)
    return docs
