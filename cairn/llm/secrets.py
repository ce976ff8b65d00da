"""Secret scans with two Markov models of characters.

A candidate is a run of at least `least` characters of [A-Za-z0-9+/_-].  Other characters end it; where a Latin letter beyond ASCII adjoins, the
run is a piece of a word and no candidate.  One model is of random strings, one of ordinary identifiers, words, paths and numbers; both give each
character's probability after its predecessor.  A candidate is a secret where the log-likelihood ratio of the two, per character, is above
`threshold`.  Where the whole isn't, as in a long path with a key, the stretch of segments between [+/_-] that is most above it is, if it has `least`
characters, and so on beside that stretch.  Both are trained from labelled
samples: `samples()` draws them, with words of the corpus among the ordinary ones, or pass your own.

Defined results: null and empty texts have no secrets.  Candidates of one text are independent of each other, so repeated ones are each
found.  Texts are scanned whole.  Offsets count characters.  Other columns aren't looked at; redact() returns them as they are.
"""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_of, pieces, rows_of, tuned, utf8

SPANS = "array<struct<start:bigint,length:bigint,ratio:double,secret:string>>"
_ALPHABET = string.ascii_letters + string.digits + "+/_-"
_CODE = np.full(256, -1, np.int64)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))
_SEPARATOR = np.isin(np.arange(256), list(b"+/_-"))
EDGE = len(_ALPHABET)  # stands before the first character


@dataclass(frozen=True)
class Params:
    least: int = 16
    threshold: float = 0.25  # nats a character
    per_kind: int = 3000  # drawn samples of each kind
    corpus_documents: int = 200  # the bound of the documents that give words
    seed: int = 5
    mask: str = "[SECRET]"


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray  # (EDGE + 1, EDGE): log of random over ordinary


def samples(words: Iterable[str], p: Params = Params()) -> tuple[list[str], list[str]]:
    """(random, ordinary) strings."""
    rng = np.random.default_rng(p.seed)
    words = sorted({w for w in words if w.isascii() and w.isalpha()}) or ["alpha", "value", "index", "name"]
    common = "get set is has find load save read write parse format update delete create user name file path index value count list map key data time date config server client request response handler manager service test error message string number array object table column session account order item page content type version".split()
    kinds = {"hex": string.digits + "abcdef", "HEX": string.digits + "ABCDEF", "base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "url64": string.ascii_letters + string.digits + "-_", "upper": string.ascii_uppercase + string.digits, "lower": string.ascii_lowercase + string.digits}
    prefixes = ["", "", "", "AKIA", "ghp_", "sk-", "xoxb-"]
    random, ordinary = [], []
    for kind, chars in kinds.items():
        for size in rng.integers(16, 65, p.per_kind).tolist():
            s = "".join([chars[i] for i in rng.integers(0, len(chars), size).tolist()])
            random.append(prefixes[int(rng.integers(0, 7))] + s if kind == "base62" else s)
    pool = [words, common]
    for i in range(p.per_kind * len(kinds)):
        own = pool[i % 2]
        w = [own[j].lower() for j in rng.integers(0, len(own), int(rng.integers(2, 7))).tolist()]
        kind = i % 8
        if kind == 0:
            ordinary.append("_".join(w))
        elif kind == 1:
            ordinary.append(w[0] + "".join(x.capitalize() for x in w[1:]))
        elif kind == 2:
            ordinary.append("-".join(w) + ("-" + str(rng.integers(0, 10000)) if i % 3 else ""))
        elif kind == 3:
            ordinary.append("/" + "/".join(w))
        elif kind == 4:
            ordinary.append("_".join(w).upper())
        elif kind == 5:
            ordinary.append(f"{rng.integers(1970, 2040)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}-{'-'.join(w)}" if i % 2 else "".join(x.capitalize() for x in w))
        elif kind == 6:
            ordinary.append("".join(w) if i % 3 else "-_+/"[int(rng.integers(0, 4))] * int(rng.integers(16, 60)))
        else:
            ordinary.append("".join(map(str, rng.integers(0, 10, rng.integers(8, 33)))))
    return random, ordinary


def _log_probabilities(texts: Iterable[str]) -> np.ndarray:
    raw = np.frombuffer("\n".join(["", *texts]).encode(), np.uint8)
    code = np.where(_CODE[raw] < 0, EDGE, _CODE[raw])  # line ends, and what isn't a character of candidates
    n = np.bincount(code[:-1] * (EDGE + 1) + code[1:], minlength=(EDGE + 1) ** 2).reshape(EDGE + 1, EDGE + 1)[:, :EDGE] + 0.5
    return np.log(n / n.sum(1, keepdims=True))


def train(random: Iterable[str], ordinary: Iterable[str]) -> Model:
    """Both are strings of the candidates' characters."""
    return Model(_log_probabilities(random) - _log_probabilities(ordinary))


def fit(docs: DataFrame, p: Params = Params(), text: str = "text") -> Model:
    """Samples with the words of up to corpus_documents documents, those of least hash."""
    few = docs.where(F.length(text) > 0).select(F.xxhash64("doc_id", F.lit(p.seed)).alias("h"), "doc_id").orderBy("h", "doc_id").limit(p.corpus_documents)
    rows = rows_of(docs.select("doc_id", text).join(F.broadcast(few), "doc_id").select(text))
    return train(*samples((w for r in rows if r[0] for w in r[0].split()), p))


def _latin(c: str) -> bool:
    return c > "\x7f" and c.isalpha() and (unicodedata.name(c, "").startswith("LATIN") or c in "ªº")


def stretches(excess: np.ndarray, split: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The stretches of whole segments, at least `least` long, whose sum is positive: that of the greatest sum, and so on in what is left and right of it."""
    edge = np.flatnonzero(np.diff(np.append(np.append(True, split), True).astype(np.int8)))
    begin, end = edge[::2].tolist(), edge[1::2].tolist()
    total = np.append(0.0, np.cumsum(excess)).tolist()
    out, left = [], [(0, len(begin))]
    while left:
        lo, hi = left.pop()
        best, chosen, low, k = 0.0, None, None, lo
        for j in range(lo, hi):
            while k <= j and end[j] - begin[k] >= least:
                low = k if low is None or total[begin[k]] < total[begin[low]] else low
                k += 1
            if low is not None and total[end[j]] - total[begin[low]] > best:
                best, chosen = total[end[j]] - total[begin[low]], (low, j)
        if chosen:
            out.append((begin[chosen[0]], end[chosen[1]]))
            left += [(lo, chosen[0]), (chosen[1] + 1, hi)]
    return sorted(out)


def spans(m: Model, data: np.ndarray, offsets: np.ndarray, p: Params) -> tuple[np.ndarray, ...]:
    """Of the secrets in the values: value's index, first byte, end, ratio."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    own = data[lo:hi]
    on = np.zeros(len(own) + 2, np.int8)
    on[1:-1] = _CODE[own] >= 0
    edge = np.diff(on)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cut = offsets[1:-1] - lo
    cut = cut[(cut > 0) & (cut < len(own))]
    cut = np.unique(cut[(on[cut] == 1) & (on[cut + 1] == 1)])
    if len(cut):
        starts, ends = np.sort(np.append(starts, cut)), np.sort(np.append(ends, cut))
    long = ends - starts >= p.least
    starts, ends = starts[long], ends[long]
    if len(starts):
        # pieces of words with letters beyond ASCII are few, and only those beside such a character are looked at
        beside = (own[np.maximum(starts - 1, 0)] >= 128) | (own[np.minimum(ends, len(own) - 1)] >= 128)
        for i in np.flatnonzero(beside).tolist():
            a, b = int(starts[i]), int(ends[i])
            v = int(np.searchsorted(offsets - lo, a, "right")) - 1
            left = own[max(a - 4, int(offsets[v]) - lo) : a].tobytes().decode("utf-8", "ignore")[-1:]
            right = own[b : min(b + 4, int(offsets[v + 1]) - lo)].tobytes().decode("utf-8", "ignore")[:1]
            beside[i] = _latin(left) or _latin(right)
        starts, ends = starts[~beside], ends[~beside]
    size = ends - starts
    if len(starts):
        at = np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())
        code = _CODE[own[at]]
        first = np.cumsum(size) - size
        before = np.append(EDGE, code[:-1])
        before[first] = EDGE
        each = m.ratio[before, code]
        ratio = np.add.reduceat(each, first) / size
        keep = ratio > p.threshold
        split = _SEPARATOR[own[at]]
        more = []
        for i in np.flatnonzero(~keep & (size > p.least) & np.logical_or.reduceat(split, first)).tolist():
            f, n = int(first[i]), int(size[i])
            more += [(int(starts[i]) + a, int(starts[i]) + b, float(each[f + a : f + b].mean())) for a, b in stretches(each[f : f + n] - p.threshold, split[f : f + n], p.least)]
        starts, ends, ratio = starts[keep], ends[keep], ratio[keep]
        if more:
            starts, ends, ratio = (np.append(x, y) for x, y in zip((starts, ends, ratio), zip(*more, strict=True), strict=True))
            order = np.argsort(starts)
            starts, ends, ratio = starts[order], ends[order], ratio[order]
    else:
        ratio = np.zeros(0)
    return np.searchsorted(offsets - lo, starts, "right") - 1, starts + lo, ends + lo, ratio


def found(m: Model, p: Params):  # noqa: ANN201
    of = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ratio", pa.float64()), ("secret", pa.string())]))

    def one(text: pa.Array) -> pa.Array:
        out: list[list[dict]] = [[] for _ in range(len(text))]
        data, offsets = utf8(text)
        for a, b in pieces(offsets):
            for doc, s, e, r in zip(*(x.tolist() for x in spans(m, data, offsets[a : b + 1], p)), strict=True):
                head = data[offsets[a + doc] : s]
                start = int(((head & 0xC0) != 0x80).sum())  # characters before it
                out[a + doc].append({"start": start, "length": e - s, "ratio": r, "secret": data[s:e].tobytes().decode()})
        return pa.array(out, of)

    return F.arrow_udf(one, SPANS)


def masked(m: Model, p: Params):  # noqa: ANN201
    """The text with every secret replaced; null where it has none."""

    def one(text: pa.Array) -> pa.Array:
        out: list[str | None] = [None] * len(text)
        data, offsets = utf8(text)
        for a, b in pieces(offsets):
            parts: dict[int, list[bytes]] = {}
            last: dict[int, int] = {}
            for doc, s, e, _ in zip(*(x.tolist() for x in spans(m, data, offsets[a : b + 1], p)), strict=True):
                parts.setdefault(a + doc, []).extend((data[last.get(a + doc, offsets[a + doc]) : s].tobytes(), p.mask.encode()))
                last[a + doc] = e
            for doc, x in parts.items():
                out[doc] = b"".join([*x, data[last[doc] : offsets[doc + 1]].tobytes()]).decode()
        return pa.array(out, pa.string())

    return F.arrow_udf(one, "string")


def scan(docs: DataFrame, p: Params = Params(), m: Model | None = None, text: str = "text") -> DataFrame:
    """A row for each secret: doc_id, start, length, ratio, secret."""
    tuned(docs.sparkSession)
    m = m or fit(docs, p, text)
    return docs.select(id_of(docs), F.explode(found(m, p)(docs[text].cast("string"))).alias("s")).select("doc_id", "s.*")


def redact(docs: DataFrame, p: Params = Params(), m: Model | None = None, text: str = "text", size: str = "n_chars") -> DataFrame:
    """docs with secrets masked; the column of lengths, if there is one, is that of the masked text."""
    tuned(docs.sparkSession)
    m = m or fit(docs, p, text)
    new: Column = F.coalesce(masked(m, p)(docs[text]), docs[text])
    out = docs.withColumn(text, new)
    return out.withColumn(size, F.when(F.col(text).isNull(), docs[size]).otherwise(F.length(text)).cast(docs.schema[size].dataType)) if size in docs.columns else out
