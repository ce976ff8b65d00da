"""Language identification with a bidirectional gated recurrent network over bytes, in numpy.

Every document is cut into consecutive windows of at most `window` bytes that cover all of it.  In a window one gated recurrent
unit runs forwards and another backwards from zero states; their two states at a byte give the probabilities of the languages at
this byte.  A document's probabilities are the means over all its bytes.  Training is backpropagation through time on the
cross-entropy at every byte of windows drawn from a bounded sample of labelled documents, and of as many drawn windows of unlike input as a language
has: random characters, numbers, encoded data, letters of other scripts.  A document of `least_bytes` or more whose best language stays under
`min_probability` is rejected.

Defined results: a text that is null or has no bytes has language null, probability 0 and is rejected.  Without any labelled row
there is no model: every text has language null, probability null and is accepted.  With one label every text has it.  Equal
probabilities go to the language that sorts first.  label_counts are in the order of the languages, last the bytes labelled as unlike any.  Repeated rows are judged alike, each on its own; other columns aren't looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_of, pieces, rows_of, sample_per_class, tuned, utf8

RESULT = "struct<language:string,probability:double,label_counts:array<bigint>,accepted:boolean>"


@dataclass(frozen=True)
class Params:
    hidden: int = 8
    window: int = 256
    batch: int = 2048  # windows in a step of inference
    docs_per_language: int = 150  # the bound of the labelled sample
    windows_per_document: int = 8  # drawn from all over the text of each sampled document, of train_window bytes each
    train_window: int = 96
    train_batch: int = 128
    steps: int = 160
    rate: float = 0.02
    seed: int = 7
    min_probability: float = 0.3  # below it a document is rejected
    least_bytes: int = 24  # shorter texts show too little to be unlike any language, and stay


@dataclass
class Model:
    classes: list[str]
    tables: list[np.ndarray] = field(default_factory=list)  # of each direction: (3 hidden, 256), inputs of the gates by byte
    states: list[np.ndarray] = field(default_factory=list)  # of each direction: (3 hidden, hidden)
    outs: list[np.ndarray] = field(default_factory=list)  # of each direction: (classes, hidden)
    bias: np.ndarray | None = None  # (classes, 1)


def _step(x: np.ndarray, w: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of a unit; gates' inputs x of shape (3 hidden, batch).  Also what its gradient needs."""
    k = h.shape[0]
    g = w @ h
    zr = 1 / (1 + np.exp(-(x[: 2 * k] + g[: 2 * k])))
    n = np.tanh(x[2 * k :] + zr[k:] * g[2 * k :])
    return n + zr[:k] * (h - n), zr[:k], zr[k:], n, g[2 * k :]


def weights_of(m: Model) -> list[np.ndarray]:
    return [*m.tables, *m.states, *m.outs, m.bias]  # type: ignore[list-item]


def gradients(m: Model, xs: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean cross-entropy at every byte of xs (bytes, examples), y being the examples' classes, and its gradients by backpropagation through time, in the order of weights_of()."""
    t_n, b = xs.shape
    k, kind = m.states[0].shape[1], m.tables[0].dtype
    saved, hidden = [[], []], [np.zeros((t_n, k, b), kind) for _ in "fb"]
    for d in range(2):
        h = np.zeros((k, b), kind)
        for t in range(t_n) if d == 0 else range(t_n - 1, -1, -1):
            new, *rest = _step(m.tables[d][:, xs[t]], m.states[d], h)
            saved[d].append((h, *rest))
            hidden[d][t] = h = new
    logits = np.einsum("ck,tkb->tcb", m.outs[0], hidden[0]) + np.einsum("ck,tkb->tcb", m.outs[1], hidden[1]) + m.bias
    e = np.exp(logits - logits.max(1, keepdims=True))
    d_out = e / e.sum(1, keepdims=True)
    loss = -float(np.log(d_out[:, y, np.arange(b)]).mean())
    d_out[:, y, np.arange(b)] -= 1
    d_out /= t_n * b
    grads: list[np.ndarray] = [None] * 7  # type: ignore[list-item]
    grads[6] = d_out.sum((0, 2))[:, None]
    for d in range(2):
        grads[4 + d] = np.einsum("tcb,tkb->ck", d_out, hidden[d])
        d_hidden = np.einsum("ck,tcb->tkb", m.outs[d], d_out)
        d_w, d_x, back = np.zeros_like(m.states[d]), np.zeros((t_n, 3 * k, b), kind), np.zeros((k, b), kind)
        order = list(range(t_n)) if d == 0 else list(range(t_n - 1, -1, -1))
        for t, (h, z, r, n, g_n) in zip(reversed(order), reversed(saved[d]), strict=True):
            dh = back + d_hidden[t]
            d_n = dh * (1 - z) * (1 - n * n)
            d_z = dh * (h - n) * z * (1 - z)
            d_r = d_n * g_n * r * (1 - r)
            d_g = np.concatenate([d_z, d_r, d_n * r])
            d_x[t, : 2 * k], d_x[t, 2 * k :] = d_g[: 2 * k], d_n
            d_w += d_g @ h.T
            back = dh * z + m.states[d].T @ d_g
        flat = xs.ravel()
        grads[d] = np.stack([np.bincount(flat, d_x[:, i].ravel(), 256) for i in range(3 * k)]).astype(kind)
        grads[2 + d] = d_w
    return loss, grads


def train(codes: np.ndarray, labels: np.ndarray, classes: list[str], p: Params) -> Model:
    """codes: (examples, train_window) bytes; labels: their classes' numbers, len(classes) for what is in none."""
    rng = np.random.default_rng(p.seed)
    k, c, f4 = p.hidden, max(len(classes), int(labels.max()) + 1), np.float32
    m = Model(classes)
    m.tables = [(rng.standard_normal((3 * k, 256)) * 0.3).astype(f4) for _ in "fb"]
    m.states = [(rng.standard_normal((3 * k, k)) / np.sqrt(k)).astype(f4) for _ in "fb"]
    m.outs = [(rng.standard_normal((c, k)) * 0.3).astype(f4) for _ in "fb"]
    m.bias = np.zeros((c, 1), f4)
    weights = weights_of(m)
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    by_class = [np.flatnonzero(labels == i) for i in range(c)]
    for step in range(1, p.steps + 1):
        pick = np.concatenate([rng.choice(own, -(-p.train_batch // c)) for own in by_class])
        _, grads = gradients(m, codes[pick].T, labels[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = p.rate * min(1.0, 2 * (1 - step / (p.steps + 1)))
        for w, g, a, s in zip(weights, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            a += 0.1 * (g - a)
            s += 0.01 * (g * g - s)
            w -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(f4)
    return m


def label_windows(m: Model, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows of about equal sizes: the sums of the languages' probabilities over the bytes, and how many bytes have each label."""
    t_n, least, b, c, k = int(sizes.max()), int(sizes.min()), len(starts), len(m.bias), m.states[0].shape[1]  # type: ignore[arg-type]
    at = starts[None, :] + np.arange(t_n)[:, None]
    np.minimum(at, len(data) - 1, out=at)
    xs = data[at].astype(np.intp)
    logits = np.empty((t_n, c, b), np.float32)
    x, g, out = np.empty((3 * k, b), np.float32), np.empty((3 * k, b), np.float32), np.empty((c, b), np.float32)
    for d in range(2):
        h = np.zeros((k, b), np.float32)
        w, table, to = m.states[d].copy(), m.tables[d].copy(), m.outs[d]
        w[: 2 * k] *= 0.5  # logistic(x) = (1 + tanh(x / 2)) / 2
        table[: 2 * k] *= 0.5
        for t in range(t_n) if d == 0 else range(t_n - 1, -1, -1):
            np.take(table, xs[t], axis=1, out=x, mode="clip")
            np.matmul(w, h, out=g)
            zr, n = x[: 2 * k], g[2 * k :]
            zr += g[: 2 * k]
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            n *= zr[k:]
            n += x[2 * k :]
            np.tanh(n, out=n)
            h -= n
            h *= zr[:k]
            h += n
            if t >= least and d == 1:
                h *= sizes > t  # the backward unit starts at a window's last byte
            np.matmul(to, h, out=out)
            if d == 0:
                np.add(out, m.bias, out=logits[t])
            else:
                logits[t] += out
    top = logits.max(1, keepdims=True)
    logits -= top
    best = logits == 0
    if least < t_n:
        best &= (np.arange(t_n)[:, None] < sizes[None, :])[:, None, :]
    np.exp(logits, out=logits)
    share = 1 / logits.sum(1, keepdims=True)
    if least < t_n:
        share *= (np.arange(t_n)[:, None] < sizes[None, :])[:, None, :]
    logits *= share
    return logits.sum(0).T, best.sum(0).T


def judge(m: Model, data: np.ndarray, offsets: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: the languages' mean probabilities (0 where it is empty), and counts of labels, those as unlike any last."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    per = -(-size // p.window)
    doc = np.repeat(np.arange(n), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    starts = offsets[:-1][doc] + nth * p.window
    sizes = np.minimum(p.window, offsets[1:][doc] - starts)
    order = np.argsort(sizes, kind="stable")
    c = len(m.bias)  # type: ignore[arg-type]
    total, counts = np.zeros((n, c)), np.zeros((n, c), np.int64)
    for at in range(0, len(order), p.batch):
        own = order[at : at + p.batch]
        probabilities, labels = label_windows(m, data, starts[own], sizes[own])
        np.add.at(total, doc[own], probabilities)
        np.add.at(counts, doc[own], labels)
    return total[:, : len(m.classes)] / np.maximum(size, 1)[:, None], counts


#: Scripts by their first and last letters: Greek, Cyrillic, Arabic, Devanagari, kana, Chinese, Korean.  One that a labelled language is written in is told apart by its order of letters.
_SCRIPTS = ((0x3B1, 0x3C9), (0x430, 0x44F), (0x627, 0x64A), (0x905, 0x939), (0x3041, 0x3096), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
_ENCODED = (b"0123456789abcdef", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", b"01")


def unlike(n: int, size: int, rng: np.random.Generator) -> list[np.ndarray]:
    """n windows of bytes that are in no language."""
    out = []
    for i in range(n):
        if i % 4 == 0:
            raw = rng.integers(33, 127, size).astype(np.uint8).tobytes()
        elif i % 4 == 1:
            raw = b" ".join(str(x).encode() for x in rng.integers(0, 10 ** rng.integers(1, 10), size).tolist())
        elif i % 4 == 2:
            lo, hi = _SCRIPTS[int(rng.integers(0, len(_SCRIPTS)))]
            spaces = rng.random(size) < (0.15 if hi < 0x3000 else 0.02)
            raw = "".join(" " if s else chr(c) for c, s in zip(rng.integers(lo, hi + 1, size).tolist(), spaces, strict=True)).encode()
        else:
            chars = _ENCODED[int(rng.integers(0, len(_ENCODED)))]
            raw = bytes(chars[j] for j in rng.integers(0, len(chars), size).tolist())
        at = int(rng.integers(0, max(1, len(raw) - size + 1)))
        out.append(np.resize(np.frombuffer(raw, np.uint8)[at : at + size], size))
    return out


def fit(docs: DataFrame, p: Params = Params(), text: str = "text", label: str = "lang", key: str = "doc_id") -> Model:
    """A model from the labelled rows of docs: docs_per_language of each language, windows spread over their whole texts."""
    few = sample_per_class(docs.where(F.length(text) > 0), key, label, p.docs_per_language)
    rows = rows_of(docs.select(key, text).join(F.broadcast(few), key).where(F.length(text) > 0).groupBy(key, label).agg(F.min(text).alias(text)))
    classes = sorted({r[label] for r in rows})
    if not classes:
        return Model([])
    number = {c: i for i, c in enumerate(classes)}
    rng, codes, labels = np.random.default_rng(p.seed), [], []
    for r in sorted(rows, key=lambda r: (r[label], r[key])):
        raw = np.frombuffer(r[text].encode(), np.uint8)
        for at in rng.integers(0, max(1, len(raw) - p.train_window + 1), p.windows_per_document):
            codes.append(np.resize(raw[at : at + p.train_window], p.train_window))
            labels.append(number[r[label]])
    if len(classes) == 1:
        return Model(classes)
    other = unlike(-(-len(codes) // len(classes)), p.train_window, rng)
    codes += other
    labels += [len(classes)] * len(other)
    return train(np.stack(codes).astype(np.intp), np.array(labels), classes, p)


def identify(m: Model, p: Params = Params()):  # noqa: ANN201
    """An Arrow UDF of the text: language, probability, bytes with each label (in the order of m.classes) and whether it is accepted."""
    of = pa.struct([("language", pa.string()), ("probability", pa.float64()), ("label_counts", pa.list_(pa.int64())), ("accepted", pa.bool_())])

    def one(text: pa.Array) -> pa.Array:
        out: list[dict] = []
        data, offsets = utf8(text)
        for a, b in pieces(offsets, 4 << 20):
            own = offsets[a : b + 1]
            size = np.diff(own)
            if not m.classes:
                out += [{"language": None, "probability": None, "label_counts": [], "accepted": True}] * (b - a)
                continue
            if len(m.classes) == 1:
                mean, counts = (size > 0).astype(float)[:, None], size[:, None]
            else:
                mean, counts = judge(m, data, own, p)
            best = mean.argmax(1)
            for i in range(b - a):
                q = float(mean[i, best[i]]) if size[i] else 0.0
                out.append({"language": m.classes[best[i]] if size[i] else None, "probability": q, "label_counts": counts[i].tolist(), "accepted": bool(size[i]) and (q >= p.min_probability or bool(size[i] < p.least_bytes))})
        return pa.array(out, of)

    return F.arrow_udf(one, RESULT)


def language(docs: DataFrame, m: Model, p: Params = Params(), text: str = "text") -> Column:
    return identify(m, p)(docs[text].cast("string"))


def languages(docs: DataFrame, p: Params = Params(), m: Model | None = None) -> DataFrame:
    """One row a document: doc_id, language, probability, label_counts, accepted."""
    tuned(docs.sparkSession)
    m = m or fit(docs, p)
    return docs.select(id_of(docs), language(docs, m, p).alias("r")).select("doc_id", "r.*")


def keep_known(docs: DataFrame, p: Params = Params(), m: Model | None = None) -> DataFrame:
    """The rows of docs, all their columns, whose text is accepted."""
    tuned(docs.sparkSession)
    m = m or fit(docs, p)
    return docs.where(language(docs, m, p)["accepted"])
