"""Quality classifier: a convolutional network over bytes, in numpy.

A document's bytes become vectors of a learned table.  Learned filters look at chunks of 2 * stride bytes, one every `stride` bytes, so that
chunks overlap and cover the document to its last byte.  Each filter's greatest value over all chunks goes through a linear layer
into one probability, that of good quality.  All of it is trained by gradient descent on a bounded sample of labelled documents, each looked at whole.
Long texts are judged in parts whose maxima are kept, so memory doesn't follow a text's length.

Defined results: null and empty texts have no chunk; their probability is 0.  Without labelled documents of both kinds there is no model and
probabilities are null.  A label that is null isn't used; of several labels of a document the least counts.  Rows are judged each on its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_of, pieces, rows_of, sample_per_class, tuned, utf8

PAD = 256  # after the end of a text


@dataclass(frozen=True)
class Params:
    stride: int = 6
    width: int = 8  # of the bytes' vectors
    filters: int = 24
    per_label: int = 400  # the bound of the labelled sample, whose texts the driver holds whole
    epochs: int = 40
    batch: int = 16
    rate: float = 0.01
    seed: int = 3
    threshold: float = 0.5


@dataclass
class Model:
    table: np.ndarray  # (257, width)
    first: np.ndarray  # (stride * width, filters), of a chunk's first half
    second: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks of `stride` codes, first block of each text); every text has a block of padding at its end."""
    n = -(-(ends - starts) // stride) + 1
    first = np.cumsum(n) - n
    codes = np.full((int(n.sum()), stride), PAD, np.int16)
    flat = codes.reshape(-1)
    for at, a, b in zip((first * stride).tolist(), starts.tolist(), ends.tolist(), strict=True):
        flat[at : at + b - a] = data[a:b]
    return codes, first


SEGMENT = 1 << 16  # blocks that are looked at at once


def _filtered(m: Model, codes: np.ndarray) -> np.ndarray:
    """(blocks, filters): the filters' values of the chunk that begins with each block; the last block begins none."""
    y = np.empty((len(codes), m.first.shape[1]), np.float32)
    for a in range(0, len(codes), SEGMENT):
        x = m.table[codes[a : a + SEGMENT]].reshape(-1, m.first.shape[0])
        y[a : a + SEGMENT] = x @ m.first
        z = x @ m.second
        y[max(a - 1, 0) : a + len(x) - 1] += z[int(a == 0) :]
    return y


def _maxima(m: Model, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, filters): the filters' greatest values.  The padding blocks end a text's chunks."""
    y = _filtered(m, codes)
    y[np.append(first[1:], len(codes)) - 1] = -np.inf  # no chunk begins in the padding
    return np.maximum.reduceat(y, first, axis=0) + m.bias


def _maxima_of_one(m: Model, data: np.ndarray, stride: int) -> np.ndarray:
    """The filters' greatest values over a long text, in parts that overlap by a block."""
    top = np.full(m.first.shape[1], -np.inf, np.float32)
    step = SEGMENT * stride
    for a in range(0, len(data), step):
        own = data[a : a + step + stride]
        codes, _ = blocks(own, np.array([0]), np.array([len(own)]), stride)
        whole = codes[: -(-len(own) // stride) + (a + len(own) >= len(data))]  # only the text's end is padded
        if len(whole) > 1:
            top = np.maximum(top, _filtered(m, whole)[:-1].max(0))
    return top + m.bias


def probabilities(m: Model, data: np.ndarray, offsets: np.ndarray, stride: int) -> np.ndarray:
    out = np.zeros(len(offsets) - 1)
    size = np.diff(offsets)
    long = size > SEGMENT * stride
    some = np.flatnonzero((size > 0) & ~long)
    top = [_maxima(m, *blocks(data, offsets[some], offsets[some + 1], stride))] if len(some) else []
    some = np.append(some, np.flatnonzero(long)).astype(np.int64)
    top += [_maxima_of_one(m, data[offsets[i] : offsets[i + 1]], stride)[None] for i in np.flatnonzero(long).tolist()]
    if len(some):
        out[some] = 1 / (1 + np.exp(-(np.tanh(np.concatenate(top)) @ m.out + m.out_bias[0])))
    return out


def train(texts: list[bytes], labels: np.ndarray, p: Params = Params()) -> Model:
    rng, f4 = np.random.default_rng(p.seed), np.float32
    k = p.stride * p.width
    m = Model((rng.standard_normal((257, p.width)) * 0.5).astype(f4), (rng.standard_normal((k, p.filters)) / np.sqrt(2 * k)).astype(f4), (rng.standard_normal((k, p.filters)) / np.sqrt(2 * k)).astype(f4), np.full(p.filters, -1, f4), (rng.standard_normal(p.filters) * 0.3).astype(f4), np.zeros(1, f4))
    weights = [m.table, m.first, m.second, m.bias, m.out, m.out_bias]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    kinds = [np.flatnonzero(labels == c) for c in (0, 1)]
    steps = p.epochs * max(1, max(map(len, kinds)) // (p.batch // 2))
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(own, p.batch // 2) for own in kinds])
        parts = [np.frombuffer(texts[i], np.uint8) for i in pick]
        ends = np.cumsum([len(x) for x in parts])
        codes, first = blocks(np.concatenate(parts), ends - [len(x) for x in parts], ends, p.stride)
        y = _filtered(m, codes)
        last = np.append(first[1:], len(codes)) - 1
        y[last] = -np.inf
        where = np.stack([a + y[a:b].argmax(0) for a, b in zip(first, last, strict=True)])  # (texts, filters)
        top = np.tanh(np.take_along_axis(y, where, 0) + m.bias)
        q = 1 / (1 + np.exp(-(top @ m.out + m.out_bias[0])))
        d_q = ((q - labels[pick]) / len(pick)).astype(f4)
        d_top = d_q[:, None] * m.out * (1 - top * top)  # (texts, filters)
        g_first, g_second, g_table = np.zeros_like(m.first), np.zeros_like(m.second), np.zeros_like(m.table)
        for j in range(p.filters):
            own = where[:, j]
            g_first[:, j] = d_top[:, j] @ m.table[codes[own]].reshape(len(own), -1)
            g_second[:, j] = d_top[:, j] @ m.table[codes[own + 1]].reshape(len(own), -1)
            np.add.at(g_table, codes[own].astype(np.intp), d_top[:, j][:, None, None] * m.first[:, j].reshape(p.stride, p.width))
            np.add.at(g_table, codes[own + 1].astype(np.intp), d_top[:, j][:, None, None] * m.second[:, j].reshape(p.stride, p.width))
        grads = [g_table, g_first, g_second, d_top.sum(0), d_q @ top, d_q.sum(keepdims=True)]
        rate = p.rate * (1 - 0.9 * step / steps)
        for w, g, a, s in zip(weights, grads, mean, square, strict=True):
            a += 0.1 * (g - a)
            s += 0.01 * (g * g - s)
            w -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(f4)
    return m


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), text: str = "text", label: str = "quality", key: str = "doc_id") -> Model | None:
    """From per_label documents of each label, those of least hash."""
    tuned(docs.sparkSession)
    one = labels.groupBy(key).agg(F.min(F.col(label).cast("int")).alias(label)).where(F.col(label).isin(0, 1))
    few = sample_per_class(one, key, label, p.per_label)
    rows = rows_of(docs.select(key, text).join(F.broadcast(few), key).where(F.length(text) > 0).groupBy(key, label).agg(F.min(text).alias(text)))
    rows.sort(key=lambda r: r[key])
    y = np.array([r[label] for r in rows])
    if not (0 < y.sum() < len(y)):
        return None
    return train([r[text].encode() for r in rows], y, p)


def score(m: Model | None, p: Params = Params()):  # noqa: ANN201
    def one(text: pa.Array) -> pa.Array:
        if m is None:
            return pa.nulls(len(text), pa.float64())
        data, offsets = utf8(text)
        return pa.array(np.concatenate([np.zeros(0), *(probabilities(m, data, offsets[a : b + 1], p.stride) for a, b in pieces(offsets, 1 << 19))]), pa.float64())

    return F.arrow_udf(one, "double")


def qualities(docs: DataFrame, labels: DataFrame, p: Params = Params(), m: Model | None = None, text: str = "text") -> DataFrame:
    """doc_id, probability of good quality and whether it reaches the threshold (null probabilities do), a row for each of docs."""
    tuned(docs.sparkSession)
    m = m or fit(docs, labels, p, text)
    out = docs.select(id_of(docs), score(m, p)(docs[text].cast("string")).alias("probability"))
    return out.withColumn("keep", F.coalesce(F.col("probability") >= p.threshold, F.lit(True)))
