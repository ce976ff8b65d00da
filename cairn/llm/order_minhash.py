"""Document fingerprints by Order MinHash.

The features of a text are its k-mers of characters, each numbered by its occurrence: the second "the" is another feature than the
first.  Each of m hash functions selects the l features of least hash, puts them back into text order and hashes the tuple of
their k-mers.  Two texts' share of equal values estimates how alike their multisets of k-mers are and how alike their order is, so it
falls with edit distance where MinHash doesn't see a reordering.

Defined results: null text has a null signature and 0 k-mers.  A text shorter than k characters, the empty one included, has itself as
its only k-mer.  A text of fewer than l features selects all.  Hashes don't tie, as features are distinct; equal texts have equal signatures.
Rows are judged each on its own, and only doc_id and the text are looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_of, mix, tuned

RESULT = "struct<signature:array<bigint>,kmers:bigint>"


@dataclass(frozen=True)
class Params:
    k: int = 6
    l: int = 3  # noqa: E741
    m: int = 32
    seed: int = 11


def constants(p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of the m hash functions."""
    with np.errstate(over="ignore"):
        x = mix(np.arange(1, 2 * p.m + 1, dtype=np.uint64) + (np.uint64(p.seed) << np.uint64(32)))
    return x[: p.m] | np.uint64(1), x[p.m :]


def kmer_hashes(text: str, k: int) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(1, len(codes) - k + 1)
    h = np.full(n, min(len(codes), k), np.uint64)
    for i in range(min(k, len(codes))):
        h *= np.uint64(0x100000001B3)
        h += codes[i : i + n]
    return mix(h)


def features(h: np.ndarray) -> np.ndarray:
    """Hashes of the k-mers with their occurrence numbers, in text order."""
    n = len(h)
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    key = (h >> bits << bits) | np.arange(n, dtype=np.uint64)  # sorts by k-mer, then by place
    key.sort()
    place = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    key >>= bits
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    number = np.empty(n, np.uint64)
    number[place] = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    return mix(h + number * np.uint64(0x9E3779B97F4A7C15))


def lowest(e: np.ndarray, l: int, a: np.ndarray) -> np.ndarray:  # noqa: E741
    """For each multiplier of a, the places of the l least values of e * a modulo 2**64, in ascending order of place."""
    n = len(e)
    # few values lie under a bound that l + 24 of them are expected to lie under; all are looked at where that isn't enough
    bound = np.uint64(min(2**64 - 1, (l + 24) * (2**64 // n)))
    rows, cols, values = [], [], []
    for at in range(0, n, 4096):
        v = e[None, at : at + 4096] * a[:, None]
        low = np.flatnonzero(v < bound)
        values.append(v.ravel()[low])
        r, c = np.divmod(low, v.shape[1])
        rows.append(r)
        cols.append(c + at)
    row, col, value = (x[0] if len(x) == 1 else np.concatenate(x) for x in (rows, cols, values))
    if len(rows) > 1:
        order = np.argsort(row, kind="stable")
        row, col, value = row[order], col[order], value[order]
    count = np.bincount(row, minlength=len(a))
    width = int(count.max())
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    least = np.full((len(a), width), 2**64 - 1, np.uint64)
    where = np.zeros((len(a), width), np.int64)
    least[row, nth], where[row, nth] = value, col
    out = np.empty((len(a), l), np.int64)
    if width > l:
        out[:] = np.take_along_axis(where, np.argpartition(least, l - 1, axis=1)[:, :l], 1)
    elif width == l:
        out[:] = where
    for j in np.flatnonzero(count < l):
        v = e * a[j]
        out[j] = np.argpartition(v, l - 1)[:l] if n > l else np.arange(n)
    out.sort(axis=1)
    return out


def sketch(text: str, p: Params, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = kmer_hashes(text, p.k)
    e = features(h)
    chosen = lowest(e, min(p.l, len(e)), a)
    out = b.copy()
    for i in range(chosen.shape[1]):
        out = mix(out * np.uint64(0x100000001B3) + h[chosen[:, i]])
    return out.view(np.int64)


def sketches(p: Params):  # noqa: ANN201
    a, b = constants(p)
    of = pa.struct([("signature", pa.list_(pa.int64())), ("kmers", pa.int64())])

    def one(text: pa.Array) -> pa.Array:
        values, sizes, n = [], [], []
        for t in text:
            t = t.as_py()
            if t is None:
                sizes.append(-1)
                n.append(0)
                continue
            values.append(sketch(t, p, a, b))
            sizes.append(p.m)
            n.append(max(1, len(t) - p.k + 1))
        size = np.array(sizes, np.int64)
        ends = np.append(0, np.cumsum(np.maximum(size, 0))).astype(np.int32)
        offsets = pa.array(ends, pa.int32(), mask=np.append(size < 0, False))
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), pa.int64()))
        return pa.StructArray.from_arrays([lists, pa.array(n, pa.int64())], fields=list(of))

    return F.arrow_udf(one, RESULT)


def fingerprints(docs: DataFrame, p: Params = Params(), text: str = "text") -> DataFrame:
    """doc_id, signature (m values) and number of k-mers, a row for each of docs."""
    tuned(docs.sparkSession)
    return docs.select(id_of(docs), sketches(p)(docs[text].cast("string")).alias("s")).select("doc_id", "s.*")


def similarity(a: str, b: str) -> Column:
    """The share of equal values of two signature columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)
