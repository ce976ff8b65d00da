"""Near-duplicates by BagMinHash: weighted-Jaccard signatures, bands, exact verification, groups.

A document's features are its word shingles, weighted by how often they occur.  Every shingle has a Poisson process of rate 1 over
time for every unit [a, a + 1) of weight; a document of weight w sees the processes of units below w, and every point falls on one of
m positions.  A position keeps its earliest point, so two documents agree on it with the probability of their weighted Jaccard
similarity.  The units are discretised hierarchically, as blocks [0, 1), [1, 2), [2, 4), [4, 8) and so on: a block's process of rate 2**j gives
its first point, then splits into halves, of which one inherits the point and the other continues after it, down to single units.  A process
whose first point is later than all of the document's positions is given up with all its units.  Neither step changes a signature.

Documents of equal multisets are one group at once, and the least id stands for them.  Where signatures agree on a band, the members are
compared with the least id of the bucket, by the overlap of the multisets of the shingles' 48-bit hashes.  Then every pair of a bucket that these comparisons left in
different groups is compared as well, so each pair that shares a band is either compared or already in one group, whatever
the bucket's size.  Groups are the connected components.

Defined results: null and wordless texts are in no group.  Texts of fewer words than a shingle are one shingle.  Words are compared without ASCII
case.  Rows without doc_id are in no group.  Rows of one doc_id are one document, similar to another where one of its texts is; remove() keeps
one row of them, that of the least text.  Of a group the least id stays.  Texts are used whole, and other columns aren't looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import Written, checkpointed, id_of, mix, pieces, tuned, utf8, words

RESULT = "struct<f1:bigint,f2:bigint,bands:array<bigint>>"
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_ONE = np.uint64(1)


@dataclass(frozen=True)
class Params:
    shingle: int = 3  # words
    bands: int = 40
    rows: int = 4  # positions in a band
    threshold: float = 0.5  # least weighted Jaccard similarity
    members: int = 64  # compared with one document in one piece of work
    seed: int = 1

    @property
    def m(self) -> int:
        return self.bands * self.rows


def weighted_shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value's index, 48-bit hash of the shingle, count), ascending.  At most 65,536 values, whose numbers stand above the hashes."""
    if len(offsets) > 65_537:
        raise ValueError(f"{len(offsets) - 1} values in a piece")
    lo, hi = int(offsets[0]), int(offsets[-1])
    w, doc = words(_LOW[data[lo:hi]], offsets - lo)
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(w)
    s = w.copy()
    whole = np.ones(n, bool)
    for i in range(1, k):
        s *= np.uint64(0x9E3779B97F4A7C15)
        s[: n - i] += w[i:]
        same = np.zeros(n, bool)
        same[: n - i] = doc[i:] == doc[: n - i]
        whole &= same
    first = np.append(True, doc[1:] != doc[:-1])
    short = first & ~whole  # texts of fewer than k words: one shingle of all of them
    if short.any():
        for i in np.flatnonzero(short).tolist():
            own = w[i : i + k - 1][doc[i : i + k - 1] == doc[i]]
            x = len(own)
            for y in own.tolist():
                x = (x * 0x9E3779B97F4A7C15 + y) % 2**64
            s[i] = x
    keep = whole | short
    key = (doc[keep].astype(np.uint64) << np.uint64(48)) | (mix(s[keep]) >> np.uint64(16))
    key.sort()
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64(2**48 - 1), count


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, m: int, seed: int) -> np.ndarray:
    """(n, m) times of the positions' earliest points; infinite for documents without shingles."""
    h = np.full(n * m, np.inf)
    last = np.full(n, np.inf)
    last[np.bincount(doc, minlength=n) == 0] = -1
    # processes: document, hash of the shingle, level (a block or part of one has 2**level units), number of the first unit, weight, time of the first point
    base = mix(shingle + (np.uint64(seed) << np.uint64(48)))
    doc_p, base_p, level_p, unit_p, weight_p = [doc], [base], [np.zeros(len(doc), np.int64)], [np.zeros(len(doc), np.int64)], [count]
    j = 0
    while len(more := np.flatnonzero(count > (1 << j))):
        doc_p.append(doc[more])
        base_p.append(base[more])
        level_p.append(np.full(len(more), j))
        unit_p.append(np.full(len(more), 1 << j))
        weight_p.append(count[more])
        j += 1
    d, b, level, unit, weight = (np.concatenate(x) for x in (doc_p, base_p, level_p, unit_p, weight_p))
    state = mix(b + (unit.astype(np.uint64) << np.uint64(6)) + level.astype(np.uint64))  # the process's own random numbers
    time = -np.log(_uniform(state)) / (_ONE << level.astype(np.uint64))
    while len(d):
        single = level == 0
        one = np.flatnonzero(single)
        state1 = mix(state[one] + _ONE)
        position = (state1 >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
        np.minimum.at(h, d[one] * m + position.astype(np.int64), time[one])
        touched = np.flatnonzero(np.bincount(d[one], minlength=n))
        last[touched] = h.reshape(n, m)[touched].max(1)
        state2 = mix(state1 + _ONE)
        parts = [(d[one], b[one], level[one], unit[one], weight[one], state2, time[one] - np.log(_uniform(state2)))]
        if len(one) < len(d):
            two = np.flatnonzero(~single)
            state1 = mix(state[two] + _ONE)
            half = np.int64(1) << (level[two] - 1)
            later = time[two] - np.log(_uniform(mix(state1 + _ONE))) / half
            upper_first = (state1 >> np.uint64(63)).astype(bool)
            for upper in (False, True):
                at = unit[two] + half * upper
                inside = at < weight[two]
                child = level[two] - 1
                own = mix(b[two] + (at.astype(np.uint64) << np.uint64(6)) + child.astype(np.uint64))
                when = np.where(upper_first == upper, time[two], later)
                parts.append(tuple(x[inside] for x in (d[two], b[two], child, at, weight[two], own, when)))
        d, b, level, unit, weight, state, time = (np.concatenate(x) if len(parts) > 1 else x[0] for x in zip(*parts, strict=True))
        live = time < last[d]
        if not live.all():
            d, b, level, unit, weight, state, time = d[live], b[live], level[live], unit[live], weight[live], state[live], time[live]
    return h.reshape(n, m)


def band_hashes(h: np.ndarray, p: Params) -> np.ndarray:
    """(n, bands).  Times are compared in single precision, so that the last bits of a logarithm don't matter."""
    x = h.astype(np.float32).view(np.uint32).astype(np.uint64).reshape(len(h), p.bands, p.rows)
    out = np.broadcast_to(np.arange(1, p.bands + 1, dtype=np.uint64), (len(h), p.bands)).copy()
    for i in range(p.rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + x[:, :, i])
    return out.view(np.int64)


def sketched(p: Params):  # noqa: ANN201
    """Of each text two hashes of its multiset and its bands; null without words."""
    of = pa.struct([("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def one(text: pa.Array) -> pa.Array:
        n = len(text)
        f1, f2, bands, some = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros((n, p.bands), np.int64), np.zeros(n, bool)
        data, offsets = utf8(text)
        for a, b in pieces(offsets):
            doc, shingle, count = weighted_shingles(data, offsets[a : b + 1], p.shingle)
            if not len(doc):
                continue
            first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            c = count.astype(np.uint64)
            own = doc[first]
            some[a + own] = True
            f1[a + own] = np.add.reduceat(mix(shingle + _ONE) * c, first)
            f2[a + own] = np.add.reduceat(mix(shingle ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * c, first)
            h = signatures(np.repeat(np.arange(len(first)), np.diff(np.append(first, len(doc)))), shingle, count, len(first), p.m, p.seed)
            bands[a + own] = band_hashes(h, p)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p.bands, pa.int32()), pa.array(bands.ravel(), pa.int64()))
        return pa.StructArray.from_arrays([pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists], fields=list(of), mask=pa.array(~some))

    return F.arrow_udf(one, RESULT)


def bag(text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode(), np.uint8)
    _, shingle, count = weighted_shingles(raw, np.array([0, len(raw)]), k)
    return shingle, count


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum() + b[1].sum()) - both)


def verified(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """Of distinct pairs (a, b) those whose multisets overlap enough.  Each piece of work has one a and about `members` of its b."""
    size = pairs.groupBy("a").agg(F.count("*").alias("n"))
    chunked = pairs.join(size, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / p.members)).alias("chunk"))
    wanted = chunked.select("a", "chunk", F.col("b").alias("doc_id")).unionByName(chunked.select("a", "chunk", F.col("a").alias("doc_id")).distinct())

    def compare(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = key[0].as_py()
        bags: dict = {}
        for batch in rows:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("t"), strict=True):
                bags.setdefault(i, []).append(bag(t.as_py(), p.shingle))
        hit = [i for i, own in bags.items() if i != a and max(jaccard(x, y) for x in bags[a] for y in own) >= p.threshold]
        yield pa.RecordBatch.from_arrays([pa.array([a] * len(hit), kind), pa.array(hit, kind)], ["a", "b"])

    own = texts.schema["doc_id"].dataType
    kind = to_arrow_type(own)
    return wanted.join(texts, "doc_id").select("a", "chunk", "doc_id", "t").groupBy("a", "chunk").applyInArrow(compare, T.StructType([T.StructField("a", own), T.StructField("b", own)]))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected edges (a, b), the component being its least node: alternating large and small stars."""
    tables = Written(edges.sparkSession)
    edges = tables.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "0")
    before = None
    for turn in itertools.count(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = tables.write(small.unionByName(least.select("a", F.col("m").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), str(turn))
        tables.drop(str(turn - 1))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
    raise AssertionError  # the loop ends when nothing changes


def near_duplicates(docs: DataFrame, p: Params = Params(), text: str = "text") -> DataFrame:
    """A row for each document that has an equal or similar one of lesser id in its group: doc_id and keep_id, the group's least id."""
    tuned(docs.sparkSession)
    texts = docs.select(id_of(docs), docs[text].cast("string").alias("t")).where("doc_id is not null and t is not null")
    # filtered after the checkpoint: before it the condition would be pushed below the sketches and make them twice, in two workers a task
    sketches = checkpointed(texts.select("doc_id", sketched(p)("t").alias("s"))).where("s is not null").select("doc_id", "s.*")
    equal = sketches.groupBy("f1", "f2").agg(F.min("doc_id").alias("keep"))
    copies = sketches.select("doc_id", "f1", "f2").join(equal, ["f1", "f2"]).where("doc_id <> keep").select(F.col("doc_id").alias("a"), F.col("keep").alias("b"))
    kept = sketches.join(equal, ["f1", "f2"]).where("doc_id = keep").select("doc_id", F.explode("bands").alias("band"))
    # bands are shuffled once; a bucket's least member is aggregated where they lie, and hash-joined to its members, so no task sorts or holds a bucket
    bands = kept.where("band is not null").repartition("band")
    hubs = bands.groupBy("band").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("other")).where("hub <> other").drop("other")
    buckets = checkpointed(bands.join(hubs.hint("shuffle_hash"), "band").select("doc_id", "band", "hub"))
    wanted = buckets.select("doc_id").distinct()
    candidates = checkpointed(texts.join(wanted, "doc_id", "left_semi"))
    stars = buckets.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    near = checkpointed(verified(stars, candidates, p))
    group = components(near)
    labelled = buckets.join(group.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "hub", "doc_id", F.coalesce("component", "doc_id").alias("g"))
    split = labelled.groupBy("band").agg(F.min("g").alias("g1"), F.max("g").alias("g2")).where("g1 <> g2").select("band")
    left = checkpointed(labelled.join(split, "band"))
    x = left.select("band", "hub", F.col("doc_id").alias("a"), F.col("g").alias("ga"))
    y = left.select("band", F.col("doc_id").alias("b"), F.col("g").alias("gb"))
    rest = x.join(y, "band").where("a < b and ga <> gb and a <> hub").select("a", "b").distinct()  # those with the hub are compared already
    again = checkpointed(verified(rest, candidates, p))
    grouped = components(near.unionByName(again).unionByName(copies))
    return grouped.select(F.col("node").alias("doc_id"), F.col("component").alias("keep_id"))


def remove(docs: DataFrame, p: Params = Params(), text: str = "text") -> DataFrame:
    """docs, all their columns, with one document of each group, and one row of each document."""
    gone = near_duplicates(docs, p, text).select(F.col("doc_id").alias("_gone"))
    out = docs.join(gone, id_of(docs) == gone["_gone"], "left_anti")
    repeated = checkpointed(docs.groupBy(docs["doc_id"].alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1 and _id is not null").select("_id"))
    if repeated.isEmpty():
        return out
    some = out.join(repeated, out["doc_id"] == repeated["_id"], "left_semi")
    order = Window.partitionBy("doc_id").orderBy(F.col(text).asc_nulls_last())
    one = some.select(F.struct("*").alias("_row"), "doc_id", text).withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select("_row.*")
    return out.join(repeated, out["doc_id"] == repeated["_id"], "left_anti").unionByName(one)
