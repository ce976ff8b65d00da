"""Sharding by balanced label propagation over linked documents.

Documents that hold the same passage are linked.  Passages are whole lines of at least `least_chars` characters, and, wherever lines end, `gram` words
in a row: of any `window` neighbouring ones that of least hash is taken, so documents that share gram + window - 1 words in a row share a passage,
in near copies of edited lines and in quotations inside a line too.  A passage of words that stands in one and the same long line wherever it is
held is that line, and doesn't count again.  Each of a passage's documents is linked with the one before it by id and with the first, in parts of about `part` documents, and the parts' first ones with the passage's least id.  So links grow with
the documents that hold a passage, not with their square, and no document has many times more links than a part has documents.  A link's weight
is the sum of its passages' weights, 1 / (documents that hold it - 1).  Shards start as equal hash ranges of ids.  In every round each document
computes by a join over the links how much weight it has in every shard, and asks for the shard that has most if its own has less.  Only a half of the
documents may ask, by a hash that differs from round to round, so that neighbours don't swap places for ever.

Quotas bound what moves: as many documents go from shard s to t as come from t to s, best gain first, and beyond that a share, in proportion to
what is asked for, of the room that t has up to documents / shards * (1 + slack) and of what s can spare down to documents / shards *
(1 - slack).  Sizes so stay between these two in every round.  The rounds end when three in turn lower the cut weight by less than
`least_progress`, and the best assignment seen is returned.  Links stay where they are through all rounds, by their second document; a round shuffles shards
and one message a link, the driver sees at most shards ** 2 counts.

Words are what white space and controls separate.  Text without any is linked by its lines alone.

Defined results: null texts and texts that share no passage have no links and keep their first shard.  Rows of one doc_id are one document
with the passages of all.  Rows without doc_id get no shard and aren't in the result.  Ties between shards go to the lowest number, ties in gain to
the lower hash of the id.  With fewer documents than shards some are empty.  An empty table gives no rows.  Other columns aren't looked at.
"""

from __future__ import annotations

import itertools
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, checkpointed, id_of, mix, pieces, tuned, utf8, words


@dataclass(frozen=True)
class Params:
    shards: int = 16
    slack: float = 0.05
    least_chars: int = 40
    gram: int = 8  # words of a passage that isn't a line
    window: int = 8  # of these, one is taken; at most gram, so that none reaches into the next text
    rounds: int | None = None  # at most; by default progress alone ends them
    part: int = 10_000  # documents of a passage in one part
    least_progress: float = 0.01  # of the cut weight
    edges_per_task: int = 500_000
    seed: int = 9


def line_keys(own: np.ndarray, offsets: np.ndarray, least_chars: int) -> np.ndarray:
    """A key of each line's bytes, of 32 bits; 0 for lines of fewer characters."""
    seen = np.append(0, np.cumsum((own & 0xC0) != 0x80))
    ends = offsets[1:].copy()
    ends[(ends > offsets[:-1]) & (own[ends - 1] == 10)] -= 1
    out = np.zeros(len(ends), np.int64)
    raw = memoryview(own)
    for i in np.flatnonzero(seen[ends] - seen[offsets[:-1]] >= least_chars).tolist():
        a, b = int(offsets[i]), int(ends[i])
        out[i] = max(1, zlib.crc32(raw[a:b], b - a))
    return out


def winnowed(data: np.ndarray, offsets: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value's index, hash of its words, key of the long line that holds them all, 0 if none or several), each hash once, in order of the values."""
    none = np.zeros(0, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    own = np.ascontiguousarray(data[lo:hi])
    if not len(own):
        return none, none, none
    bounds = np.unique(np.concatenate([offsets - lo, np.flatnonzero(own == 10) + 1]))
    h, line = words(own, bounds)
    n = len(h) - p.gram + 1
    if n < 1:
        return none, none, none
    doc = (np.searchsorted(offsets - lo, bounds[:-1], "right") - 1)[line]
    g = np.zeros(n, np.uint64)
    for j in range(p.gram):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    g = mix(g) >> np.uint64(1)
    most = np.uint64(2**64 - 1)
    g[doc[:n] != doc[p.gram - 1 :]] = most  # gram - 1 of these end a text, so windows of at most gram see one text
    wide = np.full(n + 2 * p.window - 2, most, np.uint64)
    wide[p.window - 1 : p.window - 1 + n] = g
    least = wide[: n + p.window - 1].copy()
    for j in range(1, p.window):
        np.minimum(least, wide[j : j + len(least)], out=least)
    top = least[:n].copy()
    for j in range(1, p.window):
        np.maximum(top, least[j : j + n], out=top)
    at = np.flatnonzero((g == top) & (g != most))
    key = np.where(line[at] == line[at + p.gram - 1], line_keys(own, bounds, p.least_chars)[line[at]], 0)
    of, hashes = doc[at], g[at].view(np.int64)
    order = np.lexsort((key, hashes, of))
    of, hashes, key = of[order], hashes[order], key[order]
    new = np.append(True, (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1]))[: len(of)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(of))[: len(first)] - 1
    return of[first], hashes[first], np.where(key[first] == key[last], key[first], 0)


def grams(p: Params):  # noqa: ANN201
    def one(text: pa.Array) -> pa.Array:
        data, offsets = utf8(text)
        sizes, hashes, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in pieces(offsets):
            of, h, k = winnowed(data, offsets[a : b + 1], p)
            sizes.append(np.bincount(of, minlength=b - a))
            hashes.append(h)
            keys.append(k)
        ends = np.append(0, np.cumsum(np.concatenate(sizes))).astype(np.int32)
        line = np.concatenate(keys).astype(np.uint32).view(np.int32)
        values = pa.StructArray.from_arrays([pa.array(np.concatenate(hashes)), pa.array(line)], ["passage", "line"])
        return pa.ListArray.from_arrays(pa.array(ends), values)

    return F.arrow_udf(one, "array<struct<passage:bigint,line:int>>")


def passages(docs: DataFrame, p: Params, text: str = "text") -> DataFrame:
    """(doc_id, passage, line), each once: of long lines their hash and 0, of words in a row their hash and the key of the line that they stand in."""
    own = docs.select(id_of(docs), docs[text].cast("string").alias("t")).where("doc_id is not null")
    long_lines = F.array_distinct(F.filter(F.split("t", "\n"), lambda x: F.length(x) >= p.least_chars))
    lines = F.transform(long_lines, lambda x: F.struct(F.xxhash64(x, F.lit(p.seed)).alias("passage"), F.lit(0).alias("line")))
    both = F.concat(F.coalesce(lines, F.array().cast("array<struct<passage:bigint,line:int>>")), grams(p)("t"))
    every = own.select("doc_id", F.explode(both).alias("g")).select("doc_id", "g.*")
    repeated = checkpointed(own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if repeated.isEmpty():
        return every
    some = every.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "passage").agg(F.when(F.min("line") == F.max("line"), F.min("line")).otherwise(0).alias("line"))
    return every.join(repeated, "doc_id", "left_anti").unionByName(some)


def links(docs: DataFrame, p: Params = Params(), text: str = "text") -> DataFrame:
    """(a, b, weight), both ways.

    Passages are shuffled and sorted once, with their documents; only those that very many documents hold are shuffled again, in parts.
    """
    holds = passages(docs, p, text).repartition("passage")
    of = Window.partitionBy("passage").orderBy("doc_id")
    whole = of.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    about = {"first": F.min("doc_id").over(whole), "n": F.count("*").over(whole), "low": F.min("line").over(whole), "high": F.max("line").over(whole), "before": F.lag("doc_id").over(of)}
    held = holds.withColumns(about).where("n > 1 and (low <> high or low = 0)").drop("low", "high", "line")
    shared = Written(docs.sparkSession).write(held, "held")
    few = shared.where(F.col("n") <= p.part).withColumn("leader", F.col("first"))
    parted = shared.where(F.col("n") > p.part).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / p.part))).repartition("passage", "part")
    within = Window.partitionBy("passage", "part").orderBy("doc_id")
    many = parted.withColumns({"before": F.lag("doc_id").over(within), "leader": F.first("doc_id").over(within)}).drop("part")
    others = F.array("before", "leader", F.when(F.col("doc_id") == F.col("leader"), F.col("first")))
    one_way = few.unionByName(many).select(F.col("doc_id").alias("b"), F.explode(F.array_distinct(others)).alias("a"), (1 / (F.col("n") - 1)).alias("w"))
    summed = one_way.where("a is not null and a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("weight"))
    return summed.unionByName(summed.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def first_shards(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, shard): ids in order of a hash, cut into ranges that differ by at most one in size; by histogram, without one global sort."""
    ids = docs.select(id_of(docs)).where("doc_id is not null").distinct()
    hashed = ids.withColumn("h", F.xxhash64("doc_id", F.lit(p.seed))).withColumn("bucket", F.shiftright("h", 52))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over 4,096 buckets at most
    sizes = hashed.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    total = sizes.agg(F.sum("n").alias("total"))
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("h", "doc_id")) - 1
    placed = hashed.withColumn("nth", nth).join(F.broadcast(sizes.select("bucket", "start")), "bucket").crossJoin(F.broadcast(total))
    return placed.select("doc_id", F.floor((F.col("start") + F.col("nth")) * p.shards / F.col("total")).cast("int").alias("shard"))


def quotas(asked: dict[tuple[int, int], int], sizes: dict[int, int], least: int, most: int) -> dict[tuple[int, int], int]:
    """How many may move from s to t: what is exchanged, and a share of the room that t has and of what s can spare before the round."""
    even = {(s, t): min(n, asked.get((t, s), 0)) for (s, t), n in asked.items()}
    more = {k: n - even[k] for k, n in asked.items()}
    for side, left in ((1, {k: max(0, most - n) for k, n in sizes.items()}), (0, {k: max(0, n - least) for k, n in sizes.items()})):
        every: dict[int, int] = {}
        for k, n in more.items():
            every[k[side]] = every.get(k[side], 0) + n
        more = {k: n if every[k[side]] <= left.get(k[side], 0) else left.get(k[side], 0) * n // every[k[side]] for k, n in more.items()}
    return {k: even[k] + more[k] for k in asked}


def heard(edges: DataFrame, moving: DataFrame) -> DataFrame:
    """Of each document (a, own, to, gain, cut): its shard, the one of most weight, what that has more, and the weight in others.

    edges lie by b: each tells its a the shard of its b, and these messages are all that is shuffled of them.
    """
    parts = edges.rdd.getNumPartitions()
    said = edges.join(moving.select(F.col("doc_id").alias("b"), "shard"), "b").select("a", "shard", "weight").repartition(parts, "a")
    by_shard = said.groupBy("a", "shard").agg(F.round(F.sum("weight"), 9).alias("w"))  # so that the order of a sum doesn't decide ties
    known = by_shard.join(moving.select(F.col("doc_id").alias("a"), F.col("shard").alias("own")), "a")
    seen = known.groupBy("a", "own").agg(
        F.max(F.struct("w", (-F.col("shard")).alias("less"))).alias("top"),
        F.sum("w").alias("every"),
        F.coalesce(F.sum(F.when(F.col("shard") == F.col("own"), F.col("w"))), F.lit(0.0)).alias("mine"),
    )
    return seen.select("a", "own", (-F.col("top.less")).cast("int").alias("to"), (F.col("top.w") - F.col("mine")).alias("gain"), (F.col("every") - F.col("mine")).alias("cut"))


def shards(docs: DataFrame, p: Params = Params(), text: str = "text") -> DataFrame:
    """doc_id and shard, a row for each document."""
    spark = tuned(docs.sparkSession)
    tables = Written(spark)
    now = checkpointed(first_shards(docs, p))
    linked = tables.write(links(docs, p, text), "edges")
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, -(-linked.count() // p.edges_per_task)))
    # by b, and kept so on the executors' disks; what is lost with one is read again from the table
    edges = linked.repartition(parts, "b").persist(StorageLevel.DISK_ONLY)
    total = now.count()
    least, most = int(total * (1 - p.slack) / p.shards), max(int(total * (1 + p.slack) / p.shards), -(-total // p.shards))
    # linked documents alone move; for the others the rounds are of no account
    moving = checkpointed(now.join(edges.select(F.col("b").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    resting = now.join(moving.select("doc_id"), "doc_id", "left_anti")
    fixed = {r["shard"]: r["n"] for r in resting.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    best, best_cut, stale = moving, None, 0
    name = best_name = ""  # of the table of moving, and of best
    for turn in itertools.count():
        state = tables.write(heard(edges, moving), f"state-{turn}")
        may = (F.col("gain") > 1e-9) & (F.col("to") != F.col("own")) & (F.pmod(F.xxhash64("a", F.lit(p.seed + 1 + turn)), F.lit(2)) == 0)
        counts = state.groupBy("own", "to").agg(F.count_if(may).alias("asked"), F.count("*").alias("n"), F.sum("cut").alias("cut")).collect()  # at most shards ** 2 rows
        cut = sum(r["cut"] for r in counts)
        stale = stale + 1 if best_cut is not None and cut > best_cut * (1 - p.least_progress) else 0
        if best_cut is None or cut < best_cut:
            if best_name not in ("", name):
                tables.drop(best_name)
            best, best_name, best_cut = moving, name, cut
        if turn == p.rounds or not cut or stale >= 3:
            break
        sizes = {s: fixed.get(s, 0) + sum(r["n"] for r in counts if r["own"] == s) for s in range(p.shards)}
        allowed = quotas({(r["own"], r["to"]): r["asked"] for r in counts if r["asked"]}, sizes, least, most)
        if any(allowed.values()):  # else another half of the documents may ask in the next round
            quota = spark.createDataFrame([(s, t, n) for (s, t), n in allowed.items()], "own int, to int, quota long")
            nth = F.row_number().over(Window.partitionBy("own", "to").orderBy(F.desc("gain"), F.xxhash64("a", F.lit(p.seed)), "a"))
            moved = state.where(may).withColumn("nth", nth).join(F.broadcast(quota), ["own", "to"]).where("nth <= quota").select("a", F.col("to").alias("new"))
            moving = tables.write(state.select("a", "own").join(moved, "a", "left").select(F.col("a").alias("doc_id"), F.coalesce("new", "own").alias("shard")), f"moving-{turn}")
            if name not in ("", best_name):
                tables.drop(name)
            name = f"moving-{turn}"
        tables.drop(f"state-{turn}")
    edges.unpersist()
    return best.unionByName(resting)
