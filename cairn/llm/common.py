"""What the text operators share: Arrow buffers as numpy arrays, mixing hashes, checkpoints, sampling."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import shipped
from ..sources.files import Files, scratch

#: Bytes of text in an Arrow batch.  Operators work on pieces of CHUNK_BYTES, so a worker's memory doesn't follow the batch.
BATCH_BYTES = 8 << 20
CHUNK_BYTES = 1 << 20


def tuned(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by bytes as well as by rows: documents differ in length by five orders of magnitude."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return shipped(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, in local mode, a temporary one."""
    sc = spark.sparkContext
    if not (folder := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(scratch(spark))
        folder = sc.getCheckpointDir()
    return folder  # type: ignore[return-value]


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the cluster's shared checkpoint folder, so that its lineage ends and lost executors don't matter."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Written:
    """Tables of a loop, as Parquet in the shared folder, until the application ends.

    A checkpoint ends a plan's lineage but keeps the constraints on its columns, which double with each round of a loop.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.files = spark, Files(spark)
        self.folder = self.files.temporary(f"{shared_folder(spark)}/loop-{uuid.uuid4().hex}")

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, name: str) -> None:
        self.files.delete(f"{self.folder}/{name}")


def utf8(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The array's UTF-8 bytes and the len(text) + 1 offsets of its values; nulls are empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = text.fill_null("")
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    _, offsets, data = text.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), ends


#: Values in a piece: their numbers fit into 16 bits.
PIECE_VALUES = 1 << 15


def pieces(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of values that hold up to `most` bytes, or one longer value, and PIECE_VALUES values."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = min(at + PIECE_VALUES, max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1))
        yield at, min(end, n)
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection on uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: True for bytes of words: anything but ASCII white space and controls.
_WORD = np.arange(256) > 32
_POW = None


def _powers(n: int) -> np.ndarray:
    """Odd multipliers' powers base**0..base**(n-1) modulo 2**64."""
    global _POW
    if _POW is None or len(_POW) < n:
        p = np.ones(max(n, 1 << 16), np.uint64)
        p[1:] = np.uint64(0x9E3779B97F4A7C15)
        _POW = np.multiply.accumulate(p)
    return _POW


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its value), words being runs of bytes above the space.  offsets start anywhere in data.

    A word's hash is a polynomial of its bytes modulo 2**64, mixed; it doesn't depend on where the word stands.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    own = data[lo:hi]
    if not len(own):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    on = np.zeros(len(own) + 2, np.int8)
    on[1:-1] = _WORD[own]
    edge = np.diff(on)
    cut = offsets[1:-1] - lo  # a word ends where its text does
    cut = cut[(cut > 0) & (cut < len(own))]
    cut = np.unique(cut[(on[cut] == 1) & (on[cut + 1] == 1)])  # empty texts end where others do
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(cut):
        starts, ends = np.sort(np.append(starts, cut)), np.sort(np.append(ends, cut))
    size = ends - starts
    doc = np.searchsorted(offsets - lo, starts, "right") - 1
    codes = own.astype(np.uint64) + np.uint64(1)
    power = _powers(int(size.max(initial=1)) + 1)
    # each byte times base**(its place in the word), summed over the word
    place = np.arange(len(own), dtype=np.int64)
    first = np.zeros(len(own), np.int64)
    first[starts] = np.diff(starts, prepend=0)
    place -= np.cumsum(first)
    np.clip(place, 0, len(power) - 1, out=place)
    codes *= power[place]
    total = np.zeros(len(own) + 1, np.uint64)
    np.cumsum(codes, out=total[1:])
    return mix(total[ends] - total[starts]), doc


def sample_per_class(df: DataFrame, key: str, label: str, per_class: int) -> DataFrame:
    """Up to per_class values of key for each label: those of least hash, whatever the partitions.

    Only these two columns are read.  Ranks are dense, so repeated rows have one; each partition passes on the rows of at most per_class values a label, and no others are shuffled.
    """
    w = Window.partitionBy(label).orderBy(F.xxhash64(F.col(key), F.lit(17)), F.col(key))
    few = df.select(key, label).where(F.col(key).isNotNull() & F.col(label).isNotNull())
    return few.withColumn("_n", F.dense_rank().over(w)).where(F.col("_n") <= per_class).drop("_n").distinct()


def id_of(df: DataFrame, name: str = "doc_id") -> Column:
    """The id as the results carry it: numbers as bigint, others as they are."""
    return (df[name].cast("long") if isinstance(df.schema[name].dataType, T.NumericType) else df[name]).alias(name)


def id_type(df: DataFrame, name: str = "doc_id") -> T.DataType:
    own = df.schema[name].dataType
    return T.LongType() if isinstance(own, (T.NumericType, T.NullType)) else own


def rows_of(df: DataFrame) -> list[Any]:
    """The rows of a result whose size doesn't follow the input."""
    return df.collect()
