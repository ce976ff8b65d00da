"""Defaults, checksums, chunks, frames, times."""

from __future__ import annotations

import struct
import zlib

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def default_of(t: T.DataType) -> Column:
    """Zero, false, the empty string, array or struct of defaults."""
    if isinstance(t, T.StringType):
        return F.lit("")
    if isinstance(t, T.BooleanType):
        return F.lit(False)
    if isinstance(t, T.ArrayType):
        return F.array().cast(t)
    if isinstance(t, T.StructType):
        return F.struct(*(default_of(f.dataType).alias(f.name) for f in t.fields))
    return F.lit(0).cast(t) if isinstance(t, T.NumericType) else F.lit(None).cast(t)


def with_defaults(df: DataFrame) -> DataFrame:
    return df.select(*(F.coalesce(df[f.name], default_of(f.dataType)).alias(f.name) for f in df.schema))


def checksum(column: Column) -> Column:
    """CRC32 of a string's or binary's bytes."""
    return F.crc32(column.cast("binary"))


def row_checksum(df: DataFrame) -> Column:
    """An aggregate that doesn't depend on the order of rows."""
    return F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")


def chunks(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, chunk, data): pieces of at most `size` characters; empty and null texts have none."""
    n = F.ceil(F.length(text) / size).cast("int")
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))
    return df.select(key, text, at.alias("chunk")).select(key, "chunk", F.substring(F.col(text), F.col("chunk") * size + 1, F.lit(size)).alias("data"))


def micros(column: Column | None = None) -> Column:
    """Microseconds since 1970, by default of now."""
    return F.unix_micros(F.current_timestamp() if column is None else column)


def client_id() -> Column:
    return F.uuid()


MAGIC, FRAME_VERSION = b"CRNF", 1
COMPRESSED, HEARTBEAT, SNAPSHOT, DELTA = 1, 2, 4, 8


def encode_frame(payload: bytes, flags: int = DELTA) -> bytes:
    """Magic, version, flags, big-endian length, payload, CRC32 of the payload as written."""
    if flags & COMPRESSED:
        payload = zstandard.compress(payload, 3)
    return MAGIC + struct.pack(">BBI", FRAME_VERSION, flags, len(payload)) + payload + struct.pack(">I", zlib.crc32(payload))


def decode_frame(frame: bytes) -> tuple[bytes, int]:
    """(payload, flags)."""
    if len(frame) < 14 or frame[:4] != MAGIC:
        raise ValueError("not a frame")
    version, flags, n = struct.unpack(">BBI", frame[4:10])
    if version != FRAME_VERSION:
        raise ValueError(f"frame version {version}")
    if len(frame) != 14 + n:
        raise ValueError("frame cut short")
    payload = frame[10 : 10 + n]
    if struct.unpack(">I", frame[10 + n :])[0] != zlib.crc32(payload):
        raise ValueError("frame checksum doesn't match")
    return (zstandard.decompress(payload) if flags & COMPRESSED else payload), flags
