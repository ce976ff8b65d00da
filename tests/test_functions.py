from __future__ import annotations

from decimal import Decimal

import pyspark.sql.functions as F
import pytest

from cairn import schema as S
from cairn.functions import masks, values
from cairn.functions.json import decode, encode

POINT = S.loads('[database]\nname="p"\n[custom_types.v]\nfields=[{name="x",type="i8"}]\n[enums.e]\nvariants=["a","b"]\n[tables.t]\nfields=[{name="u",type="u64"},{name="f",type="f32"},{name="l",type="[u8; 2]"},{name="v",type="v"},{name="e",type="e"},{name="n",type="i16",nullable=true}]\n')
GOOD = '{"u": 18446744073709551615, "f": 1.1, "l": [1, 255], "v": {"x": -128}, "e": 1, "n": null, "more": 1}'


def decoded(spark, text, wrap=False):
    value, fault = decode(F.col("j"), POINT, POINT.tables[0].fields, wrap)
    return spark.createDataFrame([(text,)], "j string").select(value.alias("v"), fault.alias("f")).first()


def test_decode(spark):
    r = decoded(spark, GOOD)
    assert r.f is None and r.v.u == Decimal(2**64 - 1) and r.v.l == [1, 255] and r.v.v.x == -128 and r.v.e == 1 and r.v.n is None
    assert r.v.f == pytest.approx(1.1)


@pytest.mark.parametrize(
    ("old", "new", "fault"),
    [
        ('"u": 18446744073709551615', '"u": 18446744073709551616', "u: out of range"),
        ('"u": 18446744073709551615', '"u": -1', "u: out of range"),
        ('"u": 18446744073709551615, ', "", "u: missing"),
        ("[1, 255]", "[1]", "l: not 2 long"),
        ("[1, 255]", "[1, 256]", "l[]: out of range"),
        ('{"x": -128}', '{"x": -129}', "v.x: out of range"),
        ('"e": 1', '"e": 2', "e: out of range"),
        ('"f": 1.1', '"f": "no"', "f: missing or of another kind"),
        ('"f": 1.1', '"f": null', "f: missing or of another kind"),
        (', "n": null', "", "n: missing"),
    ],
)
def test_faults(spark, old, new, fault):
    assert decoded(spark, GOOD.replace(old, new)).f == fault


def test_not_json(spark):
    assert decoded(spark, "[1]").f == decoded(spark, "x").f == "not a JSON object"


def test_wrapping(spark):
    r = decoded(spark, GOOD.replace("18446744073709551615", "18446744073709551617").replace("-128", "130"), wrap=True)
    assert r.f is None and r.v.u == 1 and r.v.v.x == -126


def test_encode(spark):
    r = spark.createDataFrame([(1.5, 2.5, 42, None)], "x float, y float, id long, n string").select(encode(["x", "y", "id", "n"]).alias("j")).first()
    assert r.j == '{"x":1.5,"y":2.5,"id":42,"n":null}'


def test_masks(spark):
    r = spark.range(1).select(masks.add(masks.empty(), 3).alias("a"), masks.remove(masks.add(masks.empty(), 3), 3).alias("b"), masks.contains(masks.bit(63), 63).alias("c"), masks.bit(63).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (8, 0, True, -(2**63)) and masks.of(63) == -(2**63) and masks.of(1, 2, 3) == 14
    with pytest.raises(ValueError, match="999"):
        masks.bit(999)


def test_chunks(spark):
    df = spark.createDataFrame([(1, "abcdefg"), (2, ""), (3, None), (4, "abc")], "k int, t string")
    assert sorted(map(tuple, values.chunks(df, "k", "t", 3).collect())) == [(1, 0, "abc"), (1, 1, "def"), (1, 2, "g"), (4, 0, "abc")]


@pytest.mark.parametrize("flags", [values.DELTA, values.SNAPSHOT | values.COMPRESSED, values.HEARTBEAT])
def test_frames(flags):
    frame = values.encode_frame(b"payload" * 9, flags)
    assert values.decode_frame(frame) == (b"payload" * 9, flags)
    for bad in (frame[:-1], b"X" + frame[1:], frame[:12] + bytes([frame[12] ^ 1]) + frame[13:], frame[:4] + b"\x09" + frame[5:], b""):
        with pytest.raises(ValueError):  # noqa: PT011
            values.decode_frame(bad)


def test_defaults(spark):
    df = spark.createDataFrame([(None, None, None, None)], "a int, b string, c boolean, d struct<x:double>")
    assert values.with_defaults(df).first().asDict(recursive=True) == {"a": 0, "b": "", "c": False, "d": {"x": 0.0}}


def test_ids_times_and_checksums(spark):
    r = spark.range(1).select(values.client_id().alias("u"), values.micros(F.timestamp_micros(F.lit(5))).alias("t"), values.checksum(F.lit("abc")).alias("c"), values.micros().alias("n")).first()
    assert len(r.u) == 36 and r.t == 5 and r.c == 891568578 and r.n > 10**15
