from __future__ import annotations

import pytest
from pyspark.sql import types as T

from cairn import schema as S
from cairn.config import Config
from cairn.plans.catalogue import GAME


def fields(*rows):
    return tuple(S.Field(n, S.parse_type(t), **more) for n, t, more in rows)


BASE = S.Table("entities", fields(("uid", "u64", {"primary_key": True}), ("name", "u32", {})))


def with_field(*row):
    return S.Schema("x", tables=(BASE, S.Table("components", fields(row))))


@pytest.mark.parametrize(
    ("schema", "message"),
    [
        (with_field("ref", "u64", {"foreign_key": "nothing.uid"}), "unknown table"),
        (with_field("ref", "u64", {"foreign_key": "entities.nothing"}), "unknown field"),
        (with_field("ref", "u32", {"foreign_key": "entities.name"}), "not primary key"),
        (with_field("ref", "u32", {"foreign_key": "entities.uid"}), "type mismatch"),
        (with_field("list", "[u8; 0]", {}), "Array length must be >0"),
        (with_field("list", "[[u8; 0]; 2]", {}), "Array length must be >0"),
        (S.Schema("x", tables=(S.Table("id"),)), "reserved"),
        (with_field("id", "u8", {}), "reserved"),
        (S.Schema("x", tables=(BASE, BASE)), "Duplicate table name"),
        (S.Schema("x", tables=(S.Table("t", fields(("a", "u8", {}), ("a", "u8", {}))),)), "Duplicate field name"),
        (with_field("a", "nothing", {}), "unknown type"),
        (S.Schema("x", tables=(S.Table("p", fields(("a", "u8", {}))), S.Table("c", fields(("r", "u8", {"foreign_key": "p"}))))), "no primary key"),
    ],
)
def test_faults(schema, message):
    with pytest.raises(S.SchemaError, match=message):
        S.validate(schema)


def test_good_references():
    S.validate(with_field("ref", "u64", {"foreign_key": "entities.uid"}))
    S.validate(with_field("ref", "u64", {"foreign_key": "entities"}))


@pytest.mark.parametrize("text", ["", "name =", "[tables.a]", '[database]\nversion = "1"', '[database]\nname="a"\n[tables.t]\nfields=[{name="a"}]'])
def test_unreadable(text):
    with pytest.raises(S.SchemaError):
        S.loads(text)


def test_reserved_names_only_warn_when_loading():
    text = '[database]\nname = "g"\n[tables.health]\nfields = [{name = "entity_id", type = "u64"}, {name = "hp", type = "u32"}]\n[tables.empty]\n'
    with pytest.warns(UserWarning, match="entity_id"):
        s = S.loads(text)
    assert [t.name for t in s.tables] == ["empty", "health"] and s.version == "1.0.0" and s.find("empty").fields == ()
    with pytest.raises(S.SchemaError):
        S.loads(text, strict_names=True)


def test_types():
    s = S.loads(GAME)
    t = S.struct_type(s, s.find("body").fields)
    assert t["at"].dataType == T.StructType([T.StructField(n, T.FloatType(), False, {}) for n in "xyz"]) or [f.name for f in t["at"].dataType.fields] == ["x", "y", "z"]
    assert t["slots"].dataType == T.ArrayType(T.ArrayType(T.IntegerType(), False), False)
    assert t["side"].dataType == T.LongType() and not t["mass"].nullable and t["mass"].metadata["type"] == "f64"
    assert S.spark_type(s, S.parse_type("u64")) == T.DecimalType(20, 0)
    with pytest.raises(S.SchemaError):
        S.parse_type("[u8 3]")


def test_layout():
    s = S.Schema("x")
    assert S.layout(s, fields(("a", "u32", {}), ("b", "u64", {}))) == ([("a", 0, 4, 4), ("b", 8, 8, 8)], 16)
    assert S.layout(s, fields(("arr", "[u32; 3]", {})))[1] == 12
    assert S.layout(s, fields(("a", "u64", {}), ("b", "u8", {})))[1] == 16


def test_migration(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    out = S.migrate(df, [{"op": "add_field", "name": "c", "type": "double", "default": 1.5}, {"op": "add_index", "name": "a"}, {"op": "drop_field", "name": "b"}])
    assert out.collect()[0].asDict() == {"a": 1, "c": 1.5}
    for step in ({"op": "drop_field", "name": "x"}, {"op": "add_field", "name": "a", "type": "int"}, {"op": "rename"}):
        with pytest.raises(S.SchemaError):
            S.migrate(df, [step])


def test_config(tmp_path):
    c = Config(keep_snapshots=5, data_dir="/d/", compact_ratio=0.5)
    c.save(tmp_path / "c.toml")
    assert Config.load(tmp_path / "c.toml", {}) == c and c.path("log_dir") == "/d/log"
    assert Config.load(tmp_path / "c.toml", {"CAIRN_KEEP_SNAPSHOTS": "7"}).keep_snapshots == 7
    assert Config.load(None, {}) == Config()
    (tmp_path / "bad.toml").write_text("nothing = 1\n")
    with pytest.raises(ValueError, match="nothing"):
        Config.load(tmp_path / "bad.toml", {})
