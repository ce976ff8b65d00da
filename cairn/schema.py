"""Component schemas: TOML to Spark types, validation, record layout, migration."""

from __future__ import annotations

import tomllib
import warnings
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SchemaError(ValueError):
    """A schema that can't be read or isn't valid."""


#: Name: bytes, Spark type, least and greatest value of the unsigned ones, which Spark holds in a wider type.
PRIMITIVES: dict[str, tuple[int, T.DataType, int | None, int | None]] = {
    "u8": (1, T.ShortType(), 0, 2**8 - 1),
    "u16": (2, T.IntegerType(), 0, 2**16 - 1),
    "u32": (4, T.LongType(), 0, 2**32 - 1),
    "u64": (8, T.DecimalType(20, 0), 0, 2**64 - 1),
    "i8": (1, T.ByteType(), -(2**7), 2**7 - 1),
    "i16": (2, T.ShortType(), -(2**15), 2**15 - 1),
    "i32": (4, T.IntegerType(), -(2**31), 2**31 - 1),
    "i64": (8, T.LongType(), -(2**63), 2**63 - 1),
    "f32": (4, T.FloatType(), None, None),
    "f64": (8, T.DoubleType(), None, None),
    "bool": (1, T.BooleanType(), None, None),
}
RESERVED = ("id", "version", "entity_id", "table", "schema", "database")


@dataclass(frozen=True)
class FieldType:
    """A primitive or a name to look up; an array if it has an item."""

    name: str = ""
    item: FieldType | None = None
    length: int = 0

    def __str__(self) -> str:
        return f"[{self.item}; {self.length}]" if self.item else self.name


@dataclass(frozen=True)
class Field:
    name: str
    type: FieldType
    nullable: bool = False
    indexed: bool = False
    primary_key: bool = False
    foreign_key: str | None = None


@dataclass(frozen=True)
class Table:
    name: str
    fields: tuple[Field, ...] = ()
    parent: str | None = None
    description: str | None = None

    @property
    def keys(self) -> list[Field]:
        return [f for f in self.fields if f.primary_key]


@dataclass(frozen=True)
class Schema:
    name: str
    version: str = "1.0.0"
    tables: tuple[Table, ...] = ()
    custom_types: dict[str, tuple[Field, ...]] = field(default_factory=dict)
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def find(self, name: str) -> Table | None:
        return next((t for t in self.tables if t.name == name), None)


def parse_type(text: str) -> FieldType:
    """A primitive's name, "[type; length]", nested too, or the name of a custom type or an enum."""
    text = text.strip()
    if not text.startswith("["):
        if not text:
            raise SchemaError("empty type")
        return FieldType(text)
    if not text.endswith("]") or ";" not in text:
        raise SchemaError(f"malformed array type {text}")
    item, _, length = text[1:-1].rpartition(";")
    if not length.strip().isdigit():
        raise SchemaError(f"malformed array length in {text}")
    return FieldType(item=parse_type(item), length=int(length))


def parse_fields(rows: Iterable[dict[str, Any]] | None) -> tuple[Field, ...]:
    out = []
    for r in rows or ():
        for need in ("name", "type"):
            if need not in r:
                raise SchemaError(f"field without {need}")
        out.append(Field(r["name"], parse_type(r["type"]), r.get("nullable", False), r.get("indexed", False), r.get("primary_key", False), r.get("foreign_key")))
    return tuple(out)


def loads(text: str, strict_names: bool = False) -> Schema:
    """The schema in a TOML string, validated; reserved names only warn unless strict_names."""
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise SchemaError(f"not TOML: {e}") from e
    if "database" not in raw:
        raise SchemaError("missing [database]")
    if "name" not in raw["database"]:
        raise SchemaError("missing database name")
    schema = Schema(
        raw["database"]["name"],
        raw["database"].get("version", "1.0.0"),
        tuple(Table(n, parse_fields(t.get("fields")), t.get("parent_table"), t.get("description")) for n, t in sorted(raw.get("tables", {}).items())),
        {n: parse_fields(t.get("fields")) for n, t in raw.get("custom_types", {}).items()},
        {n: tuple(t.get("variants", ())) for n, t in raw.get("enums", {}).items()},
    )
    return validate(schema, strict_names)


def load(path: str | Path, strict_names: bool = False) -> Schema:
    return loads(Path(path).read_text(encoding="utf-8"), strict_names)


def validate(schema: Schema, strict_names: bool = True) -> Schema:
    """The schema, if foreign keys, array lengths, names and types hold; the first fault is raised."""
    for t in schema.tables:
        for f in t.fields:
            if f.foreign_key:
                _check_reference(schema, t, f)
    for t in schema.tables:
        for f in t.fields:
            _check_length(t.name, f.name, f.type)
    for name, fields in schema.custom_types.items():
        for f in fields:
            _check_length(name, f.name, f.type)
    taken = [(n, what) for t in schema.tables for n, what in [(t.name, "table"), *((f.name, f"field of {t.name}") for f in t.fields)] if n in RESERVED]
    if taken and strict_names:
        raise SchemaError(f"{taken[0][0]} is a reserved name ({taken[0][1]})")
    if taken:
        warnings.warn(f"reserved names: {', '.join(sorted({n for n, _ in taken}))}", stacklevel=2)
    _check_unique([t.name for t in schema.tables], "table name")
    for t in schema.tables:
        _check_unique([f.name for f in t.fields], "field name")
        for f in t.fields:
            resolve(schema, f.type)
    return schema


def _check_reference(schema: Schema, t: Table, f: Field) -> None:
    table, _, column = (f.foreign_key or "").partition(".")
    target = schema.find(table)
    if target is None:
        raise SchemaError(f"{t.name}.{f.name} refers to unknown table {table}")
    if not column:
        if not target.keys:
            raise SchemaError(f"{t.name}.{f.name} refers to {table}, which has no primary key")
        other = target.keys[0]
    else:
        other = next((x for x in target.fields if x.name == column), None)
        if other is None:
            raise SchemaError(f"{t.name}.{f.name} refers to unknown field {table}.{column}")
        if not other.primary_key:
            raise SchemaError(f"{table}.{column} is not primary key")
    if not compatible(f.type, other.type):
        raise SchemaError(f"type mismatch: {t.name}.{f.name} is {f.type}, {table}.{other.name} is {other.type}")


def compatible(a: FieldType, b: FieldType) -> bool:
    """Structural equality."""
    return a == b


def _check_length(owner: str, name: str, t: FieldType) -> None:
    if t.item:
        if t.length <= 0:
            raise SchemaError(f"Array length must be >0: {owner}.{name}")
        _check_length(owner, name, t.item)


def _check_unique(names: list[str], what: str) -> None:
    seen: set[str] = set()
    for n in names:
        if n in seen:
            raise SchemaError(f"Duplicate {what} {n}")
        seen.add(n)


def resolve(schema: Schema, t: FieldType) -> str:
    """What a type is: primitive, array, struct or enum.  Custom types come before enums."""
    if t.item:
        resolve(schema, t.item)
        return "array"
    if t.name in PRIMITIVES:
        return "primitive"
    if t.name in schema.custom_types:
        return "struct"
    if t.name in schema.enums:
        return "enum"
    raise SchemaError(f"unknown type {t.name}")


def spark_type(schema: Schema, t: FieldType) -> T.DataType:
    kind = resolve(schema, t)
    if kind == "array":
        return T.ArrayType(spark_type(schema, t.item), False)  # type: ignore[arg-type]
    if kind == "primitive":
        return PRIMITIVES[t.name][1]
    return T.LongType() if kind == "enum" else struct_type(schema, schema.custom_types[t.name])


def struct_type(schema: Schema, fields: Iterable[Field]) -> T.StructType:
    return T.StructType([T.StructField(f.name, spark_type(schema, f.type), f.nullable, {"primary_key": f.primary_key, "indexed": f.indexed, "foreign_key": f.foreign_key, "type": str(f.type)}) for f in fields])


def size_and_alignment(schema: Schema, t: FieldType) -> tuple[int, int]:
    """Bytes of a value in a C record."""
    kind = resolve(schema, t)
    if kind == "array":
        size, align = size_and_alignment(schema, t.item)  # type: ignore[arg-type]
        return size * t.length, align
    if kind == "primitive":
        return (PRIMITIVES[t.name][0],) * 2
    if kind == "enum":
        return 4, 4
    rows, total = layout(schema, schema.custom_types[t.name])
    return total, max((r[3] for r in rows), default=1)


def layout(schema: Schema, fields: Iterable[Field]) -> tuple[list[tuple[str, int, int, int]], int]:
    """((field, offset, size, alignment) of each, total size) as a C compiler lays out a struct."""
    rows, at, most = [], 0, 1
    for f in fields:
        size, align = size_and_alignment(schema, f.type)
        at = -(-at // align) * align
        rows.append((f.name, at, size, align))
        at += size
        most = max(most, align)
    return rows, -(-at // most) * most


def layout_report(spark: SparkSession, schema: Schema) -> DataFrame:
    rows = [(t.name, *r) for t in schema.tables for r in layout(schema, t.fields)[0]]
    return spark.createDataFrame(rows, "table_name string, field string, offset int, size int, alignment int")


def schema_report(spark: SparkSession, schema: Schema) -> DataFrame:
    rows = [(t.name, f.name, str(f.type), f.nullable, f.indexed, f.primary_key, f.foreign_key) for t in schema.tables for f in t.fields]
    return spark.createDataFrame(rows, "table_name string, field string, type string, nullable boolean, indexed boolean, primary_key boolean, foreign_key string")


def migrate(df: DataFrame, steps: Iterable[dict[str, Any]]) -> DataFrame:
    """df after add_field (name, type as Spark DDL, default), drop_field (name) and add_index, which changes nothing."""
    for s in steps:
        if s["op"] == "add_field":
            if s["name"] in df.columns:
                raise SchemaError(f"Duplicate field name {s['name']}")
            df = df.withColumn(s["name"], F.lit(s.get("default")).cast(s["type"]))
        elif s["op"] == "drop_field":
            if s["name"] not in df.columns:
                raise SchemaError(f"unknown field {s['name']}")
            df = df.drop(s["name"])
        elif s["op"] != "add_index":
            raise SchemaError(f"unknown migration {s['op']}")
    return df
