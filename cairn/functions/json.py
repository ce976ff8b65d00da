"""Rows to JSON and back.  Decoding is strict: each field has to be there, of its kind and in its range; further keys are ignored."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import PRIMITIVES, Field, FieldType, Schema, resolve


def encode(columns: Iterable[str | Column]) -> Column:
    """A JSON object with a key for each column; nulls are written."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _wide(schema: Schema, t: FieldType) -> T.DataType:
    """What JSON is parsed as before ranges are looked at."""
    kind = resolve(schema, t)
    if kind == "array":
        return T.ArrayType(_wide(schema, t.item))  # type: ignore[arg-type]
    if kind == "struct":
        return T.StructType([T.StructField(f.name, _wide(schema, f.type)) for f in schema.custom_types[t.name]])
    if kind == "enum" or PRIMITIVES[t.name][2] is not None:
        return T.DecimalType(38, 0)
    return T.DoubleType() if t.name == "f32" else PRIMITIVES[t.name][1]


def _fault(schema: Schema, t: FieldType, c: Column, path: str, nullable: bool = False) -> Column:
    """What is wrong with a parsed value; null if nothing."""
    kind = resolve(schema, t)
    faults = [] if nullable else [F.when(c.isNull(), F.lit(f"{path}: missing or of another kind"))]
    if kind == "array":
        faults.append(F.when(F.size(c) != t.length, F.lit(f"{path}: not {t.length} long")))
        inner = F.filter(F.transform(c, lambda x: _fault(schema, t.item, x, f"{path}[]")), lambda x: x.isNotNull())  # type: ignore[arg-type]
        faults.append(F.when(F.size(inner) > 0, F.element_at(inner, 1)))
    elif kind == "struct":
        faults += [_fault(schema, f.type, c[f.name], f"{path}.{f.name}", f.nullable) for f in schema.custom_types[t.name]]
    else:
        low, high = (0, len(schema.enums[t.name]) - 1) if kind == "enum" else PRIMITIVES[t.name][2:]
        if low is not None:
            faults.append(F.when((c < F.lit(str(low)).cast("decimal(38,0)")) | (c > F.lit(str(high)).cast("decimal(38,0)")), F.lit(f"{path}: out of range")))
    return F.coalesce(*faults) if faults else F.lit(None).cast("string")


def _narrow(schema: Schema, t: FieldType, c: Column, wrap: bool) -> Column:
    kind = resolve(schema, t)
    if kind == "array":
        return F.transform(c, lambda x: _narrow(schema, t.item, x, wrap))  # type: ignore[arg-type]
    if kind == "struct":
        return F.when(c.isNotNull(), F.struct(*(_narrow(schema, f.type, c[f.name], wrap).alias(f.name) for f in schema.custom_types[t.name])))
    if kind == "enum":
        return c.try_cast("long")
    low = PRIMITIVES[t.name][2]
    if wrap and low is not None:
        span = F.lit(str(2 ** (8 * PRIMITIVES[t.name][0]))).cast("decimal(38,0)")
        start = F.lit(str(low)).cast("decimal(38,0)")
        c = F.pmod(c - start, span) + start
    return c.try_cast(PRIMITIVES[t.name][1])


def decode(column: Column, schema: Schema, fields: Iterable[Field], wrap: bool = False) -> tuple[Column, Column]:
    """(struct of the fields, what is wrong or null).  With wrap, integers out of range wrap around."""
    fields = list(fields)
    parsed = F.from_json(column, T.StructType([T.StructField(f.name, _wide(schema, f.type)) for f in fields]))
    keys = F.json_object_keys(column)
    faults = [F.when(keys.isNull(), F.lit("not a JSON object"))]
    for f in fields:
        faults.append(F.when(~F.array_contains(keys, f.name), F.lit(f"{f.name}: missing")))
        fault = _fault(schema, f.type, parsed[f.name], f.name, f.nullable)
        faults.append(F.when(~fault.endswith("out of range"), fault) if wrap else fault)
    value = F.struct(*(_narrow(schema, f.type, parsed[f.name], wrap).alias(f.name) for f in fields))
    return value, reduce(lambda a, b: F.coalesce(a, b), faults)
