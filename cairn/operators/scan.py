"""Scans, predicates, search, paging and joins over component tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.json import encode
from ..schema import Schema

Operator = Literal["=", "!=", ">", "<", ">=", "<=", "LIKE", "IN", "IS NULL"]


def point(df: DataFrame, key: str, value: Any) -> DataFrame:
    """The row of a key; the comparison reaches the Parquet scan."""
    return df.where(F.col(key) == F.lit(value))


def page(df: DataFrame, key: str, limit: int, offset: int = 0) -> DataFrame:
    """Rows offset..offset + limit in order of key; past the end there are none."""
    return df.orderBy(key).offset(max(0, offset)).limit(max(0, limit))


def page_after(df: DataFrame, key: str, limit: int, after: Any = None) -> DataFrame:
    """The `limit` rows next in order of key after `after`: unlike an offset, a deep page reads what a first one does."""
    return (df if after is None else df.where(F.col(key) > F.lit(after))).orderBy(key).limit(max(0, limit))


def ui_page(df: DataFrame, key: str, number: int, size: int = 20) -> DataFrame:
    """Page `number`, from 1."""
    return page(df, key, size, (max(1, number) - 1) * size)


def page_json(df: DataFrame, key: str, limit: int, offset: int = 0) -> DataFrame:
    """(key, json) of a page."""
    return page(df, key, limit, offset).select(key, encode([c for c in df.columns if c != key]).alias("json"))


def predicate(column: str | Column, op: Operator, value: Any = None) -> Column:
    """A typed comparison: values are literals, never text that is parsed."""
    c = F.col(column) if isinstance(column, str) else column
    match op:
        case "=":
            return c == F.lit(value)
        case "!=":
            return c != F.lit(value)
        case ">":
            return c > F.lit(value)
        case "<":
            return c < F.lit(value)
        case ">=":
            return c >= F.lit(value)
        case "<=":
            return c <= F.lit(value)
        case "LIKE":
            return c.like(value)
        case "IN":
            return c.isin(*value)
        case "IS NULL":
            return c.isNull()
    raise ValueError(f"unknown operator {op}")


def conjunction(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def search(df: DataFrame, query: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows where any column contains the query: strings whatever the case, numbers by their text.  An empty query keeps all."""
    if not query:
        return df
    hits = []
    for f in df.schema:
        if columns is not None and f.name not in columns:
            continue
        if isinstance(f.dataType, T.StringType):
            hits.append(F.contains(F.lower(df[f.name]), F.lit(query.lower())))
        elif isinstance(f.dataType, T.NumericType):
            hits.append(F.contains(df[f.name].cast("string"), F.lit(query)))
    return df.where(F.coalesce(reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), hits, F.lit(False)), F.lit(False)))


@dataclass
class Query:
    """What the query builder holds: tables, fields "table.field", joins, conditions joined by AND."""

    tables: dict[str, DataFrame]
    source: list[str]
    fields: list[str] = field(default_factory=list)
    joins: list[tuple[str, str, str, str]] = field(default_factory=list)  # kind, table, left field, right field
    conditions: list[tuple[str, Operator, Any]] = field(default_factory=list)
    schema: Schema | None = None  # whose foreign keys join_linked() follows
    groups: list[str] = field(default_factory=list)
    aggregates: list[Column] = field(default_factory=list)
    order: list[tuple[str, bool]] = field(default_factory=list)  # column, whether descending
    most: int | None = None
    skip: int = 0

    def link(self, a: str, b: str) -> tuple[str, str]:
        """The fields by which a foreign key of one table refers to the other, a's first; an error if there are several or none."""
        if self.schema is None:
            raise ValueError("foreign keys need a schema")
        found = []
        for own, other in ((a, b), (b, a)):
            for f in self.schema.find(own).fields:  # type: ignore[union-attr]
                table, _, column = (f.foreign_key or "").partition(".")
                if table == other:
                    to = column or self.schema.find(other).keys[0].name  # type: ignore[union-attr]
                    found.append((f"{own}.{f.name}", f"{other}.{to}") if own == a else (f"{other}.{to}", f"{own}.{f.name}"))
        if len(found) != 1:
            raise ValueError(f"{len(found)} foreign keys link {a} and {b}")
        return found[0]

    def join_linked(self, table: str, to: str | None = None, kind: str = "inner") -> Query:
        """Joins a table by the foreign key that links it with `to`, by default with the one table at hand that it is linked with."""
        at_hand = [*self.source, *(t for _, t, _, _ in self.joins)]
        links = []
        for t in [to] if to else at_hand:
            try:
                links.append(self.link(t, table))
            except ValueError:
                if to:
                    raise
        if len(links) != 1:
            raise ValueError(f"{table} is linked with {len(links)} of {', '.join(at_hand)}")
        return self.join(table, *links[0], kind)

    def order_by(self, column: str, descending: bool = False) -> Query:
        self.order.append((column, descending))
        return self

    def limit(self, n: int, offset: int = 0) -> Query:
        self.most, self.skip = n, offset
        return self

    def group_by(self, *fields: str, **aggregates: Column) -> Query:
        self.groups += fields
        self.aggregates += [c.alias(n) for n, c in aggregates.items()]
        return self

    def join(self, table: str, left: str, right: str, kind: str = "inner") -> Query:
        if kind.lower() not in ("inner", "left", "right"):
            raise ValueError(f"unknown join {kind}")
        self.joins.append((kind.lower(), table, left, right))
        return self

    def where(self, column: str, op: Operator, value: Any = None) -> Query:
        self.conditions.append((column, op, value))
        return self

    def select(self, *fields: str) -> Query:
        self.fields += fields
        return self

    def build(self) -> DataFrame:
        """Several source tables are a cross product, which Catalyst turns into a join on the conditions; no fields are all fields."""
        df = reduce(lambda a, b: a.crossJoin(b), (self.tables[t].alias(t) for t in self.source))
        for kind, table, left, right in self.joins:
            df = df.join(self.tables[table].alias(table), F.col(left) == F.col(right), kind)
        if self.conditions:
            df = df.where(conjunction(predicate(c, o, F.col(v[1:]) if isinstance(v, str) and v.startswith("@") else v) for c, o, v in self.conditions))
        if self.groups or self.aggregates:
            df = df.groupBy(*self.groups).agg(*self.aggregates)
        if self.order:  # before the projection, which may not have the columns
            df = df.orderBy(*(F.col(c).desc() if d else F.col(c).asc() for c, d in self.order))
        if self.skip:
            df = df.offset(self.skip)
        if self.most is not None:
            df = df.limit(self.most)
        return df.select(*self.fields) if self.fields else df


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """A top-k: each partition keeps its n best, nothing is sorted whole."""
    return df.orderBy(*order).limit(n)
