"""Entities, archetypes, membership and integrity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import masks


def entity_fold(ops: DataFrame) -> DataFrame:
    """ops (entity_id, seq, op of create_entity or delete_entity) to (entity_id, version, alive): deletes so far, and whether the last op is a create."""
    return ops.where(F.col("op").isin("create_entity", "delete_entity")).groupBy("entity_id").agg(
        F.count_if(F.col("op") == "delete_entity").alias("version"), (F.max_by("op", "seq") == "create_entity").alias("alive")
    )


def live(ops: DataFrame) -> DataFrame:
    return entity_fold(ops).where("alive").select("entity_id")


def entity_counts(ops: DataFrame) -> DataFrame:
    """created: all records ever made; alive: those not deleted."""
    created = F.count_if(F.col("op") == "create_entity")
    return ops.agg(created.alias("created"), (created - F.count_if(F.col("op") == "delete_entity")).alias("alive"))


class Allocator:
    """Ids from 1; a freed id is used again before a new one, last freed first, with its version one higher.  Serial by definition."""

    def __init__(self) -> None:
        self.free: list[int] = []
        self.versions: dict[int, int] = {}
        self.alive: set[int] = set()
        self.next = 1
        self.records = 0

    def create(self) -> int:
        if self.free:
            i = self.free.pop()
        else:
            i, self.next = self.next, self.next + 1
            self.versions[i] = 0
        self.alive.add(i)
        self.records += 1
        return i

    def delete(self, i: int) -> None:
        if i not in self.alive:
            raise KeyError(f"entity {i} not found")
        self.alive.remove(i)
        self.versions[i] += 1
        self.free.append(i)

    def get(self, i: int) -> tuple[int, int]:
        """(id, version) of a live entity."""
        if i not in self.alive:
            raise KeyError(f"entity {i} not found")
        return i, self.versions[i]


def archetypes(components: Mapping[int, DataFrame], key: str = "entity_id") -> DataFrame:
    """(entity_id, mask): one aggregation over the union of the tables' keys, combined before the shuffle."""
    keys = [df.select(df[key].cast("long").alias("entity_id"), masks.bit(t).alias("bit")) for t, df in sorted(components.items())]
    return reduce(DataFrame.unionByName, keys).groupBy("entity_id").agg(F.bit_or("bit").alias("mask"))


def in_archetype(entities: DataFrame, mask: int) -> DataFrame:
    """Entities of exactly this mask."""
    return entities.where(F.col("mask") == F.lit(mask))


def archetype_sizes(entities: DataFrame) -> DataFrame:
    return entities.groupBy("mask").agg(F.count("*").alias("entities"))


def composed(have: Sequence[DataFrame], lack: Sequence[DataFrame] = (), key: str = "entity_id") -> DataFrame:
    """Keys that are in all of `have` and in none of `lack`."""
    out = have[0].select(key).distinct()
    for df in have[1:]:
        out = out.join(df.select(key), key, "left_semi")
    for df in lack:
        out = out.join(df.select(key), key, "left_anti")
    return out


def by_archetype(df: DataFrame, entities: DataFrame, key: str = "entity_id") -> DataFrame:
    """df in an order that keeps an archetype's rows together."""
    return df.join(entities.select(F.col("entity_id").alias(key), "mask"), key, "left").repartitionByRange("mask", key).sortWithinPartitions("mask", key).drop("mask")


def dangling(df: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of df whose reference isn't null and has no row in parent."""
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col(parent_key).alias(column)), column, "left_anti")


def restricted(deleted: DataFrame, components: Sequence[DataFrame], key: str = "entity_id") -> DataFrame:
    """Of the entities to delete those that still have a row in a component."""
    held = reduce(DataFrame.union, (c.select(key) for c in components))
    return deleted.join(held, key, "left_semi")


def counts(components: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, rows)."""
    return reduce(DataFrame.union, (df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in components.items()))
