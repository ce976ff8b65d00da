"""The entities of a database: a table of (entity_id, version, alive, freed) with the last changes on top.

Ids count from 1.  A freed id is used again before a new one, last freed first, with its version one higher.  `freed` is the number of the op that freed an
id that isn't in use, so the free list is the table in descending order of it.  The driver holds the changes since the table was last
written and a page of the free list; neither grows with the number of entities.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTITIES = "entity_id bigint, version bigint, alive boolean, freed bigint"
OPS = "seq bigint, op string, entity_id bigint, timestamp bigint"


def fold(base: DataFrame, ops: DataFrame) -> DataFrame:
    """ENTITIES after ops (seq, op, entity_id); repeated ops count once."""
    own = ops.dropDuplicates(["seq"]).groupBy("entity_id").agg(F.count_if(F.col("op") == "delete_entity").alias("deletes"), F.max_by("op", "seq").alias("last"), F.max("seq").alias("at"))
    gone = F.col("last") == "delete_entity"
    both = base.join(own, "entity_id", "full_outer")
    return both.select(
        "entity_id",
        (F.coalesce("version", F.lit(0)) + F.coalesce("deletes", F.lit(0))).cast("long").alias("version"),
        F.when(F.col("last").isNull(), F.col("alive")).otherwise(~gone).alias("alive"),
        F.when(F.col("last").isNull(), F.col("freed")).when(gone, F.col("at")).alias("freed"),
    )


class Registry:
    PAGE = 1000  # free ids fetched at once

    def __init__(self, spark: SparkSession, base: DataFrame | None = None, seq: int = 0, created: int = 0) -> None:
        self.spark = spark
        self.seq, self.created = seq, created  # ops and creations so far
        self.pending: list[tuple[int, str, int]] = []  # ops that aren't logged yet: seq, op, entity
        self.rebase(base)

    def rebase(self, base: DataFrame | None) -> None:
        """base holds all changes so far."""
        self.base = base
        self.changed: dict[int, tuple[int, bool, int | None]] = {}  # entity: version, alive, freed
        self.free: list[int] = []  # freed since, last freed at the end
        self.page: list[int] = []  # of the table's free list, to be used from the end
        self.below: int | None = None  # of the table's free list, ids freed before this op are still to be fetched
        found = base.agg(F.max("entity_id").alias("top"), F.count_if(~F.col("alive")).alias("free")).first() if base is not None else None
        self.next = (found["top"] or 0) + 1 if found else 1
        self.more = bool(found and found["free"])

    def _known(self, ids: Iterable[int]) -> dict[int, tuple[int, bool, int | None]]:
        """(version, alive, freed) of those of ids that were ever made."""
        ids = list(dict.fromkeys(ids))
        out = {i: self.changed[i] for i in ids if i in self.changed}
        rest = [i for i in ids if i not in out]
        if rest and self.base is not None:
            rows = self.base.where(F.col("entity_id").isin(rest)) if len(rest) <= 100 else self.base.join(self.spark.createDataFrame([(i,) for i in rest], "entity_id long"), "entity_id", "left_semi")
            out |= {r["entity_id"]: (r["version"], r["alive"], r["freed"]) for r in rows.collect()}
        return out

    def missing(self, ids: Iterable[int]) -> list[int]:
        """Those of ids that aren't in use."""
        ids = list(dict.fromkeys(ids))
        known = self._known(ids)
        return [i for i in ids if i not in known or not known[i][1]]

    def get(self, i: int) -> tuple[int, int]:
        """(id, version) of an entity in use."""
        known = self._known([i])
        if i not in known or not known[i][1]:
            raise KeyError(f"entity {i} not found")
        return i, known[i][0]

    def _pop(self) -> int | None:
        if self.free:
            return self.free.pop()
        if not self.page and self.more:
            rows = self.base.where("not alive" if self.below is None else f"not alive and freed < {self.below}").orderBy(F.desc("freed")).limit(self.PAGE).collect()  # type: ignore[union-attr]
            self.more = len(rows) == self.PAGE
            if rows:
                self.below = rows[-1]["freed"]
                self.page = [r["entity_id"] for r in reversed(rows)]
                self.changed |= {r["entity_id"]: (r["version"], False, r["freed"]) for r in rows}
        return self.page.pop() if self.page else None

    def _log(self, op: str, i: int) -> None:
        self.pending.append((self.seq, op, i))
        self.seq += 1

    def create(self) -> int:
        i = self._pop()
        if i is None:
            i, self.next = self.next, self.next + 1
        self.changed[i] = (self.changed[i][0] if i in self.changed else 0, True, None)
        self.created += 1
        self._log("create_entity", i)
        return i

    def delete(self, i: int) -> None:
        _, version = self.get(i)
        self.changed[i] = (version + 1, False, self.seq)
        self.free.append(i)
        self._log("delete_entity", i)

    def frame(self) -> DataFrame:
        """ENTITIES as they are now."""
        top = self.spark.createDataFrame([(i, *x) for i, x in self.changed.items()], ENTITIES)
        if self.base is None:
            return top
        return self.base.join(F.broadcast(top.select("entity_id")), "entity_id", "left_anti").unionByName(top)

    def alive(self) -> DataFrame:
        return self.frame().where("alive").select("entity_id")

    def counts(self) -> tuple[int, int]:
        """(created, alive)."""
        return self.created, self.alive().count()


def of_rows(keys: DataFrame) -> DataFrame:
    """ENTITIES for a store without a registry: those that have a row."""
    return keys.distinct().select(F.col("entity_id").cast("long").alias("entity_id"), F.lit(0).cast("long").alias("version"), F.lit(True).alias("alive"), F.lit(None).cast("long").alias("freed"))


def free_order(entities: DataFrame) -> DataFrame:
    """(entity_id, version, place) of ids not in use, place 1 being used next.  Ranks are kept by range of `freed` and carried over, so no task sorts the whole list."""
    free = entities.where(~F.col("alive")).select("entity_id", "version", "freed").withColumn("part", F.floor(F.col("freed") / 65536))
    sizes = free.groupBy("part").agg(F.count("*").alias("n"))
    later = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("later"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("freed")))
    return free.withColumn("nth", nth).join(F.broadcast(later), "part").select("entity_id", "version", (F.col("later") + F.col("nth")).alias("place"))
