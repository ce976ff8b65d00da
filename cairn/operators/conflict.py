"""Three-way merges of a client's ops with the server's state.

Client ops are (table_id, entity_id, op, old, new), the server's rows (table_id, entity_id, data).  An insert conflicts where the key
exists; an update or delete where the row exists and isn't the client's old image; entity ops never.  All ops of a delta are
compared with the state before it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .delta import ring

Strategy = Literal["server", "last_write", "custom"]


def detected(ops: DataFrame, server: DataFrame) -> DataFrame:
    """ops with the server's row as `current` and whether they conflict."""
    rows = server.select("table_id", "entity_id", F.col("data").alias("current"), F.lit(True).alias("_there"))
    stale = F.when(F.col("op") == "insert", True).when(F.col("op").isin("update", "delete"), ~F.col("current").eqNullSafe(F.col("old"))).otherwise(False)
    return ops.join(rows, ["table_id", "entity_id"], "left").withColumn("conflict", F.coalesce(F.col("_there"), F.lit(False)) & stale).drop("_there")


def resolved(found: DataFrame, strategy: Strategy = "server", merge: Callable[[Column, Column], Column] | None = None, by_time: tuple[str, str] | None = None) -> DataFrame:
    """The ops to apply: (table_id, entity_id, op, old, new, conflict).

    server: a conflicting write is rewritten with the server's value, a conflicting delete dropped.  last_write: the client's value, over the
    server's as old image; with by_time = (server's column, client's column) only where the client's time isn't earlier.  custom: merge(server,
    client) is written; a delete is applied.
    """
    c, write = F.col("conflict"), F.col("op").isin("insert", "update")
    if strategy == "custom":
        if merge is None:
            raise ValueError("custom merges need a function")
        new = F.when(c & write, merge(F.col("current"), F.col("new"))).otherwise(F.col("new"))
    elif strategy == "server":
        found = found.where(~(c & (F.col("op") == "delete")))
        new = F.when(c, F.col("current")).otherwise(F.col("new"))
    elif strategy == "last_write":
        new = F.col("new")
        if by_time:
            older = c & (F.col(by_time[1]) < F.col(by_time[0]))
            found = found.where(~(older & (F.col("op") == "delete")))
            new = F.when(older, F.col("current")).otherwise(new)
    else:
        raise ValueError(f"unknown strategy {strategy}")
    op = F.when(c & write, "update").otherwise(F.col("op"))
    return found.select("table_id", "entity_id", op.alias("op"), F.when(c, F.col("current")).otherwise(F.col("old")).alias("old"), new.alias("new"), "conflict")


def header(server_version: Column, server_ts: Column, client_ts: Column) -> tuple[Column, Column]:
    """(version, timestamp) of the resolved delta."""
    return server_version + 1, F.greatest(server_ts, client_ts)


def stamped(merged: DataFrame, server_version: str = "server_version", server_time: str = "server_time", client_time: str = "client_time") -> DataFrame:
    """Resolved ops with the version and timestamp of their delta."""
    version, at = header(F.col(server_version), F.col(server_time), F.col(client_time))
    return merged.withColumns({"version": version, "timestamp": at})


def fields(found: DataFrame, *names: str) -> DataFrame:
    """(table_id, entity_id, field, server_value, client_value) of the fields of conflicting writes in which server and client differ."""
    pairs = F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"current.{n}").cast("string").alias("server_value"), F.col(f"new.{n}").cast("string").alias("client_value")) for n in names))
    differing = F.filter(pairs, lambda x: ~x["server_value"].eqNullSafe(x["client_value"]))
    return found.where(F.col("conflict") & F.col("new").isNotNull()).select("table_id", "entity_id", F.explode(differing).alias("x")).select("table_id", "entity_id", "x.*")


def log(found: DataFrame, tables: DataFrame, n: int = 1000, arrival: tuple[str, ...] = ("entity_id", "table_id"), more: tuple[str, ...] = ()) -> DataFrame:
    """The last n conflicts by arrival, the columns that number them, with their table's name, or its id as text, and the columns `more`.

    Of those that arrived together the least by table, entity and op stay, however the rows are spread.
    """
    ties = tuple(c for c in ("table_id", "entity_id", "op") if c not in arrival)
    hit = ring(found.where("conflict"), n, *arrival, ties=ties).join(tables, "table_id", "left")
    return hit.select(
        F.coalesce("table_name", F.col("table_id").cast("string")).alias("table_name"), "table_id", "entity_id", "op", F.col("current").alias("server_value"), F.col("new").alias("client_value"), *more
    )
