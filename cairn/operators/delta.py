"""Deltas: differences of two tables, capture from a batch of ops, summaries, the last N."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ops import as_data


def difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, op, old, new) of the rows that differ; columns are compared null-safely, as structs."""
    a = as_data(old, key).withColumnRenamed("data", "old").withColumn("_a", F.lit(True))
    b = as_data(new, key).withColumnRenamed("data", "new").withColumn("_b", F.lit(True))
    op = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").otherwise("update")
    both = a.join(b, key, "full_outer").where(F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("old").eqNullSafe(F.col("new")))
    return both.select(key, op.alias("op"), "old", "new")


def capture(ops: DataFrame, base: DataFrame, key: str = "entity_id") -> DataFrame:
    """A batch's delta: (version, seq, op, key, old, new), the old image being that just before the op, whether from the batch or the base.

    A write is an insert if there was no row before it, else an update; a delete of nothing gives nothing.
    """
    before = Window.partitionBy(key).orderBy("version", "seq")
    image = F.struct((F.col("op") != "delete").alias("there"), F.col("data").alias("image"))
    held = as_data(base, key).select(key, F.struct(F.lit(True).alias("there"), F.col("data").alias("image")).alias("_base"))
    known = ops.join(held, key, "left").withColumn("_old", F.coalesce(F.lag(image).over(before), F.col("_base")))
    old = F.when(F.col("_old.there"), F.col("_old.image"))
    op = F.when(F.col("op") == "delete", "delete").when(old.isNull(), "insert").otherwise("update")
    return known.where((F.col("op") != "delete") | F.coalesce(F.col("_old.there"), F.lit(False))).select(
        "version", "seq", op.alias("op"), key, old.alias("old"), F.when(F.col("op") != "delete", F.col("data")).alias("new")
    )


def summary(feed: DataFrame) -> DataFrame:
    """(version, operations, first op, table and entity) of each delta."""
    first = F.min_by(F.struct("op", "table_id", "entity_id"), "seq").alias("first")
    return feed.groupBy("version").agg(F.count("*").alias("operation_count"), first).select(
        "version", "operation_count", F.col("first.op").alias("first_op_type"), F.col("first.table_id").alias("first_table_id"), F.col("first.entity_id").alias("first_entity_id")
    )


def ring(df: DataFrame, n: int, *order: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """The last n rows by order, of equal ones the first by ties: a top-k, so each partition passes on n rows."""
    return df.orderBy(*(F.col(c).desc() for c in order), *(F.col(c).asc() for c in ties)).limit(n)


def numbered(df: DataFrame, within: str, *order: str | Column) -> DataFrame:
    """df with seq from 0 in each group."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(within).orderBy(*order)) - 1)


def between(feed: DataFrame, low: int, high: int) -> DataFrame:
    """Versions low..high."""
    return feed.where(F.col("version").between(low, high))


def subscribed(feed: DataFrame, clients: DataFrame) -> DataFrame:
    """Each client's part of the feed: versions after its own, tables it subscribed to or all if it named none; ops without a table are heard by all.

    Sessions are bounded by the manager's `most`.  The join has no key, so Spark broadcasts them while they are under its threshold, and else takes their product.
    """
    hears = (F.size("subscribed_tables") == 0) | feed["table_id"].isNull() | F.array_contains("subscribed_tables", feed["table_id"])
    return feed.join(clients, (feed["version"] > clients["client_version"]) & hears)


def lag(feed: DataFrame, clients: DataFrame) -> DataFrame:
    """(client_id, lag): the server's version less the client's."""
    server = feed.agg(F.coalesce(F.max("version"), F.lit(0)).alias("server"))
    return clients.crossJoin(server).select("client_id", (F.col("server") - F.col("client_version")).alias("lag"))
