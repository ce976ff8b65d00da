"""Op logs: legality within a batch, one fold for batches, log replay, change feeds and snapshots.

A component table is (key, fields).  An op log of one table is (version, seq, op, key, data), data being a struct of the fields and op
one of insert, update, delete; delete_entity removes the key's row whatever its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order() -> Column:
    return F.struct("version", "seq")


def fields_of(df: DataFrame, key: str) -> list[str]:
    return [c for c in df.columns if c != key]


def as_data(df: DataFrame, key: str) -> DataFrame:
    """(key, data)."""
    return df.select(key, F.struct(*fields_of(df, key)).alias("data"))


def presence(ops: DataFrame, base: DataFrame, key: str = "entity_id") -> DataFrame:
    """ops with `present`: whether the key's row is there just before the op."""
    before = Window.partitionBy(key).orderBy("version", "seq").rowsBetween(Window.unboundedPreceding, -1)
    change = F.when(F.col("op") == "insert", True).when(F.col("op").isin("delete", "delete_entity"), False)
    known = base.select(key).distinct().withColumn("_base", F.lit(True))
    return ops.join(known, key, "left").withColumn("present", F.coalesce(F.last(change, ignorenulls=True).over(before), F.col("_base"), F.lit(False))).drop("_base")


def illegal(ops: DataFrame, base: DataFrame, key: str = "entity_id", entities: DataFrame | None = None) -> DataFrame:
    """Ops that make their batch fail: update or delete of a row that isn't there at that point, or any op on an entity that doesn't exist."""
    bad = presence(ops, base, key).where(F.col("op").isin("update", "delete") & ~F.col("present")).drop("present")
    if entities is None:
        return bad
    nobody = ops.join(entities.select(F.col("entity_id").alias(key)), key, "left_anti").select(*bad.columns)
    return bad.unionByName(nobody).distinct()


def fold(base: DataFrame, ops: DataFrame, key: str = "entity_id") -> DataFrame:
    """The table after the ops: the last op of each key counts.  max_by combines before the shuffle and needs no sort."""
    fields = fields_of(base, key)
    start = as_data(base, key).select(key, F.lit(None).cast("long").alias("version"), F.lit(-1).cast("long").alias("seq"), F.lit("insert").alias("op"), "data")
    every = start.unionByName(ops.select(key, F.col("version").cast("long").alias("version"), F.col("seq").cast("long").alias("seq"), "op", "data"))
    last = every.groupBy(key).agg(F.max_by(F.struct("op", "data"), order()).alias("last"))
    return last.where(F.col("last.op").isin("insert", "update")).select(key, *(F.col(f"last.data.{f}").alias(f) for f in fields))


def apply_feed(base: DataFrame, feed: DataFrame, key: str = "entity_id", since: int | None = None) -> DataFrame:
    """A replica's table after a change feed with create_entity and delete_entity among its ops.

    Repeated (version, seq) count once and versions up to `since` not at all.  delete_entity removes what the entity had before it, in order of
    (version, seq).
    """
    if since is not None:
        feed = feed.where(F.col("version") > since)
    return fold(base, feed.where(F.col("op") != "create_entity"), key)


def committed(log: DataFrame, since: int = -1) -> DataFrame:
    """The log's ops in transactions after `since` that have a commit marker and no rollback marker."""
    marks = log.where(F.col("op").isin("commit", "rollback") & (F.col("transaction_id") > since))
    good = marks.groupBy("transaction_id").agg(F.bool_and(F.col("op") == "commit").alias("ok")).where("ok")
    ops = log.where(~F.col("op").isin("commit", "rollback"))
    return ops.join(good, "transaction_id", "left_semi")


def incomplete(log: DataFrame) -> DataFrame:
    """Transactions without a marker."""
    return log.groupBy("transaction_id").agg(F.count_if(F.col("op").isin("commit", "rollback")).alias("marks"), F.count("*").alias("ops")).where("marks = 0").select("transaction_id", "ops")


def replay(base: DataFrame, log: DataFrame, key: str = "entity_id", since: int = -1) -> DataFrame:
    """base after the log's committed transactions, in order of transaction and sequence."""
    ops = committed(log, since).withColumnsRenamed({"transaction_id": "version", "sequence": "seq"})
    return fold(base, ops, key)


def entry_checksum(log: DataFrame) -> Column:
    """CRC32 over all columns of a log entry, nulls included, whatever their order."""
    return F.crc32(F.to_json(F.struct(*sorted(log.columns)), {"ignoreNullFields": "false", "timeZone": "UTC"}).cast("binary"))


def sealed(log: DataFrame) -> DataFrame:
    """log with the checksum of each entry."""
    return log.withColumn("checksum", entry_checksum(log))


def tampered(log: DataFrame) -> DataFrame:
    """Entries of a sealed log that aren't as they were."""
    return log.where(~F.col("checksum").eqNullSafe(entry_checksum(log.drop("checksum"))))


def last_version(log: DataFrame) -> DataFrame:
    return log.where(F.col("op") == "commit").agg(F.coalesce(F.max("transaction_id"), F.lit(0)).alias("version"))


def next_sequence(log: DataFrame) -> DataFrame:
    """(transaction_id, next): how many entries a transaction has."""
    return log.groupBy("transaction_id").agg(F.count("*").alias("next"))


def touched(ops: DataFrame) -> DataFrame:
    return ops.select("table_id").distinct()


def fragmentation(ops: DataFrame) -> DataFrame:
    """(peak, live, ratio) of slots, given (seq, change of +1 or -1): a freed slot is used again, so there are as many as rows at the peak.

    Running sums are taken in parts and carried over, so no task sorts the whole log.
    """
    parts = ops.withColumn("part", F.floor(F.col("seq") / 65536))
    running = F.sum("change").over(Window.partitionBy("part").orderBy("seq"))
    inner = parts.withColumn("running", running).groupBy("part").agg(F.max("running").alias("top"), F.sum("change").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = inner.withColumn("peak", F.greatest(F.col("top") + before, F.lit(0))).agg(F.coalesce(F.max("peak"), F.lit(0)).cast("long").alias("peak"), F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("live"))
    return sums.withColumn("ratio", F.when(F.col("peak") > 0, 1 - F.col("live") / F.col("peak")).otherwise(0.0))
