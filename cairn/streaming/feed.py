"""Change feeds as streams: a feed folder, publishing to clients, a stateful replica, event-time windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.delta import subscribed
from ..sources.files import Files

FEED = "version bigint, seq bigint, op string, table_id int, entity_id bigint, data string"


def read(spark: SparkSession, path: str, schema: str | T.StructType = FEED, files_per_tick: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_tick:
        reader = reader.option("maxFilesPerTrigger", files_per_tick)
    return reader.parquet(path)


def append(feed: DataFrame, path: str) -> None:
    feed.write.mode("append").parquet(path)


def publish(feed: DataFrame, clients: Callable[[], DataFrame], send: Callable[[DataFrame, int], None], checkpoint: str, tick_ms: int | None = None, seen: Callable[[int], None] | None = None) -> StreamingQuery:
    """Every tick sends each client its part of the new deltas; without tick_ms all that is there is sent and the query ends.

    seen is told a tick's greatest version once it was sent, to whomever.  A batch may be sent twice after a failure: receivers drop (version, seq) that
    they have, as the replica does.
    """

    def one(batch: DataFrame, number: int) -> None:
        send(subscribed(batch, clients()), number)
        if seen and (top := batch.agg(F.max("version")).first()[0]) is not None:
            seen(top)

    writer = feed.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{tick_ms} milliseconds") if tick_ms else writer.trigger(availableNow=True)).start()


ENTITY = -1  # stands for the table where all rows of an entity went


def replica(feed: DataFrame) -> DataFrame:
    """(table_id, entity_id, data, version, seq, present) of the rows that change, in update mode; an entity's deletion is one row, of table ENTITY.

    State is one aggregate a row: the op of greatest (version, seq), so ops that come twice or late change nothing.
    """
    gone = F.col("op") == "delete_entity"
    own = feed.where(F.col("op") != "create_entity").select(F.when(gone, F.lit(ENTITY)).otherwise(F.col("table_id")).alias("table_id"), "entity_id", "op", "data", F.struct("version", "seq").alias("at"))
    last = own.groupBy("table_id", "entity_id").agg(F.max_by(F.struct("op", "data"), "at").alias("x"), F.max("at").alias("at"))
    there = F.col("x.op").isin("insert", "update")
    return last.select("table_id", "entity_id", F.when(there, F.col("x.data")).alias("data"), "at.version", "at.seq", there.alias("present"))


def latest(updates: DataFrame) -> DataFrame:
    """Of all updates of a replica each row's last."""
    at = F.struct("version", "seq")
    return updates.groupBy("table_id", "entity_id").agg(F.max_by(F.struct("data", "present", "version", "seq"), at).alias("x")).select("table_id", "entity_id", "x.*")


def settled(updates: DataFrame) -> DataFrame:
    """(table_id, entity_id, data) after all updates of a replica."""
    at = F.struct("version", "seq")
    gone = F.max(F.when(F.col("table_id") == ENTITY, at)).over(Window.partitionBy("entity_id"))  # an entity has a row in each table at most
    rows = latest(updates).withColumn("gone", gone).where((F.col("table_id") != ENTITY) & F.col("present"))
    return rows.where(F.col("gone").isNull() | (at > F.col("gone"))).select("table_id", "entity_id", "data")


class Replica:
    """A copy of the tables behind a feed, as Parquet in a folder: the updates of every tick, which compact() makes one."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark)

    def follow(self, feed: DataFrame, tick_ms: int | None = None) -> StreamingQuery:
        """Takes what is there, or with tick_ms goes on."""
        return to_folder(replica(feed), f"{self.folder}/updates", "update", f"{self.folder}/checkpoint", tick_ms)

    def updates(self) -> DataFrame:
        schema = "table_id int, entity_id bigint, data string, version bigint, seq bigint, present boolean"
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.folder}/updates")

    def table(self, table_id: int) -> DataFrame:
        """(entity_id, data)."""
        return settled(self.updates().where(F.col("table_id").isin(table_id, ENTITY))).drop("table_id")

    def get(self, table_id: int, entity_id: int) -> str | None:
        row = settled(self.updates().where(F.col("table_id").isin(table_id, ENTITY) & (F.col("entity_id") == entity_id))).first()
        return row["data"] if row else None

    def contains(self, table_id: int, entity_id: int) -> bool:
        return not settled(self.updates().where(F.col("table_id").isin(table_id, ENTITY) & (F.col("entity_id") == entity_id))).isEmpty()

    def version(self) -> int:
        return self.updates().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def compact(self) -> None:
        """One update a row, in new files, beside which the old ones go; not while the replica follows."""
        at = f"{self.folder}/updates"
        old = self.files.names(at)
        latest(self.updates()).select("table_id", "entity_id", "data", "version", "seq", "present").write.parquet(f"{at}/whole-{uuid.uuid4().hex}")
        for name in old:
            self.files.delete(f"{at}/{name}")


def windowed(events: DataFrame, time: str, width: str, *keys: str, late: str = "0 seconds", slide: str | None = None) -> DataFrame:
    """Counts by event-time window; times without zone are taken as UTC, as watermarks need instants."""
    own = events.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    return own.groupBy(F.window("_time", width, slide).alias("w") if slide else F.window("_time", width).alias("w"), *keys).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), *keys, "events")


def sessions(events: DataFrame, time: str, gap: str, *keys: str, late: str | None = None) -> DataFrame:
    """(start, end, keys, events) of sessions: events of equal keys of which none is `gap` after the one before it.  Streams need `late`, their watermark."""
    own = events.withColumn("_time", F.col(time).cast("timestamp"))
    own = own.withWatermark("_time", late) if late else own
    return own.groupBy(F.session_window("_time", gap).alias("w"), *keys).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "events")


def to_folder(df: DataFrame, folder: str, mode: str, checkpoint: str, tick_ms: int | None = None) -> StreamingQuery:
    """Writes a stream as Parquet: in update and append mode a folder a tick, which a repeated tick writes again, in complete mode the whole result."""

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(folder if mode == "complete" else f"{folder}/tick-{number:010d}")

    writer = df.writeStream.foreachBatch(one).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{tick_ms} milliseconds") if tick_ms else writer.trigger(availableNow=True)).start()


def to_memory(df: DataFrame, name: str, mode: str, checkpoint: str) -> None:
    """Runs a stream over what is there into a view of that name, on the driver: for small results."""
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Heartbeat(StreamingQueryListener):
    """Keeps the last progress of every query."""

    def __init__(self) -> None:
        self.last: dict[str, dict] = {}

    def onQueryStarted(self, event: Any) -> None:  # noqa: N802
        self.last[str(event.id)] = {"rows": 0, "batch": -1}

    def onQueryProgress(self, event: Any) -> None:  # noqa: N802
        self.last[str(event.progress.id)] = {"rows": event.progress.numInputRows, "batch": event.progress.batchId}

    def onQueryIdle(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: Any) -> None:  # noqa: N802
        self.last.pop(str(event.id), None)


class Clients:
    """Sessions of replicas: at most `most`, each with the version that it has acknowledged and the tables that it asked for."""

    STATES = ("connecting", "syncing", "ready", "disconnected")

    def __init__(self, spark: SparkSession, most: int = 100) -> None:
        self.spark, self.most = spark, most
        self.sessions: dict[str, dict] = {}

    def add(self, client_id: str | None = None, tables: list[int] | None = None, version: int = 0) -> str:
        """The session's id, a new one if none is given."""
        client_id = client_id or str(uuid.uuid4())
        if client_id not in self.sessions and len(self.sessions) >= self.most:
            raise ValueError(f"more than {self.most} clients")
        self.sessions[client_id] = {"state": "connecting", "client_version": version, "subscribed_tables": tables or []}
        return client_id

    def remove(self, client_id: str) -> bool:
        return self.sessions.pop(client_id, None) is not None

    def set(self, client_id: str, *, state: str | None = None, version: int | None = None) -> None:
        if state is not None and state not in self.STATES:
            raise ValueError(f"unknown state {state}")
        own = self.sessions[client_id]
        own["state"] = state or own["state"]
        own["client_version"] = own["client_version"] if version is None else version

    def __len__(self) -> int:
        return len(self.sessions)

    def frame(self, state: str | None = None) -> DataFrame:
        rows = [(k, s["state"], s["client_version"], s["subscribed_tables"]) for k, s in self.sessions.items() if state in (None, s["state"])]
        return self.spark.createDataFrame(rows, "client_id string, state string, client_version bigint, subscribed_tables array<int>")
