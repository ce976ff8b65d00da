"""The commands that a dashboard calls, by their names."""

from __future__ import annotations

import json
import time
import uuid
from collections import deque
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from . import schema as S
from .config import Config
from .database import Database
from .operators import conflict
from .sources.files import Files, scratch
from .streaming import feed as stream


class Commands:
    def __init__(self, spark: SparkSession, config: Config = Config()) -> None:
        self.spark, self.config = spark, config
        self.db: Database | None = None
        self.clients = stream.Clients(spark, config.max_clients)
        self.running: StreamingQuery | None = None
        self.folder: str | None = None
        self.published = 0
        self.conflicts: deque[dict] = deque(maxlen=config.conflict_ring)  # by arrival; no more than the ring leaves Spark
        self.arrived = 0

    def _db(self) -> Database:
        if self.db is None:
            raise ValueError("init_database first")
        return self.db

    def init_database(self, schema_path: str) -> int:
        """Loads the schema and registers its tables, ids in order of name; how many there are."""
        self.db = Database(self.spark, S.load(schema_path))
        for i, t in enumerate(self.db.schema.tables):
            self.db.register(t.name, i)
        return self.db.table_count()

    def create_entity(self) -> int:
        return self._db().create_entity()

    def get_schema(self) -> dict[str, Any]:
        return {t: json.loads(df.schema.json()) for t, df in self._db().tables.items()}

    def get_tables(self) -> list[str]:
        return self._db().table_names()

    def get_entity_count(self, table: str) -> int:
        return self._db().count(table)

    def fetch_entities(self, table: str, limit: int, offset: int = 0) -> list[dict]:
        return [r.asDict(recursive=True) for r in self._db().entities(table, limit, offset).collect()]

    def fetch_entities_json(self, table: str, limit: int, offset: int = 0) -> list[tuple[int, str]]:
        return [(r[0], r["json"]) for r in self._db().entities_json(table, limit, offset).collect()]

    def insert_component(self, table: str, entity_id: int, text: str) -> int:
        return self._db().insert_json(table, entity_id, text)

    def update_component(self, table: str, entity_id: int, text: str) -> int:
        return self._db().update_json(table, entity_id, text)

    def delete_component(self, table: str, entity_id: int) -> int:
        self._db().delete(table, entity_id)
        return self._db().commit()

    def commit_database(self) -> int:
        return self._db().commit()

    def start_replication(self, send: Callable[[DataFrame, int], None]) -> None:
        """From now on commits go to a feed folder, and a stream sends each client its part, a tick at a time; what was before comes with a full sync."""
        if self.running:
            return
        self.folder = self.folder or Files(self.spark).temporary(f"{scratch(self.spark)}/replication-{uuid.uuid4().hex}")
        if self._append not in self._db().on_commit:
            self._db().on_commit.append(self._append)
            self._append(self.spark.createDataFrame([], stream.FEED))  # the folder is there before the stream
            self.published = self._db().version

        def seen(version: int) -> None:
            self.published = max(self.published, version)

        self.running = stream.publish(stream.read(self.spark, f"{self.folder}/feed"), self.clients.frame, send, f"{self.folder}/checkpoint", self.config.tick_ms, seen)

    def _append(self, delta: DataFrame) -> None:
        stream.append(delta.withColumn("data", F.col("new")).select("version", "seq", "op", "table_id", "entity_id", "data") if "new" in delta.columns else delta, f"{self.folder}/feed")

    def stop_replication(self) -> None:
        if self.running:
            self.running.stop()
            self.running = None

    def get_connected_clients(self) -> int:
        return len(self.clients)

    def get_clients(self) -> list[dict]:
        return [r.asDict() for r in self.clients.frame().collect()]

    def get_pending_delta_count(self) -> int:
        """Commits that haven't been sent, whether or not a client hears them."""
        return self._db().version - self.published

    def merge(self, ops: DataFrame, server: DataFrame, strategy: conflict.Strategy = "server", client_version: int = 0) -> DataFrame:
        """A client's ops to apply, in order of their column seq if they have one; conflicts are remembered for get_conflict_log."""
        found = conflict.detected(ops, server)
        order = ["seq"] if "seq" in ops.columns else ["table_id", "entity_id"]
        seen = found.where("conflict").select("table_id", "entity_id", "op", F.to_json("current").alias("current"), F.to_json("new").alias("new"), "conflict", *([] if order[0] == "table_id" else order))
        last = conflict.log(seen, self._db().dimension(), self.config.conflict_ring, tuple(order), tuple(c for c in order if c == "seq"))
        rows = sorted((r.asDict() for r in last.collect()), key=lambda r: tuple(r[c] for c in order))
        about = {"field": None, "server_version": self._db().version, "client_version": client_version, "timestamp": time.time_ns() // 1000}
        for r in rows:
            r.pop("seq", None)
            self.conflicts.append(r | {"number": self.arrived} | about)
            self.arrived += 1
        return conflict.resolved(found, strategy)

    def get_conflict_log(self, n: int | None = None, whole: bool = False) -> list[dict]:
        """The last conflicts, newest first; whole: with number of arrival, versions and time."""
        rows = list(self.conflicts)[::-1][: n or self.config.conflict_ring]
        return rows if whole else [{k: r[k] for k in ("table_name", "table_id", "entity_id", "op", "server_value", "client_value")} for r in rows]

    def compact_database(self, threshold: float | None = None) -> list[str]:
        return self._db().compact_if_fragmented(self.config.compact_ratio if threshold is None else threshold)

    def get_delta_log(self, n: int | None = None) -> list[dict]:
        return [r.asDict() for r in self._db().delta_log(n or self.config.delta_ring).collect()]
