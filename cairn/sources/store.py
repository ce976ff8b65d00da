"""Versioned snapshots and the log of ops, as Parquet.

    <root>/snapshots/v=<version>/<table>/*.parquet   and _manifest.json with schemas, row counts and checksums
    <root>/snapshots/v=<version>/registry/*.parquet   the entities, if the database has a registry
    <root>/log/<table>/bucket=<version // log_bucket>/*.parquet   ops with time, checksum and attempt
    <root>/marks/bucket=<version // log_bucket>/*.json   commit and rollback markers, each for a transaction's ops in all tables
    <root>/wide/log/<table>/width=<versions>/bucket=<version // width>/*.parquet   the same of appends that span many buckets
    <root>/wide/marks/width=<versions>/bucket=<version // width>/*.parquet   their markers
    <root>/entities/<first op>-<last op>-<attempt>.json   creations and deletions of entities
    <root>/current.json   the version that readers see

A snapshot counts once its manifest is written, a transaction once its commit marker is.  Ops and marker carry the attempt that wrote them: what an attempt
without marker left behind doesn't count when its version is used again.  Ops are checked against their checksums as they are replayed.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import registry
from ..config import Config
from ..functions.values import micros, row_checksum
from ..operators.ops import entry_checksum, fold
from .files import Files

MARKS = "transaction_id bigint, op string, attempt string, timestamp bigint, bucket bigint"
KEPT = ("attempt", "timestamp", "checksum", "bucket")  # columns that the log adds
FOLDERS = 64  # that an append makes at most: files grow with its rows, not with its versions
WIDTH = T.StructType().add("width", "long")
REGISTRY = "registry"


class CorruptSnapshot(ValueError):
    """A snapshot's rows don't match its manifest."""


class Store:
    def __init__(self, spark: SparkSession, root: str, config: Config = Config()) -> None:
        self.spark, self.root, self.config, self.files = spark, root.rstrip("/"), config, Files(spark)

    def _snapshot(self, version: int) -> str:
        return f"{self.root}/{self.config.snapshot_dir}/v={version:012d}"

    def _log(self, table: str) -> str:
        return f"{self.root}/{self.config.log_dir}/{table}"

    # snapshots

    def write(self, tables: Mapping[str, DataFrame], version: int, key: str = "entity_id", entities: registry.Registry | None = None) -> None:
        """Files are sorted by key, so that a point lookup reads few row groups."""
        path = self._snapshot(version)
        manifest: dict = {"version": version, "time": time.time_ns() // 1000, "tables": {}}
        if entities is not None:
            manifest |= {"seq": entities.seq, "created": entities.created}
        for name, df in {**tables, **({REGISTRY: entities.frame()} if entities is not None else {})}.items():
            (df.repartitionByRange(key) if key in df.columns else df).sortWithinPartitions(*([key] if key in df.columns else df.columns[:1])).write.mode("overwrite").option("compression", self.config.compression).parquet(f"{path}/{name}")
            written = self.spark.read.schema(df.schema).parquet(f"{path}/{name}")
            rows = written.agg(F.count("*").alias("n"), row_checksum(written).alias("c")).first()
            about = {"schema": json.loads(df.schema.json()), "rows": rows["n"], "checksum": rows["c"]}
            if name == REGISTRY and entities is not None:
                manifest[REGISTRY] = about
            else:
                manifest["tables"][name] = about
        self.files.write(f"{path}/_manifest.json", json.dumps(manifest))

    def versions(self) -> list[int]:
        folder = f"{self.root}/{self.config.snapshot_dir}"
        return [int(n[2:]) for n in self.files.names(folder) if n.startswith("v=") and self.files.exists(f"{folder}/{n}/_manifest.json")]

    def manifest(self, version: int) -> dict:
        return json.loads(self.files.read(f"{self._snapshot(version)}/_manifest.json"))

    def _table(self, version: int, name: str, about: dict, verify: bool) -> DataFrame:
        df = self.spark.read.schema(T.StructType.fromJson(about["schema"])).parquet(f"{self._snapshot(version)}/{name}")
        if verify:
            rows = df.agg(F.count("*").alias("n"), row_checksum(df).alias("c")).first()
            if (rows["n"], rows["c"]) != (about["rows"], about["checksum"]):
                raise CorruptSnapshot(f"{name} at version {version}: {rows['n']} rows, {about['rows']} written, or another checksum")
        return df

    def read(self, version: int | None = None, verify: bool = True) -> tuple[int, dict[str, DataFrame]]:
        """(version, tables) of a snapshot, by default the newest; (0, nothing) if there is none."""
        have = self.versions()
        if not have and version is None:
            return 0, {}
        version = have[-1] if version is None else version
        return version, {name: self._table(version, name, about, verify) for name, about in self.manifest(version)["tables"].items()}

    def prune(self, keep: int | None = None) -> list[int]:
        """Drops all but the newest `keep` snapshots; the versions dropped."""
        gone = self.versions()[: -max(1, self.config.keep_snapshots if keep is None else keep)]
        for v in gone:
            self.files.delete(self._snapshot(v))
        return gone

    # log

    def _bucket(self, width: int | None = None) -> Column:
        return F.floor(F.col("transaction_id") / (width or self.config.log_bucket)).alias("bucket")

    def _wide(self, *names: str) -> str:
        return "/".join((self.root, "wide", *names))

    def _width(self, ops: DataFrame) -> int:
        """Versions in each folder of an append: a bucket's, doubled until FOLDERS hold them all."""
        low, high = ops.agg(F.min("transaction_id"), F.max("transaction_id")).first()
        width = self.config.log_bucket
        while low is not None and high // width - low // width >= FOLDERS:
            width *= 2
        return width

    def append(self, table: str, ops: DataFrame, attempt: str | None = None) -> None:
        """ops: (transaction_id, sequence, op, key, data), whole transactions with their markers.

        With an attempt, part of transactions whose markers mark() writes once all parts are there.
        """
        own, width = attempt or uuid.uuid4().hex, self.config.log_bucket if attempt else self._width(ops)
        rows = (ops if attempt else ops.where(~F.col("op").isin("commit", "rollback"))).select("*", self._bucket(width))
        # a folder's rows come to few tasks, so that they are in few files whatever the number of tasks; what is the same in all rows isn't shuffled
        rows = rows.coalesce(1) if attempt else rows.hint("rebalance", "bucket")
        added = rows.withColumns({"attempt": F.lit(own), "timestamp": F.col("timestamp") if "timestamp" in ops.columns else micros()})
        sealed = added.withColumn("checksum", entry_checksum(added.drop("bucket"))).select(*(c for c in added.columns if c != "bucket"), "checksum", "bucket")
        if not self.files.exists(f"{self._log(table)}/_schema.json"):
            self.files.write(f"{self._log(table)}/_schema.json", sealed.schema.json())
        wide = width > self.config.log_bucket
        sealed.write.mode("append").partitionBy("bucket").option("compression", self.config.compression).parquet(self._wide(self.config.log_dir, table, f"width={width}") if wide else self._log(table))
        if not attempt:
            marks = ops.where(F.col("op").isin("commit", "rollback")).select("transaction_id", "op", self._bucket(width)).hint("rebalance", "bucket")
            writer = marks.select("transaction_id", "op", F.lit(own).alias("attempt"), micros().alias("timestamp"), "bucket").write.mode("append").partitionBy("bucket")
            if wide:
                writer.option("compression", self.config.compression).parquet(self._wide("marks", f"width={width}"))
            else:
                writer.json(f"{self.root}/marks")

    def mark(self, version: int, attempt: str, op: str = "commit") -> None:
        """Ends a transaction that append() wrote in parts: one file, so it's there or it isn't."""
        row = {"transaction_id": version, "op": op, "attempt": attempt, "timestamp": time.time_ns() // 1000}
        self.files.write(f"{self.root}/marks/bucket={version // self.config.log_bucket}/{version}-{attempt}.json", json.dumps(row) + "\n")

    def _since(self, df: DataFrame, since: int, until: int | None) -> DataFrame:
        width = F.col("width") if "width" in df.columns else F.lit(self.config.log_bucket)
        df = df.where((F.col("bucket") + 1) * width > since + 1).where(F.col("transaction_id") > since)
        df = df if until is None else df.where(F.col("bucket") * width <= until).where(F.col("transaction_id") <= until)
        return df.withColumn("bucket", self._bucket()).drop("width") if "width" in df.columns else df

    def entries(self, table: str, since: int = -1, until: int | None = None) -> DataFrame | None:
        """All that was written for the table, with attempt, timestamp and checksum; only the buckets asked for are read."""
        if not self.files.exists(f"{self._log(table)}/_schema.json"):
            return None
        schema = T.StructType.fromJson(json.loads(self.files.read(f"{self._log(table)}/_schema.json")))
        own, at = self._since(self.spark.read.schema(schema).parquet(self._log(table)), since, until), self._wide(self.config.log_dir, table)
        return own.unionByName(self._since(self.spark.read.schema(T.StructType([*schema, *WIDTH])).parquet(at), since, until)) if self.files.exists(at) else own

    def log(self, table: str, since: int = -1, until: int | None = None) -> DataFrame | None:
        """Ops of transactions after `since`, without markers, finished or not."""
        own = self.entries(table, since, until)
        return None if own is None else own.drop(*KEPT)

    def finished(self, since: int = -1, until: int | None = None) -> DataFrame:
        """(transaction_id, attempt) of transactions with a commit marker and no rollback marker."""
        marks = self.spark.createDataFrame([], MARKS)
        if self.files.exists(f"{self.root}/marks"):
            marks = self._since(self.spark.read.schema(MARKS).json(f"{self.root}/marks"), since, until)
        if self.files.exists(self._wide("marks")):
            marks = marks.unionByName(self._since(self.spark.read.schema(f"{MARKS}, width bigint").parquet(self._wide("marks")), since, until))
        return marks.groupBy("transaction_id", "attempt").agg(F.bool_and(F.col("op") == "commit").alias("ok")).where("ok").drop("ok")

    def committed(self, table: str, since: int = -1, until: int | None = None, finished: DataFrame | None = None) -> DataFrame | None:
        """The table's ops in finished transactions; one that isn't as it was written fails the job that reads it."""
        own = self.entries(table, since, until)
        if own is None:
            return None
        own = own.join(self.finished(since, until) if finished is None else finished, ["transaction_id", "attempt"], "left_semi")
        text = F.concat(F.lit(f"CORRUPT_LOG: {table}, transaction "), F.col("transaction_id").cast("string"), F.lit(", entry "), F.col("sequence").cast("string"))
        return own.where(F.when(F.col("checksum").eqNullSafe(entry_checksum(own.drop("checksum", "bucket"))), True).otherwise(F.raise_error(text).cast("boolean"))).drop(*KEPT)

    def tampered(self, table: str) -> DataFrame | None:
        """Entries that aren't as they were written."""
        own = self.entries(table)
        return None if own is None else own.where(~F.col("checksum").eqNullSafe(entry_checksum(own.drop("checksum", "bucket"))))

    def logged_tables(self) -> list[str]:
        return [n for n in self.files.names(f"{self.root}/{self.config.log_dir}") if not n.startswith(("_", "."))]

    # entities

    def log_entities(self, ops: Iterable[tuple[int, str, int]]) -> None:
        """(seq, op, entity), as one file, which is there or isn't."""
        ops, now = list(ops), time.time_ns() // 1000
        lines = [json.dumps({"seq": s, "op": op, "entity_id": i, "timestamp": now, "checksum": zlib.crc32(f"{s}|{op}|{i}|{now}".encode())}) for s, op, i in ops]
        if lines:
            self.files.write(f"{self.root}/entities/{ops[0][0]:016d}-{ops[-1][0]:016d}-{uuid.uuid4().hex}.json", "\n".join(lines) + "\n")

    def entity_log(self, since: int = 0) -> DataFrame:
        """registry.OPS from number `since` on; an entry that isn't as it was written fails the job that reads it."""
        names = [n for n in self.files.names(f"{self.root}/entities") if n.endswith(".json") and int(n.split("-")[1]) >= since]
        if not names:
            return self.spark.createDataFrame([], registry.OPS)
        own = self.spark.read.schema(registry.OPS + ", checksum bigint").json([f"{self.root}/entities/{n}" for n in names]).where(F.col("seq") >= since)
        text = F.concat(F.lit("CORRUPT_LOG: entities, entry "), F.col("seq").cast("string"))
        return own.where(F.when(F.col("checksum").eqNullSafe(F.crc32(F.concat_ws("|", "seq", "op", "entity_id", "timestamp").cast("binary"))), True).otherwise(F.raise_error(text).cast("boolean"))).drop("checksum")

    def entities(self, until: int | None = None) -> registry.Registry | None:
        """The registry after the newest snapshot's and the log's ops; None if the store has none."""
        have = [v for v in self.versions() if until is None or v <= until]
        about = self.manifest(have[-1]) if have else {}
        seq, created = about.get("seq", 0), about.get("created", 0)
        base = self._table(have[-1], REGISTRY, about[REGISTRY], True) if REGISTRY in about else None
        ops = self.entity_log(seq)
        new = ops.agg(F.max("seq").alias("top"), F.count_if(F.col("op") == "create_entity").alias("created")).first()
        if base is None and new["top"] is None:
            return None
        whole = registry.fold(base if base is not None else self.spark.createDataFrame([], registry.ENTITIES), ops)
        return registry.Registry(self.spark, whole, max(seq, (new["top"] if new["top"] is not None else -1) + 1), created + new["created"])

    # recovery and compaction

    def recover(self, key: str = "entity_id", until: int | None = None) -> tuple[int, dict[str, DataFrame]]:
        """The newest snapshot with the log's later committed transactions on top; unfinished ones are left out."""
        have = [v for v in self.versions() if until is None or v <= until]
        version, tables = self.read(have[-1]) if have else (0, {})
        finished = self.finished(version, until)
        last = max(version, finished.agg(F.max("transaction_id")).first()[0] or 0)
        for name in self.logged_tables():
            ops = self.committed(name, version, until, finished)
            if ops is None:
                continue
            if name not in tables:
                data = ops.schema["data"].dataType
                tables[name] = self.spark.createDataFrame([], T.StructType([ops.schema[key], *data.fields]))  # type: ignore[attr-defined]
            tables[name] = fold(tables[name], ops.withColumnsRenamed({"transaction_id": "version", "sequence": "seq"}), key)
        return last, tables

    def compact(self, key: str = "entity_id", archive: bool = False) -> int:
        """A snapshot of the recovered state; older ones go, and the log's buckets that it covers whole."""
        version, tables = self.recover(key)
        if version not in self.versions():
            self.write(tables, version, key, self.entities())
        gone = [(self._snapshot(v), f"v={v:012d}") for v in self.versions()[:-1]]
        logs = {f"log/{name}": (self._log(name), self.config.log_bucket) for name in self.logged_tables()} | {"marks": (f"{self.root}/marks", self.config.log_bucket)}
        for kind in [*((self.config.log_dir, name) for name in self.logged_tables()), ("marks",)]:
            logs |= {"/".join(("wide", *kind, w)): (self._wide(*kind, w), int(w[6:])) for w in self.files.names(self._wide(*kind)) if w.startswith("width=")}
        for to, (at, width) in logs.items():
            gone += [(f"{at}/{b}", f"{to}/{b}") for b in self.files.names(at) if b.startswith("bucket=") and b[7:].lstrip("-").isdigit() and (int(b[7:]) + 1) * width <= version + 1]
        seq = self.manifest(version).get("seq", 0)
        gone += [(f"{self.root}/entities/{n}", f"entities/{n}") for n in self.files.names(f"{self.root}/entities") if n.endswith(".json") and int(n.split("-")[1]) < seq]
        for at, to in gone:
            if archive:
                self.files.move(at, f"{self.root}/{self.config.archive_dir}/{to}")
            else:
                self.files.delete(at)
        return version

    # the version that readers see

    def publish(self, version: int) -> None:
        self.files.write(f"{self.root}/current.json", json.dumps({"version": version}))

    def current(self) -> int:
        at = f"{self.root}/current.json"
        return json.loads(self.files.read(at))["version"] if self.files.exists(at) else 0


def rewrite(df: DataFrame, path: str, key: str, rows_per_file: int = 5_000_000) -> None:
    """A table in few sorted files."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def needing_compaction(ratios: DataFrame, threshold: float) -> DataFrame:
    return ratios.where(F.col("ratio") >= threshold)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_json(tables: Mapping[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def import_json(spark: SparkSession, path: str, schemas: Mapping[str, T.StructType]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(s).option("mode", "FAILFAST").json(f"{path}/{name}") for name, s in schemas.items()}


__all__ = ["CorruptSnapshot", "Store", "export_csv", "export_json", "import_json", "needing_compaction", "rewrite"]
