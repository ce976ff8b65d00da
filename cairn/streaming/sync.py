"""Bringing a replica up to date: all rows in chunks first, then the deltas that it lacks; metrics of a running job."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.json import encode

CHUNKS = "version bigint, table_name string, chunk bigint, chunks bigint, table_schema string, rows array<string>"


def full(tables: Mapping[str, DataFrame], version: int, key: str = "entity_id", rows_per_chunk: int = 10_000) -> DataFrame | None:
    """CHUNKS of about rows_per_chunk rows as JSON; chunk 0 has the schema.  Rows are put into chunks by a hash of their key, not by a global sort."""
    out = None
    for name, df in tables.items():
        n = df.agg(F.greatest(F.ceil(F.count("*") / rows_per_chunk), F.lit(1)).alias("chunks"))
        parted = df.crossJoin(F.broadcast(n)).select(F.pmod(F.xxhash64(key), F.col("chunks")).alias("chunk"), "chunks", encode(df.columns).alias("row"))
        # every chunk is sent, the empty ones too, so that the receiver can count them
        every = n.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "chunks")
        filled = every.join(parted.groupBy("chunk").agg(F.collect_list("row").alias("rows")), "chunk", "left")
        one = filled.select(
            F.lit(version).cast("long").alias("version"), F.lit(name).alias("table_name"), "chunk", "chunks", F.when(F.col("chunk") == 0, df.schema.json()).alias("table_schema"), F.coalesce("rows", F.array().cast("array<string>")).alias("rows")
        )
        out = one if out is None else out.unionByName(one)
    return out


def received(chunks: DataFrame, name: str) -> DataFrame:
    """The table back from its chunks; an error if one is missing."""
    own = chunks.where(F.col("table_name") == name)
    state = own.agg(F.max("table_schema").alias("schema"), F.count_distinct("chunk").alias("have"), F.max("chunks").alias("want")).first()
    if state["schema"] is None or state["have"] != state["want"]:
        raise ValueError(f"{name}: {state['have']} of {state['want']} chunks")
    schema = StructType.fromJson(json.loads(state["schema"]))
    return own.select(F.explode("rows").alias("row")).select(F.from_json("row", schema).alias("x")).select("x.*")


def catch_up(feed: DataFrame, client_version: int, requested: int | None = None) -> DataFrame:
    """Deltas after the client's version, up to the requested one; (version, seq) that come twice are sent once."""
    own = feed.where(F.col("version") > client_version)
    return (own if requested is None else own.where(F.col("version") <= requested)).dropDuplicates(["version", "seq"])


def measured(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df with metrics that its next action fills in on the way; rows are always counted."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in metrics.items())), seen


def prometheus(values: Mapping[str, float], prefix: str = "cairn") -> str:
    """Metrics in the text format."""
    return "".join(f"# TYPE {prefix}_{k} gauge\n{prefix}_{k} {v}\n" for k, v in sorted(values.items()))


def metrics(spark: SparkSession, feed: DataFrame, clients: DataFrame) -> dict[str, float]:
    """Version, deltas and ops of a feed, clients and their greatest lag."""
    f = feed.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"), F.count_distinct("version").alias("deltas"), F.count("*").alias("ops")).first()
    c = clients.agg(F.count("*").alias("clients"), F.coalesce(F.max(F.lit(f["version"]) - F.col("client_version")), F.lit(0)).alias("lag")).first()
    return {**f.asDict(), **c.asDict()}
