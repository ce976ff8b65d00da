from __future__ import annotations

import random

import pyspark.sql.functions as F
import pytest

from cairn.streaming import feed as S

KINDS = ("insert", "update", "delete", "create_entity", "delete_entity")


def test_replica_over_many_ticks(spark, tmp_path):
    r = random.Random(1)
    rows = [(v, s, r.choice(KINDS), r.randint(1, 2), r.randint(1, 6), f'{{"v": {v}}}') for v in range(30) for s in range(2)]
    for k in range(3):
        part = rows[k * 20 : k * 20 + 25]  # files overlap: some ops come twice
        S.append(spark.createDataFrame(part, S.FEED).coalesce(1), f"{tmp_path}/feed")
    S.to_memory(S.replica(S.read(spark, f"{tmp_path}/feed", files_per_tick=1)), "replica_test", "update", f"{tmp_path}/c")
    state: dict = {}
    for _, _, op, t, e, data in rows:
        if op in ("insert", "update"):
            state[t, e] = data
        elif op == "delete":
            state.pop((t, e), None)
        elif op == "delete_entity":
            state = {k: v for k, v in state.items() if k[1] != e}
    assert {(x.table_id, x.entity_id): x.data for x in S.settled(spark.table("replica_test")).collect()} == state


def test_publish_honours_subscriptions(spark, tmp_path):
    feed = spark.createDataFrame([(v, 0, "insert", v % 3, v, None) for v in range(1, 10)], S.FEED)
    S.append(feed, f"{tmp_path}/feed")
    clients = S.Clients(spark, 2)
    clients.add("all")
    clients.add("some", [2], version=4)
    with pytest.raises(ValueError, match="more than 2"):
        clients.add("third")
    sent = []
    S.publish(S.read(spark, f"{tmp_path}/feed"), clients.frame, lambda df, _: sent.extend((x.client_id, x.version) for x in df.collect()), f"{tmp_path}/c").awaitTermination()
    assert sorted(sent) == [("all", v) for v in range(1, 10)] + [("some", 5), ("some", 8)]
    clients.set("all", state="ready", version=9)
    assert clients.frame("ready").first().client_version == 9 and len(clients) == 2 and clients.remove("some") and not clients.remove("some")
    with pytest.raises(ValueError, match="unknown state"):
        clients.set("all", state="x")


def test_windows_drop_late_events(spark, tmp_path):
    for seconds in ((10, 70, 600), (610,), (15, 650)):  # the watermark for late events is that of the batch before
        rows = spark.createDataFrame([(s,) for s in seconds], "s long").select(F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts")).coalesce(1)
        S.append(rows, f"{tmp_path}/e")
    events = S.read(spark, f"{tmp_path}/e", rows.schema, files_per_tick=1)
    S.to_memory(S.windowed(events, "ts", "1 minute", late="1 minute"), "late_test", "update", f"{tmp_path}/c")
    last = spark.table("late_test").groupBy(F.unix_timestamp("start").alias("s")).agg(F.max("events").alias("n"))
    assert {(x.s, x.n) for x in last.collect()} == {(0, 1), (60, 1), (600, 3)}


def test_heartbeat(spark, tmp_path):
    S.append(spark.createDataFrame([(1, 0, "insert", 1, 1, None)], S.FEED), f"{tmp_path}/feed")
    listener = S.Heartbeat()
    spark.streams.addListener(listener)
    try:
        S.to_memory(S.read(spark, f"{tmp_path}/feed"), "beat", "append", f"{tmp_path}/c")
    finally:
        spark.streams.removeListener(listener)
    assert spark.table("beat").count() == 1


def test_a_replica_is_read_and_compacted(spark, tmp_path):
    rows = [(1, 0, "insert", 1, 7, "a"), (2, 0, "insert", 2, 7, "b"), (3, 0, "insert", 1, 8, "c"), (4, 0, "delete_entity", None, 7, None), (5, 0, "create_entity", None, 7, None), (6, 0, "insert", 1, 7, "d")]
    S.append(spark.createDataFrame(rows, S.FEED), f"{tmp_path}/feed")
    r = S.Replica(spark, f"{tmp_path}/replica")
    r.follow(S.read(spark, f"{tmp_path}/feed")).awaitTermination()
    for _ in range(2):
        assert (r.get(1, 7), r.get(2, 7), r.get(1, 8), r.contains(1, 8), r.contains(2, 8), r.version()) == ("d", None, "c", True, False, 6)
        assert {tuple(x) for x in r.table(1).collect()} == {(7, "d"), (8, "c")}
        r.compact()
    S.append(spark.createDataFrame([(2, 0, "insert", 2, 7, "b"), (7, 0, "delete", 1, 8, None)], S.FEED), f"{tmp_path}/feed")  # one comes again, late
    r.follow(S.read(spark, f"{tmp_path}/feed")).awaitTermination()
    assert {tuple(x) for x in r.table(1).collect()} == {(7, "d")} and r.table(2).collect() == [] and r.version() == 7


def test_publishing_tells_the_version_without_clients(spark, tmp_path):
    S.append(spark.createDataFrame([(v, 0, "insert", 1, v, None) for v in (1, 2, 3)], S.FEED), f"{tmp_path}/feed")
    seen, sent = [], []
    S.publish(S.read(spark, f"{tmp_path}/feed"), S.Clients(spark).frame, lambda df, _: sent.extend(df.collect()), f"{tmp_path}/c", seen=seen.append).awaitTermination()
    assert seen == [3] and sent == []
    assert len(S.Clients(spark).add()) == 36
