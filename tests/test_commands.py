from __future__ import annotations

import time

import pytest

from cairn.commands import Commands
from cairn.config import Config
from cairn.streaming import sync

TEXT = '[database]\nname = "g"\n[tables.a]\nfields = [{name = "v", type = "i32"}]\n[tables.b]\nfields = [{name = "w", type = "f64", nullable = true}]\n'


def test_session(spark, tmp_path):
    (tmp_path / "s.toml").write_text(TEXT)
    c = Commands(spark, Config(tick_ms=50))
    with pytest.raises(ValueError, match="init_database"):
        c.create_entity()
    assert c.init_database(str(tmp_path / "s.toml")) == 2 and c.get_tables() == ["a", "b"]
    e = c.create_entity()
    assert c.insert_component("a", e, '{"v": 3}') == 1 and c.update_component("a", e, '{"v": 4}') == 2
    assert c.fetch_entities("a", 5) == [{"entity_id": e, "v": 4}] and c.fetch_entities_json("a", 5) == [(e, '{"v":4}')]
    assert c.get_entity_count("a") == 1 and c.get_entity_count("b") == 0 and c.get_schema()["b"]["fields"][1]["name"] == "w"
    assert c.get_pending_delta_count() == 2
    c.clients.add("x", [0], version=2)
    sent = []
    c.start_replication(lambda df, _: sent.extend((r.client_id, r.version, r.op, r.data) for r in df.collect()))
    assert c.insert_component("b", e, '{"w": null}') == 3 and c.delete_component("a", e) == 4
    for _ in range(300):
        if c.published == 4:
            break
        time.sleep(0.1)
    c.stop_replication()
    assert sent == [("x", 4, "delete", None)] and c.get_pending_delta_count() == 0
    assert c.get_connected_clients() == 1 and c.get_clients()[0]["client_id"] == "x"
    assert [r["version"] for r in c.get_delta_log(2)] == [4, 3] and c.commit_database() == 4 and c.get_conflict_log() == []
    kind = "struct<v:int>"
    ops = spark.createDataFrame([(0, 7, "update", (1,), (2,))], f"table_id int, entity_id long, op string, old {kind}, new {kind}")
    server = spark.createDataFrame([(0, 7, (5,))], f"table_id int, entity_id long, data {kind}")
    assert c.merge(ops, server).first().new.v == 5
    assert c.get_conflict_log() == [{"table_name": "a", "table_id": 0, "entity_id": 7, "op": "update", "server_value": '{"v":5}', "client_value": '{"v":2}'}]


def test_full_sync(spark):
    t = spark.range(25).withColumnRenamed("id", "entity_id").selectExpr("entity_id", "cast(entity_id as string) s", "nullif(entity_id, 3) n")
    empty = t.limit(0)
    chunks = sync.full({"t": t, "e": empty}, 9, rows_per_chunk=4)
    assert chunks.where("table_name = 't'").count() == 7 and chunks.where("table_schema is not null").count() == 2
    assert sorted(sync.received(chunks, "t").collect(), key=str) == sorted(t.collect(), key=str)
    assert sync.received(chunks, "e").collect() == []
    with pytest.raises(ValueError, match="6 of 7"):
        sync.received(chunks.where("not (table_name = 't' and chunk = 3)"), "t")


def test_catch_up_and_metrics(spark):
    feed = spark.createDataFrame([(1, 0), (2, 0), (2, 0), (3, 1)], "version long, seq long")
    assert sorted(r.version for r in sync.catch_up(feed, 1).collect()) == [2, 3] and [r.version for r in sync.catch_up(feed, 1, 2).collect()] == [2]
    clients = spark.createDataFrame([("a", 1)], "client_id string, client_version long")
    m = sync.metrics(spark, feed, clients)
    assert m == {"version": 3, "deltas": 3, "ops": 4, "clients": 1, "lag": 2} and "cairn_lag 2\n" in sync.prometheus(m)
    df, seen = sync.measured(feed, "rows")
    df.collect()
    assert seen.get["rows"] == 4
