"""What a store gives back after failed, half-written and tampered transactions."""

from __future__ import annotations

import pyspark.sql.functions as F
import pytest

from cairn import registry
from cairn import schema as S
from cairn.config import Config
from cairn.database import CommitError, Database
from cairn.sources.store import Store

TEXT = """
[database]
name = "g"
[tables.a]
fields = [{name = "x", type = "i64", primary_key = true}]
[tables.b]
fields = [{name = "target", type = "i64", foreign_key = "a"}]
"""
IDS = {"a": 1, "b": 2}


def database(spark, path, **config):
    db = Database(spark, S.loads(TEXT), Store(spark, str(path), Config(**config)))
    for name, i in IDS.items():
        db.register(name, i)
    return db


def again(spark, db):
    return Database.recovered(spark, db.schema, Store(spark, db.store.root, db.store.config), IDS)


def rows(db, name):
    return {tuple(r) for r in db.tables[name].collect()}


def test_failed_batches_don_t_come_back(spark, tmp_path):
    db = database(spark, tmp_path)
    e, f = db.create_entity(), db.create_entity()
    with pytest.raises(CommitError, match="no row"), db.transaction() as t:
        t.insert("a", e, x=99)
        t.update("b", f, target=1)
    with pytest.raises(CommitError, match="no row in a"), db.transaction() as t:
        t.insert("a", e, x=98)
        t.insert("b", f, target=77)
    assert again(spark, db).version == 0 and db.version == 0
    with db.transaction() as t:
        t.insert("a", e, x=7)
    r = again(spark, db)
    assert r.version == 1 and rows(r, "a") == {(e, 7)} and rows(r, "b") == set()
    assert db.store.compact() == 1 and rows(again(spark, db), "a") == {(e, 7)}


def test_a_crash_between_two_tables_leaves_nothing(spark, tmp_path, monkeypatch):
    db = database(spark, tmp_path)
    e = db.create_entity()
    append, calls = Store.append, []

    def dies(self, table, *rest):
        calls.append(table)
        if len(calls) == 2:
            raise OSError("gone")
        append(self, table, *rest)

    monkeypatch.setattr(Store, "append", dies)
    with pytest.raises(OSError, match="gone"), db.transaction() as t:
        t.insert("a", e, x=1)
        t.insert("b", e, target=1)
    monkeypatch.undo()
    assert db.version == 0 and db.count("a") == 0
    r = again(spark, db)
    assert r.version == 0 and rows(r, "a") == set()
    with r.transaction() as t:  # the version is used again
        t.insert("a", e, x=2)
    assert rows(again(spark, db), "a") == {(e, 2)} and rows(again(spark, db), "b") == set()


def test_entries_are_sealed(spark, tmp_path):
    db = database(spark, tmp_path)
    e = db.create_entity()
    db.insert("a", e, x=1)
    db.commit()
    s = db.store
    assert s.tampered("a").count() == 0 and s.entries("a").where("timestamp > 1600000000000000").count() == 1
    changed = s.entries("a").withColumn("data", F.struct(F.lit(5).cast("long").alias("x")))
    at = f"{tmp_path}/changed"
    changed.write.partitionBy("bucket").parquet(at)
    s.files.delete(f"{tmp_path}/log/a/bucket=0")
    s.files.move(f"{at}/bucket=0", f"{tmp_path}/log/a/bucket=0")
    assert [r.sequence for r in s.tampered("a").collect()] == [0]
    with pytest.raises(Exception, match="CORRUPT_LOG"):
        rows(again(spark, db), "a")


def test_entities_are_recovered(spark, tmp_path):
    db = database(spark, tmp_path)
    ids = [db.create_entity() for _ in range(6)]
    db.delete_entity(ids[1])
    db.delete_entity(ids[4])
    db.insert("a", ids[0], x=1)
    assert db.commit() == 1
    assert db.create_entity() == ids[4]  # last freed first
    assert db.commit() == 1  # without ops, but the entity is logged
    for step in ("log", "snapshot", "compact"):
        r = again(spark, db)
        assert {tuple(x) for x in r.live_entities().collect()} == {(ids[0], 0), (ids[2], 0), (ids[3], 0), (ids[4], 1), (ids[5], 0)}, step
        assert r.registry.counts() == (7, 5) and r.registry.get(ids[4]) == (ids[4], 1)
        assert [r.create_entity(), r.create_entity()] == [ids[1], 7]
        db.snapshot() if step == "log" else db.store.compact()
    with pytest.raises(KeyError):
        again(spark, db).delete_entity(ids[1])


def test_entity_deltas_come_first(spark, tmp_path):
    db = database(spark, tmp_path)
    seen = []
    db.on_commit.append(lambda d: seen.extend((r.version, r.seq, r.op, r.table_id, r.entity_id) for r in d.orderBy("version", "seq").collect()))
    e = db.create_entity()
    db.insert("a", e, x=1)
    db.commit()
    f = db.create_entity()
    db.delete_entity(f)
    db.commit()
    db.update("a", e, x=2)
    db.commit()
    assert seen == [(1, -1, "create_entity", None, e), (1, 0, "insert", 1, e), (2, -2, "create_entity", None, f), (2, -1, "delete_entity", None, f), (2, 0, "update", 1, e)]


def test_the_free_list_is_paged(spark, monkeypatch):
    monkeypatch.setattr(registry.Registry, "PAGE", 3)
    r, plain = registry.Registry(spark), []
    for _ in range(20):
        r.create()
    for i in range(1, 20, 2):
        r.delete(i)
        plain.append(i)
    for k in range(3):
        frame = r.frame()
        assert {(x.entity_id, x.place) for x in registry.free_order(frame).collect()} == {(i, n) for n, i in enumerate(reversed(plain), 1)}
        r.rebase(spark.createDataFrame(frame.collect(), registry.ENTITIES))
        r.delete(2 * k + 2)
        plain.append(2 * k + 2)
        for _ in range(3):
            assert r.create() == plain.pop()
    while plain:
        assert r.create() == plain.pop()
    assert r.create() == 21 and r.missing([1, 99]) == [99]


def test_fold_of_entity_ops(spark):
    base = spark.createDataFrame([(1, 0, True, None), (2, 1, False, 4), (3, 0, True, None)], registry.ENTITIES)
    ops = spark.createDataFrame([(5, "delete_entity", 1), (6, "create_entity", 1), (6, "create_entity", 1), (7, "create_entity", 9), (8, "delete_entity", 3)], "seq long, op string, entity_id long")
    assert {tuple(r) for r in registry.fold(base, ops).collect()} == {(1, 1, True, None), (2, 1, False, 4), (3, 1, False, 8), (9, 0, True, None)}


def test_fragmented_tables_are_compacted(spark, tmp_path):
    db = database(spark, tmp_path)
    ids = [db.create_entity() for _ in range(10)]
    with db.transaction() as t:
        for e in ids:
            t.insert("a", e, x=e)
    with db.transaction() as t:
        for e in ids[:4]:
            t.delete("a", e)
    assert db.fragmentation("a") == pytest.approx(0.4) and db.fragmentation("b") == 0
    assert db.compact_if_fragmented(0.5) == [] and db.compact_if_fragmented() == ["a"] and db.fragmentation("a") == 0
    assert rows(db, "a") == {(e, e) for e in ids[4:]}
    db.close()


def test_appends_of_many_versions_make_few_folders(spark, tmp_path):
    store = Store(spark, str(tmp_path), Config(log_bucket=2))
    last = 1000

    def state(until, more=()):
        rows = {}
        for t in range(1, until + 1):
            if t % 3 and t % 5:
                rows[t % 7] = t
        return rows | dict(more)

    def recovered(**at):
        version, tables = store.recover(**at)
        return version, {r.entity_id: r.x for r in tables["t"].collect()}

    ops = spark.range(1, last + 1).select(F.col("id").alias("transaction_id"), F.lit(0).cast("long").alias("sequence"), F.lit("update").alias("op"), (F.col("id") % 7).alias("entity_id"), F.struct(F.col("id").alias("x")).alias("data"))
    marks = ops.where("transaction_id % 3 <> 0").withColumns({"op": F.when(F.col("transaction_id") % 5 == 0, "rollback").otherwise("commit"), "entity_id": F.lit(None).cast("long"), "data": F.lit(None).cast("struct<x:bigint>")})
    store.append("t", ops.unionByName(marks))
    folders = [p for p in tmp_path.rglob("bucket=*") if p.is_dir()]
    assert 32 <= len([p for p in folders if "log" in p.parts]) <= 64 and len(folders) <= 128
    assert store.entries("t").count() == last and store.tampered("t").isEmpty() and store.log("t", 990, 995).count() == 5
    assert store.entries("t").where("bucket <> transaction_id div 2").isEmpty()
    assert recovered() == (998, state(last)) and recovered(until=501) == (499, state(501))
    for version, mark in ((1001, True), (1002, False)):  # in parts, beside the wide folders
        store.append("t", spark.createDataFrame([(version, 0, "update", 3, (version,))], ops.schema), f"attempt-{version}")
        if mark:
            store.mark(version, f"attempt-{version}")
    assert recovered() == (1001, state(last, {3: 1001})) and recovered(until=1000) == (998, state(last))
    assert store.compact() == 1001 and recovered() == (1001, state(last, {3: 1001}))
    assert store.entries("t").select("transaction_id").distinct().count() <= 2 + 32 and store.entries("t", 1001).count() == 1
    store.mark(1002, "attempt-1002")
    assert recovered() == (1002, state(last, {3: 1002}))


def test_versions_that_a_wide_append_left_open(spark, tmp_path):
    store = Store(spark, str(tmp_path), Config(log_bucket=1))
    rows = [(t, 0, "insert", t, (t,)) for t in range(1, 201)] + [(t, None, "commit", None, None) for t in range(1, 151)]
    store.append("t", spark.createDataFrame(rows, "transaction_id long, sequence long, op string, entity_id long, data struct<x:bigint>"))
    assert store.compact(archive=True) == 150 and store.recover()[1]["t"].count() == 150
    left = {r.transaction_id for r in store.entries("t").collect()}
    assert set(range(151, 201)) <= left <= set(range(148, 201)) and (tmp_path / "archive/wide/log/t/width=4/bucket=0").is_dir()
    store.append("t", spark.createDataFrame([(160, 0, "delete", 5, None), (160, None, "commit", None, None)], "transaction_id long, sequence long, op string, entity_id long, data struct<x:bigint>"))
    assert {r.entity_id for r in store.recover()[1]["t"].collect()} == set(range(1, 151)) - {5}
