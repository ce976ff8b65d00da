from __future__ import annotations

import pytest

from cairn import schema as S
from cairn.config import Config
from cairn.database import CommitError, Database
from cairn.sources.store import CorruptSnapshot, Store, export_csv, export_json, import_json, needing_compaction, rewrite

TEXT = """
[database]
name = "g"
[tables.point]
fields = [{name = "x", type = "f32"}, {name = "y", type = "f32"}, {name = "tag", type = "u32"}]
[tables.link]
fields = [{name = "target", type = "i64", foreign_key = "nodes"}]
[tables.nodes]
fields = [{name = "uid", type = "i64", primary_key = true}]
"""


@pytest.fixture
def db(spark):
    d = Database(spark, S.loads(TEXT))
    d.register("point", 1)
    return d


def test_crud(db):
    e = db.create_entity()
    db.insert("point", e, x=1.0, y=2.0, tag=42)
    assert db.get("point", e) is None and not db.contains("point", e)
    assert db.commit() == 1
    assert db.get("point", e) == {"entity_id": e, "x": 1.0, "y": 2.0, "tag": 42}
    db.update("point", e, x=3.0, y=4.0, tag=43)
    assert db.commit() == 2 and db.get("point", e)["tag"] == 43
    with pytest.raises(CommitError, match="components"):
        db.delete_entity(e)
    db.delete("point", e)
    assert db.commit() == 3 and db.get("point", e) is None and db.count("point") == 0
    db.delete_entity(e)
    assert db.commit() == 3 and db.create_entity() == e
    assert [(r.version, r.first_op_type, r.operation_count) for r in db.delta_log().collect()] == [(3, "delete", 1), (2, "update", 1), (1, "insert", 1)]


def test_failing_batches_leave_nothing(db):
    a = db.create_entity()
    with db.transaction() as t:
        t.insert("point", a, x=0.0, y=0.0, tag=1)
    for bad in (lambda t: t.delete("point", db.create_entity()), lambda t: t.update("point", 99, x=0.0, y=0.0, tag=1), lambda t: t.insert("none", a), lambda t: t.insert("point", a, x=1.0)):
        with pytest.raises(CommitError), db.transaction() as t:
            t.update("point", a, x=9.0, y=9.0, tag=9)
            bad(t)
        assert db.version == 1 and db.get("point", a)["tag"] == 1
    with db.transaction() as t:
        t.delete("point", a)
        t.insert("point", a, x=5.0, y=5.0, tag=5)
        t.update("point", a, x=6.0, y=6.0, tag=6)
    assert db.get("point", a)["tag"] == 6 and db.count("point") == 1


def test_references(db):
    db.register("link", 2)
    db.register("nodes", 3)
    a, b = db.create_entity(), db.create_entity()
    with db.transaction() as t:
        t.insert("nodes", a, uid=7)
        t.insert("link", b, target=7)
    with pytest.raises(CommitError, match="no row in nodes"), db.transaction() as t:
        t.insert("link", a, target=8)
    assert {tuple(r) for r in db.archetypes().collect()} == {(a, 8), (b, 4)}


def test_json_and_catalogue(db):
    e = db.create_entity()
    db.insert_json("point", e, '{"x": 1.5, "y": 2.5, "tag": 42, "more": 0}')
    assert db.entities_json("point", 10).first().json == '{"x":1.5,"y":2.5,"tag":42}'
    for bad in ('{"x": 1.5, "y": 2.5}', '{"x": 1, "y": 1, "tag": -1}', "[]"):
        with pytest.raises(CommitError):
            db.update_json("point", e, bad)
    assert db.sql("SELECT tag FROM point").first().tag == 42
    assert (db.table_id("point"), db.table_name(1), db.table_count(), db.table_names(), db.table_id("x")) == (1, "point", 1, ["point"], None)
    db.register("point", 1)
    for name, i in (("nothing", 5), ("point", 2), ("link", 1), ("link", 64)):
        with pytest.raises(ValueError):  # noqa: PT011
            db.register(name, i)
    assert [tuple(r) for r in db.dimension().collect()] == [(1, "point")] and db.entities("point", 1, 1).collect() == []


def test_recovery(spark, tmp_path):
    store = Store(spark, str(tmp_path), Config(log_bucket=2))
    schema = S.loads(TEXT)
    db = Database(spark, schema, store, cut=2)
    db.register("point", 1)
    ids = [db.create_entity() for _ in range(4)]
    for k, e in enumerate(ids):
        with db.transaction() as t:
            t.insert("point", e, x=float(k), y=0.0, tag=k)
        if k == 1:
            db.snapshot()
    with db.transaction() as t:
        t.delete("point", ids[0])
    open_ended = spark.createDataFrame([(9, 0, "insert", 99, (1.0, 1.0, 1))], store.log("point").schema)
    store.append("point", open_ended)
    again = Database.recovered(spark, schema, store, {"point": 1})
    assert again.version == 5 == store.current() and {r.tag for r in again.tables["point"].collect()} == {1, 2, 3}
    assert again.create_entity() == ids[-1] + 1
    assert {r.tag for r in store.recover(until=3)[1]["point"].collect()} == {0, 1, 2}
    assert store.compact() == 5 and store.versions() == [5]
    assert {r.tag for r in store.recover()[1]["point"].collect()} == {1, 2, 3}
    assert not [b for b in store.files.names(f"{tmp_path}/log/point") if b in ("bucket=0", "bucket=1")]


def test_snapshots(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read() == (0, {}) and store.current() == 0
    for v in (1, 2, 3):
        store.write({"t": spark.range(v * 10).withColumnRenamed("id", "entity_id")}, v)
    assert store.read()[1]["t"].count() == 30 and store.read(1)[1]["t"].count() == 10
    assert store.prune() == [1] and store.versions() == [2, 3]
    store.publish(3)
    store.publish(2)
    assert store.current() == 2
    spark.range(5).withColumnRenamed("id", "entity_id").write.mode("append").parquet(f"{tmp_path}/snapshots/v={3:012d}/t")
    with pytest.raises(CorruptSnapshot):
        store.read()
    assert store.read(verify=False)[0] == 3
    store.files.delete(f"{tmp_path}/snapshots/v={3:012d}/_manifest.json")
    assert store.read()[0] == 2
    assert store.compact(archive=True) == 2


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "entity_id long, s string")
    export_csv(df, f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True, schema=df.schema).count() == 2
    export_json({"t": df}, f"{tmp_path}/json")
    assert sorted(import_json(spark, f"{tmp_path}/json", {"t": df.schema})["t"].collect()) == sorted(df.collect())
    rewrite(df, f"{tmp_path}/r", "entity_id")
    assert spark.read.parquet(f"{tmp_path}/r").count() == 2
    ratios = spark.createDataFrame([("a", 0.5), ("b", 0.1)], "t string, ratio double")
    assert [r.t for r in needing_compaction(ratios, 0.3).collect()] == ["a"]
