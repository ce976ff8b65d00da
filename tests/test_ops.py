"""Random op sequences against a dict."""

from __future__ import annotations

import random

import pyspark.sql.functions as F
import pytest

from cairn.operators import conflict, delta, entity, ops, scan

BASE = {k: k * 10.0 for k in range(0, 12, 2)}


def sequence(seed, kinds=("insert", "update", "delete"), n=120):
    r = random.Random(seed)
    return [(i // 5, i % 5, r.choice(kinds), r.randint(0, 14), float(i)) for i in range(n)]


def frames(spark, rows, base=BASE):
    log = spark.createDataFrame(rows, "version long, seq long, op string, entity_id long, value double").withColumn("data", F.struct("value")).drop("value")
    return log, spark.createDataFrame(list(base.items()) or [], "entity_id long, value double")


@pytest.mark.parametrize("seed", range(3))
def test_fold_legality_and_capture(spark, seed):
    rows = sequence(seed)
    log, base = frames(spark, rows)
    state, bad, seen = dict(BASE), set(), []
    for v, s, op, k, x in rows:
        if op != "insert" and k not in state:
            bad.add((v, s))
        if op == "insert":
            state[k] = x
        elif op == "delete":
            state.pop(k, None)
        elif k in state:
            state[k] = x
    assert {(r.version, r.seq) for r in ops.illegal(log, base).collect()} == bad
    legal = [r for r in rows if r[:2] not in bad]
    log, base = frames(spark, legal)
    assert {r.entity_id: r.value for r in ops.fold(base, log).collect()} == state
    now = dict(BASE)
    for v, s, op, k, x in legal:
        old = now.get(k)
        if op == "delete":
            del now[k]
            seen.append((v, s, "delete", k, old, None))
        else:
            now[k] = x
            seen.append((v, s, "insert" if old is None else "update", k, old, x))
    got = [(r.version, r.seq, r.op, r.entity_id, r.old and r.old.value, r.new and r.new.value) for r in delta.capture(log, base).collect()]
    assert sorted(got, key=lambda r: r[:2]) == seen


def test_insert_then_delete_in_one_batch(spark):
    log, base = frames(spark, [(1, 0, "insert", 100, 1.0), (1, 1, "delete", 100, 0.0), (1, 2, "update", 2, 5.0), (1, 3, "update", 2, 6.0)])
    assert ops.illegal(log, base).isEmpty()
    got = {(r.seq, r.op, r.old and r.old.value, r.new and r.new.value) for r in delta.capture(log, base).collect()}
    assert got == {(0, "insert", None, 1.0), (1, "delete", 1.0, None), (2, "update", 20.0, 5.0), (3, "update", 5.0, 6.0)}


@pytest.mark.parametrize("seed", range(2))
def test_feed_with_repeats_and_cascades(spark, seed):
    rows = sequence(seed, ("insert", "update", "delete", "create_entity", "delete_entity"))
    state = dict(BASE)
    for v, _, op, k, x in rows:
        if v <= 3:
            continue
        if op in ("insert", "update"):
            state[k] = x
        elif op in ("delete", "delete_entity"):
            state.pop(k, None)
    shuffled = rows + rows[::3]
    random.Random(seed).shuffle(shuffled)
    log, base = frames(spark, shuffled)
    assert {r.entity_id: r.value for r in ops.apply_feed(base, log, since=3).collect()} == state


def test_replay(spark):
    rows = [(1, 0, "insert", 1, 1.0), (1, 9, "commit", None, None), (2, 0, "insert", 2, 2.0), (2, 9, "rollback", None, None), (3, 0, "insert", 3, 3.0), (4, 0, "delete", 1, None), (4, 9, "commit", None, None), (5, 0, "insert", 5, 5.0), (5, 8, "commit", None, None), (5, 9, "rollback", None, None)]
    log, _ = frames(spark, rows)
    log = log.withColumnsRenamed({"version": "transaction_id", "seq": "sequence"})
    none = spark.createDataFrame([], "entity_id long, value double")
    assert ops.replay(none, log).collect() == [] and [r.entity_id for r in ops.replay(none, log.where("transaction_id < 4")).collect()] == [1]
    assert [tuple(r) for r in ops.incomplete(log).collect()] == [(3, 1)] and ops.last_version(log).first().version == 5
    base = spark.createDataFrame([(1, 9.0)], "entity_id long, value double")
    assert [r.value for r in ops.replay(base, log, since=4).collect()] == [9.0]


@pytest.mark.parametrize(("changes", "want"), [([], (0, 0, 0.0)), ([1, -1], (1, 0, 1.0)), ([1, -1, 1], (1, 1, 0.0)), ([1, 1, 1, -1], (3, 2, 1 / 3))])
def test_fragmentation(spark, changes, want):
    log = spark.createDataFrame([(i * 40000, c) for i, c in enumerate(changes)], "seq long, change int")
    r = ops.fragmentation(log).first()
    assert (r.peak, r.live) == want[:2] and r.ratio == pytest.approx(want[2])


def conflicts(spark, rows, server):
    kind = "struct<v:int>"
    o = spark.createDataFrame([(1, k, op, old and (old,), new and (new,)) for k, op, old, new in rows], f"table_id int, entity_id long, op string, old {kind}, new {kind}")
    s = spark.createDataFrame([(1, k, (v,)) for k, v in server], f"table_id int, entity_id long, data {kind}")
    return conflict.detected(o, s)


def outcome(df):
    return {r.entity_id: (r.op, r.old and r.old.v, r.new and r.new.v) for r in df.collect()}


def test_conflicts(spark):
    rows = [(1, "update", 10, 11), (2, "update", 99, 21), (3, "delete", 30, None), (4, "delete", 99, None), (5, "insert", None, 51), (6, "insert", None, 61), (7, "update", 70, 71), (8, "create_entity", None, None)]
    found = conflicts(spark, rows, [(1, 10), (2, 20), (3, 30), (4, 40), (5, 50), (8, 80)])
    assert {r.entity_id for r in found.where("conflict").collect()} == {2, 4, 5}
    free = {1: ("update", 10, 11), 3: ("delete", 30, None), 6: ("insert", None, 61), 7: ("update", 70, 71), 8: ("create_entity", None, None)}
    assert outcome(conflict.resolved(found, "server")) == free | {2: ("update", 20, 20), 5: ("update", 50, 50)}
    assert outcome(conflict.resolved(found, "last_write")) == free | {2: ("update", 20, 21), 4: ("delete", 40, None), 5: ("update", 50, 51)}
    merge = lambda a, b: F.struct((a["v"] + b["v"]).alias("v"))
    assert outcome(conflict.resolved(found, "custom", merge)) == free | {2: ("update", 20, 41), 4: ("delete", 40, None), 5: ("update", 50, 101)}
    timed = found.withColumns({"server_ts": F.lit(5), "client_ts": F.when(F.col("entity_id") == 2, 9).otherwise(1)})
    assert outcome(conflict.resolved(timed, "last_write", by_time=("server_ts", "client_ts"))) == free | {2: ("update", 20, 21), 5: ("update", 50, 50)}
    with pytest.raises(ValueError, match="function"):
        conflict.resolved(found, "custom")
    tables = spark.createDataFrame([(2, "other")], "table_id int, table_name string")
    assert [(r.table_name, r.entity_id) for r in conflict.log(found, tables, 2).collect()] == [("1", 5), ("1", 4)]


def test_conflicts_that_arrive_together(spark):
    rows = [(k, "insert", None, k, k % 2) for k in (9, 3, 8, 1, 7, 2, 5)]
    kind = "struct<v:int>"
    found = spark.createDataFrame([(1, k, op, old, (new,), (0,), True, at) for k, op, old, new, at in rows], f"table_id int, entity_id long, op string, old {kind}, new {kind}, current {kind}, conflict boolean, at int")
    tables = spark.createDataFrame([(1, "t")], "table_id int, table_name string")
    for n in (1, 2, 3, 4):
        for parts in (1, 3, 7):
            assert {r.entity_id for r in conflict.log(found.repartition(parts), tables, n, ("at",)).collect()} == set([1, 3, 5, 7][:n])
    assert {r.entity_id for r in conflict.log(found, tables, 6, ("at",)).collect()} == {1, 3, 5, 7, 9, 2}


def test_difference_sees_nulls(spark):
    a = spark.createDataFrame([(1, None), (2, 5), (3, None)], "k int, v int")
    b = spark.createDataFrame([(1, None), (2, None), (4, None)], "k int, v int")
    assert {(r.k, r.op) for r in delta.difference(a, b, "k").collect()} == {(2, "update"), (3, "delete"), (4, "insert")}


def test_entities(spark):
    a = entity.Allocator()
    assert a.create() == 1 and a.get(1) == (1, 0)
    a.delete(1)
    with pytest.raises(KeyError):
        a.get(1)
    assert a.create() == 1 and a.get(1) == (1, 1) and a.records == 2
    assert [a.create(), a.create()] == [2, 3]
    a.delete(2)
    a.delete(3)
    assert [a.create(), a.create(), a.create()] == [3, 2, 4]
    log = spark.createDataFrame([(1, 0, "create_entity"), (1, 1, "delete_entity"), (1, 2, "create_entity"), (2, 3, "create_entity"), (2, 4, "delete_entity")], "entity_id long, seq long, op string")
    assert {tuple(r) for r in entity.entity_fold(log).collect()} == {(1, 1, True), (2, 1, False)}
    assert tuple(entity.entity_counts(log).first()) == (3, 1) and [r.entity_id for r in entity.live(log).collect()] == [1]


def test_archetypes(spark):
    t = {i: spark.createDataFrame([(k,) for k in ks], "entity_id long") for i, ks in {0: [1, 2], 3: [1], 63: [3]}.items()}
    m = entity.archetypes(t)
    assert {tuple(r) for r in m.collect()} == {(1, 9), (2, 1), (3, -(2**63))}
    assert {tuple(r) for r in entity.archetype_sizes(m).collect()} == {(9, 1), (1, 1), (-(2**63), 1)}
    assert [r.entity_id for r in entity.composed([t[0]], [t[3]]).collect()] == [2]
    assert [r.entity_id for r in entity.by_archetype(t[0], m).collect()] == [2, 1]


def test_search_and_predicates(spark):
    df = spark.createDataFrame([("Alpha", 12, None), ("beta", 3, "x"), (None, 31, "Yy")], "a string, n int, b string")
    assert scan.search(df, "").count() == 3 and [r.n for r in scan.search(df, "ALPH").collect()] == [12]
    assert sorted(r.n for r in scan.search(df, "3").collect()) == [3, 31] and [r.n for r in scan.search(df, "yy").collect()] == [31]
    assert [r.n for r in df.where(scan.predicate("b", "IS NULL")).collect()] == [12]
    with pytest.raises(ValueError, match="unknown operator"):
        scan.predicate("a", "~", 1)
    with pytest.raises(ValueError, match="unknown join"):
        scan.Query({}, []).join("t", "a", "b", "full")
    assert scan.page(df, "n", 5, 2).count() == 1 and scan.page(df, "n", 5, 99).count() == 0


def test_values_are_never_parsed(spark):
    df = spark.createDataFrame([("x' OR '1'='1",), ("x",)], "a string")
    assert df.where(scan.predicate("a", "=", "x' OR '1'='1")).count() == 1


def test_joins_follow_foreign_keys(spark):
    from cairn import schema as S
    from cairn.operators import scan

    text = '[database]\nname = "d"\n[tables.a]\nfields = [{name = "x", type = "i64", primary_key = true}]\n[tables.b]\nfields = [{name = "y", type = "i64", foreign_key = "a.x"}]\n[tables.c]\nfields = [{name = "z", type = "i64"}]\n'
    tables = {"a": spark.createDataFrame([(1,), (2,)], "x long"), "b": spark.createDataFrame([(1,), (1,), (9,)], "y long"), "c": spark.createDataFrame([(5,)], "z long")}
    q = lambda source: scan.Query(tables, [source], schema=S.loads(text))
    assert q("b").link("b", "a") == ("b.y", "a.x") and q("b").link("a", "b") == ("a.x", "b.y")
    assert sorted(tuple(r) for r in q("b").join_linked("a").build().collect()) == [(1, 1), (1, 1)]
    assert sorted((r.x, r.y) for r in q("a").join_linked("b", kind="left").order_by("a.x").build().collect() if r.y is None) == [(2, None)]
    with pytest.raises(ValueError, match="linked with 0 of a"):
        q("a").join_linked("c")
    with pytest.raises(ValueError, match="need a schema"):
        scan.Query(tables, ["a"]).link("a", "b")
    assert [r.y for r in q("b").order_by("b.y", True).limit(2, 1).select("b.y").build().collect()] == [1, 1]


def test_pages_after_a_key(spark):
    from cairn.operators import scan

    df = spark.range(100)
    assert [r.id for r in scan.page_after(df, "id", 3).collect()] == [0, 1, 2] and [r.id for r in scan.page_after(df, "id", 3, 50).collect()] == [51, 52, 53]
    assert scan.page_after(df, "id", 3, 99).collect() == []


def test_sealed_entries(spark):
    from cairn.operators import ops

    log = ops.sealed(spark.createDataFrame([(1, 0, None), (1, 1, "x")], "transaction_id long, sequence long, data string"))
    assert ops.tampered(log).collect() == []
    assert [r.sequence for r in ops.tampered(log.replace("x", "y", "data")).collect()] == [1]
