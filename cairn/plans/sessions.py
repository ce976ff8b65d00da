"""Queries that go through a Database, its store, its commands and its feeds, and SQL that gives the same rows.

A transaction's ops come from the driver by their nature, so these read the small tables region and nation; the operators behind them are those
of the catalogue.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import registry
from .. import schema as S
from ..commands import Commands
from ..config import Config
from ..database import CommitError, Database
from ..functions import tables as own_functions
from ..functions import values
from ..operators import conflict, delta, entity, ops, scan
from ..sources.files import Files, scratch
from ..sources.store import Store, export_csv, export_json, import_json
from ..streaming import feed as stream
from ..streaming import sync
from .catalogue import event_ops, merge_sides, query, read, wal

WORLD = """
[database]
name = "world"
[tables.region]
fields = [{name = "regionkey", type = "i64", primary_key = true}]
[tables.nation]
fields = [{name = "nationkey", type = "i64", primary_key = true}, {name = "regionkey", type = "i64", foreign_key = "region"}]
"""
IDS = {"region": 3, "nation": 5}


def folder(spark: SparkSession) -> str:
    return Files(spark).temporary(f"{scratch(spark)}/{uuid.uuid4().hex}")


def world(spark: SparkSession, sf: str, store: Store | None = None) -> tuple[Database, dict[int, int], list[tuple[int, int, int]]]:
    """A database with the regions committed; entity by region key; (entity, nation key, region key) of nations that aren't."""
    db = Database(spark, S.loads(WORLD), store)
    for name, i in IDS.items():
        db.register(name, i)
    regions = {r[0]: db.create_entity() for r in read(spark, sf, "region").select("r_regionkey").orderBy("r_regionkey").collect()}
    nations = [(db.create_entity(), *r) for r in read(spark, sf, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()]
    with db.transaction() as t:
        for key, e in regions.items():
            t.insert("region", e, regionkey=key)
    return db, regions, nations


def fails(db: Database, *steps: tuple) -> None:
    """A transaction that must not go through."""
    try:
        with db.transaction() as t:
            for op, *rest, row in steps:
                getattr(t, op)(*rest, **row)
    except CommitError:
        return
    raise AssertionError("an illegal batch was committed")


_WORLD_SQL = "WITH r AS (SELECT r_regionkey, row_number() OVER (ORDER BY r_regionkey) AS entity_id FROM region), n AS (SELECT n_nationkey, n_regionkey, (SELECT count(*) FROM region) + row_number() OVER (ORDER BY n_nationkey) AS entity_id FROM nation) "


@query(_WORLD_SQL + "SELECT 'region' AS table_name, entity_id, r_regionkey AS key, NULL::BIGINT AS regionkey FROM r UNION ALL SELECT 'nation', entity_id, n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 1 ELSE n_regionkey END FROM n WHERE n_nationkey % 3 <> 0")
def commit_atomic(spark: SparkSession, sf: str) -> DataFrame:
    """What recovery gives after good transactions, failed ones over two tables, a rolled-back and a half-written one."""
    store = Store(spark, folder(spark))
    db, regions, nations = world(spark, sf, store)
    first = nations[0][0]
    with db.transaction() as t:
        for e, key, region in nations:
            t.insert("nation", e, nationkey=key, regionkey=region)
    fails(db, ("insert", "region", first, {"regionkey": 99}), ("update", "region", nations[1][0], {"regionkey": 98}))  # the second has no row
    fails(db, ("insert", "region", first, {"regionkey": 97}), ("update", "nation", first, {"nationkey": 0, "regionkey": 555}))  # no such region
    with db.transaction() as t:
        for e, key, region in nations:
            if key % 3 == 0:
                t.delete("nation", e)
            elif key % 4 == 0:
                t.update("nation", e, nationkey=key, regionkey=1)
    entries = store.entries("region")
    for op in ("rollback", None):  # the version after the last, written in part, and once rolled back
        left = entries.select(F.lit(4).cast("long").alias("transaction_id"), "sequence", F.lit("delete").alias("op"), "entity_id", "data").limit(3)
        attempt = uuid.uuid4().hex
        store.append("region", left, attempt)
        if op:
            store.mark(4, attempt, op)
    _, tables = store.recover()
    region = tables["region"].select(F.lit("region").alias("table_name"), "entity_id", F.col("regionkey").alias("key"), F.lit(None).cast("long").alias("regionkey"))
    return region.unionByName(tables["nation"].select(F.lit("nation").alias("table_name"), "entity_id", F.col("nationkey").alias("key"), "regionkey"))


@query("SELECT l_orderkey AS transaction_id, count(*) AS entries FROM lineitem WHERE l_partkey % 50 = 0 GROUP BY l_orderkey")
def wal_tamper(spark: SparkSession, sf: str) -> DataFrame:
    """Log entries whose data were changed after they were sealed."""
    log = ops.sealed(wal(spark, sf).withColumn("timestamp", F.lit(1).cast("long")))
    changed = log.withColumn("data", F.when(F.col("entity_id") % 50 == 0, F.struct((F.col("data.quantity") + 1).alias("quantity"))).otherwise(F.col("data")))
    return ops.tampered(changed).groupBy("transaction_id").agg(F.count("*").alias("entries"))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS entity_id, CASE WHEN n_nationkey IN (15, 20) THEN 1 ELSE 0 END::BIGINT AS version FROM nation QUALIFY n_nationkey NOT IN (0, 5, 10)")
def entity_recover(spark: SparkSession, sf: str) -> DataFrame:
    """Entities without rows, deleted ones and reused ids, after recovery."""
    store = Store(spark, folder(spark))
    db = Database(spark, S.loads(WORLD), store)
    ids = {r[0]: db.create_entity() for r in read(spark, sf, "nation").select("n_nationkey").orderBy("n_nationkey").collect()}
    for key in sorted(ids):
        if key % 5 == 0:
            db.delete_entity(ids[key])
    db.commit()
    db.snapshot()
    for _ in range(2):  # the ids freed last
        db.create_entity()
    db.commit()
    return Database.recovered(spark, db.schema, store, {}).live_entities()


_ENTITY_OPS = "WITH o AS (SELECT event_id AS seq, user_id AS entity_id, event_type = 'error' AS gone FROM events WHERE event_type IN ('error', 'purchase')), f AS (SELECT entity_id, count(*) FILTER (WHERE gone) AS version, max_by(gone, seq) AS dead, max(seq) AS freed FROM o GROUP BY entity_id) "


def entity_log(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return read(spark, sf, "events").where(kind.isin("error", "purchase")).select(F.col("event_id").alias("seq"), F.when(kind == "error", "delete_entity").otherwise("create_entity").alias("op"), F.col("user_id").alias("entity_id"))


@query(_ENTITY_OPS + "SELECT entity_id, version, NOT dead AS alive, CASE WHEN dead THEN freed END AS freed FROM f")
def entity_registry(spark: SparkSession, sf: str) -> DataFrame:
    return registry.fold(spark.createDataFrame([], registry.ENTITIES), entity_log(spark, sf))


@query(_ENTITY_OPS + "SELECT entity_id, version, row_number() OVER (ORDER BY freed DESC) AS place FROM f WHERE dead")
def free_list(spark: SparkSession, sf: str) -> DataFrame:
    return registry.free_order(registry.fold(spark.createDataFrame([], registry.ENTITIES), entity_log(spark, sf)))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS entity_id, n_nationkey AS nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE n_regionkey END AS regionkey FROM nation QUALIFY n_nationkey <= 4 AND n_nationkey <> 3")
def json_dml(spark: SparkSession, sf: str) -> DataFrame:
    """Immediate inserts, updates and deletes of rows given as JSON."""
    db = Database(spark, S.loads(WORLD.replace(', foreign_key = "region"', "")))
    db.register("nation", 5)
    for key, region in read(spark, sf, "nation").where("n_nationkey <= 4").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect():
        e = db.create_entity()
        db.insert_json("nation", e, f'{{"nationkey": {key}, "regionkey": {region}, "more": [1]}}')
        if key % 2 == 0:
            db.update_json("nation", e, f'{{"nationkey": {key}, "regionkey": 0}}')
        if key == 3:
            db.delete("nation", e)
            db.commit()
    return db.tables["nation"]


@query("SELECT * FROM (VALUES (3, 'region', (SELECT count(*) FROM region)), (5, 'nation', 0::BIGINT)) AS t(table_id, table_name, rows)")
def registered_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Ids, names and counts of registered tables, again after the same registration."""
    db, *_ = world(spark, sf)
    db.register("region", 3)
    return entity.counts(db.tables).join(db.dimension(), "table_name").select("table_id", "table_name", "rows")


@query(_WORLD_SQL + "SELECT 1::BIGINT AS version, -(SELECT count(*) FROM region) - (SELECT count(*) FROM nation) - 1 + entity_id AS seq, 'create_entity' AS op, NULL::INTEGER AS table_id, entity_id FROM (SELECT entity_id FROM r UNION ALL SELECT entity_id FROM n) UNION ALL SELECT 1, entity_id - 1, 'insert', 3, entity_id FROM r")
def entity_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """The first delta of a database: its entities, then its rows."""
    seen: list[DataFrame] = []
    db = Database(spark, S.loads(WORLD))
    for name, i in IDS.items():
        db.register(name, i)
    db.on_commit.append(seen.append)
    regions = [db.create_entity() for _ in range(read(spark, sf, "region").count())]
    for _ in range(read(spark, sf, "nation").count()):
        db.create_entity()
    with db.transaction() as t:
        for k, e in enumerate(regions):
            t.insert("region", e, regionkey=k)
    return seen[0].select("version", "seq", "op", "table_id", "entity_id")


@query("SELECT * FROM (VALUES ('compacted', 'region'), ('left', 'nation')) AS t(what, table_name)")
def compact_fragmented(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of which 0.3 of the slots or more are free are rewritten, the others aren't."""
    db, regions, _ = world(spark, sf)
    with db.transaction() as t:
        for key in (0, 2):
            t.delete("region", regions[key])
    done = db.compact_if_fragmented()
    return spark.createDataFrame([("compacted" if n in done else "left", n) for n in db.table_names()], "what string, table_name string")


@query("SELECT c_custkey AS entity_id, c_acctbal FROM customer WHERE c_custkey % 2 = 0")
def snapshot_prune(spark: SparkSession, sf: str) -> DataFrame:
    """The newest of three snapshots, of which two are kept."""
    store = Store(spark, folder(spark))
    rows = read(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"), "c_acctbal")
    for v, own in ((1, rows.limit(10)), (2, rows.limit(0)), (3, rows.where("entity_id % 2 = 0"))):
        store.write({"customer": own}, v)
    assert store.prune() == [1] and store.versions() == [2, 3]
    return store.read()[1]["customer"]


# replication


@query("SELECT c_custkey AS entity_id, c_name, c_acctbal FROM customer")
def full_sync(spark: SparkSession, sf: str) -> DataFrame:
    """A table sent in chunks and put together again."""
    rows = read(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"), "c_name", "c_acctbal")
    chunks = sync.full({"customer": rows}, 1, rows_per_chunk=100)
    at = f"{folder(spark)}/chunks"
    chunks.write.parquet(at)  # type: ignore[union-attr]
    return sync.received(spark.read.parquet(at), "customer")


@query("SELECT event_id AS version FROM events WHERE event_id > 50 AND event_id <= 400")
def catch_up(spark: SparkSession, sf: str) -> DataFrame:
    feed = event_ops(spark, sf)
    return sync.catch_up(feed.unionByName(feed.where("version % 7 = 0")), 50, 400).select("version")


@query("SELECT * FROM (VALUES ('b', 'ready', 7::BIGINT, [2, 3]), ('c', 'connecting', 0, []::INTEGER[])) AS t(client_id, state, client_version, subscribed_tables)")
def client_sessions(spark: SparkSession, sf: str) -> DataFrame:
    clients = stream.Clients(spark, 3)
    for name, tables in (("a", None), ("b", [2, 3]), ("c", None)):
        clients.add(name, tables)
    clients.set("b", state="ready", version=7)
    clients.remove("a")
    return clients.frame()


@query("SELECT * FROM (SELECT unnest(['version', 'deltas', 'ops', 'clients', 'lag']) AS name, unnest([max(event_id), count(*), count(*), 3, max(event_id)])::BIGINT AS value FROM events)")
def feed_metrics(spark: SparkSession, sf: str) -> DataFrame:
    sessions = spark.createDataFrame([("a", 100), ("b", 500), ("c", 0)], "client_id string, client_version bigint")
    return spark.createDataFrame([(k, int(v)) for k, v in sync.metrics(spark, event_ops(spark, sf), sessions).items()], "name string, value bigint")


@query("WITH ops AS (SELECT event_id AS v, user_id AS e, event_type FROM events WHERE event_type <> 'purchase'), x AS (SELECT e, max_by({k: event_type, v: v}, v) AS l FROM ops GROUP BY e) SELECT e AS entity_id, l.v AS value FROM x WHERE l.k NOT IN ('error', 'click')")
def replica_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of a replica that followed a feed, was compacted, and followed again what came twice."""
    kind = F.col("event_type")
    feed = read(spark, sf, "events").where(kind != "purchase").select(
        F.col("event_id").alias("version"), F.lit(0).cast("long").alias("seq"), F.when(kind == "error", "delete_entity").when(kind == "click", "delete").otherwise("insert").alias("op"),
        F.lit(1).alias("table_id"), F.col("user_id").alias("entity_id"), F.col("event_id").cast("string").alias("data"),
    )
    at = folder(spark)
    replica = stream.Replica(spark, f"{at}/replica")
    for part in ("version % 2 = 0", "version % 3 < 2", "version % 3 = 2"):
        stream.append(feed.where(part), f"{at}/feed")
        replica.follow(stream.read(spark, f"{at}/feed")).awaitTermination()
        if part == "version % 3 < 2":
            replica.compact()
    return replica.table(1).select("entity_id", F.col("data").cast("bigint").alias("value"))


_ARRIVED = "SELECT 'part' AS table_name, id AS entity_id, op, cur AS server_size, new AS client_size, id * 7919 % 100003 AS arrival, 12::BIGINT AS server_version, 9::BIGINT AS client_version FROM found WHERE conflict ORDER BY arrival DESC LIMIT 1000"
_CONFLICTS = """WITH server AS (SELECT p_partkey AS id, p_size AS cur FROM part WHERE p_partkey % 10 <> 0),
client AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' ELSE 'delete' END AS op, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN p_size - 1 ELSE p_size END AS old, CASE WHEN p_partkey % 3 < 2 THEN p_size + 5 END AS new FROM part),
found AS (SELECT c.*, cur, s.id IS NOT NULL AND (op = 'insert' OR cur IS DISTINCT FROM old) AS conflict FROM client c LEFT JOIN server s ON c.id = s.id) """


@query(_CONFLICTS + _ARRIVED)
def conflict_ring(spark: SparkSession, sf: str) -> DataFrame:
    """The last conflicts by arrival, with the versions of both sides."""
    found = merge_sides(spark, sf).withColumns({"arrival": F.col("entity_id") * 7919 % 100003, "server_version": F.lit(12).cast("long"), "client_version": F.lit(9).cast("long")})
    tables = spark.createDataFrame([(7, "part")], "table_id int, table_name string")
    last = conflict.log(found, tables, 1000, ("arrival",), ("arrival", "server_version", "client_version"))
    return last.select("table_name", "entity_id", "op", F.col("server_value.size").alias("server_size"), F.col("client_value.size").alias("client_size"), "arrival", "server_version", "client_version")


@query(_CONFLICTS + "SELECT id AS entity_id, 'size' AS field, cur::VARCHAR AS server_value, new::VARCHAR AS client_value FROM found WHERE conflict AND new IS NOT NULL AND cur IS DISTINCT FROM new")
def conflict_fields(spark: SparkSession, sf: str) -> DataFrame:
    return conflict.fields(merge_sides(spark, sf), "size").select("entity_id", "field", "server_value", "client_value")


@query(_CONFLICTS + "SELECT id AS entity_id, 13::BIGINT AS version, greatest(id % 5, id % 7) AS timestamp FROM found WHERE NOT (conflict AND op = 'delete')")
def conflict_stamped(spark: SparkSession, sf: str) -> DataFrame:
    """Version and time of resolved ops."""
    merged = conflict.resolved(merge_sides(spark, sf), "server")
    timed = merged.withColumns({"server_version": F.lit(12).cast("long"), "server_time": F.col("entity_id") % 5, "client_time": F.col("entity_id") % 7})
    return conflict.stamped(timed).select("entity_id", "version", "timestamp")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e) SELECT user_id, min(ts) AS start, count(*) AS events FROM n GROUP BY user_id, s""")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    own = stream.sessions(read(spark, sf, "events").select("ts", "user_id"), "ts", "6 hours", "user_id")
    return own.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "events")


@query("SELECT * FROM (VALUES ('tables', 'nation,region'), ('inserted', '1'), ('updated', '2'), ('rows', '1'), ('json', '{\"regionkey\":4}'), ('deleted', '3'), ('deltas', '3'), ('clients', '1'), ('pending', '0'), ('conflicts', '1'), ('sent', '3')) AS t(command, result)")
def dashboard_commands(spark: SparkSession, sf: str) -> DataFrame:
    """A dashboard's session: schema, rows, replication, conflicts."""
    at = folder(spark)
    c = Commands(spark, Config(tick_ms=20))
    c.db = Database(spark, S.loads(WORLD))
    for name, i in IDS.items():
        c.db.register(name, i)
    c.clients.add("x")
    sent: list[int] = []
    c.folder = at
    c.start_replication(lambda df, _: sent.extend(r.version for r in df.select("version").distinct().collect()))
    e = c.create_entity()
    out = [("tables", ",".join(c.get_tables())), ("inserted", c.insert_component("region", e, '{"regionkey": 3}')), ("updated", c.update_component("region", e, '{"regionkey": 4}'))]
    out += [("rows", c.get_entity_count("region")), ("json", c.fetch_entities_json("region", 1)[0][1]), ("deleted", c.delete_component("region", e)), ("deltas", len(c.get_delta_log())), ("clients", c.get_connected_clients())]
    c.running.processAllAvailable()  # type: ignore[union-attr]
    c.stop_replication()
    kind = "struct<regionkey:bigint>"
    c.merge(spark.createDataFrame([(3, 7, "update", (1,), (2,))], f"table_id int, entity_id long, op string, old {kind}, new {kind}"), spark.createDataFrame([(3, 7, (5,))], f"table_id int, entity_id long, data {kind}"))
    out += [("pending", c.get_pending_delta_count()), ("conflicts", len(c.get_conflict_log())), ("sent", len(set(sent)))]
    return spark.createDataFrame([(k, str(v)) for k, v in out], "command string, result string")


# schemas, builder, exports, functions

_FAULTS = {
    "good": "fields = [{name = 'a', type = 'i32', primary_key = true}]",
    "reserved": "fields = [{name = 'version', type = 'i32'}]",
    "repeated": "fields = [{name = 'a', type = 'i32'}, {name = 'a', type = 'i32'}]",
    "empty array": "fields = [{name = 'a', type = '[u8; 0]'}]",
    "no such table": "fields = [{name = 'a', type = 'i32', foreign_key = 'u'}]",
    "no such field": "fields = [{name = 'a', type = 'i32', foreign_key = 't.b'}]",
    "other type": "fields = [{name = 'a', type = 'i32', foreign_key = 't.b'}, {name = 'b', type = 'i64', primary_key = true}]",
    "not a key": "fields = [{name = 'a', type = 'i32', foreign_key = 't.b'}, {name = 'b', type = 'i32'}]",
}


@query("SELECT * FROM (VALUES ('good', true), ('reserved', false), ('repeated', false), ('empty array', false), ('no such table', false), ('no such field', false), ('other type', false), ('not a key', false)) AS t(what, valid)")
def schema_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Which schemas pass validation, reserved names being errors."""

    def valid(fields: str) -> bool:
        try:
            S.validate(S.loads(f"[database]\nname = 'd'\n[tables.t]\n{fields}\n"))
        except S.SchemaError:
            return False
        return True

    return spark.createDataFrame([(k, valid(x)) for k, x in _FAULTS.items()], "what string, valid boolean")


_TRADE = """
[database]
name = "trade"
[tables.customer]
fields = [{name = "c_custkey", type = "i64", primary_key = true}, {name = "c_nationkey", type = "i64", foreign_key = "nation"}]
[tables.nation]
fields = [{name = "n_nationkey", type = "i64", primary_key = true}, {name = "n_regionkey", type = "i64", foreign_key = "region"}]
[tables.region]
fields = [{name = "r_regionkey", type = "i64", primary_key = true}]
[tables.orders]
fields = [{name = "o_orderkey", type = "i64", primary_key = true}, {name = "o_custkey", type = "i64", foreign_key = "customer"}]
"""


@query("SELECT n_name, count(*) AS orders, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 1000 GROUP BY n_name ORDER BY orders DESC, n_name LIMIT 7 OFFSET 2")
def builder_joins(spark: SparkSession, sf: str) -> DataFrame:
    """Joins along foreign keys, groups, order and limit of the query builder."""
    q = scan.Query({n: read(spark, sf, n) for n in ("orders", "customer", "nation", "region")}, ["orders"], schema=S.loads(_TRADE))
    q.join_linked("customer").join_linked("nation").join_linked("region").where("o_totalprice", ">", 1000)
    q.group_by("n_name", orders=F.count("*"), total=F.sum("o_totalprice")).order_by("orders", True).order_by("n_name").limit(7, 2)
    return q.build()


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 40")
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page after a key."""
    return scan.page_after(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 40, 500)


@query("SELECT l_returnflag, l_linestatus, round(avg(l_discount), 9) AS avg_disc, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    own = read(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_discount", "l_suppkey")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return own.groupingSets([[flag], [status], []], flag, status).agg(F.round(F.avg("l_discount"), 9).alias("avg_disc"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT p_partkey AS entity_id, unnest(list_filter(range(64), lambda i: CASE WHEN i = 63 THEN p_partkey % 3 = 0 WHEN i < 16 THEN (p_size >> i) & 1 = 1 ELSE false END))::INTEGER AS table_id FROM part")
def user_table_function(spark: SparkSession, sf: str) -> DataFrame:
    """A table function that a user registered, called from SQL."""
    own_functions.register(spark)
    top = F.when(F.col("p_partkey") % 3 == 0, F.lit(-(2**63))).otherwise(F.lit(0))
    name = f"masks_{uuid.uuid4().hex}"
    read(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), (F.col("p_size").cast("long").bitwiseOR(top)).alias("mask")).createOrReplaceTempView(name)
    return spark.sql(f"SELECT entity_id, table_id FROM {name}, LATERAL tables_of_mask(mask)")


@query("SELECT p_brand, round(exp(avg(ln(p_size))), 6) AS mean FROM part WHERE p_size > 0 GROUP BY p_brand")
def user_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """An aggregate that a user wrote over Arrow batches."""
    own_functions.register(spark)
    return read(spark, sf, "part").select("p_brand", F.col("p_size").cast("double").alias("size")).groupBy("p_brand").agg(F.round(own_functions.geometric_mean("size"), 6).alias("mean"))


@query("SELECT s_suppkey AS entity_id, s_name, s_acctbal FROM supplier")
def json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    own = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity_id"), "s_name", "s_acctbal")
    at = folder(spark)
    export_json({"supplier": own}, at)
    return import_json(spark, at, {"supplier": own.schema})["supplier"]


@query("SELECT s_suppkey AS entity_id, s_name, s_acctbal FROM supplier")
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    own = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity_id"), "s_name", "s_acctbal")
    at = folder(spark)
    export_csv(own, at)
    return spark.read.csv(at, header=True, schema=own.schema)


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


@query(
    f"WITH t AS (SELECT {_crc_table()}::BIGINT[] AS tab), b AS (SELECT c_custkey, list_prepend(4294967295::BIGINT, list_transform(string_split(c_name, ''), lambda x: ord(x)::BIGINT)) AS bytes FROM customer) "
    "SELECT c_custkey, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS crc FROM b, t"
)
def crc32_rows(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").select("c_custkey", values.checksum(F.col("c_name")).alias("crc"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_id / 1000 AS bucket FROM events WHERE event_id < 5000".replace("event_id / 1000", "event_id // 1000"))
def log_order(spark: SparkSession, sf: str) -> DataFrame:
    """Entries numbered within their entity, with the log's bucket."""
    own = read(spark, sf, "events").where("event_id < 5000").select("event_id", "user_id")
    return delta.numbered(own, "user_id", "event_id").select("event_id", F.col("seq").cast("long").alias("seq"), F.floor(F.col("event_id") / 1000).alias("bucket"))


@query("SELECT mask, count(*) AS entities, min(entity_id) AS first FROM (SELECT p_partkey AS entity_id, p_size % 4 AS mask FROM part) GROUP BY mask")
def reorder_by_archetype(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in an order that keeps archetypes together: a run of each mask, counted as the rows come."""
    own = read(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), (F.col("p_size") % 4).alias("mask"))
    ordered = entity.by_archetype(own.select("entity_id"), own).join(own, "entity_id")
    first = Window.partitionBy("mask").orderBy("entity_id")
    return ordered.withColumn("first", F.first("entity_id").over(first)).groupBy("mask").agg(F.count("*").alias("entities"), F.min("first").alias("first"))
