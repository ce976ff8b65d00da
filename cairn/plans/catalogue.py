"""The queries of the library over the sample tables, and SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import masks, values
from ..functions.json import decode, encode
from ..operators import conflict, delta, entity, ops, scan
from ..sources.files import Files, scratch
from ..sources.store import Store
from ..streaming import feed as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def temporary(spark: SparkSession) -> str:
    """A new folder that goes when the application ends."""
    return Files(spark).temporary(f"{scratch(spark)}/{uuid.uuid4().hex}")


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# scans and predicates


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def component_scan(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT * FROM customer WHERE c_custkey = 42")
def point_get(spark: SparkSession, sf: str) -> DataFrame:
    return scan.point(read(spark, sf, "customer"), "c_custkey", 42)


@query("SELECT c_custkey FROM customer")
def key_scan(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").select("c_custkey")


@query("SELECT * FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40")
def paged_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scan.page(read(spark, sf, "customer"), "c_custkey", 20, 40)


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100")
def ui_page(spark: SparkSession, sf: str) -> DataFrame:
    return scan.ui_page(read(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", 3, 50)


@query("SELECT n_nationkey, to_json({n_name: n_name, n_regionkey: n_regionkey})::VARCHAR AS json FROM nation ORDER BY n_nationkey LIMIT 10 OFFSET 5")
def paged_json(spark: SparkSession, sf: str) -> DataFrame:
    return scan.page_json(read(spark, sf, "nation"), "n_nationkey", 10, 5)


for _name, _op, _value, _sql in (
    ("eq", "=", "R", "= 'R'"),
    ("ne", "!=", "R", "<> 'R'"),
    ("in", "IN", ("A", "R"), "IN ('A', 'R')"),
    ("like", "LIKE", "N%", "LIKE 'N%'"),
):
    query(f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag {_sql}", f"pred_{_name}")(
        lambda spark, sf, op=_op, value=_value: read(spark, sf, "lineitem").where(scan.predicate("l_returnflag", op, value)).select("l_orderkey", "l_linenumber", "l_quantity")
    )
for _name, _op in (("gt", ">"), ("lt", "<"), ("ge", ">="), ("le", "<=")):
    query(f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_op} 25", f"pred_{_name}")(
        lambda spark, sf, op=_op: read(spark, sf, "lineitem").where(scan.predicate("l_quantity", op, 25.0)).select("l_orderkey", "l_linenumber", "l_quantity")
    )


@query("SELECT c_custkey FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey WHERE o_custkey IS NULL")
def pred_is_null(spark: SparkSession, sf: str) -> DataFrame:
    big = read(spark, sf, "orders").where("o_totalprice > 400000").select("o_custkey").distinct()
    joined = read(spark, sf, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.where(scan.predicate("o_custkey", "IS NULL")).select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity >= 10 AND l_discount < 0.05 AND l_linestatus = 'O'")
def pred_conjunction(spark: SparkSession, sf: str) -> DataFrame:
    parts = [scan.predicate("l_quantity", ">=", 10.0), scan.predicate("l_discount", "<", 0.05), scan.predicate("l_linestatus", "=", "O")]
    return read(spark, sf, "lineitem").where(scan.conjunction(parts)).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'mit') OR contains(lower(lang), 'mit') OR contains(lower(source), 'mit') OR contains(doc_id::VARCHAR, 'MIT') OR contains(n_chars::VARCHAR, 'MIT')")
def search_any_column(spark: SparkSession, sf: str) -> DataFrame:
    return scan.search(read(spark, sf, "documents"), "MIT").select("doc_id", "lang")


# joins


def builder(spark: SparkSession, sf: str, *source: str) -> scan.Query:
    return scan.Query({t: read(spark, sf, t) for t in ("region", "nation", "customer", "supplier", "orders")}, list(source))


@query("SELECT c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000")
def join_inner(spark: SparkSession, sf: str) -> DataFrame:
    return builder(spark, sf, "customer").join("orders", "customer.c_custkey", "orders.o_custkey").where("orders.o_totalprice", ">", 100000.0).select("c_name", "o_orderkey", "o_totalprice").build()


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_left(spark: SparkSession, sf: str) -> DataFrame:
    return builder(spark, sf, "customer").join("orders", "customer.c_custkey", "orders.o_custkey", "left").select("c_custkey", "o_orderkey").build()


@query("SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(spark: SparkSession, sf: str) -> DataFrame:
    return builder(spark, sf, "supplier").join("nation", "supplier.s_nationkey", "nation.n_nationkey", "right").select("n_name", "s_suppkey").build()


@query("SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey AND n_regionkey = 1")
def join_comma(spark: SparkSession, sf: str) -> DataFrame:
    return builder(spark, sf, "supplier", "nation").where("supplier.s_nationkey", "=", "@nation.n_nationkey").where("nation.n_regionkey", "=", 1).select("s_name", "n_name").build()


@query("SELECT c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_chain(spark: SparkSession, sf: str) -> DataFrame:
    q = builder(spark, sf, "customer").join("nation", "customer.c_nationkey", "nation.n_nationkey").join("region", "nation.n_regionkey", "region.r_regionkey")
    return q.select("c_name", "n_name", "r_name").build()


# entities: customers; components account (2), buyer (1), fulfilled (3)

_COMPONENTS = """WITH account AS (SELECT c_custkey AS entity_id FROM customer WHERE c_acctbal > 0),
buyer AS (SELECT DISTINCT o_custkey AS entity_id FROM orders),
fulfilled AS (SELECT DISTINCT o_custkey AS entity_id FROM orders WHERE o_orderstatus = 'F'),
masks AS (SELECT entity_id, bit_or(b)::BIGINT AS mask FROM (SELECT entity_id, 4::BIGINT AS b FROM account UNION ALL SELECT entity_id, 2 FROM buyer UNION ALL SELECT entity_id, 8 FROM fulfilled) GROUP BY entity_id) """


def components(spark: SparkSession, sf: str) -> dict[int, DataFrame]:
    orders = read(spark, sf, "orders")
    return {
        1: orders.select(F.col("o_custkey").alias("entity_id")).distinct(),
        2: read(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("entity_id")),
        3: orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("entity_id")).distinct(),
    }


@query(_COMPONENTS + "SELECT mask, count(*) AS entities FROM masks GROUP BY mask")
def archetype_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return entity.archetype_sizes(entity.archetypes(components(spark, sf)))


@query(_COMPONENTS + "SELECT entity_id, mask FROM masks")
def archetype_mask(spark: SparkSession, sf: str) -> DataFrame:
    return entity.archetypes(components(spark, sf))


@query(_COMPONENTS + "SELECT entity_id FROM masks WHERE mask = 14")
def entities_in_archetype(spark: SparkSession, sf: str) -> DataFrame:
    return entity.in_archetype(entity.archetypes(components(spark, sf)), masks.of(1, 2, 3)).select("entity_id")


@query(_COMPONENTS + "SELECT entity_id, (mask | 16)::BIGINT AS added, (mask & ~4::BIGINT)::BIGINT AS removed, (mask & 8) > 0 AS has, bit_count(mask)::INTEGER AS tables FROM masks")
def mask_functions(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("mask")
    return entity.archetypes(components(spark, sf)).select("entity_id", masks.add(m, 4).alias("added"), masks.remove(m, 2).alias("removed"), masks.contains(m, 3).alias("has"), F.bit_count(m).alias("tables"))


@query(_COMPONENTS + "SELECT entity_id FROM buyer SEMI JOIN fulfilled USING (entity_id) ANTI JOIN account USING (entity_id)")
def component_composition(spark: SparkSession, sf: str) -> DataFrame:
    c = components(spark, sf)
    return entity.composed([c[1], c[3]], [c[2]])


@query(_COMPONENTS + "SELECT 'account' AS table_name, count(*) AS rows FROM account UNION ALL SELECT 'buyer', count(*) FROM buyer UNION ALL SELECT 'fulfilled', count(*) FROM fulfilled")
def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = components(spark, sf)
    return entity.counts({"account": c[2], "buyer": c[1], "fulfilled": c[3]})


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def fk_violations(spark: SparkSession, sf: str) -> DataFrame:
    return entity.dangling(read(spark, sf, "orders"), "o_custkey", read(spark, sf, "customer").where("c_acctbal > 0"), "c_custkey").select("o_custkey", "o_orderkey")


@query("SELECT c_custkey AS entity_id FROM customer WHERE c_custkey % 10 = 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def restrict_violations(spark: SparkSession, sf: str) -> DataFrame:
    doomed = read(spark, sf, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("entity_id"))
    return entity.restricted(doomed, [components(spark, sf)[3]])


# op log: events by user

_OPS = """WITH ops AS (SELECT event_id AS version, 0::BIGINT AS seq, user_id AS entity_id, value,
CASE event_type WHEN 'signup' THEN 'create_entity' WHEN 'error' THEN 'delete_entity' WHEN 'view' THEN 'delete' ELSE 'update' END AS op,
CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS table_id FROM events) """


def event_ops(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    op = F.when(kind == "signup", "create_entity").when(kind == "error", "delete_entity").when(kind == "view", "delete").otherwise("update")
    return read(spark, sf, "events").select(
        F.col("event_id").alias("version"), F.lit(0).cast("long").alias("seq"), F.col("user_id").alias("entity_id"), op.alias("op"), F.when(kind == "purchase", 2).otherwise(1).alias("table_id"), F.struct("value").alias("data")
    )


def no_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "entity_id long, value double")


@query(_OPS + "SELECT entity_id, count(*) FILTER (WHERE op = 'delete_entity') AS version, max_by(op, version) = 'create_entity' AS alive FROM ops WHERE op IN ('create_entity', 'delete_entity') GROUP BY entity_id")
def entity_fold(spark: SparkSession, sf: str) -> DataFrame:
    return entity.entity_fold(event_ops(spark, sf).drop("seq").withColumnRenamed("version", "seq"))


@query(_OPS + "SELECT count(*) FILTER (WHERE op = 'create_entity') AS created, count(*) FILTER (WHERE op = 'create_entity') - count(*) FILTER (WHERE op = 'delete_entity') AS alive FROM ops")
def entity_counts(spark: SparkSession, sf: str) -> DataFrame:
    return entity.entity_counts(event_ops(spark, sf))


_BATCH = """batch AS (SELECT event_id AS version, 0::BIGINT AS seq, user_id AS entity_id, CASE event_type WHEN 'purchase' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op, value FROM events),
base AS (SELECT c_custkey AS entity_id, c_acctbal AS value FROM customer WHERE c_custkey % 2 = 0) """


def batch_ops(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    kind = F.col("event_type")
    batch = read(spark, sf, "events").select(
        F.col("event_id").alias("version"), F.lit(0).cast("long").alias("seq"), F.col("user_id").alias("entity_id"), F.when(kind == "purchase", "insert").when(kind == "error", "delete").otherwise("update").alias("op"), F.struct("value").alias("data")
    )
    return batch, read(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("entity_id"), F.col("c_acctbal").alias("value"))


@query(
    "WITH " + _BATCH + ", seen AS (SELECT b.*, coalesce(last_value(CASE op WHEN 'insert' THEN true WHEN 'delete' THEN false END IGNORE NULLS) OVER (PARTITION BY b.entity_id ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s.entity_id IS NOT NULL) AS present FROM batch b LEFT JOIN base s ON s.entity_id = b.entity_id) SELECT version, seq, entity_id, op FROM seen WHERE op IN ('update', 'delete') AND NOT present"
)
def batch_legality(spark: SparkSession, sf: str) -> DataFrame:
    return ops.illegal(*batch_ops(spark, sf)).select("version", "seq", "entity_id", "op")


@query("WITH " + _BATCH + ", every AS (SELECT entity_id, -1 AS version, 'insert' AS op, value FROM base UNION ALL SELECT entity_id, version, op, value FROM batch), latest AS (SELECT entity_id, max_by({op: op, value: value}, version) AS x FROM every GROUP BY entity_id) SELECT entity_id, x.value AS value FROM latest WHERE x.op <> 'delete'")
def batch_fold(spark: SparkSession, sf: str) -> DataFrame:
    batch, base = batch_ops(spark, sf)
    return ops.fold(base, batch)


_APPLIED = _OPS + """, hit AS (SELECT version, entity_id, op, value FROM ops WHERE op = 'delete_entity' OR (table_id = 1 AND op IN ('update', 'delete'))),
latest AS (SELECT entity_id, max_by({op: op, value: value}, version) AS x FROM hit GROUP BY entity_id) SELECT entity_id, x.value AS value FROM latest WHERE x.op = 'update'"""


@query(_APPLIED)
def delta_apply(spark: SparkSession, sf: str) -> DataFrame:
    return ops.apply_feed(no_rows(spark), event_ops(spark, sf).where("table_id = 1 or op = 'delete_entity'"))


_WAL = """WITH marks AS (SELECT o_orderkey AS t, CASE o_orderstatus WHEN 'F' THEN 'commit' WHEN 'P' THEN 'rollback' END AS op FROM orders),
latest AS (SELECT l_partkey AS entity_id, max({t: l_orderkey, s: l_linenumber::BIGINT * 1000000000 + (l_extendedprice * 100)::BIGINT, q: l_quantity}) AS x FROM lineitem JOIN marks ON t = l_orderkey AND op = 'commit' WHERE l_orderkey > {since} GROUP BY l_partkey) """


def wal(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as ops of their order's transaction; sequence breaks the ties of repeated line numbers by price."""
    sequence = F.col("l_linenumber").cast("long") * 1000000000 + F.round(F.col("l_extendedprice") * 100).cast("long")
    lines = read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("transaction_id"), sequence.alias("sequence"), F.lit("update").alias("op"), F.col("l_partkey").alias("entity_id"), F.struct(F.col("l_quantity").alias("quantity")).alias("data")
    )
    status = F.col("o_orderstatus")
    marks = read(spark, sf, "orders").where(status != "O").select(F.col("o_orderkey").alias("transaction_id"), F.lit(None).cast("long").alias("sequence"), F.when(status == "F", "commit").otherwise("rollback").alias("op"))
    return lines.unionByName(marks, allowMissingColumns=True)


@query(_WAL.replace("{since}", "100") + "SELECT entity_id, x.q AS quantity FROM latest")
def wal_replay(spark: SparkSession, sf: str) -> DataFrame:
    return ops.replay(spark.createDataFrame([], "entity_id long, quantity double"), wal(spark, sf), since=100)


@query("SELECT l_orderkey AS transaction_id, count(*) AS ops FROM lineitem ANTI JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus <> 'O') USING (l_orderkey) GROUP BY l_orderkey")
def wal_incomplete(spark: SparkSession, sf: str) -> DataFrame:
    return ops.incomplete(wal(spark, sf))


@query("SELECT max(o_orderkey) AS version FROM orders WHERE o_orderstatus = 'F'")
def wal_last_version(spark: SparkSession, sf: str) -> DataFrame:
    return ops.last_version(wal(spark, sf))


@query("SELECT l_orderkey AS transaction_id, count(*) AS next FROM lineitem GROUP BY l_orderkey")
def wal_next_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return ops.next_sequence(wal(spark, sf).where("op = 'update'"))


# deltas

_PARTS = """old AS (SELECT p_partkey, p_size, p_brand FROM part WHERE p_partkey % 10 <> 0),
new AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size, p_brand FROM part WHERE p_partkey % 11 <> 0)"""


@query(
    "WITH " + _PARTS + " SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'insert' WHEN b.p_partkey IS NULL THEN 'delete' ELSE 'update' END AS op, a.p_size AS old_size, b.p_size AS new_size FROM old a FULL JOIN new b ON a.p_partkey = b.p_partkey WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR (a.p_size, a.p_brand) IS DISTINCT FROM (b.p_size, b.p_brand)"
)
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    part = read(spark, sf, "part").select("p_partkey", "p_size", "p_brand")
    old = part.where("p_partkey % 10 <> 0")
    new = part.where("p_partkey % 11 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return delta.difference(old, new, "p_partkey").select("p_partkey", "op", F.col("old.p_size").alias("old_size"), F.col("new.p_size").alias("new_size"))


@query(
    "WITH " + _BATCH + """, seen AS (SELECT b.*, lag({op: op, value: b.value}) OVER (PARTITION BY b.entity_id ORDER BY version) AS prior, s.value AS base_value FROM batch b LEFT JOIN base s ON s.entity_id = b.entity_id),
    imaged AS (SELECT version, seq, op, entity_id, value, CASE WHEN prior IS NULL THEN base_value WHEN prior.op = 'delete' THEN NULL ELSE prior.value END AS old_value FROM seen)
    SELECT version, seq, entity_id, CASE WHEN op = 'delete' THEN 'delete' WHEN old_value IS NULL THEN 'insert' ELSE 'update' END AS op, old_value, CASE WHEN op <> 'delete' THEN value END AS new_value FROM imaged WHERE op <> 'delete' OR old_value IS NOT NULL"""
)
def delta_capture(spark: SparkSession, sf: str) -> DataFrame:
    return delta.capture(*batch_ops(spark, sf)).select("version", "seq", "entity_id", "op", F.col("old.value").alias("old_value"), F.col("new.value").alias("new_value"))


@query("SELECT o_custkey AS version, count(*) AS operation_count, min_by(o_orderstatus, o_orderkey) AS first_op_type, min_by(o_orderkey % 3, o_orderkey)::INTEGER AS first_table_id, min(o_orderkey) AS first_entity_id FROM orders GROUP BY o_custkey")
def delta_summary(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    return delta.summary(o.select(F.col("o_custkey").alias("version"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("op"), (F.col("o_orderkey") % 3).cast("int").alias("table_id"), F.col("o_orderkey").alias("entity_id")))


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 1000")
def ring_last_1000(spark: SparkSession, sf: str) -> DataFrame:
    return delta.ring(read(spark, sf, "events").select("event_id", "event_type"), 1000, "event_id")


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq FROM orders")
def sequence_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return delta.numbered(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey").withColumn("seq", F.col("seq").cast("long"))


@query("SELECT event_id AS version, user_id AS entity_id FROM events WHERE event_id BETWEEN 100 AND 300")
def version_range(spark: SparkSession, sf: str) -> DataFrame:
    return delta.between(event_ops(spark, sf), 100, 300).select("version", "entity_id")


_CLIENTS = "clients AS (SELECT 'a' AS client_id, 100::BIGINT AS client_version, []::INTEGER[] AS subscribed UNION ALL SELECT 'b', 500, [2] UNION ALL SELECT 'c', 0, [1]) "


def clients(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("a", 100, []), ("b", 500, [2]), ("c", 0, [1])], "client_id string, client_version bigint, subscribed_tables array<int>")


@query(_OPS + ", " + _CLIENTS + "SELECT client_id, version, table_id, entity_id FROM ops JOIN clients ON version > client_version AND (len(subscribed) = 0 OR list_contains(subscribed, table_id))")
def incremental_feed(spark: SparkSession, sf: str) -> DataFrame:
    return delta.subscribed(event_ops(spark, sf), clients(spark)).select("client_id", "version", "table_id", "entity_id")


@query("WITH " + _CLIENTS + "SELECT client_id, (SELECT max(event_id) FROM events) - client_version AS lag FROM clients")
def client_lag(spark: SparkSession, sf: str) -> DataFrame:
    return delta.lag(event_ops(spark, sf), clients(spark))


@query("SELECT doc_id, i::INTEGER AS chunk, substr(text, (i * 1000 + 1)::BIGINT, 1000) AS data FROM documents, LATERAL (SELECT unnest(range(ceil(length(text) / 1000)::BIGINT)) AS i)")
def blob_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return values.chunks(read(spark, sf, "documents"), "doc_id", "text", 1000)


_SLOTS = "WITH log AS (SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS change FROM events), run AS (SELECT sum(change) OVER (ORDER BY seq) AS r FROM log), x AS (SELECT greatest(max(r), 0)::BIGINT AS peak, (SELECT sum(change) FROM log)::BIGINT AS live FROM run) "


@query(_SLOTS + "SELECT peak, live, CASE WHEN peak > 0 THEN 1 - live / peak ELSE 0 END AS ratio FROM x")
def slot_fragmentation(spark: SparkSession, sf: str) -> DataFrame:
    return ops.fragmentation(read(spark, sf, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, -1).otherwise(1).alias("change")))


# conflicts: server holds parts, a client writes to all

_MERGE = """WITH server AS (SELECT p_partkey AS id, p_size AS cur FROM part WHERE p_partkey % 10 <> 0),
client AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' ELSE 'delete' END AS op, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN p_size - 1 ELSE p_size END AS old, CASE WHEN p_partkey % 3 < 2 THEN p_size + 5 END AS new FROM part),
found AS (SELECT c.*, cur, s.id IS NOT NULL AND (op = 'insert' OR cur IS DISTINCT FROM old) AS conflict FROM client c LEFT JOIN server s ON c.id = s.id) """


def merge_sides(spark: SparkSession, sf: str) -> DataFrame:
    part = read(spark, sf, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    server = part.where(key % 10 != 0).select(F.lit(7).alias("table_id"), key.alias("entity_id"), F.struct(size.alias("size")).alias("data"))
    old = F.when(key % 3 != 0, F.struct(F.when(key % 4 == 0, size - 1).otherwise(size).alias("size")))
    new = F.when(key % 3 < 2, F.struct((size + 5).alias("size")))
    client = part.select(F.lit(7).alias("table_id"), key.alias("entity_id"), F.when(key % 3 == 0, "insert").when(key % 3 == 1, "update").otherwise("delete").alias("op"), old.alias("old"), new.alias("new"))
    return conflict.detected(client, server)


def merged(df: DataFrame) -> DataFrame:
    return df.select("entity_id", "op", F.col("old.size").alias("old_size"), F.col("new.size").alias("new_size"))


_REWRITTEN = "CASE WHEN conflict AND op <> 'delete' THEN 'update' ELSE op END AS op, CASE WHEN conflict THEN cur ELSE old END AS old_size"


@query(_MERGE + f"SELECT id AS entity_id, {_REWRITTEN}, CASE WHEN conflict THEN cur ELSE new END AS new_size FROM found WHERE NOT (conflict AND op = 'delete')")
def conflict_server_authoritative(spark: SparkSession, sf: str) -> DataFrame:
    return merged(conflict.resolved(merge_sides(spark, sf), "server"))


@query(_MERGE + f"SELECT id AS entity_id, {_REWRITTEN}, new AS new_size FROM found")
def conflict_last_write_wins(spark: SparkSession, sf: str) -> DataFrame:
    return merged(conflict.resolved(merge_sides(spark, sf), "last_write"))


@query(_MERGE + f"SELECT id AS entity_id, {_REWRITTEN}, CASE WHEN conflict AND op <> 'delete' THEN greatest(cur, new) ELSE new END AS new_size FROM found")
def conflict_custom_merge(spark: SparkSession, sf: str) -> DataFrame:
    return merged(conflict.resolved(merge_sides(spark, sf), "custom", lambda a, b: F.struct(F.greatest(a["size"], b["size"]).alias("size"))))


@query(_MERGE + "SELECT 'part' AS table_name, id AS entity_id, op, cur AS server_size, new AS client_size FROM found WHERE conflict ORDER BY id DESC LIMIT 1000")
def conflict_log(spark: SparkSession, sf: str) -> DataFrame:
    tables = spark.createDataFrame([(7, "part")], "table_id int, table_name string")
    return conflict.log(merge_sides(spark, sf), tables).select("table_name", "entity_id", "op", F.col("server_value.size").alias("server_size"), F.col("client_value.size").alias("client_size"))


@query("SELECT s.client_id, t.table_id FROM (SELECT 'a' AS client_id, []::INTEGER[] AS x UNION ALL SELECT 'b', [2] UNION ALL SELECT 'c', [1]) s, (SELECT unnest([1, 2, 3])::INTEGER AS table_id) t WHERE len(x) = 0 OR list_contains(x, t.table_id)")
def subscription_filter(spark: SparkSession, sf: str) -> DataFrame:
    tables = spark.range(1, 4).select(F.lit(10**6).cast("long").alias("version"), F.col("id").cast("int").alias("table_id"))
    return delta.subscribed(tables, clients(spark)).select("client_id", "table_id")


# JSON, checksums, layout

_EVENT = S.Schema("events", tables=(S.Table("props", (S.Field("k", S.parse_type("u8")),)),))


@query("SELECT event_id, (props->>'$.k')::SMALLINT AS k FROM events")
def json_decode(spark: SparkSession, sf: str) -> DataFrame:
    value, fault = decode(F.col("props"), _EVENT, _EVENT.tables[0].fields)
    return read(spark, sf, "events").where(fault.isNull()).select("event_id", value["k"].alias("k"))


@query("SELECT s_suppkey, to_json({s_name: s_name, s_nationkey: s_nationkey})::VARCHAR AS json FROM supplier")
def json_encode(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "supplier").select("s_suppkey", encode(["s_name", "s_nationkey"]).alias("json"))


GAME = """
[database]
name = "game"
[enums.faction]
variants = ["neutral", "player"]
[custom_types.vec3]
fields = [{name = "x", type = "f32"}, {name = "y", type = "f32"}, {name = "z", type = "f32"}]
[tables.body]
fields = [{name = "alive", type = "bool"}, {name = "at", type = "vec3"}, {name = "mass", type = "f64"}, {name = "side", type = "faction"}, {name = "slots", type = "[[u16; 3]; 2]"}]
"""


@query("SELECT * FROM (VALUES ('body', 'alive', 0, 1, 1), ('body', 'at', 4, 12, 4), ('body', 'mass', 16, 8, 8), ('body', 'side', 24, 4, 4), ('body', 'slots', 28, 12, 2)) AS t(table_name, field, \"offset\", size, alignment)")
def layout_report(spark: SparkSession, sf: str) -> DataFrame:
    return S.layout_report(spark, S.loads(GAME))


@query("SELECT p_partkey, p_name, 0::INTEGER AS stock FROM part")
def schema_migration(spark: SparkSession, sf: str) -> DataFrame:
    steps = [{"op": "add_field", "name": "stock", "type": "int", "default": 0}, {"op": "drop_field", "name": "p_size"}, {"op": "add_index", "name": "p_name"}]
    return S.migrate(read(spark, sf, "part").select("p_partkey", "p_name", "p_size"), steps)


# snapshots, recovery, streams


@query("SELECT c_custkey AS entity_id, c_acctbal, c_nationkey FROM customer")
def snapshot_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    store = Store(spark, temporary(spark))
    store.write({"customer": read(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"), "c_acctbal", "c_nationkey")}, 1)
    return store.read()[1]["customer"]


def _logged(spark: SparkSession, sf: str) -> Store:
    store = Store(spark, temporary(spark))
    store.append("part", wal(spark, sf))
    return store


_RECOVERED = _WAL.replace("{since}", "-1") + "SELECT entity_id, x.q AS quantity FROM latest"


@query(_RECOVERED)
def log_recover(spark: SparkSession, sf: str) -> DataFrame:
    return _logged(spark, sf).recover()[1]["part"]


@query(_RECOVERED)
def log_compact(spark: SparkSession, sf: str) -> DataFrame:
    store = _logged(spark, sf)
    store.compact()
    return store.read()[1]["part"]


@query(_APPLIED)
def stream_replica(spark: SparkSession, sf: str) -> DataFrame:
    folder = temporary(spark)
    stream.append(event_ops(spark, sf).withColumn("data", F.to_json("data")).select("version", "seq", "op", "table_id", "entity_id", "data"), f"{folder}/feed")
    replica = stream.Replica(spark, f"{folder}/replica")
    replica.follow(stream.read(spark, f"{folder}/feed")).awaitTermination()
    return replica.table(1).select("entity_id", F.get_json_object("data", "$.value").cast("double").alias("value"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS events FROM events GROUP BY ALL")
def stream_windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    folder = temporary(spark)
    events = read(spark, sf, "events").select("ts", "event_type")
    stream.append(events, f"{folder}/events")
    stream.to_folder(stream.windowed(stream.read(spark, f"{folder}/events", events.schema), "ts", "1 day", "event_type"), f"{folder}/counts", "complete", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/counts").withColumn("start", F.col("start").cast("timestamp_ntz"))


# what Spark adds: aggregation, windows, sets, top-k


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS lines, min(l_shipdate) AS first_ship, max(l_extendedprice) AS top_price FROM lineitem GROUP BY ALL")
def group_by(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.count("*").alias("lines"), F.min("l_shipdate").alias("first_ship"), F.max("l_extendedprice").alias("top_price")
    )


@query("SELECT n_regionkey, n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)")
def rollup(spark: SparkSession, sf: str) -> DataFrame:
    nation = read(spark, sf, "nation")
    return read(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).rollup("n_regionkey", "n_name").agg(F.count("*").alias("customers"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS orders FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("orders"))


@query("SELECT o_custkey, o_orderkey, r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def window_rank(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("r")).where("r <= 3")


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).union(read(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("k")).intersect(read(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_except(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(read(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark: SparkSession, sf: str) -> DataFrame:
    return scan.top(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 25, F.desc("o_totalprice"), F.col("o_orderkey"))


@query("SELECT DISTINCT p_brand, p_size FROM part")
def distinct_rows(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_brand", "p_size").distinct()


@query("SELECT CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS table_id FROM part GROUP BY 1")
def touched_tables(spark: SparkSession, sf: str) -> DataFrame:
    return ops.touched(read(spark, sf, "part").select(F.when(F.col("p_partkey") % 3 == 0, 0).otherwise(1).alias("table_id")))


@query("SELECT c_custkey, coalesce(o.n, 0)::BIGINT AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON o_custkey = c_custkey")
def default_values(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return values.with_defaults(read(spark, sf, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "n"))
