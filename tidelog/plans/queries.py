"""Registered queries over the operators, each with its SQL twin."""

from __future__ import annotations

import contextlib
import os
import tempfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import codec, filters, keys
from tidelog.operators import batch, cursor, resolve
from tidelog.operators.batch import WriteBatch
from tidelog.plans import manifest, storage
from tidelog.plans.engine import Database
from tidelog.schema import MAX_SEQ, OP_PUT, StoreError, tag
from tidelog.sources import manifest_file, table_file, wal
from tidelog.sources.tables import event_log, table

SNAP = 5000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_L = (
    "L AS (SELECT user_id AS k, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS op, "
    "CASE WHEN event_type <> 'error' THEN value END AS v FROM events)"
)
_RANK = "row_number() OVER (PARTITION BY k ORDER BY seq DESC, op DESC)"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _sql_values(rows: list[tuple], names: str) -> str:
    lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS t({names})"


# -- reads -------------------------------------------------------------------


@query(f"WITH {_L} SELECT k, seq, v FROM (SELECT *, {_RANK} r FROM L WHERE k = 7) WHERE r = 1 AND op = 1")
def get_latest(spark, d):
    return resolve.get(event_log(spark, d), 7)


@query(f"WITH {_L} SELECT k, seq, v FROM (SELECT *, {_RANK} r FROM L WHERE k = 7 AND seq <= 3000) WHERE r = 1 AND op = 1")
def get_at_snapshot(spark, d):
    return resolve.get(event_log(spark, d), 7, 3000)


@query(f"""WITH {_L}, p AS (SELECT range AS k FROM range(0, 400)),
    n AS (SELECT * FROM (SELECT *, {_RANK} r FROM L WHERE seq <= {SNAP}) WHERE r = 1)
    SELECT p.k, CASE WHEN op IS NULL THEN 'ABSENT' WHEN op = 0 THEN 'DELETED' ELSE 'OK' END AS outcome, CASE WHEN op = 1 THEN v END AS v
    FROM p LEFT JOIN n ON p.k = n.k""")
def get_outcome(spark, d):
    return resolve.get_outcome(event_log(spark, d), spark.range(400).toDF("k"), SNAP)


_ASOF = """SELECT k, snap, CASE WHEN op IS NULL THEN 'ABSENT' WHEN op = 0 THEN 'DELETED' ELSE 'OK' END AS outcome, CASE WHEN op = 1 THEN v END AS v
    FROM (SELECT p.k, p.snap, L.op, L.v, row_number() OVER (PARTITION BY p.k, p.snap ORDER BY seq DESC, op DESC) r
    FROM p LEFT JOIN L ON L.k = p.k AND L.seq <= p.snap) WHERE r = 1"""


@query(f"WITH {_L}, p AS (SELECT range % 200 AS k, range * 7 AS snap FROM range(0, 1500)) {_ASOF}")
def multi_get_asof(spark, d):
    probes = spark.range(1500).select((F.col("id") % 200).alias("k"), (F.col("id") * 7).alias("snap"))
    return resolve.multi_get(event_log(spark, d), probes, 1000)


@query(f"WITH {_L}, p AS (SELECT 7 AS k, range * 100 AS snap FROM range(0, 60)) {_ASOF}")
def multi_version_probe(spark, d):
    probes = spark.range(60).select(F.lit(7).cast("bigint").alias("k"), (F.col("id") * 100).alias("snap"))
    return resolve.multi_get(event_log(spark, d), probes)


@query(f"WITH {_L} SELECT k, seq, v FROM (SELECT *, {_RANK} r FROM L WHERE seq <= {SNAP}) WHERE r = 1 AND op = 1")
def snapshot_scan(spark, d):
    return resolve.live(event_log(spark, d), SNAP)


@query(f"WITH {_L} SELECT k, seq, v FROM (SELECT *, {_RANK} r FROM L) WHERE r = 1 AND op = 1")
def layer_union_get(spark, d):
    log = event_log(spark, d)
    parts = [log.where(F.col("seq") % 3 == 0), log.where(F.col("seq") % 3 == 1), log.where(F.col("seq") % 3 == 2)]
    return resolve.live(resolve.layers(*parts))


@query(f"WITH {_L} SELECT max(seq) AS last_seq FROM L")
def implicit_snapshot(spark, d):
    return event_log(spark, d).agg(F.max("seq").alias("last_seq"))


@query(f"WITH {_L} SELECT range AS k FROM range(0, 400) WHERE range IN (SELECT k FROM L)")
def key_exists(spark, d):
    return resolve.exists(spark.range(400).toDF("k"), event_log(spark, d))


@query(f"WITH {_L} SELECT range AS k FROM range(0, 400) WHERE range NOT IN (SELECT k FROM L)")
def key_absent(spark, d):
    return resolve.absent(spark.range(400).toDF("k"), event_log(spark, d))


@query(f"""WITH {_L} SELECT k, seq, op, v, {_RANK} AS version, lag(seq) OVER (PARTITION BY k ORDER BY seq DESC, op DESC) AS replaced_at FROM L""")
def version_history(spark, d):
    return resolve.history(event_log(spark, d))


# -- ordered access ----------------------------------------------------------


def _seek(how: str, op: str, pick: str) -> None:
    sql = f"WITH {_L}, p AS (SELECT range * 3 - 5 AS t FROM range(0, 60)) SELECT t, (SELECT {pick}(k) FROM L WHERE k {op} t) AS found FROM p"

    @query(sql, f"seek_{how}")
    def run(spark, d):
        return cursor.neighbours(event_log(spark, d), spark.range(60).select((F.col("id") * 3 - 5).alias("t")), how)


for _h, _o, _p in (("ge", ">=", "min"), ("gt", ">", "min"), ("le", "<=", "max"), ("lt", "<", "max")):
    _seek(_h, _o, _p)


@query(f"WITH {_L} SELECT * FROM L ORDER BY k, seq DESC, op DESC LIMIT 1")
def seek_first(spark, d):
    return cursor.first(event_log(spark, d))


@query(f"WITH {_L} SELECT * FROM L ORDER BY k DESC, seq, op LIMIT 1")
def seek_last(spark, d):
    return cursor.last(event_log(spark, d))


@query(f"WITH {_L} SELECT k, lead(k) OVER (ORDER BY k) AS next_k FROM (SELECT DISTINCT k FROM L)")
def iter_next(spark, d):
    return cursor.with_next(event_log(spark, d))


@query(f"WITH {_L} SELECT k, lag(k) OVER (ORDER BY k) AS prev_k FROM (SELECT DISTINCT k FROM L)")
def iter_prev(spark, d):
    return cursor.with_prev(event_log(spark, d))


@query(f"WITH {_L} SELECT *, row_number() OVER (ORDER BY k, seq DESC, op DESC) AS ordinal FROM L")
def scan_all_versions(spark, d):
    return cursor.ordinal(event_log(spark, d))


@query(f"WITH {_L} SELECT *, row_number() OVER (ORDER BY k DESC, seq, op) AS ordinal FROM L")
def scan_reverse(spark, d):
    return cursor.ordinal(event_log(spark, d), reverse=True)


@query(f"WITH {_L} SELECT * FROM L WHERE k > 20 OR (k = 20 AND (seq < 4000 OR (seq = 4000 AND op <= 1))) ORDER BY k, seq DESC, op DESC LIMIT 1")
def seek_internal(spark, d):
    return cursor.seek_internal(event_log(spark, d), 20, 4000, OP_PUT)


@query(f"WITH {_L} SELECT k, seq, v FROM (SELECT *, {_RANK} r FROM L WHERE seq <= {SNAP} AND k >= 10 AND k < 40) WHERE r = 1 AND op = 1")
def range_scan(spark, d):
    return resolve.live(cursor.scan_range(event_log(spark, d), 10, 40), SNAP)


@query(f"WITH {_L} SELECT * FROM L WHERE false")
def empty_scan(spark, d):
    return event_log(spark, d).limit(0)


# -- batches -----------------------------------------------------------------

_OPS = """b AS (SELECT l_orderkey * 1000 AS base_seq, l_orderkey, l_partkey AS k, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS op,
    CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS v,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_shipdate) - 1 AS i FROM lineitem)"""


def order_batches(spark: SparkSession, d: str) -> DataFrame:
    """Each order's lines as one batch, in line order."""
    gone = F.col("l_returnflag") == "R"
    o = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate",
        F.when(gone, 0).otherwise(1).alias("op"), F.col("l_partkey").alias("k"), F.when(~gone, F.col("l_quantity")).alias("v"),
    )
    listed = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(o)).alias("o"))
    ops = F.transform("o", lambda x: F.struct(x["op"].alias("op"), x["k"].alias("k"), x["v"].alias("v")))
    return listed.select("l_orderkey", (F.col("l_orderkey") * 1000).alias("base_seq"), ops.alias("ops"))


@query(f"WITH {_OPS} SELECT k, base_seq + i AS seq, op, v FROM b")
def batch_expand(spark, d):
    return batch.expand(order_batches(spark, d))


@query(f"""WITH {_OPS}, g AS (SELECT l_orderkey // 8 AS grp, k, op, v, min(base_seq) OVER (PARTITION BY l_orderkey // 8)
    + row_number() OVER (PARTITION BY l_orderkey // 8 ORDER BY l_orderkey, i) - 1 AS seq FROM b) SELECT k, seq, op, v FROM g""")
def batch_concat(spark, d):
    b = order_batches(spark, d).withColumn("grp", F.floor(F.col("l_orderkey") / 8))
    return batch.expand(batch.concat(b, ["grp"], "l_orderkey"))


@query(f"WITH {_OPS} SELECT l_orderkey, count(*) AS n_ops, CASE WHEN count(*) = l_orderkey % 7 THEN 'OK' ELSE 'Corruption' END AS status FROM b GROUP BY 1")
def batch_validate(spark, d):
    b = order_batches(spark, d)
    return b.select("l_orderkey", F.size("ops").cast("bigint").alias("n_ops"), batch.check("ops", F.col("l_orderkey") % 7).alias("status"))


@query("""SELECT k, seq, 1 AS op, v FROM (SELECT user_id AS k, event_id + 1 AS seq, value AS v FROM events UNION ALL
    SELECT user_id, event_id + 1, -value FROM events WHERE event_id % 3 = 0) QUALIFY row_number() OVER (PARTITION BY k, seq ORDER BY v DESC) = 1""".replace("ORDER BY v DESC", "ORDER BY (v >= 0) DESC"))
def dedup_first(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), (F.col("event_id") + 1).alias("seq"), F.lit(1).alias("op"), F.col("value").alias("v"))
    again = e.where((F.col("seq") - 1) % 3 == 0).withColumn("v", -F.col("v")).withColumn("at", F.lit(1))
    return batch.dedup_first(e.withColumn("at", F.lit(0)).unionByName(again), "at")


_LEN = """z AS (SELECT event_id + 1 AS seq, 8 + strlen(event_type) AS kl, strlen(props) AS vl FROM events),
    y AS (SELECT seq, kl, vl, kl + vl + CASE WHEN kl < 128 THEN 1 WHEN kl < 16384 THEN 2 ELSE 3 END + CASE WHEN vl < 128 THEN 1 WHEN vl < 16384 THEN 2 ELSE 3 END AS sz FROM z)"""


def _sized_events(spark, d):
    size = batch.entry_bytes(F.octet_length("event_type"), F.octet_length("props"))
    return table(spark, d, "events").select((F.col("event_id") + 1).alias("seq"), F.lit(1).alias("op"), size.cast("bigint").alias("sz"))


@query(f"WITH {_LEN} SELECT count(*) AS n, CAST(sum(sz) AS BIGINT) AS bytes FROM y")
def memtable_size(spark, d):
    return _sized_events(spark, d).agg(F.count(F.lit(1)).alias("n"), F.sum("sz").alias("bytes"))


@query(f"WITH {_LEN}, c AS (SELECT seq, CAST(sum(sz) OVER (ORDER BY seq) AS BIGINT) AS cum FROM y) SELECT (cum - 1) // 65536 AS buffer, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM c GROUP BY 1")
def rotation_points(spark, d):
    run = batch.rotation(_sized_events(spark, d), "sz", 65536, 1000)
    return run.groupBy("buffer").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n"))


_COMMITS = """WITH RECURSIVE w AS (SELECT o_custkey % 64 AS queue, o_orderkey AS ticket, CAST(floor(o_totalprice * 4) AS BIGINT) AS size, o_orderpriority = '1-URGENT' AS sync,
    row_number() OVER (PARTITION BY o_custkey % 64 ORDER BY o_orderkey) AS rn FROM orders),
    g AS (SELECT queue, ticket, rn, CAST(0 AS BIGINT) AS grp, size AS used, CASE WHEN size <= 131072 THEN size + 131072 ELSE 1048576 END AS most, sync AS head FROM w WHERE rn = 1
    UNION ALL SELECT w.queue, w.ticket, w.rn, CASE WHEN g.used + w.size > g.most OR (w.sync AND NOT g.head) THEN g.grp + 1 ELSE g.grp END,
    CASE WHEN g.used + w.size > g.most OR (w.sync AND NOT g.head) THEN w.size ELSE g.used + w.size END,
    CASE WHEN g.used + w.size > g.most OR (w.sync AND NOT g.head) THEN CASE WHEN w.size <= 131072 THEN w.size + 131072 ELSE 1048576 END ELSE g.most END,
    CASE WHEN g.used + w.size > g.most OR (w.sync AND NOT g.head) THEN w.sync ELSE g.head END FROM g JOIN w ON w.queue = g.queue AND w.rn = g.rn + 1)
    SELECT queue, ticket, grp AS commit_group FROM g"""


@query(_COMMITS)
def group_commit(spark, d):
    w = table(spark, d, "orders").select(
        (F.col("o_custkey") % 64).alias("queue"), F.col("o_orderkey").alias("ticket"),
        (F.col("o_totalprice") * 4).cast("bigint").alias("size"), (F.col("o_orderpriority") == "1-URGENT").alias("sync"),
    )
    return batch.group_commit(w, "queue", "ticket", "size", "sync")


@query(f"WITH {_L} SELECT k, seq + 100000 AS seq, op, v FROM L WHERE op = 1 UNION ALL SELECT DISTINCT k, 999999, 0, NULL FROM L WHERE k < 5")
def put_and_delete(spark, d):
    log = event_log(spark, d)
    puts = log.where(F.col("op") == 1).withColumn("seq", F.col("seq") + 100000)
    gone = log.where(F.col("k") < 5).select("k").distinct().select("k", F.lit(999999).cast("bigint").alias("seq"), F.lit(0).alias("op"), F.lit(None).cast("double").alias("v"))
    return puts.unionByName(gone)


# -- sorted tables -------------------------------------------------------------


@query("""SELECT CAST(p_partkey // 100 AS BIGINT) AS bucket, min(p_name) AS smallest_k, max(p_name) AS largest_k, count(*) AS n,
    CAST(sum(CASE WHEN strlen(p_name) + 8 < 128 THEN 1 ELSE 2 END + strlen(p_name) + 8 + 1 + strlen(p_brand)) AS BIGINT) AS bytes FROM part GROUP BY 1""")
def flush_filemeta(spark, d):
    p = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 100).alias("bucket"), F.col("p_name").alias("k"), "p_brand")
    return storage.summarize(p, "bucket", F.octet_length("k"), F.octet_length("p_brand")).withColumn("bytes", F.col("bytes").cast("bigint"))


@query(f"""WITH {_L}, z AS (SELECT (seq - 1) // 500 AS file, min(k) AS lo, max(k) AS hi FROM L GROUP BY 1),
    r AS (SELECT L.* FROM L JOIN z ON (L.seq - 1) // 500 = z.file AND z.lo <= 3 AND z.hi >= 3 WHERE L.k = 3)
    SELECT k, seq, v FROM (SELECT *, {_RANK} r FROM r) WHERE r = 1 AND op = 1""")
def zone_pruned_get(spark, d):
    log = event_log(spark, d).withColumn("file", F.floor((F.col("seq") - 1) / 500))
    zones = log.groupBy("file").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <= 3 AND hi >= 3")
    return resolve.get(log.join(F.broadcast(zones.select("file")), "file", "left_semi"), 3)


@query("""WITH s AS (SELECT p_brand AS grp, p_name AS k, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) - 1 AS pos,
    lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS b FROM part)
    SELECT grp, id, pos, pos % 16 = 0 AS restart,
    CAST(CASE WHEN pos % 16 = 0 THEN 0 ELSE len(list_filter(range(1, least(len(k), len(b)) + 1), lambda i: substr(k, 1, i) = substr(b, 1, i))) END AS BIGINT) AS shared FROM s""")
def block_prefix(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("grp"), F.encode("p_name", "UTF-8").alias("k"), F.col("p_partkey").alias("id"))
    return storage.block_prefixes(p, "grp").select("grp", "id", F.col("pos").cast("bigint").alias("pos"), "restart", F.col("shared").cast("bigint").alias("shared"))


_PREFIX = "CAST(len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: substr(a, 1, i) = substr(b, 1, i))) AS INT)"


@query(f"""WITH s AS (SELECT c_custkey AS id, c_name AS a, c_mktsegment AS b FROM customer), p AS (SELECT *, {_PREFIX} AS n FROM s)
    SELECT id, CASE WHEN n < least(len(a), len(b)) AND ascii(substr(a, n + 1, 1)) + 1 < ascii(substr(b, n + 1, 1))
    THEN substr(a, 1, n) || chr(CAST(ascii(substr(a, n + 1, 1)) + 1 AS INT)) ELSE a END AS sep FROM p""")
def separator(spark, d):
    c = table(spark, d, "customer")
    sep = keys.separator(F.encode("c_name", "UTF-8"), F.encode("c_mktsegment", "UTF-8"))
    return c.select(F.col("c_custkey").alias("id"), F.decode(sep, "UTF-8").alias("sep"))


@query("SELECT p_partkey AS id, chr(CAST(ascii(p_name) + 1 AS INT)) AS succ FROM part")
def successor(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.decode(keys.successor(F.encode("p_name", "UTF-8")), "UTF-8").alias("succ"))


@query(f"WITH {_L} SELECT k, seq, v FROM (SELECT *, {_RANK} r FROM L) WHERE r = 1 AND op = 1")
def compact_latest(spark, d):
    return storage.compact(event_log(spark, d)).select("k", "seq", "v")


@query(f"""WITH {_L} SELECT k, seq, op, v FROM (SELECT *, row_number() OVER (PARTITION BY k, seq <= {SNAP} ORDER BY seq DESC, op DESC) r FROM L)
    WHERE seq > {SNAP} OR (r = 1 AND op = 1)""")
def compact_with_snapshot(spark, d):
    return storage.compact(event_log(spark, d), SNAP)


@query("""WITH n AS (SELECT p_partkey AS id, p_name AS a, p_brand AS b FROM part), s AS (SELECT *, chr(CAST(ascii(a) + 1 AS INT)) AS u FROM n)
    SELECT id, CASE WHEN length(u) < length(a) THEN u ELSE a END AS k, CASE WHEN length(u) < length(a) THEN 72057594037927935 ELSE id END AS seq, 1 AS op FROM s""")
def internal_successor(spark, d):
    got = keys.internal_successor(F.encode("p_name", "UTF-8"), F.col("p_partkey"), F.lit(OP_PUT)).alias("i")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), got).select("id", F.decode("i.k", "UTF-8").alias("k"), "i.seq", "i.op")


@query(f"""WITH s AS (SELECT c_custkey AS id, c_name AS a, c_mktsegment AS b FROM customer), p AS (SELECT *, {_PREFIX} AS n FROM s),
    x AS (SELECT id, a, CASE WHEN n < least(len(a), len(b)) AND ascii(substr(a, n + 1, 1)) + 1 < ascii(substr(b, n + 1, 1)) THEN substr(a, 1, n) || chr(CAST(ascii(substr(a, n + 1, 1)) + 1 AS INT)) ELSE a END AS sep FROM p)
    SELECT id, sep AS k, CASE WHEN length(sep) < length(a) THEN 72057594037927935 ELSE id END AS seq, CASE WHEN length(sep) < length(a) THEN 1 ELSE 0 END AS op FROM x""")
def internal_separator(spark, d):
    got = keys.internal_separator(F.encode("c_name", "UTF-8"), F.col("c_custkey"), F.lit(0), F.encode("c_mktsegment", "UTF-8")).alias("i")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), got).select("id", F.decode("i.k", "UTF-8").alias("k"), "i.seq", "i.op")


# -- the engine and its files ----------------------------------------------------


def _bytes_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as versions of byte keys and values."""
    text = lambda c: F.encode(F.col(c).cast("string"), "UTF-8")
    return event_log(spark, d).select(text("k").alias("k"), "seq", "op", text("v").alias("v"))


def _read_back(rows: DataFrame) -> DataFrame:
    key, value = F.decode("k", "UTF-8").cast("bigint"), F.decode("v", "UTF-8").cast("double")
    return rows.select(key.alias("k"), *[c for c in ("seq", "op") if c in rows.columns], value.alias("v"))


def _warehouse(spark: SparkSession) -> str:
    """The warehouse's folder, which driver and executors share; the engine keeps its log and manifest by local calls."""
    base = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
    os.makedirs(base, exist_ok=True)
    return base


def _database(spark: SparkSession) -> Database:
    return Database(spark, tempfile.mkdtemp(dir=_warehouse(spark)))


def _written(spark: SparkSession, d: str) -> Database:
    """All events loaded, then two puts, a delete and a batch, each a write of its own; closed and opened again."""
    db = _database(spark)
    db.append(_bytes_log(spark, d), files=2)
    db.put(b"7", b"0.25")
    db.delete(b"3")
    db.put(b"100000", b"1.5")
    db.write(WriteBatch().put(b"100001", b"2.5").delete(b"100000"))
    db.close()
    return Database(spark, db.path)


_MORE = f"""{_L}, m AS (SELECT max(seq) AS s FROM L), W AS (SELECT * FROM L UNION ALL SELECT 7, s + 1, 1, 0.25 FROM m UNION ALL SELECT 3, s + 2, 0, NULL FROM m
    UNION ALL SELECT 100000, s + 3, 1, 1.5 FROM m UNION ALL SELECT 100001, s + 4, 1, 2.5 FROM m UNION ALL SELECT 100000, s + 5, 0, NULL FROM m)"""


@query(f"WITH {_MORE} SELECT k, seq, v FROM (SELECT *, {_RANK} r FROM W) WHERE r = 1 AND op = 1")
def db_recovered_scan(spark, d):
    """Put, delete, batch, log replay on opening and a scan of memory and tables."""
    return _read_back(_written(spark, d).scan())


@query(f"WITH {_MORE} SELECT k, seq, v FROM (SELECT *, {_RANK} r FROM W) WHERE r = 1 AND op = 1 AND CAST(k AS VARCHAR) >= '1' AND CAST(k AS VARCHAR) < '3'")
def db_compacted_range(spark, d):
    """Flush, major compaction and a bounded scan that opens only tables whose range meets it."""
    db = _written(spark, d)
    db.flush()
    db.compact(files=3)
    return _read_back(db.scan(low=b"1", high=b"3"))


@query(f"WITH {_MORE} SELECT k, v FROM (SELECT *, {_RANK} r FROM W WHERE k IN (3, 7, 12, 100000, 100001)) WHERE r = 1 AND op = 1")
def db_get(spark, d):
    """Single gets from memory and from pruned tables; deleted and absent keys aren't found."""
    db, found = _written(spark, d), []
    for k in (3, 7, 12, 99999, 100000, 100001):
        with contextlib.suppress(StoreError):
            found.append((k, float(db.get(str(k).encode()))))
    return _values(spark, found, "k bigint, v double")


@query(f"WITH {_MORE}, c AS (SELECT CAST(k AS VARCHAR) AS k FROM (SELECT *, {_RANK} r FROM W) WHERE r = 1 AND op = 1), o AS (SELECT k, row_number() OVER (ORDER BY k) AS step FROM c WHERE k >= '2') SELECT step, k FROM o WHERE step <= 5")
def db_cursor(spark, d):
    """Seek and four steps of a cursor over the live keys."""
    c = _written(spark, d).cursor().seek(bytearray(b"2"))
    found = []
    while c.valid and len(found) < 5:
        found.append((len(found) + 1, bytes(c.key()).decode()))
        c.next()
    return _values(spark, found, "step bigint, k string")


@query(f"WITH {_L} SELECT k, seq, op, v FROM L")
def wal_round_trip(spark, d):
    """A thousand versions a log, ten a batch: framed, checksummed, read back and decoded."""
    log = _bytes_log(spark, d).withColumn("path", F.format_string("%06d.log", F.floor(F.col("seq") / 1000)))
    op = F.struct("seq", "op", "k", "v")
    batches = log.groupBy("path", F.floor(F.col("seq") / 10).alias("n")).agg(F.array_sort(F.collect_list(op)).alias("o"))
    made = batches.select("path", F.col("o")[0]["seq"].alias("base_seq"), F.transform("o", lambda x: F.struct(x["op"].alias("op"), x["k"].alias("k"), x["v"].alias("v"))).alias("ops"))
    return _read_back(wal.decode_logs(wal.encode_logs(made)).where("status = 'OK'"))


@query(f"WITH {_L} SELECT k, seq, op, v FROM L")
def table_round_trip(spark, d):
    """Blocks, index, filter, footer and checksums of binary table files, written and read back."""
    rows = _bytes_log(spark, d).withColumn("path", F.format_string("%06d.ldb", F.floor(F.col("seq") / 2000)))
    return _read_back(table_file.decode_tables(table_file.encode_tables(rows, compression=table_file.SNAPPY)).where("status = 'OK'"))


@query(f"WITH {_L} SELECT k, seq, op, v FROM L")
def table_files(spark, d):
    """A flush to sorted files of disjoint key ranges, read through their metadata."""
    folder = tempfile.mkdtemp(dir=_warehouse(spark))
    storage.write_sorted(_bytes_log(spark, d), f"{folder}/t", 4)
    return _read_back(spark.read.parquet(f"{folder}/t"))


@query("""SELECT o_orderkey AS number, CAST(o_custkey % 7 AS BIGINT) AS level, o_orderkey + 1 AS next_file, o_orderpriority AS smallest, o_orderstatus AS largest,
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 5 END AS deleted FROM orders""")
def edit_round_trip(spark, d):
    """Manifest edits in their binary form and back: a file added by each order, every second one deleting another."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("number"), (F.col("o_custkey") % 7).cast("bigint").alias("level"), F.col("o_orderpriority").alias("smallest"), F.col("o_orderstatus").alias("largest"))

    def trip(parts):
        for pdf in parts:
            out = []
            for number, level, lo, hi in zip(pdf["number"], pdf["level"], pdf["smallest"], pdf["largest"]):
                edit = {"next_file": number + 1, "added": [(level, number, 10 * number, lo.encode(), hi.encode())], "deleted": [(level, number + 5)] if number % 2 == 0 else []}
                back = manifest_file.decode_edit(manifest_file.encode_edit(edit))
                (level_, number_, _, lo_, hi_) = back["added"][0]
                out.append((number_, level_, back["next_file"], bytes(lo_).decode(), bytes(hi_).decode(), back["deleted"][0][1] if back["deleted"] else None))
            yield pd.DataFrame(out, columns=["number", "level", "next_file", "smallest", "largest", "deleted"]).astype({"deleted": "Int64"})

    return o.mapInPandas(trip, "number bigint, level bigint, next_file bigint, smallest string, largest string, deleted bigint")


_GENERATED = """a AS (SELECT o_orderkey AS edit_id, CAST(o_custkey % 4 AS INT) AS level, o_orderkey % 997 AS number, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS is_add,
    CASE WHEN o_orderstatus <> 'F' THEN lpad(CAST(o_custkey AS VARCHAR), 6, '0') END AS smallest_k, CASE WHEN o_orderstatus <> 'F' THEN lpad(CAST(o_custkey + 3 AS VARCHAR), 6, '0') END AS largest_k FROM orders),
    f AS (SELECT level, number, smallest_k, largest_k FROM a QUALIFY row_number() OVER (PARTITION BY level, number ORDER BY edit_id DESC, is_add DESC) = 1 AND is_add = 1)"""


def _generated_files(spark: SparkSession, d: str) -> DataFrame:
    """The version after an edit by each order."""
    o, add = table(spark, d, "orders"), F.col("o_orderstatus") != "F"
    padded = lambda c: F.when(add, F.lpad(c.cast("string"), 6, "0"))
    return manifest.fold(
        o.select(
            F.col("o_orderkey").alias("edit_id"), (F.col("o_custkey") % 4).cast("int").alias("level"), (F.col("o_orderkey") % 997).alias("number"), add.cast("int").alias("is_add"),
            padded(F.col("o_custkey")).alias("smallest_k"), padded(F.col("o_custkey") + 3).alias("largest_k"),
        )
    )


@query(f"WITH {_GENERATED} SELECT * FROM f")
def version_of_edits(spark, d):
    return _generated_files(spark, d)


@query(f"""WITH {_GENERATED} SELECT * EXCLUDE (m) FROM (SELECT *, max(largest_k) OVER (PARTITION BY level ORDER BY smallest_k, number
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM f WHERE level > 0) WHERE m >= smallest_k""")
def overlaps_of_edits(spark, d):
    return manifest.overlaps(_generated_files(spark, d))


@query(f"WITH {_GENERATED}, n AS (SELECT o_orderkey % 1500 AS num FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1) SELECT printf('%06d.ldb', num) AS name, 'table' AS kind, num AS number FROM n WHERE num NOT IN (SELECT number FROM f)")
def garbage_of_edits(spark, d):
    listing = table(spark, d, "orders").where(F.col("o_custkey") % 3 == 0).select(keys.table_name(F.col("o_orderkey") % 1500).alias("name")).distinct()
    return manifest.obsolete(listing, _generated_files(spark, d), 0, 0)


# -- manifest ------------------------------------------------------------------

_EDITS = [
    # edit, level, number, is_add, smallest, largest
    (1, 0, 5, 1, "a", "f"), (1, 0, 6, 1, "c", "k"), (2, 0, 7, 1, "b", "d"), (3, 0, 5, 0, None, None), (3, 0, 6, 0, None, None),
    (3, 1, 8, 1, "a", "e"), (3, 1, 9, 1, "f", "k"), (4, 1, 8, 0, None, None), (4, 1, 8, 1, "a", "e"), (5, 1, 10, 1, "j", "m"),
    (6, 2, 11, 1, "a", "z"), (7, 2, 11, 0, None, None), (8, 2, 12, 1, "n", "p"),
]
_EDIT_NAMES = "edit_id, level, number, is_add, smallest_k, largest_k"
_FOLD = f"""a AS (SELECT * FROM {_sql_values(_EDITS, _EDIT_NAMES)}),
    f AS (SELECT level, CAST(number AS BIGINT) AS number, smallest_k, largest_k FROM a QUALIFY row_number() OVER (PARTITION BY level, number ORDER BY edit_id DESC, is_add DESC) = 1 AND is_add = 1)"""


def _files(spark):
    return manifest.fold(_values(spark, _EDITS, "edit_id bigint, level int, number bigint, is_add int, smallest_k string, largest_k string"))


@query(f"WITH {_FOLD} SELECT * FROM f")
def version_fold(spark, d):
    return _files(spark)


@query(f"WITH {_FOLD} SELECT DISTINCT number FROM f")
def live_files(spark, d):
    return _files(spark).select("number").distinct()


@query(f"""WITH {_FOLD} SELECT * EXCLUDE (m) FROM (SELECT *, max(largest_k) OVER (PARTITION BY level ORDER BY smallest_k, number
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM f WHERE level > 0) WHERE m >= smallest_k""")
def overlap_check(spark, d):
    return manifest.overlaps(_files(spark))


@query(f"WITH {_FOLD} SELECT CAST(range AS INT) AS level, (SELECT count(*) FROM f WHERE f.level = range) AS n_files FROM range(0, 7)")
def level_counts(spark, d):
    return manifest.level_counts(_files(spark))


_COUNTERS = [(1, "bytewise", 0, 2, 0), (2, None, 4, 6, None), (3, None, None, 9, 120), (4, None, 7, None, None)]


@query(f"""WITH e AS (SELECT * FROM {_sql_values(_COUNTERS, "edit_id, comparator, log_number, next_file, last_seq")})
    SELECT arg_max(comparator, edit_id) AS comparator, CAST(arg_max(log_number, edit_id) AS BIGINT) AS log_number,
    CAST(arg_max(next_file, edit_id) AS BIGINT) AS next_file, CAST(arg_max(last_seq, edit_id) AS BIGINT) AS last_seq FROM e""")
def manifest_counters(spark, d):
    return manifest.scalars(_values(spark, _COUNTERS, "edit_id bigint, comparator string, log_number bigint, next_file bigint, last_seq bigint"))


_NAMES = [
    ("CURRENT",), ("LOCK",), ("LOG",), ("LOG.old",), ("MANIFEST-000002",), ("MANIFEST-000005",), ("000003.log",), ("000007.log",), ("000005.ldb",),
    ("000007.ldb",), ("000009.ldb",), ("000012.dbtmp",), ("000011.dbtmp",), ("foo",), ("12.txt",), ("MANIFEST-x",), (".log",),
]
_PARSED = f"""n AS (SELECT name, CASE WHEN name IN ('CURRENT') THEN 'current' WHEN name = 'LOCK' THEN 'lock' WHEN name IN ('LOG', 'LOG.old') THEN 'info'
    WHEN regexp_full_match(name, 'MANIFEST-[0-9]+') THEN 'manifest' WHEN regexp_full_match(name, '[0-9]+[.]log') THEN 'log'
    WHEN regexp_full_match(name, '[0-9]+[.]ldb') THEN 'table' WHEN regexp_full_match(name, '[0-9]+[.]dbtmp') THEN 'temp' END AS kind,
    coalesce(TRY_CAST(regexp_extract(name, '([0-9]+)', 1) AS BIGINT), 0) AS num FROM {_sql_values(_NAMES, "name")})"""


@query(f"""WITH {_FOLD}, {_PARSED} SELECT name, kind, num AS number FROM n WHERE (kind = 'log' AND num < 7) OR (kind = 'manifest' AND num < 5)
    OR (kind IN ('table', 'temp') AND num NOT IN (SELECT number FROM f))""")
def obsolete_files(spark, d):
    return manifest.obsolete(_values(spark, _NAMES, "name string"), _files(spark), 7, 5)


@query(f"WITH {_PARSED} SELECT name, kind, CASE WHEN kind IS NOT NULL THEN num END AS number FROM n")
def file_name_parse(spark, d):
    n = F.col("name")
    return _values(spark, _NAMES, "name string").select(n, keys.file_kind(n).alias("kind"), keys.file_number(n).alias("number"))


_SIX = "lpad(o_orderkey::VARCHAR, greatest(6, len(o_orderkey::VARCHAR))::INT, '0')"


@query(f"SELECT o_orderkey AS id, {_SIX} || '.log' AS log, {_SIX} || '.ldb' AS tab, 'MANIFEST-' || {_SIX} AS man FROM orders")
def file_name_format(spark, d):
    o = F.col("o_orderkey")
    return table(spark, d, "orders").select(o.alias("id"), keys.log_name(o).alias("log"), keys.table_name(o).alias("tab"), keys.manifest_name(o).alias("man"))


@query(f"WITH {_OPS} SELECT l_orderkey % 16 AS log_number, max(base_seq + i) AS last_seq, count(*) AS n FROM b GROUP BY 1")
def recover_max_seq(spark, d):
    b = order_batches(spark, d).select((F.col("l_orderkey") % 16).alias("log_number"), "base_seq", F.size("ops").alias("n"))
    return b.groupBy("log_number").agg(F.max(F.col("base_seq") + F.col("n") - 1).alias("last_seq"), F.sum("n").alias("n"))


@query(f"WITH {_PARSED} SELECT name, num AS number FROM n WHERE kind = 'log' AND num >= 4")
def recover_min_log(spark, d):
    return manifest.logs_to_replay(_values(spark, _NAMES, "name string"), 4)


# -- filters and codecs ----------------------------------------------------------


@query("SELECT DISTINCT event_type, CAST(list_reduce(list_transform(range(1, len(event_type) + 1), lambda i: CAST(ascii(substr(event_type, i, 1)) AS BIGINT)), lambda h, b: xor((h * 16777619) & 4294967295, b), CAST(2166136261 AS BIGINT)) AS BIGINT) AS h FROM events")
def fnv1_hash(spark, d):
    e = table(spark, d, "events").select("event_type").distinct()
    return e.select("event_type", filters.fnv1(F.encode("event_type", "UTF-8")).alias("h"))


def _bloom(asked: str) -> str:
    """SQL of the same bits: six probes a key from its FNV-1 hash, ten bits a distinct hash, 64 at least, in whole bytes."""
    h = "CAST(list_reduce(list_transform(range(1, len(x) + 1), lambda i: CAST(ascii(substr(x, i, 1)) AS BIGINT)), lambda h, b: xor((h * 16777619) & 4294967295, b), CAST(2166136261 AS BIGINT)) AS BIGINT)"
    spots = "list_transform(range(0, 6), lambda i: ((h + i * (((h >> 17) | (h << 15)) & 4294967295)) & 4294967295) % bits)"
    return f"""WITH k AS (SELECT p_partkey, p_partkey % 8 AS grp, CAST(p_partkey AS VARCHAR) AS x FROM part), a AS (SELECT p_partkey, grp, {asked} AS x FROM k),
        kh AS (SELECT grp, {h} AS h FROM k), n AS (SELECT grp, ((greatest(64, count(DISTINCT h) * 10) + 7) // 8) * 8 AS bits FROM kh GROUP BY grp),
        s AS (SELECT grp, list(DISTINCT p) AS spots FROM (SELECT kh.grp, unnest({spots}) AS p FROM kh JOIN n ON n.grp = kh.grp) GROUP BY grp),
        ah AS (SELECT p_partkey, grp, {h} AS h FROM a)
        SELECT p_partkey, list_has_all(s.spots, {spots}) AS may_match FROM ah JOIN n ON n.grp = ah.grp JOIN s ON s.grp = ah.grp"""


@query(_bloom("x || '/absent'"))
def bloom_absent(spark, d):
    """Probes of keys that no filter holds: the same ones pass by chance."""
    return _bloom_asked(spark, d, "/absent")


@query(_bloom("x"))
def bloom_probe(spark, d):
    return _bloom_asked(spark, d, "")


def _bloom_asked(spark: SparkSession, d: str, ending: str) -> DataFrame:
    """Eight filters of part keys, each probed by its own keys with an ending; a filter's probes go to eight tasks."""
    part = table(spark, d, "part").where("p_partkey IS NOT NULL").select((F.col("p_partkey") % 8).alias("grp"), "p_partkey")
    text = F.col("p_partkey").cast("string")
    built = filters.build_filters(part.select("grp", F.encode(text, "UTF-8").alias("k")), "grp")
    asked = F.encode(F.concat(text, F.lit(ending)), "UTF-8")
    return filters.probe_filters(part, built, "grp", asked, 8).select("p_partkey", "may_match")


@query("SELECT CAST(p_partkey * 37 // 2048 AS BIGINT) AS slot, count(*) AS n, count(*) AS n_match FROM part GROUP BY 1")
def filter_block(spark, d):
    chunks = table(spark, d, "part").select((F.col("p_partkey") * 37).alias("block_offset"), F.encode("p_name", "UTF-8").alias("k"))
    hit = filters.probe_block(chunks, filters.filter_block(chunks))
    return hit.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("may_match").cast("int")).alias("n_match"))


_CRC = """SELECT DISTINCT event_type, xor(list_reduce(list_transform(range(1, len(event_type) + 1), lambda i: CAST(ascii(substr(event_type, i, 1)) AS BIGINT)),
    lambda c, b: list_reduce(range(0, 8), lambda x, j: xor(x >> 1, 2197175160 * (x & 1)), xor(c, b)), CAST(4294967295 AS BIGINT)), 4294967295) AS crc FROM events"""


@query(_CRC)
def crc32c(spark, d):
    e = table(spark, d, "events").select("event_type").distinct()
    return e.select("event_type", codec.crc32c(F.encode("event_type", "UTF-8")).alias("crc"))


@query()
def crc32c_props(spark, d):
    return table(spark, d, "events").select("event_id", codec.crc32c(F.encode("props", "UTF-8")).alias("crc"))


@query("SELECT event_id, (((event_id * 2654435761 & 4294967295) >> 15 | ((event_id * 2654435761 & 4294967295) << 17 & 4294967295)) + 2726488792) & 4294967295 AS masked FROM events")
def masked_crc(spark, d):
    x = (F.col("event_id") * F.lit(2654435761)).bitwiseAND(F.lit(4294967295))
    return table(spark, d, "events").select("event_id", codec.mask_crc(x).alias("masked"))


@query("SELECT o_orderkey AS id, CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 WHEN n < 2097152 THEN 3 WHEN n < 268435456 THEN 4 ELSE 5 END AS len FROM (SELECT o_orderkey, o_orderkey * o_custkey AS n FROM orders)")
def varint_len(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), codec.varint_len(F.col("o_orderkey") * F.col("o_custkey")).alias("len"))


@query("""WITH s AS (SELECT o_orderkey AS id, o_orderkey * 131 AS n FROM orders)
    SELECT id, CASE WHEN n < 128 THEN printf('%02X', n) WHEN n < 16384 THEN printf('%02X%02X', n % 128 + 128, n // 128)
    WHEN n < 2097152 THEN printf('%02X%02X%02X', n % 128 + 128, n // 128 % 128 + 128, n // 16384)
    ELSE printf('%02X%02X%02X%02X', n % 128 + 128, n // 128 % 128 + 128, n // 16384 % 128 + 128, n // 2097152) END AS enc FROM s""")
def varint_encode(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.hex(codec.varint(F.col("o_orderkey") * 131)).alias("enc"))


@query("""SELECT o_orderkey AS id, printf('%02X%02X%02X%02X', o_custkey % 256, o_custkey // 256 % 256, o_custkey // 65536 % 256, o_custkey // 16777216) AS f32, o_custkey AS back FROM orders""")
def fixed_encode(spark, d):
    f = codec.fixed32(F.col("o_custkey"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.hex(f).alias("f32"), codec.read_fixed(f, 4).alias("back"))


@query("SELECT p_partkey AS id, printf('%02X', len(p_brand)) || hex(p_brand) AS slice FROM part")
def length_prefixed(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.hex(codec.length_prefixed(F.encode("p_brand", "UTF-8"))).alias("slice"))


@query(f"WITH {_L} SELECT k, seq, op, seq * 256 + op AS tag, hex(CAST(k AS VARCHAR)) || printf('%02X%02X%02X', op, seq % 256, seq // 256) || '0000000000' AS packed, CAST(k AS VARCHAR) AS user_key FROM L")
def pack_tag(spark, d):
    key = F.encode(F.col("k").cast("string"), "UTF-8")
    packed = codec.pack_key(key, F.col("seq"), F.col("op"))
    return event_log(spark, d).select("k", "seq", "op", tag().alias("tag"), F.hex(packed).alias("packed"), F.decode(codec.user_key(packed), "UTF-8").alias("user_key"))


@query("SELECT range AS code, CASE range WHEN 0 THEN 'OK' WHEN 1 THEN 'NotFound : x' WHEN 2 THEN 'Corruption : x' WHEN 3 THEN 'Not implemented : x' WHEN 4 THEN 'Invalid argument : x' WHEN 5 THEN 'IO error : x' ELSE 'Unknown error : x' END AS said FROM range(0, 8)")
def status_text(spark, d):
    return spark.range(8).select(F.col("id").alias("code"), codec.status_text(F.col("id"), F.lit("x")).alias("said"))


@query(f"""WITH {_L}, s AS (SELECT seq, k, op, lag(k) OVER (ORDER BY seq) AS pk, lag(op) OVER (ORDER BY seq) AS pop, lag(seq) OVER (ORDER BY seq) AS pseq FROM L)
    SELECT seq, CASE WHEN k < pk THEN -1 WHEN k > pk THEN 1 WHEN seq * 256 + op > pseq * 256 + pop THEN -1 ELSE 1 END AS cmp FROM s WHERE pk IS NOT NULL""")
def internal_compare(spark, d):
    """Order of each version against the one written before it."""
    log = event_log(spark, d)
    earlier = cursor.neighbours(log.select(F.col("seq").alias("k")), log.select(F.col("seq").alias("t")), "lt").where("found IS NOT NULL")
    before = earlier.join(log.select(F.col("seq").alias("found"), F.col("k").alias("pk"), tag().alias("pt")), "found").select(F.col("t").alias("seq"), "pk", "pt")
    cmp = F.when(F.col("k") < F.col("pk"), -1).when(F.col("k") > F.col("pk"), 1).when(tag() > F.col("pt"), -1).otherwise(1)
    return log.join(before, "seq").select("seq", cmp.alias("cmp"))


@query(f"SELECT CAST({MAX_SEQ} AS BIGINT) AS max_seq, count(*) AS n_bad FROM events WHERE event_id + 1 > {MAX_SEQ} OR event_id < 0")
def sequence_check(spark, d):
    bad = event_log(spark, d).where((F.col("seq") > MAX_SEQ) | (F.col("seq") < 1))
    return bad.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(MAX_SEQ).alias("max_seq"), "n_bad")
