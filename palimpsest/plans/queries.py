"""The engine's queries over the driver's tables, each with its DuckDB text.

``events`` is read as a version log: key user_id, wall time ts in nanoseconds, logical event_id, deletion where
event_type is 'error'. Transactions are made of it too: id event_id, priority event_id % 7, status by event_type.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hlc, keys
from ..operators import conflicts, intents, layers, spread, versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DAY = 86_400_000_000_000
T0 = 1_705_320_000_000_000_000  # 2024-01-15 12:00
T_EARLY, T_LATE = T0 - 7 * DAY, T0 + 7 * DAY
ANY = hlc.MAX_LOGICAL

_LOG = "log AS (SELECT user_id, epoch_us(ts) * 1000 AS wall, event_id::INT AS logical, event_type = 'error' AS tombstone, event_id, event_type, value FROM events)"
_STATUS = "CASE event_type WHEN 'view' THEN 'PENDING' WHEN 'error' THEN 'ABORTED' ELSE 'COMMITTED' END"


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str, upto: int | None = None) -> DataFrame:
    """The log, or what is no later than ``upto`` nanoseconds: a bound on the stored column, so that files are pruned by it."""
    events = table(spark, sf_dir, "events")
    if upto is not None:
        events = events.filter(F.col("ts") <= F.lit(datetime(1970, 1, 1) + timedelta(microseconds=upto // 1000)).cast("timestamp_ntz"))
    return events.select("user_id", hlc.wall_of("ts").alias("wall"), F.col("event_id").cast("int").alias("logical"), (F.col("event_type") == "error").alias("tombstone"), "event_id", "event_type", "value")


def status() -> Column:
    return F.when(F.col("event_type") == "view", "PENDING").when(F.col("event_type") == "error", "ABORTED").otherwise("COMMITTED")


def txn_log(spark: SparkSession, sf_dir: str, upto: int | None = None) -> DataFrame:
    """The log with views as provisional versions of the transaction event_id; nothing is deleted."""
    log = event_log(spark, sf_dir, upto)
    return log.withColumn("txn_id", F.when(F.col("event_type") == "view", F.col("event_id"))).withColumn("tombstone", F.lit(False))


def _newest(where: str, by: str = "user_id", source: str = "log") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY wall DESC, logical DESC) AS rn FROM {source} WHERE {where}"


# scans and reads


@query("SELECT * FROM customer")
def full_scan(spark, sf_dir):
    return table(spark, sf_dir, "customer")


@query("SELECT * FROM orders WHERE o_orderkey = 42")
def pk_lookup(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(F.col("o_orderkey") == 42)


@query("SELECT * FROM orders WHERE o_orderkey = -1")
def pk_lookup_missing(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(F.col("o_orderkey") == -1)


@query("SELECT * FROM customer WHERE c_name = 'Customer#000000007'")
def text_pk_lookup(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter(F.col("c_name") == "Customer#000000007")


@query(f"WITH {_LOG}, n AS ({_newest(f'wall <= {T0}')}) SELECT user_id, wall, logical, event_type, value FROM n WHERE rn = 1 AND NOT tombstone")
def as_of_scan(spark, sf_dir):
    return versions.as_of(event_log(spark, sf_dir, T0), ["user_id"], (T0, ANY)).select("user_id", "wall", "logical", "event_type", "value")


@query(f"WITH {_LOG}, n AS ({_newest(f'wall <= {T0} AND user_id = 7')}) SELECT user_id, wall, logical, event_type, value FROM n WHERE rn = 1 AND NOT tombstone")
def as_of_point_get(spark, sf_dir):
    return versions.get(event_log(spark, sf_dir, T0), ["user_id"], [7], (T0, ANY)).select("user_id", "wall", "logical", "event_type", "value")


@query(f"WITH {_LOG}, n AS ({_newest(f'wall <= {T0} AND user_id >= 20 AND user_id < 60')}) SELECT user_id, wall, logical, value FROM n WHERE rn = 1 AND NOT tombstone")
def range_scan(spark, sf_dir):
    return versions.scan(event_log(spark, sf_dir, T0), "user_id", (T0, ANY), 20, 60).select("user_id", "wall", "logical", "value")


@query(f"WITH {_LOG}, n AS ({_newest(f'wall <= {T0} AND user_id >= 20')}) SELECT user_id, wall, logical, value FROM n WHERE rn = 1 AND NOT tombstone ORDER BY user_id LIMIT 10")
def range_scan_max_keys(spark, sf_dir):
    return versions.scan(event_log(spark, sf_dir, T0), "user_id", (T0, ANY), 20, None, 10).select("user_id", "wall", "logical", "value")


@query(f"WITH {_LOG}, n AS ({_newest(f'wall <= {T0}')}) SELECT user_id, wall, value FROM n WHERE rn = 1 AND NOT tombstone ORDER BY user_id DESC")
def reverse_scan(spark, sf_dir):
    return versions.scan_back(event_log(spark, sf_dir, T0), "user_id", (T0, ANY)).select("user_id", "wall", "value")


_TIMES = [(T_EARLY, ANY), (T0, ANY), (T_LATE, ANY)]


@query(f"WITH {_LOG}, t(at_wall) AS (VALUES ({T_EARLY}), ({T0}), ({T_LATE})), j AS (SELECT at_wall, log.* FROM log JOIN t ON wall <= at_wall), n AS ({_newest('true', 'at_wall, user_id', 'j')}) SELECT at_wall, user_id, wall, logical, value FROM n WHERE rn = 1 AND NOT tombstone")
def as_of_multi_t(spark, sf_dir):
    return versions.as_of_each(event_log(spark, sf_dir, T_LATE), ["user_id"], _TIMES).select("at_wall", "user_id", "wall", "logical", "value")


@query(f"WITH {_LOG}, n AS ({_newest('true')}) SELECT user_id, max(CASE WHEN rn = 1 THEN wall END) AS wall, max(CASE WHEN rn = 1 THEN logical END) AS logical, bool_or(CASE WHEN rn = 1 THEN tombstone END) AS deleted, max(CASE WHEN rn = 1 THEN length(event_type) END) AS value_bytes, count(*) AS versions FROM n GROUP BY user_id")
def version_metadata(spark, sf_dir):
    return versions.metadata(event_log(spark, sf_dir), ["user_id"], F.length("event_type").cast("long"))


@query(f"WITH {_LOG} SELECT user_id, wall, logical, tombstone, row_number() OVER w AS version_rank, coalesce(lead(wall) OVER w, 0) AS prev_wall, coalesce(lead(logical) OVER w, 0) AS prev_logical FROM log WINDOW w AS (PARTITION BY user_id ORDER BY wall DESC, logical DESC)")
def version_history(spark, sf_dir):
    return versions.history(event_log(spark, sf_dir), ["user_id"]).select("user_id", "wall", "logical", "tombstone", "version_rank", F.coalesce("prev_wall", F.lit(0)).alias("prev_wall"), F.coalesce("prev_logical", F.lit(0)).alias("prev_logical"))


@query(f"WITH {_LOG}, r AS (SELECT DISTINCT user_id + 5 AS user_id FROM log), n AS ({_newest(f'wall <= {T0}')}) SELECT r.user_id, n.value, n.user_id IS NOT NULL AS found FROM r LEFT JOIN (SELECT * FROM n WHERE rn = 1 AND NOT tombstone) n USING (user_id)")
def kv_get_many(spark, sf_dir):
    log = event_log(spark, sf_dir)
    asked = log.select((F.col("user_id") + 5).alias("user_id")).distinct()
    state = versions.as_of(event_log(spark, sf_dir, T0), ["user_id"], (T0, ANY)).select("user_id", "value", F.lit(True).alias("found"))
    return asked.join(state, "user_id", "left").select("user_id", "value", F.coalesce("found", F.lit(False)).alias("found"))


@query("WITH v AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_type = 'signup') SELECT user_id, event_id, value FROM v WHERE rn = 1")
def inline_values(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type = 'signup'").select("user_id", "event_id", "value", F.lit(0).cast("long").alias("wall"), F.lit(0).alias("logical"), F.col("event_id").alias("seq"))
    return versions.inline(rows, ["user_id"]).select("user_id", "event_id", "value")


# writes


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders UNION ALL SELECT 10000000 + c_custkey, c_custkey, c_acctbal FROM customer")
def insert_upsert(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.lit(1).cast("long").alias("wall"), F.lit(0).alias("logical"), F.lit(False).alias("tombstone"))
    changed = base.filter("o_orderkey % 10 = 0").withColumns({"o_totalprice": F.col("o_totalprice") + 1, "wall": F.lit(2).cast("long")})
    fresh = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 10_000_000).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("o_totalprice"), F.lit(2).cast("long").alias("wall"), F.lit(0).alias("logical"), F.lit(False).alias("tombstone"))
    log = versions.upsert(versions.upsert(base, changed), fresh)
    return versions.latest(log, ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 'VIP' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_by_pk(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.lit(1).cast("long").alias("wall"), F.lit(0).alias("logical"), F.lit(False).alias("tombstone"))
    new = versions.get(base, ["c_custkey"], [7], (1, 0)).withColumns({"c_mktsegment": F.lit("VIP"), "wall": F.lit(2).cast("long")})
    return versions.latest(versions.upsert(base, new), ["c_custkey"]).select("c_custkey", "c_mktsegment")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <> 3")
def delete_by_pk(spark, sf_dir):
    base = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit(1).cast("long").alias("wall"), F.lit(0).alias("logical"), F.lit(False).alias("tombstone"))
    gone = versions.deletions(base.filter("n_nationkey = 3"), (2, 0))
    return versions.latest(versions.upsert(base, gone), ["n_nationkey"]).select("n_nationkey", "n_name")


@query(f"WITH {_LOG}, b AS ({_newest(f'wall <= {T_EARLY}')}), a AS ({_newest(f'wall <= {T_LATE}')}) SELECT b.user_id, b.wall AS live_wall, a.wall AS deleted_wall FROM b JOIN a USING (user_id) WHERE b.rn = 1 AND a.rn = 1 AND NOT b.tombstone AND a.tombstone")
def delete_tombstones(spark, sf_dir):
    log = event_log(spark, sf_dir, T_LATE)
    before = versions.as_of(event_log(spark, sf_dir, T_EARLY), ["user_id"], (T_EARLY, ANY)).select("user_id", F.col("wall").alias("live_wall"))
    after = versions.as_of(log, ["user_id"], (T_LATE, ANY), tombstones=True).filter("tombstone").select("user_id", F.col("wall").alias("deleted_wall"))
    return before.join(after, "user_id")


# conflicts


def _proposals(log: DataFrame) -> DataFrame:
    return log.select("user_id", "event_id", "wall", F.lit(0).alias("logical"), F.col("event_id").alias("txn_id"))


@query(f"WITH {_LOG}, m AS (SELECT user_id, max(wall) AS w FROM log WHERE wall <= {T0} GROUP BY user_id) SELECT event_id, p.user_id, CASE WHEN p.wall <= m.w THEN 'write_too_old' ELSE 'ok' END AS outcome, CASE WHEN p.wall <= m.w THEN m.w ELSE 0 END AS existing_wall FROM log p LEFT JOIN m USING (user_id)")
def write_too_old(spark, sf_dir):
    log = event_log(spark, sf_dir)
    known = log.filter(F.col("wall") <= T0).withColumn("txn_id", F.lit(None).cast("long"))
    return conflicts.classify_writes(_proposals(log), known, ["user_id"]).select("event_id", "user_id", "outcome", F.coalesce("existing_wall", F.lit(0)).alias("existing_wall"))


@query(f"WITH {_LOG}, i AS (SELECT user_id, wall AS iw, event_id AS holder FROM ({_newest(chr(39).join(['event_type = ', 'view', '']))}) WHERE rn = 1), m AS (SELECT user_id, max(struct_pack(w := wall, l := logical)) AS n FROM log GROUP BY user_id), c AS (SELECT p.event_id, p.user_id, i.iw, m.n.w AS nw, i.holder <> p.event_id AS held, i.holder IS NULL AND (p.wall < m.n.w OR p.wall = m.n.w AND 0 <= m.n.l) AS old FROM log p LEFT JOIN i USING (user_id) LEFT JOIN m USING (user_id)) SELECT event_id, user_id, CASE WHEN held THEN 'write_intent' WHEN old THEN 'write_too_old' ELSE 'ok' END AS outcome, CASE WHEN held THEN iw WHEN old THEN nw ELSE 0 END AS existing_wall FROM c")
def write_intent_conflict(spark, sf_dir):
    log = txn_log(spark, sf_dir)
    return conflicts.classify_writes(_proposals(log), log, ["user_id"]).select("event_id", "user_id", "outcome", F.coalesce("existing_wall", F.lit(0)).alias("existing_wall"))


@query(f"WITH {_LOG} SELECT user_id, max(wall) AS wall FROM log GROUP BY user_id HAVING max(wall) > {T_LATE} AND max(wall) <= {T_LATE + 7 * DAY}")
def uncertainty_window(spark, sf_dir):
    return conflicts.uncertain(event_log(spark, sf_dir), ["user_id"], (T_LATE, ANY), (T_LATE + 7 * DAY, ANY)).select("user_id", "wall")


@query(f"WITH {_LOG} SELECT user_id, arg_max(event_id, struct_pack(w := wall, l := logical)) AS txn_id, max(wall) AS wall FROM log WHERE event_type = 'view' AND wall <= {T_EARLY} GROUP BY user_id")
def read_blocked_by_intent(spark, sf_dir):
    return conflicts.blocked(txn_log(spark, sf_dir, T_EARLY), ["user_id"], (T_EARLY, ANY)).select("user_id", "txn_id", "wall")


@query(f"WITH {_LOG}, r AS (SELECT user_id, max(struct_pack(w := wall, l := logical)) AS t FROM log WHERE event_type = 'view' GROUP BY user_id), p AS (SELECT event_id, user_id, wall, t FROM log LEFT JOIN r USING (user_id) WHERE event_type = 'purchase') SELECT event_id, user_id, coalesce(wall < t.w OR wall = t.w AND 0 <= t.l, false) AS pushed, CASE WHEN wall < t.w OR wall = t.w AND 0 <= t.l THEN t.w ELSE wall END AS wall, CASE WHEN wall < t.w OR wall = t.w AND 0 <= t.l THEN t.l + 1 ELSE 0 END AS logical FROM p")
def ts_cache_push(spark, sf_dir):
    log = event_log(spark, sf_dir)
    reads = log.filter("event_type = 'view'").select("user_id", "wall", "logical", F.col("event_id").alias("txn_id"))
    writes = log.filter("event_type = 'purchase'").select("event_id", "user_id", "wall", F.lit(0).alias("logical"), F.lit(None).cast("long").alias("txn_id"))
    return conflicts.push_by_reads(writes, reads, ["user_id"]).select("event_id", "user_id", "pushed", "wall", "logical")


@query(f"WITH {_LOG}, r AS (SELECT user_id, arg_max(logical, struct_pack(w := wall, l := logical)) AS logical, max(wall) AS wall FROM log GROUP BY user_id), o AS (SELECT *, row_number() OVER (ORDER BY wall DESC, logical DESC, user_id) AS k FROM r) SELECT user_id, wall, false AS low_water FROM o WHERE k <= 50 UNION ALL SELECT -1, max(wall), true FROM o WHERE k > 50")
def ts_cache_bounded(spark, sf_dir):
    kept, low = conflicts.read_cache(event_log(spark, sf_dir).select("user_id", "wall", "logical"), ["user_id"], 50)
    return kept.select("user_id", "wall", F.lit(False).alias("low_water")).unionAll(low.select(F.lit(-1).cast("long"), "wall", F.lit(True)))


_WRITTEN = f"epoch_us(ts) * 1000 + (event_id % 3) * {DAY}"


@query(f"WITH {_LOG}, t AS (SELECT event_id AS id, {_STATUS} AS status, {_WRITTEN} AS w FROM events) SELECT user_id, event_id, CASE WHEN status = 'COMMITTED' THEN w ELSE wall END AS wall, CASE WHEN status = 'PENDING' THEN event_id ELSE -1 END AS txn_id FROM log JOIN t ON id = event_id WHERE status <> 'ABORTED'")
def resolve_intents(spark, sf_dir):
    log = event_log(spark, sf_dir)
    txns = log.select(F.col("event_id").alias("txn_id"), status().alias("status"), (F.col("wall") + F.col("event_id") % 3 * DAY).alias("write_wall"), F.col("logical").alias("write_logical"))
    held = log.withColumn("txn_id", F.col("event_id"))
    return intents.resolve(held, txns).select("user_id", "event_id", "wall", F.coalesce("txn_id", F.lit(-1)).alias("txn_id"))


@query(f"WITH {_LOG} SELECT event_id, user_id, CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN greatest(wall, {T0}) ELSE wall END AS wall FROM log")
def push_intents(spark, sf_dir):
    log = txn_log(spark, sf_dir)
    pushes = log.filter("txn_id IS NOT NULL AND event_id % 2 = 0").select("txn_id", F.lit(T0).alias("to_wall"), F.lit(0).alias("to_logical"))
    return intents.push(log, pushes).select("event_id", "user_id", "wall")


@query(f"WITH t AS (SELECT {_STATUS} AS status, CASE WHEN event_id % 2 = 0 THEN 'SSI' ELSE 'SI' END AS iso, event_id % 3 AS push FROM events) SELECT iso, CASE WHEN status = 'ABORTED' OR iso = 'SSI' AND push > 0 THEN 'retry' ELSE 'committed' END AS outcome, count(*) AS n FROM t GROUP BY ALL")
def commit_isolation(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("iso", F.when(F.col("event_id") % 2 == 0, "SSI").otherwise("SI"))
    read, write = hlc.hlc(F.col("wall"), F.col("logical")), hlc.hlc(F.col("wall") + F.col("event_id") % 3, F.col("logical"))
    return log.withColumn("outcome", conflicts.commit_outcome(F.col("iso"), status(), read, write)).groupBy("iso", "outcome").agg(F.count("*").alias("n"))


@query(f"WITH {_LOG}, i AS (SELECT user_id, arg_max(event_id, struct_pack(w := wall, l := logical)) AS b FROM log GROUP BY user_id), f AS (SELECT p.event_id, b, p.event_id % 7 AS pri, b % 7 AS bpri, {_STATUS.replace('event_type', 'h.event_type')} AS status, CASE WHEN b % 2 = 0 THEN 'SSI' ELSE 'SI' END AS iso, h.wall AS hw, h.logical AS hl, p.wall AS pw, p.logical AS pl FROM log p JOIN i USING (user_id) JOIN log h ON h.event_id = b WHERE p.event_id <> b) SELECT event_id, b AS blocker, CASE WHEN status = 'ABORTED' THEN 'clean_abort' WHEN status = 'COMMITTED' THEN 'clean_commit' WHEN pri > bpri THEN 'abort_blocker' ELSE 'retry' END AS write_write, CASE WHEN status = 'ABORTED' THEN 'clean_abort' WHEN status = 'COMMITTED' THEN 'clean_commit' WHEN iso = 'SSI' AND (hw < pw OR hw = pw AND hl < pl + 1) THEN CASE WHEN pri > bpri THEN 'abort_blocker' ELSE 'retry' END ELSE 'push' END AS read_write FROM f")
def priority_fight(spark, sf_dir):
    log = event_log(spark, sf_dir)
    top = log.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "wall", "logical"), versions.stamp()).alias("h"))
    both = log.join(top, "user_id").filter("event_id <> h.event_id").withColumn("event_type", F.col("h.event_type"))
    pri, held = F.col("event_id") % 7, F.col("h.event_id") % 7
    iso = F.when(F.col("h.event_id") % 2 == 0, "SSI").otherwise("SI")
    return both.select("event_id", F.col("h.event_id").alias("blocker"), conflicts.write_write(status(), pri, held).alias("write_write"), conflicts.read_write(status(), iso, hlc.hlc(F.col("h.wall"), F.col("h.logical")), pri, held, hlc.hlc(F.col("wall"), F.col("logical"))).alias("read_write"))


_GC = f"WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY wall DESC, logical DESC) AS rn, row_number() OVER (PARTITION BY user_id, wall <= {T0} ORDER BY wall DESC, logical DESC) AS rn_side FROM log), g AS (SELECT *, bool_or(rn = 1 AND tombstone AND wall <= {T0}) OVER (PARTITION BY user_id) AS dead FROM r)"


@query(f"{_GC} SELECT user_id, event_id, wall FROM g WHERE NOT dead AND (rn = 1 OR wall > {T0})")
def gc_retained(spark, sf_dir):
    return versions.gc_retained(event_log(spark, sf_dir), ["user_id"], (T0, ANY)).select("user_id", "event_id", "wall")


@query(f"{_GC} SELECT user_id, event_id, wall FROM g WHERE dead OR NOT (rn = 1 OR wall > {T0})")
def gc_dropped(spark, sf_dir):
    return versions.gc_dropped(event_log(spark, sf_dir), ["user_id"], (T0, ANY)).select("user_id", "event_id", "wall")


@query(f"{_GC} SELECT user_id, event_id, wall FROM g WHERE NOT dead AND (rn = 1 OR wall > {T0} OR rn_side = 1)")
def gc_keep_visible(spark, sf_dir):
    return versions.gc_retained(event_log(spark, sf_dir), ["user_id"], (T0, ANY), keep_visible=True).select("user_id", "event_id", "wall")


@query(f"WITH c AS (SELECT user_id, event_id, epoch_us(ts) * 1000 // {DAY} * {DAY} AS wall FROM events), m AS (SELECT *, max(wall) OVER (PARTITION BY user_id ORDER BY event_id) AS hlc_wall FROM c) SELECT user_id, event_id, hlc_wall, row_number() OVER (PARTITION BY user_id, hlc_wall ORDER BY event_id) - 1 AS hlc_logical FROM m")
def hlc_now_series(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("wall", F.expr(f"wall div {DAY}L * {DAY}L"))
    return spread.clock_series(log, "wall", "event_id", "user_id").select("user_id", "event_id", "hlc_wall", "hlc_logical")


# layers

_LAYERS = f"{_LOG}, n AS (SELECT *, event_id % 4 AS layer, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 4, event_id) AS rn FROM log)"


def _layers(spark, sf_dir):
    return event_log(spark, sf_dir).withColumn("layer", F.col("event_id") % 4)


@query(f"WITH {_LAYERS} SELECT user_id, event_id, layer, value FROM n WHERE rn = 1 AND NOT tombstone")
def lsm_layered_merge(spark, sf_dir):
    return layers.merged(_layers(spark, sf_dir), ["user_id"], F.struct("layer", "event_id")).select("user_id", "event_id", "layer", "value")


_TWO = f"{_LOG}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) AS k FROM log), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2) AS rn FROM l WHERE k = 1)"


def _compacted(spark, sf_dir, bottom):
    log = event_log(spark, sf_dir)
    upper, lower = (layers.merged(log.filter(f"event_id % 2 = {k}"), ["user_id"], "event_id", tombstones=True) for k in (0, 1))
    return layers.compacted(upper, lower, ["user_id"], bottom).select("user_id", "event_id", "tombstone", "value")


@query(f"WITH {_TWO} SELECT user_id, event_id, tombstone, value FROM n WHERE rn = 1 AND NOT tombstone")
def compaction_bottom(spark, sf_dir):
    return _compacted(spark, sf_dir, True)


@query(f"WITH {_TWO} SELECT user_id, event_id, tombstone, value FROM n WHERE rn = 1")
def compaction_mid(spark, sf_dir):
    return _compacted(spark, sf_dir, False)


@query("SELECT p_size % 3 AS level, count(*) AS files, (4 * pow(10, p_size % 3))::BIGINT AS threshold, count(*) >= 4 * pow(10, p_size % 3) AS due FROM part GROUP BY p_size % 3")
def level_file_counts(spark, sf_dir):
    return layers.level_counts(table(spark, sf_dir, "part").select((F.col("p_size") % 3).alias("level")))


# keys, cluster state


@query("SELECT s_suppkey, lower('2F737570706C6965722F' || lpad(hex(s_suppkey), 16, '0')) AS row_key, lower('2F737570706C6965722F' || lpad(hex(s_suppkey), 16, '0') || '00' || 'FFFFFFFFFFFF' || lpad(hex(65535 - s_suppkey % 1000), 4, '0') || 'FFFFFFFE') AS version_key, s_suppkey AS decoded, s_suppkey % 1000 AS wall FROM supplier")
def row_key_encoding(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", keys.row_key("supplier", F.col("s_suppkey")).alias("k"))
    rows = rows.withColumn("v", keys.version_key(F.col("k"), F.col("s_suppkey") % 1000, F.lit(1))).withColumn("p", keys.version_parts(F.col("v")))
    return rows.select("s_suppkey", F.lower(F.hex("k")).alias("row_key"), F.lower(F.hex("v")).alias("version_key"), keys.row_key_value("supplier", F.col("p.raw")).alias("decoded"), F.col("p.wall").alias("wall"))


def _infos(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return log.select(F.concat_ws("-", "event_type", (F.col("user_id") % 20).cast("string")).alias("key"), "value", F.expr("event_id div 10").alias("stamp"), F.col("user_id").alias("node"), F.when(F.col("event_id") % 5 == 0, F.lit(0)).otherwise(F.col("event_id") % 11 * DAY).cast("long").alias("ttl"), F.col("wall").alias("created"), F.col("event_id").alias("arrival"))


_INFOS = f"i AS (SELECT event_type || '-' || (user_id % 20) AS key, value, event_id // 10 AS stamp, user_id AS node, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 11 * {DAY} END AS ttl, epoch_us(ts) * 1000 AS created, event_id AS arrival FROM events)"


@query(f"WITH {_INFOS}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY stamp DESC, arrival) AS rn FROM i) SELECT key, value, stamp, node, arrival FROM n WHERE rn = 1 AND (ttl = 0 OR {T_LATE} <= created + ttl)")
def gossip_latest(spark, sf_dir):
    return spread.unexpired(spread.latest_infos(_infos(spark, sf_dir)), T_LATE).select("key", "value", "stamp", "node", "arrival")


@query(f"WITH {_INFOS}, h AS (SELECT node, max(stamp) AS s FROM i WHERE created <= {T0} GROUP BY node) SELECT key, stamp, i.node, arrival FROM i LEFT JOIN h ON h.node = i.node WHERE stamp > coalesce(s, 0)")
def gossip_delta(spark, sf_dir):
    infos = _infos(spark, sf_dir)
    return spread.delta(infos, spread.high_water(infos.filter(F.col("created") <= T0))).select("key", "stamp", "node", "arrival")


@query(f"WITH r AS (SELECT user_id AS node, event_id % 3 AS epoch, epoch_us(ts) * 1000 + {DAY} AS expiration FROM events), m AS (SELECT node, epoch, expiration, row_number() OVER (PARTITION BY node ORDER BY epoch DESC, expiration DESC) AS rn FROM r) SELECT node, epoch, expiration, {T_LATE} < expiration AS live FROM m WHERE rn = 1")
def liveness_state(spark, sf_dir):
    rows = event_log(spark, sf_dir).select(F.col("user_id").alias("node"), (F.col("event_id") % 3).alias("epoch"), (F.col("wall") + DAY).alias("expiration"))
    return spread.liveness(rows, T_LATE)


@query("WITH m AS (SELECT event_id, user_id, epoch_us(ts) * 1000 AS sent, (event_id % 1000) * 1000001 AS rtt, (event_id * 7919) % 1500000000 - 700000000 AS skew FROM events), o AS (SELECT event_id, sent + rtt // 2 + skew - (sent + rtt // 2) AS clock_offset, rtt // 2 AS uncertainty FROM m) SELECT event_id, clock_offset, uncertainty, abs(clock_offset) <= 500000000 AS healthy FROM o")
def clock_offset(spark, sf_dir):
    rows = event_log(spark, sf_dir).select("event_id", F.col("wall").alias("sent"), (F.col("event_id") % 1000 * 1000001).alias("rtt"), (F.col("event_id") * 7919 % 1500000000 - 700000000).alias("skew"))
    rows = rows.withColumn("server", F.col("sent") + F.expr("rtt div 2") + F.col("skew"))
    offset = hlc.clock_offset(F.col("server"), F.col("sent"), F.col("rtt"))
    return rows.select("event_id", offset.alias("clock_offset"), F.expr("rtt div 2").alias("uncertainty"), hlc.is_healthy(offset, 500_000_000).alias("healthy"))


@query("SELECT user_id AS range_id, list_sort(list(event_id % 100), 'DESC')[len(list(event_id)) // 2 + 1] AS commit_index, min(event_id % 100) AS slowest FROM events GROUP BY user_id")
def quorum_commit_index(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("range_id"), (F.col("event_id") % 100).alias("match_index"))
    return spread.quorum_index(rows, "range_id")


@query("WITH m AS (SELECT o_custkey AS account, -(o_orderkey % 7) AS amount FROM orders UNION ALL SELECT (o_custkey * 31) % 150 + 1, o_orderkey % 7 FROM orders UNION ALL SELECT c_custkey, 100 FROM customer) SELECT account, sum(amount)::BIGINT AS balance FROM m GROUP BY account")
def bank_transfer_balances(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    moves = orders.select(F.col("o_custkey").alias("account"), (-(F.col("o_orderkey") % 7)).alias("amount")).unionAll(orders.select(F.col("o_custkey") * 31 % 150 + 1, F.col("o_orderkey") % 7)).unionAll(table(spark, sf_dir, "customer").select("c_custkey", F.lit(100).cast("long")))
    return moves.groupBy("account").agg(F.sum("amount").alias("balance"))


# SQL over states as of a time: extensions that Spark SQL brings


def _views(spark, sf_dir):
    versions.as_of(event_log(spark, sf_dir, T0), ["user_id"], (T0, ANY)).createOrReplaceTempView("palimpsest_events")
    for name in ("orders", "customer", "nation", "region", "lineitem"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"palimpsest_{name}")


_STATE = f"{_LOG}, palimpsest_events AS (SELECT * FROM ({_newest(f'wall <= {T0}')}) WHERE rn = 1 AND NOT tombstone)"
_JOIN = "SELECT n_name, event_type, count(*) AS users, max(value) AS top_value FROM palimpsest_events JOIN {p}customer ON c_custkey = user_id JOIN {p}nation ON n_nationkey = c_nationkey GROUP BY n_name, event_type"
_RANK = "SELECT user_id, event_type, value, CAST(rank() OVER (PARTITION BY event_type ORDER BY value DESC, user_id) AS BIGINT) AS place FROM palimpsest_events"
_SETS = "SELECT user_id FROM palimpsest_events WHERE value > 50 EXCEPT SELECT o_custkey FROM {p}orders WHERE o_totalprice > 400000 UNION SELECT c_custkey FROM {p}customer WHERE c_acctbal < -500"
_ROLLUP = "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM {p}lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"


@query(f"WITH {_STATE} {_JOIN.format(p='')}")
def sql_join_group(spark, sf_dir):
    _views(spark, sf_dir)
    return spark.sql(_JOIN.format(p="palimpsest_"))


@query(f"WITH {_STATE} {_RANK}")
def sql_window(spark, sf_dir):
    _views(spark, sf_dir)
    return spark.sql(_RANK)


@query(f"WITH {_STATE} {_SETS.format(p='')}")
def sql_set_operations(spark, sf_dir):
    _views(spark, sf_dir)
    return spark.sql(_SETS.format(p="palimpsest_"))


@query(_ROLLUP.format(p=""))
def sql_rollup(spark, sf_dir):
    _views(spark, sf_dir)
    return spark.sql(_ROLLUP.format(p="palimpsest_"))
