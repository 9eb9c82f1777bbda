"""Registered queries that run the SQL front end, catalog, version store, request batches, transactions and streams.

Each makes its tables in a new folder of the shared directory, writes through the component that it is named for, and
returns what is read back. The DuckDB text computes the same state from the driver's tables.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hlc, keys
from ..operators import spread, versions
from ..sources.catalog import TYPES, CatalogError, column_type
from ..sources.files import scratch
from ..sources.store import CommitConflict, VersionStore
from ..streaming import apply, latest
from . import kv, txn
from .clock import Clock, Timestamp
from .queries import _LOG, ANY, T0, T_LATE, _newest, event_log, query, table
from .sql import Engine, SqlError

LATER = T_LATE + 60 * 86_400_000_000_000


def _rows(spark, schema: str, *rows) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


# SQL front end


def _accounts(spark, sf_dir) -> Engine:
    """An engine with the table accounts, filled from customer by INSERT ... SELECT."""
    db = Engine(spark, scratch(spark))
    table(db.session, sf_dir, "customer").createOrReplaceTempView("customer")
    db.execute("CREATE TABLE accounts (id INT PRIMARY KEY, owner TEXT, balance FLOAT)")
    db.execute("INSERT INTO accounts SELECT c_custkey, c_name, c_acctbal FROM customer")
    return db


@query("SELECT c_custkey AS id, c_name AS owner, c_acctbal AS balance FROM customer")
def engine_insert_select(spark, sf_dir):
    return _accounts(spark, sf_dir).query("SELECT * FROM accounts")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE c_name END AS owner, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS balance FROM customer UNION ALL SELECT -1, 'added', 0.5")
def engine_insert_replaces(spark, sf_dir):
    db = _accounts(spark, sf_dir)
    db.execute("INSERT INTO accounts (owner, id) SELECT 'changed', c_custkey FROM customer WHERE c_custkey % 3 = 0; INSERT INTO accounts VALUES (-1, 'added', 0.5)")
    return db.query("SELECT * FROM accounts")


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN upper(c_name) ELSE c_name END AS owner, CASE WHEN c_acctbal < 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance FROM customer")
def engine_update(spark, sf_dir):
    db = _accounts(spark, sf_dir)
    db.execute("UPDATE accounts SET balance = balance + 1, owner = upper(owner) WHERE balance < 0")
    return db.query("SELECT * FROM accounts")


@query("SELECT c_custkey AS id, c_acctbal AS balance FROM customer WHERE c_custkey % 4 <> 1")
def engine_delete(spark, sf_dir):
    db = _accounts(spark, sf_dir)
    db.execute("DELETE FROM accounts WHERE id % 4 = 1")
    return db.query("SELECT id, balance FROM accounts")


@query("SELECT 'then' AS state, count(*) AS n, sum(c_custkey)::BIGINT AS ids FROM customer UNION ALL SELECT 'now', count(*), sum(c_custkey)::BIGINT FROM customer WHERE c_custkey % 4 <> 1")
def engine_as_of(spark, sf_dir):
    db = _accounts(spark, sf_dir)
    then = db.clock.now()
    db.execute("DELETE FROM accounts WHERE id % 4 = 1")
    text = "SELECT '{}' AS state, count(*) AS n, sum(id) AS ids FROM accounts"
    return db.query(text.format("then"), as_of=then).unionAll(db.query(text.format("now")))


@query("SELECT c_custkey AS id, 'it''s' AS quoted, 1.5 AS half, true AS yes, c_acctbal > 100 AS rich FROM customer WHERE c_name >= 'Customer#00000001' AND c_custkey <> 12")
def engine_literals(spark, sf_dir):
    return _accounts(spark, sf_dir).query("SELECT a.id, 'it''s' AS quoted, CAST(1.5 AS FLOAT8) AS half, TRUE AS yes, a.balance > 100 AS \"rich\" FROM accounts a WHERE a.owner >= 'Customer#00000001' AND a.id <> 12")


_DONE = "SELECT 1 AS step, 'INSERT' AS outcome, count(*) AS n FROM customer"


@query(f"{_DONE} UNION ALL SELECT step, 'refused', (SELECT count(*) FROM customer) FROM (VALUES (2), (3), (4), (5)) t(step)")
def engine_atomicity(spark, sf_dir):
    """Statements that fail change nothing: a key twice, no key, a value that does not fit, an unknown column."""
    db, out = _accounts(spark, sf_dir), []
    out.append((1, "INSERT", db.query("SELECT id FROM accounts").count()))
    for step, text in enumerate(("INSERT INTO accounts SELECT c_custkey % 7, c_name, 0 FROM customer", "INSERT INTO accounts (owner) VALUES ('nobody')", "INSERT INTO accounts VALUES ('abc', 'x', 1)", "UPDATE accounts SET height = 1 WHERE id = 1"), 2):
        try:
            outcome = db.execute(text).message
        except Exception as e:  # noqa: BLE001
            outcome = "refused" if isinstance(e, SqlError) or "CAST_INVALID_INPUT" in str(e) else f"failed: {e}"
        out.append((step, outcome, db.query("SELECT id FROM accounts").count()))
    return _rows(spark, "step int, outcome string, n long", *out)


@query("WITH n AS (SELECT count(*) AS n, count(*) FILTER (c_custkey % 2 = 0) AS even, count(*) FILTER (c_custkey % 2 = 1 AND c_acctbal < 0) AS poor FROM customer) SELECT 1 AS step, 'OK' AS message, 0::BIGINT AS affected FROM n UNION ALL SELECT 2, 'INSERT ' || n, n FROM n UNION ALL SELECT 3, 'DELETE ' || even, even FROM n UNION ALL SELECT 4, 'UPDATE ' || poor, poor FROM n UNION ALL SELECT 5, 'DELETE 0', 0 FROM n UNION ALL SELECT 6, 'SELECT', 0 FROM n UNION ALL SELECT 7, 'SHOW', 0 FROM n UNION ALL SELECT 8, 'OK', 0 FROM n")
def engine_dispatch(spark, sf_dir):
    db = Engine(spark, scratch(spark))
    table(db.session, sf_dir, "customer").createOrReplaceTempView("customer")
    texts = ["CREATE TABLE t (k INT PRIMARY KEY, b FLOAT)", "INSERT INTO t SELECT c_custkey, c_acctbal FROM customer", "DELETE FROM t WHERE k % 2 = 0", "UPDATE t SET b = 0 WHERE b < 0", "DELETE FROM t WHERE k % 2 = 0", "SELECT * FROM t", "SHOW TABLES", "DROP TABLE t"]
    results = [db.execute(text) for text in texts]
    return _rows(spark, "step int, message string, affected long", *((k, r.message, r.rows_affected) for k, r in enumerate(results, 1)))


@query("WITH w AS (SELECT greatest(4, max(length(r_name))) AS w FROM region), l AS (SELECT 0 AS line, 'code | ' || 'name' AS text FROM w UNION ALL SELECT 1, repeat('-', 4) || '-+-' || repeat('-', w) FROM w UNION ALL SELECT 2 + r_regionkey, rpad(r_regionkey::VARCHAR, 4, ' ') || ' | ' || r_name FROM region UNION ALL SELECT 2 + count(*), '(' || count(*) || ' rows)' FROM region) SELECT line::BIGINT AS line, text FROM l")
def engine_text(spark, sf_dir):
    """A result as the text table that a console shows, line by line."""
    db = Engine(spark, scratch(spark))
    table(db.session, sf_dir, "region").createOrReplaceTempView("region")
    db.execute("CREATE TABLE areas (code INT PRIMARY KEY, name TEXT); INSERT INTO areas SELECT r_regionkey, r_name FROM region")
    lines = db.execute("SELECT code, name FROM areas ORDER BY code").text().split("\n")
    return _rows(spark, "line long, text string", *enumerate(lines))


# catalog


def _three_tables(spark) -> Engine:
    db = Engine(spark, scratch(spark))
    db.execute("CREATE TABLE Orders (o_key BIGINT PRIMARY KEY, total FLOAT8, paid BOOL); CREATE TABLE parts (name VARCHAR(30) NOT NULL, size INT4, PRIMARY KEY (name)); CREATE TABLE nations (id INT PRIMARY KEY)")
    return db


@query("SELECT * FROM (VALUES ('Orders', 'o_key', 3), ('nations', 'id', 1), ('parts', 'name', 2)) t(name, key, columns)")
def catalog_list_tables(spark, sf_dir):
    return _three_tables(spark).execute("SHOW TABLES").rows


@query("SELECT * FROM (VALUES ('Orders', 1, 'o_key', 'bigint', true), ('Orders', 2, 'total', 'double', false), ('Orders', 3, 'paid', 'boolean', false), ('parts', 1, 'name', 'string', true), ('parts', 2, 'size', 'bigint', false), ('nations', 1, 'id', 'bigint', true)) t(name, place, col, kind, is_key)")
def catalog_schemas(spark, sf_dir):
    """Schemas are found whatever the case of a table's name."""
    db = _three_tables(spark)
    found = [db.catalog.get(n.upper()) for n in db.catalog.list()]
    return _rows(spark, "name string, place int, col string, kind string, is_key boolean", *((t.name, k, n, kind.simpleString(), n == t.key) for t in found for k, (n, kind) in enumerate(t.columns, 1)))


@query("SELECT * FROM (VALUES (1, 'created again', 'refused'), (2, 'dropped', 'done'), (3, 'dropped again', 'refused'), (4, 'listed', 'Orders,nations'), (5, 'created anew', 'done'), (6, 'rows', '0')) t(step, what, outcome)")
def catalog_drop_table(spark, sf_dir):
    db, out = _three_tables(spark), []
    db.execute("INSERT INTO parts VALUES ('bolt', 3)")
    for what, text in (("created again", "CREATE TABLE parts (name TEXT PRIMARY KEY)"), ("dropped", "DROP TABLE parts"), ("dropped again", "DROP TABLE parts")):
        try:
            db.execute(text)
            out.append((what, "done"))
        except CatalogError:
            out.append((what, "refused"))
    out.append(("listed", ",".join(db.catalog.list())))
    db.execute("CREATE TABLE parts (name TEXT PRIMARY KEY)")
    out += [("created anew", "done"), ("rows", str(db.query("SELECT * FROM parts").count()))]
    return _rows(spark, "step int, what string, outcome string", *((k, *o) for k, o in enumerate(out, 1)))


_KINDS = {"bigint": "INT INT8 INT4 INTEGER BIGINT", "string": "TEXT STRING VARCHAR CHAR", "boolean": "BOOL BOOLEAN", "double": "FLOAT FLOAT8 FLOAT4 REAL"}


@query(" UNION ALL ".join(f"SELECT unnest(string_split('{names}', ' ')) AS name, '{kind}' AS kind" for kind, names in _KINDS.items()) + " UNION ALL SELECT 'DOUBLE PRECISION', 'double' UNION ALL SELECT 'DATE', 'refused'")
def catalog_types(spark, sf_dir):
    rows = [(n, column_type(n).simpleString()) for n in TYPES]
    try:
        rows.append(("DATE", column_type("DATE").simpleString()))
    except CatalogError:
        rows.append(("DATE", "refused"))
    return _rows(spark, "name string, kind string", *rows)


# version store


def _event_store(spark, sf_dir, parts: int = 1) -> VersionStore:
    """The event log in a store, in ``parts`` commits."""
    log = event_log(spark, sf_dir).select("user_id", "event_id", "value", "wall", "logical", "tombstone")
    store = VersionStore(spark, scratch(spark), log.schema, ["user_id"])
    for k in range(parts):
        store.append(log.filter(F.col("event_id") % parts == k))
    return store


@query(f"WITH {_LOG}, n AS ({_newest(f'wall <= {T0} AND user_id = 7')}) SELECT user_id, event_id, value FROM n WHERE rn = 1 AND NOT tombstone")
def store_point_get(spark, sf_dir):
    return versions.get(_event_store(spark, sf_dir).log(), ["user_id"], [7], (T0, ANY)).select("user_id", "event_id", "value")


@query(f"WITH {_LOG}, n AS ({_newest('true')}) SELECT user_id, event_id, value FROM n WHERE rn = 1 AND NOT tombstone")
def store_level_compaction(spark, sf_dir):
    """The state of a log that came in nine commits, after the due levels have been merged."""
    store = _event_store(spark, sf_dir, 9)
    store.compact_due()
    return store.state().select("user_id", "event_id", "value")


@query("SELECT * FROM (VALUES ('appended', 0, 5), ('merged', 1, 1), ('appended again', 0, 3), ('appended again', 1, 1)) t(step, level, files)")
def store_level_files(spark, sf_dir):
    """Folders of each level: four or more appends are merged into one folder of the next level, fewer wait."""
    store, out = _event_store(spark, sf_dir, 5), []

    def count(step):
        seen = store.manifest()
        levels = [seen["levels"].get(f, 0) for f in seen["folders"]]
        out.extend((step, k, levels.count(k)) for k in sorted(set(levels)))

    count("appended")
    store.compact_due()
    count("merged")
    for _ in range(3):
        store.append(store.log().limit(0))
    store.compact_due()
    count("appended again")
    return _rows(spark, "step string, level int, files int", *out)


@query(f"WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY wall DESC, logical DESC) AS rn FROM log), g AS (SELECT *, bool_or(rn = 1 AND tombstone AND wall <= {T0}) OVER (PARTITION BY user_id) AS dead FROM r) SELECT user_id, event_id FROM g WHERE NOT dead AND (rn = 1 OR wall > {T0})")
def store_collect_garbage(spark, sf_dir):
    store = _event_store(spark, sf_dir)
    store.collect_garbage((T0, ANY))
    return store.log().select("user_id", "event_id")


@query(f"WITH {_LOG} SELECT user_id, event_id, wall FROM log")
def store_snapshot_restore(spark, sf_dir):
    """The log, exported, cleared and restored."""
    store, out = _event_store(spark, sf_dir), scratch(spark)
    store.export(out)
    store.clear()
    store.restore(out)
    return store.log().select("user_id", "event_id", "wall")


@query("SELECT step, (SELECT count(*) FROM events) * whole AS n FROM (VALUES ('torn manifest', 1), ('vacuumed', 1), ('staged', 1), ('staged and vacuumed', 1), ('published', 2), ('compacted under a pin', 2), ('stale commit refused', 2)) t(step, whole)")
def store_survives(spark, sf_dir):
    """Rows that readers see after a torn manifest, vacuums, staging, compaction under a pin and a commit on an old state."""
    store, out = _event_store(spark, sf_dir), []
    note = lambda step, n=None: out.append((step, store.log().count() if n is None else n))
    torn = store.manifest()["next"]
    store.files.create(f"{store.path}/_manifest/{torn:020d}.json", "7\n{\"version\": ")
    note("torn manifest")
    store.vacuum(grace=0)
    note("vacuumed")
    folder, _ = store.stage(store.log())
    note("staged")
    store.vacuum(grace=0)
    note("staged and vacuumed")
    old = store.manifest()
    store.publish(folder)
    note("published")
    with store.pinned() as log:
        store.compact()
        store.vacuum(grace=0)
        note("compacted under a pin", log.count())
    try:
        store.append(store.log(), seen=old)
    except CommitConflict:
        note("stale commit refused")
    return _rows(spark, "step string, n long", *out)


# request batches


def _kv_log(spark, sf_dir, upto=None):
    log = event_log(spark, sf_dir, upto)
    return log.select(F.col("user_id").alias("key"), "value", "wall", "logical", "tombstone", F.lit(None).cast("long").alias("txn_id"))


_REQUEST = "ordinal long, op string, key long, value double, start long, end long, max_keys int"


@query(f"WITH {_LOG}, n AS ({_newest(f'wall <= {T0}')}), live AS (SELECT user_id AS key, value FROM n WHERE rn = 1 AND NOT tombstone), g AS (SELECT n_nationkey AS ordinal, n_nationkey * 7 AS asked FROM nation), s AS (SELECT 100 + r_regionkey AS ordinal, key, value, row_number() OVER (PARTITION BY r_regionkey ORDER BY key) AS k, r_regionkey FROM region JOIN live ON key >= r_regionkey * 30 AND (r_regionkey = 4 OR key < r_regionkey * 30 + 40)) SELECT ordinal::BIGINT AS ordinal, asked::BIGINT AS key, value, live.key IS NOT NULL AS found FROM g LEFT JOIN live ON live.key = asked UNION ALL SELECT ordinal::BIGINT, key, value, true FROM s WHERE r_regionkey % 2 = 0 OR k <= 10")
def kv_batch_read(spark, sf_dir):
    """A batch of gets (for each nation) and scans (for each region; some with a limit, one without an end)."""
    gets = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("ordinal"), F.lit("get").alias("op"), (F.col("n_nationkey") * 7).cast("long").alias("key"), *(F.lit(None).cast(t).alias(n) for n, t in (("value", "double"), ("start", "long"), ("end", "long"), ("max_keys", "int"))))
    start = (F.col("r_regionkey") * 30).cast("long")
    scans = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).cast("long").alias("ordinal"), F.lit("scan").alias("op"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("double").alias("value"), start.alias("start"), F.when(F.col("r_regionkey") != 4, start + 40).alias("end"), F.when(F.col("r_regionkey") % 2 == 1, 10).otherwise(0).alias("max_keys"))
    asked = gets.unionAll(scans)
    kv.check(asked)
    return kv.read(_kv_log(spark, sf_dir, T0), asked, (T0, ANY))


def _puts(spark, sf_dir, key: str):
    part = table(spark, sf_dir, "customer")
    return part.select(F.col("c_custkey").alias("ordinal"), F.when(F.col("c_custkey") % 5 == 0, "delete").otherwise("put").alias("op"), F.expr(key).cast("long").alias("key"), F.col("c_acctbal").alias("value"))


@query(f"WITH {_LOG}, n AS ({_newest('true')}) SELECT c_custkey AS key, c_acctbal AS value FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT user_id, value FROM n WHERE rn = 1 AND NOT tombstone AND user_id NOT IN (SELECT c_custkey FROM customer)")
def kv_batch_write(spark, sf_dir):
    """The state after a batch of puts and deletes, one for each customer, has been committed to a store."""
    log = _kv_log(spark, sf_dir)
    store = VersionStore(spark, scratch(spark), log.schema, ["key"])
    store.append(log)
    rows, _ = kv.write(store.log(), _puts(spark, sf_dir, "c_custkey"), (LATER, 0))
    store.append(rows)
    return store.state().select("key", "value")


@query("WITH p AS (SELECT c_custkey AS ordinal, row_number() OVER (PARTITION BY c_custkey % 97 ORDER BY c_custkey) > 1 AS old FROM customer), s AS (SELECT min(ordinal) AS stop FROM p WHERE old) SELECT ordinal, CASE WHEN old THEN 'write_too_old' ELSE 'ok' END AS outcome FROM p, s WHERE stop IS NULL OR ordinal <= stop")
def kv_batch_stops(spark, sf_dir):
    """A batch stops at its first error: a key for the second time is too old."""
    return kv.write(_kv_log(spark, sf_dir), _puts(spark, sf_dir, "c_custkey % 97"), (LATER, 0))[1]


@query("SELECT * FROM (VALUES ('get,scan', 'read'), ('put,delete', 'write'), ('get,put', 'refused'), ('none', 'empty'), ('merge', 'refused')) t(ops, outcome)")
def kv_batch_kinds(spark, sf_dir):
    out = []
    for ops in ("get,scan", "put,delete", "get,put", "none", "merge"):
        asked = _rows(spark, "op string", *([] if ops == "none" else [(o,) for o in ops.split(",")]))
        try:
            out.append((ops, kv.check(asked)))
        except ValueError:
            out.append((ops, "refused"))
    return _rows(spark, "ops string, outcome string", *out)


# transactions


@query("WITH m AS (SELECT 1 + r_regionkey AS id, -10.0 - r_regionkey AS d FROM region UNION ALL SELECT 2 + r_regionkey, 10.0 + r_regionkey FROM region) SELECT s_suppkey AS id, 100 + coalesce((SELECT sum(d) FROM m WHERE m.id = s_suppkey), 0)::DOUBLE AS balance FROM supplier")
def txn_transfers(spark, sf_dir):
    """Balances of all suppliers after a transfer for each region, each a serializable transaction over the store."""
    log = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(100.0).alias("balance"), F.lit(1).cast("long").alias("wall"), F.lit(0).alias("logical"), F.lit(False).alias("tombstone"))
    store = VersionStore(spark, scratch(spark), log.schema, ["id"])
    store.append(log)
    manager = txn.Manager(txn.StoreBackend(store, ["id", "balance"]), Clock(max_offset=0), seed=3)
    for r in sorted(r["r_regionkey"] for r in table(spark, sf_dir, "region").select("r_regionkey").collect()):

        def move(t, r=r):
            now = t.get_many([1 + r, 2 + r])
            t.put_many({1 + r: {"balance": now[1 + r]["balance"] - 10 - r}, 2 + r: {"balance": now[2 + r]["balance"] + 10 + r}})

        manager.run(move, txn.SSI)
    return store.state().select("id", "balance")


@query("SELECT n_regionkey::BIGINT AS key, count(*) AS n FROM nation GROUP BY n_regionkey")
def txn_counters(spark, sf_dir):
    """Counters by region after four threads have added each nation in a transaction of its own: no increment is lost."""
    manager = txn.Manager(txn.MemoryBackend(), Clock(max_offset=0), seed=4)
    work = [r["n_regionkey"] for r in table(spark, sf_dir, "nation").select("n_regionkey").collect()]

    def add(part):
        for key in part:
            manager.run(lambda t, key=key: t.put(key, (t.get(key) or 0) + 1), txn.SSI, attempts=1000)

    threads = [threading.Thread(target=add, args=(work[k::4],)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    reader = manager.begin()
    return _rows(spark, "key long, n long", *reader.get_many(sorted(set(work))).items())


@query("SELECT * FROM (VALUES ('SI', 'committed', 'committed', 0), ('SSI', 'retry', 'committed', 10)) t(isolation, first, second, total)")
def txn_write_skew(spark, sf_dir):
    """Two transactions read x and y and each sets one to 0: snapshot isolation lets both commit, serializable one."""
    out = []
    for isolation in (txn.SI, txn.SSI):
        manager = txn.Manager(txn.MemoryBackend(), Clock(max_offset=0), seed=5)
        manager.run(lambda t: t.put_many({"x": 10, "y": 10}))
        both, ends = [manager.begin(isolation, 1) for _ in range(2)], []
        for t in both:
            t.get_many(["x", "y"])
        for t, key in zip(both, "xy", strict=True):
            try:
                t.put(key, 0)
                t.commit()
                ends.append("committed")
            except txn.Retry:
                t.abort()
                ends.append("retry")
        out.append((isolation, *ends, sum(manager.begin().get_many(["x", "y"]).values())))
    return _rows(spark, "isolation string, first string, second string, total int", *out)


@query("SELECT * FROM (VALUES (1, 'low against high', 'retry'), (2, 'high against low', 'committed'), (3, 'the pushed out', 'retry'), (4, 'own write', '2'), (5, 'after abort', '2'), (6, 'finished', 'refused'), (7, 'another writer', 'retry'), (8, 'run again', 'committed')) t(step, what, outcome)")
def txn_conflicts(spark, sf_dir):
    """Priorities, own reads, aborts, finished transactions, and a commit of another writer to the same store."""
    out = []

    def note(what, act):
        try:
            out.append((what, str(act())))
        except txn.Retry:
            out.append((what, "retry"))
        except txn.Finished:
            out.append((what, "refused"))

    manager = txn.Manager(txn.MemoryBackend(), Clock(max_offset=0), seed=6)
    low, high = manager.begin(priority=1), manager.begin(priority=9)
    high.put("a", 1)
    note("low against high", lambda: low.put("a", 2))
    late = manager.begin(priority=1)
    late.put("b", 1)
    high.put("b", 2)
    note("high against low", lambda: high.commit() and "committed")
    note("the pushed out", lambda: late.put("c", 1))
    own = manager.begin()
    own.put("b", 2)
    note("own write", lambda: own.get("b"))
    gone = manager.begin(priority=99)
    gone.put("d", 5)
    gone.abort()
    note("after abort", lambda: manager.begin().get("b"))
    note("finished", high.abort)
    log = _rows(spark, "id long, n long, wall long, logical int, tombstone boolean", (1, 1, 1, 0, False))
    store = VersionStore(spark, scratch(spark), log.schema, ["id"])
    store.append(log)
    other = txn.Manager(txn.StoreBackend(store, ["id", "n"]), Clock(max_offset=0), seed=7)
    t = other.begin()
    t.put(1, {"n": t.get(1)["n"] + 1})
    store.append(log.withColumn("id", F.lit(2).cast("long")))
    note("another writer", t.commit)
    note("run again", lambda: other.run(lambda t: t.put(1, {"n": 3})) or "committed")
    return _rows(spark, "step int, what string, outcome string", *((k, *o) for k, o in enumerate(out, 1)))


# streams


def _event_stream(spark, sf_dir) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")


def _until_done(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


@query(f"WITH {_LOG}, n AS ({_newest('true')}) SELECT user_id, event_id, value FROM n WHERE rn = 1 AND NOT tombstone")
def stream_apply_log(spark, sf_dir):
    """The state of a store that a stream of versions has been applied to, twice from one checkpoint."""
    log = event_log(spark, sf_dir).select("user_id", "event_id", "value", "wall", "logical", "tombstone")
    store, check = VersionStore(spark, scratch(spark), log.schema, ["user_id"]), scratch(spark)
    rows = _event_stream(spark, sf_dir).select("user_id", "event_id", "value", hlc.wall_of("ts").alias("wall"), F.col("event_id").cast("int").alias("logical"), (F.col("event_type") == "error").alias("tombstone"))
    for _ in range(2):
        apply.apply_log_with_snapshots(rows, store, check).awaitTermination()
    return store.state().select("user_id", "event_id", "value")


@query(f"WITH {_LOG}, n AS ({_newest('true')}) SELECT user_id, event_id, wall FROM n WHERE rn = 1")
def stream_latest_versions(spark, sf_dir):
    rows = _event_stream(spark, sf_dir).select("user_id", "event_id", hlc.wall_of("ts").alias("wall"), F.col("event_id").cast("int").alias("logical"))
    out = scratch(spark, "state")
    keep = lambda df, _: df.write.mode("overwrite").parquet(out)
    _until_done(apply.latest_versions(rows, ["user_id"]).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", scratch(spark)))
    return spark.read.parquet(out).select("user_id", "event_id", "wall")


@query("SELECT event_type || '-' || (user_id % 20) AS key, max(event_id) AS stamp, arg_max(user_id, event_id) AS node FROM events GROUP BY ALL")
def stream_gossip_latest(spark, sf_dir):
    """The last info of each key, kept as streaming state."""
    infos = _event_stream(spark, sf_dir).select(F.concat_ws("-", "event_type", (F.col("user_id") % 20).cast("string")).alias("key"), F.col("event_id").alias("stamp"), F.col("user_id").alias("node"), F.col("value").cast("string").alias("value"))
    out = scratch(spark, "infos")
    keep = lambda df, _: df.write.mode("append").parquet(out)
    _until_done(latest.latest_infos(infos).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", scratch(spark)))
    return versions.pick(spark.read.parquet(out), ["key"], F.col("stamp")).select("key", "stamp", "node")


@query("SELECT event_type AS prefix, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY event_type")
def stream_prefix_callbacks(spark, sf_dir):
    """Rows that callbacks by key prefix have got."""
    infos, out = _event_stream(spark, sf_dir).select(F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("key")), scratch(spark, "calls")
    own = lambda name: lambda rows: rows.select(F.lit(name).alias("prefix")).write.mode("append").parquet(out)
    apply.on_prefix(infos, {"view-": own("view"), "click-": own("click")}, scratch(spark)).awaitTermination()
    return spark.read.parquet(out).groupBy("prefix").agg(F.count("*").alias("n"))


# clocks and keys


@query(f"WITH {_LOG}, l AS (SELECT event_id, wall, CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN {ANY} ELSE logical END AS logical FROM log) SELECT event_id, CASE WHEN logical = {ANY} THEN wall + 1 ELSE wall END AS next_wall, (CASE WHEN logical = {ANY} THEN 0 ELSE logical::BIGINT + 1 END)::INT AS next_logical, CASE WHEN logical = 0 THEN wall - 1 ELSE wall END AS prev_wall, (CASE WHEN logical = 0 THEN {ANY} ELSE logical - 1 END)::INT AS prev_logical, wall || '.' || lpad(logical::VARCHAR, 10, '0') AS text, wall = 0 AND logical = 0 AS is_empty FROM l")
def hlc_functions(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("l", F.when(F.col("event_id") % 3 == 0, 0).when(F.col("event_id") % 3 == 1, ANY).otherwise(F.col("logical")))
    log = log.select("event_id", hlc.hlc(F.col("wall"), F.col("l")).alias("t"))
    after, before = hlc.following(F.col("t")), hlc.preceding(F.col("t"))
    return log.select("event_id", after["wall"].alias("next_wall"), after["logical"].alias("next_logical"), before["wall"].alias("prev_wall"), before["logical"].alias("prev_logical"), hlc.to_text(F.col("t")).alias("text"), hlc.is_empty(F.col("t")).alias("is_empty"))


@query("SELECT s_suppkey, lower(hex('/s/' || s_name) || '00') AS next_key, '/s/' || s_name >= '/s/' AND '/s/' || s_name < '/s0' AS inside, s_name AS decoded FROM supplier")
def key_functions(spark, sf_dir):
    """Successors of text keys, whether they lie in their table's range, and the keys decoded."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", keys.row_key("s", F.col("s_name"), of_text=True).alias("k"))
    lo, hi = keys.table_range("s")
    inside = (F.col("k") >= F.lit(bytearray(lo))) & (F.col("k") < F.lit(bytearray(hi)))
    return rows.select("s_suppkey", F.lower(F.hex(keys.successor(F.col("k")))).alias("next_key"), inside.alias("inside"), keys.row_key_value("s", F.col("k"), of_text=True).alias("decoded"))


@query("SELECT * FROM (VALUES (1, 100, 0), (2, 100, 1), (3, 500, 8), (4, 500, 9), (5, 500, 10), (6, 500, 11), (7, 900, 0)) t(step, wall, logical)")
def clock_follows_remotes(spark, sf_dir):
    """A clock's timestamps as its wall reading stands still or falls back and remote timestamps arrive."""
    wall = [100]
    clock = Clock(lambda: wall[0])
    out = [clock.now(), clock.now(), clock.update(Timestamp(500, 7)), clock.update(Timestamp(400, 99)), clock.now()]
    wall[0] = 50
    out.append(clock.now())
    wall[0] = 900
    out.append(clock.now())
    return _rows(spark, "step int, wall long, logical int", *((k, *t) for k, t in enumerate(out, 1)))


@query("WITH m AS (SELECT user_id AS peer, event_id, (event_id * 7919) % 1500000000 - 700000000 AS skew FROM events), o AS (SELECT peer, arg_max(skew, event_id) AS clock_offset, count(*) AS heartbeats FROM m GROUP BY peer) SELECT peer, clock_offset, heartbeats, abs(clock_offset) <= 500000000 AS healthy FROM o")
def clock_peers(spark, sf_dir):
    """Each peer's last measured clock offset over its heartbeats, and whether it is within the bound."""
    rows = event_log(spark, sf_dir).withColumn("rtt", F.col("event_id") % 1000 * 1000001)
    server = F.col("wall") + F.expr("rtt div 2") + (F.col("event_id") * 7919 % 1500000000 - 700000000)
    return spread.peer_offsets(rows.select(F.col("user_id").alias("peer"), F.col("event_id").alias("seq"), F.col("wall").alias("sent"), server.alias("server"), "rtt"), 500_000_000)
