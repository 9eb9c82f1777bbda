import threading

import pytest
from pyspark.sql import types as T

from palimpsest.plans.clock import Clock, Timestamp
from palimpsest.plans.sql import Engine, SqlError, spark_text, statements
from palimpsest.sources.catalog import CatalogError, column_type
from palimpsest.sources.files import Files
from palimpsest.sources.store import CommitConflict, VersionStore

LOG = T.StructType().add("key", "string").add("value", "string").add("wall", "long").add("logical", "integer").add("tombstone", "boolean")


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/db")


@pytest.fixture
def boats(engine):
    engine.execute("CREATE TABLE boats (hull INT PRIMARY KEY, label TEXT)")
    engine.execute("INSERT INTO boats VALUES (40, 'heron'), (70, 'osprey')")
    return engine


def rows(engine, sql, **k):
    return sorted(tuple(r) for r in engine.execute(sql, **k).rows.collect())


@pytest.fixture
def store(spark, tmp_path):
    return VersionStore(spark, f"file://{tmp_path}/t", LOG, ["key"])


def versions(spark, *data):
    return spark.createDataFrame([(k, v, w, 0, v is None) for k, v, w in data], LOG)


def test_statements_of_the_surface(boats):
    assert boats.execute("CREATE TABLE ports (code TEXT PRIMARY KEY)").message == "OK"
    assert boats.execute("").message == "OK" and boats.execute(" ; -- nothing\n").message == "OK"
    assert boats.execute("INSERT INTO boats VALUES (70, 'kestrel'), (90, 'plover')").message == "INSERT 2"
    assert rows(boats, "SELECT * FROM boats") == [(40, "heron"), (70, "kestrel"), (90, "plover")]
    assert boats.execute("DELETE FROM boats WHERE hull > 80").message == "DELETE 1" and boats.execute("DELETE FROM boats WHERE hull > 80").message == "DELETE 0"
    out = boats.execute("UPDATE boats SET label = concat(label, '!') WHERE label LIKE '%r%'")
    assert (out.message, out.rows_affected) == ("UPDATE 2", 2) and boats.execute("UPDATE boats SET label = NULL WHERE hull = 5").message == "UPDATE 0"
    assert rows(boats, "SELECT label FROM boats WHERE hull = 70") == [("kestrel!",)] and rows(boats, "SELECT * FROM boats WHERE hull = 71") == []


def test_tables_are_listed_and_dropped(boats):
    assert boats.catalog.list() == ["boats"] and boats.catalog.get("BOATS").key == "hull"
    assert [r["name"] for r in boats.execute("SHOW TABLES").rows.collect()] == ["boats"]
    boats.execute("DROP TABLE boats")
    assert boats.catalog.list() == []
    with pytest.raises(CatalogError, match="no table"):
        boats.execute("DROP TABLE boats")
    boats.execute("CREATE TABLE boats (hull INT PRIMARY KEY, label TEXT)")
    assert rows(boats, "SELECT * FROM boats") == []


@pytest.mark.parametrize("sql", ["CREATE TABLE boats (hull INT PRIMARY KEY)", "CREATE TABLE t (id FLOAT PRIMARY KEY, n TEXT)", "CREATE TABLE t (f BOOL PRIMARY KEY)", "CREATE TABLE t (id INT)", "CREATE TABLE t (a INT PRIMARY KEY, b INT PRIMARY KEY)", "CREATE TABLE t (id INT PRIMARY KEY, d DATE)", "CREATE TABLE t (id INT PRIMARY KEY, CHECK (id > 0))", "CREATE TABLE t (id INT PRIMARY KEY, wall INT)", "CREATE TABLE t (id INT PRIMARY KEY, n TEXT NOT NULL)"])
def test_rejected_tables(boats, sql):
    with pytest.raises((CatalogError, SqlError)):
        boats.execute(sql)


@pytest.mark.parametrize("sql", ["INSERT INTO boats VALUES (1)", "INSERT INTO boats VALUES (5, 'a'), (5, 'b')", "INSERT INTO boats VALUES (NULL, 'a')", "INSERT INTO boats (label) VALUES ('a')", "INSERT INTO boats VALUES ('abc', 'a')", "UPDATE boats SET label = 'x'", "UPDATE boats SET hull = 3 WHERE hull = 40", "UPDATE boats SET nope = 3 WHERE hull = 40", "DELETE FROM boats", "TRUNCATE boats", "INSERT INTO nope VALUES (1)", "SELECT * FROM boats WHERE label = 'x"])
def test_rejected_statements_change_nothing(boats, sql):
    with pytest.raises(Exception):  # noqa: B017
        boats.execute(sql)
    assert rows(boats, "SELECT * FROM boats") == [(40, "heron"), (70, "osprey")]


def test_types_never_narrow():
    for name in ("INT", "int8", "INT4", "INTEGER", "BIGINT"):
        assert column_type(name) == T.LongType()
    for name in ("TEXT", "STRING", "VARCHAR", "VARCHAR(20)", "CHAR"):
        assert column_type(name) == T.StringType()
    for name in ("FLOAT", "FLOAT8", "FLOAT4", "REAL", "DOUBLE  PRECISION"):
        assert column_type(name) == T.DoubleType()
    assert column_type("BOOL") == column_type("BOOLEAN") == T.BooleanType()


def test_column_lists_queries_and_expressions(boats):
    boats.execute("CREATE TABLE t (k VARCHAR(10) NOT NULL PRIMARY KEY, n BIGINT, f DOUBLE PRECISION, b BOOL)")
    boats.execute("INSERT INTO t (n, k) VALUES (9007199254740993, 'it''s')")
    assert rows(boats, "SELECT k, n, f, b FROM t") == [("it's", 9007199254740993, None, None)]
    boats.execute("INSERT INTO t SELECT label, hull / 10, hull / 2, hull > 50 FROM boats")
    assert boats.execute("UPDATE t SET n = n + 1, b = false WHERE n < 10 AND k LIKE 'o%'").message == "UPDATE 1"
    assert rows(boats, "SELECT k, n, f, b FROM t WHERE n < 10") == [("heron", 4, 20.0, False), ("osprey", 8, 35.0, False)]
    assert rows(boats, 'SELECT count(*), max(CAST(u.hull AS TEXT)) FROM t JOIN boats u ON u.label = "k"') == [(2, "70")]


def test_queries_as_of_a_time(boats):
    before = boats.clock.now()
    boats.execute("UPDATE boats SET label = 'new' WHERE hull = 40; DELETE FROM boats WHERE hull = 70; INSERT INTO boats VALUES (3, 'c')")
    assert rows(boats, "SELECT * FROM boats", as_of=before) == [(40, "heron"), (70, "osprey")]
    assert rows(boats, "SELECT * FROM boats") == [(3, "c"), (40, "new")]
    with pytest.raises(SqlError):
        boats.execute("DELETE FROM boats WHERE hull = 40", as_of=before)


def test_text_output(boats):
    assert boats.execute("SELECT hull, label FROM boats WHERE hull = 40").text() == "hull | label\n-----+------\n40   | heron\n(1 row)"
    assert boats.execute("SELECT hull FROM boats WHERE hull = 7").text().endswith("(0 rows)")


def test_dialect():
    assert statements("SELECT ';'; SELECT 2 -- ;\n;") == ["SELECT ';'", "SELECT 2 -- ;"]
    assert spark_text("SELECT \"a\", 'it''s', CAST(x AS TEXT) FROM t AS text") == "SELECT `a`, 'it\\'s', CAST(x AS STRING) FROM t AS text"


def test_compaction_collection_and_vacuum(spark, store):
    for w, v in ((1, "a"), (2, "b"), (3, None)):
        store.append(versions(spark, ("x", v, w), (f"k{w}", "v", w)))
    reads = {t: sorted((r["key"], r["value"]) for r in store.state((t, 0)).collect()) for t in (1, 2, 3)}
    store.compact(partitions=2)
    assert {t: sorted((r["key"], r["value"]) for r in store.state((t, 0)).collect()) for t in (1, 2, 3)} == reads
    assert len(store.manifest()["folders"]) == 1 and store.vacuum() == [] and len(store.vacuum(grace=0)) == 3
    store.collect_garbage((3, 0))
    assert sorted(r["key"] for r in store.log().collect()) == ["k1", "k2", "k3"] and reads[3] == sorted((r["key"], r["value"]) for r in store.state().collect())


def test_vacuum_keeps_what_can_be_read_staged_or_pinned(spark, store):
    store.append(versions(spark, ("a", "1", 1)))
    files = Files(spark)
    files.create(f"{store.path}/_manifest/{2:020d}.json", "123\n{\"version\": 2, \"fol")
    assert store.vacuum(grace=0) == [] and store.state().count() == 1
    folder, _ = store.stage(versions(spark, ("b", "1", 2)))
    assert store.vacuum(grace=0) == []
    store.publish(folder)
    assert store.state().count() == 2
    with store.pinned() as log:
        store.compact()
        assert store.vacuum(grace=0) == [] and log.count() == 2
    assert len(store.vacuum(grace=0)) == 2 and store.state().count() == 2
    for name in files.names(f"{store.path}/_manifest"):
        files.create(f"{store.path}/_manifest/{name}", "torn", overwrite=True)
    assert store.vacuum(grace=0) == []  # nothing readable: nothing goes


def test_levels_are_merged_when_due(spark, store):
    for w in range(1, 4):
        store.append(versions(spark, (f"k{w}", "v", w)))
    assert store.due() == [] and store.compact_due() == 0
    store.append(versions(spark, ("k4", "v", 4)))
    assert store.due() == [0] and store.compact_due() == 1 and store.state().count() == 4
    seen = store.manifest()
    assert [seen["levels"].get(f, 0) for f in seen["folders"]] == [1]
    store.append(versions(spark, ("k5", "v", 5)))
    assert store.compact_due() == 0 and len(store.manifest()["folders"]) == 2 and store.state().count() == 5


def test_rewrites_are_sized_by_bytes(spark, store, monkeypatch):
    from palimpsest.sources import store as module

    store.append(spark.range(20_000).selectExpr("cast(id AS string) AS key", "sha2(cast(id AS string), 256) AS value", "id + 1 AS wall", "0 AS logical", "false AS tombstone"))
    monkeypatch.setattr(module, "TARGET_BYTES", 200_000)
    store.compact()
    parts = [n for n in Files(spark).names(f"{store.path}/data/{store.manifest()['folders'][0]}") if n.endswith(".parquet")]
    assert len(parts) > 4 and store.log().count() == 20_000


def test_commits_are_compared_and_torn_manifests_skipped(spark, store):
    seen = store.manifest()
    store.append(versions(spark, ("a", "1", 1)))
    with pytest.raises(CommitConflict):
        store.append(versions(spark, ("a", "2", 2)), seen=seen)
    files = Files(spark)
    files.create(f"{store.path}/_manifest/{2:020d}.json", "123\n{\"version\": 2, \"fol")
    assert store.manifest()["version"] == 1 and store.state().count() == 1
    assert store.append(versions(spark, ("b", "1", 3))) == 3 and store.state().count() == 2


def test_a_staged_folder_is_not_seen(spark, store):
    folder, written = store.stage(versions(spark, ("a", "1", 1)))
    assert written.count() == 1 and store.log().count() == 0
    store.discard(folder)
    store.append(versions(spark, ("b", "1", 1)))
    assert [r["key"] for r in store.log().collect()] == ["b"]


def test_export_clear_and_restore(spark, store, tmp_path):
    store.append(versions(spark, ("a", "1", 1), ("b", None, 2)))
    store.export(f"file://{tmp_path}/out")
    store.clear()
    assert store.log().count() == 0
    store.append(versions(spark, ("z", "1", 5)))
    store.restore(f"file://{tmp_path}/out")
    assert sorted(r["key"] for r in store.log().collect()) == ["a", "b"]


def test_appends_from_threads_all_arrive(spark, store):
    def work(n):
        store.append(versions(spark, (f"k{n}", "v", n)))

    threads = [threading.Thread(target=work, args=(n,)) for n in range(1, 5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert store.state().count() == 4


def test_clock_of_an_engine_can_be_set(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/c", Clock(lambda: 100))
    e.execute("CREATE TABLE t (id INT PRIMARY KEY); INSERT INTO t VALUES (1); INSERT INTO t VALUES (2)")
    stamps = sorted((r["wall"], r["logical"]) for r in e.store("t").log().collect())
    assert stamps == [(100, 0), (100, 1)] and rows(e, "SELECT id FROM t", as_of=Timestamp(100, 0)) == [(1,)]
