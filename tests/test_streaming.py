from pyspark.sql import types as T

from palimpsest.sources.store import VersionStore
from palimpsest.streaming import apply, latest

LOG = T.StructType().add("key", "string").add("value", "string").add("wall", "long").add("logical", "integer").add("tombstone", "boolean")
INFO = T.StructType().add("key", "string").add("stamp", "long").add("node", "long").add("value", "string")


def files(spark, path, schema, *batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_log_is_applied_in_batches_and_only_once(spark, tmp_path):
    store = VersionStore(spark, f"file://{tmp_path}/t", LOG, ["key"])
    stream = files(spark, tmp_path, LOG, [("a", "1", 1, 0, False)], [("a", "2", 2, 0, False), ("b", None, 2, 0, True)])
    for _ in range(2):  # the second run finds nothing new
        apply.apply_log(stream, store, f"{tmp_path}/check").awaitTermination()
    assert store.log().count() == 3 and [(r["key"], r["value"]) for r in store.state().collect()] == [("a", "2")]
    applied = store.manifest()["applied"]
    assert not apply.apply_batch(store, store.log(), applied) and store.log().count() == 3


def test_log_with_snapshots(spark, tmp_path):
    store = VersionStore(spark, f"file://{tmp_path}/t", LOG, ["key"])
    stream = files(spark, tmp_path, LOG, *[[("k", str(n), n, 0, False)] for n in range(1, 5)])
    apply.apply_log_with_snapshots(stream, store, f"{tmp_path}/check", every=2).awaitTermination()
    assert store.log().count() == 4 and len(store.manifest()["folders"]) == 1


def test_prefix_callbacks(spark, tmp_path):
    seen = {"node": 0, "x": 0}
    stream = files(spark, tmp_path, INFO, [("node-1", 1, 1, "a"), ("other", 1, 1, "b")])

    def count(name):
        return lambda rows: seen.__setitem__(name, seen[name] + rows.count())

    apply.on_prefix(stream, {"node-": count("node"), "x": count("x")}, f"{tmp_path}/check").awaitTermination()
    assert seen == {"node": 1, "x": 0}


def test_latest_infos_keep_the_first_of_equal_stamps(spark, tmp_path):
    stream = files(spark, tmp_path, INFO, [("k", 5, 1, "first")], [("k", 5, 2, "same")], [("k", 4, 1, "stale")], [("k", 6, 1, "new")])
    query = latest.latest_infos(stream).writeStream.format("memory").queryName("infos").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    values = [r["value"] for r in spark.sql("SELECT value FROM infos ORDER BY stamp").collect()]
    assert values[-1] == "new" and "same" not in values[:1] and len(values) <= 3


def test_streaming_liveness_and_versions(spark, tmp_path):
    schema = T.StructType().add("node", "integer").add("epoch", "long").add("expiration", "long")
    stream = files(spark, tmp_path, schema, [(1, 1, 99), (2, 1, 5)], [(1, 2, 10)])
    query = latest.liveness(stream).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.sql("SELECT node, epoch, expiration FROM live").collect()} == {(1, 2, 10), (2, 1, 5)}
