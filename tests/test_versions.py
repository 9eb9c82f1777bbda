import pytest

from palimpsest.operators import versions as v

SCHEMA = "key string, wall long, logical int, tombstone boolean, txn_id long, value string"


def put(key, wall, value, logical=0, txn=None):
    return (key, wall, logical, value is None, txn, value)


@pytest.fixture
def log(rows):
    return lambda *data: rows(SCHEMA, *data)


def values(df):
    return {r["key"]: r["value"] for r in df.collect()}


def test_point_reads(log):
    l = log(put("A", 10, "v1"), put("A", 20, "v2"))
    for at, want in ((5, {}), (10, {"A": "v1"}), (15, {"A": "v1"}), (20, {"A": "v2"}), (99, {"A": "v2"})):
        assert values(v.get(l, ["key"], ["A"], (at, 0))) == want


def test_logical_part_breaks_ties(log):
    l = log(put("A", 10, "v1", 1), put("A", 10, "v2", 2))
    assert values(v.as_of(l, ["key"], (10, 1))) == {"A": "v1"}
    assert values(v.as_of(l, ["key"], (10, 5))) == {"A": "v2"}
    assert values(v.as_of(l, ["key"], (10, 0))) == {}


def test_tombstones_hide_after_the_newest_is_picked(log):
    l = log(put("a", 10, "x"), put("b", 10, "y"), put("c", 10, "z"), put("b", 20, None))
    assert values(v.as_of(l, ["key"], (25, 0))) == {"a": "x", "c": "z"}
    assert values(v.as_of(l, ["key"], (15, 0))) == {"a": "x", "b": "y", "c": "z"}
    assert v.as_of(l, ["key"], (25, 0), tombstones=True).count() == 3


def test_range_scan_is_half_open_ordered_and_limited(log):
    l = log(*(put(k, 10, k) for k in "ecabd"))
    assert [r["key"] for r in v.scan(l, "key", (20, 0), "b", "d").collect()] == ["b", "c"]
    assert [r["key"] for r in v.scan(l, "key", (20, 0)).collect()] == list("abcde")
    assert [r["key"] for r in v.scan(l, "key", (20, 0), max_keys=2).collect()] == ["a", "b"]
    assert [r["key"] for r in v.scan_back(l, "key", (20, 0), "c").collect()] == ["e", "d", "c"]


def test_own_intents_show_and_foreign_ones_do_not(log):
    l = log(put("a", 10, "x"), put("a", 20, "mine", txn=1), put("b", 20, "other", txn=2))
    assert values(v.as_of(l, ["key"], (30, 0), own=1)) == {"a": "mine"}
    assert values(v.as_of(l, ["key"], (15, 0), own=1)) == {"a": "x"}
    assert values(v.as_of(l, ["key"], (30, 0))) == {"a": "x"}


def test_inline_values(rows):
    l = rows(SCHEMA + ", seq int", (*put("a", 0, "x"), 1), (*put("a", 0, "y"), 2), (*put("b", 5, "z"), 3))
    assert values(v.inline(l, ["key"])) == {"a": "y"}
    assert values(v.get(l, ["key"], ["a"], (0, 0))) == {"a": "y"}
    assert values(v.as_of(l, ["key"], (9, 0))) == {"b": "z"}


def test_several_times(log):
    l = log(put("a", 10, "old"), put("a", 20, "new"), put("b", 15, "b"))
    out = {(r["at_wall"], r["key"]): r["value"] for r in v.as_of_each(l, ["key"], [(12, 0), (25, 0)]).collect()}
    assert out == {(12, "a"): "old", (25, "a"): "new", (25, "b"): "b"}


def test_metadata_and_history(log):
    from pyspark.sql import functions as F

    l = log(put("a", 10, "xx"), put("a", 20, None), put("b", 5, "yyy"))
    out = {r["key"]: tuple(r)[1:] for r in v.metadata(l, ["key"], F.length("value")).collect()}
    assert out["a"][:2] == (20, 0) and out["a"][2] is True and out["a"][4] == 2 and out["b"] == (5, 0, False, 3, 1)
    ranks = {(r["key"], r["wall"]): (r["version_rank"], r["prev_wall"]) for r in v.history(l, ["key"]).collect()}
    assert ranks == {("a", 20): (1, 10), ("a", 10): (2, None), ("b", 5): (1, None)}


def test_gc_rules(log):
    l = log(*(put("A", w, str(w)) for w in (10, 20, 30, 40, 50)), put("one", 10, "x"), put("dead", 10, "x"), put("dead", 20, None), put("late", 10, "x"), put("late", 40, None))
    kept = lambda **k: sorted((r["key"], r["wall"]) for r in v.gc_retained(l, ["key"], (30, 0), **k).collect())
    assert kept() == [("A", 40), ("A", 50), ("late", 40), ("one", 10)]
    assert kept(keep_visible=True) == [("A", 30), ("A", 40), ("A", 50), ("late", 10), ("late", 40), ("one", 10)]
    assert v.gc_retained(l, ["key"], (30, 0)).count() + v.gc_dropped(l, ["key"], (30, 0)).count() == l.count()


def test_gc_changes_reads_only_below_the_oldest_kept_version(log):
    l = log(put("A", 10, "a"), put("A", 50, "b"))
    after = v.gc_retained(l, ["key"], (30, 0))
    assert values(v.as_of(l, ["key"], (40, 0))) == {"A": "a"} and values(v.as_of(after, ["key"], (40, 0))) == {}
    visible = v.gc_retained(l, ["key"], (30, 0), keep_visible=True)
    for t in (30, 40, 50, 60):
        assert values(v.as_of(visible, ["key"], (t, 0))) == values(v.as_of(l, ["key"], (t, 0)))


def test_filters_and_columns_reach_the_scan(spark, log, tmp_path):
    log(put("a", 10, "x")).write.parquet(str(tmp_path / "l"))
    plan = v.scan(spark.read.parquet(str(tmp_path / "l")), "key", (20, 0), "a", "b").select("key")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,a)" in plan and "LessThan(key,b)" in plan and "value:string" not in plan
