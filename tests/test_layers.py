from palimpsest.operators import layers, spread

SCHEMA = "key string, value string, tombstone boolean"


def values(df):
    return {r["key"]: r["value"] for r in df.collect()}


def test_newer_layers_win_and_deletions_hide(rows):
    top, mid, old = rows(SCHEMA, ("a", "a1", False), ("b", None, True)), rows(SCHEMA, ("b", "b2", False), ("c", "c2", False)), rows(SCHEMA, ("a", "a3", False), ("d", "d3", False))
    stack = layers.stack(top, mid, old)
    assert values(layers.merged(stack, ["key"], "layer")) == {"a": "a1", "c": "c2", "d": "d3"}
    assert values(layers.merged(stack, ["key"], "layer", tombstones=True)) == {"a": "a1", "b": None, "c": "c2", "d": "d3"}
    assert values(layers.merged(layers.stack(old), ["key"], "layer")) == {"a": "a3", "d": "d3"}


def test_compaction_keeps_deletions_above_the_bottom(rows):
    up, low = rows(SCHEMA, ("a", None, True), ("b", "new", False)), rows(SCHEMA, ("a", "x", False), ("b", "old", False), ("c", "c", False))
    assert values(layers.compacted(up, low, ["key"], bottom=True)) == {"b": "new", "c": "c"}
    assert values(layers.compacted(up, low, ["key"], bottom=False)) == {"a": None, "b": "new", "c": "c"}


def test_level_thresholds(rows):
    files = rows("level int, name string", *[(0, str(k)) for k in range(4)], *[(1, str(k)) for k in range(5)])
    assert {r["level"]: tuple(r)[1:] for r in layers.level_counts(files).collect()} == {0: (4, 4, True), 1: (5, 40, False)}


def test_gossip_liveness_and_quorum(rows):
    infos = rows("key string, value string, stamp long, node long, ttl long, created long, arrival int", ("k", "first", 5, 1, 0, 0, 1), ("k", "same", 5, 2, 0, 0, 2), ("k", "stale", 4, 1, 0, 0, 3), ("x", "gone", 1, 3, 10, 0, 4))
    latest = spread.latest_infos(infos)
    assert {r["key"]: r["value"] for r in latest.collect()} == {"k": "first", "x": "gone"}
    assert [r["key"] for r in spread.unexpired(latest, 11).collect()] == ["k"] and spread.unexpired(latest, 10).count() == 2
    assert {r["node"]: r["stamp"] for r in spread.high_water(infos).collect()} == {1: 5, 2: 5, 3: 1}
    peer = rows("node long, stamp long", (1, 4), (3, 1))
    assert sorted(r["value"] for r in spread.delta(infos, peer).collect()) == ["first", "same"]
    live = rows("node int, epoch long, expiration long", (1, 1, 99), (1, 2, 10), (2, 1, 20), (2, 1, 30))
    assert {r["node"]: tuple(r)[1:] for r in spread.liveness(live, 20).collect()} == {1: (2, 10, False), 2: (1, 30, True)}
    match = rows("g int, match_index long", (1, 9), (1, 4), (1, 7), (2, 3))
    assert {r["g"]: tuple(r)[1:] for r in spread.quorum_index(match, "g").collect()} == {1: (7, 4), 2: (3, 3)}


def test_clock_series(rows):
    df = rows("g int, n int, wall long", (1, 1, 5), (1, 2, 5), (1, 3, 4), (1, 4, 6))
    out = spread.clock_series(df, "wall", "n", "g").orderBy("n").collect()
    assert [(r["hlc_wall"], r["hlc_logical"]) for r in out] == [(5, 0), (5, 1), (5, 2), (6, 0)]
