import pytest
from pyspark.sql import functions as F

from palimpsest.functions import hlc
from palimpsest.operators import conflicts as c
from palimpsest.operators import intents

SCHEMA = "key string, wall long, logical int, tombstone boolean, txn_id long, value string"
PROPOSAL = "key string, wall long, logical int, txn_id long"


def outcomes(df):
    return {r["key"]: (r["outcome"], r["existing_wall"]) for r in df.collect()}


def test_write_classification(rows):
    log = rows(SCHEMA, ("below", 20, 0, False, None, "x"), ("equal", 20, 0, False, None, "x"), ("above", 20, 0, False, None, "x"), ("dead", 20, 0, True, None, None), ("held", 20, 0, False, 1, "x"), ("mine", 20, 0, False, 7, "x"))
    asked = rows(PROPOSAL, ("below", 10, 0, None), ("equal", 20, 0, None), ("above", 30, 0, None), ("dead", 15, 0, None), ("held", 99, 0, 2), ("mine", 10, 0, 7), ("new", 1, 0, None))
    assert outcomes(c.classify_writes(asked, log, ["key"])) == {"below": ("write_too_old", 20), "equal": ("write_too_old", 20), "above": ("ok", None), "dead": ("write_too_old", 20), "held": ("write_intent", 20), "mine": ("ok", None), "new": ("ok", None)}
    plain = rows(PROPOSAL, ("held", 99, 0, None))
    assert outcomes(c.classify_writes(plain, log, ["key"])) == {"held": ("write_intent", 20)}


def test_uncertainty_looks_at_the_newest_version_only(rows):
    log = rows(SCHEMA, ("in", 15, 0, False, None, "x"), ("out", 30, 0, False, None, "x"), ("two", 15, 0, False, None, "x"), ("two", 30, 0, False, None, "x"), ("own", 15, 0, False, 1, "x"))
    assert sorted(r["key"] for r in c.uncertain(log, ["key"], (10, 0), (20, 0)).collect()) == ["in", "own"]
    assert [r["key"] for r in c.uncertain(log, ["key"], (10, 0), (20, 0), own=1).collect()] == ["in"]


def test_blocked_reads(rows):
    log = rows(SCHEMA, ("a", 10, 0, False, None, "x"), ("b", 10, 0, False, 1, "x"), ("c", 30, 0, False, 1, "x"))
    assert [r["key"] for r in c.blocked(log, ["key"], (20, 0), own=2).collect()] == ["b"]
    c.assert_unblocked(log, ["key"], (20, 0), own=1)
    with pytest.raises(c.BlockedRead):
        c.assert_unblocked(log, ["key"], (20, 0), own=2)


def test_reads_push_writes_but_not_ones_own(rows):
    reads = rows(PROPOSAL, ("a", 20, 0, 1), ("a", 15, 0, 2), ("b", 20, hlc.MAX_LOGICAL, 1))
    writes = rows(PROPOSAL, ("a", 20, 0, 1), ("a", 20, 0, 3), ("a", 10, 0, 1), ("b", 5, 0, 2), ("z", 1, 0, 2))
    out = {(r["key"], r["txn_id"]): [] for r in writes.collect()}
    for r in c.push_by_reads(writes, reads, ["key"]).collect():
        out[r["key"], r["txn_id"]].append((r["pushed"], r["wall"], r["logical"]))
    assert sorted(out["a", 1]) == [(False, 20, 0), (True, 15, 1)] and out["a", 3] == [(True, 20, 1)]
    assert out["b", 2] == [(True, 21, 0)] and out["z", 2] == [(False, 1, 0)]
    low = c.push_by_reads(writes, reads, ["key"], low_water=(50, 0)).filter("key = 'z'").first()
    assert (low["wall"], low["logical"]) == (50, 1)


def test_bounded_read_cache(rows):
    reads = rows("key string, wall long, logical int", ("a", 1, 0), ("b", 2, 0), ("c", 3, 0), ("c", 1, 0))
    kept, low = c.read_cache(reads, ["key"], 2)
    assert sorted(r["key"] for r in kept.collect()) == ["b", "c"] and low.first()["wall"] == 1


def test_commit_rule(rows):
    df = rows("iso string, status string, w long", ("SI", "PENDING", 9), ("SSI", "PENDING", 5), ("SSI", "PENDING", 9), ("SI", "ABORTED", 5))
    out = df.select(c.commit_outcome(F.col("iso"), F.col("status"), hlc.hlc(5), hlc.hlc(F.col("w")))).collect()
    assert [r[0] for r in out] == ["committed", "committed", "retry", "retry"]


def test_conflict_matrices(rows):
    df = rows("status string, iso string, read long, pri int, held int", (None, None, None, 1, None), ("ABORTED", "SI", 1, 1, 9), ("COMMITTED", "SI", 1, 1, 9), ("PENDING", "SI", 1, 9, 1), ("PENDING", "SI", 1, 1, 1), ("PENDING", "SSI", 1, 9, 1), ("PENDING", "SSI", 1, 1, 9), ("PENDING", "SSI", 11, 1, 9))
    out = df.select(c.write_write(F.col("status"), F.col("pri"), F.col("held")), c.read_write(F.col("status"), F.col("iso"), hlc.hlc(F.col("read")), F.col("pri"), F.col("held"), hlc.hlc(10))).collect()
    assert [r[0] for r in out] == ["clean_abort", "clean_abort", "clean_commit", "abort_blocker", "retry", "abort_blocker", "retry", "retry"]
    assert [r[1] for r in out] == ["clean_abort", "clean_abort", "clean_commit", "push", "push", "abort_blocker", "retry", "push"]


def test_resolve_and_push_intents(rows):
    log = rows(SCHEMA, ("a", 10, 0, False, None, "old"), ("a", 20, 0, False, 1, "new"), ("b", 20, 0, False, 2, "x"), ("c", 20, 0, False, 3, "y"), ("d", 20, 0, False, 9, "z"))
    txns = rows("txn_id long, status string, write_wall long, write_logical int", (1, "COMMITTED", 25, 3), (2, "ABORTED", 20, 0), (3, "PENDING", 20, 0))
    out = sorted((r["key"], r["wall"], r["logical"], r["txn_id"]) for r in intents.resolve(log, txns).collect())
    assert out == [("a", 10, 0, None), ("a", 25, 3, None), ("c", 20, 0, 3)]
    pushes = rows("txn_id long, to_wall long, to_logical int", (1, 30, 0), (2, 5, 0), (77, 99, 0))
    out = sorted((r["key"], r["wall"]) for r in intents.push(log, pushes).collect())
    assert out == [("a", 10), ("a", 30), ("b", 20), ("c", 20), ("d", 20)]
