from pyspark.sql import functions as F

from palimpsest.functions import hlc, keys

TOP = hlc.MAX_LOGICAL


def test_timestamps_order_by_wall_then_logical(rows):
    df = rows("wall long, logical int", (2, 0), (1, 5), (1, 2), (0, 0))
    out = df.select(hlc.hlc(F.col("wall"), F.col("logical")).alias("t")).orderBy("t").select("t.*").collect()
    assert [tuple(r) for r in out] == [(0, 0), (1, 2), (1, 5), (2, 0)]


def test_next_previous_text_and_empty(rows):
    df = rows("wall long, logical int", (7, 3), (7, TOP), (7, 0), (0, 0)).withColumn("t", hlc.hlc(F.col("wall"), F.col("logical")))
    out = df.select(hlc.following(F.col("t")).alias("n"), hlc.preceding(F.col("t")).alias("p"), hlc.to_text(F.col("t")).alias("s"), hlc.is_empty(F.col("t")).alias("e")).collect()
    assert [tuple(r["n"]) for r in out] == [(7, 4), (8, 0), (7, 1), (0, 1)]
    assert [tuple(r["p"]) for r in out][:3] == [(7, 2), (7, TOP - 1), (6, TOP)]
    assert out[0]["s"] == "7.0000000003" and [r["e"] for r in out] == [False, False, False, True]


def test_wall_of_ignores_the_session_time_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-15 12:00:00.000001' AS ts")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert df.select(hlc.wall_of("ts")).first()[0] == 1_705_320_000_000_001_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_clock_offset_and_health(rows):
    df = rows("server long, sent long, rtt long", (1_000, 400, 200), (100, 400, 201), (None, 1, 1))
    off = hlc.clock_offset(F.col("server"), F.col("sent"), F.col("rtt"))
    out = df.select(off, hlc.is_healthy(off, 450)).collect()
    assert [tuple(r) for r in out] == [(500, False), (-400, True), (None, True)]


def test_row_keys_round_trip_and_order(rows):
    df = rows("k long", (1,), (2,), (-1,), (2**62,))
    out = df.select("k", keys.row_key("t", F.col("k")).alias("b")).withColumn("back", keys.row_key_value("t", F.col("b"))).orderBy("b").collect()
    assert [r["k"] for r in out] == [1, 2, 2**62, -1]  # unsigned bytes: negative numbers come last
    assert all(r["k"] == r["back"] for r in out)
    low, end = keys.table_range("t")
    assert [low <= bytes(r["b"]) < end for r in out] == [True, True, True, False]


def test_text_keys_and_foreign_tables(rows):
    df = rows("k string", ("a",), ("é",), ("",)).withColumn("b", keys.row_key("t", F.col("k"), of_text=True))
    out = df.select("k", keys.row_key_value("t", F.col("b"), of_text=True).alias("same"), keys.row_key_value("u", F.col("b"), of_text=True).alias("other")).collect()
    assert all(r["k"] == r["same"] and r["other"] is None for r in out)


def test_version_keys_sort_newest_first_and_round_trip(rows):
    df = rows("wall long, logical int", (1, 0), (1, 1), (5, 0)).withColumn("v", keys.version_key(F.lit(bytearray(b"k")), F.col("wall"), F.col("logical")))
    out = df.withColumn("p", keys.version_parts(F.col("v"))).orderBy("v").collect()
    assert [(r["p"]["wall"], r["p"]["logical"], bytes(r["p"]["raw"])) for r in out] == [(5, 0, b"k"), (1, 1, b"k"), (1, 0, b"k")]
    assert all((r["wall"], r["logical"]) == (r["p"]["wall"], r["p"]["logical"]) for r in out)


def test_successor_and_checksum(rows):
    import zlib

    r = rows("b binary", (bytearray(b"ab"),)).select(keys.successor(F.col("b")), keys.checksum(F.col("b"))).first()
    assert bytes(r[0]) == b"ab\x00" and r[1] == zlib.crc32(b"ab")
