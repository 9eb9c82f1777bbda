"""Words, hashes, shared helpers."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import common, textnp
from palimpsest.sources import files

TEXTS = st.lists(st.text(alphabet=st.sampled_from("abAB é\n\t\x0b\x1f x"), max_size=30), max_size=8)


@settings(deadline=None, max_examples=200)
@given(TEXTS, st.sampled_from([1, 8, 1000]))
def test_words_of_chunks(texts, limit):
    found = []
    for c in textnp.chunks(pa.array(texts, pa.string()), limit):
        c.words()
        for d in range(c.n):
            found.append([bytes(c.buf[c.start[k] : c.end[k]]).decode() for k in range(c.first[d], c.first[d + 1])])
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]


@settings(deadline=None, max_examples=200)
@given(TEXTS)
def test_lines_and_hashes(texts):
    for c in textnp.chunks(pa.array(texts, pa.string())):
        start, end, doc = c.lines()
        lines = [(int(d), bytes(c.buf[a:b]).decode()) for a, b, d in zip(start, end, doc, strict=True)]
        assert sorted(lines) == sorted((k, line) for k, t in enumerate(texts) for line in t.split("\n"))
        c.prefix(lower=True)
        hashes = c.hashes(start, end)
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), line) for _, line in lines]
        assert all((hashes[i] == hashes[j]) == (low[i] == low[j]) for i in range(len(low)) for j in range(i))


def test_nulls_slices_and_long_texts():
    column = pa.array(["x y", None, "", "z" * 3_000_000, "a b c"]).slice(1)
    got = []
    for c in textnp.chunks(column):
        c.words()
        got += c.count.tolist()
    assert got == [0, 0, 1, 3]
    assert list(textnp.chunks(pa.array([], pa.string()))) == []


def test_shingle_sets_of_short_texts():
    (c,) = textnp.chunks(pa.array(["a b c d e", "A B C D E", "a b", "b a", "", "a a a a a a"]))
    sets = textnp.shingle_sets(c, 4)
    assert [len(s) for s in sets] == [2, 2, 1, 1, 0, 1]
    assert np.array_equal(sets[0], sets[1]) and sets[2][0] != sets[3][0]


def test_key_filter_passes_all_members_and_few_others(spark):
    keys = spark.range(0, 1000).select(F.col("id").alias("k"))
    probe = spark.range(0, 20_000)
    kept = common.pass_filter(probe, common.key_filter(keys, "k"), F.col("id"))
    assert kept.filter("id < 1000").count() == 1000 and kept.count() < 1100
    marked = common.pass_filter(probe, common.key_filter(keys.limit(0), "k"), F.col("id"), "mark")
    assert marked.filter("_maybe").count() == 0 and marked.count() == 20_000


def test_remainder_matches_crc32(rows):
    import zlib

    df = rows("doc_id long", (1,), (-5,), (10**12,), (None,))
    out = df.select("doc_id", common.remainder(F.col("doc_id"), 5).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 for r in out)


def test_shared_folder_comes_from_the_session(spark):
    assert files.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    df = common.stored(spark.range(5), "t")
    assert df.count() == 5 and df.inputFiles()[0].startswith(files.shared_dir(spark).replace("file://", "file://"))


def test_components(spark, rows):
    from palimpsest.llm.graphs import components

    edges = rows("a long, b long", *[(k, k + 1) for k in range(1, 40)], (100, 101), (101, 100), (5, 5), (None, 3), *[(200, k) for k in range(201, 260)])
    out = {r["node"]: r["label"] for r in components(edges.filter("a IS NOT NULL")).collect()}
    assert all(out[k] == 1 for k in range(1, 41)) and out[101] == out[100] == 100 and all(out[k] == 200 for k in range(200, 260)) and len(out) == 102
    assert components(edges.limit(0)).count() == 0


