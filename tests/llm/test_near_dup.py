import random
import re
from collections import Counter

import numpy as np
import pandas as pd

from palimpsest.llm import near_dup


def sets_of(texts, width):
    out = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    return out


def components(texts, width, percent):
    sets, parent, index = sets_of(texts, width), {d: d for d in texts}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d in sorted(sets):
        for e, n in Counter(e for s in sets[d] for e in index.get(s, [])).items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
        for s in sets[d]:
            index.setdefault(s, []).append(d)
    return {d: find(d) for d in texts}, {d: len(s) for d, s in sets.items()}


def check(df, width=4, percent=80):
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    want, sizes = components(texts, width, percent)
    for r in near_dup.near_duplicates(df, width, percent).collect():
        assert r["component_id"] == want[r["doc_id"]] and r["n_shingles"] == sizes[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]])
    return want


def family(pick, n, words, edits):
    base = [f"w{pick.randrange(5000)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for _ in range(pick.randint(0, edits)):
            own[pick.randrange(words)] = f"w{pick.randrange(10**6)}"
        yield " ".join(own)


def test_against_brute_force_on_the_table(spark, small):
    check(spark.read.parquet(f"{small}/documents.parquet"))


def test_families_at_the_threshold(spark):
    """Copies with more and more edits: links between members that a bucket's centre does not link must be found."""
    pick = random.Random(4)
    texts = [t for _ in range(12) for t in family(pick, 60, 90, 7)] + [t for _ in range(40) for t in family(pick, 3, 12, 1)]
    pick.shuffle(texts)
    want = check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert len(want) - len(set(want.values())) > 200


def test_blocks_of_a_large_family(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    monkeypatch.setattr(near_dup, "PART", 5000)
    pick = random.Random(9)
    check(spark.createDataFrame(list(enumerate(family(pick, 150, 60, 8))), "doc_id long, text string"))


def test_members_that_share_only_boilerplate_meet_nobody(spark, monkeypatch):
    """The prefix filter keeps both ends of every link between two labels, and drops who has only the common part."""
    monkeypatch.setattr(near_dup, "PART", 6000)
    monkeypatch.setattr(near_dup, "SAMPLE", 20000)
    pick = np.random.default_rng(3)
    core = pick.choice(2**62, 160, replace=False)
    alone = [np.concatenate([core, pick.choice(2**62, 40, replace=False)]) for _ in range(80)]
    near = [np.concatenate([x[: 200 - k], pick.choice(2**62, k, replace=False)]) for x, k in zip(alone[:20], range(0, 60, 3))]
    sets = [np.unique(x.astype(np.uint64)) for x in [*alone, *near]]
    frame = spark.createDataFrame([(k, bytearray(s.tobytes()), 8 * len(s)) for k, s in enumerate(sets)], "_id long, _set binary, _size int")
    members = spark.createDataFrame([(5, k, k) for k in range(len(sets))], "family long, rep long, label long")
    met = {r["_met"] for r in near_dup._meeting(members, frame, 80).collect()}
    linked = set()
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            n = len(np.intersect1d(x, y))
            if 100 * n >= 80 * (len(x) + len(y) - n):
                linked |= {i, j}
    assert linked and linked <= met and len(met) < len(linked) + 20
    same = members.selectExpr("family", "rep", "1L AS label")
    assert near_dup._meeting(same, frame, 80).isEmpty()


def test_a_chain_is_one_component(spark):
    words = [f"w{k}" for k in range(400)]
    chain = [" ".join(words[10 * k : 10 * k + 200]) for k in range(20)]
    want = check(spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string"))
    assert set(want.values()) == {0}


def test_many_exact_copies_and_short_texts(spark):
    texts = ["the same words again and again"] * 500 + ["a b", "A B", "b a", "a b c", "", " "]
    want = check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert want[499] == 0 and want[501] == 500 and want[502] == 502


def test_signatures_estimate_similarity_and_fill_empty_bins():
    pick = np.random.default_rng(1)
    for n in (1, 2, 9, 60, 400):
        a = np.unique(pick.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[n // 10 :], pick.integers(0, 2**63, max(n // 10, 0), dtype=np.uint64)]))
        x, y, z = near_dup.signature([a, b, a])
        assert (x == z).all() and (x != 0).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((x == y).mean() - true) < 0.3
    assert near_dup.band_keys(near_dup.signature([a])).shape == (1, near_dup.BINS // near_dup.ROWS)


def test_block_links_join_labels_once():
    s = np.arange(10, dtype=np.uint64).tobytes()
    t = np.arange(100, 110, dtype=np.uint64).tobytes()
    frame = pd.DataFrame({"label": [1, 2, 3, 4], "probe": [False, True, True, True], "target": [True] * 4, "_set": [s, s, s, t]})
    assert len(near_dup._block_links(frame, 80)) == 2


def test_a_doc_id_with_several_texts_is_one_document(spark):
    words = lambda seed: " ".join(f"{seed}{k}" for k in range(40))
    rows = [(1, words("a")), (2, words("b")), (3, words("a")), (3, words("b")), (4, words("c")), (4, words("c")), (5, words("d"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs).collect()]
    assert sorted(out) == [(1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (4, 4, True), (4, 4, True), (5, 5, True)]
    assert sorted(tuple(r) for r in near_dup.keep_one(docs).collect()) == [(1, words("a")), (4, words("c")), (5, words("d"))]
