"""Near-duplicates: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidate edges.

Documents with equal shingle sets form one class at once (a cryptographic digest of the set). Only the class's
smallest document goes on. Its signature comes from one hash of each shingle: the top bits choose a bin, the least
hash of a bin is its value, and an empty bin copies the first filled bin of its own fixed random probe sequence.
Bands of the signature are bucket keys. In a bucket every member is compared with the smallest one only, on full sets.

Star edges alone would lose links between two members that the centre does not link. So documents that candidate
edges connect, confirmed or not, form a family. In a large family of more than one component the documents go that
share none of their rarest shingles with another component, which a link needs (prefix filter). Of the rest, every
document outside its family's largest component is compared with all others, in blocks of bounded size, by an inverted
index. Only links that join two components leave a block. Nothing is capped: a larger family has more blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp
from .common import arrow_map, guarded, key_filter, pass_filter, stored
from .graphs import components

BINS, ROWS = 128, 4
#: Documents that are compared with as many others in one block.
BLOCK = 128
#: Bytes of the sets that one task of the prefix filter takes, and about those of the sample that orders a family's
#: shingles; neither changes the result.
PART, SAMPLE = 16 << 20, 2 << 20
_PROBES = 64


def signature(sets: list[np.ndarray], bins: int = BINS, seed: int = 11) -> np.ndarray:
    """MinHash values (sets x bins) of non-empty sorted sets of 64-bit hashes."""
    bits = np.uint64(64 - int(bins).bit_length() + 1)
    out = np.zeros((len(sets), bins), np.uint64)
    full = np.zeros((len(sets), bins), bool)
    for k, s in enumerate(sets):
        where = (s >> bits).astype(np.int64)
        head = np.flatnonzero(np.diff(where, prepend=-1))  # sorted: the first of a bin is its least
        out[k, where[head]] = s[head]
        full[k, where[head]] = True
    empty = ~full
    values = out.copy()
    column = np.arange(bins, dtype=np.uint64)
    for turn in range(1, 1 << 20):
        rows, cols = np.nonzero(empty)
        if not len(rows):
            break
        if turn > _PROBES:  # so few bins are filled that the rest take the next filled one in the turn's own order
            for r in np.unique(rows):
                filled = np.flatnonzero(full[r])
                own = cols[rows == r]
                pick = textnp.mix(column[own] * np.uint64(_PROBES + 1) + np.uint64(seed))
                order = textnp.mix(filled.astype(np.uint64)[None, :] ^ pick[:, None])
                values[r, own] = out[r, filled[np.argmin(order, axis=1)]]
            break
        probe = (textnp.mix(column * np.uint64(_PROBES) + np.uint64(turn + seed)) % np.uint64(bins)).astype(np.int64)
        got = full[rows, probe[cols]]
        values[rows[got], cols[got]] = out[rows[got], probe[cols[got]]]
        empty[rows[got], cols[got]] = False
    return values


def band_keys(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit bucket key for each band of ``rows`` values."""
    parts = values.reshape(len(values), -1, rows)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        key = textnp.mix(key ^ parts[:, :, k])
    return key.view(np.int64)


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, band keys (none for empty sets)."""

    def run(batches):
        for batch in batches:
            for c in textnp.chunks(batch.column(1)):
                sets = textnp.shingle_sets(c, width)
                some = [s for s in sets if len(s)]
                keys = band_keys(signature(some)) if some else np.zeros((0, BINS // ROWS), np.int64)
                sizes = np.array([len(s) for s in sets])
                off = np.concatenate([[0], np.cumsum((sizes > 0) * keys.shape[1])]).astype(np.int32)
                marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.n), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.ListArray.from_arrays(pa.array(off), pa.array(keys.ravel()))], names=["doc_id", "n_shingles", "mark", "keys"])

    return arrow_map(docs, run, "doc_id long, n_shingles long, mark binary, keys array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, the set's digest and the full set, as the bytes of its sorted 64-bit hashes."""

    def run(batches):
        for batch in batches:
            for c in textnp.chunks(batch.column(1)):
                sets = [s.tobytes() for s in textnp.shingle_sets(c, width)]
                marks = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.n), pa.array(marks, pa.binary()), pa.array(sets, pa.binary())], names=["_id", "_mark", "_set"])

    return arrow_map(docs, run, "_id long, _mark binary, _set binary")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """centre, rep, common and union sizes of the full sets."""
    one = pairs.join(sets.select(F.col("_id").alias("_a"), F.col("_set").alias("_left")), F.col("centre") == F.col("_a")).drop("_a")
    both = one.join(sets.select(F.col("_id").alias("_b"), F.col("_set").alias("_right")), F.col("rep") == F.col("_b")).drop("_b")

    def run(batches):
        for batch in batches:
            common, union = [], []
            last, a = None, None
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.as_buffer(), y.as_buffer()
                if last is None or x != last:
                    last, a = x, np.frombuffer(x, np.uint64)
                b = np.frombuffer(y, np.uint64)
                small, large = (a, b) if len(a) < len(b) else (b, a)
                at = np.searchsorted(large, small)
                n = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                common.append(n)
                union.append(len(a) + len(b) - n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(union, pa.int64())], names=["centre", "rep", "common", "all"])

    return arrow_map(both.select("centre", "rep", "_left", "_right"), run, "centre long, rep long, common long, all long")


def _linked(common, union, percent: int):
    return 100 * common >= percent * union


def _block_links(frame: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links of one block's probes with its targets that join two labels, as pairs of labels."""
    probes = frame[frame["probe"]]
    targets = frame[frame["target"]]
    if not len(probes) or not len(targets):
        return []
    sets = [np.frombuffer(x, np.uint64) for x in probes["_set"]]
    size = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], np.repeat(np.arange(len(sets)), size)[order]
    label = probes["label"].to_numpy()
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    links = []
    for raw, own in zip(targets["_set"], targets["label"].to_numpy(), strict=True):
        s = np.frombuffer(raw, np.uint64)
        lo, hi = np.searchsorted(tokens, s, "left"), np.searchsorted(tokens, s, "right")
        n = hi - lo
        lo, n = lo[n > 0], n[n > 0]
        if not len(n):
            continue
        at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        common = np.bincount(owner[at], minlength=len(sets))
        for k in np.flatnonzero(_linked(common, size + len(s) - common, percent) & (label != own)):
            x, y = find(int(label[k])), find(int(own))
            if x != y:
                root[max(x, y)] = min(x, y)
                links.append((int(label[k]), int(own)))
    return links


def _meeting(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members (family, rep, label) that may have a link to another label of their family: rep.

    Each family orders its shingles from rare to frequent, as a sample of it counts them. Sets of similarity p share
    one of the first n - ceil(2 p n / (1 + p)) + 1 shingles of the smaller set and n - ceil(p n) + 1 of the larger one
    (n: the set's size), in any order, so the sample decides on the cost alone. What a whole family has in common comes
    last: members that share nothing else meet nobody, and cost what their own shingles do.
    """
    sized = members.join(sets.select("_id", "_size"), F.col("rep") == F.col("_id")).groupBy("family").agg(F.sum("_size").alias("bytes"))
    sized = stored(sized.select(F.col("family").alias("_f"), "bytes", F.ceil(F.col("bytes") / PART).alias("parts")), "family_sizes")
    rows = members.join(sized, F.col("family") == F.col("_f")).join(sets, F.col("rep") == F.col("_id"))
    sampled = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("bytes")) < SAMPLE
    own = F.struct(F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part"), F.lit(False).alias("sample"))
    everywhere = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), F.lit(True).alias("sample")))
    rows = rows.select("family", "rep", "label", "_set", F.explode(F.when(sampled, F.concat(F.array(own), everywhere)).otherwise(F.array(own))).alias("place"))
    rows = rows.select("family", "place.part", "place.sample", "rep", "label", "_set")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        drawn = [np.frombuffer(x, np.uint64) for x in frame.loc[frame["sample"], "_set"]]
        known, times = np.unique(np.concatenate([*drawn, np.zeros(1, np.uint64)]), return_counts=True)
        mine = frame[~frame["sample"]]
        spots, first = [], []
        for raw in mine["_set"]:
            s = np.frombuffer(raw, np.uint64)
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            long, short = (len(s) + (-part * len(s) // of) + 1 for part, of in ((percent, 100), (2 * percent, 100 + percent)))
            spots.append(s[np.argsort(np.where(known[at] == s, times[at], 0), kind="stable")[:long]])
            first.append(np.arange(len(spots[-1])) < short)
        n = [len(x) for x in spots]
        salt = textnp.mix(frame["family"].to_numpy()[:1].astype(np.uint64))
        spot = textnp.mix(np.concatenate([*spots, np.zeros(0, np.uint64)]) ^ salt).view(np.int64)
        return pd.DataFrame({"spot": spot, "rep": np.repeat(mine["rep"].to_numpy(), n), "label": np.repeat(mine["label"].to_numpy(), n), "first": np.concatenate([*first, np.zeros(0, bool)])})

    found = stored(rows.groupBy("family", "part").applyInPandas(run, "spot long, rep long, label long, first boolean"), "prefixes")
    early = F.when(F.col("first"), F.col("label"))
    spots = found.groupBy("spot").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(early).alias("_lo"), F.max(early).alias("_hi")).filter("lo < hi AND _lo IS NOT NULL")
    spots = stored(spots.select(F.col("spot").alias("_spot"), "_lo", "_hi"), "spots")
    return stored(found.join(spots, F.col("spot") == F.col("_spot")).filter("first OR _lo <> label OR _hi <> label").select(F.col("rep").alias("_met")).distinct(), "meeting")


def _unsettled(families: DataFrame) -> DataFrame:
    """Members of families of several labels, with whether they are outside the largest one, and the family's blocks."""
    sizes = families.groupBy("family", "label").agg(F.count("*").alias("n"))
    whole = sizes.groupBy("family").agg(F.sum("n").alias("total"), F.max(F.struct("n", "label")).alias("main")).filter("total > main.n")
    whole = whole.select(F.col("family").alias("_f"), F.col("main.label").alias("main"), F.ceil(F.col("total") / BLOCK).alias("targets"), F.ceil((F.col("total") - F.col("main.n")) / BLOCK).alias("probes"))
    whole = stored(whole, "unsettled")  # its size is known when the join is planned
    return families.join(whole, F.col("family") == F.col("_f")).select("family", "rep", "label", (F.col("label") != F.col("main")).alias("probe"), "targets", "probes")


def _rest(families: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different labels of a family (rep, label, family) that star edges missed: a, b (labels)."""
    single = F.col("targets") == 1
    rows = _unsettled(families)
    large = stored(rows.filter(~single).select("family", "rep", "label"), "large")
    if not large.isEmpty():
        met = large.join(_meeting(large, sets, percent), F.col("rep") == F.col("_met")).drop("_met")
        rows = rows.filter(single).unionAll(_unsettled(met))
    rows = rows.join(sets, F.col("rep") == F.col("_id")).drop("_id")
    own_probe, own_target = F.pmod(F.xxhash64("rep"), F.col("probes")), F.pmod(F.xxhash64("rep"), F.col("targets"))
    keep = ["family", "i", "j", "label", "probe", "target", "_set"]
    once = rows.filter(single).select("family", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "label", "probe", F.lit(True).alias("target"), "_set")
    many = rows.filter(~single)
    asked = many.filter("probe").select("family", own_probe.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("targets") - 1)).alias("j"), "label", "probe", F.lit(False).alias("target"), "_set")
    told = many.select("family", F.explode(F.sequence(F.lit(0).cast("long"), F.col("probes") - 1)).alias("i"), own_target.alias("j"), "label", F.lit(False).alias("probe"), F.lit(True).alias("target"), "_set")
    blocks = once.select(keep).unionAll(asked.select(keep)).unionAll(told.select(keep))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_block_links(frame, percent), columns=["a", "b"], dtype="int64")

    return blocks.groupBy("family", "i", "j").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document (one row for each row of ``docs``).

    Documents are linked if 100 * shared shingles >= percent * all shingles of both, over whole texts with A-Z
    lower-cased. component_id is the least doc_id that links reach, kept whether it is the document's own. A document
    of fewer than ``width`` words is one shingle; a null or empty text, or one without words, links with nothing.
    Rows of one doc_id are one document, whatever their texts, and share a component; a null doc_id has a null component
    and is kept. Texts of any length are read whole; extra columns are not read; an empty table gives an empty one.
    Links are confirmed on full sets of 64-bit shingle hashes, not on the shingles' bytes; a pair at the threshold
    shares a bucket with probability 1 - 5e-8, and one that shares none is still met in a common family.
    """
    part = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    signed = stored(_signed(part, width), "signatures")
    known = signed.filter("mark IS NOT NULL AND doc_id IS NOT NULL")
    # classes have numbers of their own: one doc_id with several texts may be the least of several classes
    classes = known.groupBy("mark").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys"))
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    buckets = classes.select("rep", F.explode("keys").alias("bucket"))
    centres = buckets.groupBy("bucket").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).filter("centre < last").select(F.col("bucket").alias("_bucket"), "centre")
    pairs = stored(buckets.join(centres, F.col("bucket") == F.col("_bucket")).filter("rep <> centre").select("centre", "rep").distinct(), "pairs")
    wanted = pairs.select("rep").union(pairs.select("centre")).distinct()
    wanted = stored(classes.select("mark", "least", F.col("rep").alias("_rep")).join(wanted, F.col("_rep") == F.col("rep")).select("mark", "least", "rep"), "wanted")
    near = _sets(pass_filter(part, key_filter(wanted, "least"), F.col("doc_id")), width)
    near = near.join(wanted, (F.col("_id") == F.col("least")) & (F.col("_mark") == F.col("mark"))).select(F.col("rep").alias("_id"), "_set")
    near = near.withColumn("_size", F.length("_set"))
    sets = stored(near.dropDuplicates(["_id"]), "sets")  # repeated rows have equal sets
    links = stored(_compared(pairs, sets).filter(_linked(F.col("common"), F.col("all"), percent)).select(F.col("centre").alias("a"), F.col("rep").alias("b")), "links")
    same = _same_document(known, classes)
    links = links if same is None else links.union(same)
    labels = components(links)
    families = components(pairs.select(F.col("centre").alias("a"), F.col("rep").alias("b"))).select(F.col("node").alias("rep"), F.col("label").alias("family"))
    families = families.join(labels.withColumnRenamed("label", "_label"), F.col("rep") == F.col("node"), "left").select("rep", "family", F.coalesce("_label", "rep").alias("label"))
    rest = stored(_rest(stored(families, "families"), sets, percent), "rest")
    if not rest.isEmpty():
        labels = components(links.union(rest))
    of_label = classes.join(labels, F.col("rep") == F.col("node")).groupBy("label").agg(F.min("least").alias("component")).withColumnRenamed("label", "_label")
    named = labels.join(of_label, F.col("label") == F.col("_label")).select("node", "component")
    final = classes.join(named, F.col("rep") == F.col("node"), "left").select(F.col("mark").alias("_mark"), F.coalesce("component", "least").alias("component"))
    out = signed.join(final, F.col("mark") == F.col("_mark"), "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _same_document(known: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links between the classes of doc_ids that have several texts: a, b. None where there is no such doc_id."""
    several = known.groupBy("doc_id").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).filter("lo < hi")
    several = stored(several.select(F.col("doc_id").alias("_several"), "lo"), "several")
    if several.isEmpty():
        return None
    own = classes.select("mark", "rep")
    rows = known.select("doc_id", "mark").join(several, F.col("doc_id") == F.col("_several")).filter("mark > lo").select("lo", "mark").distinct()
    rows = rows.join(own.select(F.col("mark").alias("_lo"), F.col("rep").alias("a")), F.col("lo") == F.col("_lo"))
    return stored(rows.join(own.withColumnRenamed("mark", "_m"), F.col("mark") == F.col("_m")).select("a", F.col("rep").alias("b")), "same")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near_duplicates(), with all columns of ``docs``, whatever their names.

    Of several rows of a kept doc_id the one with the least text stays (then the least hash of the row). Rows with a
    null doc_id stay; texts without words are in groups of their own.
    """
    found = stored(near_duplicates(docs, width, percent).select("doc_id", "kept"), "verdicts")
    asked = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("kept").alias("kept")).filter("doc_id IS NOT NULL AND (rows > 1 OR NOT kept)")
    asked = stored(asked.select(F.col("doc_id").alias("_asked"), "kept"), "asked")
    inner, back = guarded(docs, "doc_id", "text")
    marked = pass_filter(inner, key_filter(asked, "_asked"), inner["doc_id"].cast("long"), "mark")
    sure, some = (marked.filter(f"{no} _maybe").drop("_maybe") for no in ("NOT", ""))
    some = some.join(asked, some["doc_id"].cast("long") == asked["_asked"], "left")
    alone = some.filter("_asked IS NULL").select(*inner.columns)
    one = some.filter("kept").select("_asked", F.struct(*inner.columns).alias("_row"), F.struct(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(*inner.columns).alias("h")).alias("_order"))
    one = one.groupBy("_asked").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")
    return back(sure.unionAll(alone).unionAll(one))


def sql(width: int, percent: int) -> str:
    """The same result in DuckDB: all pairs that share a shingle, and reachability over links."""
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, spot, spot + {width - 1}), ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {width - 2}, 2))) AS spot FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= {percent} * (a.n + b.n - common)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, l.y FROM reach JOIN l ON l.x = reach.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
