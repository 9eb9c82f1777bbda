"""Line dedup by content-defined chunks, in DataFrame and SQL functions only.

A document's \\n-split lines are hashed, and a rolling hash over each line and the next one chooses the borders: a chunk
starts where that hash is lower than at both neighbouring lines. So borders depend on four lines only, an insertion
shifts none but its neighbours, and chunks have two lines or more. Of the chunks that occur more than once among all
documents, the first occurrence (least doc_id, then least line) stays and every other one whose bytes equal it goes.

Borders depend on the lines around a passage, so the two ends of a repeated passage, and short ones as a whole, lie in
chunks that differ: chunks alone remove an eighth of repeated passages of 3 lines, seven eighths of those of 30 lines.
complete() therefore also compares every two neighbouring lines that have a word (with the blank ones between them): of those that stand in
several places the first stays whole, and the lines of every other one go, wherever chunks end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import guarded, key_filter, pass_filter, stored

FACTOR, MODULUS = 31, 4_294_967_291
LEAST_LINES = 2


def _chunks(docs: DataFrame) -> DataFrame:
    """Adds _lines and _chunks: array of struct(at, n, hash, body) for each chunk of the text, in order."""
    out = docs.withColumn("_lines", F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1))
    out = out.withColumn("_hashes", F.expr("transform(_lines, x -> cast(conv(substring(md5(cast(x AS binary)), 1, 8), 16, 10) AS bigint))"))
    # of each line but the last; sequence() would count down for fewer than two lines
    out = out.withColumn("_rolling", F.expr(f"transform(slice(sequence(0, size(_lines)), 1, size(_lines) - 1), i -> ({FACTOR} * _hashes[i] + _hashes[i + 1]) % {MODULUS})"))
    out = out.withColumn("_cuts", F.expr(f"filter(sequence(0, size(_lines)), i -> i = 0 OR i = size(_lines) OR i >= {LEAST_LINES} AND i < size(_rolling) AND get(_rolling, i) < get(_rolling, i - 1) AND get(_rolling, i) <= coalesce(get(_rolling, i + 1), {MODULUS}L))"))
    out = out.withColumn("_chunks", F.expr("transform(sequence(0, size(_cuts) - 2), k -> named_struct('at', _cuts[k], 'n', _cuts[k + 1] - _cuts[k], 'body', array_join(slice(_lines, _cuts[k] + 1, _cuts[k + 1] - _cuts[k]), '\\n')))"))
    return out.drop("_hashes", "_rolling", "_cuts")


def _multi_line(docs: DataFrame) -> DataFrame:
    """A row for each chunk of two lines or more that has a word: doc_id, at, n, body, hash."""
    # outer (no text is without chunks): a plain explode adds a filter on the array, for which it would be computed again and again
    rows = _chunks(docs.select("doc_id", "text")).select("doc_id", F.explode_outer("_chunks").alias("c")).select("doc_id", "c.at", "c.n", "c.body")
    rows = rows.filter((F.col("n") >= LEAST_LINES) & F.col("body").rlike(r"[^\x20\x09-\x0D]"))
    return rows.withColumn("hash", F.xxhash64("body"))


def repeats(docs: DataFrame) -> DataFrame:
    """Occurrences to remove: doc_id, at (first line), n (lines), hash. Stored in the shared folder.

    Hashes find repeats; bytes decide: a chunk goes only if it equals the kept occurrence's. Hot chunks are combined
    before the shuffle and split by Spark in the joins.
    """
    part = docs.select(docs["doc_id"], docs["text"])
    place = F.struct("doc_id", "at")
    twice = _multi_line(part).groupBy("hash").agg(F.min(place).alias("keep"), F.count("*").alias("times")).filter("times > 1")
    twice = stored(twice.select(F.col("hash").alias("_hash"), "keep"), "repeated")
    found = pass_filter(_multi_line(part), key_filter(twice, "_hash"), F.col("hash"))
    found = found.join(twice, F.col("hash") == F.col("_hash")).withColumn("first", place.eqNullSafe(F.col("keep"))).select("doc_id", "at", "n", "body", "hash", "first")
    found = stored(found, "occurrences")
    kept = found.filter("first").groupBy("hash").agg(F.min("body").alias("_body")).withColumnRenamed("hash", "_hash")
    gone = found.filter("NOT first").join(kept, (F.col("hash") == F.col("_hash")) & (F.col("body") == F.col("_body")))
    return stored(gone.select("doc_id", "at", "n", "hash"), "removed")


def apply(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` with the removed chunks' lines taken out of text, and the columns _n_lines and _removed (at, n).

    Texts without removed lines are unchanged (a null stays null), and only those with some are shuffled.
    """
    own = removed.groupBy("doc_id").agg(F.collect_set(F.struct("at", "hash")).alias("_gone")).withColumnRenamed("doc_id", "_gone_id")
    marked = pass_filter(docs, key_filter(removed, "doc_id"), docs["doc_id"], "mark")
    plain = [marked[c] for c in docs.columns]
    count = F.size(F.split(F.coalesce(marked["text"], F.lit("")), "\n", -1)).alias("_n_lines")
    none = F.expr("cast(array() AS array<struct<at: int, n: int>>)").alias("_removed")
    sure = marked.filter("NOT _maybe").select(*plain, count, none)
    asked = marked.filter("_maybe").select(*plain)
    asked = _chunks(asked.join(own, asked["doc_id"].eqNullSafe(own["_gone_id"]), "left"))
    hit = "coalesce(array_contains(_gone, named_struct('at', c.at, 'hash', xxhash64(c.body))), false)"
    text = F.expr(f"CASE WHEN _gone IS NULL THEN text ELSE array_join(transform(filter(_chunks, c -> NOT {hit}), c -> c.body), '\\n') END")
    out = F.expr(f"transform(filter(_chunks, c -> {hit}), c -> named_struct('at', c.at, 'n', c.n))")
    done = asked.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns), F.size("_lines").alias("_n_lines"), out.alias("_removed"))
    return sure.unionAll(done)


def _pairs(docs: DataFrame) -> DataFrame:
    """Adds _lines and _pairs: array of struct(at, n, body) for each two lines with a word that only blank ones part."""
    out = docs.withColumn("_lines", F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1))
    out = out.withColumn("_full", F.expr(r"filter(sequence(0, size(_lines) - 1), i -> get(_lines, i) RLIKE '[^\\x20\\x09-\\x0D]')"))
    # sequence() would count down for fewer than two lines
    out = out.withColumn("_pairs", F.expr("transform(slice(sequence(0, size(_full)), 1, greatest(size(_full) - 1, 0)), k -> named_struct('at', _full[k], 'n', _full[k + 1] - _full[k] + 1, 'body', array_join(slice(_lines, _full[k] + 1, _full[k + 1] - _full[k] + 1), '\\n')))"))
    return out.drop("_full")


def _mark(at: str, n: str, body_hash: str) -> str:
    """Place and hash in one string: set functions look atoms up by hash, structs one by one."""
    return f"concat_ws(':', {at}, {n}, {body_hash})"


def passages(docs: DataFrame) -> DataFrame:
    """Repeated pairs of lines: doc_id, mark, kind (gone, or held for the first place). Stored in the shared folder."""
    part = docs.select(docs["doc_id"], docs["text"])
    rows = _pairs(part).select("doc_id", F.explode_outer("_pairs").alias("c")).select("doc_id", "c.at", "c.n", "c.body")
    rows = rows.filter("body IS NOT NULL").withColumn("hash", F.xxhash64("body"))
    place = F.struct("doc_id", "at")
    # equal rows of one doc_id are one place
    twice = rows.groupBy("hash").agg(F.min(place).alias("keep"), F.max(place).alias("last")).filter("NOT keep <=> last")
    twice = stored(twice.select(F.col("hash").alias("_hash"), "keep"), "repeated_pairs")
    found = pass_filter(rows, key_filter(twice, "_hash"), F.col("hash"))
    found = found.join(twice, F.col("hash") == F.col("_hash")).withColumn("first", place.eqNullSafe(F.col("keep")))
    found = stored(found.select("doc_id", F.expr(_mark("at", "n", "hash")).alias("mark"), "body", "hash", "first"), "pairs")
    kept = found.filter("first").groupBy("hash").agg(F.min("body").alias("_body")).withColumnRenamed("hash", "_hash")
    gone = found.filter("NOT first").join(kept, (F.col("hash") == F.col("_hash")) & (F.col("body") == F.col("_body")))
    held = found.filter("first").select("doc_id", "mark", F.lit("held").alias("kind"))
    return stored(gone.select("doc_id", "mark", F.lit("gone").alias("kind")).unionAll(held), "passages")


def complete(docs: DataFrame, spare: int | None = None) -> DataFrame:
    """``docs`` as apply() gives them, without repeated chunks and without repeated passages that share no chunk.

    A line goes if it is in a repeated chunk or pair and not in the first place of a repeated pair. Each removed line
    stands in an earlier place too, and of each removed pair one copy stays whole. With ``spare``, a document that would
    lose so many per cent of its words or more stays as it is.
    """
    chunks = repeats(docs).select("doc_id", F.expr(_mark("at", "n", "hash")).alias("mark"), F.lit("chunk").alias("kind"))
    marks = chunks.unionAll(passages(docs))
    sets = [F.collect_set(F.when(F.col("kind") == k, F.col("mark"))).alias(f"_{k}_marks") for k in ("chunk", "gone", "held")]
    own = marks.groupBy("doc_id").agg(*sets).withColumnRenamed("doc_id", "_gone_id")
    marked = pass_filter(docs, key_filter(marks.filter("kind <> 'held'"), "doc_id"), docs["doc_id"], "mark")
    plain = [marked[c] for c in docs.columns]
    count = F.size(F.split(F.coalesce(marked["text"], F.lit("")), "\n", -1)).alias("_n_lines")
    none = F.expr("cast(array() AS array<struct<at: int, n: int>>)").alias("_removed")
    sure = marked.filter("NOT _maybe").select(*plain, count, none)
    asked = marked.filter("_maybe").select(*plain)
    asked = asked.join(own, asked["doc_id"].eqNullSafe(own["_gone_id"]), "left")
    asked = _pairs(_chunks(asked).drop("_lines"))
    # a mark holds only for the row that has its text: rows may share a doc_id
    numbers = lambda name, of: f"flatten(transform(array_intersect(transform({of}, c -> {_mark('c.at', 'c.n', 'xxhash64(c.body)')}), coalesce({name}, cast(array() AS array<string>))), m -> sequence(cast(split_part(m, ':', 1) AS int), cast(split_part(m, ':', 1) AS int) + cast(split_part(m, ':', 2) AS int) - 1)))"
    asked = asked.withColumn("_out", F.expr(f"array_sort(array_except(array_union({numbers('_chunk_marks', '_chunks')}, {numbers('_gone_marks', '_pairs')}), {numbers('_held_marks', '_pairs')}))"))
    if spare is not None:
        words = lambda of: f"aggregate({of}, 0L, (n, x) -> n + regexp_count(x, r'[^\\x20\\x09-\\x0D]+'))"
        lost = words("transform(_out, i -> get(_lines, i))")
        asked = asked.withColumn("_out", F.expr(f"CASE WHEN size(_out) > 0 AND 100 * {lost} >= {spare} * {words('_lines')} THEN slice(_out, 1, 0) ELSE _out END"))
    asked = asked.withColumn("_next", F.expr("transform(_out, i -> i + 1)"))
    text = F.expr("CASE WHEN size(_out) = 0 THEN text ELSE array_join(transform(array_except(sequence(0, size(_lines) - 1), _out), i -> get(_lines, i)), '\\n') END")
    runs = F.expr("zip_with(array_except(_out, _next), array_except(_next, _out), (a, b) -> named_struct('at', a, 'n', b - a))")
    done = asked.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns), F.size("_lines").alias("_n_lines"), runs.alias("_removed"))
    return sure.unionAll(done)


def line_dedup(docs: DataFrame, whole: bool = True) -> DataFrame:
    """doc_id, n_lines, n_removed (lines), removed (first:end line numbers, comma-joined), text of every document.

    A null text counts as one empty line and stays null. Rows that share doc_id, place and bytes of a first occurrence
    all keep it; null ids come first. ``whole=False`` removes repeated chunks only; repeated passages whose chunks differ
    then stay. A repeated line with no repeated neighbour is no passage and stays. Texts of any length are read whole;
    extra columns are not read; an empty table gives an empty one.
    """
    part = docs.select(docs["doc_id"], docs["text"])
    out = complete(part) if whole else apply(part, repeats(part))
    spans = F.expr("array_join(transform(array_sort(_removed), r -> concat(r.at, ':', r.at + r.n)), ',')")
    return out.select("doc_id", F.col("_n_lines").cast("long").alias("n_lines"), F.expr("aggregate(_removed, 0L, (a, r) -> a + r.n)").alias("n_removed"), spans.alias("removed"), "text")


#: Per cent of its words that a document must lose to count as a copy rather than as one that repeats a passage.
SPARE = 50


def drop_repeats(docs: DataFrame, spare: int | None = SPARE) -> DataFrame:
    """``docs`` with repeated multi-line chunks and passages taken out of text; its columns, whatever their names.

    A document that would lose half of its words or more (``spare``) is a copy as a whole. It stays as it is, for
    near-duplicate detection to drop, which could not know it by the few lines that would be left. None spares nothing.
    """
    inner, back = guarded(docs, "doc_id", "text")
    return back(complete(inner, spare))


#: The result in DuckDB, where chunks and pairs of lines are grouped by their bytes at once.
SQL = f"""
WITH l AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
u AS (SELECT rid, doc_id, lines, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM l),
h AS (SELECT rid, doc_id, line, pos, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM u),
r AS (SELECT *, ({FACTOR} * h + lead(h) OVER w) % {MODULUS} AS r FROM h WINDOW w AS (PARTITION BY rid ORDER BY pos)),
b AS (SELECT *, CASE WHEN pos >= {LEAST_LINES} AND r < lag(r) OVER w AND r <= coalesce(lead(r) OVER w, {MODULUS}) THEN 1 ELSE 0 END AS cut FROM r WINDOW w AS (PARTITION BY rid ORDER BY pos)),
g AS (SELECT *, sum(cut) OVER (PARTITION BY rid ORDER BY pos) AS part FROM b),
c AS (SELECT rid, any_value(doc_id) AS doc_id, min(pos) AS spot, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS body FROM g GROUP BY rid, part),
m AS (SELECT rid, spot, n, row_number() OVER (PARTITION BY body ORDER BY doc_id, spot) AS k FROM c WHERE n >= {LEAST_LINES} AND regexp_matches(body, '[^\\x20\\x09-\\x0D]')),
f AS (SELECT rid, doc_id, lines, pos, lead(pos) OVER (PARTITION BY rid ORDER BY pos) AS upto FROM u WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
q AS (SELECT rid, doc_id, pos, upto, array_to_string(list_slice(lines, pos + 1, upto + 1), chr(10)) AS body FROM f WHERE upto IS NOT NULL),
p AS (SELECT rid, pos, upto, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS k, count(*) OVER (PARTITION BY body) AS times FROM q),
gone AS (SELECT rid, unnest(range(spot, spot + n)) AS pos FROM m WHERE k > 1 UNION SELECT rid, unnest(range(pos, upto + 1)) FROM p WHERE k > 1),
held AS (SELECT rid, unnest(range(pos, upto + 1)) AS pos FROM p WHERE k = 1 AND times > 1),
x AS (SELECT * FROM gone EXCEPT SELECT * FROM held),
i AS (SELECT rid, min(pos) AS a, max(pos) + 1 AS z FROM (SELECT *, pos - row_number() OVER (PARTITION BY rid ORDER BY pos) AS run FROM x) GROUP BY rid, run),
o AS (SELECT rid, sum(z - a)::BIGINT AS n_removed, string_agg(a || ':' || z, ',' ORDER BY a) AS removed FROM i GROUP BY rid),
t AS (SELECT u.rid, string_agg(line, chr(10) ORDER BY u.pos) AS cleaned FROM u LEFT JOIN x ON x.rid = u.rid AND x.pos = u.pos WHERE x.pos IS NULL GROUP BY u.rid)
SELECT l.doc_id, len(l.lines)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed, CASE WHEN n_removed IS NULL THEN l.text ELSE coalesce(cleaned, '') END AS text
FROM l LEFT JOIN o USING (rid) LEFT JOIN t USING (rid)
"""
