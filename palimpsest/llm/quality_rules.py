"""Quality rules with adaptive thresholds: mergeable quantile sketches per language and source, then a joined filter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnp
from .common import arrow_map, guarded, stored

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])
_WORD_HEAD = textnp.IS_WORD & textnp.IS_HEAD


def text_counts(column: pa.Array) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (those with a word) of each text."""
    parts: list[list[np.ndarray]] = []
    for c in textnp.chunks(column):
        c.words()
        c.prefix(lower=False)
        per_doc = np.arange(c.n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        # lines with a word: those that contain the start of one
        start, end, doc = c.lines()
        full = np.searchsorted(c.start, start) < np.searchsorted(c.start, end)
        start, end, doc = start[full], end[full], doc[full]
        distinct = np.unique(np.stack([doc.astype(np.uint64), c.hashes(start, end)], axis=1), axis=0)[:, 0] if len(doc) else np.zeros(0, np.uint64)
        n_lines = np.bincount(doc, minlength=c.n)
        n_dup = n_lines - np.bincount(distinct.astype(np.int64), minlength=c.n)
        # words in windows that a document has twice or more
        covered = np.zeros(len(c.start) + 1, np.int64)
        runs = textnp.windows(c.hashes(c.start, c.end), WINDOW)
        if len(runs):
            owner = np.repeat(np.arange(c.n), c.count)
            inside = np.flatnonzero(owner[: len(runs)] == owner[WINDOW - 1 :])
            key = textnp.mix(runs[inside] ^ per_doc[owner[inside]])
            order = np.argsort(key, kind="stable")
            same = key[order[1:]] == key[order[:-1]]
            twice = np.zeros(len(key), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            at = inside[twice]
            np.add.at(covered, at, 1)
            np.add.at(covered, at + WINDOW, -1)
        sums = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
        parts.append([c.count, c.totals(_WORD_HEAD[c.buf]), c.totals(_SYMBOL[c.buf]), n_dup, np.diff(sums[c.first]), n_lines])
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 6


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


#: Rules: a value in whole units of each document; the quantile (in twentieths) of its group from which the bound is
#: measured, above and, mirrored, below if ``low``; the least spread that counts. The bound lies SPREAD times the
#: distance of that quantile from the median beyond the quantile. Symbols and repeated lines are 0 in most documents of
#: any group, quartiles included; there the least spread decides, and elsewhere the sketch.
RULES = {
    "symbols": ("1000 * {p}n_symbols div greatest({p}word_chars, 1)", 15, False, 12),
    "dup_lines": ("1000 * {p}n_dup_lines div greatest({p}n_lines, 1)", 15, False, 100),
    "word_length": ("100 * {p}word_chars div greatest({p}n_words, 1)", 18, True, 8),
}
SPREAD = 4
#: Quantiles that are read from sketches, in twentieths.
TWENTIETHS = (2, 10, 15, 18)
#: Groups of fewer documents take the merged sketch of their language, then of all documents.
LEAST_GROUP = 50


def measured(docs: DataFrame, *keep: str, prefix: str = "") -> DataFrame:
    """The columns of ``keep`` as they are, then the counts of the text (null: none), named with ``prefix``."""
    part = docs.select(*(docs[c] for c in keep), *([] if "text" in keep else [docs["text"].alias("_text")]))
    names = [prefix + c for c in COUNTS]
    at = keep.index("text") if "text" in keep else len(keep)
    n = len(keep)

    def run(batches):
        for batch in batches:
            counts = [pa.array(x, pa.int64()) for x in text_counts(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *counts], names=[*batch.schema.names[:n], *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields[:n])
    return arrow_map(part, run, ", ".join([*([fields] if fields else []), *(f"{c} long" for c in names)]))


def base_failed(p: str = "") -> Column:
    return F.expr(f"{p}n_words < 20 OR 100 * {p}n_repeat_words > 30 * {p}n_words")


def sketches(counts: DataFrame) -> DataFrame:
    """Quantile sketches of each rule's value by language and source, over documents that pass the base rules.

    A sketch is a histogram over a log-linear grid (32 cells a power of two: values are kept to within 1/32), so
    sketches merge by adding counts. Columns: lang, source, rule, cell, n.
    """
    rule = F.array(*(F.struct(F.lit(name).alias("rule"), F.expr(f"cast({value.format(p='')} as bigint)").alias("value")) for name, (value, *_) in RULES.items()))
    values = counts.filter(~base_failed()).select("lang", "source", F.explode(rule).alias("r")).select("lang", "source", "r.rule", "r.value")
    shift = "greatest(length(bin(value)) - 6, 0)"
    cells = values.withColumn("cell", F.expr(f"shiftleft(shiftright(value, {shift}), {shift})"))
    return cells.groupBy("lang", "source", "rule", "cell").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Merged sketches' quantiles (TWENTIETHS) of each group and rule, with the number of documents."""
    from pyspark.sql import Window

    merged = sketch.groupBy(*by, "rule", "cell").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "rule")
    run = merged.select("*", F.sum("n").over(group.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(group).alias("total"))
    return run.groupBy(*by, "rule").agg(*(F.min(F.expr(f"CASE WHEN 20 * upto >= {k} * total THEN cell END")).alias(f"q{k}") for k in TWENTIETHS), F.max("total").alias("total"))


def thresholds(counts: DataFrame) -> DataFrame:
    """For each language and source a row with low and high bounds of every rule; both keys may be null.

    A stored table, so that its size is known when the documents' join with it is planned: while it is small, no text
    is shuffled.
    """
    sketch = sketches(counts)
    fine, lang, every = quantiles(sketch, ["lang", "source"]), quantiles(sketch, ["lang"]), quantiles(sketch, [])
    q = F.struct(*(f"q{k}" for k in TWENTIETHS))
    got = fine.select("lang", "source", "rule", q.alias("own"), F.col("total").alias("own_n"))
    got = got.join(lang.select(F.col("lang").alias("_l"), F.col("rule").alias("_r"), q.alias("of_lang"), F.col("total").alias("lang_n")), F.col("lang").eqNullSafe(F.col("_l")) & (F.col("rule") == F.col("_r"))).drop("_l", "_r")
    got = got.join(every.select(F.col("rule").alias("_r"), q.alias("of_all")), F.col("rule") == F.col("_r")).drop("_r")
    q = F.when(F.col("own_n") >= LEAST_GROUP, F.col("own")).when(F.col("lang_n") >= LEAST_GROUP, F.col("of_lang")).otherwise(F.col("of_all"))
    got = got.select("lang", "source", "rule", q.alias("q"))
    bounds = []
    for name, (_, at, low, least) in RULES.items():
        of, high, middle, below = F.col("rule") == name, F.col(f"q.q{at}"), F.col("q.q10"), F.col(f"q.q{20 - at}") if low else None
        bounds.append(F.max(F.when(of, high + SPREAD * F.greatest(F.lit(least), high - middle))).alias(f"{name}_high"))
        bounds += [F.max(F.when(of, below - SPREAD * F.greatest(F.lit(least), middle - below))).alias(f"{name}_low")] if low else []
    return stored(got.groupBy("lang", "source").agg(*bounds), "bounds")


def judge(counts: DataFrame, bounds: DataFrame, prefix: str = "") -> DataFrame:
    """Adds base_failed, rules_failed (names of failed adaptive rules, comma-joined) and kept, with ``prefix``.

    A language and source without bounds (no document passed the base rules) fails no adaptive rule. The bounds are
    one small row for each group; Spark broadcasts them if the stored size allows and else splits hot groups.
    """
    named = bounds.select(F.col("lang").alias("__b_lang"), F.col("source").alias("__b_source"), *(F.col(c).alias(f"__b_{c}") for c in bounds.columns[2:]))
    joined = counts.join(named, counts["lang"].eqNullSafe(named["__b_lang"]) & counts["source"].eqNullSafe(named["__b_source"]), "left")
    failed = []
    for name, (value, _, low, _) in RULES.items():
        v = f"({value.format(p=prefix)})"
        tests = [f"{v} > __b_{name}_high"] + ([f"{v} < __b_{name}_low"] if low else [])
        failed.append(F.expr(f"CASE WHEN {' OR '.join(tests)} THEN '{name}' END"))
    out = joined.select(*(counts[c] for c in counts.columns), base_failed(prefix).alias(f"{prefix}base_failed"), F.concat_ws(",", *failed).alias(f"{prefix}rules_failed"))
    return out.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & (F.col(f"{prefix}rules_failed") == ""))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Verdict of every document: doc_id, the counts, base_failed, rules_failed, kept.

    Null texts count as empty and fail the base rules; null languages and sources are groups of their own; repeated
    rows are judged alike; a value equal to a bound passes; texts of any length are read whole; extra columns are not
    read; an empty table gives an empty one.
    """
    counts = stored(measured(docs, "doc_id", "lang", "source"), "quality_counts")
    return judge(counts, thresholds(counts)).select("doc_id", *COUNTS, "base_failed", "rules_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that quality_rules() keeps, with all their columns, whatever their names."""
    counts = stored(measured(docs, "lang", "source"), "quality_counts")
    inner, back = guarded(docs, "text", "lang", "source")
    return back(judge(measured(inner, *inner.columns, prefix="__q_"), thresholds(counts), prefix="__q_").filter("__q_kept"))


def _sql() -> str:
    """The same verdicts in DuckDB."""
    values = {n: v.format(p="").replace(" div ", " // ") for n, (v, *_) in RULES.items()}
    rules = " UNION ALL ".join(f"SELECT lang, source, '{n}' AS rule, {v} AS value FROM good" for n, v in values.items())

    def quartiles(name: str, by: str) -> str:
        group = f"{by}, rule" if by else "rule"
        return f"""
{name}_m AS (SELECT {group}, cell, sum(n) AS n FROM sketch GROUP BY ALL),
{name}_u AS (SELECT *, sum(n) OVER (PARTITION BY {group} ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY {group}) AS total FROM {name}_m),
{name} AS (SELECT {group}, {", ".join(f"min(cell) FILTER (20 * upto >= {k} * total) AS q{k}" for k in TWENTIETHS)}, max(total) AS total FROM {name}_u GROUP BY ALL)"""

    pick = ", ".join(f"CASE WHEN f.total >= {LEAST_GROUP} THEN f.q{k} WHEN g.total >= {LEAST_GROUP} THEN g.q{k} ELSE h.q{k} END AS q{k}" for k in TWENTIETHS)
    bounds, tests = [], []
    for n, (_, at, low, least) in RULES.items():
        bounds.append(f"max(q{at} + {SPREAD} * greatest({least}, q{at} - q10)) FILTER (rule = '{n}') AS {n}_high")
        own = [f"{values[n]} > {n}_high"]
        if low:
            bounds.append(f"max(q{20 - at} - {SPREAD} * greatest({least}, q10 - q{20 - at})) FILTER (rule = '{n}') AS {n}_low")
            own.append(f"{values[n]} < {n}_low")
        tests.append(f"CASE WHEN {' OR '.join(own)} THEN '{n}' END")
    leads = ", ".join(f"lead(w, {k}) OVER o" for k in range(1, WINDOW))
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{word}') AS ws, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '{word}')] AS ls FROM d),
u AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS spot1 FROM w),
p AS (SELECT rid, spot1, CASE WHEN lead(w, {WINDOW - 1}) OVER o IS NOT NULL THEN concat_ws(' ', w, {leads}) END AS run FROM u WINDOW o AS (PARTITION BY rid ORDER BY spot1)),
v AS (SELECT rid, spot1, count(*) OVER (PARTITION BY rid, run) AS times FROM p WHERE run IS NOT NULL),
r AS (SELECT rid, count(DISTINCT spot) AS n FROM (SELECT rid, unnest(range(spot1, spot1 + {WINDOW})) AS spot FROM v WHERE times > 1) GROUP BY rid),
c AS (SELECT rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
good AS (SELECT * FROM b WHERE NOT base_failed),
cells AS (SELECT *, greatest(length(bin(value)) - 6, 0)::INT AS k FROM ({rules})),
sketch AS (SELECT lang, source, rule, (value >> k) << k AS cell, count(*) AS n FROM cells GROUP BY ALL),{quartiles("fine", "lang, source")},{quartiles("mid", "lang")},{quartiles("every", "")},
t AS (SELECT f.lang, f.source, f.rule, {pick} FROM fine f JOIN mid g ON g.lang IS NOT DISTINCT FROM f.lang AND g.rule = f.rule JOIN every h ON h.rule = f.rule),
bounds AS (SELECT lang, source, {", ".join(bounds)} FROM t GROUP BY ALL),
o AS (SELECT b.*, concat_ws(',', {", ".join(tests)}) AS rules_failed FROM b LEFT JOIN bounds ON b.lang IS NOT DISTINCT FROM bounds.lang AND b.source IS NOT DISTINCT FROM bounds.source)
SELECT doc_id, {", ".join(COUNTS)}, base_failed, rules_failed, NOT base_failed AND rules_failed = '' AS kept FROM o
"""


SQL = _sql()
