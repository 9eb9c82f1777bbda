"""Mixing sources to target weights: a token budget runs down a domain-language-source tree.

At each node the budget is split among the children by weight. A child whose texts, repeated for at most
``max_epochs`` epochs, cannot fill its share takes what it has, and the shortage goes to its siblings by weight; only
if all of them are full does it go to the node's own siblings. A leaf with b tokens to give takes whole epochs first
and then the prefix of the next epoch, in an order seeded by epoch, whose tokens fit the rest.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import guarded, stored

#: Cells of a leaf's order: this many times the root of its number of documents. Only the cell in which a prefix ends
#: is sorted, and both the cells and the documents of one grow with the root.
CELLS = 1.0


@dataclass(frozen=True)
class Mix:
    """Weights are whole numbers; names that are not listed weigh 1. ``domain`` is a SQL expression over the columns.

    The budget is ``percent`` of all words, or ``tokens`` if given.
    """

    domain: str = "CASE WHEN substr(md5(coalesce(source, '')), 1, 1) < '8' THEN 'web' WHEN substr(md5(coalesce(source, '')), 1, 1) < 'c' THEN 'books' ELSE 'reference' END"
    weights: dict[str, dict[str, int]] = field(default_factory=lambda: {"domain": {"web": 5, "books": 3, "reference": 2}, "lang": {"en": 6, "de": 2, "fr": 2}, "source": {}})
    percent: int = 60
    tokens: int | None = None
    max_epochs: int = 2
    seed: int = 17


LEVELS = ["domain", "lang", "source"]
_KEYS = ["_m_domain", "_m_lang", "_m_source"]


def _weight(level: str, mix: Mix) -> Column:
    out = F.lit(1).cast("long")
    for name, w in mix.weights.get(level, {}).items():
        out = F.when(F.col(f"_m_{level}") == name, F.lit(w).cast("long")).otherwise(out)
    return out


def _prepared(docs: DataFrame, mix: Mix) -> DataFrame:
    """Adds _m_domain, _m_lang, _m_source (nulls as empty names), _m_tokens: the number of words."""
    plain = docs.select("*", F.expr(mix.domain).alias("_m_domain"), F.coalesce(F.col("lang"), F.lit("")).alias("_m_lang"), F.coalesce(F.col("source"), F.lit("")).alias("_m_source"))
    return plain.withColumn("_m_tokens", F.expr(r"coalesce(regexp_count(text, r'[^\x20\x09-\x0D]+'), 0)").cast("long"))


def _fill(nodes: DataFrame, parent: list[str], name: str, weight: Column) -> DataFrame:
    """Splits each parent's ``budget`` among its rows by weight within ``cap``: adds ``given``.

    Rows in order of cap for each unit of weight: those that the remaining level would overfill keep their cap, the
    others share what is left.
    """
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = group.orderBy(F.col("cap") / F.col("w"), F.col(name))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    out = nodes.withColumn("w", weight).withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("ws", F.sum("w").over(after)).withColumn("rank", F.row_number().over(order))
    # products of tokens and weights may pass 64 bits
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    out = out.withColumn("full", wide("cap") * wide("ws") <= wide("left") * wide("w"))
    out = out.withColumn("level", F.min(F.when(~F.col("full"), F.struct("rank", "left", "ws"))).over(group))
    return out.withColumn("given", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("cast(level.left AS decimal(19,0)) * cast(w AS decimal(19,0)) div level.ws"))).drop("w", "left", "ws", "rank", "full", "level")


def budgets(docs: DataFrame, mix: Mix) -> DataFrame:
    """A row for each leaf: _m_domain, _m_lang, _m_source, n_docs, available and given tokens."""
    return _budgets(_prepared(docs, mix), mix)


def _budgets(prepared: DataFrame, mix: Mix) -> DataFrame:
    leaves = stored(prepared.groupBy(*_KEYS).agg(F.count("*").alias("n_docs"), F.sum("_m_tokens").alias("available")), "leaves")
    leaves = leaves.withColumn("cap", F.col("available") * mix.max_epochs)
    total = leaves.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("available")).first()[0]
    budget = mix.tokens if mix.tokens is not None else total * mix.percent // 100
    nodes = [leaves.groupBy(*_KEYS[:k]).agg(F.sum("cap").alias("cap")) for k in (1, 2)] + [leaves]
    top = _fill(nodes[0].withColumn("budget", F.lit(budget).cast("long")), [], _KEYS[0], _weight("domain", mix))
    for k in (1, 2):
        above = top.select(*(F.col(c).alias(f"_up{c}") for c in _KEYS[:k]), F.col("given").alias("budget"))
        match = [F.col(c) == F.col(f"_up{c}") for c in _KEYS[:k]]
        top = _fill(nodes[k].join(above, match).drop(*(f"_up{c}" for c in _KEYS[:k])), _KEYS[:k], _KEYS[k], _weight(LEVELS[k], mix))
    return top.select(*_KEYS, "n_docs", "available", "given")


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``docs`` as chosen, a row for each epoch that has the document, with _m_domain, _m_tokens and _m_epoch.

    Words are counted once for a stored table without texts, from which budgets and cells come, and once more for the
    rows themselves.
    """
    part = _prepared(docs, mix)
    return _chosen(part, _light(part), mix).select(*docs.columns, "_m_domain", "_m_tokens", "_m_epoch")


def _light(prepared: DataFrame) -> DataFrame:
    """Ids, leaves and word counts, without texts, stored."""
    return stored(prepared.select("doc_id", "lang", "source", *_KEYS, "_m_tokens"), "word_counts")


def _ordered(part: DataFrame, rule: DataFrame, mix: Mix) -> DataFrame:
    """Adds the leaf's whole epochs and rest, and each row's place and cell in the epoch that is taken in part."""
    rows = part.join(rule, [F.col(c) == F.col(f"_r{c}") for c in _KEYS]).drop(*(f"_r{c}" for c in _KEYS))
    rows = rows.withColumn("_m_order", F.expr(f"md5(cast(concat_ws(':', '{mix.seed}', _m_whole + 1, coalesce(cast(doc_id AS string), '')) AS binary))"))
    return rows.withColumn("_m_cell", F.expr("cast(conv(substring(_m_order, 1, 8), 16, 10) AS bigint) * _m_cells div 4294967296"))


def _chosen(part: DataFrame, light: DataFrame, mix: Mix) -> DataFrame:
    """Rows of ``part`` by epoch, as budgets and cells over ``light`` say.

    Leaves and cells are small tables, joined as Spark's own size checks allow; texts are shuffled only in the cells
    in which prefixes end. Hot leaves have as many cells as their documents need, so no leaf is ordered in one task.
    """
    plan = stored(_budgets(light, mix), "plan")
    rule = plan.select(*(F.col(c).alias(f"_r{c}") for c in _KEYS), F.expr("CASE WHEN available > 0 THEN given div available ELSE 0 END").alias("_m_whole"), F.expr("CASE WHEN available > 0 THEN given % available ELSE 0 END").alias("_m_rest"), F.ceil(F.sqrt(F.col("n_docs")) * CELLS).alias("_m_cells"))
    leaf = Window.partitionBy(*_KEYS).orderBy("_m_cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = _ordered(light, rule, mix).groupBy(*_KEYS, "_m_cell", "_m_rest").agg(F.sum("_m_tokens").alias("own")).withColumn("upto", F.sum("own").over(leaf))
    state = F.expr("CASE WHEN upto <= _m_rest THEN 1 WHEN upto - own <= _m_rest THEN 2 ELSE 0 END")
    cells = stored(cells.select(*(F.col(c).alias(f"_c{c}") for c in [*_KEYS, "_m_cell"]), state.alias("_m_state"), (F.col("upto") - F.col("own")).alias("_m_before")), "cells")
    rows = _ordered(part, rule, mix).join(cells, [F.col(c) == F.col(f"_c{c}") for c in [*_KEYS, "_m_cell"]]).drop(*(f"_c{c}" for c in [*_KEYS, "_m_cell"]))
    inside = Window.partitionBy(*_KEYS, "_m_cell").orderBy("_m_order", "doc_id", "_m_tokens").rowsBetween(Window.unboundedPreceding, 0)
    part_cell = rows.filter("_m_state = 2").withColumn("_m_sum", F.col("_m_before") + F.sum("_m_tokens").over(inside)).withColumn("_m_state", F.expr("CASE WHEN _m_sum <= _m_rest THEN 1 ELSE 0 END")).drop("_m_sum")
    chosen = rows.filter("_m_state <> 2").unionAll(part_cell)
    chosen = chosen.withColumn("_m_times", F.expr("_m_whole + CASE WHEN _m_rest > 0 THEN _m_state ELSE 0 END")).filter("_m_times > 0")
    return chosen.withColumn("_m_epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m_times"))))


def mix_sources(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epoch: a row for each time that a document is taken.

    Tokens are words (a null text has none). Null languages and sources are leaves with empty names. Ties of the
    seeded order go by doc_id, then tokens; repeated rows count one by one. Extra columns are not read; an empty table
    or a budget of 0 gives an empty one. Documents without words cost nothing and come with whole epochs. Texts of any
    length are read whole, once.
    """
    light = _light(_prepared(docs.select(*(docs[c] for c in ("doc_id", "text", "lang", "source"))), mix))
    out = _chosen(light, light, mix)
    return out.select("doc_id", F.col("_m_domain").alias("domain"), "lang", "source", F.col("_m_tokens").alias("n_tokens"), F.col("_m_epoch").alias("epoch"))


def remix(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The documents as mix_sources() takes them, a row for each epoch, with their columns, whatever their names."""
    inner, back = guarded(docs, "doc_id", "text", "lang", "source")
    return back(mixed(inner, mix))


def sql(mix: Mix = Mix()) -> str:
    """The same result in DuckDB."""

    def weight(level: str) -> str:
        cases = "".join(f" WHEN {level} = '{n}' THEN {w}" for n, w in mix.weights.get(level, {}).items())
        return f"CASE{cases} ELSE 1 END" if cases else "1"

    def fill(name: str, source: str, parent: list[str], child: str) -> str:
        by = f"PARTITION BY {', '.join(parent)}" if parent else ""
        return f"""
{name}_w AS (SELECT *, {weight(child)} AS w FROM {source}),
{name}_o AS (SELECT *, budget - coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
  sum(w) OVER ({by} ORDER BY cap / w, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM {name}_w),
{name}_f AS (SELECT *, cap * ws <= lft * w AS is_full, row_number() OVER ({by} ORDER BY cap / w, {child}) AS rnk FROM {name}_o),
{name}_l AS (SELECT *, min(CASE WHEN NOT is_full THEN rnk END) OVER ({by}) AS lvl FROM {name}_f),
{name}_v AS (SELECT *, max(CASE WHEN rnk = lvl THEN lft END) OVER ({by}) AS l_left, max(CASE WHEN rnk = lvl THEN ws END) OVER ({by}) AS l_ws FROM {name}_l),
{name} AS (SELECT *, CASE WHEN is_full THEN cap ELSE (l_left * w)::BIGINT // l_ws::BIGINT END AS given FROM {name}_v)"""

    total = str(mix.tokens) if mix.tokens is not None else f"(SELECT coalesce(sum(n_tokens), 0)::BIGINT * {mix.percent} // 100 FROM d)"
    return rf"""
WITH d AS (SELECT doc_id, lang AS lang0, source AS source0, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {mix.domain} AS domain,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS available, sum(n_tokens)::BIGINT * {mix.max_epochs} AS cap FROM d GROUP BY ALL),
n1 AS (SELECT domain, sum(cap)::BIGINT AS cap, {total} AS budget FROM leaf GROUP BY domain),{fill("a", "n1", [], "domain")},
n2 AS (SELECT x.domain, x.lang, x.cap, a.given AS budget FROM (SELECT domain, lang, sum(cap)::BIGINT AS cap FROM leaf GROUP BY ALL) x JOIN a USING (domain)),{fill("b", "n2", ["domain"], "lang")},
n3 AS (SELECT leaf.*, b.given AS budget FROM leaf JOIN b USING (domain, lang)),{fill("c", "n3", ["domain", "lang"], "source")},
r AS (SELECT d.*, CASE WHEN available > 0 THEN given // available ELSE 0 END AS whole, CASE WHEN available > 0 THEN given % available ELSE 0 END AS rest FROM d JOIN c USING (domain, lang, source)),
o AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws(':', '{mix.seed}', whole + 1, doc_id)), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM r),
t AS (SELECT *, (whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS times FROM o)
SELECT doc_id, domain, lang0 AS lang, source0 AS source, n_tokens, unnest(range(1, times + 1)) AS epoch FROM t WHERE times > 0
"""
