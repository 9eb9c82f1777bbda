"""Personal data: base patterns, and bootstrapped contextual extraction of identifiers that they miss.

The base patterns' spans are seeds. The lexical patterns of a span are the word and the two words before and after it,
and the pair of words around it with the number of words that it has between them. Every other identifier-like span
(loosened base shapes: numbers in several parts of up to six digits, dotted or colon-joined addresses, spelt-out or
dotless e-mail addresses, tokens of three digits or more and any length) that stands in such a context is an unlabelled instance. Spark scores the
graph of patterns and instances in rounds. In each, the patterns with SUPPORT mentions of seeds or of instances that
were discovered before count: a pattern's confidence in a kind is the score of its instances over its uses in the whole
corpus, where an unlabelled instance counts no more than its score (it may well be of the kind) but every other word
counts; an instance's score is the noisy-or of its patterns, and it is discovered if one of them is confident.
Instances of the last round's confident patterns are added as spans of that kind if they have its shape; base spans
always stay. Contexts never reach over the border of a text, so the result does not depend on how rows are dealt out.

Two passes over the texts: one finds base spans, instances and their contexts, one counts the uses of the patterns.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp
from .common import FILTER_BITS, arrow_map, stored

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring; the least confidence and number of seeded mentions of a pattern that discovers.
ROUNDS, CONFIDENT, SUPPORT = 3, 0.8, 5

_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that fails from its start fails from within it: the look-behind spares the attempts
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = re.compile(r"[\x20(\[]at[\x20)\]]", re.I)
_TOKEN = re.compile(r"(?<![A-Za-z0-9-])[A-Za-z0-9][A-Za-z0-9-]{5,}+")
# numbers in parts of up to six digits, with one separator each
_PARTS = re.compile(r"(?<![A-Za-z0-9])[+(]?[0-9]{1,6}+(?![0-9])(?:(?:\x20?\(|\)\x20?|[\x20.-])[0-9]{1,6}+(?![A-Za-z0-9]))+")
_COLONS = re.compile(r"(?<![A-Za-z0-9:])[0-9A-Fa-f]{0,4}+(?::[0-9A-Fa-f]{0,4}+){2,7}(?![A-Za-z0-9:])")
_NAME = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++"
_MAIL = re.compile(_NAME + r"(?:\x20?(?:@|[(\[]at[)\]])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]++)*|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)+)", re.I)
#: Most words between the two of a context around a span.
SLOTS = 6
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str):
    """Leftmost non-overlapping matches of the e-mail pattern, found from each @ (long runs are not rescanned)."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _HOST.match(text, at)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1  # no local part reaches over an @
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, kind number, end of each base span, in order of start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
                    out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _text_key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


def loose_spans(text: str, spans) -> list[tuple[int, int, int]]:
    """start, end, shape of identifier-like spans that overlap neither base spans nor each other.

    Shapes: -1 digits (a card, phone or dotted address), -2 an e-mail address, -3 an address joined by colons, -4 a token
    with letters (a masked card or phone number).
    """
    taken, out = bytearray(len(text)), []
    for a, _, b in spans:
        taken[a:b] = b"\1" * (b - a)

    def add(a, b, shape):
        if taken.find(1, a, b) < 0:
            taken[a:b] = b"\1" * (b - a)
            out.append((a, b, shape))

    if "@" in text or _AT.search(text):
        for m in _MAIL.finditer(text):
            add(*m.span(), -2)
    if _DIGIT.search(text):
        for m in _PARTS.finditer(text):
            if 7 <= (n := len(_DIGIT.findall(m.group()))) <= 19 or n >= 4 and m.group().count(".") == 3:
                add(*m.span(), -1)
        if ":" in text:
            for m in _COLONS.finditer(text):
                if len(m.group().replace(":", "")) >= 3:
                    add(*m.span(), -3)
        for m in _TOKEN.finditer(text):
            token = m.group().rstrip("-")
            if len(_DIGIT.findall(token)) >= 3:
                add(m.start(), m.start() + len(token), -1 if token.replace("-", "").isdigit() else -4)
    return out


def _contexts(c: textnp.Chunk) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """64-bit hashes of each word, each two neighbouring words, each two with k = 1 to SLOTS words between, by first word;
    and of each kind whether all its words are of one text."""
    c.words(_LETTER)
    c.prefix(lower=True)
    word = c.hashes(c.start, c.end)
    slots = [textnp.mix(textnp.windows(word[: len(word) - k - 1], 1) + word[k + 1 :] + np.uint64(k)) if len(word) > k + 1 else word[:0] for k in range(1, SLOTS + 1)]
    owner = np.repeat(np.arange(c.n), c.count)
    found = [word, textnp.windows(word, 2), *slots]
    return [x.view(np.int64) for x in found], [owner[: len(x)] == owner[len(owner) - len(x) :] for x in found]


def _mentions(text: str, base: list[tuple[int, int, int]], key: int) -> list[dict]:
    """Seeds (kind) and identifier-like spans (their shape as kind) of a text with their contexts."""
    spans = [(a, b, k) for a, k, b in base] + loose_spans(text, base)
    if not spans:
        return []
    (c,) = textnp.chunks(pa.array([text], pa.large_string()))
    (word, pair, *slots), _ = _contexts(c)
    points = np.append(np.flatnonzero(textnp.IS_HEAD[c.buf]), len(c.buf))  # byte of each code point
    out = []
    for a, b, k in spans:
        # the last word that ends before the span; the first that starts after it
        left = int(np.searchsorted(c.end, points[a], "right")) - 1
        right = int(np.searchsorted(c.start, points[b], "left"))
        found = [int(word[left])] if left >= 0 else []
        found += [int(pair[left - 1])] if left >= 1 else []
        found += [int(word[right]) ^ 1] if right < len(word) else []
        found += [int(pair[right]) ^ 1] if right < len(pair) else []
        found += [int(slots[right - left - 2][left])] if left >= 0 and right < len(word) and 1 <= right - left - 1 <= SLOTS else []
        out.append({"kind": k, "at": a, "to": b, "instance": _text_key(text[a:b]), "contexts": found})
    return out


_MENTION = pa.struct([("kind", pa.int32()), ("at", pa.int64()), ("to", pa.int64()), ("instance", pa.int64()), ("contexts", pa.list_(pa.int64()))])


def _scanned(docs: DataFrame) -> DataFrame:
    """doc_id, a key of the text, base counts, digest and spans, and mentions (array) of every text."""

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                rows = []
                for text in batch.column(1).slice(lo, 1024).to_pylist():
                    text = text or ""
                    base, key = base_spans(text), _text_key(text)
                    joined = _joined(base)
                    some = _mentions(text, base, key) if _DIGIT.search(text) or "@" in text or _AT.search(text) else []
                    rows.append((key, *(sum(k == n for _, k, _ in base) for n in range(4)), hashlib.sha256(joined.encode()).hexdigest(), joined, some))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(_MENTION)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 1024), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "key", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "mentions"])

    return arrow_map(docs, run, "doc_id long, key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, mentions array<struct<kind: int, at: long, to: long, instance: long, contexts: array<long>>>")


def _uses(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, uses: how often each pattern's words stand so in all texts.

    Workers look contexts up in a bitmap of the patterns (8 MiB, whatever their number) and count only those; others that
    merely share a bit are dropped by the join with the patterns.
    """
    slot = F.pmod(F.shiftright("pattern", 1), F.lit(FILTER_BITS))
    pages = patterns.select(F.floor(slot / 32768).cast("int").alias("page"), (slot % 32768).alias("bit")).groupBy("page").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).collect()  # at most 2,048 rows of 4 KiB
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for page in pages:
        bits[page["page"] * 4096 : (page["page"] + 1) * 4096] = np.frombuffer(page["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        table = shared.value
        for batch in batches:
            found = []
            for c in textnp.chunks(batch.column(1)):
                for pair, whole in zip(*_contexts(c), strict=True):
                    pair = pair[whole]
                    at = (pair >> 1) % FILTER_BITS
                    found.append(pair[(table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0])
            value, n = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n.astype(np.int64))], names=["pair", "n"])

    counted = arrow_map(docs, run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # a word or pair as context before is its hash, as context after its hash with the last bit turned
    both = counted.select(F.explode(F.array("pair", F.col("pair").bitwiseXOR(F.lit(1)))).alias("_p"), "n").groupBy("_p").agg(F.sum("n").alias("n"))
    return patterns.join(both, F.col("pattern") == F.col("_p")).select("pattern", F.col("n").alias("uses"))


def discover(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """doc_id, key, kind, at, to of the spans that confident patterns add, from what _scanned() found in ``docs``."""
    mentions = scanned.select("doc_id", "key", F.explode("mentions").alias("m")).select("doc_id", "key", "m.*")
    edges = mentions.select("key", "at", "instance", "kind", F.explode("contexts").alias("pattern"))
    # what may have SUPPORT in some round; copies of one text mention a span once
    often = stored(edges.groupBy("pattern").agg(F.countDistinct("key", "at").alias("support")).filter(F.col("support") >= SUPPORT).select("pattern"), "patterns")
    if mentions.filter("kind >= 0").isEmpty() or often.isEmpty():
        return mentions.limit(0).select("doc_id", "key", "kind", "at", "to")
    uses = stored(_uses(docs, often), "uses")
    # distinct edges of the graph, with how often each occurs and in how many mentions
    once = edges.groupBy("pattern", "instance", "kind", "key", "at").agg(F.count("*").alias("n"))
    once = once.groupBy("pattern", "instance", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("mentions"))
    graph = stored(once.join(uses.withColumnRenamed("pattern", "_p"), F.col("pattern") == F.col("_p")).drop("_p"), "graph")
    shape = F.expr("CASE kind WHEN -1 THEN as_kind <> 0 WHEN -2 THEN as_kind = 0 WHEN -3 THEN as_kind = 1 ELSE as_kind > 1 END")
    plain = graph.groupBy("pattern").agg((F.max("uses") - F.sum(F.when(F.col("kind") < 0, F.col("n")).otherwise(0))).alias("others"))
    plain = stored(plain.withColumnRenamed("pattern", "_q"), "others")
    seeds = graph.filter("kind >= 0").select(F.col("instance").alias("_i"), F.col("kind").alias("as_kind")).distinct().withColumn("score", F.lit(1.0)).withColumn("sure", F.lit(True))
    scores = seeds
    for turn in range(ROUNDS):
        held = graph.join(scores, F.col("instance") == F.col("_i")).filter((F.col("kind") == F.col("as_kind")) | (F.col("kind") < 0) & shape)
        got = F.col("n") * F.col("score")
        sums = held.groupBy("pattern", "as_kind").agg(F.sum(F.when(F.col("sure"), F.col("mentions")).otherwise(0)).alias("support"), F.sum(got).alias("sum"), F.sum(F.when(F.col("kind") < 0, got).otherwise(0.0)).alias("guessed"), F.sum(F.when(F.col("kind") >= 0, F.col("n")).otherwise(0)).alias("seeds"))
        sums = sums.filter(F.col("support") >= SUPPORT)
        patterns = sums.join(plain, F.col("pattern") == F.col("_q")).select(F.col("pattern").alias("_p"), "as_kind", F.round(F.col("sum") / (F.greatest("others", "seeds") + F.col("guessed")), 9).alias("confidence"))
        if turn < ROUNDS - 1:
            fresh = graph.filter("kind < 0").join(patterns, F.col("pattern") == F.col("_p")).filter(shape).groupBy(F.col("instance").alias("_i"), "as_kind")
            fresh = fresh.agg(F.round(1 - F.exp(F.sum(F.log(1 - F.least(F.lit(0.999), F.col("confidence"))))), 9).alias("score"), (F.max("confidence") >= CONFIDENT).alias("sure"))
            # a seed that also stands where no base span is keeps its own score
            fresh = fresh.join(seeds.select(F.col("_i").alias("_s"), F.col("as_kind").alias("_k")), (F.col("_i") == F.col("_s")) & (F.col("as_kind") == F.col("_k")), "left_anti")
            scores = stored(seeds.unionAll(fresh), f"scores{turn}")
    sure = stored(patterns.filter(F.col("confidence") >= CONFIDENT), "confident")
    loose = mentions.filter("kind < 0").select("doc_id", "key", "kind", "at", "to", F.explode("contexts").alias("pattern"))
    found = loose.join(sure, F.col("pattern") == F.col("_p")).filter(shape).groupBy("doc_id", "key", "at", "to").agg(F.max_by("as_kind", F.struct("confidence", -F.col("as_kind"))).alias("kind"))
    return stored(found.select("doc_id", "key", "kind", "at", "to"), "discovered")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (all, with those that patterns discover).

    A null text counts as empty; texts of any length are read whole. Rows with one doc_id and text share their added
    spans, and copies of one text support a pattern once; null ids work like others; of two kinds with the same
    confidence the first in KINDS wins; extra columns are not read; an empty table gives an empty one.
    """
    part = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    bases = stored(_scanned(part), "scanned")
    own = F.struct(F.col("at"), F.col("kind"), F.col("to"))
    more = discover(part, bases).groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_key")).agg(F.collect_set(own).alias("_more"))
    out = bases.join(more, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_key")), "left")
    names = "array('" + "','".join(KINDS) + "')"
    parsed = f"transform(filter(split(base, ','), s -> s <> ''), s -> named_struct('at', cast(split_part(s, ':', 2) AS bigint), 'kind', cast(array_position({names}, split_part(s, ':', 1)) - 1 AS int), 'to', cast(split_part(s, ':', 3) AS bigint)))"
    spans = F.expr(f"CASE WHEN _more IS NULL THEN base ELSE array_join(transform(array_sort(concat({parsed}, _more)), s -> concat(get({names}, s.kind), ':', s.at, ':', s.to)), ',') END")
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", spans.alias("spans"))
