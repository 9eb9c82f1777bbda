"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise interactions of
low rank in time linear in the number of features. Statistics and the character count are one-hot cells between
quantiles of the training sample; words are hashed, with x = the root of their share of the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp
from .common import arrow_map, label_sample, remainder
from .quality_rules import text_counts

BITS, RANK, CELLS = 16, 8, 8
#: At most so many labelled documents are fitted (the bound of the training sample).
SAMPLE = 8000
DIVISOR, HELD_OUT = 3, 1
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?;:,.-_=+/@\"'()[]{}"]] = True
STATS = ["n_words", "word_length", "symbols", "dup_lines", "repeats", "line_length", "upper", "digits", "marks", "distinct", "n_chars"]


@dataclass
class Model:
    edges: np.ndarray  # statistics x (CELLS - 1)
    bias: float
    w: np.ndarray
    v: np.ndarray


def raw_features(column: pa.Array, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Statistics (texts x STATS); and of distinct hashed words: text, word and x."""
    n_words, chars, symbols, dup, repeats, lines = (x.astype(float) for x in text_counts(column))
    more, docs, words, xs = [], [], [], []
    for c in textnp.chunks(column):
        c.words()
        c.prefix(lower=True)
        word = (c.hashes(c.start, c.end) >> np.uint64(64 - BITS)).astype(np.int64)
        key, n = np.unique((np.repeat(np.arange(c.n), c.count) << BITS) | word, return_counts=True)
        doc = key >> BITS
        distinct = np.bincount(doc, minlength=c.n)
        more.append(np.stack([c.totals(_UPPER[c.buf]), c.totals(_DIGIT[c.buf]), c.totals(_MARK[c.buf]), distinct]).astype(float))
        docs.append(doc + c.lo)
        words.append(key & ((1 << BITS) - 1))
        xs.append(np.sqrt(n / np.maximum(c.count, 1)[doc]))
    upper, digits, marks, distinct = np.concatenate(more, axis=1) if more else np.zeros((4, 0))
    some, few = np.maximum(n_words, 1), np.maximum(chars, 1)
    stats = np.stack([n_words, chars / some, symbols / few, dup / np.maximum(lines, 1), repeats / some, n_words / np.maximum(lines, 1), upper / few, digits / few, marks / few, distinct / some, n_chars], axis=1)
    return stats, *((np.concatenate(x) for x in (docs, words, xs)) if docs else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)))


def cells(stats: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Feature number of each text's cell of each statistic; a missing value has a cell of its own."""
    out = np.empty(stats.shape, np.int64)
    for k in range(stats.shape[1]):
        at = np.searchsorted(edges[k], stats[:, k], "right")
        at[np.isnan(stats[:, k])] = CELLS
        out[:, k] = (1 << BITS) + k * (CELLS + 1) + at
    return out


def _flat(stats, doc, word, x, edges):
    own = cells(stats, edges)
    who = np.concatenate([doc, np.repeat(np.arange(len(stats)), own.shape[1])])
    what, value = np.concatenate([word, own.ravel()]), np.concatenate([x, np.full(own.size, 1 / np.sqrt(own.shape[1]))])
    order = np.argsort(who, kind="stable")
    return who[order], what[order], value[order]


def margin(who: np.ndarray, what: np.ndarray, x: np.ndarray, n: int, bias: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margins by the sum-of-squares identity, and the inner sums. ``who`` is sorted and has every text."""
    first = np.searchsorted(who, np.arange(n))
    part = v[what] * x[:, None]
    sums = np.add.reduceat(part, first, axis=0)
    squares = np.add.reduceat((part * part).sum(axis=1), first)
    return bias + np.add.reduceat(w[what] * x, first) + 0.5 * ((sums * sums).sum(axis=1) - squares), sums


#: A tenth of the sample tells when to stop, from this many texts on; fitting ends after PATIENCE epochs without gain.
LEAST_TO_STOP, PATIENCE = 500, 3


def fit(column: pa.Array, n_chars: np.ndarray, labels: np.ndarray, epochs: int = 30, batch: int = 512, rate: float = 0.05, seed: int = 7) -> Model:
    """Adagrad over the factorisation machine. A tenth of the texts are kept back and the best epoch on them counts."""
    stats, doc, word, x = raw_features(column, n_chars)
    size = (1 << BITS) + len(STATS) * (CELLS + 1)
    with np.errstate(all="ignore"):
        edges = np.stack([np.quantile(s[~np.isnan(s)], np.arange(1, CELLS) / CELLS) if (~np.isnan(s)).any() else np.zeros(CELLS - 1) for s in stats.T])
        # the outer quantiles too: rare junk lies beyond the usual ones
        for k, s in enumerate(stats.T):
            known = s[~np.isnan(s)]
            if len(known):
                edges[k, [0, 1, -2, -1]] = np.quantile(known, [0.02, 0.07, 0.93, 0.98])
                edges[k] = np.sort(edges[k])
    rng = np.random.default_rng(seed)
    w, v = np.zeros(size), rng.normal(0, 0.02, (size, RANK))
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias = float(np.log(share / (1 - share)))
    if len(np.unique(labels)) < 2:
        return Model(edges, bias, w.astype(np.float32), np.zeros((size, RANK), np.float32))
    who, what, x = _flat(stats, doc, word, x, edges)
    off = np.searchsorted(who, np.arange(len(labels) + 1))
    l2 = np.where(np.arange(size) < (1 << BITS), 3e-3, 3e-5)
    gw, gv, gb = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    back = rng.permutation(len(labels))[: len(labels) // 10] if len(labels) >= LEAST_TO_STOP else np.zeros(0, np.int64)
    used_rows = np.setdiff1d(np.arange(len(labels)), back)

    def rows_of(part):
        n = off[part + 1] - off[part]
        at = np.arange(n.sum()) + np.repeat(off[part] - (np.cumsum(n) - n), n)
        return np.repeat(np.arange(len(part)), n), what[at], x[at]

    best, best_loss, waited = None, np.inf, 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(used_rows), max(1, len(used_rows) // batch)):
            d, f, value = rows_of(part)
            m, sums = margin(d, f, value, len(part), bias, w, v)
            err = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - labels[part]) / len(part)
            used, inv = np.unique(f, return_inverse=True)
            push = err[d] * value
            dw = np.bincount(inv, push, minlength=len(used)) + l2[used] * w[used] / len(part)
            own = v[f]
            each = push[:, None] * (sums[d] - own * value[:, None])
            dv = np.stack([np.bincount(inv, each[:, k], minlength=len(used)) for k in range(RANK)], axis=1) + l2[used, None] * v[used] / len(part)
            gw[used] += dw * dw
            gv[used] += dv * dv
            w[used] -= rate * 4 * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
            gb += err.sum() ** 2
            bias -= rate * err.sum() / np.sqrt(gb)
        if len(back):
            m, _ = margin(*rows_of(back), len(back), bias, w, v)
            loss = float(np.logaddexp(0, np.where(labels[back] > 0, -m, m)).mean())
            if loss < best_loss - 1e-5:
                best, best_loss, waited = (float(bias), w.copy(), v.copy()), loss, 0
            elif (waited := waited + 1) >= PATIENCE:
                break
    bias, w, v = best or (float(bias), w, v)
    return Model(edges, float(bias), w.astype(np.float32), v.astype(np.float32))


def score_texts(column: pa.Array, n_chars: np.ndarray, model: Model) -> np.ndarray:
    if not len(column):
        return np.zeros(0)
    who, what, x = _flat(*raw_features(column, n_chars), model.edges)
    m, _ = margin(who, what, x.astype(np.float32), len(column), model.bias, model.w, model.v)
    return 1 / (1 + np.exp(-np.clip(m.astype(float), -30, 30)))


def _length(docs: DataFrame):
    return docs["n_chars"].cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits at most ``sample`` labelled documents outside the held-out fold, on the driver.

    Inputs are the text and n_chars (metadata; null has a cell of its own), never labels, lang, source or doc_id.
    """
    rows = label_sample(docs, labels, "quality", DIVISOR, HELD_OUT, sample, n_chars=_length(docs))
    if not len(rows):
        size = (1 << BITS) + len(STATS) * (CELLS + 1)
        return Model(np.zeros((len(STATS), CELLS - 1)), 0.0, np.zeros(size, np.float32), np.zeros((size, RANK), np.float32))
    return fit(pa.array(rows["text"], pa.large_string()), rows["n_chars"].to_numpy(float), rows["label"].to_numpy())


#: Bytes of text whose features are held at once.
_AT_ONCE = 1 << 22


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every whole text, however long. Null texts count as empty and are scored by their statistics.

    Repeated rows score alike; null ids stay null; extra columns are not read; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            length = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            sizes = np.cumsum([len(t or "") for t in batch.column(1).to_pylist()])
            lo = 0
            while lo < len(sizes):
                done = sizes[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(sizes, done + _AT_ONCE)))
                s = score_texts(batch.column(1).slice(lo, hi - lo), length[lo:hi], shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])
                lo = hi

    part = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], _length(docs).alias("n_chars"))
    return arrow_map(part, run, "doc_id long, score double, predicted int")


def quality_classifier(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """train() and score(): doc_id, held_out, score, predicted."""
    out = score(docs, train(docs, labels, sample))
    return out.select("doc_id", (remainder(F.col("doc_id"), DIVISOR) == HELD_OUT).alias("held_out"), "score", "predicted")
