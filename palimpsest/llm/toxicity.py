"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels.

A sentence is toxic with probability sigmoid(bias + sum of its distinct features' weights), features being hashed
words and the beginnings of words, which inflected forms share; a document with probability
1 - prod(1 - p). Only document labels are known; the likelihood's gradient says which sentences carry them. The
weights then score any text and locate its offending sentences.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp
from .common import arrow_map, label_sample, remainder

#: Hashed features; the model has this many weights whatever the corpus.
BITS = 20
#: Lengths in bytes of the beginnings of longer words that are features besides the word.
STEMS = (4, 5, 6, 7, 8)
#: At most so many labelled documents are fitted (the bound of the training sample).
SAMPLE = 8000
DIVISOR, HELD_OUT = 5, 0
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def instances(c: textnp.Chunk, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's sentences with words: document, then of their distinct (wanted) features: sentence and feature.

    Also sets c.sentence_start and c.sentence_end, the bytes of each sentence's first and last words.
    """
    c.words(_LETTER)
    c.prefix(lower=True, fold=True)
    if not len(c.start):
        c.sentence_start = c.sentence_end = np.zeros(0, np.int64)
        return (np.zeros(0, np.int64),) * 3
    doc = np.repeat(np.arange(c.n), c.count)
    stops = np.cumsum(_STOP[c.buf])[c.start] + doc  # differs between sentences, and grows
    head = np.flatnonzero(np.diff(stops, prepend=-1))
    sentence = np.cumsum(np.diff(stops, prepend=stops[0]) > 0)
    c.sentence_start = c.start[head]
    c.sentence_end = c.end[np.append(head[1:], len(stops)) - 1]
    down, size, keys = np.uint64(64 - BITS), c.end - c.start, []
    for stem in (0, *STEMS):
        at = np.flatnonzero(size > stem)
        end = c.start[at] + stem if stem else c.end[at]
        code = c.hashes(c.start[at], end)
        feature = ((code if stem else textnp.mix(code + np.uint64(1))) >> down).astype(np.int64)
        if wanted is not None:
            hit = wanted[feature]
            at, feature = at[hit], feature[hit]
        keys.append((sentence[at].astype(np.int64) << BITS) | feature)
    key = np.unique(np.concatenate(keys))
    return doc[head], key >> BITS, key & ((1 << BITS) - 1)


def _instances(texts: list[str], wanted: np.ndarray | None):
    """Document, sentence (of this part) and feature, part by part, with the number of sentences before."""
    n_docs = n_sent = 0
    for c in textnp.chunks(pa.array(texts, pa.large_string())):
        d, s, f = instances(c, wanted)
        yield d + n_docs, s, f, n_sent
        n_docs, n_sent = n_docs + c.n, n_sent + len(d)


def fit(texts: list[str], labels: np.ndarray, rounds: int = 800, rate: float = 0.3, l1: float = 1e-4, start: float = 0.5, least_docs: int = 3, lift: float = 3.0) -> Model:
    """Weights from document labels by full-batch Adagrad with a proximal l1 step, so that few features carry weight.

    Features are screened first: at least ``least_docs`` toxic documents have one, and their share among its documents
    is ``lift`` times the share among all. Rounds and l1 have the least log loss in a cross-validation inside the
    training folds.
    """
    size, y = 1 << BITS, labels.astype(float)
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.01
    flat = Model(np.zeros(size, np.float32), float(np.log(share / (1 - share))) - 3.0)
    if len(np.unique(labels)) < 2:
        return flat
    seen, toxic = np.zeros(size), np.zeros(size)
    for doc, sent, feature, _ in _instances(texts, None):
        pair = np.unique(doc[sent] * size + feature)
        seen += np.bincount(pair % size, minlength=size)
        toxic += np.bincount(pair % size, y[pair // size], minlength=size)
    wanted = (toxic >= least_docs) & (toxic > lift * share * seen)
    parts = [(d, s + before, f) for d, s, f, before in _instances(texts, wanted)]
    doc, sent, feature = (np.concatenate(x) for x in zip(*parts, strict=True))
    n_docs = len(texts)
    if not len(feature):
        return flat
    # sentences without a feature all have the bias alone: their number is enough
    some, sent = np.unique(sent, return_inverse=True)
    plain = np.bincount(doc, minlength=n_docs)
    doc = doc[some]
    plain = plain - np.bincount(doc, minlength=n_docs)
    used, feature = np.unique(feature, return_inverse=True)
    # words that explain the same documents keep their share: start from each one's own odds, over its features in a word
    odds = np.log((toxic + 0.5) / (seen - toxic + 0.5) * (1 - share) / share)[used]
    w, b = start * odds, -5.0
    total = np.full(len(used) + 1, 1e-8)
    for _ in range(rounds):
        s = b + np.bincount(sent, w[feature], minlength=len(some))
        p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        a = np.bincount(doc, np.logaddexp(0, s), minlength=n_docs) + plain * np.logaddexp(0, b)
        pull = np.where(y > 0, -1 / np.expm1(np.clip(a, 1e-6, 50)), 1.0)
        g = pull[doc] * p / len(y)
        rest = (pull * plain).sum() / (1 + np.exp(-b)) / len(y)
        grad = np.append(np.bincount(feature, g[sent], minlength=len(used)), g.sum() + rest)
        total += grad * grad
        pace = rate / np.sqrt(total)
        w, b = w - pace[:-1] * grad[:-1], b - pace[-1] * grad[-1] * 0.3
        w = np.sign(w) * np.maximum(np.abs(w) - pace[:-1] * l1, 0)
    weights = np.zeros(size, np.float32)
    weights[used] = w
    return Model(weights, float(b))


def score_texts(column: pa.Array, model: Model) -> tuple[np.ndarray, list[str]]:
    """Score of each text, and its offending sentences (p >= 0.5) as start:end in code points, comma-joined."""
    scores, spans, wanted = [], [], model.weights != 0
    for c in textnp.chunks(column):
        doc, sent, feature = instances(c, wanted)
        s = model.bias + np.bincount(sent, model.weights[feature].astype(float), minlength=len(doc))
        clean = np.bincount(doc, np.logaddexp(0, s), minlength=c.n)
        scores.append(-np.expm1(-clean))
        found: list[list[str]] = [[] for _ in range(c.n)]
        bad = np.flatnonzero(s >= 0)
        if len(bad):
            points = np.concatenate([[0], np.cumsum(textnp.IS_HEAD[c.buf])])
            for k in bad:
                zero = points[c.off[doc[k]]]
                found[doc[k]].append(f"{points[c.sentence_start[k]] - zero}:{points[c.sentence_end[k]] - zero}")
        spans += [",".join(f) for f in found]
    return (np.concatenate(scores) if scores else np.zeros(0)), spans


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits at most ``sample`` labelled documents outside the held-out fold, on the driver. No labels: a flat model."""
    rows = label_sample(docs, labels, "toxic", DIVISOR, HELD_OUT, sample)
    return fit(rows["text"].tolist(), rows["label"].to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, offending (spans of toxic sentences) of every whole text, however long.

    Texts that are null, empty or without words score 0. Repeated rows score alike; null ids stay null; extra columns
    are not read; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            scores, spans = score_texts(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spans, pa.string())], names=["doc_id", "score", "predicted", "offending"])

    return arrow_map(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), run, "doc_id long, score double, predicted int, offending string")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """train() and score(): doc_id, held_out, score, predicted, offending."""
    out = score(docs, train(docs, labels, sample))
    return out.select("doc_id", (remainder(F.col("doc_id"), DIVISOR) == HELD_OUT).alias("held_out"), "score", "predicted", "offending")
