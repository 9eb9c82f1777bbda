"""Byte-level BPE: batched numpy merge rounds over the symbols of many words in one flat array.

A vocabulary is a tokenizer file of the byte-level kind (its path is a parameter and every worker reads it). Texts
are cut at special tokens and by the file's pre-tokenizing pattern; each distinct word of a batch is encoded once.
In a round every unfinished word merges all places of its lowest-ranked pair; ranks come from a binary search over
sorted pair keys. Words longer than ``LONG`` symbols use a heap, which needs no round for each merge.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_map

#: The pre-tokenizing pattern of byte-level tokenizer files with use_regex.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes that such files write as themselves; the others are written as code points from 256 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Symbols beyond which a word is encoded by the heap: as many rounds as it has merges would each scan all of it.
LONG = 4096
#: Words kept encoded in a worker; the cache starts anew beyond.
CACHE = 120_000
_NONE = np.int64(1) << np.int64(40)


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("only byte-level BPE files without a normalizer are read")
        if spec["pre_tokenizer"].get("add_prefix_space") or any(a[k] for a in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("prefix spaces and added tokens that strip or normalize are not supported")
        rest = iter(range(256, 512))
        printed = set(PRINTED)
        letter = [chr(b) if b in printed else chr(next(rest)) for b in range(256)]
        byte = {c: b for b, c in enumerate(letter)}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        pieces = [b""] * self.size
        for token, i in vocab.items():
            pieces[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.table = np.frombuffer(b"".join(pieces), np.uint8)
        self.place = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.of_byte = np.array([vocab[c] for c in letter], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.byte_rank, self.byte_made = (x.reshape(256, 256) for x in self.find(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256)))
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.written = [str(i) for i in range(self.size)]
        self._ranks: dict | None = None

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens in order; special tokens stand alone, as they are written."""
        if self.split is None or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        out: list[str] = []
        for part in self.split.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out += self.pattern.findall(part)
        return out

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs (_NONE if there is no merge) and what they merge to, by binary search over the pair keys."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], _NONE), self.made[at]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, one after another, and the number of each word's ids."""
        length = np.array([len(w) for w in words], np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in np.flatnonzero(length > LONG):
            own = self._by_heap(words[k])
            parts.append((np.array([k]), np.array([len(own)]), own))
        ids = np.flatnonzero((length > 0) & (length <= LONG))
        if len(ids):
            raw = np.frombuffer(b"".join(w for w in words if 0 < len(w) <= LONG), np.uint8)
            self._rounds(raw, length[ids], ids, parts)
        if not parts:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        who, size, flat = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(who, kind="stable")
        start = (np.cumsum(size) - size)[order]
        sizes = np.zeros(len(words), np.int64)
        sizes[who] = size
        size = size[order]
        return flat[np.arange(len(flat)) + np.repeat(start - (np.cumsum(size) - size), size)], sizes

    def _rounds(self, raw: np.ndarray, sizes: np.ndarray, ids: np.ndarray, parts: list) -> None:
        symbols = self.of_byte[raw]
        owner = np.repeat(np.arange(len(ids)), sizes)
        rank, made = np.full(len(raw), _NONE), np.zeros(len(raw), np.int64)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inside], made[inside] = self.byte_rank[raw[inside], raw[inside + 1]], self.byte_made[raw[inside], raw[inside + 1]]
        while True:
            best = np.minimum.reduceat(rank, np.cumsum(sizes) - sizes)
            over = best == _NONE
            if over.any():
                out = over[owner]
                parts.append((ids[over], sizes[over], symbols[out]))
                keep = ~out
                symbols, rank, made = symbols[keep], rank[keep], made[keep]
                sizes, ids, best = sizes[~over], ids[~over], best[~over]
                if not len(ids):
                    return
                owner = np.repeat(np.arange(len(ids)), sizes)
            # of touching hits (one symbol repeated), every other one from the left
            place = np.flatnonzero(rank == best[owner])
            fresh = np.ones(len(place), bool)
            fresh[1:] = place[1:] != place[:-1] + 1
            count = np.arange(len(place))
            place = place[(count - np.maximum.accumulate(np.where(fresh, count, 0))) % 2 == 0]
            symbols[place] = made[place]
            keep = np.ones(len(symbols), bool)
            keep[place + 1] = False
            sizes = sizes - np.bincount(owner[place], minlength=len(ids))
            symbols, rank, made, owner = symbols[keep], rank[keep], made[keep], owner[keep]
            # only the pairs that touch a merged symbol have changed
            place = place - np.arange(len(place))
            ask = np.concatenate([place, place[place > 0] - 1])
            rank[place] = _NONE
            ask = ask[ask < len(symbols) - 1]
            same = owner[ask] == owner[ask + 1]
            ask = ask[same]
            rank[ask], made[ask] = self.find(symbols[ask], symbols[ask + 1])

    def _by_heap(self, word: bytes) -> np.ndarray:
        if self._ranks is None:
            self._ranks = {int(k): (int(r), int(m)) for k, r, m in zip(self.keys, self.rank, self.made, strict=True)}
        ranks, size = self._ranks, self.size
        s = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, s[i], s[i + 1], r[1]) for i in range(n - 1) if (r := ranks.get(s[i] * size + s[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j >= n or s[j] != b:
                continue
            s[i], s[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if r := ranks.get(made * size + s[after[i]]):
                    heapq.heappush(heap, (r[0], i, made, s[after[i]], r[1]))
            if (h := before[i]) >= 0 and (r := ranks.get(s[h] * size + made)):
                heapq.heappush(heap, (r[0], h, s[h], made, r[1]))
        return np.array([x for x in s if x >= 0], np.int64)

    def decode_many(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of consecutive runs of ids, gathered from the flat table of token bytes in one pass."""
        if not len(ids):
            return [b""] * len(sizes)
        if ids.min() < 0 or ids.max() >= self.size:
            raise ValueError("an id is outside the vocabulary")
        length = self.place[ids + 1] - self.place[ids]
        end = np.cumsum(length)
        flat = np.arange(end[-1]) + np.repeat(self.place[ids] - (end - length), length)
        raw = self.table[flat].tobytes()
        cut = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(sizes)])]
        return [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts with a bounded cache of words: for each its ids, or (digest) their decimal text and decoded bytes."""

    def __init__(self, path: str, digest: bool = False):
        self.vocab, self.cache, self.digest = vocabulary(path), {}, digest

    def words(self, texts: list[str]) -> list[list[str]]:
        """Pre-tokens of each text; all of them are in the cache afterwards."""
        v = self.vocab
        cut = [v.pieces(t) for t in texts]
        new = set().union(*cut).difference(self.cache) if cut else set()
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = set().union(*cut)
        found = [w for w in new if w not in v.special]
        flat, sizes = v.encode_words([w.encode() for w in found])
        own = [w for w in new if w in v.special]
        found += own
        flat, sizes = np.concatenate([flat, np.array([v.special[w] for w in own], np.int64)]), np.concatenate([sizes, np.ones(len(own), np.int64)])
        cut_at = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        if self.digest:
            written = [v.written[i] for i in flat.tolist()]
            for w, a, b, raw in zip(found, cut_at, cut_at[1:], v.decode_many(flat, sizes), strict=False):
                self.cache[w] = (",".join(written[a:b]), raw)
        else:
            raw = flat.astype(np.int32).tobytes()
            for w, a, b in zip(found, cut_at, cut_at[1:], strict=False):
                self.cache[w] = raw[4 * a : 4 * b]
        return cut

    def ids(self, words: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join([self.cache[w] for w in words]), np.int32)


#: Characters of text that are cut into words at once.
_AT_ONCE = 1 << 20


def _groups(texts: list[str | None]):
    """Slices of a batch by size."""
    group: list[str] = []
    size = 0
    for t in texts:
        group.append(t or "")
        size += len(group[-1])
        if size >= _AT_ONCE:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Token ids of every whole text: the columns of ``keep``, n_tokens (long) and ids (array of int).

    A null or empty text has no ids. Special tokens' strings in a text are encoded as those tokens. Repeated rows give
    a row each; other columns are not read; an empty table gives an empty one.
    """
    part = docs.select(*(docs[c] for c in keep), docs["text"].alias("_text"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields[:-1]) + ", n_tokens long, ids array<int>"

    def run(batches):
        coder = Encoder(path)
        for batch in batches:
            lo = 0
            for group in _groups(batch.column(len(keep)).to_pylist()):
                ids = [coder.ids(w) for w in coder.words(group)]
                n = [len(i) for i in ids]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(ids) if ids else [], pa.int32()))
                columns = [batch.column(k).slice(lo, len(group)) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), lists], names=[*keep, "n_tokens", "ids"])
                lo += len(group)

    return arrow_map(part, run, out)


def decode(tokens: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Texts of id arrays (column ids): the columns of ``keep`` and text. Null arrays give empty texts.

    Bytes that are not UTF-8 become replacement characters; an id outside the vocabulary is an error.
    """
    part = tokens.select(*(tokens[c] for c in keep), tokens["ids"].alias("_ids"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields[:-1]) + ", text string"

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            ids = [np.array(x or [], np.int64) for x in batch.column(len(keep)).to_pylist()]
            raw = v.decode_many(np.concatenate([*ids, np.zeros(0, np.int64)]), np.array([len(i) for i in ids], np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())], names=[*keep, "text"])

    return arrow_map(part, run, out)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of encoding and decoding every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256, n_words (pre-tokens).

    Ids and decoded bytes are those of encode() and decode(), joined from the words' own; nothing but digests leaves
    the worker. Nulls, repeats and empty tables as in encode().
    """
    part = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])

    def run(batches):
        coder = Encoder(path, digest=True)
        for batch in batches:
            lo = 0
            for group in _groups(batch.column(1).to_pylist()):
                rows = []
                for words in coder.words(group):
                    found = [coder.cache[w] for w in words]
                    text = ",".join([f[0] for f in found])
                    plain = b"".join([f[1] for f in found]).decode("utf-8", "replace")
                    rows.append((text.count(",") + 1 if text else 0, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest(), len(words)))
                a, b, c, d = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(group)), pa.array(a, pa.int64()), pa.array(b), pa.array(c), pa.array(d, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_words"])
                lo += len(group)

    return arrow_map(part, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_words long")
