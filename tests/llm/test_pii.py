"""Added spans of personal data against a brute-force form, on several layouts of the rows, and on planted identifiers."""

import collections
import random
import re

import pytest

from palimpsest.llm import pii

SHAPES = {-1: (1, 2, 3), -2: (0,), -3: (1,), -4: (2, 3)}


def contexts(text, a, b):
    words = [(m.start(), m.end(), m.group().translate({c: c + 32 for c in range(65, 91)})) for m in re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", text)]
    before, after = [w for w in words if w[1] <= a], [w for w in words if w[0] >= b]
    out = [("word", "before", before[-1][2])] if before else []
    out += [("pair", "before", before[-2][2], before[-1][2])] if len(before) > 1 else []
    out += [("word", "after", after[0][2])] if after else []
    out += [("pair", "after", after[0][2], after[1][2])] if len(after) > 1 else []
    between = len(words) - len(before) - len(after)
    if before and after and 1 <= between <= pii.SLOTS:
        out.append(("frame", between, before[-1][2], after[0][2]))
    return out


def uses_of(texts):
    n = collections.Counter()
    for text in texts:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall("[0-9A-Za-z\x80-\U0010ffff]+", text)]
        for side in ("before", "after"):
            n.update(("word", side, x) for x in w)
            n.update(("pair", side, x, y) for x, y in zip(w, w[1:], strict=False))
        for k in range(1, pii.SLOTS + 1):
            n.update(("frame", k, w[i], w[i + k + 1]) for i in range(len(w) - k - 1))
    return n


def added(texts):
    """Spans (text, start, kind, end) that the patterns add."""
    mentions = [(t, a, b, k, c) for t in texts for a, b, k in [(a, b, k) for a, k, b in pii.base_spans(t)] + pii.loose_spans(t, pii.base_spans(t)) for c in [contexts(t, a, b)]]
    places = collections.defaultdict(set)
    for t, a, _, _, c in mentions:
        for p in c:
            places[p].add((t, a))
    often = {p for p, s in places.items() if len(s) >= pii.SUPPORT}
    uses, n, own = uses_of(texts), collections.Counter(), collections.defaultdict(set)
    for t, a, b, k, c in mentions:
        for p in c:
            if p in often:
                n[p, t[a:b], k] += 1
                own[p, t[a:b], k].add((t, a))
    others = {p: uses[p] - sum(x for (q, _, k), x in n.items() if q == p and k < 0) for p in often}
    seeds = {(t[a:b], k): (1.0, True) for t, a, b, k, c in mentions if k >= 0 and set(c) & often}
    scores = dict(seeds)
    for turn in range(pii.ROUNDS):
        got = collections.defaultdict(lambda: [0, 0.0, 0.0, 0])
        for (p, i, k), x in n.items():
            for kind in (k,) if k >= 0 else SHAPES[k]:
                if (i, kind) in scores:
                    score, sure = scores[i, kind]
                    g = got[p, kind]
                    g[0] += len(own[p, i, k]) if sure else 0
                    g[1] += x * score
                    g[2] += x * score if k < 0 else 0
                    g[3] += x if k >= 0 else 0
        sure = {pk: round(g[1] / (max(others[pk[0]], g[3]) + g[2]), 9) for pk, g in got.items() if g[0] >= pii.SUPPORT}
        if turn < pii.ROUNDS - 1:
            fresh = collections.defaultdict(dict)
            for p, i, k in n:
                for kind in SHAPES.get(k, ()):
                    if (p, kind) in sure and (i, kind) not in seeds:
                        fresh[i, kind][p, k] = sure[p, kind]
            scores = dict(seeds)
            for key, found in fresh.items():
                miss = 1.0
                for c in found.values():
                    miss *= 1 - min(0.999, c)
                scores[key] = (round(1 - miss, 9), max(found.values()) >= pii.CONFIDENT)
    best = {}
    for t, a, b, k, c in mentions:
        for p in c:
            for kind in SHAPES.get(k, ()):
                if sure.get((p, kind), 0) >= pii.CONFIDENT:
                    best[t, a, b] = max(best.get((t, a, b), (0, 0)), (sure[p, kind], -kind))
    return {(t, a, -kind, b) for (t, a, b), (_, kind) in best.items()}


def digits(pick, n):
    return "".join(pick.choice("0123456789") for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(12)
    word = lambda: pick.choice(["lo", "mira", "tan", "sel", "ora", "née", "quo"])
    some = lambda: " ".join(word() for _ in range(pick.randint(1, 6)))
    out = []
    for k in range(450):
        number = [f"+1 ({digits(pick, 3)}) 555-{digits(pick, 4)}", f"{digits(pick, 3)}.{digits(pick, 3)}.{digits(pick, 4)}", f"({digits(pick, 3)}) {digits(pick, 3)}-{digits(pick, 4)}"][pick.randrange(3)]
        host = [f"10.{k % 200}.3.7", f"fe80:0:{k:x}:1", "10.20.30"][pick.randrange(3)]
        mail = [f"u{k}@mail.example.org", f"u{k} [at] mail [dot] org", f"u{k} at mail dot org"][pick.randrange(3)]
        card = [digits(pick, 16), f"4{digits(pick, 3)}-XXXX-XXXX-{digits(pick, 4)}"][pick.randrange(2)]
        out.append([f"{some()} Call {number} {some()}", f"{some()} from host {host} {some()}", f"{some()} write to {mail} now", f"{some()} charged card {card} and {some()}", f"{some()} order {digits(pick, 9)} {some()} order of {some()}", some(), "", f"{mail} first", f"last {number}"][k % 9])
    return out + out[:40] + [None]


def spans(docs):
    return {(r["doc_id"], r["spans"]) for r in pii.personal_data(docs).collect()}


def test_added_spans_equal_those_of_brute_force(spark, texts):
    want = added([t or "" for t in texts])
    assert len(want) > 20 and {k for _, _, k, _ in want} >= {0, 3}
    rows = list(enumerate(texts))
    for doc, found in spans(spark.createDataFrame(rows, "doc_id long, text string")):
        text = texts[doc] or ""
        all_spans = sorted({*pii.base_spans(text), *((a, k, b) for t, a, k, b in want if t == text)})
        assert found == pii._joined(all_spans), text


def test_spans_do_not_depend_on_the_layout(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = spans(docs.orderBy("doc_id").coalesce(1))
    assert one == spans(docs.orderBy("text").coalesce(1)) == spans(docs.repartition(7, "text"))


def test_planted_identifiers_are_found_and_nothing_else(spark, small):
    """In the documents' own prose: of each kind 30 in the base form and 30 in others, after words that tell them."""
    pick = random.Random(13)
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    ids, want = iter(sorted(docs)), set()
    for kind in ("email", "ip", "card", "phone"):
        for k in range(60):
            doc, a, b = next(ids), digits(pick, 4), digits(pick, 4)
            base = {"email": f"p{a}@post.example.net", "ip": f"10.{k}.0.{k}", "phone": f"+1 (555) 200-{a}", "card": "4000 1234 5678 9017"}[kind]
            other = {"email": f"p{a} [at] post [dot] net", "ip": f"fe80::{a}:{b}", "phone": f"555.200.{a}", "card": f"4000-XXXX-XXXX-{b}"}[kind]
            lead = {"email": "kindly write to ", "ip": "seen from address ", "phone": "please call ", "card": "was charged to card "}[kind]
            lines = docs[doc].split("\n")
            at = pick.randrange(len(lines) + 1)
            lines.insert(at, lead + (base if k < 30 else other) + " as agreed")
            docs[doc] = "\n".join(lines)
            if k >= 30:
                start = len("\n".join([*lines[:at], ""])) + len(lead) if at else len(lead)
                want.add((doc, f"{kind}:{start}:{start + len(other)}"))
    got = set()
    for doc, found in spans(spark.createDataFrame(list(docs.items()), "doc_id long, text string")):
        got |= {(doc, s) for s in found.split(",") if s} - {(doc, s) for s in pii._joined(pii.base_spans(docs[doc])).split(",")}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got), (len(want), len(got), len(got & want), sorted(got - want)[:5], sorted(want - got)[:5])
