"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from postforge.llm import ranked

DOCS = "doc_id long, text string, rank int, score string, item_id string"
ITEMS = "item_id long, text string, doc_id int"


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, most=20):
    found = [(d, Counter(split(t))) for d, t in docs]
    total, words = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    queries = {}
    for i, t in items:
        queries.setdefault(i, Counter()).update(split(t))
    out = {}
    for i, q in queries.items():
        scored = []
        for d, c in found:
            m = 75 + (25 * sum(c.values()) * total) // words if words else 0
            s = sum(n * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, n in q.items() if t in c)
            if s > 0 and d is not None:
                scored.append((-s, d))
        out[i] = [(r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:most], 1)]
    return {i: x for i, x in out.items() if x}


def searched(spark, docs, items, parts=3, **kw):
    d = spark.createDataFrame([(i, t, 0, "clash", "x") for i, t in docs], DOCS).repartition(parts)
    out = {}
    for r in ranked.ranked_search(d, spark.createDataFrame([(i, t, 7) for i, t in items], ITEMS), **kw).orderBy("item_id", "rank").collect():
        out.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["The", "the", "Éa", "éa", "a-b", "x_y", "3.5", "naïve"]
    weight = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, weight, k=rng.choice((0, 1, 5, 40, 200)))) for _ in range(n)]
    docs = [(i, t) for i, t in zip(rng.sample(range(-n, 9 * n), n), texts, strict=True)]
    docs += [(20 * n + i, docs[i % 9][1]) for i in range(n // 3)] + [docs[5], (None, "w1 w2 w3"), (30 * n, None), (30 * n + 1, "--- ..")]
    items = [(i, " ".join(rng.choices(words, weight, k=rng.choice((1, 3, 12, 30))))) for i in range(25)]
    return docs, [*items, (100, ""), (101, None), (102, "nowhere found"), (103, "w1 w1 w1 w2"), (104, "w3"), (104, "w4 w3"), (None, "w7 w9")]


@pytest.mark.parametrize("most", [1, 20])
def test_against_all_pairs(spark, most):
    docs, items = corpus(1, 600)
    assert searched(spark, docs, items, most=most) == brute(docs, items, most)


def test_small_shards_chunks_and_blocks(spark, monkeypatch):
    """Many shards a task, thresholds that move within a merge, several blocks of queries."""
    monkeypatch.setattr(ranked, "SHARD_TERMS", 500)
    monkeypatch.setattr(ranked, "BLOCK_PAIRS", 120)
    docs, items = corpus(2, 400)
    assert searched(spark, docs, items, parts=2) == brute(docs, items)


@pytest.mark.parametrize("chunk", [1, 2, 5])
def test_search_of_one_shard_in_small_chunks(monkeypatch, chunk):
    monkeypatch.setattr(ranked, "FIRST_CHUNK", chunk)
    monkeypatch.setattr(ranked, "CHUNK", 2 * chunk)
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = int(rng.integers(1, 300))
        doc, term = rng.integers(0, n, 4 * n), rng.integers(0, 12, 4 * n)
        ids = (rng.permutation(n) * 3).tolist()
        shard = ranked._shard(ids, rng.integers(1, 50, n).tolist(), [doc], [term]).to_pylist()[0]
        weights = rng.integers(0, 9000, 12)
        postings = ranked.Postings(shard, weights, n, 25 * n)
        query = [(t, int(rng.integers(1, 3))) for t in range(14) if rng.random() < 0.6]
        score = Counter()
        for t, k in query:
            if t in postings.lists:
                for d, a in zip(*postings.lists[t][:2], strict=True):
                    score[int(postings.ids[d])] += k * int(a)
        held = []
        ranked.search(postings, query, held, 7)
        assert sorted((-s, -i) for s, i in held) == sorted((-s, i) for i, s in score.items() if s > 0)[:7]


def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        v = rng.integers(0, 2 ** rng.integers(1, 33, n), n) if n else np.zeros(0, np.int64)
        assert ranked.unpack(ranked.pack(v)).tolist() == v.tolist()


def test_many_copies_of_one_document_and_long_texts(spark):
    docs = [(i, "same words here again") for i in range(3000)] + [(9000, "same " * 300_000 + "rare")]
    assert searched(spark, docs, [(1, "same words rare"), (2, "again here")]) == brute(docs, [(1, "same words rare"), (2, "again here")])


def test_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == {} and searched(spark, [(1, "a b"), (2, "c")], []) == {}
    assert searched(spark, [(1, None), (2, "")], [(1, "a")]) == {}
