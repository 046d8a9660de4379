"""The language model against a scalar version of it, and as a distribution."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from postforge.llm import lm

M64 = 2**64 - 1
DOCS = "doc_id long, text string"


def matrix_of(texts):
    out = np.zeros((256, 256), np.int64)
    for t in texts:
        before = lm.END
        for b in [*t, lm.END]:
            out[before, b] += 1
            before = b
    return out


def scalar_hash(context):
    x = context * 0x9E3779B97F4A7C15 & M64
    x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & M64
    return x >> 32, x >> 16 & 255


def scalar_slot(high, mark, bits):
    place = ((high ^ (mark | 1)) * 0xC2B2AE35 & 0xFFFFFFFF) >> (32 - lm.BLOCK_BITS)
    return high >> (32 - bits + lm.BLOCK_BITS) << lm.BLOCK_BITS | place


def steps(codes, before, byte):
    e = before << 8 | byte
    return [(int(codes.marks[i]), float(codes.odds[i])) for i in range(codes.offsets[e], codes.offsets[e] + codes.lengths[e])]


def places(text):
    """(byte before, byte, context of each order) of every place of a text and its end."""
    padded = bytes([lm.END]) * 8 + text + bytes([lm.END])
    for i in range(8, len(padded)):
        yield padded[i - 1], padded[i], [int.from_bytes(padded[i - o : i], "little") for o in lm.ORDERS]


class Scalar:
    """Every decision on its own, in double precision."""

    def __init__(self, texts):
        matrix = matrix_of(texts)
        self.codes, self.bits = lm.Codes(matrix), lm.table_bits(int(matrix.sum()))
        counts = [collections.defaultdict(lambda: [0, 0]) for _ in lm.ORDERS]
        for t in texts:
            for before, byte, contexts in places(t):
                for mark, _ in steps(self.codes, before, byte):
                    for own, context in zip(counts, contexts, strict=True):
                        high, check = scalar_hash(context)
                        own[scalar_slot(high, mark, self.bits), check][mark & 1] += 1
        self.tables = []
        for own in counts:
            best = {}
            for (slot, check), (n0, n1) in sorted(own.items()):
                if slot not in best or n0 + n1 > best[slot][0]:
                    best[slot] = (n0 + n1, check, n0, n1)
            odds = lambda n0, n1: max(-127, min(127, round(math.log((n1 + lm.PRIOR) / (n0 + lm.PRIOR)) * lm.STEP) or 1))
            self.tables.append({slot: (check, odds(n0, n1)) for slot, (_, check, n0, n1) in best.items()})

    def log10(self, text):
        weights = [list(w) for w in lm.START]
        squares = [[lm.FIRST_SQUARE] * len(w) for w in lm.START]
        seen = [lm.MAP_PRIOR] * lm.NODES
        ones = [lm.MAP_PRIOR / (1 + math.exp(8 - 16 * i / (lm.NODES - 1))) for i in range(lm.NODES)]
        total, stop = 0.0, lm.block_end(0)
        grad = [[0.0] * len(w) for w in weights]
        new = []
        for k, (before, byte, contexts) in enumerate(places(text)):
            if k == stop:
                for g in range(len(weights)):
                    for i in range(len(weights[g])):
                        squares[g][i] += grad[g][i] ** 2
                        weights[g][i] += lm.RATE * grad[g][i] / math.sqrt(squares[g][i])
                for node, bit in new:
                    ones[node] += bit
                    seen[node] += 1
                grad, new, stop = [[0.0] * len(w) for w in weights], [], lm.block_end(stop)
            for mark, base in steps(self.codes, before, byte):
                x, gate = [base], 0
                for table, context in zip(self.tables, contexts, strict=True):
                    high, check = scalar_hash(context)
                    found = table.get(scalar_slot(high, mark, self.bits))
                    hit = found is not None and found[0] == check
                    gate += hit
                    x.append(found[1] / lm.STEP if hit else 0.0)
                z = max(-7.99, min(7.99, sum(a * b for a, b in zip(x, weights[gate], strict=True))))
                p, node, bit = 1 / (1 + math.exp(-z)), round((z + 8) * (lm.NODES - 1) / 16), mark & 1
                final = max(1 / 8192, min(1 - 1 / 8192, (p + ones[node] / seen[node]) / 2))
                total += math.log10(final if bit else 1 - final)
                for i, v in enumerate(x):
                    grad[gate][i] += (bit - p) * v
                new.append((node, bit))
        return total


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    words = [f"{rng.choice('bcdfgst')}{rng.choice('aeiou')}{rng.choice('lmnr')}{rng.choice(['', 'ing', 'er', 'tion'])}" for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    return [None, "", "a", "Ünïcode ÉÉ <|x|>", *texts, *texts[:3], "word " * 900, "\n\t  "]


def is_train(i):
    return zlib.crc32(str(i).encode()) % 5 != 1


def lowered(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode()


def test_scores_are_those_of_the_scalar_model(spark, corpus):
    rows = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(list(enumerate(corpus)), DOCS).repartition(3)).collect()}
    model = Scalar([lowered(t) for i, t in enumerate(corpus) if is_train(i)])
    assert sorted(rows) == list(range(len(corpus)))
    for i, t in enumerate(corpus):
        want = model.log10(lowered(t))
        assert math.isclose(rows[i].score, want, rel_tol=2e-3, abs_tol=1e-3), (i, rows[i].score, want)
        assert math.isclose(rows[i].bits_per_byte, -rows[i].score / math.log10(2) / max(1, len(lowered(t))), rel_tol=1e-9)


def test_next_bytes_and_the_end_sum_to_one(corpus):
    train = [lowered(t) for t in corpus]
    matrix = matrix_of(train)
    rng = np.random.default_rng(0)
    # any tables at all give a distribution
    tables = [(rng.integers(0, 256, 1 << lm.LEAST_BITS) << 8 | rng.integers(1, 256, 1 << lm.LEAST_BITS)).astype(np.uint16) for _ in lm.ORDERS]
    model = lm.Model(lm.Codes(matrix), tables)
    for start in (b"", b"a", b"the do", train[10][:37]):
        so_far = lm.log10_probabilities(model, [start], ends=False)[0]
        more = lm.log10_probabilities(model, [start + bytes([b]) for b in range(255)], ends=False)
        end = lm.log10_probabilities(model, [start])[0]
        assert math.isclose((10 ** (more - so_far)).sum() + 10 ** (end - so_far), 1, rel_tol=1e-4)


def test_a_score_depends_on_its_text_alone(corpus):
    train = [lowered(t) for t in corpus]
    tables = [np.zeros(1 << lm.LEAST_BITS, np.uint16) for _ in lm.ORDERS]
    model = lm.Model(lm.Codes(matrix_of(train)), tables)
    together = lm.log10_probabilities(model, train)
    assert np.allclose(together, [lm.log10_probabilities(model, [t])[0] for t in train], rtol=1e-5)


def test_the_model_learns_within_a_text(corpus):
    """A text that goes on as it began costs ever less."""
    train = [lowered(t) for t in corpus[4:64]]
    model = lm.Model(lm.Codes(matrix_of(train)), [np.zeros(1 << lm.LEAST_BITS, np.uint16) for _ in lm.ORDERS])
    odd = "zq" * 400
    bits = -np.diff([0.0, *lm.log10_probabilities(model, [odd[:n].encode() for n in (200, 400, 800)], ends=False)]) / [200, 200, 400]
    assert bits[2] < bits[1] < bits[0]


def test_repeated_rows_are_scored_each_by_its_text(spark):
    docs = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (1, "two"), (2, "one two"), (None, "two"), (3, None)], DOCS)
    rows = sorted(lm.score_documents(docs).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect(), key=tuple)
    assert [(r.doc_id, r.n_tokens) for r in rows] == [(1, 2), (1, 4), (1, 4), (2, 3), (3, 1)]
    assert rows[1] == rows[2] and all(r.n_known <= r.n_tokens for r in rows)
    counts = collections.Counter()
    for i, t in ((1, "one two three"), (1, "one two three"), (1, "two"), (2, "one two"), (3, "")):
        if is_train(i):
            counts.update([*t.split(), None])
    norm = math.log10(sum(counts.values()) + 0.5 * (len(counts) + 1))
    for r, t in zip(rows, ("two", "one two three", "one two three", "one two", ""), strict=True):
        assert math.isclose(r.base_score, sum(math.log10(counts[w] + 0.5) - norm for w in [*t.split(), None]), rel_tol=1e-9)


def test_the_more_frequent_context_keeps_a_slot():
    cell = np.array([5 << 9 | 3 << 1, 5 << 9 | 3 << 1 | 1, 5 << 9 | 9 << 1, 7 << 9 | 4 << 1 | 1, 7 << 9 | 2 << 1], np.int64)
    values = lm.block_values(cell, np.array([2, 2, 5, 1, 1]))
    assert values[5] >> 8 == 9 and values[5].astype(np.uint8).view(np.int8) < 0
    assert values[7] >> 8 == 2 and np.count_nonzero(values) == 2


def test_tables_grow_with_the_training_text():
    assert [lm.table_bits(n) for n in (0, 2**23, 2**24, 2**30, 2**40)] == [18, 18, 19, 25, 26]
