"""The quality classifier: held-out accuracy, and its parts against plain versions."""

import zlib

import duckdb
import numpy as np

from postforge.llm import quality, queries

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, score string, label int, quality string"
LABELS = "doc_id long, quality int, toxic int"


def test_held_out_documents(spark):
    rows = {r.doc_id: r for r in queries.op13_quality(spark, SF).collect()}
    truth = dict(duckdb.connect().execute(f"select doc_id, quality from read_parquet('{SF}/labels.parquet')").fetchall())
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for d, r in rows.items())
    test = [(rows[d].score, rows[d].predicted, q) for d, q in truth.items() if rows[d].held_out]
    good, bad = [s for s, _, q in test if q], [s for s, _, q in test if not q]
    assert len(bad) > 5 and np.mean([g > b for g in good for b in bad]) > 0.99
    assert np.mean([p == 1 for _, p, q in test if q]) > 0.98 and np.mean([p == 0 for _, p, q in test if not q]) > 0.8


def plain_features(text):
    """Buckets by loops over characters and words."""
    mask = 2**32 - 1
    space = " \t\n\x0b\x0c\r"
    chars = []
    for c in text:
        if c not in space:
            chars.append(ord(c))
        elif not chars or chars[-1] != 32:
            chars.append(32)
    bucket = lambda h: ((h * 2654435761) & mask) >> (32 - quality.BUCKET_BITS)
    out = []
    for n in quality.GRAMS:
        for i in range(len(chars) - n + 1):
            h = n
            for c in chars[i : i + n]:
                h = (h * 16777619 + c) & mask
            out.append(bucket(h))
    words = [w for w in "".join(map(chr, chars)).split(" ") if w]
    hashes = [sum((ord(c) + 1) * pow(1000003, (i & 63) + 1, 2**32) for i, c in enumerate(w)) * 31 + 17 for w in words]
    out += [bucket(h & mask) for h in hashes]
    out += [bucket(((b - a) * 40503) & mask) for a, b in zip(hashes, hashes[1:])]
    return sorted(out)


def test_features_against_loops():
    for text in ("", " ", "a", "ab  cd", " lead and tail \n", "same same same", "é日本 ﬀ\U0001f600 x y", "long" * 40 + " w"):
        assert sorted(int(x) for part in quality.features(text) for x in part) == plain_features(text)


def test_a_step_follows_the_gradient():
    """The first step against plain sums; many steps tell two texts apart."""
    at, share = quality.counts("a few plain words")
    begun, after = (quality.train([(1, at, share)], epochs=1, rate=r) for r in (0.0, 0.1))
    hidden = [sum(float(s) * float(begun.vectors[i, d]) for i, s in zip(at, share, strict=True)) for d in range(quality.DIMS)]
    assert np.allclose(after.output, [[-0.05 * h for h in hidden], [0.05 * h for h in hidden]], atol=1e-6)
    assert np.allclose(after.offset, [-0.05, 0.05]) and np.array_equal(after.vectors, begun.vectors)  # the output layer begins at nought
    model = quality.train([(1, at, share), (0, *quality.counts("OTHER!! WORDS!!"))], epochs=2000)
    assert model.score("a few plain words") > 0.9 > 0.1 > model.score("OTHER!! WORDS!!")
    hidden = share @ model.vectors[at]
    z = model.output @ hidden + model.offset
    assert abs(model.score("a few plain words") - np.exp(z[1]) / np.exp(z).sum()) < 1e-4


def test_nulls_empty_texts_one_label_and_clashes(spark):
    docs = spark.createDataFrame([(i, f"good words {i} here" if i % 2 else "BAD!! | BAD!!", "x", 1, "y") for i in range(200)] + [(900, None, "", 0, ""), (901, "", "", 0, ""), (None, "no id", "", 0, ""), (5, "good again", "", 0, ""), (902, "long " * 500_000, "", 0, "")], DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(7, None, None), (None, 1, 1), (8, 5, 0), (9, 0, 0), (5000, 1, 0), (3, 1, 0)], LABELS)
    model = quality.fit_quality(docs, labels)
    found = quality.score_quality(docs, model).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == docs.count() and by_id[900].score == by_id[901].score and by_id[None].held_out is False
    assert all(by_id[i].predicted == i % 2 for i in range(20) if i not in (5, 9))
    some = quality.fit_quality(docs, labels, sample=20, sample_bytes=200)
    assert some.score("good words 4000 here") > some.score("BAD!! | BAD!!")
    one = quality.fit_quality(docs, labels.where("quality = 1"))
    assert one.score("BAD!! | BAD!!") > 0.99
    none = quality.fit_quality(docs, labels.where("quality = 7"))
    assert none.score("anything") == 0.5
    empty = docs.limit(0)
    assert quality.score_quality(empty, quality.fit_quality(empty, labels.limit(0))).count() == 0


def test_held_out_labels_teach_nothing(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, f"text {i} of words", "", 0, "") for i in range(400)], DOCS)
    labels = [(i, i % 2, 0) for i in range(400)]
    turned = [(i, 1 - q if i in held else q, t) for i, q, t in labels]
    a, b = (quality.fit_quality(docs, spark.createDataFrame(x, LABELS)) for x in (labels, turned))
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.offset, b.offset)
