"""The filter audit against a plain loop over every order."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from postforge.llm import audit

DOCS = "doc_id long, text string, lang string, part string, fp long"
LABELS = "doc_id long, quality int, toxic int"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails(text, own, rows):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    upper = sum("A" <= c <= "Z" for c in text)
    smaller = any(d is not None and own is not None and d < own and (t or "") == text for d, t, _ in rows)
    return (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * upper > 10 * len(text), any(c in "#$%&*|" for c in text), smaller)


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    judged = [(p or "", d, fails(t or "", d, rows)) for d, t, p in rows]
    out = {}
    for part in {p for p, *_ in judged}:
        own = [(d, dict(zip("ABCDE", f, strict=True))) for p, d, f in judged if p == part]
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                failing = [(d, f) for d, f in own if f[name]]
                lost = [(d, f) for d, f in left if f[name]]
                left = [(d, f) for d, f in left if not f[name]]
                out[part, "".join(order), step] = [len(left), len(lost), len(failing) - len(lost), sum(sum(f.values()) == 1 for _, f in failing), sum(d in good for d, _ in lost), sum(d in toxic for d, _ in lost)]
        for name in "ABCDE":
            keys = [k for k in out if k[0] == part and k[1][k[2] - 1] == name]
            total = sum(out[k][1] for k in keys)
            for k in keys:
                out[k].append(total)
    return out


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(d, t, p, "clash", 1) for d, t, p in rows], DOCS)
    found = audit.audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len({(r.part, r.filter_order, r.step) for r in found}) == len(found)
    return {(r.part, r.filter_order, r.step): [r[m] for m in MEASURES] for r in found}


def test_every_order_against_a_plain_loop(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["THE", "é|", "x"]
    texts = [" ".join(rng.choices(words, k=rng.choice((3, 90, 100, 140)))) for _ in range(30)] + ["", None, "A" * 30, "a\tb\x0bc d " * 40, " ".join(f"u{i}" for i in range(120))]
    rows = [(i, rng.choice(texts), rng.choice(("en", "de", None, ""))) for i in rng.sample(range(-50, 900), 150)]
    rows += [(rows[0][0], rows[0][1], "en"), (rows[1][0], rows[2][1], "en"), (None, "lone", "fr"), (None, "lone", "fr"), (5000, "lone", "fr"), (4999, "lone", "fr")]
    labels = [(d, rng.choice((0, 1, None)), rng.choice((0, 1))) for d, *_ in rng.sample(rows, 90)] + [(rows[3][0], 0, 0), (rows[3][0], 1, 1), (None, 1, 1), (-999, 1, 1)]
    assert audited(spark, rows, labels) == brute(rows, labels)


def test_copies_that_fill_many_tasks(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        copies = spark.range(4000).select((F.col("id") + 10).alias("doc_id"), F.lit("copied " * 5).alias("text"), F.lit("en").alias("lang"))
        others = spark.range(3000).select((F.col("id") + 9000).alias("doc_id"), F.concat(F.lit("own "), "id").alias("text"), F.lit("en").alias("lang"))
        docs = copies.union(others).union(copies.where("doc_id < 300"))
        found = audit.text_figures(docs)
        assert found.where("repeated").count() == 3999 + 289
        assert found.where("not repeated and doc_id < 9000").select("doc_id").distinct().collect() == [(10,)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_equal_fingerprints_of_different_texts_are_told_apart(spark, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(audit.F, "xxhash64", lambda c: real(c) * 0)
    docs = spark.createDataFrame([(i, f"text {i % 7}", "en") for i in range(200)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in audit.text_figures(docs).where("not repeated").collect()) == list(range(7))


def test_empty_tables_long_texts_and_other_filters(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit.audit(docs, labels).count() == 0
    long = spark.createDataFrame([(1, "word " * 400_000, None, "", 0), (2, "word " * 400_000, None, "", 0)], DOCS)
    assert [(r.n_words, r.n_distinct, r.repeated) for r in audit.text_figures(long).orderBy("doc_id").collect()] == [(400_000, 1, False), (400_000, 1, True)]
    found = audit.audit(long, labels, {"L": "n_words > 10", "R": "repeated"}).collect()
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in found} == {("LR", 1): (0, 2, 0, 3), ("LR", 2): (0, 0, 1, 1), ("RL", 1): (1, 1, 0, 1), ("RL", 2): (0, 1, 1, 3)}
    with pytest.raises(ValueError):
        audit.audit(docs, labels, dict.fromkeys("ABCDEFG", "true"))
