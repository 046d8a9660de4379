"""Licences, URLs, languages and the pipeline against brute force; very long
texts, repeated rows and columns of clashing names."""

import collections
import hashlib
import math
import random
import re
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postforge.llm import decontam, language, licenses, lines, lm, packing, simhash, substrings, urls
from postforge.llm.license_rules import RULES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# --- licences ---------------------------------------------------------------------


def brute_licence(text):
    """(labels, score) by walking all rules over the text and sweeping all matches."""
    norm = " ".join(WORDS.findall((text or "").translate(LOWER)))
    base = [label for phrase, label in licenses.BASE if f" {phrase} " in f" {norm} "]
    found = set()
    for label, priority, keyword, pattern in RULES:
        if keyword in norm:
            found |= {(m.start(), -m.end(), -priority, label) for m in re.finditer(rf"(?<![^ ])(?:{pattern})(?![^ ])", norm) if m.group()}
    kept, top, labels = [], 0, list(base)
    for start, back, low, label in sorted(found):
        if not any(s <= start and -back <= e and p >= -low for s, e, p in kept):
            kept.append((start, -back, -low))
            labels.append(label)
            top = max(top, -low)
    return ",".join(sorted(set(labels))), 1.0 if base else licenses.CONFIDENCE.get(top, 0.0)


def test_licence_labels_and_scores(spark):
    pieces = [
        "Licensed under the Apache License, Version 2.0", "GNU General Public License version 3 or later", "GNU Lesser General Public License v2.1", "SPDX-License-Identifier: BSD-3-Clause", "All rights reserved.", "Creative Commons Attribution-ShareAlike 4.0", "CC BY NC 4.0", "under the MIT license", "MIT License",
        "Mozilla Public License 2.0", "This is free and unencumbered software released into the public domain", "Permission is hereby granted, free of charge, to any person", "Redistribution and use in source and binary forms", "no part of this book may be reproduced", "GPLv2", "AGPL-3.0", "CC0 1.0 Universal", "Eclipse Public License", "the Unlicense", "Boost Software License 1.0", "ISC license",
    ]
    rng = random.Random(6)
    texts = [None, "", "no such words here", *pieces, *[" filler words ".join(rng.sample(pieces, rng.randrange(2, 6))) for _ in range(60)], *[" ".join(rng.sample(" ".join(pieces).split(), 30)) for _ in range(30)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(docs.unionByName(docs)).collect()}
    assert rows == {i: brute_licence(t) for i, t in enumerate(texts)}
    assert len({s for _, s in rows.values()}) >= 3


# --- URLs ---------------------------------------------------------------------------


def brute_verdict(url):
    url = url or ""
    host, path = "", ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = host.translate(LOWER)
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    low = url.translate(LOWER)
    has = lambda t: re.search(rf"(?<![a-z0-9\x80-\U0010FFFF]){re.escape(t)}(?![a-z0-9\x80-\U0010FFFF])", low)
    strict, soft = sum(bool(has(t)) for t in urls.STRICT), sum(bool(has(t)) for t in urls.SOFT)
    by_words = "block" if strict or soft >= urls.SOFT_LIMIT else "allow"
    return (host, path, max(fits)[1], max(fits)[2], strict, soft) if fits else (host, path, None, by_words, strict, soft)


def test_url_verdicts(spark):
    rng = random.Random(8)
    terms = [*urls.STRICT, *urls.SOFT, "free", "essex", "news", "über", "казино"]
    hosts = ["a.com", "www.example.net", "EXAMPLE.com", "x.org", "sub.example.com", "net", "über.de"]
    made = [f"https://{rng.choice(hosts)}/{rng.choice(['', 'en/', 'de/', 'fr/'])}{rng.choice('-/_.').join(rng.sample(terms, rng.randrange(1, 4)))}{rng.choice(['', '?q=' + rng.choice(terms), '#' + rng.choice(terms)])}" for _ in range(600)]
    given = [None, "", "://", "porn", "a://b", "https://", "https://a.com/xporn", "https://a.com/porné", "https://a.com/" + "x/" * 200_000 + "porn", *made, *made[:5]]
    docs = spark.createDataFrame([(i, u, "n", 1) for i, u in enumerate(given)], "page_id long, url string, host string, n_strict int").repartition(3)
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.n_strict, r.n_soft) for r in urls.judge_urls(docs).collect()}
    assert rows == {i: brute_verdict(u) for i, u in enumerate(given)}
    by_words = collections.Counter((bool(r[4]), r[3]) for r in rows.values() if r[2] is None)
    assert by_words[True, "block"] > 50 and by_words[False, "block"] > 20 and by_words[False, "allow"] > 20
    assert urllib.parse.urlsplit(made[0]).netloc


# --- languages ----------------------------------------------------------------------


def brute_language(model, text):
    """The nearest centroid by plain sums over hashed trigrams."""
    if text is None or not any(map(str.isalpha, text)):
        return "und", 0.0
    folded = "".join(c if "a" <= c <= "z" or ord(c) >= 0xAA else " " for c in f" {text.lower()} ")
    folded = re.sub(" +", " ", folded)
    grams = collections.Counter()
    for a, b, c in zip(folded, folded[1:], folded[2:], strict=False):
        grams[(((ord(a) * 31 + ord(b)) * 1009 + ord(c)) * 2654435761 % 2**32) >> 19] += 1
    vector = {g: math.log1p(n) * float(model.idf[g]) for g, n in grams.items()}
    norm = math.sqrt(sum(v * v for v in vector.values()))
    sims = [sum(v * float(c[g]) for g, v in vector.items()) / norm for c in model.centroids]
    best = max(range(len(sims)), key=lambda j: sims[j])
    return model.langs[best], min(1.0, max(0.0, sims[best]))


def test_the_nearest_centroid_wins(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit_language(docs)
    texts = [None, "", "123", "x", "ÀÉ", *[r.text for r in docs.limit(60).collect()]]
    own = spark.createDataFrame([(i, t, "clash", 2.0, True) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, score double, rejected boolean")
    for keep in (False, True):
        rows = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(own, model, keep=keep).collect()}
        for i, t in enumerate(texts):
            lang, score = brute_language(model, t)
            assert rows[i][0] == lang and math.isclose(rows[i][1], score, abs_tol=1e-4)


# --- the pipeline -------------------------------------------------------------------

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string"


def components(n, linked):
    comp = list(range(n))
    while True:
        before = list(comp)
        for a, b in linked:
            comp[a] = comp[b] = min(comp[a], comp[b])
        comp = [comp[c] for c in comp]
        if comp == before:
            return comp


def brute_pipeline(texts, items):
    """Stages two to five over {id: text} by plain loops: the ids of the kept documents, their tokens."""
    from tokenizers import Tokenizer

    key = lambda line: line.encode().strip().lower()
    held = collections.defaultdict(set)
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    texts = {i: None if t is None else "\n".join(x for x in t.split("\n") if len(key(x).decode()) < 10 or min(held[key(x)]) == i) for i, t in texts.items()}
    ids = sorted(texts)
    grams = []
    for i in ids:
        w = (texts[i] or "").translate(LOWER).encode().split()
        grams.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    linked = [(a, b) for a in range(len(ids)) for b in range(a) if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    comp = components(len(ids), linked)
    texts = {i: texts[i] for k, i in enumerate(ids) if comp[k] == k}
    windows = set()
    for item in items:
        v = WORDS.findall((item or "").translate(LOWER))
        n = min(len(v), 10)
        windows |= {tuple(v[a : a + n]) for a in range(len(v) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}

    def leaks(t):
        w = WORDS.findall((t or "").translate(LOWER))
        return any(tuple(w[a : a + n]) in windows for n in sizes for a in range(len(w) - n + 1))

    texts = {i: t for i, t in texts.items() if not leaks(t)}
    tok = Tokenizer.from_file(packing.tokenizer_path())
    return {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}


def test_the_whole_run_is_that_of_plain_loops(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(120).collect()
    items = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rng = random.Random(12)
    given = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 0.5, "x") for r in rows]
    top = max(r.doc_id for r in rows) + 1
    base = max((r.text for r in rows if r.lang == "en"), key=len).split()[:150]
    chain = [base]
    for _ in range(5):  # each a near copy of the one before, the ends are not
        chain.append([w if rng.random() > 0.02 else "altered" for w in chain[-1]])
    given += [(top + i, " ".join(w), "en", None, None, None, None) for i, w in enumerate(chain)]
    given += [(top + 10, " ".join(base) + " " + items[0], "en", None, None, None, None), (top + 11, None, None, None, None, None, None)]
    docs = spark.createDataFrame(given, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    first = corpus_pipeline.language_stage(spark, docs, str(tmp_path))
    assert first.columns == docs.columns
    kept = {r.doc_id: r.text for r in first.collect()}
    assert len(kept) >= 0.9 * len(given) - 1 and top + 11 not in kept
    want = brute_pipeline(kept, items)
    pieces = collections.defaultdict(dict)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id][r.start] = r.length
    assert {i: sum(p.values()) for i, p in pieces.items()} == {i: len(t) for i, t in want.items()}


def test_the_pipeline_takes_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


# --- very long texts ----------------------------------------------------------------


@pytest.fixture(scope="module")
def long_docs(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in rng.integers(0, 40_000, 200_000)]
    text = "\n".join(" ".join(words[i : i + 40]) for i in range(0, len(words), 40))
    return text, spark.createDataFrame([(1, text), (2, text), (3, "a short one"), (4, text + " under the MIT license")], "doc_id long, text string")


def test_very_long_texts(spark, long_docs):
    text, docs = long_docs
    assert [r.component_id for r in simhash.near_duplicates(docs).orderBy("doc_id").collect()] == [1, 1, 3, 1]
    assert sorted(r.doc_id for r in simhash.near_copies(docs).collect()) == [2, 4]
    found = {r.doc_id: r for r in lines.drop_repeated_lines(docs, digest=True).collect()}
    assert [found[i].n_dropped for i in (1, 2, 3, 4)] == [0, 5000, 0, 4999] and found[2].kept == hashlib.sha256(b"").hexdigest()
    scans = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert scans[4].base_labels == "mit" and scans[4].first_word == 200_000 and scans[1].n_base == 0
    removed = {r.doc_id: r.n_removed for r in substrings.drop_repeated_passages(docs, digest=True).collect()}
    assert removed == {1: 0, 2: 200_000, 3: 0, 4: 200_000}
    bench = spark.createDataFrame([(1, " ".join(text.split()[150_000:150_012]))], "item_id long, text string")
    hits = {r.doc_id: r.n_hit for r in decontam.contamination(docs, bench).collect()}
    assert hits == {1: 12, 2: 12, 3: 0, 4: 12}
    assert packing.pack(docs, keep_ids=False).agg(F.sum("length")).first()[0] == packing.pack(docs, keep_ids=False).select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]


def test_very_long_texts_are_scored(spark, long_docs):
    _, docs = long_docs
    rows = {r.doc_id: r for r in lm.score_documents(docs).collect()}
    assert rows[1].n_tokens == 200_001 and rows[1].score == rows[2].score and rows[1].bits_per_byte < 8
