"""Near copies and their buckets, against brute force."""

import random

import numpy as np

import corpus_pipeline
from postforge.llm import simhash
from test_operators import brute_components


def test_every_covering_mask_keeps_many_bits():
    for radius, least, least_twice in ((3, 32, 48), (6, 27, 40)):
        first = simhash.masks(list(range(64)), radius)
        assert min(m.bit_count() for m in first) >= least
        for m in first:
            again = simhash.masks([b for b in range(64) if not m >> b & 1], radius)
            assert min((m | x).bit_count() for x in again) >= least_twice


def test_hot_buckets_in_cells_give_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 32)
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 2**63, dtype=np.uint64)
    fps = np.unique(np.array([centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(12, rng.integers(1, 7), replace=False))) for _ in range(200)], np.uint64))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = simhash.fingerprint_links(frame, 3).toPandas()
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    got = brute_components(len(fps), [(at[a], at[b]) for a, b in zip(links.a, links.b, strict=True)])
    a, b = simhash.links_within(fps, 3)
    assert got == brute_components(len(fps), list(zip(a.tolist(), b.tolist(), strict=True)))


def test_a_large_bucket_is_cut_into_cells_that_hold_every_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 32)
    rows = simhash._in_cells(spark.createDataFrame([(5, 9, i) for i in range(100)] + [(6, 9, i) for i in range(3)], "t long, key long, fp long")).collect()
    cells = {}
    for r in rows:
        cells.setdefault((r.t, r.key), set()).add(r.fp)
    assert all(len(c) < 60 for c in cells.values())
    met = {(a, b) for c in cells.values() for a in c for b in c}
    assert met == {(a, b) for a in range(100) for b in range(100)} and cells[6, 9] == {0, 1, 2}


def edited(rng, words, changes):
    """The words with so many places changed, far enough apart to cost five shingles each."""
    out = list(words)
    for i in range(changes):
        out[10 + i * 12 + rng.randrange(3)] = f"x{rng.randrange(10**6)}"
    return out


def corpus():
    """Texts in pairs of similarity 0.7 to 0.98, short ones and long ones, and the sets of their shingles."""
    rng = random.Random(8)
    texts = []
    for size in (60, 150, 400):
        for changes in range(1, size // 12 - 1):
            for _ in range(12 if size < 400 else 4):
                words = [f"w{rng.randrange(9000)}" for _ in range(size)]
                texts += [" ".join(words), " ".join(edited(rng, words, changes))]
    rng.shuffle(texts)
    return texts, [{" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]


def alike(sets, least=0.8):
    held = {}
    for i, s in enumerate(sets):
        for x in s:
            held.setdefault(x, []).append(i)
    pairs = {(a, b) for own in held.values() for a in own for b in own if a < b}
    return {(a, b): j for a, b in pairs if (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= least}


def test_every_pair_of_similarity_0_8_shares_a_bucket(spark):
    texts, sets = corpus()
    near = alike(sets)
    assert sum(0.8 <= j < 0.85 for j in near.values()) >= 30 and sum(0.85 <= j < 0.95 for j in near.values()) >= 40
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    signed = {r.id: r for r in simhash.signatures(frame).collect()}
    assert not [p for p in near if signed[p[0]].c != signed[p[1]].c and not set(signed[p[0]]["keys"]) & set(signed[p[1]]["keys"])]
    gone = {r.doc_id for r in simhash.near_copies(frame).collect()}
    assert gone == {b for _, b in near}  # every text has one near copy at most
    assert (1 - 0.8**simhash.ROWS) ** simhash.BANDS < 1e-4


def test_one_document_of_a_group_stays(spark, monkeypatch):
    """Chains of edited copies: ends are not similar, all are one group."""
    rng = random.Random(3)
    texts = []
    for _ in range(6):
        words = [f"w{rng.randrange(9000)}" for _ in range(150)]
        for i in range(9):
            texts.append(" ".join(words))
            words[10 + 14 * i] = f"x{rng.randrange(10**6)}"
            words[17 + 14 * i] = f"x{rng.randrange(10**6)}"
    rng.shuffle(texts)
    texts += [texts[4], texts[7].upper(), "", " ", None]
    sets = [{" ".join((t or "").lower().split()[i : i + 5]) for i in range(len((t or "").split()) - 4)} for t in texts]
    near = set(alike(sets, 0.8)) | {(56, 57), (56, 58)}  # of no shingle at all
    comp = brute_components(len(texts), near)
    assert any((comp[i], i) not in near for i in range(len(texts)) if comp[i] != i)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {i: c for i, c in enumerate(comp) if i != c}
    assert {r.doc_id: r.kept_id for r in simhash.near_copies(frame).collect()} == want
    monkeypatch.setattr(simhash, "CELL", 4)
    assert {r.doc_id: r.kept_id for r in simhash.near_copies(frame).collect()} == want


def test_set_links_join_what_all_pairs_join():
    rng = np.random.default_rng(5)
    base = [rng.choice(1000, 40, replace=False) for _ in range(8)]
    sets = [np.unique(np.where(rng.random(40) < 0.08, rng.integers(1000, 2000, 40), base[i % 8])).astype("<u4") for i in range(60)] + [np.zeros(0, "<u4")] * 2
    near = [(a, b) for a in range(62) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
    a, b = simhash.set_links(sets, np.arange(62), 0.8)
    assert brute_components(62, list(zip(a.tolist(), b.tolist(), strict=True))) == brute_components(62, near)


def test_the_pipeline_stage_keeps_the_smallest_of_each_group(spark):
    texts, sets = corpus()
    comp = brute_components(len(texts), list(alike(sets)))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_copy_stage(spark, frame, "").collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(i, t) for i, t in enumerate(texts) if comp[i] == i]
