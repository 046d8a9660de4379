"""Corpus operators against brute force on small hostile tables."""

import binascii
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
import corpus_pipeline
from postforge.llm import decontam, language, licenses, lines, lm, packing, simhash, substrings, urls, vectors

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, id string, component_id long, kept string, c long"


def frame(spark, texts):
    """Documents with nulls in every other column and columns of clashing names."""
    return spark.createDataFrame([(i, t, None, None, None, 7, "x", None, "y", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    base = [prose(rng, 120, 5000) for _ in range(12)]
    near = [b.replace(b.split()[k], "changed", 1) for b in base[:6] for k in (3, 60)]
    shared = prose(rng, 70, 9000)
    out = [None, "", " \t\n ", "one", "ONE", "ñandú Ünïcode ÉÉ", "\n\n", *base, *base[:4], *near, *[prose(rng, 20) + " " + shared + " " + prose(rng, 20) for _ in range(5)], "long line here, repeated\nshort\n" + base[0][:80], "Long LINE here, repeated \nshort\nother line of text", "word " * 3000]
    return out


def brute_components(n, linked):
    comp = list(range(n))
    for _ in range(n):
        changed = False
        for a, b in linked:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                changed = True
        if not changed:
            break
    return comp


def brute_fingerprint(text, k):
    words = (text or "").translate(LOWER).encode().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def test_simhash(spark, texts):
    rows = simhash.near_duplicates(frame(spark, texts)).select("doc_id", simhash.hex_fingerprint("fp").alias("h"), "component_id").collect()
    fps = [brute_fingerprint(t, 3) for t in texts]
    comp = brute_components(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 3])
    assert {r.doc_id: (r.h, r.component_id) for r in rows} == {i: (f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, comp, strict=True))}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_covering_masks_leave_no_pair_out():
    rng = random.Random(5)
    for radius in (3, 6):
        masks = simhash.masks(list(range(64)), radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(300):
            diff = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not diff & m for m in masks)


def test_hot_buckets_give_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 32)
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**63, dtype=np.uint64)
    fps = np.unique(np.array([centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False))) for _ in range(900)], np.uint64))
    links = simhash.fingerprint_links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")).toPandas()
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    got = brute_components(len(fps), [(at[a], at[b]) for a, b in zip(links.a, links.b, strict=True)])
    a, b = simhash.links_within(fps, 3)
    assert got == brute_components(len(fps), list(zip(a.tolist(), b.tolist(), strict=True)))


def test_near_copies_share_five_word_shingles(spark, texts):
    gone = {r.doc_id: r.kept_id for r in simhash.near_copies(frame(spark, texts)).collect()}
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for t in texts]
    for d, k in gone.items():
        assert k < d and len(sets[d] & sets[k]) >= 0.8 * len(sets[d] | sets[k])
    for i, t in enumerate(texts):  # of equal texts one stays
        if t in texts[:i]:
            assert i in gone


@pytest.mark.parametrize("held", [0, 64 << 20])
def test_lines(spark, monkeypatch, texts, held):
    monkeypatch.setattr(lines, "ARRAY_BYTES", held)
    held = collections.defaultdict(set)
    key = lambda line: line.encode().strip().lower()
    long = lambda k: len(k.decode()) >= 10
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    want = {}
    for i, t in enumerate(texts):
        own = (t or "").split("\n")
        kept = [x for x in own if not (long(key(x)) and len(held[key(x)]) > 1 and min(held[key(x)]) != i)]
        want[i] = (len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    got = lines.drop_repeated_lines(frame(spark, texts), digest=True).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in got} == want
    whole = lines.without_repeated_lines(frame(spark, texts))
    assert whole.columns == frame(spark, []).columns and whole.count() == len(texts)
    assert lines.drop_repeated_lines(frame(spark, [])).count() == 0


@pytest.mark.parametrize("held", [0, 64 << 20])
def test_heavy_lines_and_shards(spark, monkeypatch, held):
    """Routed probes and broadcast arrays answer alike; several shards, a hot key."""
    monkeypatch.setattr(lines, "HEAVY", 4)
    monkeypatch.setattr(lines, "SHARD_KEYS", 8)
    monkeypatch.setattr(lines, "ARRAY_BYTES", held)
    texts = ["the very common line\nunique line number %d\nshared line of pair %d" % (i, i // 2) for i in range(60)]
    got = {r.doc_id: r.n_dropped for r in lines.drop_repeated_lines(frame(spark, texts)).collect()}
    assert got == {i: (i > 0) + i % 2 for i in range(60)}


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64))
    mph = lines.PerfectHash.build(keys)
    assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))


def test_packed_shards_answer_documents():
    rng = np.random.default_rng(4)
    high, low = (rng.integers(0, 2**63, 5000).astype(np.uint64) for _ in range(2))
    first, n = rng.integers(0, 10**9, 5000), rng.integers(1, 4, 5000)
    shard = lines.Shard.unpack(lines.Shard.build(high, low, first, n).pack())
    known, owner = shard.owners(high, low)
    assert (known == (n >= 2)).all() and (owner[known] == first[n >= 2]).all()
    assert not shard.owners(high, low ^ np.uint64(1))[0].any()  # the fingerprint tells another key
    empty = lines.Shard.unpack(lines.Shard.build(*[np.zeros(0, np.uint64)] * 2, *[np.zeros(0, np.int64)] * 2).pack())
    assert not empty.owners(high, low)[0].any()


def test_licenses(spark):
    texts = [None, "", "Released under the MIT License. UNDER the mit\nlicense!", "Apache License, Version 2.0 and CC-BY-NC 4.0", "cc by nc cc by nc", "GNU General Public License, version 3.", "commit licensee", "x " * 5000 + "under the mit license"]
    rows = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    assert [(rows[i].n_base, rows[i].first_word, rows[i].last_word, rows[i].base_labels) for i in range(8)] == [(0, None, None, ""), (0, None, None, ""), (2, 1, 5, "mit"), (2, 0, 6, "apache-2,cc-by-nc"), (2, 0, 3, "cc-by-nc"), (0, None, None, ""), (0, None, None, ""), (1, 5000, 5000, "mit")]
    assert rows[5].labels == "gpl-3" and rows[2].score == 1.0 and rows[6].labels == "" and rows[7].n_words == 5004
    assert licenses.scan_licenses(frame(spark, [])).count() == 0


def test_urls(spark):
    given = [None, "", "no scheme", "https://A.b.NET/x", "https://example.net/en/1", "http://q.example.com/de/?x", "https://w.org/fr/a", "https://evil.com/xxx", "https://ok.com/dating/casino", "https://ok.com/dating", "https://ok.com/essex", "HTTP://x.net", "https://h.net#f"]
    rows = urls.judge_urls(spark.createDataFrame(list(enumerate(given)), "page_id long, url string")).orderBy("page_id").collect()
    assert [r.verdict for r in rows] == ["allow", "allow", "allow", "block", "allow", "block", "allow", "block", "block", "allow", "allow", "allow", "allow"]
    assert (rows[3].host, rows[3].path, rows[3].rule, rows[5].path) == ("a.b.net", "/x", "net/", "/de/")


def test_language_model(spark):
    texts = [None, "", "123 !!", "the house"] + ["der Hund und die Katze im Haus ist schön " * 4, "the dog and the cat in the house is nice " * 4] * 20
    rows = [(i, t, None if i < 4 else ("de", "en")[i % 2]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language.identify(docs, language.fit_language(docs)).collect()}
    assert [found[i].lang_pred for i in range(4)] == ["und", "und", "und", "en"]
    assert all(found[i].lang_pred == rows[i][2] and 0 <= found[i].score <= 1 for i in range(4, len(rows)))
    empty = docs.limit(0)
    assert language.identify(docs, language.fit_language(empty)).where("lang_pred <> 'und'").count() == 0


def test_language_holds_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = entry.queries()["op10_language"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_language_model_scores(spark, texts):
    rows = {r.doc_id: r for r in lm.score_documents(frame(spark, texts)).collect()}
    counts = collections.Counter()
    tokens = [(t or "").translate(LOWER).encode().split() + [None] for t in texts]
    for i, t in enumerate(tokens):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(t)
    total, norm = sum(counts.values()), math.log10(sum(counts.values()) + 0.5 * (len(counts) + 1))
    for i, t in enumerate(tokens):
        r = rows[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1) and (r.n_tokens, r.train_tokens) == (len(t), total)
        assert r.n_known == sum(counts[w] > 0 for w in t)
        assert math.isclose(r.base_score, sum(math.log10(counts[w] + 0.5) - norm for w in t), rel_tol=1e-9)
        assert r.score < 0 and (len(t) < 50 or r.bits_per_byte < 8)


def test_decontamination(spark, texts):
    items = [None, "!!", "short ITEM", " ".join((texts[7] or "").split()[20:45]), "one", " ".join((texts[9] or "").split()[:10]), "ñandú Ünïcode"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    split = lambda t: "".join(c if c.isdigit() and ord(c) < 128 or "a" <= c <= "z" or ord(c) > 127 else " " for c in (t or "").translate(LOWER)).split(" ")
    words = lambda t: [w for w in split(t) if w]
    want = {}
    for i, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for j, item in enumerate(items):
            v = words(item)
            n = min(len(v), 10)
            wins = {tuple(v[a : a + n]) for a in range(len(v) - n + 1)} if n else set()
            for s in range(len(w) - n + 1) if n else ():
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    found.add(str(j))
        want[i] = (len(w), len(hit), sorted(found))
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.contamination(frame(spark, texts), bench).collect()}
    assert got == want
    assert decontam.contamination(frame(spark, texts), bench.limit(0)).where("contaminated").count() == 0


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base[:30] + 0.1 * rng.standard_normal((30, 16)), base[:5], 3 * base[:3]]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [1.0, None]), (204, []), (205, [1.0] * 7)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]))
    u = vectors.unit(x)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    comp = brute_components(len(x), list(zip(*[a.tolist() for a in np.nonzero(near)], strict=True)))
    want = {i: (int(near[i].sum()), comp[i]) for i in range(len(x))} | {i: (0, i) for i in range(200, 206)}
    assert {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()} == want
    monkeypatch.setattr(vectors, "CELL", 8)
    assert {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()} == want


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    own = [*texts, "<|endoftext|> text", "a <|endoftext|> b<|endoftext|>", "日本語 😀  \r\n x", "a" * 5000]
    tok = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack(frame(spark, own), window=64).collect()
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(own)}
    seen = collections.defaultdict(list)
    for r in rows:
        part = np.frombuffer(r["ids"], "<u4").tolist()
        assert part == ids[r.doc_id][r.start : r.start + r.length] and zlib.crc32(r["ids"]) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id].append((r.start, r.length))
    assert {d: sum(n for _, n in s) for d, s in seen.items()} == {d: len(v) for d, v in ids.items()}
    fill = collections.defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
    for s in fill.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False))
    sizes = [sum(n for _, n in fill[s]) for s in sorted(fill)]
    assert all(n == 64 for n in sizes[:-1]) and len(sizes) == math.ceil(sum(map(len, ids.values())) / 64)
    assert packing.pack(frame(spark, [])).count() == 0


def test_pieces_stay_in_place_after_coalesce_and_union(spark, texts):
    docs = frame(spark, texts)
    cols = ["doc_id", "start", "sequence_id", "offset", "length"]
    pieces = lambda df: sorted(map(tuple, df.select(*cols).where("doc_id >= 0").collect()))
    held = packing.pack(docs, window=64, keep_ids=False)
    want = pieces(held)
    assert pieces(held.coalesce(1)) == want
    other = spark.range(50).selectExpr("-1L doc_id", "0L start", "0L sequence_id", "0L offset", "0L length").repartition(5)
    assert pieces(other.unionByName(held.select(*cols))) == want
    fill = sorted((s * 64 + o, n) for _, _, s, o, n in want)
    assert all(a + n == b for (a, n), (b, _) in zip(fill, fill[1:], strict=False))


def test_ids_beyond_two_bytes(spark):
    r = packing.pack(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), end_id=70_000).first()
    assert np.frombuffer(r["ids"], "<u4").tolist()[-1] == 70_000


def test_passages(spark, texts):
    words = [(t or "").encode().split() for t in texts]
    low = {}
    for i, w in enumerate(words):
        for j in range(len(w) - 49):
            low.setdefault(tuple(w[j : j + 50]), i)
    want = {}
    for i, w in enumerate(words):
        gone = set()
        for j in range(len(w) - 49):
            if low[tuple(w[j : j + 50])] < i:
                gone |= set(range(j, j + 50))
        kept = [x for j, x in enumerate(w) if j not in gone]
        want[i] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    got = substrings.drop_repeated_passages(frame(spark, texts), digest=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == want
    assert substrings.drop_repeated_passages(frame(spark, [])).count() == 0


def test_a_full_sketch_loses_nothing(spark, texts, monkeypatch):
    wide = {r.doc_id: r.kept for r in substrings.drop_repeated_passages(frame(spark, texts), digest=True).collect()}
    monkeypatch.setattr(substrings, "sketch_width", lambda words, window: substrings.BLOCK)
    monkeypatch.setattr(substrings, "COPIES", 0)
    assert {r.doc_id: r.kept for r in substrings.drop_repeated_passages(frame(spark, texts), digest=True).collect()} == wide


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns
        assert after.select("doc_id").subtract(before.select("doc_id")).count() == 0
        before = after
    assert 0.5 * docs.count() < before.count() < docs.count()
    hits = decontam.contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count()
    assert hits == 0
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.select("doc_id").distinct().count() == before.count()
    assert pieces.agg(F.sum("length")).first()[0] == pieces.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]
