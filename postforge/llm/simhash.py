"""SimHash near-duplicate groups by covering locality-sensitive hashing.

Every fingerprint bit gets a non-zero code of radius+1 bits. For each non-zero
vector v of as many bits, a table keeps the bits whose code has odd overlap
with v. Any ``radius`` differing bits leave some v orthogonal to all their
codes, so two fingerprints within the radius agree in at least one table:
candidate search has no false negatives.

Equal fingerprints are collapsed before the search, so exact copies cost one
row however many there are. A bucket of more than about BUCKET distinct fingerprints
is dealt again by the same construction over the bits its table left out; one
that is still larger is cut into pairs of blocks. Buckets yield spanning
forests, never all pairs.

Near copies are told by the Jaccard similarity of shingles itself: candidates
share a band of MinHashes, and every link is confirmed on the whole sets.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postforge.operators.graph import connected_components, spanning_forest
from postforge.session import cut

BITS = 64
#: Distinct fingerprints that one task compares within one bucket.
BUCKET = 16384
#: One fingerprint in so many is counted to tell hot buckets.
SAMPLE = 16
#: Rows compared at a time against a whole bucket.
BLOCK = 128
#: Shingle sets that one task compares within one bucket.
CELL = 2048
#: Hot buckets that a broadcast may hold; beyond, they are joined by shuffle.
HOT_ROWS = 200_000
SEED = 42
#: Of the order in which codes are dealt to bits (a test asserts the least mask).
CODE_SEED = 55


#: Bands and MinHashes a band: a pair of Jaccard similarity s shares no band with
#: chance (1 - s ** ROWS) ** BANDS, which is 7e-5 at 0.8 and 1e-9 at 0.9.
BANDS, ROWS = 24, 5
_MIX = np.random.default_rng(SEED).integers(1, 2**64, (4, BANDS * ROWS), np.uint64) | np.uint64(1)


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of the k-word shingles of a lower-cased text, repeats included."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a:b], SEED) for a, b in zip(starts[: n - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)]
    return np.array(found, np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; none: zero."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 4096):
        part = np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(id, fp long): the fingerprint of each whole text. Null or blank text: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = [fingerprint(shingle_hashes(t.as_py() or b"", k)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["id", "fp"])

    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return ids.mapInArrow(run, f"id {dict(ids.dtypes)['id']}, fp long")


def masks(bits: list[int], radius: int) -> list[int]:
    """Covering masks over the given bit positions, as unsigned integers. Codes
    are dealt in a fixed shuffled order, so that every mask keeps about half of
    the bits, also where there are more codes than bits."""
    codes = list(range(1, 2 ** (radius + 1)))
    random.Random(CODE_SEED).shuffle(codes)
    return [sum(1 << b for i, b in enumerate(bits) if (codes[i % len(codes)] & v).bit_count() % 2) for v in range(1, len(codes) + 1)]


def _rows(t: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(t.astype(np.int64)), pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], names=["t", "key", "fp"])


def _first_keys(radius: int):
    """(fp) to (t, key, fp): the bucket of each table."""
    table = np.array(masks(list(range(BITS)), radius), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(fps), 1024):
                fp = np.repeat(fps[i : i + 1024], len(table))
                t = np.tile(np.arange(len(table)), len(fp) // len(table))
                yield _rows(t, fp & table[t], fp)

    return run


def _second_keys(radius: int):
    """(t, fp) to (t', key, fp): a hot bucket's table dealt again over the bits it left out."""
    first = masks(list(range(BITS)), radius)
    table = np.array([[m | x for x in masks([b for b in range(BITS) if not m >> b & 1], radius)] for m in first], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = table.shape[1]
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                t, fp = np.repeat(batch.column(0).to_numpy()[i : i + 1024], n), np.repeat(batch.column(1).to_numpy()[i : i + 1024].view(np.uint64), n)
                s = np.tile(np.arange(n), len(t) // n)
                yield _rows((t + 1) * 1000 + s, fp & table[t, s], fp)

    return run


def links_within(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (positions) of the pairs within the radius."""
    left, right = [], []
    for i in range(0, len(fps), BLOCK):
        near = np.bitwise_count(fps[i : i + BLOCK, None] ^ fps[None, :]) <= radius
        a, b = np.nonzero(near)
        keep = a + i < b
        a, b = a[keep] + i, b[keep]
        if len(a):  # a forest of the block's own links, so that a dense bucket stays small
            a, b = spanning_forest(a, b)
            left.append(a)
            right.append(b)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return spanning_forest(np.concatenate(left), np.concatenate(right))


def _bucket_links(radius: int):
    """Rows (t, key, fp) sorted by (t, key) to links (a, b) of fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

        def solve(t: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.concatenate([[True], (t[1:] != t[:-1]) | (key[1:] != key[:-1])])
            starts = np.append(np.nonzero(new)[0], len(t))
            sizes = np.diff(starts)
            lo, hi = [], []
            two = starts[:-1][sizes == 2]  # the common case, without a loop
            near = np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= radius
            lo.append(fp[two][near])
            hi.append(fp[two + 1][near])
            for i in np.nonzero(sizes > 2)[0]:
                own = fp[starts[i] : starts[i + 1]]
                a, b = links_within(own.view(np.uint64), radius)
                lo.append(own[a])
                hi.append(own[b])
            a, b = np.concatenate(lo), np.concatenate(hi)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t, key, fp = (np.concatenate([x, c.to_numpy()]) for x, c in zip(last, batch.columns, strict=True))
            end = np.nonzero((t != t[-1]) | (key != key[-1]))[0]
            cutoff = end[-1] + 1 if len(end) else 0  # the last bucket may go on in the next batch
            if cutoff:
                yield from solve(t[:cutoff], key[:cutoff], fp[:cutoff])
            last = (t[cutoff:], key[cutoff:], fp[cutoff:])
        if len(last[0]):
            yield from solve(*last)

    return run


def _in_cells(rows: DataFrame) -> DataFrame:
    """(t, key, fp): buckets of more than BUCKET rows cut into pairs of blocks,
    each a bucket of its own, so that every pair of a bucket meets in one."""
    big = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("t", "key", F.ceil(F.col("n") / (BUCKET // 2)).alias("blocks"))
    side = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    met = rows.join(big, ["t", "key"]).select("t", "key", "fp", side.alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    cell = F.least("side", "other") * (1 << 20) + F.greatest("side", "other") + 1
    cells = met.select((F.col("t") + cell * (1 << 20)).alias("t"), "key", "fp")
    return rows.join(big, ["t", "key"], "left_anti").select("t", "key", "fp").unionByName(cells)


def fingerprint_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """``fps``: one long column of distinct fingerprints. (a, b): links whose
    components are those of all pairs within the radius."""
    schema = "t long, key long, fp long"
    fps = fps.select(F.col(fps.columns[0]).cast("long").alias("fp"))
    keyed = fps.mapInArrow(_first_keys(radius), schema)
    # hot buckets are told from one fingerprint in SAMPLE: it only decides how a bucket is dealt, not what is found
    some = fps.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0).mapInArrow(_first_keys(radius), schema)
    hot = cut(some.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET // SAMPLE).select("t", "key"))
    n_hot = hot.count()
    if n_hot:
        met = F.broadcast(hot) if n_hot <= HOT_ROWS else hot
        again = keyed.join(met, ["t", "key"]).select("t", "fp").mapInArrow(_second_keys(radius), schema)
        again = _in_cells(cut(again))
        keyed = keyed.join(met, ["t", "key"], "left_anti").select("t", "key", "fp").unionByName(again)
    rows = keyed.repartition("t", "key").sortWithinPartitions("t", "key")
    return rows.mapInArrow(_bucket_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 3) -> DataFrame:
    """(id, fp long, component_id, kept): documents grouped by fingerprint
    links of at most ``radius`` differing bits. Documents with a null id are
    left out, repeated rows give repeated rows, other columns are ignored.
    """
    marked = cut(fingerprints(docs.where(F.col(id_col).isNotNull()), id_col, text_col, k))
    classes = cut(marked.groupBy("fp").agg(F.min("id").alias("first")))
    links = fingerprint_links(classes.select("fp"), radius)
    reach = connected_components(links)
    named = classes.join(reach, classes["fp"] == reach["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    lowest = cut(named.groupBy("c").agg(F.min("first").alias("component_id")))  # a table of its own: the join can split a large component
    final = named.join(lowest, "c").select("fp", "component_id")
    out = marked.join(final, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A MinHash key for each band, of distinct shingle hashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    x = shingles.astype(np.uint64)
    for i in range(0, len(x), 1024):
        np.minimum(low, (_MIX[0][:, None] * x[i : i + 1024] + _MIX[1][:, None]).min(axis=1), out=low)
    return ((low >> np.uint64(7)) * _MIX[2]).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64) + _MIX[3][:BANDS]


def _signed(k: int):
    """(id, text) to (id, c, keys, s): the sorted distinct shingle hashes, four
    bytes each, a hash of them that names the class, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py() or b"", k) >> np.uint64(32)).astype("<u4") for t in batch.column(1)]
            held = [s.tobytes() for s in sets]
            names = np.fromiter((xxhash.xxh3_64_intdigest(s) for s in held), np.uint64, len(held)).view(np.int64)
            keys = np.concatenate([band_keys(s) for s in sets] or [np.zeros(0, np.uint64)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1, dtype=np.int32) * BANDS), pa.array(keys))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), lists, pa.array(held, pa.binary())], names=["id", "c", "keys", "s"])

    return run


def shared_buckets(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((c, first): each class and its smallest id, (key, c, lo, hi, n): the
    classes of each bucket of more than one, its ends and its size)."""
    classes = cut(signed.groupBy("c").agg(F.min("id").alias("first"), F.first("keys").alias("keys")))
    buckets = classes.select("c", F.explode("keys").alias("key"))
    met = buckets.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("n > 1")
    return classes.select("c", "first"), cut(buckets.join(met, "key").select("key", "c", "lo", "hi", "n"))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(id, c long, keys, s): the shingle class of each text and its band keys."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return cut(rows.mapInArrow(_signed(words), f"id {dict(rows.dtypes)['id']}, c long, keys array<long>, s binary"))


def _confirmed(similarity: float):
    """(a, b, s, r) to (a, b) where the sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for s, r in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(s.as_py(), "<u4"), np.frombuffer(r.as_py(), "<u4")
                both = len(np.intersect1d(a, b, assume_unique=True))
                near.append(both >= similarity * (len(a) + len(b) - both))
            mask = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def set_links(sets: list[np.ndarray], group: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) that join all sets of a similar pair, beside those of one group."""
    sizes = np.array([len(s) for s in sets])
    values, rows = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    group, left, right = group.copy(), [], []
    for i, s in enumerate(sets):
        if (group == group[0]).all():
            break
        lo, n = np.searchsorted(values, s), np.searchsorted(values, s, "right")
        n -= lo
        hit = rows[np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)]
        both = np.bincount(hit, minlength=len(sets))
        near = both >= similarity * (sizes + sizes[i] - both)
        for other in np.unique(group[near & (group != group[i])]):
            left.append(i)
            right.append(int(np.nonzero(near & (group == other))[0][0]))
            group[group == other] = group[i]
    return np.array(left, np.int64), np.array(right, np.int64)


def _cell_links(similarity: float):
    """Rows (key, i, j, c, r, s) sorted by (key, i, j) to links (a, b) of classes."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        c, r = (np.array([x[k] for x in held], np.int64) for k in (3, 4))
        a, b = set_links([np.frombuffer(x[5], "<u4") for x in held], r, similarity)
        return pa.RecordBatch.from_arrays([pa.array(c[a]), pa.array(c[b])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return run


def near_copy_links(signed: DataFrame, shared: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links whose components are those of all pairs of classes that
    share a bucket and are similar enough.

    Every class is first held against both ends of its buckets. Pairs of a
    bucket of more than three classes that are not of one component by then
    are compared whole; a large bucket is cut into pairs of blocks.
    """
    # one row a class first, where copies meet in a partial aggregate, then those with company
    sets = cut(signed.groupBy("c").agg(F.first("s").alias("s")).join(shared.select("c").distinct(), "c", "left_semi"))
    ends = F.explode(F.array("lo", "hi")).alias("e")
    pairs = shared.select("c", ends).where("c <> e").select(F.least("c", "e").alias("a"), F.greatest("c", "e").alias("b")).distinct()
    both = pairs.join(sets.select(F.col("c").alias("a"), "s"), "a").join(sets.select(F.col("c").alias("b"), F.col("s").alias("r")), "b")
    links = cut(both.select("a", "b", "s", "r").mapInArrow(_confirmed(similarity), "a long, b long"))
    at = shared.where("n > 3").join(connected_components(links), F.col("c") == F.col("node"), "left").select("key", "c", F.coalesce("component", "c").alias("r"))
    at = cut(at)
    mixed = at.groupBy("key").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    mixed = mixed.select("key", F.when(F.col("n") > CELL, F.ceil(F.col("n") / (CELL // 2))).otherwise(1).alias("blocks"))
    side = F.pmod(F.xxhash64("c"), F.col("blocks"))
    dealt = at.join(mixed, "key").select("key", "c", "r", side.alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    cells = dealt.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "c", "r").join(sets, "c").select("key", "i", "j", "c", "r", "s")
    more = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_cell_links(similarity), "a long, b long")
    return links.unionByName(more)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, kept_id): documents to drop, each with the smallest document of its
    group, which stays.

    A group is a component of the links between documents whose
    ``words``-word shingles have the given Jaccard similarity or more.
    Candidates share a band of MinHashes of these shingles. Texts of the same
    shingles are one class throughout; no group is gathered.
    """
    signed = signatures(docs, id_col, text_col, words)
    classes, shared = shared_buckets(signed)
    reach = connected_components(near_copy_links(signed, shared, similarity))
    named = classes.join(reach, F.col("c") == F.col("node"), "left").select("c", "first", F.coalesce("component", "c").alias("g"))
    lowest = cut(named.groupBy("g").agg(F.min("first").alias("kept_id")))  # a table of its own: the join can split a large group
    final = named.join(lowest, "g").select("c", "kept_id")
    return signed.select("id", "c").join(final, "c").where("id <> kept_id").select(F.col("id").alias(id_col), "kept_id").distinct()


def hex_fingerprint(fp: str) -> F.Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


__all__ = ["fingerprint_links", "fingerprints", "hex_fingerprint", "masks", "near_copies", "near_duplicates"]
