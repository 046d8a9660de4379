"""Line dedup: documents probe a sharded minimal perfect hash, lines are not joined.

1. Each line key becomes a 128-bit hash. Distinct hashes are counted with
   map-side combining: smallest document and number of documents.
2. Hashes are dealt to shards by their leading bits. A shard's keys are placed
   by a multi-level bit-array perfect hash; rank in the bit arrays is the slot.
   Slots index an array of 32-bit fingerprints, an array of counts (saturating
   at 255) and, for repeated keys only, an array of owners (the smallest
   document). A shard is kept as one row of packed arrays, some six bytes a key.
3. While all shards together stay below ARRAY_BYTES, which is measured, they
   are broadcast, and documents probe them as they are rewritten, in one pass
   that shuffles no text. Beyond, documents send (hash, id) probes to the task
   that holds the shard, and hot keys (more than 1/HEAVY of all lines, so fewer
   than HEAVY of them, whatever the input) are answered from a broadcast, so
   that no shard is hot; texts then meet what they lose by id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postforge.session import cut, shuffle_partitions

#: Shortest key, in code points, that can be dropped.
MIN_POINTS = 10
#: A key with more than 1/HEAVY of all lines is answered from a broadcast.
HEAVY = 2000
#: Keys that a shard is sized for.
SHARD_KEYS = 250_000
#: Packed arrays of all shards that a broadcast may hold; beyond, probes go to the shards.
ARRAY_BYTES = 64 << 20
#: Bits per key of each level of the perfect hash.
GAMMA = 2.0


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def is_long(key: bytes, points: int = MIN_POINTS) -> bool:
    return len(key) >= points and (key.isascii() or len(key.decode(errors="replace")) >= points)


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys: bit arrays by level, each
    with the number of bits set before every 64-bit word. Levels go by the high
    halves; keys that no level parts, such as those of one high half, are kept
    whole, sorted, as pairs of halves in ``rest``."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, rest: np.ndarray):
        self.sizes, self.words, self.rest = sizes, words, rest
        self.first = np.cumsum([0, *((sizes + 63) // 64)])
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.uint32)]).astype(np.uint32)

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, low: np.ndarray | None = None, depth: int = 40) -> PerfectHash:
        sizes, words = [], []
        low = np.zeros(len(keys), np.uint64) if low is None else low
        for level in range(depth):
            if not len(keys):
                break
            size = max(64, int(GAMMA * len(keys)))
            at = cls._at(keys, level, size)
            alone = np.bincount(at, minlength=-(-size // 64) * 64) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys, low = keys[~alone[at]], low[~alone[at]]
        order = np.lexsort((low, keys))
        rest = np.stack([keys[order], low[order]], axis=1).astype("<u8").reshape(-1)
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, "<u8"), rest)

    def slots(self, keys: np.ndarray, low: np.ndarray | None = None) -> np.ndarray:
        """The slot of each key of the set; any slot or -1 for others."""
        low = np.zeros(len(keys), np.uint64) if low is None else low
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self._at(keys[left], level, int(size))
            word, bit = (at >> 6) + self.first[level], (at & 63).astype(np.uint64)
            own = self.words[word]
            hit = (own >> bit) & np.uint64(1) > 0
            below = np.bitwise_count(own[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = self.before[word[hit]] + below
            left = left[~hit]
            if not len(left):
                return out
        if len(self.rest):
            pairs = self.rest.reshape(-1, 2)
            at = np.searchsorted(pairs[:, 0], keys[left])
            while len(left):  # once for each key of the longest run of one high half
                inside = np.minimum(at, len(pairs) - 1)
                same = (at < len(pairs)) & (pairs[inside, 0] == keys[left])
                hit = same & (pairs[inside, 1] == low[left])
                out[left[hit]] = int(self.before[-1]) + at[hit]
                left, at = left[same & ~hit], at[same & ~hit] + 1
        return out

    def __len__(self) -> int:
        return int(self.before[-1]) + len(self.rest) // 2


class Shard:
    """Fingerprint, count and owner arrays behind a perfect hash."""

    def __init__(self, mph: PerfectHash, fingerprint: np.ndarray, count: np.ndarray, owner: np.ndarray):
        self.mph, self.fingerprint, self.count, self.owner = mph, fingerprint, count, owner
        # repeated keys before every 64th slot; those in between are counted when asked
        repeated = np.zeros(-(-len(count) // 64) * 64, bool)
        repeated[: len(count)] = count >= 2
        self.repeated = np.packbits(repeated, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.repeated), dtype=np.uint32)]).astype(np.uint32)

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray, first: np.ndarray, count: np.ndarray) -> Shard:
        mph = PerfectHash.build(high, low)
        at = mph.slots(high, low)
        if len(np.unique(at)) != len(at) or (at < 0).any():
            raise ValueError("two line hashes share a slot: keys of a shard must be distinct")
        fingerprint, counts, owner = np.zeros(len(mph), "<u4"), np.zeros(len(mph), np.uint8), np.zeros(len(mph), "<i8")
        fingerprint[at], counts[at], owner[at] = low.astype("<u4"), np.minimum(count, 255), first
        return cls(mph, fingerprint, counts, owner[counts >= 2])

    def pack(self) -> bytes:
        parts = [self.mph.sizes, self.mph.words, self.mph.rest, self.fingerprint, self.count, self.owner]
        return np.array([len(p) for p in parts], "<i8").tobytes() + b"".join(p.tobytes() for p in parts)

    @classmethod
    def unpack(cls, data: bytes) -> Shard:
        sizes, at, parts = np.frombuffer(data, "<i8", 6), 48, []
        for n, kind in zip(sizes.tolist(), ("<i8", "<u8", "<u8", "<u4", "<u1", "<i8"), strict=True):
            parts.append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
        return cls(PerfectHash(*parts[:3]), *parts[3:])

    def owners(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is a key of at least two documents, its smallest document)."""
        at = self.mph.slots(high, low)
        known, found = at >= 0, np.zeros(len(high), np.int64)
        at = np.where(known, at, 0)
        if len(self.count):
            known &= (self.fingerprint[at] == low.astype("<u4")) & (self.count[at] >= 2)
        at = at[known]
        rank = self.before[at >> 6] + np.bitwise_count(self.repeated[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
        found[known] = self.owner[rank]
        return known, found


def shard_of(high: np.ndarray, bits: int) -> np.ndarray:
    """The shard of unsigned hashes: their leading bits."""
    return (high >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(high), np.int64)


def _shard_column(bits: int) -> F.Column:
    return F.shiftrightunsigned("high", 64 - bits).cast("int") if bits else F.lit(0)


def _hashed(texts: list[bytes], points: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lines of each text, text and line number, high and low hash of every long key)."""
    every, text_at, line_at, digests = [], [], [], []
    for i, text in enumerate(texts):
        found = text.split(b"\n")
        every.append(found)
        for j, line in enumerate(found):
            if len(line) >= points and is_long(key := line_key(line), points):
                text_at.append(i)
                line_at.append(j)
                digests.append(key_hash(key))
    two = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return every, np.array(text_at, np.int64), np.array(line_at, np.int64), np.ascontiguousarray(two[:, 0]), np.ascontiguousarray(two[:, 1])


def _line_rows(points: int):
    """(id, text) to distinct (high, low, id) of each document's long keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, doc, _, high, low = _hashed([t.as_py() or b"" for t in batch.column(1)], points)
            order = np.lexsort((low, high, doc))
            doc, high, low = doc[order], high[order], low[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (high[1:] != high[:-1]) | (low[1:] != low[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(high[new].view(np.int64)), pa.array(low[new].view(np.int64)), batch.column(0).take(pa.array(doc[new]))], names=["high", "low", "id"])

    return run


def line_keys(source: DataFrame, points: int = MIN_POINTS) -> DataFrame:
    """``source`` (id long, text binary) to one row for each distinct key:
    (high, low, first document, n: 1, or 2 and more for several documents)."""
    keys = source.mapInArrow(_line_rows(points), "high long, low long, id long").groupBy("high", "low").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
    return cut(keys.select("high", "low", "first", F.when(F.col("first") == F.col("last"), 1).otherwise(F.greatest(F.col("n"), F.lit(2))).cast("long").alias("n"), F.col("n").alias("rows")))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys sorted by shard (shard, high, low, first, n) to (shard, packed arrays)."""

    def done(shard: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        high, low, first, n = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in range(1, 5))
        data = Shard.build(high.view(np.uint64), low.view(np.uint64), first, n).pack()
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([data], pa.binary())], names=["shard", "arrays"])

    now, held = None, []
    for batch in batches:
        s = batch.column(0).to_numpy()
        edges = np.concatenate([[0], np.nonzero(s[1:] != s[:-1])[0] + 1, [len(s)]]) if len(s) else np.zeros(1, int)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if held and s[a] != now:
                yield done(now, held)
                held = []
            now = int(s[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield done(now, held)


def line_shards(keys: DataFrame, distinct: int) -> tuple[DataFrame, int]:
    """((shard, arrays binary) of the keys, number of leading hash bits that name a shard)."""
    bits = max(0, math.ceil(math.log2(max(distinct, 1) / SHARD_KEYS)))
    rows = keys.select(_shard_column(bits).alias("shard"), "high", "low", "first", "n")
    parts = min(1 << bits, 16 * shuffle_partitions(keys.sparkSession))
    return cut(rows.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(_build, "shard int, arrays binary")), bits


# --- probes beyond the broadcast ------------------------------------------------


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, arrays, high, low, id) sorted by shard, the arrays ahead of
    the probes, to the (id, high, low) to drop."""
    now, own = None, None
    for batch in batches:
        s = batch.column(0).to_numpy()
        edges = np.concatenate([[0], np.nonzero(s[1:] != s[:-1])[0] + 1, [len(s)]]) if len(s) else np.zeros(1, int)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part = batch.slice(a, b - a)
            if s[a] != now:
                now, own = s[a], Shard.unpack(part.column(1)[0].as_py())
                part = part.slice(1)
            high, low, ids = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3, 4))
            known, owner = own.owners(high.view(np.uint64), low.view(np.uint64))
            drop = known & (owner != ids)
            if drop.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[drop]) for x in (ids, high, low)], names=["id", "high", "low"])


def routed_drops(source: DataFrame, keys: DataFrame, shards: DataFrame, bits: int, points: int) -> DataFrame:
    """(id, drops array<struct<high, low>>): probes go to the shards."""
    total = keys.agg(F.sum("rows")).first()[0] or 0
    heavy = cut(keys.where((F.col("rows") * HEAVY > total) & (F.col("rows") >= HEAVY)).select("high", "low", "first", "n"))
    lines = source.mapInArrow(_line_rows(points), "high long, low long, id long")
    marked = lines.join(F.broadcast(heavy), ["high", "low"], "left")  # fewer than HEAVY rows, whatever the input
    here = marked.where("n >= 2 and first <> id").select("id", "high", "low")
    none = F.lit(None)
    asks = marked.where("n is null").select(_shard_column(bits).alias("shard"), none.cast("binary").alias("arrays"), "high", "low", "id")
    held = shards.select("shard", "arrays", *[none.cast("long").alias(c) for c in ("high", "low", "id")])
    rows = held.unionByName(asks).repartition("shard").sortWithinPartitions("shard", F.col("arrays").isNull())
    drops = rows.mapInArrow(_probe, "id long, high long, low long").unionByName(here)
    return drops.groupBy("id").agg(F.collect_set(F.struct("high", "low")).alias("drops"))


# --- rewriting ------------------------------------------------------------------


def _rewritten(every: list[list[bytes]], gone: dict[int, set[int]], whole: bool) -> list[pa.Array]:
    lines = [len(x) for x in every]
    kept = [[x for j, x in enumerate(found) if j not in gone[i]] if i in gone else found for i, found in enumerate(every)]
    out = [b"\n".join(x) for x in kept]
    last = pa.array(out, pa.binary()).cast(pa.string()) if whole else pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string())
    return [pa.array(lines, pa.int64()), pa.array([n - len(x) for n, x in zip(lines, kept, strict=True)], pa.int64()), last]


_NAMES = ["id", "n_lines", "n_dropped", "kept"]


def _rewrite_probing(shared, bits: int, points: int, whole: bool):
    """(row, text, key) to (row, n_lines, n_dropped, kept), probing the broadcast shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = {s: Shard.unpack(data) for s, data in shared.value}
        for batch in batches:
            every, doc, line, high, low = _hashed([t.as_py() or b"" for t in batch.column(1)], points)
            own = batch.column(2)
            ids, named = own.fill_null(0).to_numpy(zero_copy_only=False)[doc], own.is_valid().to_numpy(zero_copy_only=False)[doc]
            gone: dict[int, set[int]] = {}
            shard = shard_of(high, bits)
            order = np.argsort(shard, kind="stable")
            for at in np.split(order, np.nonzero(np.diff(shard[order]))[0] + 1):
                if len(at) and (held := shards.get(int(shard[at[0]]))):
                    known, owner = held.owners(high[at], low[at])
                    drop = at[known & named[at] & (owner != ids[at])]
                    for i, j in zip(doc[drop].tolist(), line[drop].tolist(), strict=True):
                        gone.setdefault(i, set()).add(j)
            yield pa.RecordBatch.from_arrays([batch.column(0), *_rewritten(every, gone, whole)], names=_NAMES)

    return run


def _rewrite_joined(points: int, whole: bool):
    """(row, text, drops) to (row, n_lines, n_dropped, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drops = [{(d["high"], d["low"]) for d in x or ()} for x in batch.column(2).to_pylist()]
            every, doc, line, high, low = _hashed([t.as_py() or b"" for t in batch.column(1)], points)
            gone: dict[int, set[int]] = {}
            for i, j, *key in zip(doc.tolist(), line.tolist(), high.view(np.int64).tolist(), low.view(np.int64).tolist(), strict=True):
                if drops[i] and tuple(key) in drops[i]:
                    gone.setdefault(i, set()).add(j)
            yield pa.RecordBatch.from_arrays([batch.column(0), *_rewritten(every, gone, whole)], names=_NAMES)

    return run


def _rewrite(docs: DataFrame, row: F.Column, id_col: str, text_col: str, points: int, whole: bool) -> DataFrame:
    """(id: ``row``, n_lines, n_dropped, kept) of every row."""
    text, key = F.col(text_col).cast("binary").alias("text"), F.col(id_col).cast("long")
    source = docs.where(F.col(id_col).isNotNull()).select(key.alias("id"), text)
    keys = line_keys(source, points)
    distinct = keys.count()
    shards, bits = line_shards(keys, distinct)
    rows = docs.select(row.alias("id"), text, key.alias("k"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_lines long, n_dropped long, kept string"
    if (shards.agg(F.sum(F.length("arrays"))).first()[0] or 0) <= ARRAY_BYTES:
        held = [(r.shard, bytes(r.arrays)) for r in shards.toLocalIterator()]  # ARRAY_BYTES at most
        shared = docs.sparkSession.sparkContext.broadcast(held)
        return rows.mapInArrow(_rewrite_probing(shared, bits, points, whole), schema)
    drops = routed_drops(source, keys, shards, bits, points).withColumnRenamed("id", "k")
    return rows.join(drops, "k", "left").select("id", "text", "drops").mapInArrow(_rewrite_joined(points, whole), schema)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, points: int = MIN_POINTS) -> DataFrame:
    """(id, n_lines, n_dropped, kept): each row's text without the lines whose
    key a smaller document holds. ``digest``: its SHA-256 instead of the text.

    Ids are integers. Null or empty text is one empty line. A null id keeps all
    its lines. Rows that repeat an id are one document. Keys of fewer than
    ``points`` code points are never dropped.
    """
    return _rewrite(docs, F.col(id_col), id_col, text_col, points, not digest).withColumnRenamed("id", id_col)


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, every column and row of it, with the kept lines as text (a
    null text stays null if it has nothing to lose: its one line is empty)."""
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(F.col(text_col).isNotNull().alias("held"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)])
    out = _rewrite(docs, row, id_col, text_col, MIN_POINTS, True)
    text = F.when(F.col("id.held"), F.col("kept"))
    return out.select(*[text.alias(c) if c == text_col else F.col(f"id.c{others.index(c)}").alias(c) for c in docs.columns])
