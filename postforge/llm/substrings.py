"""Repeated-passage removal behind a count-min prefilter.

A window of WINDOW words holds, at a place that only its words decide, one
anchor: the smallest hash of its half-window sub-windows. A window is in two
documents only if its anchor is, so an anchor's count bounds the window's from
above and there are over ten times fewer anchors than windows. Each partition
counts its anchors (once a document) in a two-row count-min sketch that
saturates at two; partition sketches are merged block by block. Windows whose
merged estimate is two or more, a superset of the repeated ones, are then
grouped exactly by 128-bit hashes; nothing is lost, a full sketch only costs
more rows in that second pass.

Copies of whole documents are settled by one hash each before any window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postforge.session import cut

WINDOW = 50
#: Rows of the sketch and its least and greatest width (cells of a row); two bits a cell.
DEPTH, LEAST, MOST = 2, 2**20, 2**29
#: Cells per anchor expected.
ROOM = 4
#: Cells of a block of the sketch.
BLOCK = 1 << 16
#: Distinct words whose hash a worker remembers.
CACHE = 200_000
#: Ids of whole copies that a broadcast may hold; beyond, they are joined by shuffle.
COPIES = 500_000
#: Documents hashed together.
GROUP = 128

_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 2**64)
_ODD2 = 0xD6E8FEB86659FD93
_INV2 = pow(_ODD2, -1, 2**64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    found = _POWERS.get((base, 0))
    if found is None or len(found) < n:
        found = np.full(max(n, 1 << 16), base, np.uint64)
        found[0] = 1
        found = _POWERS[(base, 0)] = np.cumprod(found, dtype=np.uint64)
    return found[:n]


def rolling(words: np.ndarray, k: int, base: int = _ODD, inverse: int = _INV) -> np.ndarray:
    """Hash of every k consecutive word hashes."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _powers(base, n), out=sums[1:])
    return _mix((sums[k:] - sums[:-k]) * _powers(inverse, n - k + 1))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, in log2(w) passes."""
    n, span = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[w - span : w - span + n])


def anchors(words: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The anchor of every window."""
    half = window // 2
    return sliding_min(rolling(words, half), window - half + 1)


def _split(texts: list[bytes | None], known: _Hashes) -> tuple[list[int], np.ndarray]:
    """Word counts of the texts and the hashes of all their words, end to end."""
    sizes, out = [], []
    for t in texts:
        words = (t or b"").split()
        sizes.append(len(words))
        out.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
    return sizes, np.concatenate(out) if out else np.zeros(0, np.uint64)


def _windows(sizes: list[int], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, start in the joined words) of all whole windows."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    n = np.maximum(np.array(sizes, np.int64) - window + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), n)
    first = np.cumsum(n) - n
    return doc, np.arange(n.sum()) - first[doc] + starts[doc]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, GROUP):
            yield batch.slice(i, GROUP)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, n_words, high, low) of the word sequence."""
    for batch in batches:
        digest = [(len(w), xxhash.xxh3_128_digest(b" ".join(w))) for w in ((t.as_py() or b"").split() for t in batch.column(1))]
        two = np.frombuffer(b"".join(d for _, d in digest), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in digest], pa.int64()), pa.array(np.ascontiguousarray(two[:, 0])), pa.array(np.ascontiguousarray(two[:, 1]))], names=["id", "n_words", "high", "low"])


def cells(values: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each value in each row of the sketch."""
    mask = np.uint64(width - 1)
    return [((values ^ (values >> np.uint64(31))) * np.uint64(2 * r + 0x9FB21C651E98DF25) >> np.uint64(29)) & mask for r in range(DEPTH)]


def _sketch(window: int, width: int):
    """(id, text) to the partition's sketch as rows (block, cells binary):
    two-byte cell offsets, first those counted once, then those counted twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        once, twice = (np.zeros(DEPTH * width // 8, np.uint8) for _ in range(2))
        for batch in _groups(batches):
            sizes, words = _split(batch.column(1).to_pylist(), known)
            doc, at = _windows(sizes, window)
            if not len(doc):
                continue
            own = anchors(words, window)[at]
            change = np.concatenate([[True], (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])])
            pairs = np.unique(np.rec.fromarrays([own[change], doc[change]]))  # once a document
            for r, cell in enumerate(cells(pairs.f0, width)):
                cell, n = np.unique(cell.astype(np.int64) + r * width, return_counts=True)
                byte, bit = cell >> 3, np.left_shift(1, cell & 7).astype(np.uint8)
                again = (n > 1) | ((once[byte] & bit) > 0)
                np.bitwise_or.at(twice, byte[again], bit[again])
                np.bitwise_or.at(once, byte, bit)
        per = BLOCK // 8
        blocks, blobs = [], []
        for b in range(len(once) // per):
            part = once[b * per : (b + 1) * per]
            if part.any():
                double = twice[b * per : (b + 1) * per]
                one, two = (np.nonzero(np.unpackbits(x, bitorder="little"))[0].astype("<u2") for x in (part & ~double, double))
                blocks.append(b)
                blobs.append(len(one).to_bytes(4, "little") + one.tobytes() + two.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(blobs, pa.binary())], names=["block", "cells"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partition sketches sorted by block to (block, bits of cells counted twice)."""
    now, count = None, np.zeros(BLOCK, np.uint8)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(count >= 2, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    for batch in batches:
        for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if block != now:
                if now is not None:
                    yield out()
                now, count = block, np.zeros(BLOCK, np.uint8)
            n = int.from_bytes(blob[:4], "little")
            offsets = np.frombuffer(blob, "<u2", offset=4)
            count[offsets[n:]] = 2
            one = offsets[:n]
            count[one] = np.minimum(count[one] + 1, 2)
    if now is not None:
        yield out()


def sketch_width(words: int, window: int) -> int:
    """ROOM cells per expected anchor (two in window - window/2 + 2 words), a power of two within bounds."""
    expected = ROOM * words * 2 / (window - window // 2 + 2)
    return 1 << min(MOST.bit_length() - 1, max(LEAST.bit_length() - 1, int(np.ceil(np.log2(max(expected, 1))))))


def _candidates(window: int, width: int, shared):
    """(id, text) to (high, low, id, pos) of the windows estimated repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in _groups(batches):
            sizes, words = _split(batch.column(1).to_pylist(), known)
            doc, at = _windows(sizes, window)
            if not len(doc):
                continue
            own = anchors(words, window)[at]
            likely = np.ones(len(own), bool)
            for r, cell in enumerate(cells(own, width)):
                cell = cell.astype(np.int64) + r * width
                likely &= (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0
            if not likely.any():
                continue
            doc, at = doc[likely], at[likely]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            high, low = rolling(words, window)[at], rolling(words, window, _ODD2, _INV2)[at]
            ids = batch.column(0).to_numpy()[doc]
            yield pa.RecordBatch.from_arrays([pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(ids), pa.array((at - starts[doc]).astype(np.int32))], names=["high", "low", "id", "pos"])

    return run


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """((id) of documents whose whole word sequence a smaller document has,
    (id, pos array) of the window starts that a smaller document holds)."""
    spark = docs.sparkSession
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    whole = cut(source.mapInArrow(_whole, "id long, n_words long, high long, low long").where(F.col("n_words") >= window))
    first = whole.groupBy("high", "low").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = cut(whole.join(first, ["high", "low"]).where("id > first").select("id").distinct())
    few = copies.count() <= COPIES
    unique = source.join(F.broadcast(copies) if few else copies, "id", "left_anti")
    width = sketch_width(whole.agg(F.sum("n_words")).first()[0] or 0, window)
    sketch = unique.select("id", "text").mapInArrow(_sketch(window, width), "block int, cells binary")
    merged = sketch.repartition("block").sortWithinPartitions("block").mapInArrow(_merge, "block int, bits binary")
    bits = bytearray(DEPTH * width // 8)  # at most DEPTH * MOST / 8 bytes, whatever the input
    for row in merged.toLocalIterator():
        bits[row.block * BLOCK // 8 : (row.block + 1) * BLOCK // 8] = row.bits
    shared = spark.sparkContext.broadcast(bytes(bits))
    found = cut(unique.select("id", "text").mapInArrow(_candidates(window, width, shared), "high long, low long, id long, pos int"))
    lowest = cut(found.groupBy("high", "low").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("high", "low", "first"))
    # a table of its own is joined, so that a common window's rows can be split
    places = found.join(lowest, ["high", "low"]).where("id > first").groupBy("id").agg(F.collect_list("pos").alias("pos"))
    return copies, places


def covered(n: int, starts: list[int], window: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of the places."""
    change = np.zeros(n + 1, np.int64)
    s = np.unique(np.asarray(starts, np.int64))
    np.add.at(change, s[s < n], 1)
    np.add.at(change, np.minimum(s + window, n), -1)
    return np.cumsum(change[:-1]) > 0


def _remove(window: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, out = [], [], []
            for text, starts, copy in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True):
                words = (text.as_py() or b"").split()
                kept = words
                if copy and len(words) >= window:
                    kept = []
                elif starts.is_valid:
                    gone = covered(len(words), starts.as_py(), window)
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                total.append(len(words))
                removed.append(len(words) - len(kept))
                whole = b" ".join(kept)
                out.append(hashlib.sha256(whole).hexdigest() if digest else whole.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], names=["id", "n_words", "n_removed", "kept"])

    return run


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, digest: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept): each row's words without those covered
    by a window that also starts in a smaller document, joined by a space;
    with ``digest`` the SHA-256 of that text.

    Null text has no words, shorter texts have no window, a null id loses
    nothing. Rows that repeat an id with one text are one document; an id with
    several texts loses the places found in any of them.
    """
    copies, places = repeated_windows(docs, id_col, text_col, window)
    marks = places.select("id", "pos", F.lit(False).alias("copy")).unionByName(copies.select("id", F.lit(None).cast("array<int>").alias("pos"), F.lit(True).alias("copy")))
    marks = marks.groupBy("id").agg(F.first("pos", ignorenulls=True).alias("pos"), F.max("copy").alias("copy"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).join(marks, "id", "left").select("id", "text", "pos", "copy")
    return rows.mapInArrow(_remove(window, digest), f"id {kind}, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)
