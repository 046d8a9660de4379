"""Language-model scoring by online logistic context mixing.

A text is coded byte by byte; a byte is a path of binary decisions down the
Huffman tree of its predecessor (trees from all training texts). A predictor
of each context order gives a decision a log-odds from a hashed table of
decision counts with a check byte for each slot. A mixer sums the log-odds by
weights that a gate picks (how many of the contexts were ever seen); an
adaptive map then refines the mixed probability. Weights and map start from
constants and are learned online within each text: they move after each of the
first BLOCK_RATIO bytes, then whenever the text has grown by 1/BLOCK_RATIO, so
a text longer by a word already profits, long texts need few steps, and
scoring needs no order among texts. Decisions multiply to the probability of
the text and its end.

Training counts (context, byte) pairs of every text exactly, merged block by
block of the table that the context falls in; where two contexts meet in a
slot, the more frequent one keeps it. Tables grow with the training text, a
slot for SLOT_BYTES of it, up to 2^MOST_BITS slots (a bounded broadcast).

The base figures are an add-half unigram model of lower-cased words. Words
with over 1/COMMON of all training tokens (fewer than COMMON, whatever the
input) are looked up in a broadcast; the others meet their counts in a join.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postforge.session import cut

#: Bytes of context of the hashed predictors (at most 7).
ORDERS = (3, 5)
#: Training bytes for a slot, and bounds of the slots of a table (powers of two).
SLOT_BYTES, LEAST_BITS, MOST_BITS = 32, 18, 26
#: Slots of a block, in which tables are merged: a context's decisions lie in one.
BLOCK_BITS = 14
#: Stored log-odds are multiples of 1/STEP, at most 127 steps.
STEP = 14.0
PRIOR = 0.35
END = 0xFF  # no byte of UTF-8
PAD = 8
#: Starting weights (order 1, then ORDERS) by gate: how many of ORDERS were ever seen.
START = ((1.0, 0.0, 0.0), (0.2, 0.85, 0.0), (0.1, 0.4, 0.6))
#: Step of the weights and the squared gradient they start from (AdaGrad).
RATE, FIRST_SQUARE = 0.08, 4.0
BLOCK_RATIO = 16
#: Nodes of the refining map, and the decisions that its start counts for.
NODES, MAP_PRIOR = 24, 12.0
#: Places coded at a time.
CHUNK = 1 << 15
FOLDS = 5
#: A word with more than 1/COMMON of all training tokens is common.
COMMON = 1 << 22
#: Distinct words, or distinct pairs of an order, that a counting task holds back to merge.
CACHE = 400_000
#: Bytes and texts that are taken up at once, but for longer texts.
GROUP_BYTES, GROUP_TEXTS = 1 << 20, 1024
#: The same of texts scored in lock-step, where a step costs the same for few places.
SCORED_BYTES, SCORED_TEXTS = 1 << 22, 2048

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint32(0xC2B2AE35)


def is_held_out(id_col: str, fold: int = 1) -> F.Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS)) == fold


# --- decisions -----------------------------------------------------------------


class Codes:
    """Paths of every (predecessor, byte), from a 256 x 256 count matrix."""

    def __init__(self, counts: np.ndarray):
        total = counts.sum(axis=0)
        lengths, offsets, nodes, bits = np.zeros(65536, np.int64), np.zeros(65536, np.int64), [], []
        self._node_odds = np.zeros(65536, np.float32)
        at = 0
        for prev in range(256):
            weight = counts[prev] * 4096.0 + (total + 1) * (4096.0 / (total.sum() + 256))
            paths = self._tree(weight, prev)
            for byte, path in enumerate(paths):
                e = prev * 256 + byte
                lengths[e], offsets[e] = len(path), at
                at += len(path)
                nodes += [prev * 256 + n for n, _ in path]
                bits += [b for _, b in path]
        self.lengths, self.offsets = lengths, offsets
        nodes = np.array(nodes)
        self.odds = self._node_odds[nodes]
        #: The node, hashed, with the decision as the lowest bit.
        self.marks = (nodes.astype(np.uint32) * np.uint32(0x85EBCA6B)) & np.uint32(0xFFFFFFFE) | np.array(bits, np.uint32)

    def _tree(self, weight: np.ndarray, prev: int) -> list[list[tuple[int, int]]]:
        heap = [(float(w), i, i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        parent: dict[int, tuple[int, int]] = {}
        for node in range(255):
            (w0, _, a), (w1, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            parent[a], parent[b] = (node, 0), (node, 1)
            self._node_odds[prev * 256 + node] = np.log((w1 + 1e-9) / (w0 + 1e-9))
            heapq.heappush(heap, (w0 + w1, 256 + node, 256 + node))
        paths = []
        for byte in range(256):
            path, x = [], byte
            while x in parent:
                path.append(parent[x])
                x = 256 + parent[x][0]
            paths.append(path[::-1])
        return paths

    def decisions(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of predecessor * 256 + byte: (number of decisions, index of each into marks and odds)."""
        n = self.lengths.take(entry)
        ends = np.cumsum(n)
        path = np.repeat(self.offsets.take(entry) - ends + n, n)
        path += np.arange(len(path))
        return n, path


def hashed(context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, check byte) of contexts: their last bytes as a number."""
    x = context * _C1
    x = (x ^ (x >> np.uint64(29))) * _C2
    return (x >> np.uint64(32)).astype(np.uint32), (x >> np.uint64(16)).astype(np.uint8)


def slots(context: np.ndarray, marks: np.ndarray, bits: int) -> np.ndarray:
    """The slot of each decision: its hashed context picks the block, both pick the place there."""
    place = context ^ (marks | np.uint32(1))
    place *= _C3
    place >>= np.uint32(32 - BLOCK_BITS)
    block = context >> np.uint32(32 - bits + BLOCK_BITS)
    block <<= np.uint32(BLOCK_BITS)
    place |= block
    return place


def table_bits(n_bytes: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(n_bytes, 1) / SLOT_BYTES)))))


def _buffer(texts: list[bytes], ends: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first place, end) of the texts, each behind PAD and before END."""
    pad = bytes([END]) * PAD
    buf = np.frombuffer(b"".join(pad + t + pad[:1] for t in texts), np.uint8)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.cumsum(size + PAD) - size
    return buf, first, first + size - (not ends)


def _ranges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range number, value) of the joined ranges [a, b)."""
    n = b - a
    which = np.repeat(np.arange(len(a)), n)
    return which, np.arange(len(which)) + np.repeat(a - np.cumsum(n) + n, n)


def _lowered(column: pa.Array) -> pa.Array:
    """Texts with A-Z lower-cased, null as empty."""
    return pc.ascii_lower(pc.fill_null(column, b"").view(pa.string()))


def _groups(batches: Iterator[pa.RecordBatch], n_bytes: int = GROUP_BYTES, n_texts: int = GROUP_TEXTS) -> Iterator[pa.RecordBatch]:
    """Rows (id, lowered text) in groups of bounded size."""
    for batch in batches:
        low = pa.RecordBatch.from_arrays([batch.column(0), _lowered(batch.column(1))], names=["id", "text"])
        size = np.cumsum(pc.binary_length(low.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < low.num_rows:
            most = (size[a - 1] if a else 0) + n_bytes
            b = min(max(a + 1, int(np.searchsorted(size, most))), a + n_texts, low.num_rows)
            yield low.slice(a, b - a)
            a = b


def _bytes_of(column: pa.Array) -> list[bytes]:
    return column.view(pa.binary()).to_pylist()


# --- training ------------------------------------------------------------------


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(65536, np.int64)
    for part in _groups(batches):
        buf, first, end = _buffer(_bytes_of(part.column(1)))
        two = buf[:-1].astype(np.int64) << 8
        two |= buf[1:]
        counts += np.bincount(two, minlength=65536)
        counts[END << 8 | END] -= len(first) * (PAD - 1)  # pads; ends are followed by pads too
        counts[END << 8 | END] -= len(first) - 1
    rows = counts.reshape(256, 256)
    used = np.nonzero(rows.any(axis=1))[0]
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([rows[i].astype("<i8").tobytes() for i in used], pa.binary())], names=["block", "data"])


def _sum_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}  # at most 256 rows
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[block] = total.get(block, 0) + np.frombuffer(data, "<i8")
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "data"])


def _summed(keys: list[np.ndarray], counts: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts (None: ones)."""
    key = np.concatenate(keys)
    if all(c is None for c in counts):
        key.sort()
        first = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.nonzero(first)[0]
        return key[at], np.diff(np.append(at, len(key)))
    order = np.argsort(key, kind="stable")
    key = key[order]
    n = np.concatenate([np.ones(len(k), np.int64) if c is None else c for k, c in zip(keys, counts, strict=True)])[order]
    at = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
    return key[at], np.add.reduceat(n, at) if len(at) else n


def _count_bytes(bits: int):
    """Training texts to rows (block, data): the distinct (context, byte) of
    each order, by the block that the context falls in, with their counts."""
    width = 1 << 22  # places sorted at a time

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new: list[list[np.ndarray]] = [[] for _ in ORDERS]
        held: list[tuple[list, list]] = [([], []) for _ in ORDERS]
        waiting = 0

        def merge() -> None:
            for k in range(len(ORDERS)):
                if new[k]:
                    key, n = _summed(new[k], [None] * len(new[k]))
                    held[k][0].append(key)
                    held[k][1].append(n)
                    new[k].clear()
                    if sum(map(len, held[k][0])) > CACHE and len(held[k][0]) > 1:
                        key, n = _summed(*held[k])
                        held[k][0][:], held[k][1][:] = [key], [n]

        def out() -> Iterator[pa.RecordBatch]:
            for k, order in enumerate(ORDERS):
                if not held[k][0]:
                    continue
                key, n = _summed(*held[k])
                held[k][0].clear()
                held[k][1].clear()
                context, _ = hashed(key & np.uint64((1 << 8 * order) - 1))
                block = (context >> np.uint32(32 - bits + BLOCK_BITS)).astype(np.int64)
                by = np.argsort(block, kind="stable")
                block, key, n = block[by], key[by], n[by]
                at = np.nonzero(np.concatenate([[True], block[1:] != block[:-1]]))[0]
                ends = np.append(at[1:], len(block))
                for i in range(0, len(at), 256):
                    rows = [(int(block[a]) << 2 | k, _pack(key[a:b], n[a:b], order + 1)) for a, b in zip(at[i : i + 256].tolist(), ends[i : i + 256].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "data"])

        for part in _groups(batches):
            buf, first, end = _buffer(_bytes_of(part.column(1)))
            # the places of texts and ends, not those of pads
            real = np.ones(len(buf), bool)
            real[_ranges(first - PAD, first)[1]] = False
            at = np.nonzero(real)[0]
            last = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))[at - 7]
            for k, order in enumerate(ORDERS):
                new[k].append(last >> np.uint64(56 - 8 * order))
            waiting += len(at)
            if waiting >= width:
                merge()
                waiting = 0
                if sum(len(x) for h in held for x in h[0]) > 20 * CACHE:
                    yield from out()
        merge()
        yield from out()

    return run


def _pack(key: np.ndarray, n: np.ndarray, size: int) -> bytes:
    """Keys of ``size`` bytes and counts, those under 255 in one byte."""
    raw = np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size])
    large = n >= 255
    return len(key).to_bytes(4, "little") + raw.tobytes() + np.where(large, 255, n).astype(np.uint8).tobytes() + n[large].astype("<u8").tobytes()


def _unpack(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    key = np.zeros((n, 8), np.uint8)
    key[:, :size] = np.frombuffer(data, np.uint8, n * size, 4).reshape(n, size)
    count = np.frombuffer(data, np.uint8, n, 4 + n * size).astype(np.int64)
    count[count == 255] = np.frombuffer(data[4 + n * (size + 1) :], "<u8")
    return key.reshape(-1).view("<u8"), count


def _block_of(codes: Codes, bits: int, order: int, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, count) of the decisions of (context, byte) pairs of one block; a
    cell is the place in the block, the check byte and the decision."""
    shift = np.uint64(8 * order)
    context, byte = key & np.uint64((1 << 8 * order) - 1), key >> shift
    steps, path = codes.decisions(((context >> (shift - np.uint64(8))) << np.uint64(8) | byte).astype(np.int64))
    high, check = hashed(context)
    marks = codes.marks.take(path)
    place = slots(np.repeat(high, steps), marks, bits) & np.uint32((1 << BLOCK_BITS) - 1)
    cell = place.astype(np.int64) << 9 | np.repeat(check, steps).astype(np.int64) << 1 | marks & np.uint32(1)
    return _summed([cell], [np.repeat(n, steps)])


def block_values(cell: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A block's slots from its cells: check byte and quantised log-odds of the
    most frequent context of each (the least check byte of equally frequent
    ones); zero where there is none."""
    out = np.zeros(1 << BLOCK_BITS, np.uint16)
    if not len(cell):
        return out
    both = cell >> 1
    at = np.nonzero(np.concatenate([[True], both[1:] != both[:-1]]))[0]
    both, ones, total = both[at], np.add.reduceat(np.where(cell & 1, n, 0), at), np.add.reduceat(n, at)
    odds = np.rint(np.log((ones + PRIOR) / (total - ones + PRIOR)) * STEP)
    odds = np.clip(np.where(odds == 0, 1, odds), -127, 127).astype(np.int8)  # zero means never seen
    rank = np.lexsort((both, -total, both >> 8))
    first = rank[np.concatenate([[True], (both[rank][1:] >> 8) != (both[rank][:-1] >> 8)])]
    out[both[first] >> 8] = (both[first] & 255).astype(np.uint16) << np.uint16(8) | odds[first].view(np.uint8)
    return out


def _merge_blocks(shared, bits: int):
    """Rows sorted by block to (block, its slots)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: Codes = shared.value
        now, cells, counts, waiting = None, [], [], 0

        def out() -> pa.RecordBatch:
            values = block_values(*_summed(cells, counts))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([values.tobytes()], pa.binary())], names=["block", "data"])

        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != now:
                    if now is not None:
                        yield out()
                    now, cells, counts, waiting = block, [], [], 0
                order = ORDERS[block & 3]
                cell, n = _block_of(codes, bits, order, *_unpack(data, order + 1))
                cells.append(cell)
                counts.append(n)
                waiting += len(cell)
                if waiting > 1 << 21:  # at most 2 ** (BLOCK_BITS + 9) cells are left
                    cell, n = _summed(cells, counts)
                    cells, counts, waiting = [cell], [n], 0
        if now is not None:
            yield out()

    return run


class Model:
    """Codes, and one table of slots (check byte, log-odds) for each order."""

    def __init__(self, codes: Codes, tables: list[np.ndarray]):
        self.codes, self.tables, self.bits = codes, tables, len(tables[0]).bit_length() - 1


def fit(train: DataFrame) -> Model:
    """``train`` (id, text binary): counts cover every text; what reaches the
    driver is bounded (256 rows of pairs, two bytes for each slot)."""
    spark = train.sparkSession
    pairs = train.mapInArrow(_pair_counts, "block int, data binary").repartition("block").mapInArrow(_sum_pairs, "block int, data binary")
    matrix = np.zeros((256, 256), np.int64)
    for row in pairs.toLocalIterator():
        matrix[row.block] = np.frombuffer(row.data, "<i8")
    codes, bits = Codes(matrix), table_bits(int(matrix.sum()))
    shared = spark.sparkContext.broadcast(codes)
    rows = train.mapInArrow(_count_bytes(bits), "block int, data binary")
    merged = cut(rows.repartition("block").sortWithinPartitions("block").mapInArrow(_merge_blocks(shared, bits), "block int, data binary"))  # all blocks at once, then read one by one
    tables = [np.zeros(1 << bits, np.uint16) for _ in ORDERS]
    for row in merged.toLocalIterator():
        at = row.block >> 2 << BLOCK_BITS
        tables[row.block & 3][at : at + (1 << BLOCK_BITS)] = np.frombuffer(row.data, np.uint16)
    return Model(codes, tables)


# --- scoring -------------------------------------------------------------------


def block_end(done: int) -> int:
    """Where the block ends that begins after so many bytes of a text."""
    return done + max(1, done // BLOCK_RATIO)


def log10_probabilities(model: Model, texts: list[bytes], ends: bool = True) -> np.ndarray:
    """log10 of the probability of each text and its end (or of the text as a
    beginning); texts in lock-step, each with weights and a map of its own."""
    buf, first, end = _buffer(texts, ends)
    gates, inputs, count = len(START), len(ORDERS) + 1, len(texts)
    codes, f4 = model.codes, np.float32
    weights = np.tile(np.array(START, f4).T, count)  # (inputs, text * gates + gate)
    squares = np.full(weights.shape, FIRST_SQUARE, f4)
    seen = np.full(count * NODES, MAP_PRIOR)
    ones = np.tile(MAP_PRIOR / (1 + np.exp(-np.linspace(-8, 8, NODES))), count)
    refined = (ones / seen).astype(f4)
    out = np.zeros(count)
    window = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    done, live = 0, np.nonzero(first < end)[0]
    while len(live):
        stop = block_end(done)
        run, where = _ranges(first[live] + done, np.minimum(first[live] + stop, end[live]))
        grad = np.zeros(weights.shape)
        for i in range(0, len(where), CHUNK):
            at, own = where[i : i + CHUNK], live[run[i : i + CHUNK]]
            last = window[at - 8]
            n, path = codes.decisions((last >> np.uint64(56) << np.uint64(8)).astype(np.int64) | buf[at])
            marks, owner = codes.marks.take(path), np.repeat(own, n)
            x, pick = [codes.odds.take(path)], owner * gates
            for table, order in zip(model.tables, ORDERS, strict=True):
                high, check = hashed(last >> np.uint64(64 - 8 * order))
                held = table.take(slots(np.repeat(high, n), marks, model.bits).astype(np.int64))
                held ^= np.repeat(check.astype(np.uint16) << np.uint16(8), n)  # no check byte is left where it is the same
                odds = held.astype(np.int8)
                odds *= held < np.uint16(256)
                pick += odds != 0  # a longer context is hardly ever seen without the shorter ones
                x.append(odds * f4(1 / STEP))
            z = x[0] * weights[0].take(pick)
            for k in range(1, inputs):
                z += x[k] * weights[k].take(pick)
            np.clip(z, f4(-7.99), f4(7.99), out=z)
            p = 1 / (1 + np.exp(-z))
            z += f4(8)
            z *= f4((NODES - 1) / 16)
            slot = np.rint(z).astype(np.int64)
            owner *= NODES
            slot += owner
            bit = (marks & np.uint32(1)).astype(f4)
            final = p + refined.take(slot)
            final *= f4(0.5)
            np.clip(final, f4(1 / 8192), f4(1 - 1 / 8192), out=final)
            likely = np.log(np.abs(f4(1) - bit - final))  # of what came
            new = np.concatenate([[0], np.nonzero(own[1:] != own[:-1])[0] + 1])  # texts lie end to end
            out[own[new]] += np.add.reduceat(likely, (np.cumsum(n) - n)[new], dtype=np.float64)
            miss = bit - p
            for k in range(inputs):
                grad[k] += np.bincount(pick, weights=miss * x[k], minlength=grad.shape[1])
            both = np.bincount(slot, weights=bit * f4(1 << 20) + f4(1), minlength=len(seen)).astype(np.int64)  # a chunk has far fewer decisions
            ones += both >> 20
            seen += both & (1 << 20) - 1
        squares += (grad * grad).astype(f4)
        weights += (RATE * grad / np.sqrt(squares)).astype(f4)
        refined = (ones / seen).astype(f4)
        done = stop
        live = live[first[live] + done < end[live]]
    return out / np.log(10)


# --- unigram base --------------------------------------------------------------


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each word, words) of lowered texts."""
    split = pc.ascii_split_whitespace(texts)
    row = pc.list_parent_indices(split).to_numpy()
    words = pc.list_flatten(split)
    some = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty one
    return row[some.to_numpy(zero_copy_only=False)], words.filter(some).view(pa.binary())


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training texts to (word, n), summed within bounded memory."""
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

    for part in _groups(batches):
        found = pc.value_counts(_words(part.column(1))[1])
        held.append(pa.Table.from_arrays([found.field(0), found.field(1)], names=["word", "n"]))
        if sum(t.num_rows for t in held) > CACHE:
            held = [merged()]
            if held[0].num_rows > CACHE // 2:
                yield from held[0].combine_chunks().to_batches()
                held = []
    if held:
        yield from merged().combine_chunks().to_batches()


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, c) to chunks (hashes, their values) as bytes."""
    for batch in batches:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, batch.column(0).to_pylist()), "<u8", batch.num_rows)
        v = np.log10(batch.column(1).to_numpy() + 0.5)
        yield pa.RecordBatch.from_arrays([pa.array([h.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], names=["h", "v"])


_SCORED = "id long, x long, word binary, n long, total double, n_tokens long, n_bytes long, score double"


def _score(shared_model, shared_words):
    """(id, text) to one row for each text (word null; n and total: known words
    among the common ones, and their sum) and one for each distinct other word
    of a text (n: how often). x tells texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared_model.value
        common, value = (np.frombuffer(x, k) for x, k in zip(shared_words.value, ("<u8", "<f8"), strict=True))
        by_length = (b.take(pc.sort_indices(pc.fill_null(pc.binary_length(b.column(1)), 0))) for b in batches)
        for part in _groups(by_length, SCORED_BYTES, SCORED_TEXTS):
            ids, texts = part.column(0).cast(pa.int64()), _bytes_of(part.column(1))
            x = pa.array(np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts)).view(np.int64))
            row, words = _words(part.column(1))
            coded = words.dictionary_encode()
            spelled, at = coded.dictionary, coded.indices.to_numpy()
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, spelled.to_pylist()), np.uint64, len(spelled))
            found = np.full(len(h), np.nan)
            if len(common):
                near = np.minimum(np.searchsorted(common, h), len(common) - 1)
                found = np.where(common[near] == h, value[near], np.nan)
            v = found[at]
            other = np.isnan(v)
            n = np.bincount(row[~other], minlength=len(texts))
            total = np.bincount(row[~other], weights=v[~other], minlength=len(texts)).astype(np.float64)
            tokens = np.bincount(row, minlength=len(texts)).astype(np.int64) + 1
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            score = log10_probabilities(model, texts)
            names = _SCORED.replace(",", "").split()[::2]
            yield pa.RecordBatch.from_arrays([ids, x, pa.nulls(len(texts), pa.binary()), *map(pa.array, (n, total, tokens, sizes, score))], names=names)
            pair, times = np.unique(row[other].astype(np.int64) << 32 | at[other], return_counts=True)
            if len(pair):
                own, none = pa.array(pair >> 32), pa.nulls(len(pair), pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(own), x.take(own), spelled.take(pa.array(pair & 0xFFFFFFFF)), pa.array(times), pa.array(np.zeros(len(pair))), none, none, pa.nulls(len(pair), pa.float64())], names=names)

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte), one row per row of ``docs`` that has an id (an integer).

    Learns from the texts outside fold 1. Null and empty texts are an end
    alone. Rows that repeat an id are scored each by its own text, and each
    counts in training.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    train = rows.where(~is_held_out("id"))
    counts = cut(train.mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")))
    texts = train.count()
    found = counts.agg(F.sum("c"), F.count("*")).first()
    total, distinct = (found[0] or 0) + texts, found[1] + (texts > 0)
    hashes, values = [], []
    for row in counts.where(F.col("c") * COMMON > total).mapInArrow(_common, "h binary, v binary").toLocalIterator():
        hashes.append(np.frombuffer(row.h, "<u8"))  # fewer than COMMON in all, whatever the input: 16 bytes each
        values.append(np.frombuffer(row.v, "<f8"))
    hashes, values = (np.concatenate(x) if x else np.zeros(0) for x in (hashes, values))
    order = np.argsort(hashes)
    words = spark.sparkContext.broadcast((hashes[order].tobytes(), values[order].tobytes()))
    model = spark.sparkContext.broadcast(fit(train))
    scored = rows.mapInArrow(_score(model, words), _SCORED)
    # texts' own rows go through the join as well, spread by a key that no word has, so that texts are read once
    key = F.coalesce(F.col("word"), F.concat(F.lit("\n"), F.col("id").cast("string")).cast("binary")).alias("word")
    rare = counts.where(F.col("c") * COMMON <= total)
    met = scored.withColumn("own", F.col("word").isNull()).withColumn("word", key).join(rare, "word", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    known = F.when(F.col("own") | (c > 0), F.col("n")).otherwise(0)
    part = F.when(F.col("own"), F.col("total")).otherwise(F.col("n") * F.log10(c + 0.5))
    same = F.count_if("own")  # rows of one id and text
    sums = met.groupBy("id", "x").agg(same.alias("same"), F.sum(known).alias("known"), F.sum(part).alias("total"), *[F.max(k).alias(k) for k in ("n_tokens", "n_bytes", "score")])
    sums = sums.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("same"))))
    norm, ends = float(np.log10(total + 0.5 * (distinct + 1))), float(np.log10(texts + 0.5))
    return sums.select(
        F.col("id").alias(id_col),
        is_held_out("id").alias("held_out"),
        "n_tokens",
        ((F.col("known") / F.col("same")).cast("long") + int(texts > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("total") / F.col("same") + ends - F.col("n_tokens") * norm).alias("base_score"),
        "score",
        (-F.col("score") / float(np.log10(2)) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )
