"""Ranked lexical search over an inverted index, document at a time.

1. One pass over the documents writes shards where the texts lie: no text is
   shuffled. A shard holds a bounded number of terms; its documents are sorted
   by id, and each query term that occurs has a posting list of document gaps
   and frequencies, packed in one to four bytes a number.
2. Document counts, lengths and document frequencies are added up over all
   shards; they weigh the terms.
3. Per shard and query, the lists that a top document cannot do without are
   merged document at a time by a k-way heap; the others are only looked up at
   the documents so found. Lists can be done without as long as the best scores
   in them add up to less than the worst result held. Results are kept in a
   bounded heap keyed by score, then id, which goes on from shard to shard of a
   task. The heaps of all tasks are merged by a ranked window.

Queries come in blocks of bounded size, each searched against all documents.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postforge.session import cut, small_batches

#: Terms of a shard, after which the next one begins (a text is never split).
SHARD_TERMS = 4_000_000
#: (query, term) pairs of a block of queries: what a broadcast holds.
BLOCK_PAIRS = 500_000
#: Documents found by the merge that are scored together, at first and at most.
FIRST_CHUNK, CHUNK = 64, 4096

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def term_column(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), GAP), lambda t: t != "")


# --- packed numbers ---------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Numbers under 2 ** 32: their count, two bits of length each, then one to four bytes each."""
    v = values.astype("<u4")
    size = 1 + (v > 0xFF).astype(np.int64) + (v > 0xFFFF) + (v > 0xFFFFFF)
    used = np.arange(4) < size[:, None]
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = size - 1
    code = code.reshape(-1, 4)
    lengths = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    return np.array([len(v)], "<u4").tobytes() + lengths.tobytes() + v.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    lengths = np.frombuffer(data, np.uint8, -(-n // 4), 4)
    size = ((lengths[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).reshape(-1)[:n].astype(np.int64) + 1
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8, int(size.sum()), 4 + len(lengths))
    return out.view("<u4").reshape(-1).astype(np.int64)


# --- shards -----------------------------------------------------------------------

_SHARD = "docs long, terms long, named long, ids binary, lengths binary, vocabulary array<int>, counts array<long>, gaps binary, frequencies binary"


def _shard(ids: list[int | None], lengths: list[int], docs: list[np.ndarray], found: list[np.ndarray]) -> pa.RecordBatch:
    """Postings of documents in any order: (document, term) pairs with repeats. Documents without an id come last."""
    own, unnamed, n = np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], bool), np.array(lengths, np.int64)
    order = np.lexsort((own, unnamed))
    rank = np.empty(len(own), np.int64)
    rank[order] = np.arange(len(own))
    doc, term = np.concatenate([np.zeros(0, np.int64), *docs]), np.concatenate([np.zeros(0, np.int64), *found])
    keys, tf = np.unique(term * max(len(own), 1) + rank[doc], return_counts=True)
    term, doc = np.divmod(keys, max(len(own), 1))
    vocabulary, first, counts = np.unique(term, return_index=True, return_counts=True)
    gaps = np.diff(doc, prepend=0)
    gaps[first] = doc[first]
    columns = [
        pa.array([int((n > 0).sum())], pa.int64()),
        pa.array([int(n.sum())], pa.int64()),
        pa.array([int((~unnamed).sum())], pa.int64()),
        pa.array([own[order].astype("<i8").tobytes()], pa.binary()),
        pa.array([pack(n[order])], pa.binary()),
        pa.array([vocabulary.tolist()], pa.list_(pa.int32())),
        pa.array([counts.tolist()], pa.list_(pa.int64())),
        pa.array([pack(gaps)], pa.binary()),
        pa.array([pack(tf)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["docs", "terms", "named", "ids", "lengths", "vocabulary", "counts", "gaps", "frequencies"])


def _index(shared, most: int):
    """(id, text) to shards of at most ``most`` terms and one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        ids, lengths, docs, found, size = [], [], [], [], 0
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms(text.as_py() or b"")
                known = np.array([x for x in map(number.get, words) if x is not None], np.int64)
                docs.append(np.full(len(known), len(ids), np.int64))
                found.append(known)
                ids.append(own)
                lengths.append(len(words))
                size += len(words)
                if size >= most:
                    yield _shard(ids, lengths, docs, found)
                    ids, lengths, docs, found, size = [], [], [], [], 0
        if ids:
            yield _shard(ids, lengths, docs, found)

    return run


class Postings:
    """A shard's lists: documents by rank, and what each posting adds to a score."""

    def __init__(self, row: dict, weights: np.ndarray, total: int, length: int):
        self.ids = np.frombuffer(row["ids"], "<i8")
        m = 100 - 25 + (25 * unpack(row["lengths"]) * total) // max(length, 1)
        counts = np.array(row["counts"], np.int64)
        ends = np.cumsum(counts)
        gaps, tf = unpack(row["gaps"]), unpack(row["frequencies"])
        run = np.cumsum(gaps)
        begins = ends - counts
        before = np.where(begins > 0, run[begins - 1], 0) if len(counts) else begins
        docs = run - np.repeat(before, counts)
        term = np.array(row["vocabulary"], np.int64)
        adds = np.where(docs < row["named"], np.repeat(weights[term], counts) * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[docs])), 0)
        best = np.maximum.reduceat(adds, begins) if len(counts) else counts
        self.lists = {t: (docs[a:b], adds[a:b], top) for t, a, b, top in zip(term.tolist(), begins.tolist(), ends.tolist(), best.tolist(), strict=True)}


def search(postings: Postings, query: list[tuple[int, int]], results: list[tuple[int, int]], most: int) -> None:
    """Merge one query's lists into ``results``, a heap of (score, -id) with the worst first."""
    lists = [(n * held[2], n, held[0], held[1]) for t, n in query if (held := postings.lists.get(t)) and held[2] > 0]
    lists.sort(key=lambda x: x[0])
    reach = np.cumsum([x[0] for x in lists])  # the most that a document in the lists up to here alone can score
    at, chunk = 0, FIRST_CHUNK
    while at < len(postings.ids):
        least = results[0][0] if len(results) == most else 1
        needed = lists[int(np.searchsorted(reach, least)) :]
        if not needed:
            return
        merged = heapq.merge(*[own[np.searchsorted(own, at) :].tolist() for _, _, own, _ in needed])
        while True:
            popped = np.fromiter(islice(merged, chunk), np.int64)
            if not len(popped):
                return
            docs = np.unique(popped)
            docs = docs[docs >= at]  # the last one before may recur
            chunk = min(2 * chunk, CHUNK)
            score = np.zeros(len(docs), np.int64)
            for _, n, own, adds in lists:
                place = np.minimum(np.searchsorted(own, docs), len(own) - 1)
                score += np.where(own[place] == docs, n * adds[place], 0)
            good = score >= least
            for s, i in zip(score[good].tolist(), postings.ids[docs[good]].tolist(), strict=True):
                if len(results) < most:
                    heapq.heappush(results, (s, -i))
                elif (s, -i) > results[0]:
                    heapq.heapreplace(results, (s, -i))
            at = int(popped[-1]) + 1
            least = results[0][0] if len(results) == most else 1
            if int(np.searchsorted(reach, least)) > len(lists) - len(needed):
                break  # fewer lists are needed: merge those alone from here on


def _search(shared, most: int):
    """Shards to (query, id, score): the best of this task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, total, length = shared.value
        results: list[list[tuple[int, int]]] = [[] for _ in queries]
        for batch in batches:
            for i in range(batch.num_rows):
                postings = Postings(batch.slice(i, 1).to_pylist()[0], weights, total, length)
                for query, held in zip(queries, results, strict=True):
                    search(postings, query, held, most)
        rows = [(q, -i, s) for q, held in enumerate(results) for s, i in held]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)] if rows else [pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int64())], names=["query", "id", "score"])

    return run


def _weight(total: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))


def _search_block(source: DataFrame, pairs: list, kind: str, most: int) -> DataFrame:
    """(item, id, score) of one block's (item, term, count) rows, no more than BLOCK_PAIRS and one item's."""
    spark = source.sparkSession
    number = {t: i for i, t in enumerate(sorted({r.term.encode() for r in pairs}))}
    items = {r.item: [] for r in pairs}
    for r in pairs:
        items[r.item].append((number[r.term.encode()], r.n))
    shards = cut(source.mapInArrow(_index(spark.sparkContext.broadcast(number), SHARD_TERMS), _SHARD))
    total, length = shards.agg(F.sum("docs"), F.sum("terms")).first()
    counted = shards.select(F.explode(F.arrays_zip("vocabulary", "counts")).alias("x")).groupBy("x.vocabulary").agg(F.sum("x.counts").alias("df"))
    weights = np.zeros(len(number), np.int64)
    for t, df in counted.collect():  # one row a term of the block
        weights[t] = _weight(total, df)
    shared = spark.sparkContext.broadcast((list(items.values()), weights, total or 0, length or 0))
    found = shards.mapInArrow(_search(shared, most), "query int, id long, score long")
    named = spark.createDataFrame(list(enumerate(items)), f"query int, item {kind}")
    return found.join(F.broadcast(named), "query").select("item", "id", "score")


def ranked_search(docs: DataFrame, queries: DataFrame, most: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """(item, rank, id, score): the ``most`` best documents of every query with
    a score above 0, equal scores by ascending id.

    Ids of documents are integers. Null and empty texts have no terms. Rows that
    repeat an item are one query with all their terms, a null item is an item.
    Rows that repeat a document's id are ranked each; a row without an id counts
    in the statistics and is never returned. Columns of other names are left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    asked = queries.select(F.col(item_col).alias("item"), F.explode(term_column(F.col(query_col).cast("string"))).alias("term"))
    pairs = cut(asked.groupBy("item", "term").agg(F.count("*").alias("n")))
    blocks = max(1, math.ceil(2 * pairs.count() / BLOCK_PAIRS))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64(F.col("item").cast("string")), F.lit(blocks)))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = queries.schema[item_col].dataType.simpleString()
    found = None
    for block in range(blocks):
        own = pairs.where(F.col("block") == block).orderBy("item", "term").collect()  # bounded by the number of blocks
        if own:
            part = _search_block(source, own, kind, most)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"item {kind}, id long, score long")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= most)
    return best.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
