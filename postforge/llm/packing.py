"""Concatenate and cut: token ids of all documents in fixed windows.

Pass one tokenises each document once and keeps its ids (two bytes each, four
where the vocabulary is larger) in the shared checkpoint folder; pass two turns partition totals, one number per
partition, into global offsets by a prefix sum. Each task then cuts its own
documents at multiples of the window without seeing any other. Only the last
sequence can be short.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postforge.session import cut

WINDOW = 2048
END_ID = 1
#: The split that comes before merging in the vocabulary's tokenizer (a fixed value of that file).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable
    Latin-1 bytes for themselves, the others from U+0100 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """The ids that the tokenizers library gives for the byte-level vocabulary
    file (its added tokens included where their strings stand in a text), by a
    faster merge of the same ranks: an id is its merge's rank there. Tests hold
    the ids against the library, whose own speed (1 MB a second and core) would
    be 2.5 times too slow.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        added, byte_of = {t["content"]: t["id"] for t in data.get("added_tokens", ())}, _byte_of()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in added}
        self.added, self.own = set(added), tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.kind = "<u2" if max([*ranks.values(), *added.values()]) < 1 << 16 else "<u4"

    def __call__(self, text: str) -> np.ndarray:
        return self.own.encode_to_numpy(text, allowed_special=self.added)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """Built once by a worker, not by each of its tasks."""
    return Encoder(path)


def token_ids(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int = END_ID) -> DataFrame:
    """(id, ids binary, n, part, before): ids of each text with ``end_id``
    behind, how many bytes an id takes being len(ids) / n, the partition it was
    made in and the tokens that came before in that partition. Null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = encoder(path), TaskContext.get().partitionId(), 0
        kind = encode.kind if end_id < 1 << 16 else "<u4"
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            for some in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                found = [encode(x.as_py() or "").astype(kind).tobytes() + end for x in some.column(1)]
                n = np.array([len(x) // len(end) for x in found], np.int64)
                ends = before + np.cumsum(n)
                before = int(ends[-1])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found, pa.binary()), pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n)], names=["id", "ids", "n", "part", "before"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids binary, n long, part int, before long")


def _cut(starts: dict[int, int], window: int, keep: bool):
    """(id, ids, n, part, before) to pieces; a row needs no other row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids, n, part, before in zip(batch.column(0).to_pylist(), batch.column(1), *(c.to_pylist() for c in batch.columns[2:]), strict=True):
                ids = ids.as_py()
                at, start, kind = starts[part] + before, 0, f"<u{len(ids) // n}"
                ids = np.frombuffer(ids, kind)
                while start < n:
                    sequence, offset = divmod(at, window)
                    length = min(window - offset, n - start)
                    piece = ids[start : start + length].astype("<u4").tobytes()
                    rows.append((doc, start, length, zlib.crc32(piece), n, sequence, offset) + ((piece,) if keep else ()))
                    start, at = start + length, at + length
            cols = list(zip(*rows, strict=True)) or [[]] * (7 + keep)
            kinds = [batch.column(0).type, *[pa.int64()] * 6, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 7 + keep])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset[, ids as little-endian uint32]).

    Every id of every row lies in exactly one piece. A null or empty text is
    its end id alone; repeated rows are packed as often as they come; an empty
    table gives no piece. Partition and place are columns of the kept ids, so
    what is done with the result (coalesce, union) leaves offsets alone.
    """
    held = cut(token_ids(docs, id_col, text_col, path or tokenizer_path(), end_id))
    # one total per partition: bounded by the number of partitions, not by rows
    totals = held.groupBy("part").agg(F.sum("n").alias("n")).collect()
    starts, at = {}, 0
    for p, n in sorted((r.part, r.n) for r in totals):
        starts[p], at = at, at + n
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids
    return held.mapInArrow(_cut(starts, window, keep_ids), schema).withColumnRenamed("id", id_col)
