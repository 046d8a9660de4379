"""Quality classifier: averaged embeddings of hashed words and character n-grams.

Words, pairs of words and character n-grams of a text are hashed to BUCKETS
features. Each has a learned vector; a document is the average of the vectors
of all its features, and a softmax over that average gives the score. Vectors
and output layer are trained together by stochastic gradient descent in numpy,
one document at a time, on a bounded sample of labelled documents: executors
count the features of their texts, one task of bounded size trains. As averaging
and output layer are linear, scoring adds up one number a feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postforge.session import cut, small_batches

BUCKET_BITS = 16
DIMS = 16
#: Character n-grams of these lengths; they span words.
GRAMS = (2, 3, 4)
#: Labelled documents of each label that the model is fitted on at most, those of the smallest id hashes, and their bytes.
SAMPLE, SAMPLE_BYTES = 2000, 16 << 20
RATE = 0.1
#: Passes over the sample: as many as make STEPS, within these.
EPOCHS, STEPS = (8, 200), 20_000
#: Shares are about 1 / features: the steps of vectors are scaled by the number of features, up to this.
SCALED = 300
#: Characters whose features are taken together; longer texts are cut there, and no n-gram spans the cut.
BLOCK = 1 << 20
FOLDS, HELD_OUT = 4, 2
ACCEPT = 0.7

_MIX = np.uint32(2654435761)
_SHIFT = np.uint32(32 - BUCKET_BITS)
_POWERS = np.cumprod(np.full(64, 1000003, np.uint32), dtype=np.uint32)


def _hashed(block: str) -> Iterator[np.ndarray]:
    """Buckets of the words, word pairs and character n-grams of a block."""
    code = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (code == 32) | ((code >= 9) & (code <= 13))
    code = np.where(space, np.uint32(32), code)
    code = code[np.concatenate([[True], ~(space[1:] & space[:-1])])]  # runs of white space count as one
    for n in GRAMS:
        if len(code) >= n:
            h = np.full(len(code) - n + 1, n, np.uint32)
            for i in range(n):
                h = h * np.uint32(16777619) + code[i : len(code) - n + 1 + i]
            yield (h * _MIX) >> _SHIFT
    inner = code != 32
    starts = np.nonzero(inner & np.concatenate([[True], ~inner[:-1]]))[0]
    if len(starts):
        code, inner, starts = code[starts[0] :], inner[starts[0] :], starts - starts[0]
        place = np.arange(len(code)) - np.repeat(starts, np.diff(np.append(starts, len(code))))
        word = np.add.reduceat(np.where(inner, (code + np.uint32(1)) * _POWERS[place & 63], np.uint32(0)), starts, dtype=np.uint32)
        word = word * np.uint32(31) + np.uint32(17)
        yield (word * _MIX) >> _SHIFT
        if len(word) > 1:
            yield ((word[1:] - word[:-1]) * np.uint32(40503) * _MIX) >> _SHIFT  # a word said twice is one pair, whatever the word


def features(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of a whole text, in arrays of bounded size."""
    for i in range(0, len(text or ""), BLOCK):
        yield from _hashed(text[i : i + BLOCK])


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets, share of the text's features in each)."""
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for part in features(text):
        total += np.bincount(part, minlength=len(total))
    at = np.nonzero(total)[0]
    return at.astype("<u4"), (total[at] / max(int(total.sum()), 1)).astype("<f4")


@dataclass
class QualityModel:
    """Vectors of all buckets, output layer of both labels and their offset."""

    vectors: np.ndarray
    output: np.ndarray
    offset: np.ndarray

    def table(self) -> np.ndarray:
        """What each bucket adds to the log odds of label 1, for one feature of one."""
        return (self.vectors @ (self.output[1] - self.output[0])).astype(np.float32)

    def score(self, text: str | None) -> float:
        return score(self.table(), float(self.offset[1] - self.offset[0]), text)


def score(table: np.ndarray, offset: float, text: str | None) -> float:
    """The softmax share of label 1."""
    added, n = 0.0, 0
    for part in features(text):
        added += float(table[part].sum(dtype=np.float64))
        n += len(part)
    return float(1 / (1 + np.exp(-np.clip(offset + added / max(n, 1), -500, 500))))


def train(examples: list[tuple[int, np.ndarray, np.ndarray]], epochs: int | None = None, rate: float = RATE) -> QualityModel:
    """Gradient descent, one (label, buckets, shares) at a time, in an order drawn anew each epoch."""
    epochs = epochs or min(max(EPOCHS[0], STEPS // max(1, len(examples))), EPOCHS[1])
    rng = np.random.default_rng(5)
    vectors = rng.uniform(-1 / DIMS, 1 / DIMS, (1 << BUCKET_BITS, DIMS)).astype(np.float32)
    output, offset = np.zeros((2, DIMS), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, epochs * len(examples)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            label, at, share = examples[i]
            now = rate * (1 - done / steps)
            done += 1
            own = vectors[at]
            hidden = share @ own
            z = output @ hidden + offset
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1  # the gradient of the loss by z
            back = p @ output
            output -= now * np.outer(p, hidden)
            offset -= now * p
            vectors[at] = own - np.outer(share * np.float32(now * min(len(at), SCALED)), back)
    return QualityModel(vectors, output, offset)


def is_held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def _count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, order, id, text) to (label, order, id, buckets, shares)."""
    for batch in batches:
        for i in range(batch.num_rows):
            at, share = counts(batch.column(3)[i].as_py())
            row = batch.slice(i, 1)
            yield pa.RecordBatch.from_arrays([*row.columns[:3], pa.array([at.tobytes()], pa.binary()), pa.array([share.tobytes()], pa.binary())], names=["label", "o", "id", "at", "share"])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    examples = []
    for batch in batches:
        for label, at, share in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            examples.append((label, np.frombuffer(at, "<u4"), np.frombuffer(share, "<f4")))
    model = train(examples)
    parts = [model.vectors, model.output, model.offset]
    yield pa.RecordBatch.from_arrays([pa.array([p.astype("<f4").tobytes()], pa.binary()) for p in parts], names=["vectors", "output", "offset"])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> QualityModel:
    """Fit on labelled documents outside the held-out fold, at most ``sample``
    and ``sample_bytes`` of texts of each label (at least one document), in the
    order of their id hashes. Labels are 0 and 1, others are passed over; an id
    that has both is an example of both. Null texts are empty. The offset is
    moved by the odds of all labelled documents against those of the sample.
    Without examples of both labels the score of every text is their share (a
    half without any).
    """
    small_batches(docs.sparkSession)
    ids = docs.where(~is_held_out(id_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).alias("size"))
    said = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null").distinct()
    known = cut(said.join(ids.groupBy("id").agg(F.max("size").alias("size")), "id").withColumn("o", F.xxhash64(F.lit("quality"), "id")))
    totals = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        share = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1) if not totals else float(totals.get(1, 0) > 0)
        return QualityModel(np.zeros((1 << BUCKET_BITS, DIMS), np.float32), np.zeros((2, DIMS), np.float32), np.log(np.clip([1 - share, share], 1e-6, 1)).astype(np.float32))
    # a uniform share of the hash range first, so that few rows are sorted; then the exact bounds
    share = F.expr("case label " + " ".join(f"when {k} then {min(1.0, 2.0 * sample / n + 1e-3)}D" for k, n in totals.items()) + " end")
    ordered = Window.partitionBy("label").orderBy("o", "id")
    some = known.where((F.col("o").cast("double") / F.lit(2.0**64) + 0.5) <= share).select("*", F.row_number().over(ordered).alias("r"), F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("bytes"))
    picked = cut(some.where((F.col("r") <= sample) & ((F.col("bytes") <= sample_bytes) | (F.col("r") == 1))).select("label", "o", "id"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(picked), "id").dropDuplicates(["label", "id"]).select("label", "o", "id", "text")  # 2 * sample rows at most
    counted = cut(rows.mapInArrow(_count_texts, "label int, o long, id long, at binary, share binary"))
    taught = {r.label: r.n for r in counted.groupBy("label").agg(F.count("*").alias("n")).collect()}
    found = counted.repartition(1).sortWithinPartitions("o", "id", "label").mapInArrow(_train, "vectors binary, output binary, offset binary").first()
    model = QualityModel(np.frombuffer(found.vectors, "<f4").reshape(-1, DIMS), np.frombuffer(found.output, "<f4").reshape(2, DIMS), np.frombuffer(found.offset, "<f4").copy())
    for k in (0, 1):
        model.offset[k] += np.log(totals[k] / taught[k])
    return model


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """(id, held_out, score, predicted) of every row; columns of other names are left out.

    Whole texts are scored; null texts are empty. A text without features, an
    empty one, has the score of the offset alone. A null id is not held out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.table(), float(model.offset[1] - model.offset[0])))  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, offset = shared.value
        for batch in batches:
            scores = pa.array([score(table, offset, t.as_py()) for t in batch.column(2)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], scores], names=["id", "held_out", "score"])

    sent = docs.select(F.col(id_col).alias("id"), is_held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = sent.schema["id"].dataType.simpleString()
    found = sent.mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return found.select(F.col("id").alias(id_col), "held_out", "score", F.when(F.col("score") >= accept, 1).otherwise(0).alias("predicted"))
