"""Language identification by nearest centroid.

Character trigrams of the folded letters of a text are hashed to DIMS
features; vectors are sublinear TF times IDF, normalised. Each language has a
few centroids from spherical k-means; a text takes the language of the most
similar one. Texts with no letter are undetermined, and texts further from
their centroid than nearly all training texts of their length are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postforge.session import cut, small_batches

DIMS = 8192
CENTROIDS = 4
#: A centroid of fewer of its language's texts is dropped: wrong labels form such.
LEAST_SHARE = 0.05
#: Labelled texts per language that the model is fitted on at most, those of the smallest id hashes.
SAMPLE = 400
#: A text is rejected below this quantile of the similarities that training texts of its language, cut as short, have to
#: centroids of other training texts.
QUANTILE = 0.005
#: Lengths are told apart by powers of two of trigrams, up to 2 ** (BANDS - 1).
BANDS = 11
#: Labels whose counts a broadcast may hold; beyond (dirty labels), they are joined by shuffle.
MANY_LABELS = 100_000
FOLDS = 5
UNDETERMINED = "und"

_MIX = np.uint32(2654435761)


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams of the folded text, runs of other characters as one space."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 0xAA)
    code = np.where(letter, raw, np.uint32(32))
    code = code[np.concatenate([[True], (code[1:] != 32) | (code[:-1] != 32)])]
    if len(code) < 3:
        return np.zeros(0, np.int64)
    x = (code[:-2] * np.uint32(31) + code[1:-1]) * np.uint32(1009) + code[2:]
    return ((x * _MIX) >> np.uint32(19)).astype(np.int64)


def counts(text: str) -> np.ndarray:
    return np.bincount(trigrams(text), minlength=DIMS).astype(np.float32)


def vector(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf)
    v *= idf
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    v /= np.where(n == 0, 1, n)
    return v


def _centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from evenly spaced starts, the same on every run."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            own = x[near == j]
            if len(own):
                m = own.sum(axis=0)
                c[j] = m / (np.linalg.norm(m) or 1)
    share = np.bincount((x @ c.T).argmax(axis=1), minlength=len(c)) / len(x)
    return c[share >= min(LEAST_SHARE, share.max())]


def _band(n: np.ndarray) -> np.ndarray:
    """The length band of texts of so many trigrams."""
    return np.clip(np.log2(np.maximum(n, 1)).astype(int), 0, BANDS - 1)


def _floors(x: np.ndarray, leads: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """The least similarity by band: texts are cut to the band's least length
    and held against centroids of the other half of the texts."""
    half = np.arange(len(x)) % 2
    if len(x) < 2:  # nothing to tell by
        return np.zeros(BANDS)
    cents = [_centroids(x[half != h], CENTROIDS) for h in (0, 1)]
    out = np.zeros(BANDS)
    for band in range(BANDS):
        sims = [vector(np.stack(tf), idf) @ c.T for h, c in enumerate(cents) if (tf := [np.bincount(t[: 1 << band], minlength=DIMS).astype(np.float32) for t in leads[h::2] if len(t) >= 1 << band])]
        out[band] = np.quantile(np.concatenate([s.max(axis=1) for s in sims]), QUANTILE) if sims else out[max(band - 1, 0)]
    return out


class LanguageModel:
    def __init__(self, idf: np.ndarray, centroids: np.ndarray, langs: list[str], floors: list[np.ndarray]):
        self.idf, self.centroids, self.langs, self.floors = idf, centroids, langs, floors

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """(language, similarity 0 to 1, rejected) of whole texts."""
        langs, scores, rejected = [], [], []
        for i in range(0, len(texts), 64):
            part = texts[i : i + 64]
            tf = np.stack([counts(t or "") for t in part])
            bands = _band(tf.sum(axis=1))
            sims = vector(tf, self.idf) @ self.centroids.T
            for t, s, band in zip(part, sims, bands, strict=True):
                if t is None or not len(s) or not any(map(str.isalpha, t)):
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    rejected.append(True)
                else:
                    j = int(s.argmax())
                    langs.append(self.langs[j])
                    scores.append(float(min(1.0, max(0.0, s[j]))))
                    rejected.append(bool(s[j] < self.floors[j][band]))
        return langs, scores, rejected


def is_held_out(id_col: str, fold: int = 0) -> F.Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS)) == fold


def fit_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Fit on at most ``sample`` labelled training documents a language, those
    of the smallest id hashes. Executors count the n-grams of their whole
    texts; the driver holds one language's counts at a time.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~F.coalesce(is_held_out(id_col), F.lit(False)))
    labelled = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("o"), F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike(r"\p{L}"))
    per = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    # a uniform share of the hash range first, so that few texts are sorted; then the exact bound
    share = F.coalesce(F.least(F.lit(1.0), F.lit(2.0 * sample) / F.col("n") + 1e-3), F.lit(1.0))
    per = cut(per)
    some = labelled.join(F.broadcast(per) if per.count() <= MANY_LABELS else per, "lang").where((F.col("o").cast("double") / F.lit(2.0**64) + 0.5) <= share)
    best = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("o", "i"))).where(F.col("r") <= sample)
    rows = cut(best.select("lang", "o", "i", "text").mapInArrow(_count_texts, "lang string, o long, i string, tf binary, lead binary").orderBy("lang", "o", "i"))
    n, df = 0, np.zeros(DIMS, np.int64)
    for row in rows.toLocalIterator():
        n, df = n + 1, df + (np.frombuffer(row.tf, "<f4") > 0)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    texts = lambda: ((lang, list(own)) for lang, own in groupby(rows.toLocalIterator(), key=lambda r: r.lang))
    vectors = lambda own: vector(np.stack([np.frombuffer(r.tf, "<f4") for r in own]), idf).astype(np.float32)
    cents, owners, floors = [], [], []
    for lang, own in texts():
        c = _centroids(vectors(own), CENTROIDS)
        cents.append(c)
        owners += [lang] * len(c)
    every = np.concatenate(cents) if cents else np.zeros((0, DIMS), np.float32)
    for lang, own in texts():
        x = vectors(own)
        true = np.nonzero(np.array(owners)[(x @ every.T).argmax(axis=1)] == lang)[0]  # of the others the label is likely wrong
        floors += [_floors(x[true], [np.frombuffer(own[i].lead, "<u2") for i in true], idf)] * owners.count(lang)
    return LanguageModel(idf, every, owners, floors)


def _count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [trigrams(t) for t in batch.column(3).to_pylist()]
        tf = pa.array([np.bincount(x, minlength=DIMS).astype("<f4").tobytes() for x in found], pa.binary())
        lead = pa.array([x[: 1 << (BANDS - 1)].astype("<u2").tobytes() for x in found], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], tf, lead], names=["lang", "o", "i", "tf", "lead"])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(id, lang_pred, score, rejected), with ``keep`` every column of ``docs``
    and those three behind; given columns of those names give way to them.

    Null texts and texts without a letter are ``und``, score 0, rejected. Of
    equally similar languages the one first in alphabetical order is taken.
    """
    spark: SparkSession = docs.sparkSession
    if keep:
        docs = docs.drop(*[c for c in ("lang_pred", "score", "rejected") if c not in (id_col, text_col)])
    shared = spark.sparkContext.broadcast((model.idf, model.centroids, model.langs, model.floors))  # DIMS floats a centroid

    small_batches(spark)
    base = docs if keep else docs.select(id_col)
    sent = docs.select(*base.columns) if text_col in base.columns and dict(docs.dtypes)[text_col] == "string" else docs.select(*base.columns, F.col(text_col).cast("string").alias("__text"))
    at = sent.columns.index(text_col if sent.columns == base.columns else "__text")  # a kept text is sent once
    width = len(base.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*shared.value)
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                langs, scores, rejected = own.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*part.schema.names[:width], "lang_pred", "score", "rejected"])

    fields = ", ".join(f"`{c}` {t}" for c, t in base.dtypes)
    return sent.mapInArrow(run, f"{fields}, lang_pred string, score double, rejected boolean")
