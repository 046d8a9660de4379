"""Embedding near-duplicates by p-stable (Euclidean) hashing and exact cosines.

Unit vectors are projected on Gaussian directions, shifted and quantised; k
quantised values make a bucket, several tables of buckets are searched. k
grows with the logarithm of the number of distinct vectors, so that buckets of
unrelated vectors keep their size, and the number of tables follows from the
wanted recall at the threshold. Every link is an exact double-precision
cosine; a pair is counted in the first table that holds both.

Equal vectors are collapsed first. A bucket of more than CELL vectors is cut
into blocks and each pair of blocks is one bounded cell of work. Cells give
link counts and spanning forests, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postforge.operators.graph import connected_components, spanning_forest
from postforge.session import cut

WIDTH = 1.5
#: Chance of missing a pair exactly at the threshold.
MISS = 0.002
#: Unrelated vectors expected in a bucket.
CROWD = 150
CELL = 4096
#: Vectors of a cell that are held against all of it at once.
STRIP = 128
SEED = 7


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised projection agrees at this distance."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float) -> tuple[int, int]:
    """(projections per table, tables) for n distinct vectors."""
    near, far = collision(math.sqrt(max(0.0, 2 - 2 * threshold))), collision(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(n, 2) / CROWD) / -math.log(far)))
    return k, max(1, math.ceil(math.log(MISS) / math.log(1 - near**k)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows as double-precision unit vectors."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _valid_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, embedding) to (id, vec binary or null, high, low)."""
    for batch in batches:
        blobs, high, low = [], [], []
        for v in batch.column(1):
            blob = None
            if v.is_valid and len(v.values) and not v.values.null_count:
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all() and x.any():
                    blob = x.tobytes() if (x.astype(np.float32) != x).any() else x.astype(np.float32).tobytes() + b"f"
            h = xxhash.xxh3_128_digest(blob or b"")
            blobs.append(blob)
            high.append(h[:8])
            low.append(h[8:])
        two = [pa.array(np.frombuffer(b"".join(x), np.int64)) for x in (high, low)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary()), *two], names=["id", "vec", "high", "low"])


def _array(blobs: list[bytes]) -> np.ndarray:
    """Blobs of one length; single precision carries a mark behind."""
    if len(blobs[0]) % 4 == 1:
        return np.frombuffer(b"".join(b[:-1] for b in blobs), np.float32).reshape(len(blobs), -1).astype(np.float64)
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def _dims(blob: bytes) -> int:
    return (len(blob) - 1) // 4 if len(blob) % 4 == 1 else len(blob) // 8


def _hash(k: int, tables: int):
    """(cls, n, vec) to one row per table: (t, key, cls, n, vec, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple] = {}
        mul = np.random.default_rng(SEED).integers(1, 2**63, (tables, k), dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                blobs = part.column(2).to_pylist()
                keys = np.zeros((len(blobs), tables), np.uint64)
                for size in {len(b) for b in blobs}:
                    at = [i for i, b in enumerate(blobs) if len(b) == size]
                    x = unit(_array([blobs[i] for i in at]))
                    d = x.shape[1]
                    if d not in planes:
                        rng = np.random.default_rng([SEED, d])
                        planes[d] = (rng.standard_normal((d, tables * k)), rng.uniform(0, WIDTH, tables * k))
                    q = np.floor((x @ planes[d][0] + planes[d][1]) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(at), tables, k)
                    keys[at] = (q * mul).sum(axis=2, dtype=np.uint64) ^ np.uint64(d * 0x9E3779B97F4A7C15 % 2**64)
                n = len(blobs)
                take = np.repeat(np.arange(n), tables)
                held = pa.array([r.tobytes() for r in keys], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(keys.reshape(-1).view(np.int64)), part.column(0).take(pa.array(take)), part.column(1).take(pa.array(take)), part.column(2).take(pa.array(take)), held.take(pa.array(take))],
                    names=["t", "key", "cls", "n", "vec", "keys"],
                )

    return run


def _cell_links(threshold: float):
    """Rows sorted by (t, key, i, j) to (kind 0: cls, linked vectors; 1: cls, cls)."""

    def solve(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        for size in {_dims(r["vec"]) for r in rows}:
            own = [r for r in rows if _dims(r["vec"]) == size]
            if len(own) < 2:
                continue
            t = own[0]["t"]
            x = unit(np.concatenate([_array([r["vec"]]) for r in own]) if len({len(r["vec"]) for r in own}) > 1 else _array([r["vec"] for r in own]))
            cls, n = (np.array([r[c] for r in own], np.int64) for c in ("cls", "n"))
            side = np.array([r["side"] for r in own])
            across = own[0]["i"] != own[0]["j"]
            keys = np.frombuffer(b"".join(r["keys"] for r in own), np.uint64).reshape(len(own), -1)
            total = np.zeros(len(own), np.int64)
            edges = []
            for s in range(0, len(own), STRIP):
                dots = x[s : s + STRIP] @ x.T
                near = dots >= threshold - 1e-9
                near &= np.arange(s, s + len(near))[:, None] < np.arange(len(own))
                if across:
                    near &= side[s : s + STRIP, None] != side
                a, b = np.nonzero(near & (dots < threshold + 1e-9))  # the last digits decide: sums of one pair by itself
                for i in range(0, len(a), 4096):
                    c, d = a[i : i + 4096], b[i : i + 4096]
                    near[c, d] = np.einsum("ij,ij->i", x[c + s], x[d]) >= threshold
                a, b = np.nonzero(near)
                a += s
                if not len(a):
                    continue
                fresh = np.ones(len(a), bool)
                for u in range(t):  # counted in an earlier table
                    fresh &= keys[a, u] != keys[b, u]
                a, b = a[fresh], b[fresh]
                for c, d in ((a, b), (b, a)):
                    order = np.argsort(c, kind="stable")
                    starts = np.nonzero(np.diff(c[order], prepend=-1))[0]
                    if len(starts):
                        total[c[order][starts]] += np.add.reduceat(n[d[order]], starts)
                if len(a):
                    edges.append(spanning_forest(a, b))
            hit = np.nonzero(total)[0]
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(hit), np.int32)), pa.array(cls[hit]), pa.array(total[hit])], names=["kind", "a", "b"])
            if edges:
                a, b = spanning_forest(np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(a), np.int32)), pa.array(cls[a]), pa.array(cls[b])], names=["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and any(row[c] != held[0][c] for c in ("t", "key", "i", "j")):
                    if len(held) > 1:
                        yield from solve(held)
                    held = []
                held.append(row)
        if len(held) > 1:
            yield from solve(held)

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of ``vectors``.

    Null, empty, zero and non-finite vectors, and vectors of different
    lengths, link with nothing. Rows without an id are left out; rows that
    repeat an id are vectors of their own with one id.
    """
    rows = cut(vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).mapInArrow(_valid_bytes, "id long, vec binary, high long, low long"))
    good = rows.where("vec is not null")
    classes = cut(good.groupBy("high", "low").agg(F.min("id").alias("cls"), F.count("*").alias("n"), F.first("vec").alias("vec")))
    k, tables = plan(classes.count(), threshold)
    hashed = classes.select("cls", "n", "vec").mapInArrow(_hash(k, tables), "t int, key long, cls long, n long, vec binary, keys binary")
    hashed = cut(hashed)
    hot = hashed.groupBy("t", "key").agg(F.count("*").alias("m")).where(F.col("m") > CELL).select("t", "key", F.ceil(F.col("m") / (CELL // 2)).alias("blocks"))
    side = F.pmod(F.xxhash64("cls"), F.col("blocks")).alias("side")
    blocked = hashed.join(hot, ["t", "key"]).select("*", side).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = blocked.select("t", "key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "cls", "n", "vec", "keys")
    zero = F.lit(0).cast("long")
    plain = hashed.join(hot, ["t", "key"], "left_anti").select("t", "key", zero.alias("i"), zero.alias("j"), zero.alias("side"), "cls", "n", "vec", "keys")
    cells = plain.unionByName(dealt).repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    found = cut(cells.mapInArrow(_cell_links(threshold), "kind int, a long, b long"))
    links = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("more"))
    reach = connected_components(found.where("kind = 1").select("a", "b"))
    done = classes.select("high", "low", "cls", "n").join(links, F.col("cls") == links["a"], "left").join(reach, F.col("cls") == reach["node"], "left")
    done = done.select("high", "low", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component_id"))
    out = good.select("id", "high", "low").join(done, ["high", "low"]).select("id", "n_links", "component_id")
    alone = rows.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
