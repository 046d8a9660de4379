"""Keys of one high half in a line shard; a dense cell of vectors in little memory."""

import tracemalloc

import numpy as np
import pytest

from postforge.llm import lines, vectors


def test_keys_of_one_high_half_have_slots_of_their_own():
    rng = np.random.default_rng(3)
    high = np.concatenate([rng.integers(0, 2**63, 5000).astype(np.uint64), np.full(7, 5, np.uint64), np.full(2, 2**63, np.uint64)])
    low = rng.permutation(len(high)).astype(np.uint64) + np.uint64(2**40)
    shard = lines.Shard.unpack(lines.Shard.build(high, low, np.arange(len(high)), np.full(len(high), 2)).pack())
    known, owner = shard.owners(high, low)
    assert known.all() and owner.tolist() == list(range(len(high)))
    known, _ = shard.owners(np.full(3, 5, np.uint64), np.array([1, 2, 3], np.uint64))
    assert not known.any()
    three = lines.Shard.build(np.array([5, 5, 9], np.uint64), np.array([1, 2, 3], np.uint64), np.array([7, 8, 9]), np.array([2, 2, 2]))
    assert [x.tolist() for x in three.owners(np.array([5, 5, 9], np.uint64), np.array([1, 2, 3], np.uint64))] == [[True] * 3, [7, 8, 9]]
    with pytest.raises(ValueError, match="distinct"):
        lines.Shard.build(np.array([5, 5], np.uint64), np.array([1, 1], np.uint64), np.array([7, 8]), np.array([2, 2]))


def batch(rows):
    import pyarrow as pa

    kinds = {"t": pa.int32(), "key": pa.int64(), "i": pa.int64(), "j": pa.int64(), "side": pa.int64(), "cls": pa.int64(), "n": pa.int64(), "vec": pa.binary(), "keys": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in kinds.items()], names=list(kinds))


def cell(x, n):
    return [{"t": 0, "key": 1, "i": 0, "j": 0, "side": 0, "cls": i, "n": int(n[i]), "vec": v.tobytes(), "keys": np.array([1], np.uint64).tobytes()} for i, v in enumerate(x)]


def test_a_dense_cell_takes_little_memory():
    rng = np.random.default_rng(1)
    x = rng.normal(size=64) + 0.01 * rng.normal(size=(4096, 64))
    rows = batch(cell(x, np.ones(4096)))
    tracemalloc.start()
    found = list(vectors._cell_links(0.95)([rows]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6
    assert found[0].column(2).to_pylist() == [4095] * 4096


def test_ties_at_the_threshold_link_and_copies_count():
    x = np.array([[1.0, 0], [0.95, np.sqrt(1 - 0.95**2)], [0, 1.0], [1.0, 1e-12]])
    n = np.array([3, 5, 7, 2])
    u = vectors.unit(x)
    want = np.zeros(4, np.int64)
    for a in range(4):
        for b in range(4):
            if a != b and np.einsum("j,j->", u[a], u[b]) >= 0.95:
                want[a] += n[b]
    found = {a: b for r in vectors._cell_links(0.95)([batch(cell(x, n))]) for kind, a, b in zip(*map(lambda c: c.to_pylist(), r.columns), strict=True) if kind == 0}
    assert found == {i: int(w) for i, w in enumerate(want) if w}
