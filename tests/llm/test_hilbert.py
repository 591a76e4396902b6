import itertools

import numpy as np
import pytest

from tillroll.llm import catalog, hilbert


def test_keys_walk_through_all_cells_step_by_step():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        key = hilbert.hilbert_keys(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def exact(vectors, k=10, every=100):
    found = {}
    for q, x in vectors.items():
        if q % every == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), p) for p, y in vectors.items() if p != q)
            found[q] = near[:k]
    return found


def held(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(found[r.query_id])
    return found


def same(found, expected):
    assert found.keys() == {q for q, near in expected.items() if near}
    for q, near in found.items():
        assert [p for _, p in near] == [p for _, p in expected[q]]
        assert np.allclose([d for d, _ in near], [d for d, _ in expected[q]])


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[200:340] = x[200]
    x[400] = x[200]
    return {i: v.astype(np.float64) for i, v in enumerate(x)}


def frame(spark, vectors, more=()):
    rows = [(i, [float(c) for c in v]) for i, v in vectors.items()]
    return spark.createDataFrame([*rows, *more], "vec_id long, embedding array<float>")


def test_exact_with_copies_and_odd_rows(spark, vectors, monkeypatch):
    monkeypatch.setattr(hilbert, "WINDOW", 5)
    monkeypatch.setattr(hilbert, "POINTS", 100)
    monkeypatch.setattr(hilbert, "QUERIES", 4)
    odd = [(1000, None), (1100, []), (1200, [0.0] * 8), (1300, [float("nan")] * 8), (1400, [None] * 8), (1500, [1.0, 2.0]),
           (None, [1.0] * 8), (1600, [float("inf")] * 8), (200, [float(c) for c in vectors[200]])]
    same(held(hilbert.search(frame(spark, vectors, odd)).collect()), exact(vectors))


def test_curves_alone_find_structured_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 3)) @ rng.normal(size=(3, 16))
    vectors = {i: v.astype(np.float32).astype(np.float64) for i, v in enumerate(x)}
    found, expected = held(hilbert.search(frame(spark, vectors), check=False).collect()), exact(vectors)
    hit = sum(len({p for _, p in found[q]} & {p for _, p in expected[q]}) for q in expected)
    assert hit >= 0.9 * 10 * len(expected)


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in rows}
    same(held(catalog.registered()["op6_hilbert_neighbours"](spark, sf_dir).collect()), exact(vectors))


def test_few_and_none(spark, vectors):
    few = {i: vectors[i] for i in (100, 5, 7)}
    same(held(hilbert.search(frame(spark, few)).collect()), exact(few))
    assert hilbert.search(frame(spark, few).limit(0)).count() == 0
