"""Whitening against numpy and whole-number arithmetic."""

import math
import random

import numpy as np
import pytest
from compare import SMALL

from salesloom.llm import queries, whitening

NAMES = "vec_id long, embedding array<float>, row string, index string, x string, whitening string"


def table(spark, vectors):
    return spark.createDataFrame([(k, v, "a", "b", "c", "d") for k, v in enumerate(vectors)], NAMES)


def expected(vectors, components):
    """By vector: deviation and |whitened|; then explained shares."""
    kept = {k: v for k, v in enumerate(vectors) if v and all(e is not None and math.isfinite(e) for e in v)}
    x = {k: [math.floor(1024 * float(np.float32(e))) + 100000 for e in v] for k, v in kept.items()}
    n = len(x)
    sums = [sum(c) for c in zip(*x.values())]
    deviation = {k: sum((n * a - s) ** 2 for a, s in zip(v, sums)) for k, v in x.items()}
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in x.values()])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    order = order[values[order] > 1e-12 * values.sum()]
    placed = centred @ axes[:, order] / np.sqrt(values[order])
    return deviation, dict(zip(x, placed)), values[order] / values.sum()


def check(rows, vectors, components):
    deviation, placed, share = expected(vectors, components)
    assert {r.vec_id: int(r.whitening.deviation) for r in rows} == deviation
    assert len(rows) == len(deviation)
    got = np.array([r.whitening.whitened for r in rows])
    want = np.array([placed[r.vec_id] for r in rows])
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * signs).max() < 1e-7
    assert np.allclose(rows[0].whitening.explained, share, rtol=1e-6)
    assert rows[0].whitening.identity_error < 1e-8 and rows[0].whitening.n == len(deviation)


@pytest.fixture(scope="module")
def vectors():
    draw = random.Random(5)
    out = [[draw.gauss(0, 0.1 * (k + 1)) for k in range(12)] for _ in range(300)]
    bad = [None, [], [None] * 12, [float("nan")] + [0.0] * 11, [0.0] * 11 + [float("-inf")]]
    return out + bad + [out[0]] * 150


def test_whitening_is_numpy(spark, vectors, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 16)
    monkeypatch.setattr(whitening, "BLOCKS", 1000)
    monkeypatch.setattr(whitening, "COLUMNS", 5)  # several column blocks
    rows = whitening.whiten(table(spark, vectors).repartition(7)).collect()
    check(rows, vectors, 8)
    assert rows[0]["index"] == "b" and rows[0]["x"] == "c"


def test_other_lengths_are_left_out(spark, vectors):
    rows = whitening.whiten(table(spark, [*vectors, [1.0, 2.0], [0.5] * 20]), components=3).collect()
    check(rows, vectors, 3)


def test_no_spread_and_no_rows(spark):
    for vectors, n in (([[0.5, 0.25]] * 4, 4), ([[1.0, 2.0]], 1), ([], 0), ([None, []], 0)):
        rows = whitening.whiten(table(spark, vectors)).collect()
        assert len(rows) == n
        assert all(r.whitening.whitened == [] and r.whitening.deviation == 0 for r in rows)


def test_large_entries(spark):
    rows = whitening.whiten(table(spark, [[3.0e38, 1.0], [-3.0e38, 2.0], [0.0, 4.0]])).collect()
    assert len(rows) == 3 and all(math.isfinite(v) for r in rows for v in r.whitening.whitened)


def test_query(spark):
    source = [r.embedding for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()]
    rows = queries.queries()["op12_whitening"](spark, SMALL).collect()
    deviation, placed, share = expected(source, 8)
    assert len(rows) == 8 * len(deviation)
    for r in rows:
        assert r.deviation == deviation[r.vec_id] and r.n == len(deviation)
        assert abs(abs(r.whitened) - abs(placed[r.vec_id][r.component - 1])) < 1e-6
        assert abs(r.explained - share[r.component - 1]) < 1e-6
        assert r.identity_error < 1e-8
