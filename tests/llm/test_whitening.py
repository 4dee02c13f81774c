"""Whitening against exact fractions and numpy's own covariance."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabgauge.llm import whitening as w

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, component string, n int"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame(
        [(i, v, 0, "x", "c", 3) for i, v in zip(ids, vectors)], SCHEMA
    )


def whole(vector):
    return tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vector)


@pytest.mark.parametrize("spread", [50, 2**30, 2**61])
def test_cross_products_are_exact(spread):
    rnd = np.random.default_rng(spread)
    x = rnd.integers(-spread, spread, (130, 5))
    x[:, 2] = 7
    sums, pairs = w.cross_products(x)
    big = x.astype(object)
    assert sums == big.sum(axis=0).tolist()
    for (j, k), value in pairs.items():
        assert value == int((big[:, j] * big[:, k]).sum())
    for value in [*sums, *pairs.values()]:
        assert sum(part << (w.LIMB * i) for i, part in enumerate(w.limbs(value))) == value


def check(got, vectors, components):
    """The result rows against the contract, for vectors that all stay."""
    xs = [whole(v) for v in vectors]
    fit = sorted(set(xs))
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    cov = np.array(
        [
            [
                (n * sum(x[j] * x[k] for x in fit) - sums[j] * sums[k]) / (n * n)
                for k in range(d)
            ]
            for j in range(d)
        ]
    )
    values = np.linalg.eigvalsh(cov)[::-1]
    rows = {}
    for r in got:
        assert r.n == n
        assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(xs[r.vec_id], sums))
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(cov), rel=1e-9)
        assert r.identity_error < 1e-9
        rows[r.vec_id, r.component] = r.whitened
    count = min(components, d)
    assert len(rows) == len(vectors) * count
    places = {x: xs.index(x) for x in fit}
    white = np.array([[rows[places[x], c + 1] for c in range(count)] for x in fit])
    centred = white - white.mean(axis=0)
    assert np.abs(centred.T @ centred / n - np.eye(count)).max() < 1e-9
    # Distances along the components agree with the vectors, so the directions do.
    scaled = white * np.sqrt(values[:count])
    moved = np.array([[a - s / n for a, s in zip(x, sums)] for x in fit])
    assert np.allclose(moved.T @ scaled / n, cov @ np.linalg.lstsq(moved, scaled, rcond=None)[0])
    for i, x in enumerate(xs):
        for c in range(count):
            assert rows[i, c + 1] == rows[places[x], c + 1]


@pytest.mark.parametrize("d,components", [(6, 16), (20, 16), (1, 16), (9, 4)])
def test_against_plain_python(spark, monkeypatch, d, components):
    monkeypatch.setattr(w, "BLOCK_ROWS", 70)
    monkeypatch.setattr(w, "OUTPUT_ROWS", 50)
    rnd = random.Random(d)
    vectors = [[rnd.gauss(j, 0.3 + j) for j in range(d)] for _ in range(300)]
    vectors += vectors[:80] + [vectors[0]] * 40
    got = w.whiten(frame(spark, vectors).repartition(5), components=components).collect()
    check(got, vectors, components)


def test_damaged_vectors_have_no_rows(spark):
    good = [[1.0, 2.0], [2.0, 1.0], [3.0, 3.5]]
    bad = [None, [], [None, 1.0], [float("nan"), 1.0], [1.0, float("inf")], [1.0], [1.0, 2.0, 3.0]]
    df = frame(spark, good + bad)
    got = w.whiten(df).collect()
    assert sorted({r.vec_id for r in got}) == [0, 1, 2]
    check(got, good, 16)
    assert list(got[0].asDict()) == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error",
    ]


def test_without_variance(spark):
    flat = w.whiten(frame(spark, [[1.0, 2.0]] * 3)).collect()
    assert len(flat) == 6 and {r.n for r in flat} == {1} and {r.deviation for r in flat} == {0}
    assert {(r.whitened, r.identity_error, r.explained) for r in flat} == {(None, None, 0.0)}
    line = w.whiten(frame(spark, [[float(i), 2.0 * i, 1.0] for i in range(9)])).collect()
    assert {r.component for r in line if r.whitened is not None} == {1}
    assert all(r.identity_error < 1e-9 for r in line)


def test_repeated_and_null_ids_keep_their_rows(spark):
    vectors = [[0.5, 1.0], [1.5, 3.0], [2.5, 1.0]]
    got = w.whiten(frame(spark, [*vectors, vectors[0]], [None, 4, 4, None])).collect()
    assert sorted((r.vec_id is None, r.component) for r in got) == sorted(
        (none, c) for none in (True, True, False, False) for c in (1, 2)
    )


def test_huge_entries(spark):
    got = w.whiten(frame(spark, [[1e38, 1.0], [-1e38, 2.0], [0.0, 4.0]])).collect()
    assert {r.deviation for r in got if r.vec_id == 0} == {None}
    assert all(math.isfinite(r.explained) for r in got)


def test_empty(spark):
    none = w.whiten(frame(spark, []))
    assert none.collect() == [] and none.columns[0] == "vec_id"
    assert w.whiten(frame(spark, [None, []])).select(F.count("*")).first()[0] == 0
