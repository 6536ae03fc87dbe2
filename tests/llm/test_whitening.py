"""Whitening against numpy and against whole numbers of any size."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import queries as q
from strataloom.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, label int"


def check(got, rows, components=4):
    """rows: (vec_id, list of floats) of the remaining rows, ids unique."""
    x = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in rows}
    fit = sorted({tuple(v) for v in x.values()})
    n, d = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(d)]
    covariance = np.array([[float(Fraction(sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in fit), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, d)
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, c) for i in x for c in range(1, k + 1))
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(1, k + 1):
        want = {i: sum((v[j] - sums[j] / n) * vectors[j, c - 1] for j in range(d)) / math.sqrt(values[c - 1]) for i, v in x.items()}
        sign = min((1, -1), key=lambda s: sum(abs(s * by[i, c].whitened - want[i]) for i in x))
        assert max(abs(sign * by[i, c].whitened - want[i]) for i in x) < 1e-6
        assert all(abs(by[i, c].explained / (values[c - 1] / np.trace(covariance)) - 1) < 1e-9 for i in x)
    for r in got:
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x[r.vec_id], sums)) and r.identity_error < 1e-9


def test_whole_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in q.table(spark, sf_dir, "embeddings").limit(10**6).collect()]
    got = q.op13_whitening(spark, sf_dir).collect()
    values = {(r.vec_id, r.component): r for r in got}
    x = np.floor(256 * np.array([v for _, v in rows], dtype=np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    e, vectors = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    want = (x - sums / n) @ vectors[:, :-5:-1] / np.sqrt(e[:-5:-1])
    have = np.array([[values[i, c].whitened for c in range(1, 5)] for i, _ in rows])
    assert np.minimum(np.abs(have - want).max(axis=0), np.abs(have + want).max(axis=0)).max() < 1e-9
    assert [values[i, 1].deviation for i, _ in rows] == ((n * x - sums) ** 2).sum(axis=1).tolist()
    assert all(r.n == n and r.identity_error < 1e-9 and abs(r.explained - e[-r.component] / e.sum()) < 1e-9 for r in got)


def test_bad_rows_copies_and_clashing_names(spark):
    rnd = np.random.default_rng(2)
    good = [(i, [float(v) for v in rnd.normal(size=5) * [5, 4, 3, 2, 1]]) for i in range(60)]
    good += [(100 + i, good[3][1]) for i in range(25)]  # copies count once
    bad = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [float("nan")] * 5), (203, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (204, [1e30] * 5), (205, [1.0]), (206, [])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in good + bad], SCHEMA)
    for name in ("x", "v", "n", "d", "at", "component", "deviation"):
        frame = frame.withColumn(name, F.lit("other"))
    check(w.whitened_components(frame.repartition(4)).collect(), good)


def test_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 0.0]), (None, [0.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0])]
    got = w.whitened_components(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    assert sorted(map(str, ((r.vec_id, r.component) for r in got))) == sorted(map(str, [(i, c) for i, _ in rows for c in (1, 2)]))
    assert {r.n for r in got} == {3}


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_nothing_remains(spark, rows):
    assert w.whitened_components(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect() == []


def test_constant_entries_have_no_component(spark):
    got = w.whitened_components(spark.createDataFrame([(i, [float(i), 2.0], 0) for i in range(4)], SCHEMA)).collect()
    assert [r.whitened is None for r in sorted(got, key=lambda r: (r.vec_id, r.component))] == [False, True] * 4
    alone = w.whitened_components(spark.createDataFrame([(1, [3.0, 2.0], 0)], SCHEMA)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained) for r in alone] == [(1, 0, None, 0.0)] * 2


def test_numbers_beyond_64_bits_stay_exact(spark):
    """Entries near the limit: squares of centred values need more than a long."""
    rows = [(i, [float((-1) ** i * (1 << 43) + i * 4096), float(i * i * (1 << 30)), float(i)]) for i in range(9)]
    got = w.whitened_components(spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>"), components=1).collect()
    x = [[math.floor(256 * c) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    want = [sum((9 * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    assert [r.deviation for r in sorted(got, key=lambda r: r.vec_id)] == [v if v < 1 << 63 else None for v in want]
    assert got[0].identity_error < 1e-6


@pytest.mark.parametrize("largest", [10, 1 << 31, 1 << 45, 1 << 60])
def test_square_sums(largest):
    rows = np.random.default_rng(1).integers(-largest, largest + 1, size=(3, 50))
    assert w.square_sums(rows, largest) == [sum(int(v) ** 2 for v in row) for row in rows]
    assert w.square_sums(rows.astype(object), largest) == [sum(int(v) ** 2 for v in row) for row in rows]
