"""Whitening against a full eigendecomposition of the exact covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from wavecohort.llm import whiten

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), *[T.StructField(c, T.StringType()) for c in ("x", "_key", "component", "n", "w")]])


def table(spark, rows):
    return spark.createDataFrame([(i, v, *"ABCDE") for i, v in rows], SCHEMA).repartition(4)


def exact(vectors):
    """Integer vectors, their sums, covariance in rationals rounded once, deviations."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    far = [[n * r[j] - sums[j] for j in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in far), n**3)) for j in range(d)] for i in range(d)])
    return np.array(far, float) / n, cov, [sum(v * v for v in r) for r in far]


def checked(spark, rows, good, components=32):
    got = whiten.whitened(table(spark, rows), components).collect()
    far, cov, deviations = exact([v for _, v in good])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-11 * values[0]).sum()))
    assert len(got) == len(good) * k
    assert {r.n for r in got} == {len(good)} and max(r.identity_error for r in got) < 1e-9
    assert len({r.identity_error for r in got}) == 1
    by_row = {}
    for r in got:
        by_row.setdefault((r.vec_id, int(r.deviation)), []).append(r)
    assert sorted(by_row, key=str) == sorted({(i, d) for (i, _), d in zip(good, deviations)}, key=str)
    want = far @ vectors[:, :k] / np.sqrt(values[:k])
    signs = np.zeros(k)
    for (i, _), d, w in zip(good, deviations, want):
        for r in by_row[i, d]:
            c = r.component - 1
            assert abs(r.explained - values[c] / np.trace(cov)) <= 1e-12
            signs[c] = signs[c] or np.sign(r.whitened * w[c])
            assert abs(r.whitened - signs[c] * w[c]) <= 1e-8 * (1 + abs(w[c]))


def test_equals_a_full_decomposition(sent):
    draw = np.random.default_rng(4)
    rows = [(i, (draw.standard_normal(20) * np.linspace(0.5, 3, 20)).astype(np.float32).tolist()) for i in range(400)]
    checked(sent, rows, rows)
    checked(sent, rows, rows, components=3)


def test_odd_vectors_are_left_out_and_repeats_count(sent):
    draw = np.random.default_rng(5)
    good = [(i % 50, draw.standard_normal(5).astype(np.float32).tolist()) for i in range(60)]
    good += [(None, good[0][1])] * 40 + [(0, good[0][1])] * 2  # a third of the rows are one vector
    bad = [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0, 4.0]), (903, [1.0, math.nan, 2.0, 3.0, 4.0]), (904, [1.0, math.inf, 2.0, 3.0, 4.0]), (905, [1.0, 2.0]), (906, [1e30, 0.0, 0.0, 0.0, 0.0])]
    checked(sent, good + bad, good)


def test_low_rank_and_large_numbers(sent):
    rows = [(i, [float(i), 2.0 * i, 7.0, 1e6 * (i % 7)]) for i in range(200)]
    checked(sent, rows, rows)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, None)], [(1, []), (2, [])]])
def test_nothing_varies(sent, rows):
    assert whiten.whitened(table(sent, rows)).collect() == []


def test_deviations_beyond_64_bits_are_exact():
    x = np.array([[2**51, 5], [0, 7]], np.int64)
    centre = whiten.Centre(10**9, (10**9 * 17 + 3, 10**9 * 2 + 1))
    want = [sum((10**9 * v - s) ** 2 for v, s in zip(r, centre.sums)) for r in x.tolist()]
    assert [w if w < 10**38 else None for w in want] == [None if d is None else int(d) for d in centre.deviations(x).to_pylist()]


@pytest.mark.parametrize("length, wanted, space", [(64, 4, 14), (150, 6, 30), (64, 32, None), (6, 32, None), (1, 1, None)])
def test_solver_with_restarts_and_equal_eigenvalues(length, wanted, space):
    draw = np.random.default_rng(6)
    turn = np.linalg.qr(draw.standard_normal((length, length)))[0]
    values = np.sort(np.concatenate([np.full(min(3, length), 9.0), draw.random(max(0, length - 3)) * 8]))[::-1]
    full = (turn * values) @ turn.T
    got, vectors = whiten.leading(lambda block: full @ block, length, wanted, space)
    wanted = min(wanted, length)
    assert np.abs(got - values[:wanted]).max() < 1e-13 * 9
    assert np.linalg.norm(full @ vectors - vectors * got, axis=0).max() < 5e-14 * 9
    assert np.abs(vectors.T @ vectors - np.eye(wanted)).max() < 1e-13


def test_minres_solves_shifted_systems_in_a_complement():
    draw = np.random.default_rng(7)
    turn = np.linalg.qr(draw.standard_normal((30, 30)))[0]
    full = (turn * np.arange(1.0, 31)) @ turn.T
    held = turn[:, -2:]
    right = draw.standard_normal((30, 3))
    right -= held @ (held.T @ right)
    shifts = np.array([30.0, 29.0, 20.5])
    t = whiten.minres(lambda b: full @ b, shifts, right, held, 60, 1e-12)
    assert np.abs(full @ t - t * shifts - right).max() < 1e-8 and np.abs(held.T @ t).max() < 1e-9
