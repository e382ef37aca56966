"""Matrix correction against the definitions on whole numpy matrices."""

from __future__ import annotations

import numpy as np
import pytest

from strandframe.operators import contacts as C


def made(seed, size=40, empty=(3, 17)):
    rng = np.random.default_rng(seed)
    x = rng.poisson(60 / (1 + np.abs(np.subtract.outer(np.arange(size), np.arange(size)))) ** 0.5).astype(float)
    x = np.triu(x) + np.triu(x, 1).T
    x[list(empty)] = 0
    x[:, list(empty)] = 0
    return x


def pixels(spark, x, upper=True):
    rows = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(np.triu(x) if upper else x), strict=True)]
    return spark.createDataFrame(rows, "bin1 long, bin2 long, n double").repartition(3)


def correction(x, tolerance, skipped=0):
    """Every round on the whole matrix; the first diagonals are in no sum."""
    x, bias = x.copy(), np.ones(len(x))
    near = np.abs(np.subtract.outer(np.arange(len(x)), np.arange(len(x)))) < skipped
    for _ in range(599):
        some = x.sum(1) != 0
        s = np.where(near, 0, x).sum(1)
        step = np.where(some, 1 + 0.8 * (s / s[some].mean() - 1), 1)
        bias *= step
        x = x / step[:, None] / step[None, :]
        if np.abs(step - 1).max() < tolerance:
            break
    return x * bias[some].mean() ** 2


@pytest.mark.parametrize("few", [True, False])
def test_symmetric(spark, few, monkeypatch):
    if not few:
        monkeypatch.setattr(C, "BROADCAST_BINS", 3)
    x = made(1)
    got = {(r["bin1"], r["bin2"]): r["balanced"] for r in C.balanced(pixels(spark, x), tolerance=1e-5 if few else 1e-2).collect()}
    want = correction(x, 1e-5 if few else 1e-2)
    assert set(got) == {(i, j) for i, j in zip(*np.nonzero(np.triu(x)), strict=True)}
    assert all(abs(v - want[k]) < 1e-8 * (1 + want[k]) for k, v in got.items())
    if few:
        assert np.ptp([sum(v for k, v in got.items() if b in k) for b in range(40) if b not in (3, 17)]) < 1e-2
        assert C.balanced(pixels(spark, x).limit(0)).count() == C.balanced_both_ways(pixels(spark, x).limit(0)).count() == 0


def test_without_thin_bins(spark):
    x = made(2)
    x[5] = x[:, 5] = 0
    x[5, 20] = x[20, 5] = 30  # a thin bin
    far = np.where(np.abs(np.subtract.outer(np.arange(40), np.arange(40))) < 2, 0, x)
    kept = (far.sum(0) > 40) & ((far > 0).sum(0) > min(4.0, 10))
    assert 30 < kept.sum() < 38
    want = correction(np.where(np.outer(kept, kept), far, 0), 1e-6, 3)
    middle = np.median(np.diagonal(want, 2))
    for k in (0, 1):
        for i in range(40 - k):
            want[i, i + k] = middle if kept[i] and kept[i + k] else 0
    got = {(r["bin1"], r["bin2"]): r["balanced"] for r in C.corrected_safely(pixels(spark, x), 40).collect()}
    assert set(got) == {(i, j) for i, j in zip(*np.nonzero(np.triu(want)), strict=True)}
    assert all(abs(v - want[k]) < 1e-6 * (1 + want[k]) for k, v in got.items())


@pytest.mark.parametrize("few", [True, False])
def test_both_ways(spark, few, monkeypatch):
    if not few:
        monkeypatch.setattr(C, "BROADCAST_BINS", 3)
    x = np.random.default_rng(3).poisson(2.0, (12, 12)).astype(float)
    x[4] = 0
    want, rounds = x.copy(), 20 if few else 2
    for _ in range(rounds):
        for axis in (1, 0):
            s = want.sum(axis)
            factor = np.where(s > 0, s[s > 0].mean() / np.where(s > 0, s, 1), 1)
            want = want * (factor[:, None] if axis == 1 else factor[None, :])
    want *= x.sum() / want.sum()
    got = {(r["bin1"], r["bin2"]): r["balanced"] for r in C.balanced_both_ways(pixels(spark, x, upper=False), rounds).collect()}
    assert all(abs(got.get((i, j), 0) - want[i, j]) < 1e-9 for i in range(12) for j in range(12))
