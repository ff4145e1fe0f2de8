"""Rank-one spectra and whitening against dense eigendecompositions."""

import math

import numpy as np
import pytest

from ledgerloom.llm import queries
from ledgerloom.llm import whitening as module
from ledgerloom.llm.spectrum import Spectrum, secular_roots
from ledgerloom.llm.whitening import whiten

RNG = np.random.default_rng(4)
SMOOTH = np.floor(256 * RNG.normal(size=(700, 24)) / np.sqrt(1 + np.arange(24)))
CASES = {
    "plain": SMOOTH,
    "shifted": SMOOTH[:, :9] + 1e6,
    "few rows": SMOOTH[:5],
    "equal rows": np.repeat(SMOOTH[:1], 40, 0),
    "zeros": np.zeros((9, 6)),
    "one row": SMOOTH[:1],
    "one column": SMOOTH[:, :1],
    "low rank": np.floor(SMOOTH[:, :3] @ RNG.normal(size=(3, 15))),
    "equal eigenvalues": np.vstack([np.eye(12), -np.eye(12)]) * 100,
    "repeated axes": 256.0 * np.eye(16)[RNG.integers(0, 16, 300)],
}


@pytest.mark.parametrize("size", [1, 13, 256])
@pytest.mark.parametrize("name", sorted(CASES))
def test_spectrum_of_blocks(name, size):
    rows = CASES[name]
    halves = []
    for half in (rows[: len(rows) // 3], rows[len(rows) // 3 :]):
        halves.append(Spectrum.empty(rows.shape[1]))
        for begin in range(0, len(half), size):
            halves[-1].add_rows(half[begin : begin + size])
    found = halves[0]
    found.add(halves[1])
    centred = rows - rows.mean(0)
    scatter = centred.T @ centred
    scale = max(np.abs(scatter).max(), 1.0)
    assert found.n == len(rows) and np.allclose(found.mean, rows.mean(0), rtol=1e-12)
    assert np.abs(found.values - np.linalg.eigvalsh(scatter)).max() < 1e-11 * scale
    assert np.abs(found.vectors.T @ found.vectors - np.eye(len(scatter))).max() < 1e-11
    assert np.abs(scatter @ found.vectors - found.vectors * found.values).max() < 1e-11 * scale


def test_roots_interlace():
    for k in (1, 2, 5, 40):
        poles, weights = np.sort(RNG.random(k)) * 10.0 ** RNG.integers(-6, 6), RNG.random(k) ** 6 + 1e-12
        roots, delta = secular_roots(poles, weights)
        assert (roots[:-1] <= poles[1:]).all() and (roots >= poles).all()
        dense = np.linalg.eigvalsh(np.diag(poles) + np.outer(np.sqrt(weights), np.sqrt(weights)))
        assert np.allclose(roots, dense, rtol=1e-10, atol=1e-13 * max(1, poles.max()))


def expected(rows, components=4, scale=256):
    """vec_id to deviation and coordinates, shares of variance, and n; coordinates of positive-most axes."""
    kept = {}
    for i, (vec_id, vector) in enumerate(rows):
        if vector and all(c is not None and math.isfinite(c) for c in vector):
            kept[i] = (vec_id, [math.floor(scale * c) for c in vector])
    d = max((len(x) for _, x in kept.values()), default=0)
    kept = {i: (v, x + [0] * (d - len(x))) for i, (v, x) in kept.items()}
    fit = sorted({tuple(x) for _, x in kept.values()})
    n, sums = len(fit), [sum(column) for column in zip(*fit)]
    x = np.array(fit, float)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True).reshape(d, d))
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = []
    for vec_id, row in kept.values():
        deviation = sum((n * c - s) ** 2 for c, s in zip(row, sums))
        out.append((vec_id, deviation, (np.array(row) - x.mean(0)) @ vectors / np.sqrt(values)))
    return n, values / np.trace(np.cov(x.T, bias=True).reshape(d, d)), out


def compared(got, rows):
    n, shares, want = expected(rows)
    by_row = {}
    for row in got:
        by_row.setdefault((row.vec_id, row.deviation), {})[row.component] = row
    assert len(got) == sum(1 for _ in want) * len(shares)
    signs = np.sign([max((w[2][k] for w in want), key=abs) for k in range(len(shares))])
    mine = [max((row.whitened for row in got if row.component == k + 1), key=abs) for k in range(len(shares))]
    signs *= np.sign(mine)
    for vec_id, deviation, coordinates in want:
        found = by_row[vec_id, deviation]
        assert sorted(found) == list(range(1, len(shares) + 1))
        for k, row in found.items():
            assert row.n == n and row.identity_error < 1e-9
            assert abs(row.whitened - signs[k - 1] * coordinates[k - 1]) < 1e-7
            assert abs(row.explained - shares[k - 1]) < 1e-9


def vectors_of(spark, rows):
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr(
        "vec_id", "embedding", "vec_id as x", "'e' as whitened", "1 as n", "2 as slot"
    )
    return table.repartition(5)


def test_rows_with_awkward_vectors(spark, monkeypatch):
    """NULL and non-finite entries, repeated ids and vectors, NULL ids, short vectors; spectra combined on two levels."""
    monkeypatch.setattr(module, "FAN", 2)
    base = (RNG.normal(size=(60, 7)) / np.arange(1, 8)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(base)] + [(0, base[3]), (-5, base[4]), (None, base[5]), (70, [0.5, -0.25])]
    rows += [(80, None), (81, []), (82, [1.0, None, *base[0][2:]]), (83, [float("nan")] * 7), (84, [float("-inf")] * 7)]
    rows += [(90, [0.5, -0.25, 0.0, 0.0, 0.0, 0.0, 0.0]), (91, [0.5, -0.25, -0.0, 0.0, 0.0, 0.0, 0.0])]
    compared(whiten(vectors_of(spark, rows)).collect(), rows)


def test_vectors_without_variance(spark):
    got = whiten(vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(got)] == [
        (i, k, 1, 0, None, None, None) for i in (1, 2) for k in (1, 2)
    ]
    line = whiten(vectors_of(spark, [(i, [float(i), 2.0 * i]) for i in range(5)])).collect()
    assert {(r.component, r.whitened is None, round(r.explained, 9)) for r in line} == {(1, False, 1.0), (2, True, 0.0)}
    assert max(r.identity_error for r in line) < 1e-9


def test_large_entries_are_exact(spark):
    rows = [(i, [float(2**60), float(i)]) for i in range(4)]
    got = {r.vec_id: r.deviation for r in whiten(vectors_of(spark, rows), scale=1).collect()}
    assert got == {i: (4 * i - 6) ** 2 for i in range(4)}
    far = [(0, [1e30]), (1, [-1e30]), (2, [0.0])]
    assert {r.deviation for r in whiten(vectors_of(spark, far)).collect() if r.vec_id != 2} == {None}


def test_empty_table(spark):
    empty = whiten(spark.createDataFrame([], "vec_id bigint, embedding array<float>"))
    assert empty.collect() == [] and [f.dataType.simpleString() for f in empty.schema] == [
        "bigint", "int", "bigint", "bigint", "double", "double", "double"
    ]


def test_registered_query(spark, tmp_path):
    base = (RNG.normal(size=(200, 16)) / np.sqrt(np.arange(1, 17))).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(base)] + [(500, base[0]), (501, None)]
    vectors_of(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    compared(queries.op13_whitening(spark, str(tmp_path)).collect(), rows)
