"""Whitening of embeddings by incremental eigendecomposition.

Every partition keeps the spectrum of its vectors by centred rank-one updates (``spectrum.py``); spectra are combined, a
few at a time and level by level, by one update per eigenpair and one for the difference of the means. The basis found is
refined by one distributed Rayleigh-Ritz step with the exact mean: the covariance in that basis is summed over all
vectors, where it is nearly diagonal, and solved once more. What is whitened is then measured on the fitted vectors.

Each distinct vector counts once in the fit. A partition's state is a d x d matrix, and no task combines more than
``FAN`` of them. Sums that results must hold exactly are decimals or whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.spectrum import Spectrum
from ledgerloom.session import cut

#: States combined by one task.
FAN = 16
#: Numbers of a block of vectors.
BLOCK = 1 << 20
#: Share of the trace below which a variance is taken for zero.
NO_VARIANCE = 1e-13

_STATE = "slot bigint, n bigint, totals array<decimal(38,0)>, mean array<double>, values array<double>, vectors array<double>"
_MATRIX = "slot bigint, entries array<double>"


def _scaled(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """Rows (vec_id, x) of the vectors without NULL, NaN or infinite entries, x the floor of scale times the entry."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    unfit = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(F.col("x").isNotNull() & ~unfit).withColumn(
        "x", F.transform("x", lambda c: F.floor(c * F.lit(float(scale))))
    )


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of batches with their vectors as rows of a matrix; missing entries are zero."""
    most = max(256, min(16 * d, BLOCK // d))
    for batch in batches:
        for begin in range(0, batch.num_rows, most):
            part = batch.slice(begin, most)
            column = part.column("x")
            flat, sizes = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
            x = np.zeros((part.num_rows, d), np.int64)
            x[np.arange(d) < sizes[:, None]] = flat
            yield part, x


def _exact_sum(x: np.ndarray) -> list[int]:
    largest = max(abs(int(x.max())), abs(int(x.min())))
    return [int(v) for v in (x if largest * len(x) < 1 << 62 else x.astype(object)).sum(0)]


def _state(slot: int, totals: list[int], found: Spectrum) -> pa.RecordBatch:
    decimals = pa.array([[Decimal(v) for v in totals]], pa.list_(pa.decimal128(38, 0)))
    floats = [pa.array([v.ravel()], pa.list_(pa.float64())) for v in (found.mean, found.values, found.vectors)]
    names = ["slot", "n", "totals", "mean", "values", "vectors"]
    return pa.RecordBatch.from_arrays([pa.array([slot]), pa.array([found.n]), decimals, *floats], names)


def _spectra(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, totals = Spectrum.empty(d), [0] * d
        for _, x in _blocks(batches, d):
            found.add_rows(x.astype(float))
            totals = [a + b for a, b in zip(totals, _exact_sum(x))]
        if found.n:
            yield _state(TaskContext.get().partitionId(), totals, found)

    return run


def _combined_spectra(group: pa.Table) -> pa.Table:
    found, totals = None, None
    for row in group.sort_by("slot").to_pylist():
        d = len(row["mean"])
        other = Spectrum(row["n"], np.array(row["mean"]), np.array(row["values"]), np.array(row["vectors"]).reshape(d, d))
        if found is None:
            found, totals = other, [int(v) for v in row["totals"]]
        else:
            found.add(other)
            totals = [a + int(b) for a, b in zip(totals, row["totals"])]
    return pa.Table.from_batches([_state(group.column("slot")[0].as_py() // FAN, totals, found)])


def _matrices(d: int, mean: np.ndarray, basis: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros((d, d)), False
        for _, x in _blocks(batches, d):
            turned = (x - mean) @ basis
            total += turned.T @ turned
            any_rows = True
        if any_rows:
            entries = pa.array([total.ravel()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), entries], ["slot", "entries"])

    return run


def _combined_matrices(group: pa.Table) -> pa.Table:
    total = np.sum([np.array(row["entries"]) for row in group.sort_by("slot").to_pylist()], axis=0)
    slot = group.column("slot")[0].as_py() // FAN
    return pa.table({"slot": pa.array([slot]), "entries": pa.array([total], pa.list_(pa.float64()))})


def _combined(states: DataFrame, combine: Callable[[pa.Table], pa.Table], schema: str) -> dict:
    """The one state that all states give, combined ``FAN`` at a time."""
    states = cut(states, "states")
    while states.count() > 1:
        states = cut(states.groupBy(F.expr(f"slot div {FAN}")).applyInArrow(combine, schema), "states")
    return states.first().asDict()


def _projection(d: int, n: int, totals: list[int], mean: np.ndarray, axes: np.ndarray):
    """Adds to rows (.., x) their exact ``deviation`` and ``whitened``, the coordinates on the axes; drops x."""

    def deviations(x: np.ndarray) -> list[int | None]:
        largest = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, totals))
        if largest * largest * d < 1 << 63:
            apart = n * x - np.array(totals, np.int64)
            return (apart * apart).sum(1).tolist()
        apart = n * x.astype(object) - np.array(totals, object)
        return [int(v) if v < 1 << 63 else None for v in (apart * apart).sum(1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, d):
            whitened = (x - mean) @ axes
            offsets = np.arange(len(x) + 1, dtype=np.int32) * axes.shape[1]
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(whitened.ravel()))
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(deviations(x), pa.int64()), values], ["vec_id", "deviation", "whitened"]
            )

    return run


def whiten(
    vectors: DataFrame, components: int = 4, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Coordinates of every vector on the first principal components, scaled to unit variance.

    Entries are x = floor(scale * entry). The fit takes every distinct x once: n of them, their mean, and the eigenvectors
    of their covariance (divisor n) by falling eigenvalue, the largest entry of each positive. One row per vector and
    component (from 1): vec_id, component, n, deviation (sum over dimensions of (n * x - sum)^2, exact; NULL beyond a
    long), whitened, explained (share of the variance), identity_error (of the whitened fit's covariance).

    Vectors that are NULL, empty or hold NULL or non-finite entries take no part; shorter vectors count as filled up with
    zeros. Repeated rows and ids each have their rows. A component without variance (all vectors equal, or fewer
    independent ones than components) has NULL in ``whitened`` and is left out of identity_error, which is NULL if none
    is left. Without vectors there are no rows. Equal eigenvalues leave their components in an arbitrary rotation. Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    rows = _scaled(vectors, vec_id, vector, scale).where(F.size("x") > 0)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fitted = cut(rows.select("x").distinct(), "fitted")
    d = fitted.agg(F.max(F.size("x"))).first()[0]
    if not d:
        return spark.createDataFrame([], schema)
    if fitted.where(F.size("x") < d).limit(1).count():
        # Vectors of other lengths may be equal once filled up.
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), d - F.size("x"))))
        fitted = cut(rows.select("x").distinct(), "fitted")

    state = _combined(fitted.mapInArrow(_spectra(d), _STATE), _combined_spectra, _STATE)
    n, totals = state["n"], [int(v) for v in state["totals"]]
    mean = np.array([float(Fraction(v, n)) for v in totals])
    basis = np.linalg.qr(np.array(state["vectors"]).reshape(d, d))[0]
    matrix = _combined(fitted.mapInArrow(_matrices(d, mean, basis), _MATRIX), _combined_matrices, _MATRIX)
    values, turns = np.linalg.eigh(np.array(matrix["entries"]).reshape(d, d) / n)
    trace, first = float(values.sum()), np.argsort(-values, kind="stable")[: min(components, d)]
    axes = basis @ turns[:, first]
    axes *= np.sign(axes[np.abs(axes).argmax(0), np.arange(len(first))])
    spread = values[first] > NO_VARIANCE * trace
    axes = axes / np.sqrt(np.where(spread, values[first], 1.0))

    project = _projection(d, n, totals, mean, axes)
    coordinates = "vec_id bigint, deviation bigint, whitened array<double>"
    sample = fitted.select(F.lit(0).cast("bigint").alias("vec_id"), "x").mapInArrow(project, coordinates)
    error = _identity_error(sample, np.flatnonzero(spread).tolist())
    parts = F.array(
        *[
            F.struct(
                F.lit(i + 1).cast("int").alias("component"),
                (F.col("whitened")[i] if spread[i] else F.lit(None).cast("double")).alias("whitened"),
                F.lit(float(max(values[first[i]], 0) / trace) if trace > 0 else None).cast("double").alias("explained"),
            )
            for i in range(len(first))
        ]
    )
    return (
        rows.mapInArrow(project, coordinates)
        .select("vec_id", "deviation", F.explode(parts).alias("part"))
        .select(
            "vec_id",
            "part.component",
            F.lit(n).cast("bigint").alias("n"),
            "deviation",
            "part.whitened",
            "part.explained",
            F.lit(error).cast("double").alias("identity_error"),
        )
    )


def _identity_error(sample: DataFrame, kept: list[int]) -> float | None:
    """The largest absolute entry of the covariance of the coordinates ``kept`` minus the identity."""
    pairs = [(i, j) for i in kept for j in kept if i <= j]
    if not pairs:
        return None
    found = sample.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) for i, j in pairs]).first()
    return max(abs(value - (i == j)) for value, (i, j) in zip(found, pairs))
