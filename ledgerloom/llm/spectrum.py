"""Eigendecompositions of scatter matrices kept up to date by rank-one updates.

An update U diag(d) U' + v v' has eigenvalues that interlace d and are the roots of the secular equation
1 + sum z_j^2 / (d_j - x) = 0 with z = U' v. Roots are found as offsets from their nearer pole, all at once, by rational
interpolation with poles at both ends of the interval, inside a bracket. Eigenvectors come from the z that has exactly
the roots found, which keeps them orthogonal. Entries with a negligible z, and one of two poles that nearly coincide, are
deflated beforehand: their eigenpairs stay, the latter after a plane rotation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_EPS = np.finfo(float).eps
_ROUNDS = 200


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(weights / (poles - x)), ascending, and the matrix of pole j minus root i without cancellation.

    Poles ascend strictly and weights are positive. Root i lies between pole i and the next one, the last above its pole.
    """
    k = np.arange(len(poles))
    upper = np.append(poles[1:], poles[-1] + weights.sum())
    gap = upper - poles
    middle = 1 + (weights / (poles - poles[:, None] - gap[:, None] / 2)).sum(1)
    from_left = middle >= 0
    from_left[-1] = True
    origin = np.where(from_left, k, k + 1)
    low, high = np.where(from_left, 0.0, -gap / 2), np.where(from_left, gap / 2, 0.0)
    if middle[-1] < 0:
        low[-1], high[-1] = gap[-1] / 2, gap[-1]
    away = poles - poles[origin][:, None]
    upper_away = upper - poles[origin]
    below = k <= k[:, None]
    offset = (low + high) / 2
    for _ in range(_ROUNDS):
        delta = away - offset[:, None]
        terms = weights / delta
        slopes = terms / delta
        value, slope = 1 + terms.sum(1), slopes.sum(1)
        low, high = np.where(value < 0, offset, low), np.where(value < 0, high, offset)
        left, right = delta[k, k], upper_away - offset
        of_left = np.where(below, slopes, 0.0).sum(1)
        with np.errstate(all="ignore"):
            c = value - left * of_left - right * (slope - of_left)
            a = (left + right) * value - left * right * slope
            b = left * right * value
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        moved = offset + step
        moved = np.where((moved > low) & (moved < high), moved, (low + high) / 2)
        done = np.abs(moved - offset) <= 2 * _EPS * np.abs(moved)
        offset = np.where((moved != 0) & ~(value == 0), moved, offset)
        if (done | (value == 0)).all():
            break
    return poles[origin] + offset, away - offset[:, None]


def _exact_weights(poles: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """The weights whose secular equation has exactly the roots that ``delta`` (pole j minus root i) was found for."""
    k = np.arange(len(poles))
    partner = np.where(k[:, None] < k, k[:, None], np.minimum(k[:, None] + 1, k[-1]))
    apart = np.abs(poles[partner] - poles)
    apart[-1] = 1.0
    return np.prod(np.abs(delta) / apart, axis=0)


@dataclass
class Spectrum:
    """Rows seen, their mean, and ascending eigenvalues and eigenvectors (columns) of their centred scatter matrix."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dimensions: int) -> Spectrum:
        return cls(0, np.zeros(dimensions), np.zeros(dimensions), np.eye(dimensions))

    def update(self, v: np.ndarray) -> None:
        """Add v v' to the scatter matrix."""
        z, d, u = self.vectors.T @ v, self.values.copy(), self.vectors
        size = float(np.linalg.norm(z))
        least = 8 * _EPS * max(float(np.abs(d).max(initial=0)), size * size)
        if size * size <= least * _EPS or size == 0:
            return
        active = np.flatnonzero(np.abs(z) * size > least)
        if not len(active):
            return
        if len(active) > 1:
            near, far = active[:-1], active[1:]
            mixed = np.abs(z[near] * z[far]) / (z[near] ** 2 + z[far] ** 2)
            if ((d[far] - d[near]) * mixed <= least).any():
                u = u.copy()
                active = self._rotated(active, z, d, u, least)
        # Rotated poles may have moved by a rounding error.
        active = active[np.argsort(d[active], kind="stable")]
        roots, delta = secular_roots(d[active], z[active] ** 2)
        weights = np.sqrt(_exact_weights(d[active], delta)) * np.sign(z[active])
        mix = (weights / delta).T
        mix /= np.linalg.norm(mix, axis=0)
        still = np.setdiff1d(np.arange(len(d)), active)
        values = np.concatenate([d[still], roots])
        vectors = np.concatenate([u[:, still], u[:, active] @ mix], axis=1)
        order = np.argsort(values, kind="stable")
        self.values, self.vectors = values[order], vectors[:, order]

    @staticmethod
    def _rotated(active: np.ndarray, z: np.ndarray, d: np.ndarray, u: np.ndarray, least: float) -> np.ndarray:
        """Turn pairs of nearly equal poles so that one of the two has no weight; changes z, d and u in place."""
        kept: list[int] = []
        for j in active.tolist():
            if kept:
                i = kept[-1]
                r = float(np.hypot(z[i], z[j]))
                c, s = z[j] / r, z[i] / r
                if (d[j] - d[i]) * abs(c * s) <= least:
                    z[i], z[j] = 0.0, r
                    u[:, i], u[:, j] = c * u[:, i] - s * u[:, j], s * u[:, i] + c * u[:, j]
                    d[i], d[j] = d[i] * c * c + d[j] * s * s, d[i] * s * s + d[j] * c * c
                    kept.pop()
            kept.append(j)
        return np.array(kept)

    def absorb(self, n: int, mean: np.ndarray, terms: np.ndarray) -> None:
        """Add ``n`` rows of that mean whose centred scatter matrix is the sum of the outer squares of ``terms``."""
        if not n:
            return
        for term in terms:
            self.update(term)
        if self.n:
            self.update((mean - self.mean) * np.sqrt(self.n / (self.n + n) * n))
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n += n

    def add_rows(self, rows: np.ndarray) -> None:
        """Add a block of rows, as the rows of the triangular factor of the centred block: as many as dimensions at most."""
        mean = rows.mean(0)
        centred = rows - mean
        self.absorb(len(rows), mean, np.linalg.qr(centred, mode="r") if len(rows) > 1 else centred)

    def add(self, other: Spectrum) -> None:
        """Add the rows of another spectrum, by one update for each of its eigenpairs."""
        terms = (other.vectors * np.sqrt(np.maximum(other.values, 0))).T
        self.absorb(other.n, other.mean, terms[other.values > 0])
