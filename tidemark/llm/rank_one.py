"""Eigendecompositions kept up to date under rank-one additions.

A spectrum is a count of rows, their mean, and the eigenvalues and eigenvectors of their scatter matrix (the sum of
centred outer products). A row adds one outer product, and so does each eigenpair of another spectrum that is merged;
every addition solves the secular equation 1 + rho * sum(z_j^2 / (d_j - x)) = 0 for the new eigenvalues.
"""

from __future__ import annotations

import numpy as np

_EPSILON = float(np.finfo(np.float64).eps)
_MOST_STEPS = 80


class Spectrum:
    """Count, mean, and eigenpairs of the scatter matrix of the rows added so far; eigenvalues ascend."""

    def __init__(self, width: int):
        self.count = 0
        self.mean = np.zeros(width)
        self.values = np.zeros(width)
        self.vectors = np.eye(width)

    def add_row(self, row: np.ndarray) -> None:
        """Centre a row by the mean of those before it and add its outer product."""
        away = row - self.mean
        self.values, self.vectors = add_outer(self.values, self.vectors, away, self.count / (self.count + 1))
        self.count += 1
        self.mean = self.mean + away / self.count

    def merge(self, other: Spectrum) -> None:
        """Add another spectrum: its eigenpairs one by one, then the distance of the means."""
        if not other.count:
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = add_outer(self.values, self.vectors, vector, value)
        total = self.count + other.count
        away = other.mean - self.mean
        self.values, self.vectors = add_outer(self.values, self.vectors, away, self.count * other.count / total)
        self.mean = self.mean + away * (other.count / total)
        self.count = total

    def dump(self) -> tuple[int, bytes]:
        return self.count, np.concatenate([self.mean, self.values, self.vectors.ravel()]).tobytes()

    @classmethod
    def load(cls, count: int, data: bytes, width: int) -> Spectrum:
        found, numbers = cls(width), np.frombuffer(data)
        found.count = count
        found.mean, found.values = numbers[:width], numbers[width : 2 * width]
        found.vectors = numbers[2 * width :].reshape(width, width)
        return found


def add_outer(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of V diag(values) V' + weight * v v', eigenvalues ascending, for weight >= 0."""
    z = vectors.T @ v
    length = float(z @ z)
    rho = weight * length
    if not rho > 0:
        return values, vectors
    z = z / np.sqrt(length)
    tolerance = 8 * _EPSILON * max(float(np.abs(values).max()), rho)
    # Deflation: a part of v too small to matter leaves its eigenpair as it is.
    live = np.flatnonzero(rho * np.abs(z) > tolerance)
    if not len(live):
        return values, vectors
    if len(live) > 1 and (np.diff(values[live]) * np.abs(z[live[1:]] * z[live[:-1]]) <= tolerance).any():
        values, vectors = values.copy(), vectors.copy()
        live = _rotate_close(values, vectors, z, live, tolerance)
    new, mixed = _secular(values[live], z[live], rho)
    values, turned = values.copy(), vectors.copy()
    values[live] = new
    turned[:, live] = vectors[:, live] @ mixed
    order = np.argsort(values, kind="stable")
    return values[order], turned[:, order]


def _rotate_close(
    values: np.ndarray, vectors: np.ndarray, z: np.ndarray, live: np.ndarray, tolerance: float
) -> np.ndarray:
    """Deflation of (nearly) equal eigenvalues: turn two eigenvectors, in place, so that only one meets the new part."""
    kept, before = [], int(live[0])
    for at in live[1:].tolist():
        length = float(np.hypot(z[before], z[at]))
        cos, sin = z[at] / length, z[before] / length
        if (values[at] - values[before]) * abs(cos * sin) <= tolerance:
            first, second = vectors[:, before].copy(), vectors[:, at].copy()
            vectors[:, before], vectors[:, at] = cos * first - sin * second, sin * first + cos * second
            low, high = values[before], values[at]
            values[before], values[at] = cos**2 * low + sin**2 * high, sin**2 * low + cos**2 * high
            z[before], z[at] = 0.0, length
        else:
            kept.append(before)
        before = at
    return np.array([*kept, before])


def _secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of diag(d) + rho z z' for ascending, different d and no z of 0."""
    k = len(d)
    if k == 1:
        return d + rho * z * z, np.ones((1, 1))
    squares = (rho * z * z)[:, None]
    room = np.append(d[1:], d[-1] + squares.sum()) - d
    # Each root is taken from its nearer pole, so that its distance to that pole keeps all digits.
    right = 1 + (squares / (d[:, None] - (d + room / 2))).sum(axis=0) < 0
    right[-1] = False
    pole = np.arange(k) + right
    poles = d[:, None] - d[pole]
    low, high = np.where(right, -room / 2, 0.0), np.where(right, 0.0, room / 2)
    high[-1] = room[-1]
    x = (low + high) / 2
    lower = np.tri(k).T  # poles at or below the root of a column
    settled = np.zeros(k, bool)
    each, after = np.arange(k), np.minimum(np.arange(k) + 1, k - 1)
    for _ in range(_MOST_STEPS):
        inverse = 1 / (poles - x)
        parts = squares * inverse
        under, whole = np.einsum("ij,ij->j", parts, lower), np.add.reduce(parts)
        f = 1 + whole
        settled |= np.abs(f) <= k * _EPSILON * (1 + whole - 2 * under)
        if settled.all():
            break
        low, high = np.where(f < 0, x, low), np.where(f > 0, x, high)
        parts *= inverse
        below = np.einsum("ij,ij->j", parts, lower)
        gaps = 1 / inverse[each, each], 1 / inverse[after, each]
        step = _step(*gaps, f, below, np.add.reduce(parts) - below)
        moved = x + step
        moved = np.where((moved > low) & (moved < high), moved, (low + high) / 2)
        near = np.abs(moved - x) <= 4 * _EPSILON * np.abs(x)
        x = np.where(settled, x, moved)
        settled |= near
    gaps = poles - x
    # The vector for which these roots are exact, so that eigenvectors stay orthogonal to all digits.
    apart = d[None, :] - d[:, None]
    np.fill_diagonal(apart, 1.0)
    exact = np.sqrt(np.abs(np.prod(-gaps / apart, axis=1))) * np.sign(z)
    mixed = exact[:, None] / gaps
    return d[pole] + x, mixed / np.sqrt((mixed * mixed).sum(axis=0))


def _step(
    first: np.ndarray, second: np.ndarray, f: np.ndarray, below: np.ndarray, above: np.ndarray
) -> np.ndarray:
    """Step of each root from a model of one pole on either side; the last root has none above."""
    with np.errstate(all="ignore"):
        a = (first + second) * f - first * second * (below + above)
        b = first * second * f
        c = f - first * below - second * above
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        step[-1] = first[-1] + below[-1] * first[-1] ** 2 / (f[-1] - first[-1] * below[-1])
    return step
