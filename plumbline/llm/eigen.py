"""Leading eigenpairs of a small symmetric matrix.

Householder reflections make the matrix tridiagonal. A Sturm sequence counts the eigenvalues below
a shift, so bisection closes in on the leading ones, all at once. Inverse iteration on the
tridiagonal matrix gives their vectors; within a cluster of eigenvalues each new vector is made
orthogonal to those before it, every round. The reflections then turn the vectors back.
"""

from __future__ import annotations

import numpy as np

ROUNDS = 6
# Neighbours nearer than this share of the matrix's norm are one cluster.
CLUSTER = 1e-3
EPSILON = np.finfo(float).eps


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal, and the unit vectors of the reflections, which act on the last
    entries."""
    a, mirrors = matrix.astype(float).copy(), []
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        scale = np.abs(x).max()
        v = x / scale if scale else np.zeros_like(x)
        if scale:
            v[0] += np.copysign(np.linalg.norm(v), v[0])
            v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = 2 * (rest @ v)
        w = p - (p @ v) * v
        rest -= np.outer(v, w) + np.outer(w, v)
        x -= 2 * (v @ x) * v
        a[k, k + 1 :] = x
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def below(diagonal: np.ndarray, off: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each shift: negative terms of the Sturm sequence."""
    tiny = EPSILON * max(np.abs(diagonal).max(initial=0), np.abs(off).max(initial=0), np.finfo(float).tiny / EPSILON)
    count, q = np.zeros(shift.shape, int), np.ones(shift.shape)
    for i, d in enumerate(diagonal):
        q = d - shift - (off[i - 1] ** 2 / q if i else 0)
        q = np.where(np.abs(q) < tiny * EPSILON, -tiny * EPSILON, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection from Gershgorin's bounds until no
    double lies between the ends."""
    n = len(diagonal)
    reach = np.r_[0, np.abs(off)] + np.r_[np.abs(off), 0]
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    low, high = low - EPSILON * np.abs(low), high + EPSILON * np.abs(high)
    wanted = n - np.arange(k)
    while True:
        middle = (low + high) / 2
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            return middle
        above = below(diagonal, off, middle) < wanted
        low, high = np.where(open_ & above, middle, low), np.where(open_ & ~above, middle, high)


def solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """(T - shift) x = right, by elimination with row exchanges."""
    n = len(diagonal)
    d, u, uu = diagonal - shift, np.append(off, 0.0), np.zeros(n)
    lower, x = off.copy(), right.astype(float).copy()
    for i in range(n - 1):
        if abs(lower[i]) > abs(d[i]):
            d[i], lower_i = lower[i], d[i]
            u[i], d[i + 1] = d[i + 1], u[i]
            uu[i], u[i + 1] = u[i + 1], uu[i]
            x[i], x[i + 1] = x[i + 1], x[i]
        else:
            lower_i = lower[i]
        if d[i] == 0:
            d[i] = tiny
        m = lower_i / d[i]
        d[i + 1] -= m * u[i]
        u[i + 1] -= m * uu[i]
        x[i + 1] -= m * x[i]
    if abs(d[-1]) < tiny:
        d[-1] = tiny
    for i in range(n - 1, -1, -1):
        after = u[i] * x[i + 1] if i + 1 < n else 0.0
        after += uu[i] * x[i + 2] if i + 2 < n else 0.0
        x[i] = (x[i] - after) / d[i]
    return x


def leading_pairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit vectors as rows. The largest entry
    of a vector is positive."""
    n = len(matrix)
    if n == 0 or k == 0:
        return np.empty(0), np.empty((0, n))
    size = np.abs(matrix).max()
    if not size:
        return np.zeros(k), np.eye(n)[:k]
    diagonal, off, mirrors = tridiagonal(matrix / size)
    values = leading_values(diagonal, off, k)
    norm = np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0)
    rng, found = np.random.default_rng(0), []
    for i, value in enumerate(values):
        cluster = []
        for j in range(i - 1, -1, -1):
            if values[j] - values[j + 1] > CLUSTER * norm:
                break
            cluster.append(found[j])
        # Equal shifts would give one direction for all of a multiple eigenvalue.
        shift = value - len(cluster) * 4 * EPSILON * norm
        x = rng.uniform(-1, 1, n)
        for _ in range(ROUNDS):
            x = solve(diagonal, off, shift, x / np.linalg.norm(x), EPSILON * norm * EPSILON)
            x /= np.abs(x).max()
            for _ in range(2):
                for other in cluster:
                    x -= (other @ x) * other
        found.append(x / np.linalg.norm(x))
    vectors = np.array(found)
    for at in range(n - 3, -1, -1):
        own = vectors[:, at + 1 :]
        own -= 2 * np.outer(own @ mirrors[at], mirrors[at])
    top = np.abs(vectors).argmax(axis=1)
    vectors *= np.sign(vectors[np.arange(k), top])[:, None]
    return values * size, vectors
