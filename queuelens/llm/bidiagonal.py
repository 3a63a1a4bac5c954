"""Singular values and right singular vectors of a small square matrix: Householder, dqds, twisted factorisations.

The matrix is the triangular factor of all centred rows, so its size is that of one vector and not of the table.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Neighbouring eigenvalues closer than this share of the larger one are made orthogonal by inverse iteration.
CLUSTER = 1e-4
SWEEPS_PER_VALUE = 200


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, right transformation) of ``r`` after Householder reflections from both sides."""
    a, size = np.array(r, dtype=float), len(r)
    right = np.eye(size)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        top = np.abs(x).max(initial=0.0)
        if top == 0 or len(x) == 1:
            return None
        v = x / top
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        return v / np.linalg.norm(v)

    for k in range(size):
        if (v := reflector(a[k:, k])) is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k + 2 < size and (v := reflector(a[k, k + 1:])) is not None:
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
            right[:, k + 1:] -= 2 * np.outer(right[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One transform of the quotients and differences; the last value tells whether the shift was below the smallest."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    least = d
    for i in range(n - 1):
        new_q[i] = d + e[i]
        if new_q[i] <= 0:
            return new_q, new_e, -1.0
        ratio = q[i + 1] / new_q[i]
        new_e[i] = e[i] * ratio
        d = d * ratio - shift
        least = min(least, d)
    new_q[-1] = d
    return new_q, new_e, least


def squared_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, falling, by shifted quotient-difference transforms."""
    found: list[float] = []
    parts = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above], 0.0)]
    while parts:
        q, e, base = parts.pop()
        sweeps, guess = 0, 0.0
        while q:
            if len(q) == 1:
                found.append(base + max(q[0], 0.0))
                break
            small = [i for i, x in enumerate(e) if x <= (EPS * EPS) * min(base + q[i], base + q[i + 1]) or x < 1e-300]
            if small:
                i = small[-1]
                if i == len(e) - 1:  # the last value stands alone
                    found.append(base + max(q.pop(), 0.0))
                    e.pop()
                    guess = 0.0
                    continue
                parts.append((q[:i + 1], e[:i], base))
                q, e, guess = q[i + 1:], e[i + 1:], 0.0
                continue
            if q[0] < q[-1] / 4:  # small values leave at the end; transposing and flipping keeps all values
                q, e = q[::-1], e[::-1]
            sweeps += 1
            if sweeps > SWEEPS_PER_VALUE * (len(diagonal) + 1):
                raise ArithmeticError("dqds does not converge")
            shift = guess
            while True:
                new_q, new_e, least = _dqds(q, e, shift)
                if least >= 0:
                    break
                shift = shift / 4 if shift > EPS * (base + max(q)) * 1e-3 else 0.0
                if shift == 0.0:
                    new_q, new_e, least = _dqds(q, e, 0.0)
                    new_q[-1] = max(new_q[-1], 0.0)
                    break
            base, q, e = base + shift, new_q, new_e
            tail = q[-1] - np.sqrt(e[-1] * q[-1]) - e[-1]
            guess = max(0.0, min(least * 0.98, max(tail, least * 0.5))) if least > 0 else 0.0
    return np.sort(np.array(found))[::-1]


def _twisted(d: np.ndarray, low: np.ndarray, value: float) -> np.ndarray:
    """The vector of ``value`` from the stationary and the progressive factorisation, joined where the residual is least."""
    n, tiny = len(d), 1e-290
    plus, s = np.zeros(n - 1), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + d[i]
        pivot = pivot if abs(pivot) > tiny else tiny
        plus[i] = d[i] * low[i] / pivot
        s[i + 1] = plus[i] * low[i] * s[i] - value
    minus, p = np.zeros(n - 1), np.zeros(n)
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = d[i] * low[i] * low[i] + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else tiny
        minus[i] = low[i] * d[i] / pivot
        p[i] = p[i + 1] * (d[i] / pivot) - value
    twist = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -minus[i] * z[i]
    return z / np.linalg.norm(z)


def _inverse_iteration(diagonal: np.ndarray, above: np.ndarray, value: float, others: np.ndarray, seed: int) -> np.ndarray:
    """A vector of ``value`` orthogonal to ``others``, the vectors already found of its cluster."""
    n = len(diagonal)
    main = diagonal ** 2
    main[1:] += above ** 2
    side = diagonal[:-1] * above
    matrix = np.diag(main - value) + np.diag(side, 1) + np.diag(side, -1)
    matrix += np.eye(n) * (EPS * max(main.max(), 1e-300))  # not singular to the last bit
    z = np.random.default_rng(seed).standard_normal(n)
    for _ in range(4):
        for _ in range(2):
            z -= others @ (others.T @ z)
        z = np.linalg.solve(matrix, z / np.linalg.norm(z))
    for _ in range(2):
        z -= others @ (others.T @ z)
        z /= np.linalg.norm(z)
    return z


def right_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Columns: right singular vectors of the bidiagonal matrix for the ``count`` largest squared values."""
    size = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    floor = size * 1e-20
    b = np.where(np.abs(diagonal) < floor, floor, diagonal)
    d, low = b * b, above / b[:-1]
    out = np.zeros((len(diagonal), count))
    start = 0
    for k in range(count):
        if k and values[k - 1] - values[k] > CLUSTER * values[k - 1]:
            start = k
        with np.errstate(all="ignore"):
            z = _twisted(d, low, float(values[k]))
        mates = out[:, start:k]
        if k > start or not np.isfinite(z).all():
            overlap = np.abs(mates.T @ z).max(initial=0.0) if np.isfinite(z).all() else 1.0
            if overlap > 1e-14:
                z = _inverse_iteration(diagonal, above, float(values[k]), mates, k)
        out[:, k] = z
    return out


def largest_directions(r: np.ndarray, count: int, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray, float]:
    """(squared singular values, their directions as columns, sum of all squared values) of a triangular factor.

    At most ``count``, and only those above ``tolerance`` times the largest. The largest entry of a direction is positive.
    """
    scale = np.abs(r).max(initial=0.0)
    if scale == 0 or not np.isfinite(scale):
        return np.zeros(0), np.zeros((len(r), 0)), 0.0
    diagonal, above, right = bidiagonalise(r / scale)
    values = squared_values(diagonal, above)
    wanted = min(count, int((values > tolerance * values[0]).sum()))
    directions = right @ right_vectors(diagonal, above, values, wanted)
    directions /= np.linalg.norm(directions, axis=0)
    top = directions[np.abs(directions).argmax(axis=0), np.arange(wanted)]
    return values[:wanted] * scale ** 2, directions * np.where(top < 0, -1.0, 1.0), float((r * r).sum())
