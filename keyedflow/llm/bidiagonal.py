"""Singular values and right singular vectors of a small square matrix.

Householder reflections make the matrix bidiagonal, the dqds iteration gives the squares of the
singular values to high relative accuracy, and twisted factorisations give a vector for each.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Relative distance under which singular values count as one cluster.
CLUSTER = 1e-3


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a, superdiagonal b and W with matrix = U B W', for a square matrix."""
    work = np.array(matrix, dtype=float)
    n = len(work)
    right = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.abs(x[1:]).max(initial=0.0)
        if size == 0:
            return None
        v = x / max(size, abs(x[0]))
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        return v / np.linalg.norm(v)

    for k in range(n):
        v = reflector(work[k:, k].copy())
        if v is not None:
            work[k:, k:] -= 2 * np.outer(v, v @ work[k:, k:])
        if k < n - 2:
            v = reflector(work[k, k + 1 :].copy())
            if v is not None:
                work[k:, k + 1 :] -= 2 * np.outer(work[k:, k + 1 :] @ v, v)
                right[:, k + 1 :] -= 2 * np.outer(right[:, k + 1 :] @ v, v)
    return np.diagonal(work).copy(), np.diagonal(work, 1).copy(), right


def _dqds_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One differential qd transform with a shift; None if the shift is above the smallest value."""
    d, new_q, new_e = q[0] - shift, [], []
    for i, x in enumerate(e):
        if d < 0:
            return None
        new_q.append(d + x)
        ratio = q[i + 1] / new_q[i]
        new_e.append(x * ratio)
        d = d * ratio - shift
    if d < 0:
        return None
    return [*new_q, d], new_e


def _shift(q: list[float], e: list[float]) -> float:
    """A lower bound of the smallest value: one over the trace of the inverse."""
    row = total = 1 / q[-1] if q[-1] > 0 else np.inf
    for x, y in zip(reversed(q[:-1]), reversed(e)):
        row = (1 + y * row) / x if x > 0 else np.inf
        total += row
    return (1 - 8 * len(q) * EPS) / total


def squared_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal, falling, by dqds with deflation."""
    # Diagonal entries under the rounding of the matrix are set to it: dqds divides by them.
    least = (EPS * max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))) ** 2
    if least == 0:
        return np.zeros(len(a))
    blocks, found = [([max(x, least) for x in (a * a).tolist()], (b * b).tolist(), 0.0)], []
    while blocks:
        q, e, moved = blocks.pop()
        for _ in range(100 + 30 * len(q)):
            if len(q) == 1:
                break
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= (8 * EPS) ** 2 * (moved + min(q[k], q[k + 1]))), None)
            if cut is not None:
                blocks += [(q[: cut + 1], e[:cut], moved), (q[cut + 1 :], e[cut + 1 :], moved)]
                break
            shift, step = _shift(q, e), None
            while step is None:
                step, tried = _dqds_step(q, e, shift), shift
                shift = shift / 2 if shift > moved * EPS else 0.0
            (q, e), moved = step, moved + tried
        else:
            raise ArithmeticError("dqds did not converge")
        if len(q) == 1:
            found.append(max(q[0], 0.0) + moved)
    return np.sort(np.array(found))[::-1]


def _twisted(a: np.ndarray, b: np.ndarray, value: float, start: np.ndarray | None = None) -> np.ndarray:
    """A vector of B'B for an eigenvalue from the twisted factorisation with the smallest pivot.

    With ``start``, the solution of (B'B - value) x = start by the two halves of that factorisation.
    """
    n, q = len(a), a * a
    off, tiny = a[:-1] * b, EPS * EPS * max(value, np.max(q), np.finfo(float).tiny)
    ell = np.divide(b, a[:-1], out=np.zeros(n - 1), where=a[:-1] != 0)
    safe = lambda x: x if abs(x) > tiny else np.copysign(tiny, x)
    s, p, low, up, above, below = np.zeros(n), np.zeros(n), np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0)), np.zeros(n), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        above[i] = safe(s[i] + q[i])
        low[i] = off[i] / above[i]
        s[i + 1] = low[i] * ell[i] * s[i] - value
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        below[i + 1] = safe(off[i] * ell[i] + p[i + 1])
        up[i] = off[i] / below[i + 1]
        p[i] = p[i + 1] * (q[i] / below[i + 1]) - value
    pivots = s + p + value
    r = int(np.argmin(np.abs(pivots)))
    z = np.zeros(n)
    if start is None:
        z[r] = 1.0
    else:
        y = start.copy()
        for i in range(r):
            y[i + 1] -= low[i] * y[i]
        for i in range(n - 1, r, -1):
            y[i - 1] -= up[i - 1] * y[i]
        z[r] = y[r] / safe(pivots[r])
        z[:r], z[r + 1 :] = y[:r] / above[:r], y[r + 1 :] / below[r + 1 :]
    for i in range(r - 1, -1, -1):
        z[i] -= low[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] -= up[i] * z[i]
    return z / np.linalg.norm(z)


def vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Columns: orthonormal vectors of B'B for ``values`` (falling), from twisted factorisations.

    Vectors of close values are made orthogonal to each other, with fresh starts where two agree, and turned
    to the axes of the small matrix that they span.
    """
    floor = EPS * max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    a = np.where(np.abs(a) < floor, floor, a)
    n, out, rnd = len(a), np.zeros((len(a), len(values))), np.random.default_rng(7)

    def times(x: np.ndarray) -> np.ndarray:
        y = a * x
        y[:-1] += b * x[1:]
        z = a * y
        z[1:] += b * y[:-1]
        return z

    at = 0
    while at < len(values):
        end = at + 1
        while end < len(values) and values[end - 1] - values[end] <= CLUSTER * values[end - 1] + n * floor * floor:
            end += 1
        if end == at + 1:
            out[:, at] = _twisted(a, b, values[at])
        else:
            for k in range(at, end):
                z = _twisted(a, b, values[k])
                for attempt in range(8):
                    rest = z - out[:, at:k] @ (out[:, at:k].T @ z)
                    if np.linalg.norm(rest) > 1e-3:
                        break
                    # The others' vectors again: solve from another start that they have no part in.
                    z = rnd.standard_normal(n)
                    for _ in range(3):
                        z -= out[:, at:k] @ (out[:, at:k].T @ z)
                        z = _twisted(a, b, values[k] * (1 + 4 * EPS * (attempt + 1)), z)
                rest /= np.linalg.norm(rest)
                rest -= out[:, at:k] @ (out[:, at:k].T @ rest)
                out[:, k] = rest / np.linalg.norm(rest)
            own = out[:, at:end]
            inner = own.T @ np.column_stack([times(own[:, j]) for j in range(end - at)])
            _, turn = np.linalg.eigh((inner + inner.T) / 2)
            out[:, at:end] = own @ turn[:, ::-1]
        at = end
    return out


def right_singular(matrix: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Squares of the ``keep`` largest singular values, and their right vectors as columns."""
    scale = np.abs(matrix).max(initial=0.0)
    n = len(matrix)
    if scale == 0:
        return np.zeros(min(keep, n)), np.eye(n)[:, :keep]
    a, b, right = bidiagonal(matrix / scale)
    values = squared_values(a, b)[:keep]
    return values * scale * scale, right @ vectors(a, b, values)
