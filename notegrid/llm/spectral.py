"""Symmetric eigenproblems by spectral divide and conquer on QDWH polar decompositions.

The polar factor U of a shifted matrix A - s I has the eigenvalues +1 and -1: (U + I) / 2 projects on the
invariant subspace of the eigenvalues above s. QDWH finds U in a few iterations of dynamically weighted
Halley steps, by QR while the matrix is far from orthogonal and by Cholesky after that. The two subspaces split A in two
smaller problems, down to single components. The matrices here are covariances: their size is the
length of a vector, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix; a singular direction may stay short of length one."""
    n = len(a)
    eye = np.eye(n)
    size = np.linalg.norm(a)
    if not size:
        return eye
    x = a / size
    low = EPS / 2  # a bound below the least singular value of x, as far as doubles tell
    for _ in range(30):
        l2 = low * low
        d = np.cbrt(4 * (1 - l2) / (l2 * l2))
        w = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - l2) / (l2 * np.sqrt(1 + d)))
        b = (w - 1) ** 2 / 4
        c = w + b - 1
        if c > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
            new = b / c * x + (w - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        else:
            z = np.linalg.cholesky(eye + c * (x.T @ x))
            new = b / c * x + (w - b / c) * np.linalg.solve(z.T, np.linalg.solve(z, x.T)).T
        low = min(low * (w + b * l2) / (1 + c * l2), 1.0)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x = new
        if moved < np.cbrt(EPS) and abs(1 - low) < 10 * EPS:
            break
        if low >= 1:
            low = 1 - EPS
    return x


def _pair(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of a 2 by 2 matrix by one rotation."""
    angle = 0.5 * np.arctan2(2 * a[0, 1], a[0, 0] - a[1, 1])
    c, s = np.cos(angle), np.sin(angle)
    v = np.array([[c, -s], [s, c]])
    return np.diag(v.T @ a @ v).copy(), v


def _split(a: np.ndarray, shift: float, rng: np.random.Generator) -> tuple[np.ndarray, int, float]:
    """(basis, k, what is left between the two parts): the first k columns span the eigenvalues above shift."""
    n = len(a)
    projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
    k = int(round(np.trace(projector)))
    if not 0 < k < n:
        return np.eye(n), k, np.inf
    guess = rng.normal(size=(n, n))
    for _ in range(2):  # the second time from the first basis: subspaces to working precision
        guess = np.linalg.qr(np.hstack([projector @ guess[:, :k], guess[:, k:] - projector @ guess[:, k:]]))[0]
    left = guess[:, k:].T @ a @ guess[:, :k]
    return guess, k, float(np.linalg.norm(left))


def spectral(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix in falling order and the unit eigenvectors as columns."""
    a = (a + a.T) / 2
    size = np.linalg.norm(a)
    rng = np.random.default_rng(1)

    def solve(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(part)
        if n == 2:
            return _pair(part)
        mean = np.trace(part) / max(n, 1)
        if n < 2 or np.linalg.norm(part - mean * np.eye(n)) <= 4 * EPS * size * np.sqrt(n):
            return np.diag(part).copy(), np.eye(n)  # all eigenvalues are equal, any basis will do
        # shifts between the ends of the spectrum: the median first, then others, until the parts come apart
        width = np.linalg.norm(part - mean * np.eye(n)) / np.sqrt(n)
        best = None
        for shift in [np.median(np.diag(part)), mean, *(mean + width * t for t in (0.31, -0.31, 0.77, -0.77, 0.05, -0.05, 1.3, -1.3))]:
            basis, k, left = _split(part, shift, rng)
            if best is None or left < best[2]:
                best = basis, k, left
            if left <= 8 * EPS * size * np.sqrt(n):
                break
        basis, k, left = best
        if not np.isfinite(left):
            return np.diag(part).copy(), np.eye(n)
        inner = basis.T @ part @ basis
        (e1, v1), (e2, v2) = (solve((b + b.T) / 2) for b in (inner[:k, :k], inner[k:, k:]))
        return np.concatenate([e1, e2]), np.hstack([basis[:, :k] @ v1, basis[:, k:] @ v2])

    _, v = solve(a)
    for _ in range(2):
        v = _refined(a, v)
    e = np.einsum("ij,ij->j", v, a @ v)
    order = np.argsort(-e, kind="stable")
    return e[order], v[:, order]


def _refined(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Columns turned towards the eigenvectors by one first-order step where eigenvalues are far enough apart, then made orthogonal."""
    s = v.T @ a @ v
    s = (s + s.T) / 2
    gap = np.diag(s)[None, :] - np.diag(s)[:, None]
    apart = (np.abs(gap) > 1e4 * EPS * np.linalg.norm(a)) & (100 * np.abs(s) <= np.abs(gap))
    v = v + v @ np.divide(s, gap, out=np.zeros_like(s), where=apart)
    for _ in range(3):
        v = v @ (3 * np.eye(len(a)) - v.T @ v) / 2
    return v
