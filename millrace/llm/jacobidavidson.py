"""The largest eigenpairs of a symmetric matrix that is known by its products only: block Jacobi-Davidson.

What is held is a search space W, its products V W, and the locked eigenvectors: a few columns of the vectors' length.
Each call of the product is one pass over the data for a whole block of columns, so the columns' correction equations are
solved in step with each other, by MINRES.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

EPS = float(np.finfo(float).eps)
#: Columns that one pass multiplies, MINRES steps for a correction, and rounds before giving up.
BLOCK, STEPS, ROUNDS = 16, 4, 200
#: Rounds that lock nothing before the space may grow.
PATIENCE = 15
#: MINRES stops early at this share of the residual: more is lost on a correction of the first order.
ENOUGH = 1e-2


@dataclass
class Pairs:
    values: np.ndarray
    vectors: np.ndarray
    #: Norms of V u - e u, by a product of their own after the last step.
    residuals: np.ndarray
    products: int


def _orthonormal(new: np.ndarray, *old: np.ndarray) -> np.ndarray:
    """The part of new that is orthogonal to old, as orthonormal columns; columns of rounding errors are left out."""
    for _ in range(2):
        for q in old:
            new = new - q @ (q.T @ new)
        size = np.linalg.norm(new, axis=0)
        new = new[:, size > 0] / size[size > 0]
        if not new.shape[1]:
            return new
        u, s, _ = np.linalg.svd(new, full_matrices=False)
        new = u[:, s > 1e-10 * s[0]]
    return new


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, enough: float) -> np.ndarray:
    """Solutions of one symmetric system for each column of b, from zero, in step; apply multiplies each column by its own matrix."""
    x, size = np.zeros_like(b), np.linalg.norm(b, axis=0)
    live = size > 0
    beta = np.where(live, size, 1)
    v, v_old = b / beta, np.zeros_like(b)
    w, w_old = np.zeros_like(b), np.zeros_like(b)
    phi, c, s, delta, epsilon = np.where(live, size, 0.0), -np.ones_like(size), np.zeros_like(size), np.zeros_like(size), np.zeros_like(size)
    last = np.zeros_like(size)
    for _ in range(steps):
        p = apply(v) - last * v_old
        alpha = (v * p).sum(axis=0)
        p -= alpha * v
        after = np.linalg.norm(p, axis=0)
        bar = c * delta + s * alpha  # the last rotation on the new column of the tridiagonal matrix
        gamma_bar = s * delta - c * alpha
        before, epsilon, delta = epsilon, s * after, -c * after
        gamma = np.maximum(np.hypot(gamma_bar, after), EPS)
        c, s = gamma_bar / gamma, after / gamma
        w, w_old = (v - before * w_old - bar * w) / gamma, w
        x = x + np.where(live, phi * c, 0.0) * w
        phi = phi * s
        live = live & (after > EPS * size)
        if (~live | (np.abs(phi) <= enough * size)).all():
            break
        v, v_old, last = np.where(after > 0, p / np.where(after > 0, after, 1), 0.0), v, after
    return x


def largest(product: Callable[[np.ndarray], np.ndarray], d: int, want: int, block: int = BLOCK, steps: int = STEPS, seed: int = 0) -> Pairs:
    """The want largest eigenpairs (or all d), by falling value; each residual is within a few roundings of the largest value.

    A space that has grown past three blocks and what is still wanted is cut down to its best Ritz vectors; where that
    locks nothing for a while (clusters wider than the space), the space may grow to twice the size. Ritz pairs are locked
    from the top as they converge; later columns are kept orthogonal to them.
    """
    want, random, calls = min(want, d), np.random.default_rng(seed), 0

    def times(u: np.ndarray) -> np.ndarray:
        nonlocal calls
        calls += 1
        return product(u)

    locked, top, wide, idle = np.zeros((d, 0)), 0.0, 3 * block, 0
    w = _orthonormal(random.standard_normal((d, min(block, d))))
    aw = times(w) if d else w
    for _ in range(ROUNDS):
        if locked.shape[1] >= want:
            break
        h = w.T @ aw
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        x, ax = w @ s, aw @ s
        top = max(top, float(np.abs(theta).max()))
        r = ax - x * theta
        done = np.linalg.norm(r, axis=0) <= 16 * EPS * np.sqrt(d) * top
        k = int(np.argmin(np.append(done, False)))
        k = min(k, want - locked.shape[1])
        idle = 0 if k else idle + 1
        if idle > PATIENCE:
            wide, idle = 2 * wide, 0
        locked = np.concatenate([locked, _orthonormal(x[:, :k], locked)], axis=1) if k else locked
        x, ax, theta, r = x[:, k:], ax[:, k:], theta[k:], r[:, k:]
        left = want - locked.shape[1]
        if not left:
            break
        if x.shape[1] + locked.shape[1] >= d:  # all of space: only rounding is left, so the products are taken anew
            w = _orthonormal(x, locked)
            aw = times(w)
            continue
        m = min(block, left, x.shape[1])
        chosen, shift, held = x[:, :m], theta[:m], np.concatenate([locked, x[:, :m]], axis=1)

        def within(u: np.ndarray, held=held) -> np.ndarray:
            return u - held @ (held.T @ u)

        def shifted(u: np.ndarray, within=within, shift=shift) -> np.ndarray:
            return within(times(u) - u * shift)

        t = minres(shifted, within(-r[:, :m]), steps, ENOUGH) if m else chosen
        if x.shape[1] + m > left + wide:
            x, ax = x[:, : left + wide // 3], ax[:, : left + wide // 3]
        new = _orthonormal(np.concatenate([t, random.standard_normal((d, max(0, min(block, left) - t.shape[1])))], axis=1), locked, x)
        if not new.shape[1]:
            new = _orthonormal(random.standard_normal((d, 1)), locked, x)
        w, aw = np.concatenate([x, new], axis=1), np.concatenate([ax, times(new)], axis=1)
    else:
        raise RuntimeError(f"{locked.shape[1]} of {want} eigenpairs after {ROUNDS} rounds")
    q = _orthonormal(locked)
    aq = times(q) if want else q
    h = q.T @ aq
    theta, s = np.linalg.eigh((h + h.T) / 2)
    theta, s = theta[::-1], s[:, ::-1]
    return Pairs(theta, q @ s, np.linalg.norm(aq @ s - (q @ s) * theta, axis=0), calls)
