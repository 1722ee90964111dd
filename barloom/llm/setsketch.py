"""SetSketch: registers of exponentially spaced truncated minima, mergeable and locality-sensitive.

Each element starts a Poisson process of marks: mark j lies an Exp(1)/m beyond mark j - 1 and falls on a uniform register;
register i of a set is the least mark on i over all elements, an Exp(n) minimum, stored as floor(1 - log_b(mark / A)).
Marks come in ascending order, so an element stops at the first mark beyond the set's largest register.
"""

from __future__ import annotations

import numpy as np

from .common import mix

#: Registers, base of their spacing, scale below which every mark lies.
M, BASE, SCALE = 128, 1.001, 64.0
TOP = (1 << 16) - 2
_STEP = np.uint64(0x9E3779B97F4A7C15)


def sketch(elements: np.ndarray, owner: np.ndarray, n_sets: int, m: int = M) -> np.ndarray:
    """Registers (n_sets x m, uint16) of sets given as distinct 64-bit elements and the set of each. Empty sets: zeros."""
    best = np.full(n_sets * m, np.inf)
    state, own, x = mix(elements + _STEP), owner, np.zeros(len(elements))
    low = np.uint64(m - 1)
    while len(state):
        state = mix(state + _STEP)
        x = x - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / m
        np.minimum.at(best, own * m + (state & low).astype(np.int64), x)
        live = x < best.reshape(n_sets, m).max(axis=1)[own]
        state, own, x = state[live], own[live], x[live]
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(best / SCALE) / np.log(BASE))
    return np.clip(np.where(np.isfinite(k), k, 0), 0, TOP).astype(np.uint16).reshape(n_sets, m)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def _chance(x: np.ndarray) -> np.ndarray:
    """P(one register is greater) from the share of the union that only its set has, for base BASE."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sketches (rows) whose set sizes are known.

    The numbers of registers greater, less and equal are multinomial with chances given by the similarity J; the
    log-likelihood is concave, so its maximum is found by bisection of the derivative over J's feasible range.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u

    def value(j: np.ndarray) -> np.ndarray:
        up, down = _chance(u - v * j), _chance(v - u * j)
        tiny = 1e-300
        return more * np.log(np.maximum(up, tiny)) + less * np.log(np.maximum(down, tiny)) + same * np.log(np.maximum(1 - up - down, tiny))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        left, right = low + (high - low) / 3, high - (high - low) / 3
        up = value(left) < value(right)
        low, high = np.where(up, left, low), np.where(up, high, right)
    return (low + high) / 2
