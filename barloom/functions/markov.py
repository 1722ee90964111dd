"""Two-regime Markov switching of mean and variance: filter, smoother and EM for many series at once.

Filter and smoother are products of 2 x 2 matrices, which are associative: prefix products by doubling give all times of all series
in log2(T) array operations, without a loop over time.
"""

from __future__ import annotations

import numpy as np

LEAST_ROWS, STEPS, TOLERANCE = 30, 1_000, 1e-8


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix products of (.., 4) rows [m00, m01, m10, m11]."""
    return np.stack(
        (
            a[..., 0] * b[..., 0] + a[..., 1] * b[..., 2],
            a[..., 0] * b[..., 1] + a[..., 1] * b[..., 3],
            a[..., 2] * b[..., 0] + a[..., 3] * b[..., 2],
            a[..., 2] * b[..., 1] + a[..., 3] * b[..., 3],
        ),
        -1,
    )


def prefix_products(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products m_t .. m_0 for each time t (series, time, 4), scaled to a largest entry of 1, and the logs of the scales."""
    m, log = m.copy(), np.zeros(m.shape[:2])
    step = 1
    while step < m.shape[1]:
        out = _times(m[:, step:], m[:, :-step])
        scale = np.maximum(out.max(axis=-1), 1e-300)
        log[:, step:] = log[:, step:] + log[:, :-step] + np.log(scale)
        m[:, step:] = out / scale[..., None]
        step *= 2
    return m, log


def smooth(x: np.ndarray, known: np.ndarray, mu: np.ndarray, var: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, ...]:
    """Filtered and smoothed probability of each regime, expected moves, and log likelihood of every series.

    x, known: (series, time), known first; mu, var, stay: (series, 2). The first state has the chain's stationary distribution.
    """
    log_d = -0.5 * (np.log(2 * np.pi * var)[:, None, :] + (x[:, :, None] - mu[:, None, :]) ** 2 / var[:, None, :])
    top = np.where(known, log_d.max(axis=2), 0.0)
    d = np.where(known[:, :, None], np.exp(log_d - top[:, :, None]), 1.0)
    p = np.stack((stay[:, 0], 1 - stay[:, 0], 1 - stay[:, 1], stay[:, 1]), -1)  # from row to column
    start = np.stack((1 - stay[:, 1], 1 - stay[:, 0]), -1)
    start = start / start.sum(axis=1, keepdims=True)
    moves = known.copy()
    moves[:, 0] = False
    # alpha_t = D_t P' alpha_(t-1), beta_t = P D_(t+1) beta_(t+1); identity where nothing moves
    forward = np.stack((d[..., 0] * p[:, None, 0], d[..., 0] * p[:, None, 2], d[..., 1] * p[:, None, 1], d[..., 1] * p[:, None, 3]), -1)
    back = np.stack((p[:, None, 0] * d[..., 0], p[:, None, 1] * d[..., 1], p[:, None, 2] * d[..., 0], p[:, None, 3] * d[..., 1]), -1)
    eye = np.array([1.0, 0.0, 0.0, 1.0])
    forward, back = np.where(moves[..., None], forward, eye), np.where(moves[..., None], back, eye)
    a, log_scale = prefix_products(forward)
    first = start * d[:, 0]
    alpha = np.stack((a[..., 0] * first[:, None, 0] + a[..., 1] * first[:, None, 1], a[..., 2] * first[:, None, 0] + a[..., 3] * first[:, None, 1]), -1)
    total = alpha.sum(axis=2)
    loglik = np.log(total[:, -1]) + log_scale[:, -1] + top.sum(axis=1)
    alpha = alpha / total[..., None]
    reach = prefix_products(back[:, ::-1])[0][:, ::-1]  # the product from each time to the end, in time order
    beta = np.ones_like(alpha)
    beta[:, :-1] = np.stack((reach[:, 1:, 0] + reach[:, 1:, 1], reach[:, 1:, 2] + reach[:, 1:, 3]), -1)
    gamma = alpha * beta
    gamma = gamma / gamma.sum(axis=2, keepdims=True)
    xi = alpha[:, :-1, :, None] * p.reshape(-1, 1, 2, 2) * (d[:, 1:] * beta[:, 1:])[:, :, None, :]
    xi = xi / xi.sum(axis=(2, 3), keepdims=True) * moves[:, 1:, None, None]
    return alpha, gamma, xi.sum(axis=1), loglik


def fit(series: list[np.ndarray], steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[list[np.ndarray | None], np.ndarray]:
    """Filtered probability of the high-variance regime of every series, None where EM did not converge; the log likelihoods."""
    n = np.array([len(s) for s in series])
    out: list[np.ndarray | None] = [None] * len(series)
    logs = np.full(len(series), np.nan)
    live = np.flatnonzero([len(s) >= LEAST_ROWS and np.isfinite(s).all() and s.std() > 1e-12 for s in series])
    if not len(live):
        return out, logs
    x = np.zeros((len(live), n[live].max()))
    for i, s in enumerate(live.tolist()):
        x[i, : n[s]] = series[s]
    known = np.arange(x.shape[1]) < n[live][:, None]
    mean = x.sum(axis=1) / n[live]
    size = np.where(known, np.abs(x - mean[:, None]), np.nan)
    half = np.nanmedian(size, axis=1)[:, None]
    spread = np.stack([np.nanmean(np.where(side, size, np.nan) ** 2, axis=1) for side in (size <= half, size >= half)], -1)
    floor = 1e-6 * np.nanmean(size**2, axis=1)[:, None]
    mu, var, stay = np.repeat(mean[:, None], 2, axis=1), np.maximum(spread, floor), np.full((len(live), 2), 0.95)
    before = np.full(len(live), -np.inf)
    for _ in range(steps):
        alpha, gamma, moved, loglik = smooth(x, known, mu, var, stay)
        ok = np.isfinite(loglik)
        done = ok & (np.abs(loglik - before) <= tolerance * np.abs(loglik))
        for i in np.flatnonzero(done).tolist():
            high = int(var[i, 1] >= var[i, 0])
            out[live[i]] = alpha[i, : n[live[i]], high]
            logs[live[i]] = loglik[i]
        go = ok & ~done
        if not go.any():
            break
        live, x, known, gamma, moved, before, floor = live[go], x[go], known[go], gamma[go], moved[go], loglik[go], floor[go]
        weight = gamma * known[..., None]
        share = np.maximum(weight.sum(axis=1), 1e-12)
        mu = (weight * x[..., None]).sum(axis=1) / share
        var = np.maximum((weight * (x[..., None] - mu[:, None, :]) ** 2).sum(axis=1) / share, floor)
        stay = np.clip(np.stack((moved[:, 0, 0], moved[:, 1, 1]), -1) / np.maximum(moved.sum(axis=2), 1e-12), 1e-6, 1 - 1e-6)
    return out, logs
