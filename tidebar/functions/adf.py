"""Augmented Dickey-Fuller test over windows, in batches of numpy; no built-in function can choose a lag order."""

from __future__ import annotations

import math

import numpy as np

# MacKinnon's (1994) response surface for a Dickey-Fuller statistic with a constant.
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
SMALL_P = (2.1659, 1.4412, 0.038269)
LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)


def mackinnon_p(tau: np.ndarray) -> np.ndarray:
    small, large = (sum(k * tau**i for i, k in enumerate(p)) for p in (SMALL_P, LARGE_P))
    z = np.where(tau <= TAU_STAR, small, large)
    p = 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))
    return np.where(tau > TAU_MAX, 1.0, np.where(tau < TAU_MIN, 0.0, p))


def _factor(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower Cholesky factors of many matrices but for the last pivot, and which of them are far from singular."""
    out, sound = np.zeros_like(g), np.ones(len(g), bool)
    for j in range(g.shape[1] - 1):
        column = g[:, j:, j] - np.einsum("nik,nk->ni", out[:, j:, :j], out[:, j, :j])
        sound &= column[:, 0] > 1e-9 * g[:, j, j]
        out[:, j:, j] = column / np.sqrt(np.where(sound, column[:, 0], 1.0))[:, None]
    return out, sound


def _factored(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of y, the last of the columns, on the others: factors, residual sums of squares on the first 1, 2, ..., soundness."""
    z = np.stack(columns, axis=1)
    g = z @ z.swapaxes(1, 2)
    factor, sound = _factor(g)
    return factor, g[:, -1, -1][:, None] - (factor[:, -1, :-1] ** 2).cumsum(1), sound


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least squares for many small systems at once: coefficients, residual sums of squares, inverse of x'x."""
    inverse = np.linalg.pinv(np.einsum("rti,rtj->rij", x, x), hermitian=True)
    beta = np.einsum("rij,rj->ri", inverse, np.einsum("rti,rt->ri", x, y))
    rest = y - np.einsum("rti,ri->rt", x, beta)
    return beta, np.einsum("rt,rt->r", rest, rest), inverse


def _regressors(x: np.ndarray, step: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """[level, constant, lagged differences 1..lags] and the differences they explain."""
    t = np.arange(lags, step.shape[1])
    parts = [x[:, t], np.ones((len(x), len(t))), *(step[:, t - k] for k in range(1, lags + 1))]
    return np.stack(parts, axis=2), step[:, t]


def _dense(x: np.ndarray, step: np.ndarray, most: int) -> np.ndarray:
    """The statistic of windows whose regressors may hang on one another, with a fit for each order."""
    full_x, y = _regressors(x, step, most)
    nobs = y.shape[1]
    aic = np.stack([nobs * np.log(np.maximum(_fit(full_x[:, :, : 2 + k], y)[1], 1e-300) / nobs) + 2 * (2 + k) for k in range(most + 1)], axis=1)
    best = aic.argmin(1)
    tau = np.full(len(x), np.nan)
    for k in np.unique(best):
        at = best == k
        a, b = _regressors(x[at], step[at], int(k))
        beta, ssr, inverse = _fit(a, b)
        error = np.sqrt(ssr / (b.shape[1] - a.shape[2]) * inverse[:, 0, 0])
        tau[at] = np.where(error > 0, beta[:, 0] / np.where(error > 0, error, 1), np.nan)
    return tau


def adf_pvalues(x: np.ndarray) -> np.ndarray:
    """Augmented Dickey-Fuller test with a constant, lag order by AIC, for each row of x.

    Orders are nested: one factor of all cross products of a window has the residuals of each. The chosen order is fitted
    again on all rows it has, with the level last, whose statistic is then an entry of the factor.
    """
    n = x.shape[1]
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    step = np.diff(x, axis=1)
    # Columns are scaled, so that the normal equations stay well conditioned.
    scale = np.maximum(np.abs(step).max(1, keepdims=True), 1e-300)
    x, step = (x - x.mean(1, keepdims=True)) / scale, step / scale
    lagged = lambda rows, first, k: step[rows, first - k : step.shape[1] - k]
    every, nobs = slice(None), step.shape[1] - most
    ones = np.ones((len(x), step.shape[1]))
    _, rest, sound = _factored([ones[:, most:], x[:, most:-1], *(lagged(every, most, k) for k in range(1, most + 1)), step[:, most:]])
    with np.errstate(divide="ignore", invalid="ignore"):
        aic = nobs * np.log(np.maximum(rest[:, 1:], 1e-300) / nobs) + 2 * (2 + np.arange(most + 1))
    sound &= rest[:, -1] > 1e-9 * (step[:, most:] ** 2).sum(1)
    best, tau = aic.argmin(1), np.full(len(x), np.nan)
    for k in np.unique(best[sound]).tolist():
        at = np.flatnonzero(sound & (best == k))
        factor, rest, fine = _factored([ones[at, k:], *(lagged(at, k, i) for i in range(1, k + 1)), x[at, k:-1], step[at, k:]])
        sound[at] = fine
        spread = rest[:, -1] / (step.shape[1] - k - (k + 2))
        tau[at] = factor[:, -1, -2] / np.sqrt(np.maximum(spread, 1e-300))
    odd = ~sound & (np.ptp(x, axis=1) > 0)
    if odd.any():
        tau[odd] = _dense(x[odd], step[odd], most)
    return np.where(np.ptp(x, axis=1) > 0, mackinnon_p(tau), np.nan)
