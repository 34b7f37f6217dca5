"""The Tweedie density (1 < power < 2) and the log-likelihood of a fitted GLM.

Spark's GLM gives no likelihood for this family, so it is summed on Spark from
a vectorised series density (Dunn & Smyth) evaluated in a pandas_udf on Arrow
batches.  phi is the Pearson estimate.  The profile over powers, which takes
phi at its maximum, is ``cells.tweedie_profile``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from exposa.models.glm import GLMFit

# Lanczos coefficients (g = 7, n = 9): a published constant table.
_LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028,
            771.32342877765313, -176.61502916214059, 12.507343278686905,
            -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def lgamma_np(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0 (Lanczos; reflection below 0.5)."""
    x = np.asarray(x, dtype=float)
    out = np.empty_like(x)
    small = x < 0.5
    if small.any():
        xs = x[small]
        out[small] = np.log(np.pi / np.abs(np.sin(np.pi * xs))) - lgamma_np(1 - xs)
    xl = x[~small] - 1
    a = np.full_like(xl, _LANCZOS[0])
    t = xl + 7.5
    for i, c in enumerate(_LANCZOS[1:], start=1):
        a = a + c / (xl + i)
    out[~small] = 0.5 * np.log(2 * np.pi) + (xl + 0.5) * np.log(t) - t + np.log(a)
    return out


_STEP = 64                # series terms added at a time
_SMALL = -40.0            # log of a term, against the sum, that no longer changes it


def _series(logz: np.ndarray, alpha: float, mode: np.ndarray) -> np.ndarray:
    """log of the density's series per row, from its largest term outwards.

    Terms fall off on both sides of the mode, so a side ends when its last
    term is too small to change the sum: no fixed window, and a block of
    _STEP terms a row at a time whatever the widest row needs.  The gamma functions
    depend on the place alone, so they are looked up where places are fewer than terms."""
    def gammas(j):
        low = j.min(initial=np.inf)
        places = j.max(initial=-np.inf) - low + 1
        if not places < j.size:
            return lgamma_np(j + 1) + lgamma_np(-alpha * j)
        own = low + np.arange(int(places))
        return (lgamma_np(own + 1) + lgamma_np(-alpha * own))[(j - low).astype(np.int64)]

    def term(j, rows):
        return j * logz[rows][:, None] - gammas(j)

    every = np.arange(len(mode))
    top = term(mode[:, None], every)[:, 0]
    total = np.ones(len(mode))
    for way in (1, -1):
        rows, at = every, mode.copy()
        while len(rows):
            width = _STEP if way == 1 else min(_STEP, int(at[rows].max()) - 1)      # no term is below 1
            if width < 1:
                break
            j = at[rows][:, None] + way * np.arange(1, width + 1)
            t = np.where(j >= 1, term(np.maximum(j, 1.0), rows) - top[rows][:, None], -np.inf)
            total[rows] += np.exp(t).sum(axis=1)
            at[rows] += way * width
            rows = rows[(t[:, -1] > _SMALL)]
    return top + np.log(total)


_WIDE = 2.0               # a piece of log z; the series has its zeros at log z = .. + i pi, so 20 nodes give full precision
_NODES = 20
_PIECES: dict = {}        # (power, number of the piece) -> Chebyshev coefficients


def series_mode(logz: np.ndarray, p: float) -> np.ndarray:
    """Place of the series' largest term, which y and phi decide through log z alone."""
    return np.maximum(1.0, np.round(np.exp((p - 1) * logz + (2 - p) * (math.log(p - 1) - math.log(2 - p)))))


def log_series(logz: np.ndarray, p: float) -> np.ndarray:
    """``_series`` of a power as a function of log z: summed at the nodes of the pieces in use, once a
    process, and interpolated there to rounding error, so a value costs the same whatever its number of terms."""
    from numpy.polynomial import chebyshev
    out = np.full(len(logz), np.nan)
    known = np.isfinite(logz)
    at = np.floor(logz[known] / _WIDE).astype(np.int64)
    pieces, own = np.unique(at, return_inverse=True)
    if len(missing := [int(k) for k in pieces if (p, int(k)) not in _PIECES]):
        nodes = np.cos(np.pi * (np.arange(_NODES) + 0.5) / _NODES)
        x = (_WIDE * (np.array(missing)[:, None] + (nodes + 1) / 2)).ravel()
        values = _series(x, (2 - p) / (1 - p), series_mode(x, p)).reshape(len(missing), _NODES)
        to = np.linalg.inv(chebyshev.chebvander(nodes, _NODES - 1))
        _PIECES.update({(p, k): c for k, c in zip(missing, values @ to.T, strict=True)})
    if len(pieces):
        table = np.array([_PIECES[p, int(k)] for k in pieces]).T
        t = 2 * (2 * (logz[known] / _WIDE - at) - 1)
        b1, b2 = np.zeros(len(t)), np.zeros(len(t))
        for c in table[:0:-1]:                           # Clenshaw
            b1, b2 = c[own] + t * b1 - b2, b1
        out[known] = table[0][own] + t / 2 * b1 - b2
    return out


def log_scale(y: np.ndarray, phi: float, p: float) -> np.ndarray:
    """log density of y > 0 without its part in mu, which is (y theta - kappa) / phi."""
    alpha = (2 - p) / (1 - p)
    logy = np.log(y)
    logz = -alpha * logy + alpha * math.log(p - 1) - (1 - alpha) * math.log(phi) - math.log(2 - p)
    return log_series(logz, p) - logy


def tweedie_logpdf(y: np.ndarray, mu: np.ndarray, phi: float, p: float) -> np.ndarray:
    """log density of the compound Poisson-gamma Tweedie, 1 < p < 2."""
    y, mu = np.asarray(y, float), np.asarray(mu, float)
    out = np.empty_like(y)
    zero = y <= 0
    out[zero] = -(mu[zero] ** (2 - p)) / (phi * (2 - p))
    if (~zero).any():
        yp, mp = y[~zero], mu[~zero]
        theta = mp ** (1 - p) / (1 - p)
        kappa = mp ** (2 - p) / (2 - p)
        out[~zero] = log_scale(yp, phi, p) + (yp * theta - kappa) / phi
    return out


def _logpdf_udf(phi: float, p: float):
    @pandas_udf("double")
    def f(y: pd.Series, mu: pd.Series) -> pd.Series:
        return pd.Series(tweedie_logpdf(y.to_numpy(), mu.to_numpy(), phi, p))
    return f


def loglik(df: DataFrame, fit: GLMFit, power: float, weight: str | None = None) -> tuple[float, float, int]:
    """(log-likelihood, phi, parameters) of a fitted Tweedie GLM; phi by Pearson."""
    pred = fit.predict(df, "_mu")
    k, w, y = len(fit.design.names) + 1, F.col(weight) if weight else F.lit(1.0), F.col(fit.response)
    n, pear = pred.agg(F.count(F.lit(1)), F.sum(w * F.pow(y - F.col("_mu"), 2)
                                                / F.pow(F.col("_mu"), F.lit(power)))).first()
    phi = pear / max(n - k, 1)
    ll = pred.agg(F.sum(w * _logpdf_udf(phi, power)(y.cast("double"), "_mu"))).first()[0]
    return float(ll), float(phi), k + 1
