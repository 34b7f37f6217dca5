"""Gaussian interaction models of the residual loss, for several pairs of
frequency models at once.

A pair (bi, prop) of frequency columns gives the regressors bi_freq:prop_freq,
bi_sev:prop_sev and their product, and the response total - bi_freq * bi_sev -
prop_freq * prop_sev.  All fits and all cross-validation errors of all pairs
follow from the sums of products of (1, x1, x2, x3, y) per fold: ONE
aggregation with one row a fold, whatever the number of pairs.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMS = ("(Intercept)", "freq_x", "sev_x", "all_x")


def regressors(bi_freq: str, prop_freq: str, bi_sev: str = "sev_lossofinc", prop_sev: str = "sev_prop",
               total: str = "total"):
    """The four regressors (intercept first) and the response, as columns."""
    bf, pf, bs, ps = (F.col(c) for c in (bi_freq, prop_freq, bi_sev, prop_sev))
    return [F.lit(1.0), bf * pf, bs * ps, bf * pf * bs * ps], F.col(total) - bf * bs - pf * ps


def moments(df: DataFrame, pairs: Mapping[str, tuple[str, str]], fold: str) -> dict[str, dict[int, np.ndarray]]:
    """pair -> fold -> 5 x 5 sums of products of (1, x1, x2, x3, y)."""
    cols = []
    for name, (bi, prop) in pairs.items():
        x, y = regressors(bi, prop)
        z = [*x, y]
        cols += [F.sum(z[i] * z[j]).alias(f"{name}|{i}|{j}") for i in range(5) for j in range(i, 5)]
    out: dict[str, dict[int, np.ndarray]] = {name: {} for name in pairs}
    for row in df.groupBy(fold).agg(*cols).collect():
        for name in pairs:
            m = np.zeros((5, 5))
            for i in range(5):
                for j in range(i, 5):
                    m[i, j] = m[j, i] = row[f"{name}|{i}|{j}"]
            out[name][row[fold]] = m
    return out


def solve(m: np.ndarray) -> np.ndarray:
    """Least-squares coefficients from the sums (columns scaled to unit length first)."""
    scale = np.sqrt(np.maximum(np.diag(m)[:4], 1e-300))
    b, *_ = np.linalg.lstsq(m[:4, :4] / np.outer(scale, scale), m[:4, 4] / scale, rcond=1e-12)
    return b / scale


def squared_error(m: np.ndarray, b: np.ndarray) -> float:
    return float(m[4, 4] - 2 * b @ m[:4, 4] + b @ m[:4, :4] @ b)


def cross_validated(folds: Mapping[int, np.ndarray]) -> dict[str, float]:
    """MSE over folds, the same adjusted for bias (+ error of the full fit - mean error of the
    folds' fits on all rows), and R squared of the full fit."""
    whole = sum(folds.values())
    n, full = whole[0, 0], solve(whole)
    cv = adjust = 0.0
    for m in folds.values():
        b, share = solve(whole - m), m[0, 0] / n
        cv += squared_error(m, b) / n
        adjust += share * squared_error(whole, b) / n
    error = squared_error(whole, full) / n
    spread = whole[4, 4] / n - (whole[0, 4] / n) ** 2
    adjusted = cv + error - adjust
    return {"mse": cv, "mse_adjusted": adjusted, "rmse": float(np.sqrt(max(adjusted, 0.0))),
            "r2": 1 - error / spread if spread > 0 else float("nan")}


# ---- interaction of two premiums, from moments of (1, prop, bi, prop * bi, total)

def premium_moments(df: DataFrame, prop: str, bi: str, total: str, part: str, covered: str) -> dict[tuple, np.ndarray]:
    """(part, covered) -> 5 x 5 sums of products, one aggregation."""
    z = [F.lit(1.0), F.col(prop), F.col(bi), F.col(prop) * F.col(bi), F.col(total)]
    sums = [F.sum(z[i] * z[j]).alias(f"m{i}{j}") for i in range(5) for j in range(i, 5)]
    out = {}
    for row in df.groupBy(part, covered).agg(*sums).collect():
        m = np.zeros((5, 5))
        for i in range(5):
            for j in range(i, 5):
                m[i, j] = m[j, i] = row[f"m{i}{j}"]
        out[row[part], row[covered]] = m
    return out


def _least_squares(m: np.ndarray, x: list[int], y: np.ndarray) -> np.ndarray:
    """Coefficients of columns ``x`` for the response ``y`` (its weights on the five columns)."""
    a, rhs = m[np.ix_(x, x)], (m @ y)[x]
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    return np.linalg.lstsq(a / np.outer(scale, scale), rhs / scale, rcond=1e-12)[0] / scale


def premium_interaction(moments: Mapping[tuple, np.ndarray], fit_part: str, test_part: str) -> dict:
    """Interaction models fitted on one part and their errors on the other.

    total: total ~ prop + bi + prop:bi on all rows of the part.  residual: total - prop - bi ~ bi:prop
    on its covered rows; the prediction is prop + bi + interaction, interaction 0 outside the cover.
    """
    sums = lambda part: sum((m for (p, _), m in moments.items() if p == part), np.zeros((5, 5)))
    none = np.zeros((5, 5))
    fit, fit_in = sums(fit_part), moments.get((fit_part, True), none)
    test, test_in = sums(test_part), moments.get((test_part, True), none)
    total, residual = np.array([0, 0, 0, 0, 1.0]), np.array([0, -1, -1, 0, 1.0])
    whole = _least_squares(fit, [0, 1, 2, 3], total)
    slope = _least_squares(fit_in, [0, 3], residual)
    n = test[0, 0]

    def rmse(error):
        return float(np.sqrt(max(error, 0.0) / n)) if n else float("nan")

    square = lambda m, v: float(v @ m @ v)
    with_slope = residual - np.array([slope[0], 0, 0, slope[1], 0])
    return {"total": whole, "residual": slope, "n": int(n),
            "rmse": {"total ~ prop + bi + prop:bi": rmse(square(test, total - np.append(whole, 0.0))),
                     "prop + bi": rmse(square(test, residual)),
                     "prop + bi + interaction": rmse(square(test - test_in, residual) + square(test_in, with_slope))}}
