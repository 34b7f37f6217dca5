"""Model numbers against numpy IRLS, closed forms and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from exposa.models import glm as M
from exposa.models import metrics as MT
from exposa.models import negbin as NB
from exposa.models import tweedie as TW


def _toy(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    a = rng.choice(["x", "y", "z"], n)
    b = rng.choice(["p", "q"], n)
    e = rng.uniform(0.5, 2.0, n)
    mu = e * np.exp(-1.0 + 0.4 * (a == "y") - 0.3 * (a == "z") + 0.5 * (b == "q"))
    y = rng.poisson(mu)
    rows = [(str(a[i]), str(b[i]), float(e[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "a string, b string, exposure double, y long"), a, b, e, y


def _numpy_poisson(X, y, off):
    beta = np.zeros(X.shape[1])
    for _ in range(50):
        eta = X @ beta + off
        mu = np.exp(eta)
        z = eta - off + (y - mu) / mu
        W = mu
        beta = np.linalg.solve(X.T @ (W[:, None] * X), X.T @ (W * z))
    return beta


def test_poisson_matches_numpy_irls(spark):
    df, a, b, e, y = _toy(spark)
    fit = M.fit_poisson(df, "y", ["a", "b"])
    base_a, base_b = fit.design.labels["a"][0], fit.design.labels["b"][0]
    cols = [np.ones(len(y))]
    names = ["(Intercept)"]
    for f, v, lv in (("a", a, fit.design.labels["a"]), ("b", b, fit.design.labels["b"])):
        for lev in lv[1:]:
            cols.append((v == lev).astype(float))
            names.append(f"{f}_{lev}")
    beta = _numpy_poisson(np.column_stack(cols), y.astype(float), np.log(e))
    got = fit.coefficients
    for n, v in zip(names, beta):
        assert abs(got[n] - v) < 1e-6, (n, got[n], v)
    assert base_a and base_b


def test_one_factor_rating_factor_closed_form(spark):
    df, a, b, e, y = _toy(spark)
    fit = M.fit_poisson(df, "y", ["a"])
    rf = {r["level"]: r["rf_p"] for r in M.rating_factors(spark, {"p": fit}).collect()}
    rate = {lv: y[a == lv].sum() / e[a == lv].sum() for lv in set(a)}
    base = fit.design.labels["a"][0]
    for lv in rate:
        assert abs(rf[lv] - rate[lv] / rate[base]) < 1e-8


def _nb_loglik(y, mu, theta):
    return sum(math.lgamma(v + theta) - math.lgamma(theta) - math.lgamma(v + 1)
               + theta * math.log(theta) + v * math.log(m) - (v + theta) * math.log(theta + m)
               for v, m in zip(y, mu))


def test_negbin_is_a_likelihood_maximum(spark):
    df, a, b, e, y = _toy(spark)
    nb = NB.fit_negbin(df, "y", ["a", "b"])
    mu = np.array([r["mu"] for r in nb.predict(df, "mu").select("mu").collect()])
    yy = np.array([r["y"] for r in df.select("y").collect()])
    ll = _nb_loglik(yy, mu, nb.theta)
    assert abs(ll - nb.loglik) < 1e-6 * abs(ll)
    # theta is a stationary point of the profile likelihood
    for t in (nb.theta * 0.9, nb.theta * 1.1):
        assert _nb_loglik(yy, mu, t) <= ll + 1e-9
    # and it beats the Poisson fit (NB nests Poisson)
    pois = M.fit_poisson(df, "y", ["a", "b"])
    mp = np.array([r["p"] for r in pois.predict(df, "p").select("p").collect()])
    llp = sum(v * math.log(m) - m - math.lgamma(v + 1) for v, m in zip(yy, mp))
    assert ll >= llp - 1e-6


def test_negbin_overdispersed_theta(spark):
    rng = np.random.default_rng(5)
    n = 3000
    lam = rng.gamma(shape=2.0, scale=1.0, size=n)    # theta = 2, mean 2
    y = rng.poisson(lam)
    df = spark.createDataFrame([(float(1.0), int(v), "k") for v in y], "exposure double, y long, c string")
    nb = NB.fit_negbin(df, "y", ["c"])
    assert 1.5 < nb.theta < 2.7
    assert abs(math.exp(nb.intercept) - y.mean()) < 1e-3


def test_tweedie_density_integrates_to_one():
    p, mu, phi = 1.5, 2.0, 1.3
    ys = np.linspace(1e-4, 60, 300001)
    dens = np.exp(TW.tweedie_logpdf(ys, np.full_like(ys, mu), phi, p))
    p0 = math.exp(TW.tweedie_logpdf(np.array([0.0]), np.array([mu]), phi, p)[0])
    total = p0 + np.trapezoid(dens, ys)
    assert abs(total - 1) < 2e-3
    mean = np.trapezoid(ys * dens, ys)
    assert abs(mean - mu) < 1e-2


@pytest.mark.parametrize("p", [1.1, 1.5, 1.9])
def test_tweedie_series_against_a_long_sum(p):
    y, mu, phi = np.array([0.01, 1.0, 50.0, 4000.0]), np.array([1.0, 2.0, 40.0, 90.0]), 0.9
    got = TW.tweedie_logpdf(y, mu, phi, p)
    alpha = (2 - p) / (1 - p)
    for yy, m, g in zip(y, mu, got):
        logz = -alpha * math.log(yy) + alpha * math.log(p - 1) - (1 - alpha) * math.log(phi) - math.log(2 - p)
        j = np.arange(1, 60_000, dtype=float)
        t = j * logz - TW.lgamma_np(j + 1) - TW.lgamma_np(-alpha * j)
        top = t.max()
        want = -math.log(yy) + top + math.log(np.exp(t - top).sum()) + (yy * m ** (1 - p) / (1 - p)
                                                                       - m ** (2 - p) / (2 - p)) / phi
        assert abs(g - want) < 1e-8 * max(1.0, abs(want))


def test_lgamma_np():
    xs = np.array([0.1, 0.5, 1.0, 2.5, 10.0, 123.4])
    assert np.allclose(TW.lgamma_np(xs), [math.lgamma(x) for x in xs], rtol=1e-12, atol=1e-12)


def test_auc_with_ties_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    s = rng.integers(0, 8, 400).astype(float)
    yv = rng.random(400) < (0.2 + s / 20)
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, yv)], "score double, y boolean")
    got = MT.roc_auc(df, "score", "y").first()["auc"]
    pos, neg = s[yv], s[~yv]
    brute = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(got - brute) < 1e-12


def test_error_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 1.0), (3.0, 3.0)], "y double, p double")
    r = MT.error_metrics(df, "y", ["p"]).first()
    mse = (0.25 + 1.0 + 0.0) / 3
    assert abs(r["mse"] - mse) < 1e-12 and abs(r["rmse"] - math.sqrt(mse)) < 1e-12
    assert abs(r["r2"] - (1 - mse / np.var([1.0, 2.0, 3.0]))) < 1e-12


def test_chi2_sf():
    from exposa.operators.rating import chi2_sf
    # chi-square with 2 df: survival = exp(-x/2)
    for x in (0.5, 2.0, 7.0):
        assert abs(chi2_sf(x, 2) - math.exp(-x / 2)) < 1e-12
    assert abs(chi2_sf(3.84145882, 1) - 0.05) < 1e-6
