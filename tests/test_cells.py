"""Batched GLMs on design cells against numpy, single fits and Spark ML."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from exposa.models import cells as CL
from exposa.models import glm as M
from exposa.models import tweedie as TW


def _rows(n=900, seed=7):
    rng = np.random.default_rng(seed)
    a, b = rng.choice(["x", "y", "z"], n), rng.choice(["p", "q"], n)
    pc = rng.integers(0, 12, n)
    x, e, w = rng.normal(10, 1, n).round(1), rng.choice([0.5, 1.0, 1.5], n), rng.choice([0.4, 0.9, 1.0], n)
    mu = e * np.exp(-2.5 + 0.2 * x - 0.4 * (a == "y") + 0.3 * (b == "q") + 0.1 * (pc % 4))
    count = rng.poisson(mu * rng.gamma(3.0, 1 / 3.0, n))
    amount = np.where(count > 0, rng.gamma(2.0, 400.0, n) * count, 0.0).round(2)
    return a, b, pc, x, e, w, count, amount


def _frame(spark, rows):
    a, b, pc, x, e, w, count, amount = rows
    return spark.createDataFrame(
        [(str(a[i]), str(b[i]), f"{pc[i]:02d}", "NS"[pc[i] % 2], float(x[i]), float(e[i]), float(w[i]), int(count[i]),
          float(amount[i]), "test" if i % 5 == 0 else "train") for i in range(len(a))],
        "a string, b string, pc string, state string, x double, exposure double, w double, n long, amount double, split string")


def _design(fit, a, b, x, geo=None):
    """Columns of the fit's coefficients, in their order."""
    out = []
    for name in fit.names:
        f, _, level = name.rpartition("_") if "_" in name else (name, "", "")
        out.append(np.ones(len(a)) if name == "(Intercept)" else x if name == "x" else
                   ({"a": a, "b": b, "geo_code": geo}[f] == level).astype(float))
    return np.column_stack(out)


def _irls(X, y, off, w, variance, steps=60):
    """Plain IRLS with a log link."""
    mu = y + 0.1
    for _ in range(steps):
        eta = np.log(mu)
        W = w * mu ** 2 / variance(mu)
        beta = np.linalg.lstsq(np.sqrt(W)[:, None] * X, np.sqrt(W) * (eta - off + (y - mu) / mu), rcond=None)[0]
        mu = np.exp(X @ beta + off)
    return beta, mu


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.mark.parametrize("family,power", [("poisson", 1.0), ("gamma", 2.0), ("tweedie", 1.3)])
def test_families_match_numpy(spark, rows, family, power):
    a, b, pc, x, e, w, count, amount = rows
    df, y = _frame(spark, rows), (count if family == "poisson" else amount).astype(float)
    keep = y > 0 if family == "gamma" else np.ones(len(y), bool)
    if family == "gamma":
        df = df.filter("amount > 0")
    cells = CL.build(df, "n" if family == "poisson" else "amount", ["a", "b"], ["x"], exposure="exposure", weight="w")
    f = CL.fit(cells, [CL.Spec("m", family, power=power)])["m"]
    beta, mu = _irls(_design(f, a, b, x)[keep], y[keep], np.log(e)[keep], w[keep], lambda m: m ** power)
    assert f.converged and np.allclose(f.beta, beta, atol=1e-6)
    assert f.rows == keep.sum() and math.isclose(f.weight, w[keep].sum())
    assert math.isclose(f.pearson, (w[keep] * (y[keep] - mu) ** 2 / mu ** power).sum(), rel_tol=1e-6)
    assert cells.table.count() < keep.sum() or family != "poisson"
    got = f.predict(df, "mu").select("mu", "x").toPandas()["mu"]
    assert np.allclose(np.sort(got), np.sort(mu), rtol=1e-6)


def test_negbin_gradients_vanish(spark, rows):
    a, b, pc, x, e, w, count, amount = rows
    cells = CL.build(_frame(spark, rows), "n", ["a", "b"], ["x"], exposure="exposure", weight="w")
    f = CL.fit(cells, [CL.Spec("nb", "negbin")])["nb"]
    X = _design(f, a, b, x)

    def ll(beta, t):
        mu = e * np.exp(X @ beta)
        lg = np.vectorize(math.lgamma)
        return (w * (lg(count + t) - math.lgamma(t) - lg(count + 1.0) + t * np.log(t / (t + mu))
                     + count * np.log(mu / (t + mu)))).sum()
    top = ll(f.beta, f.theta)
    assert f.converged and 1 < f.theta < 20 and math.isclose(top, f.objective, rel_tol=1e-9)
    for k in range(len(f.beta)):
        for d in (-1e-3, 1e-3):
            assert ll(f.beta + d * np.eye(len(f.beta))[k], f.theta) < top + 1e-9
    assert ll(f.beta, f.theta * 1.01) < top and ll(f.beta, f.theta / 1.01) < top


def test_negbin_without_overdispersion_is_the_poisson_fit(spark):
    df = spark.createDataFrame([("k" if i % 2 else "l", 1.0, i % 3 // 2 + 1) for i in range(200)],
                               "f string, exposure double, n long")
    fits = CL.fit(CL.build(df, "n", ["f"], exposure="exposure"), [CL.Spec("p", "poisson"), CL.Spec("nb", "negbin")])
    assert fits["nb"].converged and fits["nb"].theta > CL.POISSON_LIMIT
    assert np.allclose(fits["nb"].beta, fits["p"].beta)


ENCODINGS = {"fine": {f"{k:02d}": f"g{k:02d}" for k in range(12)},
             "mid": {f"{k:02d}": f"m{k // 3}" for k in range(12)},
             "coarse": {f"{k:02d}": "all" if k < 6 else "rest" for k in range(12)}}


def test_grid_equals_fits_one_by_one(spark, rows):
    """Three encodings, Poisson and NB, in the same passes; equal to a fit of each on its own rows."""
    df = _frame(spark, rows)
    cells = CL.build(df, "n", ["a"], ["x"], exposure="exposure", weight="w", part="split", fit_part="train",
                     key=["pc", "state"], encodings=ENCODINGS)
    specs = [CL.Spec(f"{name}|{fam}", fam, encoding=name) for name in ENCODINGS for fam in ("poisson", "negbin")]
    fits = CL.fit(cells, specs)
    errors = CL.squared_errors(cells, fits, "test")
    for name, levels in ENCODINGS.items():
        mapped = F.create_map(*[F.lit(v) for kv in levels.items() for v in kv])[F.col("pc")]
        own = df.withColumn("geo_code", mapped)
        alone = CL.build(own.filter("split = 'train'"), "n", ["a", "geo_code"], ["x"], exposure="exposure", weight="w")
        for fam in ("poisson", "negbin"):
            one, f = CL.fit(alone, [CL.Spec("m", fam)])["m"], fits[f"{name}|{fam}"]
            assert f.converged and math.isclose(f.objective, one.objective, rel_tol=1e-9)
            assert math.isclose(f.theta, one.theta, rel_tol=1e-4) or fam == "poisson"
            ml = M.fit_poisson(own.filter("split = 'train'"), "n", ["a", "geo_code"], numeric=["x"], weight="w")
            if fam == "poisson" and f.names[-1].split("_")[-1] != ml.design.labels["geo_code"][0]:
                shared = [n for n in one.names if n in ml.coefficients and not n.startswith("geo")]
                assert all(math.isclose(one.coefficients[n], ml.coefficients[n], abs_tol=1e-5) for n in shared if n != "(Intercept)")
            test = one.predict(own.filter("split = 'test'"), "mu").select(F.sum((F.col("n") - F.col("mu")) ** 2),
                                                                       F.count("*")).first()
            assert math.isclose(errors[f"{name}|{fam}"][0], test[0], rel_tol=1e-6)
            assert errors[f"{name}|{fam}"][1] == test[1]


def test_unseen_codes_fall_back_to_the_state(spark):
    data = [("01", "N", 1, "train"), ("02", "S", 3, "train"), ("03", "S", 5, "test"), ("04", "W", 2, "test")] * 5
    df = spark.createDataFrame(data, "pc string, state string, n long, split string")
    cells = CL.build(df, "n", [], part="split", fit_part="train", key=["pc", "state"],
                     encodings={"g": {"01": "N", "02": "S", "03": "other", "04": "W"}})
    f = CL.fit(cells, [CL.Spec("m", "poisson", encoding="g")])
    base = 1.0 if cells.encodings["g"].levels[0] == "N" else 3.0
    sse, n = CL.squared_errors(cells, f, "test")["m"]
    assert n == 10 and math.isclose(sse, 5 * (5 - 3) ** 2 + 5 * (2 - base) ** 2, rel_tol=1e-6)


def test_logistic_covariance_matches_numpy(spark, rows):
    a, b, pc, x, e, w, count, amount = rows
    df = _frame(spark, rows).withColumn("hit", (F.col("n") > 0).cast("double"))
    f = CL.fit(CL.build(df, "hit", ["a"], ["x"], weight="w"), [CL.Spec("m", "binomial")])["m"]
    X, y = _design(f, a, b, x), (count > 0).astype(float)
    beta = np.zeros(X.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-X @ beta))
        info = X.T @ ((w * p * (1 - p))[:, None] * X)
        beta = beta + np.linalg.solve(info, X.T @ (w * (y - p)))
    assert f.converged and np.allclose(f.beta, beta, atol=1e-7)
    assert np.allclose(f.covariance(), np.linalg.inv(info), rtol=1e-5)


def test_profile_equals_single_fits(spark, rows):
    df = _frame(spark, rows)
    powers = [1.1, 1.2, 1.3, 1.4, 1.5, 1.6, 1.7, 1.8, 1.9]
    cells = CL.build(df, "amount", ["a", "b"], ["x"], exposure="exposure", weight="w")
    got = CL.tweedie_profile(cells, powers, weight="w")
    for r in got:
        single = M.fit_tweedie(df, "amount", ["a", "b"], power=r["power"], numeric=["x"], exposure="exposure", weight="w")
        shared = [n for n in r["fit"].names if n in single.coefficients]
        assert len(shared) >= 3
        assert all(abs(r["fit"].coefficients[n] - single.coefficients[n]) < 1e-3 for n in shared), r["power"]
        mu = r["fit"].predict(df, "mu").select("amount", "mu", "w").toPandas()

        def ll(phi):
            return float(mu["w"] @ TW.tweedie_logpdf(mu["amount"], mu["mu"], phi, r["power"]))
        assert math.isclose(ll(r["phi"]), r["loglik"], rel_tol=1e-7)
        assert max(ll(r["phi"] * 1.02), ll(r["phi"] / 1.02)) <= r["loglik"] + 1e-3 * abs(r["loglik"]) * 1e-2
    again = CL.tweedie_profile(cells, powers[:1], weight="w")[0]
    assert math.isclose(again["loglik"], got[0]["loglik"], rel_tol=1e-7)


def test_empty_and_missing(spark):
    df = spark.createDataFrame([("a", 1.0, 2, 1.0), (None, 2.0, 1, 1.0), ("b", None, 7, 1.0), ("b", 1.0, None, 1.0),
                                ("b", 3.0, 4, 0.0), ("a", 3.0, 3, 1.0), ("b", 1.0, 3, 1.0)],
                               "f string, x double, n long, exposure double")
    f = CL.fit(CL.build(df, "n", ["f"], ["x"], exposure="exposure"), [CL.Spec("m", "poisson")])["m"]
    assert f.rows == 4 and f.converged
    none = CL.fit(CL.build(df.filter("false"), "n", ["f"], ["x"]), [CL.Spec("m", "poisson"), CL.Spec("nb", "negbin")])
    assert not none["m"].converged and none["nb"].rows == 0
    with pytest.raises(ValueError):
        CL.fit(CL.build(df, "n", ["f"]), [CL.Spec("m", "cauchy")])


def test_density_by_pieces_is_the_series(spark):
    # before: every response's series was summed again for every dispersion, in every round
    from exposa.models import tweedie as T
    rng = np.random.default_rng(8)
    y = np.exp(rng.uniform(-2, 12, 500))
    for p in (1.05, 1.5, 1.9):
        for phi in (2.0, 300.0):
            alpha = (2 - p) / (1 - p)
            logz = -alpha * np.log(y) + alpha * math.log(p - 1) - (1 - alpha) * math.log(phi) - math.log(2 - p)
            mode = np.maximum(1.0, np.round(y ** (2 - p) / (phi * (2 - p))))
            assert np.allclose(T.series_mode(logz, p), mode, rtol=1e-9, atol=1.0)
            want = T._series(logz, alpha, mode)
            assert np.allclose(T.log_series(logz, p), want, rtol=1e-10, atol=1e-10)
    series, calls = T._series, []
    T._series = lambda logz, *a: calls.append(len(logz)) or series(logz, *a)
    try:
        many = np.exp(rng.uniform(0, 9, 20_000))
        T._PIECES.clear()
        T.log_scale(many, 50.0, 1.5)
        T.log_scale(many, 50.0, 1.5)
    finally:
        T._series = series
    assert len(calls) == 1 and calls[0] < 1000
    assert np.isnan(T.log_series(np.array([np.nan, np.inf]), 1.5)).all() and len(T.log_series(np.array([]), 1.5)) == 0


def test_a_pass_reads_held_batches(spark, rows):
    # before: every pass handed each cell to Python as a row, and its sums back as arrays
    cells = CL.build(_frame(spark, rows), "n", ["a", "b"], ["x"], exposure="exposure", weight="w")
    with cells.held() as held:
        assert dict(held.dtypes)["cells"] == "binary" and held.count() < cells.table.count()
        assert held.rdd.getNumPartitions() == cells.tasks <= cells.parts and held.storageLevel.useMemory
        with cells.held() as again:
            assert again is held
        assert cells._held is held
    assert cells._held is None and not held.storageLevel.useMemory


def test_predict_looks_levels_up_without_a_literal_map(spark):
    # before: a map literal of all levels, searched from its start for every row
    n = 40
    df = spark.createDataFrame([(f"l{i % n}", float(i % 7 + i % n / 10)) for i in range(400)] + [(None, 2.0), ("l0", 3.0)],
                               "f string, y double")
    f = CL.fit(CL.build(df, "y", ["f"]), [CL.Spec("m", "poisson")])["m"]
    scored = f.predict(df.withColumn("k", F.lit(1)), "mu")
    assert scored.columns == ["f", "y", "k", "mu"] and scored.count() == df.count()
    assert "l17" not in scored._jdf.queryExecution().optimizedPlan().expressions().toString()
    got = {r.f: r.mu for r in scored.collect()}
    for level in (None, "l0", "l17"):
        assert math.isclose(got[level], math.exp(f.beta[0] + f.coefficients.get(f"f_{level}", 0.0)), rel_tol=1e-9)
