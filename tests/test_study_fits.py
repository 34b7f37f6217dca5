"""The study's fits on the smallest data: chosen families, powers, parts and errors recomputed plainly."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from exposa.models import interaction as IA
from exposa.plans import q_cells as Q
from exposa.plans import stages as S
from exposa.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_premium_interaction_matches_numpy(spark):
    rng = np.random.default_rng(11)
    n = 600
    prop, bi = rng.gamma(2, 500, n), rng.gamma(2, 200, n)
    covered = rng.random(n) < 0.6
    bi = np.where(covered, bi, 0.0)
    total = 100 + 0.9 * prop + 1.2 * bi - 2e-4 * prop * bi + rng.normal(0, 80, n)
    part = np.where(rng.random(n) < 0.5, "interaction", "test")
    df = spark.createDataFrame([(float(a), float(b), float(c), str(d), bool(e)) for a, b, c, d, e in
                                zip(prop, bi, total, part, covered)],
                               "prop double, bi double, total double, part string, covered boolean")
    got = IA.premium_interaction(IA.premium_moments(df, "prop", "bi", "total", "part", "covered"), "interaction", "test")
    X = np.column_stack([np.ones(n), prop, bi, prop * bi])
    f, t = part == "interaction", part == "test"
    whole = np.linalg.lstsq(X[f], total[f], rcond=None)[0]
    inside = f & covered
    slope = np.linalg.lstsq(X[inside][:, [0, 3]], (total - prop - bi)[inside], rcond=None)[0]
    assert np.allclose(got["total"], whole, rtol=1e-6) and np.allclose(got["residual"], slope, rtol=1e-6)
    inter = np.where(covered, X[:, [0, 3]] @ slope, 0.0)
    rmse = lambda p: math.sqrt(np.mean((total - p)[t] ** 2))
    want = {"total ~ prop + bi + prop:bi": rmse(X @ whole), "prop + bi": rmse(prop + bi),
            "prop + bi + interaction": rmse(prop + bi + inter)}
    assert got["n"] == t.sum() and got["rmse"] == pytest.approx(want, rel=1e-6)


def test_grid_takes_the_better_family_on_both_lines(spark):
    rows = QUERIES["score_geo_grid"](spark, SF).collect()
    assert {r.line for r in rows} == {"prop", "lossofinc"}
    for r in rows:
        assert r.converged and r.rmse == min(r.rmse_poisson, r.rmse_negbin) and r.theta > 0
        assert r.family == ("poisson" if r.rmse_poisson < r.rmse_negbin else "negbin") or r.rmse_poisson == r.rmse_negbin
    for line in ("prop", "lossofinc"):
        errors = [r.rmse for r in rows if r.line == line]
        assert errors == sorted(errors) and len({r.n_geo_code for r in rows if r.line == line}) == len(errors) > 3


def test_encodings_of_equal_size_are_all_scored(spark):
    # before: only the first encoding of each number of codes, whatever the others' codes
    areas = [("S", "S1", "X", "p1", 5.0), ("S", "S1", "X", "p2", 100.0), ("S", "S1", "V", "p7", 50.0),
             ("S", "S2", "Z", "p5", 20.0), ("S", "S2", "W", "p6", 20.0)]
    own = spark.createDataFrame(areas, "state string, sa4name string, sa3name string, riskpostcode string, exposure double")
    got, sizes = Q.grid_encodings(own, [(1, 10.0, 25.0, 0.0), (2, 0.0, 10.0, 0.0), (3, 1.0, 10.0, 0.0), (4, 0.0, 0.0, 0.0)])
    assert sizes == {"1": 3, "2": 3, "4": 5}                                       # 3 has the map of 2
    assert got["1"] == {"p1": "X", "p2": "X", "p7": "p7", "p5": "S2", "p6": "S2"}
    assert got["2"] == {"p1": "S1", "p2": "S1", "p7": "S1", "p5": "p5", "p6": "p6"}


def test_grid_rows_hold_every_distinct_encoding(spark):
    policies = S.policy_claims_second(spark, SF)
    maps = {}
    for r in Q.G.one_code(Q.G.geo_grid_maps(policies, Q._grid_rows()), ["grid_id"]).collect():
        maps.setdefault(r.grid_id, {})[r.riskpostcode] = r.geo_code
    want = {frozenset(m.items()) for m in maps.values()}
    rows = QUERIES["score_geo_grid"](spark, SF).collect()
    for line in ("prop", "lossofinc"):
        each = [e for r in rows if r.line == line for e in r.encodings]
        assert {frozenset(maps[e.grid_id].items()) for e in each} == want and len(each) >= len(want)
    for r in rows:
        first = min(r.encodings, key=lambda e: e.grid_id)
        assert first.grid_id == r.grid_id and (first.family, first.rmse, first.test_rmse) == (r.family, r.rmse, r.test_rmse)
        assert [e.rmse for e in r.encodings] == sorted(e.rmse for e in r.encodings)


def test_grid_parts(spark):
    """Four fifths train, four fifths of these fit, the same share of claims in each."""
    own = Q.grid_parts(S.policy_claims_second(spark, SF), "suminsured_prop > 0", "claimcount_prop > 0").cache()
    n = {(r.part, r.has_claim): r["count"] for r in own.groupBy("part", "has_claim").count().collect()}
    for claim in (True, False):
        total = sum(v for (_, c), v in n.items() if c == claim)
        train = math.floor(total * 0.8)
        assert n["analysis", claim] == math.floor(train * 0.8) and n["assess", claim] == train - n["analysis", claim]
        assert n["test", claim] == total - train


def test_tweedie_uses_the_profile(spark):
    profile = QUERIES["tweedie_profile"](spark, SF).collect()
    fit = QUERIES["fit_tweedie_premium"](spark, SF).collect()
    for line in ("prop", "lossofinc"):
        own = [r for r in profile if r.line == line]
        assert [r.power for r in own] == list(Q.POWERS) and sum(r.best for r in own) == 1
        best = max(own, key=lambda r: r.loglik)
        assert best.best and {r.power for r in fit if r.line == line} == {best.power}
        terms = {r.term for r in fit if r.line == line}
        assert f"log_suminsured_{line}" in terms and any(t.startswith("geo_code_") for t in terms)
        assert all(any(t.startswith(f) for t in terms) for f in Q.RISK)
        # the score equations of the chosen fit hold on the training rows
        rows, lines = Q._tweedie(spark, SF)
        train = rows.filter("part = 'train'").filter("covered" if line == "lossofinc" else "true")
        p, y, w = best.power, F.col(f"grossincurred_{line}"), F.col("date_weights")
        pull = w * (y - F.col("mu")) * F.pow("mu", F.lit(1 - p))
        size = w * F.abs(y - F.col("mu")) * F.pow("mu", F.lit(1 - p))
        scored = lines[line]["fit"].predict(train, "mu")
        by = scored.groupBy("building_type").agg(F.sum(pull).alias("pull"), F.sum(size).alias("size")).collect()
        assert by and all(abs(r.pull) < 1e-3 * r.size for r in by)


def test_tweedie_errors_recomputed(spark):
    rows, lines = Q._tweedie(spark, SF)
    part = lines["lossofinc"]["fit"].predict(lines["prop"]["fit"].predict(rows.filter("part <> 'train'"), "p"), "b") \
        .select("part", "covered", "p", F.when(F.col("covered"), F.col("b")).otherwise(0.0).alias("b"), "total").toPandas()
    f, t = part["part"] == "interaction", part["part"] == "test"
    X = np.column_stack([np.ones(len(part)), part["p"], part["b"], part["p"] * part["b"]])
    beta = np.linalg.lstsq(X[f], part["total"][f], rcond=None)[0]
    want = {"total ~ prop + bi + prop:bi": X @ beta, "prop + bi": part["p"] + part["b"]}
    got = {r.prediction: (r.n, r.rmse) for r in QUERIES["tweedie_error"](spark, SF).collect()}
    for name, pred in want.items():
        assert got[name][0] == t.sum()
        assert got[name][1] == pytest.approx(math.sqrt(((part["total"] - pred)[t] ** 2).mean()), rel=1e-5)
    total = [r.estimate for r in QUERIES["interaction_tweedie"](spark, SF).collect() if r.model == "total"]
    assert np.allclose(total, beta, rtol=1e-3, atol=1e-6)


def test_logistic_on_a_tenfold_down_sample(spark):
    pol = S.policy_claims_second(spark, SF)
    train, test = Q.logistic_parts(pol, ratio=2.0)
    n = {r.has_claim: r["count"] for r in train.groupBy("has_claim").count().collect()}
    assert n[False] <= 2 * n[True]
    covered = pol.filter("LossofIncome_cover AND suminsured_lossofinc > 0")
    claims, others = covered.filter("grossincurred_lossofinc > 0").count(), covered.filter("grossincurred_lossofinc <= 0").count()
    assert n[True] == math.floor(claims * 0.8)
    assert test.count() == claims - math.floor(claims * 0.8) + others - math.floor(others * 0.8)
    fit = Q.logistic_fit(train)
    rows = train.select("occupation_risk", "log_suminsured_lossofinc", "date_weights", "has_claim").toPandas()
    X = np.column_stack([np.ones(len(rows)), rows["log_suminsured_lossofinc"],
                         *[(rows["occupation_risk"] == v).astype(float) for v in fit.cells.levels["occupation_risk"][1:]]])
    p = 1 / (1 + np.exp(-X @ fit.beta))
    w = rows["date_weights"].to_numpy()
    assert np.abs(X.T @ (w * (rows["has_claim"].astype(float) - p))).max() < 1e-4
    info = X.T @ ((w * p * (1 - p)).to_numpy()[:, None] * X) if hasattr(p, "to_numpy") else X.T @ ((w * p * (1 - p))[:, None] * X)
    table = {r.term: r for r in QUERIES["logistic_coefficients"](spark, SF).collect()}
    assert table["(Intercept)"].std_error > 0 and 0 <= table["log_suminsured_lossofinc"].p_value <= 1
    assert np.allclose(np.sqrt(np.diag(fit.covariance())), np.sqrt(np.diag(np.linalg.pinv(info))), rtol=1e-3)


# ---- fits of other modules: numbers, not just rows

def _policies(spark):
    return S.policy_claims(spark, SF)


def test_importance_is_the_t_value(spark):
    """Against the covariance of the same model fitted on design cells."""
    from exposa.models import cells as CL
    from exposa.models import glm as M
    factors = ["geo_code", "building_type", "sprinkler_type"]
    levels = M.fit_poisson(_policies(spark), "claimcount_prop", factors).design.labels        # the same base levels
    cells = CL.build(_policies(spark), "claimcount_prop", factors, exposure="exposure", levels=levels)
    fit = CL.fit(cells, [CL.Spec("m", "poisson")])["m"]
    t = {n: abs(b) / math.sqrt(v) for n, b, v in zip(fit.names, fit.beta, fit.covariance().diagonal(), strict=True)}
    t.pop("(Intercept)")
    got = [(r.term, r.importance) for r in QUERIES["glm_importance"](spark, SF).collect()]
    want = sorted(t.items(), key=lambda kv: -kv[1])[:10]
    assert [v for _, v in got] == pytest.approx([v for _, v in want], rel=1e-3)
    assert {n for n, _ in got[:8]} <= {n for n, _ in want}


def test_saved_model_scores_the_same(spark):
    r = QUERIES["save_model"](spark, SF).first()
    claims = _policies(spark).agg(F.sum("claimcount_prop")).first()[0]
    assert r.reloaded_sum == pytest.approx(r.original_sum, rel=1e-12) == pytest.approx(claims, rel=1e-6)


def test_residual_diagnostics_recomputed(spark):
    from exposa.models import cells as CL
    cells = CL.build(_policies(spark), "grossincurred_prop", ["geo_code", "building_type"])
    fit = CL.fit(cells, [CL.Spec("m", "tweedie", power=1.5)])["m"]
    d = fit.predict(_policies(spark), "mu").select(F.col("grossincurred_prop").alias("y"), "mu").toPandas()
    y, mu = d["y"].to_numpy(), d["mu"].to_numpy()
    phi = ((y - mu) ** 2 / mu ** 1.5).sum() / (len(y) - len(fit.beta))
    got = sorted(QUERIES["residual_diagnostics"](spark, SF).collect(), key=lambda r: r.ventile)
    standard = np.quantile((y - mu) / np.sqrt(phi * mu ** 1.5), [(k + 0.5) / 20 for k in range(20)])
    assert [r.quantile for r in got] == pytest.approx(standard.tolist(), rel=1e-2, abs=1e-4)
    held = [r for r in got if r.n_rows]
    assert sum(r.n_rows for r in held) == len(y)
    assert sum(r.n_rows * r.mean_observed for r in held) == pytest.approx(y.sum())
    assert sum(r.n_rows * r.mean_fitted for r in held) == pytest.approx(mu.sum(), rel=1e-3)
    fitted = [r.mean_fitted for r in held]
    assert fitted == sorted(fitted) and [r.normal for r in got] == sorted(r.normal for r in got)


def test_curves_solve_the_penalised_equations(spark):
    """X'(y - mu) = D b for the frequency curve, its Gamma form for the severity, and the totals."""
    from exposa.plans import q_fits as QF
    for what, y, w in (("frequency", "n", None), ("severity", "severity", "n")):
        rows, smooth = QF._smooth(spark, SF, what)
        d = smooth.fit.predict(rows, "mu").toPandas()
        X = np.column_stack([np.ones(len(d)), *[d[c] for c in smooth.fit.cells.numeric]])
        pull = d[y] - d["mu"] if what == "frequency" else d[w] * (d[y] - d["mu"]) / d["mu"]
        size = np.abs(X).T @ np.abs(pull)
        assert smooth.fit.converged and (np.abs(X.T @ pull - np.array(smooth.fit.spec.penalty) * smooth.fit.beta) < 1e-4 * size).all()
        chosen = [r for r in QUERIES["curve_penalties"](spark, SF).collect() if r.curve == what and r.chosen]
        assert len(chosen) == 1 and 4 <= chosen[0].parameters <= X.shape[1] + 1e-6
    c = QUERIES["fit_curve"](spark, SF).toPandas()
    assert (c["fitted_freq"] * c["exposure"]).sum() == pytest.approx(c["n"].sum(), rel=1e-6)


def test_gcv_from_moments_matches_the_hat_matrix():
    from exposa.models import smooth as SP
    rng = np.random.default_rng(6)
    X = np.column_stack([np.ones(50), rng.normal(size=(50, 4))])
    w, z, shrink = rng.random(50) + 0.5, rng.normal(size=50), np.array([0, 0, 0, 1.0, 1.0])
    a, rhs, zz = X.T @ (w[:, None] * X), X.T @ (w * z), (w * z * z).sum()
    for penalty, used, score in SP.gcv(a, rhs, zz, 50, shrink, [1e-6, 0.3, 10.0, 1e6]):
        root = np.sqrt(w)[:, None] * X
        hat = root @ np.linalg.inv(a + penalty * np.diag(shrink)) @ root.T
        error = ((np.eye(50) - hat) @ (np.sqrt(w) * z)) ** 2
        assert used == pytest.approx(np.trace(hat)) and score == pytest.approx(50 * error.sum() / (50 - np.trace(hat)) ** 2)


def test_tariff_classes_hold_the_best_split(spark):
    c = QUERIES["fit_curve"](spark, SF).toPandas().sort_values("x")
    rows = sorted(QUERIES["tariff_classes"](spark, SF).collect(), key=lambda r: r.cls)
    assert sum(r.n for r in rows) == c["n"].sum() and sum(r.exposure for r in rows) == pytest.approx(c["exposure"].sum())
    assert all(a.x_max < b.x_min for a, b in zip(rows[:-1], rows[1:]))
    x, f, w = (c[k].to_numpy() for k in ("x", "fitted_freq", "exposure"))

    def loss(part):
        return (w[part] * (f[part] - np.average(f[part], weights=w[part])) ** 2).sum()
    best = min(range(2, len(x) - 1), key=lambda k: loss(np.arange(len(x)) < k) + loss(np.arange(len(x)) >= k))
    assert any(r.x_max == pytest.approx(x[best - 1]) for r in rows)


def test_smoothing_is_the_weighted_quadratic(spark):
    d = QUERIES["coef_smoothing"](spark, SF).toPandas()
    old, new, refit = (d[d["part"] == p] for p in ("class", "new class", "refit"))
    X = np.stack([np.ones(len(old)), old["mid"], old["mid"] ** 2], axis=1)
    root = np.sqrt(old["exposure"].to_numpy())
    b = np.linalg.lstsq(root[:, None] * X, root * np.log(old["rf"]), rcond=None)[0]
    assert np.allclose(np.exp(X @ b), old["rf_smooth"], rtol=1e-5)
    assert np.allclose(np.exp(b[0] + b[1] * new["mid"] + b[2] * new["mid"] ** 2), new["rf_smooth"], rtol=1e-5)
    assert new["exposure"].sum() == pytest.approx(old["exposure"].sum()) and (refit["rf"] > 0).all() and len(refit) > 1
