"""Rules checked by hand-made rows, and numbers against numpy."""

import math
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from exposa.models import glm as M
from exposa.models import interaction as IA
from exposa.models import metrics as MT
from exposa.models import negbin as NB
from exposa.models import trees as TR
from exposa.operators import consolidate as C
from exposa.operators import gates as Q
from exposa.operators import geo as G
from exposa.operators import sampling as SM
from exposa.operators.quantiles import exact_quantiles


def test_second_path_null_rules(spark):
    df = spark.createDataFrame([(True, None, None, "12 mths"), (True, 5.0, 1.0, None), (False, None, 2.0, None),
                                (False, 7.0, None, "24 mths")],
                               "LossofIncome_cover boolean, suminsured_lossofinc double, grossincurred_lossofinc double, "
                               "indem_per_grp string")
    got = [tuple(r) for r in C.lossofinc_nulls(df, "second").collect()]
    assert got == [(True, 0.0, 0.0, "12 mths"), (True, 5.0, 1.0, None), (False, None, 2.0, "LoI_NULL"),
                   (False, 7.0, None, "LoI_NULL")]


def test_one_code_for_a_postcode_in_two_states(spark):
    m = spark.createDataFrame([("000001", "B"), ("000001", "A"), ("000002", "C")], "riskpostcode string, geo_code string")
    p = spark.createDataFrame([(1, "000001", "X"), (2, "000002", "Y"), (3, "000009", "Z")],
                              "id int, riskpostcode string, state string")
    got = {r.id: r.geo_code for r in G.attach_geo(p, m).collect()}
    assert got == {1: "A", 2: "C", 3: "Z"} and G.attach_geo(p, m).count() == 3


def test_premium_report_units_and_signs(spark):
    cols = "k int, pred_freq double, actual_freq double, pred_sev double, actual_sev double"
    prop = spark.createDataFrame([(1, 0.2, 0.5, 100.0, 300.0), (2, 0.1, 0.0, 50.0, 0.0)], cols)
    loi = spark.createDataFrame([(1, 0.1, 0.0, 10.0, 0.0)], cols)
    r = {x.k: x for x in MT.premium_report(prop, loi, ["k"]).collect()}
    assert r[1].residual_prop == pytest.approx(20.0 - 150.0)
    assert (r[1].freq_residual_prop, r[1].sev_residual_prop) == (pytest.approx(-0.3), -200.0)
    assert r[1].residual_loi == pytest.approx(1.0) and r[2].residual_loi == 0.0
    assert r[2].pred_premium_total == pytest.approx(5.0)


def test_premium_frame_is_a_rate(spark):
    from exposa.plans.q_models import _premium_frame
    f = _premium_frame(spark, "/root/testdata/sf0.001")
    means = f.groupBy("geo_code").agg(F.max("pred_freq_prop").alias("r"), F.min("pred_freq_prop").alias("s"),
                                      (F.sum("claimcount_prop") / F.sum("exposure")).alias("want")).collect()
    assert all(m.r == pytest.approx(m.s) == pytest.approx(m.want) for m in means)


def test_thresholds_do_not_follow_the_folder_name(spark, tmp_path):
    from exposa.plans.catalog import QUERIES
    folder = tmp_path / "claims_sf9"
    shutil.copytree("/root/testdata/sf0.001", folder)
    for name in ("geo_rollup", "lump_min_occupation", "geo_grid"):
        a, b = (sorted(map(str, QUERIES[name](spark, str(d)).collect())) for d in ("/root/testdata/sf0.001", folder))
        assert a == b


@pytest.mark.parametrize("parts,most", [(1, 20_000), (3, 20_000), (1, 2), (3, 100), (16, 100)])
def test_exact_quantiles(spark, parts, most):
    """One huge and many tiny groups; groups above ``most`` rows take the split path."""
    rng = np.random.default_rng(parts)
    rows = [("hot", float(v)) for v in rng.integers(0, 90, 3000)] + [("b", 1.0), (None, 4.0), (None, 8.0), ("c", None)] \
        + [(f"t{k}", float(v)) for k in range(200) for v in rng.integers(0, 9, 3)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.25, 0.333, 0.5, 0.9, 1.0]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.g: r.quantiles for r in exact_quantiles(df, ["g"], "x", probs, most=most).collect()}
        counted = df.groupBy("g", "x").count()
        weighed = {r.g: r.quantiles for r in exact_quantiles(counted, ["g"], "x", probs, count="count", most=most).collect()}
        whole = exact_quantiles(df, [], "x", probs, most=most).first()["quantiles"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert set(got) == {"hot", "b", None} | {f"t{k}" for k in range(200)} and weighed == got
    for g in got:
        want = np.quantile([x for h, x in rows if h == g], probs)
        assert np.allclose(got[g], want)
    assert np.allclose(whole, np.quantile([x for _, x in rows if x is not None], probs))
    assert exact_quantiles(df.filter("false"), ["g"], "x", probs).collect() == []


def test_quantile_plans_have_no_unbounded_buffer(spark):
    from exposa.plans.catalog import QUERIES
    for name in ("box_stats_occupation", "median_by_claims", "density_claim_type", "level_order_median"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "percentile(" not in plan and "median(" not in plan


def test_poisson_pit(spark):
    df = spark.createDataFrame([(0, 0.7, "a"), (3, 2.5, "b"), (12, 9.0, "c")], "y int, mu double, k string")
    for r in MT.poisson_pit(df, "y", "mu", ["k"]).collect():
        pmf = [math.exp(-r.mu) * r.mu ** j / math.factorial(j) for j in range(r.y + 1)]
        assert sum(pmf[:-1]) <= r.pit + 1e-12 and r.pit <= sum(pmf) + 1e-12


def test_gates_raise(spark):
    ok = spark.createDataFrame([(True, 1, 2), (False, None, 3)], "LossofIncome_cover boolean, a int, b int")
    Q.assert_covered(ok, ["a"])
    Q.assert_no_nulls(ok, ["b"])
    for bad in (lambda: Q.assert_covered(ok, []), lambda: Q.assert_no_nulls(ok),
                lambda: Q.assert_covered(ok.withColumn("a", F.lit(None).cast("int")), ["a"]),
                lambda: Q.raise_if_bad(Q.join_loss_audit(
                    spark.createDataFrame([("1",), ("2",)], "riskpostcode string"),
                    spark.createDataFrame([("1",)], "riskpostcode string"),
                    spark.createDataFrame([("1",), ("2",)], "postcode string")), "join")):
        with pytest.raises(AssertionError):
            bad()


def test_a_stage_that_fails_its_gate_is_not_used(spark):
    from exposa.plans import stages as S
    bad = spark.createDataFrame([(None,), (1,)], "x int")
    for _ in range(2):
        with pytest.raises(AssertionError):
            S.stage(spark, "/nowhere", "gated", lambda: bad, Q.assert_no_nulls)
    assert S.stage(spark, "/nowhere", "gated", lambda: bad.dropna(), Q.assert_no_nulls).count() == 1


def test_rules_are_observed_on_the_write(spark):
    """The stage is computed once, rules see the rows before ``keep``, and a failing stage is not used."""
    from exposa.plans import stages as S
    seen = spark.sparkContext.accumulator(0)

    def build(null):
        def touch(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b
        rows = spark.createDataFrame([(1, "a"), (2, None if null else "b"), (3, "c")], "k int, v string")
        return rows.mapInArrow(touch, rows.schema)
    rules = lambda df: Q.null_rules(df, ["v"])
    with pytest.raises(AssertionError, match="'v': 1"):
        S.stage(spark, "/nowhere", "observed", lambda: build(True), rules=rules, keep=lambda df: df.filter("k <> 2"))
    assert seen.value == 3
    got = S.stage(spark, "/nowhere", "observed", lambda: build(False), rules=rules, keep=lambda df: df.filter("k <> 2"))
    assert sorted(r.k for r in got.collect()) == [1, 3] and seen.value == 6
    empty = S.stage(spark, "/nowhere", "observed_empty", lambda: build(False).filter("false"), rules=rules)
    assert empty.count() == 0


def test_counted_rules_raise():
    assert Q.raise_if_counted({"lost": 0, "other": None}) is None
    with pytest.raises(AssertionError):
        Q.raise_if_counted({"lost": 2})


def test_drop_constant(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "c string, n int, d string")
    kept, gone = Q.drop_constant(df, ["c", "d"])
    assert gone == ["c"] and kept.columns == ["n", "d"]


def test_trees_take_more_than_256_levels(spark):
    df = spark.range(1200).selectExpr("concat('g', id % 300) AS f", "cast(id % 300 > 150 as double) AS y", "id AS k")
    got = TR.tune(df, df, {"y": TR.Target("y", ())}, ["f"], TR.tree_candidates(depths=(2,)), ["k"], folds=2)
    assert TR.tree_importance(spark, got).first()["importance"] == pytest.approx(1.0)
    assert TR.indexer(df, ["f"])[1] == 301


def test_interaction_models_against_numpy(spark):
    rng = np.random.default_rng(3)
    n = 400
    f = {c: rng.random(n) + 0.1 for c in ("freq_lossofinc_pois", "freq_lossofinc_nb", "freq_prop_pois", "freq_prop_nb")}
    f |= {"sev_lossofinc": 100 * rng.random(n), "sev_prop": 100 * rng.random(n), "total": 1e3 * rng.random(n)}
    df = spark.createDataFrame([(i, i % 10 + 1, *[float(f[c][i]) for c in f]) for i in range(n)],
                               "id int, fold int, " + ", ".join(f"{c} double" for c in f))
    pairs = {"pois_nb": ("freq_lossofinc_pois", "freq_prop_nb"), "nb_pois": ("freq_lossofinc_nb", "freq_prop_pois")}
    sums = IA.moments(df, pairs, "fold")
    for name, (bi, prop) in pairs.items():
        bf, pf, bs, ps = f[bi], f[prop], f["sev_lossofinc"], f["sev_prop"]
        x = np.stack([np.ones(n), bf * pf, bs * ps, bf * pf * bs * ps], axis=1)
        y = f["total"] - bf * bs - pf * ps
        fit = lambda k: np.linalg.lstsq(x[k], y[k], rcond=None)[0]
        full = fit(np.ones(n, bool))
        assert np.allclose(IA.solve(sum(sums[name].values())), full, rtol=1e-6)
        fold = np.arange(n) % 10 + 1
        cv = adj = 0.0
        for k in range(1, 11):
            b, share = fit(fold != k), (fold == k).mean()
            cv += share * ((y - x @ b)[fold == k] ** 2).mean()
            adj += share * ((y - x @ b) ** 2).mean()
        got = IA.cross_validated(sums[name])
        error = ((y - x @ full) ** 2).mean()
        assert got["mse"] == pytest.approx(cv) and got["mse_adjusted"] == pytest.approx(cv + error - adj)
        assert got["r2"] == pytest.approx(1 - error / y.var())


def test_ensemble_counts_uncovered_rows(spark):
    from exposa.plans import q_fits
    sf = "/root/testdata/sf0.001"
    scored = q_fits._scored_test(spark, sf)
    assert scored.filter("NOT LossofIncome_cover").count() > 0
    assert scored.filter("NOT LossofIncome_cover AND (freq_lossofinc_nb <> 0 OR sev_lossofinc <> 0)").count() == 0
    rows = {r.model: r.n for r in q_fits.ensemble_error(spark, sf).collect()}
    halves = SM.stratified_split(scored, 0.5, ["LossofIncome_cover"], q_fits._KEY, 321)
    assert set(rows.values()) == {halves.filter("split = 'test' OR NOT LossofIncome_cover").count()}
    chosen = q_fits.interaction_model(spark, sf).collect()
    assert len({r.pair for r in chosen}) == 4 and len({r.pair for r in chosen if r.chosen}) == 1


def test_burning_model_fits_the_predicted_premium(spark):
    from exposa.plans import q_fits
    rows = q_fits.burning_model(spark, "/root/testdata/sf0.001").collect()
    base = [r for r in rows if r.rf_burning == 1.0]
    assert len({r.factor for r in rows}) == 2 and len(base) >= 2
    assert all(r.rf_burning > 0 and r.exposure > 0 for r in rows)


def test_gamma_and_tweedie_levels_are_weighted_means(spark):
    rng = np.random.default_rng(8)
    rows = [("abc"[i % 3], float(rng.gamma(2, 50)), float(1 + i % 4)) for i in range(300)]
    df = spark.createDataFrame(rows, "f string, y double, w double")
    for fit in (M.fit_gamma(df, "y", ["f"], weight="w"), M.fit_tweedie(df, "y", ["f"], power=1.4, weight="w")):
        c, levels = fit.coefficients, fit.design.labels["f"]
        for i, lv in enumerate(levels):
            mean = np.average([y for f, y, _ in rows if f == lv], weights=[w for f, _, w in rows if f == lv])
            assert math.exp(c["(Intercept)"] + (c[f"f_{lv}"] if i else 0.0)) == pytest.approx(mean, rel=1e-5)


def test_negbin_reports_convergence(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(v), float(rng.poisson(rng.gamma(2.0, v))), 1.0) for v in rng.random(800) + 0.5],
                               "x double, y double, exposure double")
    assert NB.fit_negbin(df, "y", [], numeric=["x"]).converged
    assert not NB.fit_negbin(df, "y", [], numeric=["x"], max_iter=1).converged


def test_shared_folder_is_required_on_a_cluster():
    from types import SimpleNamespace

    from exposa import session
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError):
        session.checkpoint_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=sc))


def test_grid_by_breakpoints_equals_each_roll_up(spark):
    """Shared names across states and areas, thresholds equal to exposures; against one roll-up a triple."""
    from exposa.operators import geo as G
    rng = np.random.default_rng(12)
    rows = []
    for k in range(160):
        state = ["N", "S", "ACT"][k % 3]
        rows.append((state, f"A{k % 5}", f"B{k % 13}", f"{k % 120:03d}", float(rng.integers(1, 30))))
    df = spark.createDataFrame(rows, "state string, sa4name string, sa3name string, riskpostcode string, exposure double")
    grid = G.threshold_grid((3, 9, 20), (1.5, 3), (2, 4))
    got = {g: set() for g, *_ in grid}
    for r in G.geo_grid_maps(df, grid).collect():
        got[r.grid_id].add((r.riskpostcode, r.geo_code))
    counts = {}
    for g, a, b, c in grid:
        want = {(r.riskpostcode, r.geo_code) for r in G.geo_rollup3(df, a, b, c).collect()}
        assert got[g] == want, (a, b, c)
        counts.setdefault(len({code for _, code in want}), (g, a, b, c))
    first = {r.n_geo_code: (r.grid_id, r.t_riskpostcode, r.t_sa3name, r.t_sa4name) for r in G.geo_grid(df, grid).collect()}
    assert first == counts and len(counts) > 2
    many = G.threshold_grid(range(1, 40), (1.5, 2, 3, 4), (2, 3, 4, 5))
    plans = [G.geo_grid_maps(df, g)._jdf.queryExecution().executedPlan().toString() for g in (grid, many)]
    assert len({p.count("Exchange hashpartitioning") for p in plans}) == len({p.count("Window [") for p in plans}) == 1
