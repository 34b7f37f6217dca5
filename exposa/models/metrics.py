"""Error metrics, model ranking, ROC AUC / sensitivity, interaction model,
cross-validated error and the premium report - all as Spark aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def error_metrics(df: DataFrame, actual: str, preds: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(model, mse, rmse, r2) per prediction column in ONE aggregation;
    r2 = 1 - rss / tss."""
    g = df.groupBy(*by) if by else df.groupBy()
    aggs = [F.avg(F.col(actual)).alias("_mean_y"), F.count(F.lit(1)).alias("n")]
    for p in preds:
        aggs.append(F.avg(F.pow(F.col(actual) - F.col(p), 2)).alias(f"mse|{p}"))
    one = g.agg(*aggs, F.var_pop(actual).alias("_var_y"))
    long = one.unpivot(list(by) + ["n", "_var_y"], [f"mse|{p}" for p in preds], "k", "mse")
    return long.select(*by, F.split("k", r"\|")[1].alias("model"), "n", "mse",
                       F.sqrt("mse").alias("rmse"),
                       (1 - F.col("mse") / F.nullif(F.col("_var_y"), F.lit(0.0))).alias("r2"))


def rank_models(df: DataFrame, actual: str, preds: Sequence[str]) -> DataFrame:
    """Wide predictions -> long (model, rmse) with the model name taken after
    the last '_', sorted; ``best`` marks the lowest RMSE."""
    m = error_metrics(df, actual, preds).select(
        F.regexp_extract("model", r"([^_]*)$", 1).alias("model"), "rmse")
    w = Window.orderBy("rmse", "model")   # one row per model: tiny
    return m.withColumn("best", F.row_number().over(w) == 1)


def prefix_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score: positives, negatives and negatives strictly below.

    The distinct-score table is range-partitioned on the score; a per-
    partition total gives each partition's offset, then a window inside the
    partition adds the local running sum - a distributed prefix sum with no
    single-partition window over all scores.
    """
    g = df.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("n_pos"),
                              F.count(F.lit(1)).alias("_n"))
    g = g.withColumn("n_neg", F.col("_n") - F.col("n_pos")).drop("_n")
    from exposa.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # checkpoint: both branches below must see the SAME range partitioning
    g = g.repartitionByRange(parts, score).withColumn(
        "_pid", F.spark_partition_id()).checkpoint(eager=True)
    tot = g.groupBy("_pid").agg(F.sum("n_neg").alias("_pneg"))
    off = tot.withColumn("_off", F.sum("_pneg").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).select(
        "_pid", F.coalesce("_off", F.lit(0)).alias("_off"))
    local = Window.partitionBy("_pid").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    g = g.join(off, "_pid").withColumn(
        "neg_below", F.col("_off") + F.coalesce(F.sum("n_neg").over(local), F.lit(0)))
    return g.drop("_pid", "_off")


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """AUC = P(score_pos > score_neg) + 1/2 P(equal) - the rank-sum formula
    with mid-ranks for ties; plus n_pos, n_neg."""
    pc = prefix_counts(df, score, label)
    one = pc.agg(F.sum(F.col("n_pos") * (F.col("neg_below") + 0.5 * F.col("n_neg"))).alias("_s"),
                 F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))
    return one.select((F.col("_s") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"),
                      "n_pos", "n_neg")


def sensitivity(df: DataFrame, score: str, label: str, cutoff: float = 0.5) -> DataFrame:
    """Share of positives predicted positive (score > cutoff)."""
    pos = F.col(label).cast("boolean")
    return df.agg((F.count(F.when(pos & (F.col(score) > cutoff), 1))
                   / F.nullif(F.count(F.when(pos, 1)), F.lit(0))).alias("sensitivity"))


def interaction_frame(df: DataFrame, pair: dict[str, str]) -> DataFrame:
    """Product columns of the freq-sev interaction model: bi_freq*prop_freq,
    bi_sev*prop_sev and the four-way product."""
    f1, f2, s1, s2 = (pair[k] for k in ("bi_freq", "prop_freq", "bi_sev", "prop_sev"))
    return df.withColumns({
        "freq_x": F.col(f1) * F.col(f2), "sev_x": F.col(s1) * F.col(s2),
        "all_x": F.col(f1) * F.col(f2) * F.col(s1) * F.col(s2)})


def premium_report(prop: DataFrame, loi: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Predicted / actual frequency, severity, pure premium and residuals
    (predicted minus actual) per line, joined on the keys (missing loss-of-income scores -> 0) with
    the total premium over lines."""
    def line(df, sfx):
        return df.select(*keys, *[F.col(c).alias(f"{c}_{sfx}") for c in
                                  ("pred_freq", "actual_freq", "pred_sev", "actual_sev")])
    j = line(prop, "prop").join(line(loi, "loi"), list(keys), "left")
    j = j.fillna(0.0, [f"{c}_loi" for c in ("pred_freq", "actual_freq", "pred_sev", "actual_sev")])
    for s in ("prop", "loi"):
        j = j.withColumns({
            f"pred_premium_{s}": F.col(f"pred_freq_{s}") * F.col(f"pred_sev_{s}"),
            f"actual_premium_{s}": F.col(f"actual_freq_{s}") * F.col(f"actual_sev_{s}")})
        j = j.withColumns({n: F.col(f"pred_{m}_{s}") - F.col(f"actual_{m}_{s}") for n, m in (
            (f"residual_{s}", "premium"), (f"freq_residual_{s}", "freq"), (f"sev_residual_{s}", "sev"))})
    return j.withColumns({
        "pred_premium_total": F.col("pred_premium_prop") + F.col("pred_premium_loi"),
        "actual_premium_total": F.col("actual_premium_prop") + F.col("actual_premium_loi")})


def poisson_draw(u):
    """Inverse-CDF Poisson(1) draw from a uniform column ``u``: number of k with
    CDF(k) < u.  At k = 19 the CDF is 1 in double precision, so no draw is cut."""
    import math
    cdf, terms = 0.0, []
    for k in range(20):
        cdf += math.exp(-1.0) / math.factorial(k)
        terms.append(F.when(u > F.lit(cdf), 1).otherwise(0))
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def hash_uniform(cols, seed) -> "Column":
    """Deterministic U(0,1) from md5(seed|cols) (first 13 hex digits)."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(16 ** 13)


def bootstrap_rmse(df: DataFrame, actual: str, pred: str, key, n: int = 20, seed: int = 123):
    """RMSE on n bootstrap resamples, Poisson(1) frequency weights per row
    and replicate (seeded hash): one explode + one aggregation."""
    r = df.select(actual, pred, *key, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("replicate"))
    w = poisson_draw(hash_uniform(list(key) + ["replicate"], seed))
    r = r.withColumn("_w", w)
    return r.groupBy("replicate").agg(
        F.sqrt(F.sum(F.col("_w") * F.pow(F.col(actual) - F.col(pred), 2)) / F.sum("_w")).alias("rmse"),
        F.sum("_w").alias("n_resampled"))


def poisson_pit(df: DataFrame, y: str, mu: str, key, seed: int = 7) -> DataFrame:
    """Randomised quantile residual u = F(y-1) + V f(y) of a Poisson fit
    (uniform if the model is right); the CDF is an exact finite sum, made in one
    pass over 1..y by f(k) = f(k - 1) * mu / k."""
    yy = F.col(y).cast("int")
    start = F.struct(F.lit(0.0).alias("below"), F.exp(-F.col(mu)).alias("f"))
    steps = F.when(yy > 0, F.sequence(F.lit(1), yy)).otherwise(F.array().cast("array<int>"))
    run = F.aggregate(steps, start, lambda a, k: F.struct(
        (a["below"] + a["f"]).alias("below"), (a["f"] * F.col(mu) / k.cast("double")).alias("f")))
    v = hash_uniform(key, seed)
    return df.withColumn("_run", run).withColumn(
        "pit", F.col("_run.below") + v * F.col("_run.f")).drop("_run")


def qq_uniform(df: DataFrame, col: str, n_q: int = 20) -> DataFrame:
    """Empirical quantiles of ``col`` against uniform ones (bounded sketch)."""
    probs = [(i + 0.5) / n_q for i in range(n_q)]
    q = df.agg(F.percentile_approx(col, probs, 10000).alias("q")).select(
        F.posexplode("q").alias("i", "empirical"))
    return q.withColumn("theoretical", (F.col("i") + 0.5) / n_q)
