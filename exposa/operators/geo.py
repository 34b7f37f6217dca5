"""Geographic roll-ups: postcode -> SA3 -> SA4 (-> state).

Every roll-up starts with ONE partial aggregation of exposure to the
(state, sa4, sa3, postcode) grain - a table with one row per postcode in use
(thousands) however many claim rows there are.  The passes then run on that
small table with windows; "code is affected" is membership by VALUE (the
study tests `%in%` without the state), done as ``max(flag) over (code)``.
The 80-point threshold grid is looked up in breakpoints, the exposures at which
a postcode's code moves, so the whole grid is one job and no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GEO_KEYS = ["state", "sa4name", "sa3name", "riskpostcode"]
# Fixed values of the study.
ROLLUP3_DEFAULTS = {"riskpostcode": 50.0, "sa3name": 100.0, "sa4name": 200.0}
STATE_ONLY = ["ACT", "NT"]


def postcode_exposure(df: DataFrame, weight: str = "epy") -> DataFrame:
    return df.groupBy(*GEO_KEYS).agg(F.sum(weight).alias("_w"))


def _any_over(flag, *part):
    return F.max(flag.cast("int")).over(Window.partitionBy(*part)) == 1


def geo_rollup(df: DataFrame, threshold: float = 30.0, weight: str = "epy",
               sa4_factor: float = 4.0) -> DataFrame:
    """Two-level roll-up -> (state, riskpostcode, geo_code, origin).

    A postcode below ``threshold`` turns its WHOLE SA3 into one code; then a
    resulting code below ``sa4_factor * threshold`` turns its whole SA4.
    """
    pe = postcode_exposure(df, weight)
    # SA3 step: group has a small postcode -> all its postcodes are affected.
    pe = pe.withColumn("_sa3_hit", _any_over(F.col("_w") < threshold, "state", "sa4name", "sa3name"))
    pe = pe.withColumn("_to_sa3", _any_over(F.col("_sa3_hit"), "riskpostcode"))
    pe = pe.withColumn("postcode_encoding", F.when(F.col("_to_sa3"), F.col("sa3name"))
                       .otherwise(F.col("riskpostcode")))
    # SA4 step on the exposure of the new codes.
    enc_w = F.sum("_w").over(Window.partitionBy("state", "sa4name", "postcode_encoding"))
    pe = pe.withColumn("_enc_w", enc_w)
    pe = pe.withColumn("_sa4_hit", _any_over(F.col("_enc_w") < threshold * sa4_factor,
                                             "state", "sa4name"))
    pe = pe.withColumn("_to_sa4", _any_over(F.col("_sa4_hit"), "postcode_encoding"))
    pe = pe.withColumn("geo_code", F.when(F.col("_to_sa4"), F.col("sa4name"))
                       .otherwise(F.col("postcode_encoding")))
    origin = (F.when(F.col("geo_code") == F.col("riskpostcode"), "riskpostcode")
              .when(F.col("geo_code") == F.col("postcode_encoding"), "sa3name")
              .otherwise("sa4name"))
    return pe.select("state", "riskpostcode", "geo_code", origin.alias("origin")).distinct()


def _rollup3_passes(pe: DataFrame, thresholds: dict) -> DataFrame:
    """Three passes on a postcode-grain table with columns GEO_KEYS, _w."""
    pe = pe.withColumn("geo_code", F.col("riskpostcode"))
    scopes = [("riskpostcode", ["state", "sa4name", "sa3name"]),
              ("sa3name", ["state", "sa4name"]),
              ("sa4name", ["state"])]
    for scope, upper in scopes:
        t = thresholds[scope]
        code_w = F.sum("_w").over(Window.partitionBy(*upper, "geo_code"))
        pe = pe.withColumn("_cw", code_w).withColumn("_small", F.col("_cw") < t)
        if upper[-1] != "state":
            pe = pe.withColumn("_small", _any_over(F.col("_small"), *upper))
        hit = _any_over(F.col("_small"), "geo_code")
        pe = pe.withColumn("geo_code", F.when(hit, F.col(upper[-1])).otherwise(F.col("geo_code")))
    return pe.drop("_cw", "_small")


def geo_rollup3(df: DataFrame, t_postcode: float = 50.0, t_sa3: float = 100.0,
                t_sa4: float = 200.0, weight: str = "exposure",
                state_only: Sequence[str] = STATE_ONLY) -> DataFrame:
    """Three-level roll-up -> distinct (riskpostcode, geo_code).

    Postcode and SA3 steps move the whole parent area when one code is
    small; the SA4 step moves only the small codes to the state.  States in
    ``state_only`` always use the state.
    """
    pe = postcode_exposure(df, weight)
    th = {"riskpostcode": F.lit(float(t_postcode)), "sa3name": F.lit(float(t_sa3)),
          "sa4name": F.lit(float(t_sa4))}
    out = _rollup3_passes(pe, th)
    code = F.when(F.col("state").isin(list(state_only)), F.col("state")).otherwise(F.col("geo_code"))
    return out.select("riskpostcode", code.alias("geo_code")).distinct()


def threshold_grid(postcode_steps: Sequence[float] = (10, 20, 30, 40, 50),
                   sa3_mult: Sequence[float] = (1.5, 2, 3, 4),
                   sa4_mult: Sequence[float] = (2, 3, 4, 5)) -> list[tuple]:
    """Parameter grid: (grid_id, postcode, SA3 and SA4 threshold) triples."""
    return [(n, float(a), float(a * m3), float(a * m3 * m4)) for n, (a, m3, m4) in
            enumerate(((a, m3, m4) for a in postcode_steps for m3 in sa3_mult for m4 in sa4_mult), 1)]


def _grid_codes(pe: DataFrame, grid_rows: Sequence[tuple], state_only: Sequence[str]) -> DataFrame:
    """(grid_id, thresholds, GEO_KEYS, geo_code) of a postcode-grain table for every threshold triple.

    The code of a postcode is a step function of each threshold: it moves up just when the
    threshold is above the least exposure that would move it, its breakpoint.  Breakpoints of
    the first threshold need no grid at all, those of the second one copy of the table
    for each first threshold, those of the third one for each pair; the triples are looked up
    in these, so windows and exchanges do not depend on the grid, and rows on it only at the end.
    """
    nested: dict[float, dict[float, list]] = {}
    for g, a, b, c in grid_rows:
        nested.setdefault(a, {}).setdefault(b, []).append((g, c))
    steps = F.array(*[F.struct(F.lit(a).alias("t_riskpostcode"), F.array(*[
        F.struct(F.lit(b).alias("t_sa3name"), F.array(*[
            F.struct(F.lit(g).alias("grid_id"), F.lit(c).alias("t_sa4name")) for g, c in third]).alias("_t3"))
        for b, third in second.items()]).alias("_t2")) for a, second in nested.items()])

    def least(c, *by):
        return F.min(c).over(Window.partitionBy(*by))

    def total(*by):
        return F.sum("_w").over(Window.partitionBy(*by))

    one = ["t_riskpostcode"]
    two = [*one, "t_sa3name"]
    d = pe.withColumn("_m", least("_w", "state", "sa4name", "sa3name")).withColumn("_b", least("_m", "riskpostcode"))
    d = d.withColumn("_s", F.explode(steps)).select(*GEO_KEYS, "_w", "_b", "_s.*")
    d = d.withColumn("geo_code", F.when(F.col("_b") < F.col("t_riskpostcode"), F.col("sa3name"))
                     .otherwise(F.col("riskpostcode")))
    d = d.withColumn("_c", total(*one, "state", "sa4name", "geo_code")) \
        .withColumn("_m", least("_c", *one, "state", "sa4name")).withColumn("_b", least("_m", *one, "geo_code"))
    d = d.withColumn("_s", F.explode("_t2")).select(*GEO_KEYS, "_w", "_b", "geo_code", *one, "_s.*")
    d = d.withColumn("geo_code", F.when(F.col("_b") < F.col("t_sa3name"), F.col("sa4name")).otherwise(F.col("geo_code")))
    d = d.withColumn("_c", total(*two, "state", "geo_code")).withColumn("_b", least("_c", *two, "geo_code"))
    d = d.withColumn("_s", F.explode("_t3")).select(*GEO_KEYS, "_b", "geo_code", *two, "_s.*")
    code = F.when(F.col("_b") < F.col("t_sa4name"), F.col("state")).otherwise(F.col("geo_code"))
    code = F.when(F.col("state").isin(list(state_only)), F.col("state")).otherwise(code)
    return d.select("grid_id", *two, "t_sa4name", *GEO_KEYS, code.alias("geo_code"))


def geo_grid(df: DataFrame, grid_rows: Sequence[tuple], weight: str = "exposure",
             state_only: Sequence[str] = STATE_ONLY) -> DataFrame:
    """Number of geo codes for every threshold triple, one job.

    ``grid_rows``: (grid_id, t_postcode, t_sa3, t_sa4) - a parameter list of
    fixed size.  Keeps the first grid
    row (lowest id) per distinct number of codes.  Output: (grid_id,
    thresholds, n_geo_code).
    """
    triple = ["grid_id", "t_riskpostcode", "t_sa3name", "t_sa4name"]
    codes = _grid_codes(postcode_exposure(df, weight), grid_rows, state_only)
    counts = codes.groupBy(*triple).agg(F.count_distinct("geo_code").alias("n_geo_code"))
    return counts.groupBy("n_geo_code").agg(F.min(F.struct(*triple)).alias("_f")).select("n_geo_code", "_f.*")


def geo_grid_maps(df: DataFrame, grid_rows: Sequence[tuple], weight: str = "exposure",
                  state_only: Sequence[str] = STATE_ONLY) -> DataFrame:
    """(grid_id, state, riskpostcode, geo_code) for every threshold triple in one job."""
    codes = _grid_codes(postcode_exposure(df, weight), grid_rows, state_only)
    return codes.select("grid_id", "state", "riskpostcode", "geo_code").distinct()


def one_code(geo_map: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """One entry per postcode (the study looks codes up by postcode): a postcode
    that lies in two states, and so has two codes, gets the least one."""
    return geo_map.groupBy(*within, "riskpostcode").agg(F.min("geo_code").alias("geo_code"))


def attach_geo(df: DataFrame, geo_map: DataFrame, train_levels: DataFrame | None = None,
               fallback: str = "state") -> DataFrame:
    """Left join the (riskpostcode, geo_code) map, one code per postcode; a code missing from the map
    or unseen in training falls back to the ``fallback`` column."""
    m = one_code(geo_map).withColumnRenamed("geo_code", "_gc")
    out = df.join(m, "riskpostcode", "left")
    if train_levels is not None:
        seen = train_levels.select(F.col(train_levels.columns[0]).alias("_gc")).distinct() \
            .withColumn("_seen", F.lit(True))
        out = out.join(seen, "_gc", "left").withColumn(
            "_gc", F.when(F.col("_seen"), F.col("_gc"))).drop("_seen")
    return out.withColumn("geo_code", F.coalesce("_gc", fallback)).drop("_gc")


def pack_params(df: DataFrame, cols: Sequence[str], out: str = "geo_code_param") -> DataFrame:
    """Nest the threshold columns into one struct column."""
    rest = [c for c in df.columns if c not in cols]
    return df.select(*rest, F.struct(*cols).alias(out))
