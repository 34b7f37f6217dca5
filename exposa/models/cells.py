"""Generalised linear models on distinct design cells, many models in one pass.

``build`` reduces the rows to distinct (levels, numeric regressors, offset, response) cells
with their prior weight and row count, coded before the one exchange that meets equal cells.  That is all a GLM needs of the rows, whatever its
family, so every later pass reads the cells only, and the number of passes over the rows does not
depend on models or iterations.

``fit`` advances all models together: one IRLS step of all of them is one pass.  A task adds up
X'WX and X'Wz of every model block by block (a pair of factors is one table of keyed sums, as each
row has one level of each), the blocks are summed by model, and only the small systems reach
the driver.  Models may differ in family, variance power, prior weight and in the encoding of
one key column (such as a postcode) to levels, so a grid of encodings shares its cells.

Families: poisson, negbin (theta by maximum likelihood, advanced in the same passes), gamma,
tweedie (log links) and binomial (logit).  A step that lowers the likelihood is halved.  Levels
unknown to the fitted rows, and null levels, count as the base level; rows with a null response,
numeric regressor or weight, or an exposure that is not positive, are left out.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposa.models.tweedie import lgamma_np, log_scale
from exposa.session import TASK_ROWS, checkpoint_dir

FAMILIES = ("poisson", "negbin", "gamma", "tweedie", "binomial")
EXTRAS = ("objective", "pearson", "weight", "rows", "score", "info", "spread", "excess", "zz")
POISSON_LIMIT = 1e7              # theta beyond which no over-dispersion is left to fit
SUM_PARTS = 64                   # vectors of one model that a task adds up in the first step
MAP_LEVELS = 8                   # levels of a factor up to which its coefficients are a literal map
PASS_ROWS = 2 * TASK_ROWS        # rows of a task of a pass, at the least: each sends a vector a model


@dataclass(frozen=True)
class Spec:
    name: str
    family: str
    power: float = 1.5               # of the variance (tweedie)
    weight: str = "w"                # prior weights: w (the weight column) or n (rows)
    encoding: str | None = None      # name of the encoding whose levels are a factor
    penalty: tuple[float, ...] | None = None      # of the squared coefficients, in the order of their names


@dataclass
class Encoding:
    levels: list[str]                # the base first
    lookup: np.ndarray               # code of every key


@dataclass
class Cells:
    table: DataFrame                 # f0.., x0.., key, part, off, y, w, n
    factors: list[str]
    levels: dict[str, list[str]]     # the base first
    numeric: list[str]
    fit_part: str | None
    exposure: str | None
    parts: int                       # partitions of the table
    encodings: dict[str, Encoding] = field(default_factory=dict)
    tasks: int = 0                   # of a pass
    _held: DataFrame | None = field(default=None, repr=False)
    _users: int = field(default=0, repr=False)

    @contextmanager
    def held(self):
        """The cells as Arrow batches of one part each, a row a batch, kept by the executors while any
        caller is inside, so that a pass hands whole batches to Python instead of rows."""
        if self._held is None:
            few = self.table.coalesce(self.tasks) if self.tasks else self.table
            self._held = few.mapInArrow(_packed, "part string, cells binary").persist(StorageLevel.MEMORY_AND_DISK)
        self._users += 1
        try:
            yield self._held
        finally:
            self._users -= 1
            if not self._users:
                self._held.unpersist()
                self._held = None

    def rows(self, part: str | None) -> DataFrame:
        return self.table if part is None else self.table.filter(F.col("part") == part)

    def names(self, spec: Spec) -> list[str]:
        out = ["(Intercept)", *self.numeric]
        for f in self.factors:
            out += [f"{f}_{v}" for v in self.levels[f][1:]]
        if spec.encoding is not None:
            out += [f"geo_code_{v}" for v in self.encodings[spec.encoding].levels[1:]]
        return out

    def sizes(self, spec: Spec) -> list[int]:
        """Levels of each factor, base included."""
        out = [len(self.levels[f]) for f in self.factors]
        return out + ([len(self.encodings[spec.encoding].levels)] if spec.encoding is not None else [])


@dataclass
class Fit:
    spec: Spec
    names: list[str]
    beta: np.ndarray
    cells: Cells
    theta: float = math.inf
    objective: float = math.nan      # log-likelihood (poisson, negbin, binomial), else the quasi one
    pearson: float = math.nan
    weight: float = 0.0
    rows: int = 0
    iterations: int = 0
    converged: bool = False
    information: np.ndarray | None = None
    rhs: np.ndarray | None = None    # X'Wz at the coefficients that ``information`` (X'WX) belongs to
    zz: float = 0.0                  # z'Wz
    spread: float = 0.0              # weighted sum of (y / mu - 1)**2 (poisson)
    excess: float = 0.0              # weighted sum of (y - mu)**2 - y (poisson): over-dispersion if positive

    @property
    def coefficients(self) -> dict[str, float]:
        return dict(zip(self.names, map(float, self.beta), strict=True))

    @property
    def rank(self) -> int:
        return int(np.linalg.matrix_rank(_unit(self.information)[0]))

    @property
    def dispersion(self) -> float:
        """Pearson estimate; 1 for the families that fix it."""
        if self.spec.family in ("poisson", "negbin", "binomial"):
            return 1.0
        return self.pearson / max(self.rows - self.rank, 1)

    def covariance(self) -> np.ndarray:
        a, s = _unit(self.information)
        return self.dispersion * np.linalg.pinv(a, rcond=1e-11, hermitian=True) * np.outer(s, s)

    def linear(self, levels: Mapping[str, Column] | None = None, sent: Mapping[str, Column] | None = None) -> Column:
        """The linear predictor as a column (offset included); for models without an encoding.
        sent: coefficients of factors (null for the base) that the rows already have."""
        eta, at = F.lit(float(self.beta[0])), 1
        for x in self.cells.numeric:
            eta, at = eta + F.lit(float(self.beta[at])) * F.col(x), at + 1
        for f in self.cells.factors:
            own = self.cells.levels[f][1:]
            if sent and f in sent:
                eta, at = eta + F.coalesce(sent[f], F.lit(0.0)), at + len(own)
                continue
            pairs = [F.lit(v) for k, lv in enumerate(own) for v in (lv, float(self.beta[at + k]))]
            value = (levels or {}).get(f, F.col(f)).cast("string")
            eta, at = eta + F.coalesce(F.create_map(*pairs)[value], F.lit(0.0)), at + len(own)
        return eta + F.log(F.col(self.cells.exposure)) if self.cells.exposure else eta

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` with the fitted mean.  Coefficients of a factor with many levels are sent to the rows and
        looked up by hash: a literal map is searched from its start for every row."""
        columns, sent, at = df.columns, {}, 1 + len(self.cells.numeric)
        for i, f in enumerate(self.cells.factors):
            own = self.cells.levels[f][1:]
            if len(own) > MAP_LEVELS:
                table = df.sparkSession.createDataFrame([(v, float(self.beta[at + k])) for k, v in enumerate(own)],
                                                        f"_v{i} string, _b{i} double")
                df = df.join(F.broadcast(table), F.col(f).cast("string") == F.col(f"_v{i}"), "left")
                sent[f] = F.col(f"_b{i}")
            at += len(own)
        eta = self.linear(sent=sent)
        return df.withColumn(out, 1 / (1 + F.exp(-eta)) if self.spec.family == "binomial" else F.exp(eta)) \
            .select(*[c for c in columns if c != out], out)


def build(df: DataFrame, response: str, factors: Sequence[str], numeric: Sequence[str] = (),
          exposure: str | None = None, weight: str | None = None, part: str | None = None,
          fit_part: str | None = None, key: Sequence[str] = (),
          encodings: Mapping[str, Mapping[str, str]] | None = None,
          levels: Mapping[str, Sequence[str]] | None = None, base: Column | None = None) -> Cells:
    """Cells of ``df``; levels are those of the rows of ``fit_part`` (of column ``part``).

    exposure: its logarithm is the offset.  base: what makes a level the base by its sum (rows).
    levels: level lists, base first, instead of the counted ones.
    key, encodings: a key (value, fallback value) and, by name, the level of every value; levels
    that no fitted row has become the fallback value, and the base where that has none either.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    factors, numeric = list(factors), list(numeric)
    by = [F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(factors)]
    by += [F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(numeric)]
    by += [F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("key"),
           F.col(part).alias("part") if part else F.lit(None).cast("string").alias("part"),
           (F.log(F.col(exposure)) if exposure else F.lit(0.0)).alias("off"),
           F.col(response).cast("double").alias("y")]
    rows = df.select(*by, (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
                     (base if base is not None else F.lit(1.0)).cast("double").alias("b")) \
        .dropna(subset=[f"x{i}" for i in range(len(numeric))] + ["off", "y", "w"])
    own = F.lit(True) if fit_part is None else F.coalesce(F.col("part") == fit_part, F.lit(False))

    # levels, keys and the number of rows: one aggregation
    level = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"f{i}").alias("v")) for i in range(len(factors))],
                              F.struct(F.lit(-1).alias("i"), F.col("key").alias("v"))))
    found: dict[int, list] = {i: [] for i in range(-1, len(factors))}
    keys, total = [], 0
    for r in rows.select(level.alias("l"), "b", own.alias("own")).groupBy("l").agg(
            F.sum(F.when(F.col("own"), F.col("b"))).alias("b"), F.count_if("own").alias("own"),
            F.count(F.lit(1)).alias("n")).collect():
        if r["l"]["i"] == -1:
            total += r["n"]
            keys.append(r["l"]["v"])
        if r["l"]["v"] is not None and r["own"]:
            found[r["l"]["i"]].append((-(r["b"] or 0.0), r["l"]["v"]))
    known = {}
    for i, f in enumerate(factors):
        if levels and f in levels:
            known[f] = list(levels[f])
        else:
            ranked = [v for _, v in sorted(found[i])]
            known[f] = ranked[:1] + sorted(ranked[1:])
    used = [f for f in factors if len(known[f]) > 1]
    keys = sorted(keys) if key else []
    trained = {v: -b for b, v in found[-1]}
    made = {name: _encoding(keys, trained, m) for name, m in (encodings or {}).items()} if key else {}

    lists = [(f"f{factors.index(f)}", f"f{k}", known[f][1:]) for k, f in enumerate(used)]
    cell = [b for _, b, _ in lists] + [f"x{i}" for i in range(len(numeric))] + ["part", "off", "y", "key"]
    plain = [c for c in cell if c[0] != "f" and c != "key"]

    def code(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        sets = [(a, b, pa.array(v, pa.string())) for a, b, v in lists]
        places = pa.array(keys, pa.string())
        for batch in batches:
            def coded(name, values, plus):
                at = pc.fill_null(pc.index_in(batch.column(name).cast(pa.string()), value_set=values), -plus)
                return pc.add(at, plus).cast(pa.int32())
            arrays = {b: coded(a, v, 1) for a, b, v in sets}
            arrays |= {x: batch.column(x) for x in [*plain, "w"]} | {"key": coded("key", places, 0)}
            sums = pa.table(arrays).group_by(cell, use_threads=False).aggregate([("w", "sum"), ("w", "count")])
            names = {"w_sum": "w", "w_count": "n"}
            yield from sums.rename_columns([names.get(c, c) for c in sums.column_names]).select(
                [*cell, "w", "n"]).combine_chunks().to_batches()

    types = {b: "int" for _, b, _ in lists} | {"part": "string", "key": "int"}
    schema = ", ".join([f"{c} {types.get(c, 'double')}" for c in cell] + ["w double", "n bigint"])
    # one exchange, of coded rows already added up by batch, in partitions that a task can group in memory
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    spread = max(parts, -(-total // TASK_ROWS))
    table = rows.drop("b").mapInArrow(code, schema).repartition(spread, *cell).groupBy(*cell).agg(
        F.sum("w").alias("w"), F.sum("n").alias("n")).checkpoint()
    if spread > parts:
        table = table.coalesce(parts)                # a pass sends a vector a task and model
    tasks = min(parts, max(_parallelism(spark), -(-total // PASS_ROWS)))
    return Cells(table, used, {f: known[f] for f in used}, numeric, fit_part, exposure, parts, made, tasks)


def _parallelism(spark) -> int:
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - Connect
        return 1


def _packed(batches):
    """Batches of cells, each of one part, in Arrow's stream format."""
    import pyarrow as pa
    import pyarrow.compute as pc
    for batch in batches:
        of, rest = batch.column("part"), batch.drop_columns(["part"])
        for part in pc.unique(of).to_pylist():
            own = rest.filter(pc.is_null(of) if part is None else pc.equal(of, part))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema) as out:
                out.write_batch(own)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.string()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                             names=["part", "cells"])


def _encoding(keys: list[str], trained: Mapping[str, float], levels: Mapping[str, str]) -> Encoding:
    """Codes of ``value|fallback`` keys under a map of values to levels."""
    of = {k: levels.get(k.split("|")[0]) for k in keys}
    weight: dict[str, float] = {}
    for k, b in trained.items():
        if of[k] is not None:
            weight[of[k]] = weight.get(of[k], 0.0) + b
    ranked = sorted(weight, key=lambda v: (-weight[v], v))
    order = ranked[:1] + sorted(ranked[1:])
    at = {v: i for i, v in enumerate(order)}
    return Encoding(order or [""], np.array([at.get(of[k], at.get(k.split("|")[-1], 0)) for k in keys], np.int64))


# ---- one pass over the cells

class _Batch:
    """Numpy columns of a batch, and the linear predictor of a model on them."""

    def __init__(self, batch, n_factors: int, n_numeric: int):
        get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        self.codes = [get(f"f{i}").astype(np.int64) for i in range(n_factors)]
        self.key = get("key").astype(np.int64)
        self.off, self.y, self.w, self.n = get("off"), get("y"), get("w"), get("n").astype(float)
        self.dense = [np.ones(batch.num_rows), *[get(f"x{i}") for i in range(n_numeric)]]

        self._pairs: dict = {}

    def pair(self, i: int, j: int, size: int) -> np.ndarray:
        """Codes of a pair of factors, the same for all models of the batch."""
        if (i, j, size) not in self._pairs:
            self._pairs[i, j, size] = self.codes[i] * size + self.codes[j]
        return self._pairs[i, j, size]

    def levels(self, lookup) -> list[np.ndarray]:
        return self.codes if lookup is None else [*self.codes, lookup[self.key]]

    def eta(self, beta: np.ndarray, sizes: Sequence[int], codes) -> np.ndarray:
        at = len(self.dense)
        out = sum(b * x for b, x in zip(beta[:at], self.dense, strict=True))
        for size, code in zip(sizes, codes, strict=True):
            out = out + np.concatenate(([0.0], beta[at:at + size - 1]))[code]
            at += size - 1
        return out


def _count_tables(y: np.ndarray, theta: float):
    """Sums over k < y of 1 / (theta + k), -1 / (theta + k)**2, log(theta + k) and log(k + 1)."""
    k = np.arange(int(y.max(initial=0)) + 1, dtype=float)
    at = y.astype(np.int64)
    parts = (1 / (theta + k), -1 / (theta + k) ** 2, np.log(theta + k), np.log(k + 1))
    return [np.concatenate(([0.0], np.cumsum(p)))[at] for p in parts]


def _working(family: str, power: float, theta: float, y, off, eta, w, start: bool):
    """(W, z, extras) of an IRLS step: weights, working response without the offset, sums."""
    if start and family == "binomial":
        mu = (y + 0.5) / 2
        eta = np.log(mu / (1 - mu)) - off
    elif start:
        eta = np.log(np.where(y > 0, y, 0.0) + 0.1 * ((y <= 0) | (family in ("poisson", "negbin")))) - off
    extras = dict.fromkeys(EXTRAS, 0.0)
    if family == "binomial":
        mu = np.clip(1 / (1 + np.exp(-np.clip(eta + off, -36, 36))), 1e-15, 1 - 1e-15)
        v = mu * (1 - mu)
        extras["objective"] = w @ (y * np.log(mu) + (1 - y) * np.log1p(-mu))
        extras["pearson"] = w @ ((y - mu) ** 2 / v)
        return w * v, eta + (y - mu) / v, extras
    score = np.clip(eta + off, -80, 80)
    mu = np.exp(score)
    z = eta + (y - mu) / mu
    if family == "poisson":
        weight, variance = w * mu, mu
        extras["objective"] = w @ (y * np.log(mu) - mu - lgamma_np(y + 1))
        extras["spread"] = w @ ((y / mu - 1) ** 2)
        extras["excess"] = w @ ((y - mu) ** 2 - y)
    elif family == "negbin":
        weight, variance = w * mu / (1 + mu / theta), mu + mu ** 2 / theta
        inverse, minus_square, logs, logs1 = _count_tables(y, theta)
        extras["objective"] = w @ (logs - logs1 + theta * np.log(theta / (theta + mu)) + y * np.log(mu / (theta + mu)))
        extras["score"] = w @ (inverse + np.log(theta / (theta + mu)) + 1 - (y + theta) / (mu + theta))
        extras["info"] = -w @ (minus_square + 1 / theta - 2 / (mu + theta) + (y + theta) / (mu + theta) ** 2)
    else:
        p = 2.0 if family == "gamma" else power
        rest = np.ones_like(mu) if p == 2 else np.exp((2 - p) * score)      # mu ** (2 - p)
        weight, variance = w * rest, mu ** 2 / rest
        extras["objective"] = w @ (-y / mu - score) if p == 2 else w @ (y * (rest / mu) / (1 - p) - rest / (2 - p))
    extras["pearson"] = w @ ((y - mu) ** 2 / variance)
    return weight, z, extras


def _blocks(batch: _Batch, codes, sizes, weight, z) -> list[np.ndarray]:
    """X'WX and X'Wz in blocks: dense x dense, dense x factor, factor x later factor; then the right side.

    A factor's block with itself is diagonal and equals its block with the intercept."""
    dense, shared = batch.dense, len(batch.codes)
    weighted = [weight, *[weight * a for a in dense[1:]]]
    out = [np.array([[wa @ b for b in dense] for wa in weighted])]
    for size, code in zip(sizes, codes, strict=True):
        out += [np.bincount(code, wa, size) for wa in weighted]
    for i in range(len(codes)):
        for j in range(i + 1, len(codes)):
            both = batch.pair(i, j, sizes[j]) if j < shared else codes[i] * sizes[j] + codes[j]
            out.append(np.bincount(both, weight, sizes[i] * sizes[j]))
    out.append(np.array([wa @ z for wa in weighted]))
    wz = weight * z
    out += [np.bincount(code, wz, size) for size, code in zip(sizes, codes, strict=True)]
    return [b.ravel() for b in out]


def _system(v: np.ndarray, d: int, sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """The normal equations from a model's summed blocks, base levels left out."""
    first = np.concatenate(([d], d + np.cumsum([s - 1 for s in sizes]))).astype(int)
    p = int(first[-1])
    a, rhs, at = np.zeros((p, p)), np.zeros(p), 0

    def take(n):
        nonlocal at
        at += n
        return v[at - n:at]

    a[:d, :d] = take(d * d).reshape(d, d)
    for k, s in enumerate(sizes):
        own = slice(first[k], first[k + 1])
        for i in range(d):
            block = take(s)[1:]
            a[i, own] = a[own, i] = block
            if i == 0:
                a[own, own] = np.diag(block)
    for i, si in enumerate(sizes):
        for j in range(i + 1, len(sizes)):
            block = take(si * sizes[j]).reshape(si, sizes[j])[1:, 1:]
            a[first[i]:first[i + 1], first[j]:first[j + 1]] = block
            a[first[j]:first[j + 1], first[i]:first[i + 1]] = block.T
    rhs[:d] = take(d)
    for k, s in enumerate(sizes):
        rhs[first[k]:first[k + 1]] = take(s)[1:]
    return a, rhs


def _unit(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matrix with a unit diagonal, and the scales that make it so (0 for empty columns)."""
    d = np.diag(a)
    s = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1.0)), 0.0)
    return a * np.outer(s, s), s


def _solve(a: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Coefficients; of columns that say the same the solution of least length."""
    unit, s = _unit(a)
    try:
        low = np.linalg.cholesky(unit)
        if np.diag(low).min() > 1e-5:
            return s * np.linalg.solve(low.T, np.linalg.solve(low, s * rhs))
    except np.linalg.LinAlgError:
        pass
    return s * np.linalg.lstsq(unit, s * rhs, rcond=1e-11)[0]


def _summed(vectors: DataFrame, in_parts: bool) -> dict[int, np.ndarray]:
    """Vectors (the bytes of doubles) of (model, part, v) added up by model; of many tasks, within parts first."""
    def add(table):
        import pyarrow as pa
        total = sum(np.frombuffer(v.as_buffer()) for v in table.column("v"))
        return pa.table({"model": table.column("model").slice(0, 1), "part": table.column("part").slice(0, 1),
                         "v": pa.array([total.tobytes()], pa.binary())})
    schema = "model int, part int, v binary"
    if in_parts:
        vectors = vectors.groupBy("model", "part").applyInArrow(add, schema)
    summed = vectors.withColumn("part", F.lit(0)).groupBy("model", "part").applyInArrow(add, schema)
    return {r["model"]: np.frombuffer(r["v"]).copy() for r in summed.collect()}


def _over_cells(cells: Cells, part: str | None, fits: Sequence[Fit], of) -> dict[int, np.ndarray]:
    """Sum over the cells of ``of(batch, k, codes, sizes, beta)`` (a vector) for every model k."""
    lookups = [None if f.spec.encoding is None else cells.encodings[f.spec.encoding].lookup for f in fits]
    sizes = [cells.sizes(f.spec) for f in fits]
    betas = [f.beta for f in fits]
    n_factors, n_numeric = len(cells.factors), len(cells.numeric)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        total: list = [None] * len(betas)
        with np.errstate(over="ignore", under="ignore", divide="ignore", invalid="ignore"):
            for arrow in (pa.ipc.open_stream(c.as_buffer()).read_next_batch() for b in batches for c in b.column("cells")):
                batch = _Batch(arrow, n_factors, n_numeric)
                for k, lookup in enumerate(lookups):
                    v = of(batch, k, batch.levels(lookup), sizes[k], betas[k])
                    total[k] = v if total[k] is None else total[k] + v
        place = TaskContext.get().partitionId() % SUM_PARTS
        for k, v in enumerate(total):
            if v is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([place], pa.int32()),
                     pa.array([np.asarray(v, float).tobytes()], pa.binary())], names=["model", "part", "v"])

    with cells.held() as held:
        own = held if part is None else held.filter(F.col("part") == part)
        return _summed(own.select("cells").mapInArrow(run, "model int, part int, v binary"), (cells.tasks or cells.parts) > SUM_PARTS)


def _step_sums(cells: Cells, fits: Sequence[Fit], start: bool) -> dict[int, dict]:
    """Normal equations and extra sums of every model at its present coefficients, in one pass."""
    how = [(f.spec.family, f.spec.power, f.theta, f.spec.weight) for f in fits]

    def of(batch, k, codes, sizes, beta):
        family, power, theta, weight = how[k]
        w = batch.w if weight == "w" else batch.n
        w_, z, extras = _working(family, power, theta, batch.y, batch.off, batch.eta(beta, sizes, codes), w, start)
        extras |= {"weight": w.sum(), "rows": batch.n.sum(), "zz": w_ @ z ** 2}
        return np.concatenate([*_blocks(batch, codes, sizes, w_, z), [extras[e] for e in EXTRAS]])

    out = {}
    d = 1 + len(cells.numeric)
    for k, v in _over_cells(cells, cells.fit_part, fits, of).items():
        a, rhs = _system(v[:-len(EXTRAS)], d, cells.sizes(fits[k].spec))
        out[k] = dict(zip(EXTRAS, v[-len(EXTRAS):].tolist(), strict=True)) | {"a": a, "rhs": rhs}
    return out


def _next_theta(theta: float, score: float, info: float) -> float:
    """A Newton step for 1 / theta, in which the likelihood is near quadratic close to the Poisson limit."""
    slope, bend = -theta ** 2 * score, theta ** 3 * (2 * score - theta * info)
    inverse = 1 / theta - slope / bend if bend < 0 else (0.1 if score > 0 else 10) / theta
    return float(1 / min(max(inverse, 0.1 / theta), 10 / theta))


def _advance(cells: Cells, fits: list[Fit], max_iter: int, tol: float, start: bool) -> None:
    """IRLS steps of all models until each has settled (or ``max_iter``)."""
    last = {id(f): -math.inf for f in fits}
    before: dict[int, tuple] = {}
    halved: dict[int, int] = {}
    active = list(fits)
    for step in range(max_iter + 1):
        from_data = start and step == 0
        got = _step_sums(cells, active, from_data)
        still = []
        for k, f in enumerate(active):
            if k not in got:                       # no fitted rows at all
                continue
            s, me = got[k], id(f)
            f.pearson, f.weight, f.rows, f.information = s["pearson"], s["weight"], int(s["rows"]), s["a"]
            f.rhs, f.zz = s["rhs"], s["zz"]
            penalty = np.zeros(len(f.beta)) if f.spec.penalty is None else np.array(f.spec.penalty)
            s["objective"] -= float(penalty @ f.beta ** 2) / 2
            if f.spec.family == "poisson":
                f.spread, f.excess = s["spread"], s["excess"]
            if not from_data:
                worse = not math.isfinite(s["objective"]) or s["objective"] < last[me] - 1e-9 * (abs(last[me]) + 1)
                if worse and me in before and halved.get(me, 0) < 12:
                    beta, theta = before[me]
                    f.beta, f.theta = (f.beta + beta) / 2, math.sqrt(f.theta * theta) if theta < math.inf else theta
                    halved[me] = halved.get(me, 0) + 1
                    still.append(f)
                    continue
                halved[me] = 0
                f.objective, change = s["objective"], abs(s["objective"] - last[me])
                last[me] = s["objective"]
                steady = f.spec.family != "negbin" or me not in before or abs(f.theta / before[me][1] - 1) < 1e-5
                if (change <= tol * (abs(f.objective) + 0.1) and steady) or \
                        (f.spec.family == "negbin" and f.theta > POISSON_LIMIT):
                    f.converged = True
                    continue
            if f.iterations >= max_iter:
                continue
            before[me] = (f.beta, f.theta)
            f.beta, f.iterations = _solve(s["a"] + np.diag(penalty), s["rhs"]), f.iterations + 1
            if f.spec.family == "negbin":
                f.theta = _next_theta(f.theta, s["score"], s["info"])
            still.append(f)
        active = still
        if not active:
            break


def fit(cells: Cells, specs: Sequence[Spec], max_iter: int = 50, tol: float = 1e-10) -> dict[str, Fit]:
    """Name -> fit of every model.  ``converged`` tells whether it settled within ``max_iter`` steps."""
    for s in specs:
        if s.family not in FAMILIES:
            raise ValueError(f"unknown family {s.family}")
    if len({s.name for s in specs}) < len(specs):
        raise ValueError("model names must differ")
    new = lambda s: Fit(s, cells.names(s), np.zeros(len(cells.names(s))), cells)
    out = {s.name: new(s) for s in specs}
    poisson = {(f.spec.encoding, f.spec.weight): f for f in out.values() if f.spec.family == "poisson"}
    counts = [f for f in out.values() if f.spec.family == "negbin"]
    for f in counts:                               # negative binomial models start from their Poisson limit
        at = (f.spec.encoding, f.spec.weight)
        poisson.setdefault(at, new(Spec("", "poisson", weight=f.spec.weight, encoding=f.spec.encoding)))
    first = [f for f in out.values() if f.spec.family not in ("poisson", "negbin")] + list(poisson.values())
    with cells.held():
        _fit_all(cells, first, counts, poisson, max_iter, tol)
    return out


def _fit_all(cells: Cells, first: list[Fit], counts: list[Fit], poisson: Mapping, max_iter: int, tol: float) -> None:
    """The negative binomial models ``counts`` from their Poisson limits, which are among ``first``."""
    _advance(cells, first, max_iter, tol, start=True)
    for f in counts:
        p = poisson[f.spec.encoding, f.spec.weight]
        f.beta = p.beta
        f.theta = p.weight / p.spread if p.spread > 0 else 1.0
        if p.converged and p.excess <= 0:          # the likelihood falls from the Poisson limit on
            f.theta, f.iterations, f.converged = math.inf, p.iterations, True
    open_ = [f for f in counts if not f.converged]
    if open_:
        _advance(cells, open_, max_iter, tol, start=False)
    for f in counts:
        if f.theta > POISSON_LIMIT:                # the Poisson limit is the maximum itself
            p = poisson[f.spec.encoding, f.spec.weight]
            f.beta, f.objective, f.information = p.beta, p.objective, p.information
            f.pearson, f.weight, f.rows = p.pearson, p.weight, p.rows


def squared_errors(cells: Cells, fits: Mapping[str, Fit], part: str | None) -> dict[str, tuple[float, int]]:
    """Name -> (sum of squared errors, rows) on the rows of a part, all models in one pass."""
    names, own = list(fits), list(fits.values())
    families = [f.spec.family for f in own]

    def of(batch, k, codes, sizes, beta):
        eta = batch.eta(beta, sizes, codes) + batch.off
        mu = 1 / (1 + np.exp(-eta)) if families[k] == "binomial" else np.exp(eta)
        return np.array([batch.n @ (batch.y - mu) ** 2, batch.n.sum()])

    got = _over_cells(cells, part, own, of)
    return {names[k]: (float(v[0]), int(v[1])) for k, v in got.items()}


def tweedie_fixed(cells: Cells, fits: Mapping[str, Fit]) -> dict[str, float]:
    """Name -> phi times the part of the log-likelihood that depends on the fitted means, in one pass."""
    names, own = list(fits), list(fits.values())
    how = [(f.spec.power, f.spec.weight) for f in own]

    def of(batch, k, codes, sizes, beta):
        power, weight = how[k]
        w = batch.w if weight == "w" else batch.n
        mu = np.exp(batch.eta(beta, sizes, codes) + batch.off)
        rest = mu ** (2 - power)
        some = batch.y > 0
        return np.array([w[some] @ (batch.y[some] * rest[some] / mu[some]) / (1 - power) - w @ rest / (2 - power)])

    return {names[k]: float(v[0]) for k, v in _over_cells(cells, cells.fit_part, own, of).items()}


def tweedie_logliks(cells: Cells, fits: Mapping[str, Fit], phis: Mapping[str, Sequence[float]],
                    fixed: Mapping[str, float] | None = None) -> dict[str, np.ndarray]:
    """Name -> log-likelihood for each of its dispersions, all models and dispersions in one pass over the
    responses, and one over the means if ``fixed`` (see ``tweedie_fixed``) is not known."""
    names, own = list(fits), list(fits.values())
    how = [(f.spec.power, f.spec.weight, list(phis[name])) for name, f in fits.items()]
    fixed = tweedie_fixed(cells, fits) if fixed is None else fixed

    def of(batch, k, codes, sizes, beta):
        power, weight, values = how[k]
        some = batch.y > 0
        w, y = (batch.w if weight == "w" else batch.n)[some], batch.y[some]
        return np.array([w @ log_scale(y, phi, power) for phi in values])

    got = _over_cells(cells, cells.fit_part, own, of)
    return {names[k]: v + fixed[names[k]] / np.array(how[k][2]) for k, v in got.items()}


def tweedie_profile(cells: Cells, powers: Sequence[float], weight: str = "n", rounds: int = 5,
                    tol: float = 1e-8, max_iter: int = 25) -> list[dict]:
    """One record a power: fit, phi, log-likelihood and AIC, phi by maximum likelihood as well.

    All powers advance together: their coefficients in the passes of one ``fit``, then their
    dispersions, which close in on the maximum from the Pearson estimate by a third each round.
    """
    with cells.held():
        fits = fit(cells, [Spec(f"{p:g}", "tweedie", power=float(p), weight=weight) for p in powers],
                   max_iter=max_iter, tol=tol)
        best = _tweedie_phis(cells, fits, rounds)
    out = []
    for name, f in fits.items():
        ll, phi = best[name]
        out.append({"power": f.spec.power, "fit": f, "phi": phi, "loglik": ll, "aic": -2 * ll + 2 * (f.rank + 1)})
    return out


def _tweedie_phis(cells: Cells, fits: Mapping[str, Fit], rounds: int) -> dict[str, tuple[float, float]]:
    """Name -> (log-likelihood, dispersion) at the best dispersion tried."""
    fixed = tweedie_fixed(cells, fits)
    centre = {name: math.log(max(f.dispersion, 1e-300)) for name, f in fits.items()}
    best = {name: (-math.inf, math.nan) for name in fits}
    reach = {name: math.log(2.0) for name in fits}
    for _ in range(rounds):
        phis = {name: [math.exp(centre[name] + k * reach[name]) for k in (-1, 0, 1)] for name in fits}
        for name, v in tweedie_logliks(cells, fits, phis, fixed).items():
            k = int(np.argmax(v))
            best[name] = max(best[name], (float(v[k]), phis[name][k]))
            if k == 1:                              # inside: the top of the parabola, and closer
                bend = v[0] - 2 * v[1] + v[2]
                if bend < 0:
                    centre[name] += reach[name] * 0.5 * (v[0] - v[2]) / bend
                reach[name] /= 3
            else:
                centre[name] = math.log(phis[name][k])
    return best
