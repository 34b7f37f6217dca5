"""Negative-binomial (NB2) frequency GLM: log link, log(exposure) offset,
prior weights; theta by maximum likelihood.

The rows are reduced once to distinct (levels, regressors, exposure, claim
count) cells, the sufficient statistics of both the coefficients and theta
(digamma differences of integer counts are finite sums, looked up per count).
Coefficients and theta then advance together, one pass over the cells a step
(``models.cells``), so the rows are read a fixed number of times.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposa.models import cells as CL
from exposa.models.design import Design, build_design
from exposa.models.linalg import linear_predictor


@dataclass
class NegBinFit:
    response: str
    design: Design
    coef: list[float]
    intercept: float
    theta: float
    loglik: float
    n: int
    iterations: int
    _exposure: str | None = None
    offset: str | None = "_log_exposure"
    family: str = "negbin"
    converged: bool = True

    @property
    def coefficients(self) -> dict[str, float]:
        out = {"(Intercept)": self.intercept}
        out.update(zip(self.design.names, self.coef))
        return out

    @property
    def aic(self) -> float:
        return -2 * self.loglik + 2 * (len(self.coef) + 2)

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        keep = [c for c in df.columns if c != "_log_exposure"]
        x = self.design.transform(df)
        eta = linear_predictor("features", self.coef, self.intercept)
        if self._exposure:
            eta = eta + F.log(F.col(self._exposure))
        return x.select(*keep, F.exp(eta).alias(out))


def fit_negbin(df: DataFrame, response: str, factors: Sequence[str], exposure: str | None = "exposure",
               weight: str | None = None, max_iter: int = 50, tol: float = 1e-10,
               numeric: Sequence[str] = ()) -> NegBinFit:
    """NB2 GLM started from the Poisson fit (theta -> infinity).  ``converged`` of the
    result tells whether the likelihood settled within ``max_iter`` steps."""
    design = build_design(df, factors, numeric, weight=exposure)
    cells = CL.build(df, response, factors, numeric, exposure=exposure, weight=weight, levels=design.labels)
    fit = CL.fit(cells, [CL.Spec("nb", "negbin")], max_iter=max_iter, tol=tol)["nb"]
    coef = fit.coefficients
    return NegBinFit(response, design, [coef[n] for n in design.names], coef["(Intercept)"], fit.theta,
                     fit.objective, fit.rows, fit.iterations, exposure, converged=fit.converged)
