"""Linear predictors as SQL expressions over an ML feature vector.

Coefficients are driver-side literals, so iterating (IRLS, Newton) never
grows the lineage: each step re-reads the same cached feature frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F


def linear_predictor(features: str, coef: Sequence[float], intercept: float) -> Column:
    arr = vector_to_array(F.col(features))
    c = F.array(*[F.lit(float(v)) for v in coef])
    prod = F.zip_with(arr, c, lambda a, b: a * b)
    return F.aggregate(prod, F.lit(float(intercept)), lambda acc, v: acc + v)
