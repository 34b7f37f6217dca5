"""Design matrices with explicit level order and base level.

Each factor gets a level table (label list); the BASE level is put LAST so
``OneHotEncoder(dropLast=True)`` drops it - treatment coding with the chosen
base, as R's factor contrasts.  Unseen levels map to the base (all-zero
dummies) via ``handleInvalid='keep'`` + dropLast, and are reported by
``grouping.novel_levels`` beforehand.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Design:
    factors: list[str]
    numeric: list[str]
    labels: dict[str, list[str]] = field(default_factory=dict)   # base level last
    model: PipelineModel | None = None
    names: list[str] = field(default_factory=list)               # feature names

    def transform(self, df: DataFrame) -> DataFrame:
        casted = df.withColumns({f: F.col(f).cast("string") for f in self.factors})
        return self.model.transform(casted)


def bases_first_by(df: DataFrame, factors: Sequence[str], weight: str | None) -> dict[str, list[str]]:
    """Per factor its levels, the base first: most ``weight`` (or rows), then the rest alphabetically.
    All factors share one aggregation; only the level lists reach the driver."""
    agg = F.sum("w") if weight else F.count(F.lit(1))
    level = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f).cast("string").alias("v"))
                                for i, f in enumerate(factors)]))
    out: dict[str, list] = {f: [] for f in factors}
    for r in (df.select(level.alias("l"), (F.col(weight) if weight else F.lit(1)).alias("w")).filter("l.v IS NOT NULL")
              .groupBy("l.i", "l.v").agg(agg.alias("w")).collect()):
        out[factors[r["i"]]].append((-(r["w"] or 0), r["v"]))
    ranked = {f: [v for _, v in sorted(found)] for f, found in out.items()}
    return {f: levels[:1] + sorted(levels[1:]) for f, levels in ranked.items()}


def base_first_by(df: DataFrame, factor: str, weight: str | None) -> list[str]:
    """Levels of one factor, the base first (see ``bases_first_by``)."""
    return bases_first_by(df, [factor], weight)[factor]


def build_design(df: DataFrame, factors: Sequence[str], numeric: Sequence[str] = (),
                 weight: str | None = None, levels: dict[str, list[str]] | None = None,
                 out: str = "features") -> Design:
    """Fit the level tables on ``df`` (training rows) and assemble features.

    Treatment coding: the indexer knows only the NON-base levels; the base
    (and any unseen level, and NULL) falls in the indexer's 'keep' bucket,
    which ``OneHotEncoder(dropLast=True)`` drops.  Factors with fewer than
    two levels carry no information and are left out.
    """
    from pyspark.ml import Pipeline
    factors, numeric = list(factors), list(numeric)
    labels, stages, names, used = {}, [], [], []
    open_ = [f for f in factors if not (levels or {}).get(f)]
    counted = bases_first_by(df, open_, weight) if open_ else {}
    for f in factors:
        lv = (levels or {}).get(f) or counted[f]
        labels[f] = lv
        if len(lv) < 2:
            continue
        used.append(f)
        stages.append(StringIndexerModel.from_labels(lv[1:], inputCol=f, outputCol=f"{f}__idx",
                                                     handleInvalid="keep"))
        names += [f"{f}_{v}" for v in lv[1:]]
    if used:
        stages.append(OneHotEncoder(inputCols=[f"{f}__idx" for f in used],
                                    outputCols=[f"{f}__ohe" for f in used], dropLast=True))
    stages.append(VectorAssembler(inputCols=[f"{f}__ohe" for f in used] + numeric,
                                  outputCol=out, handleInvalid="keep"))
    names += numeric
    casted = df.withColumns({f: F.col(f).cast("string") for f in factors})
    model = Pipeline(stages=stages).fit(casted)
    return Design(used, numeric, labels, model, names)
