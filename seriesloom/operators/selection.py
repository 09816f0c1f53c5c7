"""Feature selection and importance.

Linear steps need one pass for the moments of all features; every elimination
after that is algebra on a matrix of feature-count size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.models import fit_forest
from seriesloom.operators.stats import column_moments, raw_gram_matrix, solve_centred, vif_values
from seriesloom.session import held


def select_by_vif(df: DataFrame, features: Sequence[str], *, threshold: float = 10.0, max_features: int | None = None) -> list[str]:
    """Drop the feature with the highest VIF until all are at or below the
    threshold or, where ``max_features`` is given, no more than that are left."""
    g, kept = raw_gram_matrix(df, features), list(range(len(features)))
    while len(kept) > 1:
        vifs = [math.inf if v is None else v for v in vif_values(g[np.ix_(kept, kept)])]
        worst = int(np.argmax(vifs))
        if vifs[worst] <= threshold or (max_features is not None and len(kept) <= max_features):
            break
        kept.pop(worst)
    return [features[i] for i in kept]


def forest_importance(df: DataFrame, features: Sequence[str], target: str, **params) -> dict[str, float]:
    return importance_of(fit_forest(df, features, target, **params), features)


def importance_of(model: PipelineModel, features: Sequence[str]) -> dict[str, float]:
    """Tree importances, absolute coefficients, or equal weights."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif hasattr(last, "coefficients"):
        values = np.abs(last.coefficients.toArray())
    else:
        values = np.full(len(features), 1.0 / len(features))
    return dict(zip(features, map(float, values)))


def importance_table(df: DataFrame, importance: dict[str, float], *, top: int | None = None) -> DataFrame:
    """``(rank, feature, importance)``, best first."""
    order = sorted(importance.items(), key=lambda x: (-x[1], x[0]))[:top]
    rows = [(i + 1, f, v) for i, (f, v) in enumerate(order)]
    return df.sparkSession.createDataFrame(rows, "rank int, feature string, importance double")


def rfe_forest(df: DataFrame, features: Sequence[str], target: str, *, keep: int | None = None, step: int = 1, **params) -> list[str]:
    """Refit a forest and drop the ``step`` least important features until
    ``keep`` (default a third) remain."""
    kept, keep = list(features), keep or max(len(features) // 3, 1)
    with held(df.select(*features, target)) as frame:
        while len(kept) > keep:
            scores = forest_importance(frame, kept, target, **params)
            drop = sorted(kept, key=lambda f: scores[f])[: min(step, len(kept) - keep)]
            kept = [f for f in kept if f not in drop]
    return kept


def rfe_ridge(df: DataFrame, features: Sequence[str], target: str, *, keep: int | None = None, alpha: float = 1.0) -> list[str]:
    """Eliminate by the smallest standardised ridge coefficient; keeps
    ``min(sqrt(n), p)`` features by default.  The data is read for the moments only."""
    n, _, cov = column_moments(df, [*features, target])
    scale = np.sqrt(np.where(np.diag(cov) > 0, np.diag(cov), 1.0))
    unit, kept = cov / np.outer(scale, scale), list(range(len(features)))
    keep = keep or min(int(math.sqrt(n)), len(features))
    while len(kept) > keep:
        at = [*kept, len(features)]
        slopes, _, _ = solve_centred(unit[np.ix_(at, at)], np.zeros(len(at)), alpha / n)
        kept.pop(int(np.argmin(np.abs(slopes))))
    return [features[i] for i in kept]


def pca(df: DataFrame, features: Sequence[str], *, variance: float = 0.95) -> tuple[PipelineModel, DataFrame]:
    """Fitted scaler and projection, and ``(component, explained, cumulative,
    kept, feature, loading)`` with the loadings of the first two components.

    Components are kept until they explain ``variance``; standardising with
    the sample or the population deviation gives the same shares.
    """
    from pyspark.ml import Pipeline

    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="skip"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
        PCA(k=len(features), inputCol="_scaled", outputCol="components"),
    ]
    model = Pipeline(stages=stages).fit(df.select(*features))
    shares = model.stages[-1].explainedVariance.toArray()
    loadings = model.stages[-1].pc.toArray()
    total = np.cumsum(shares)
    needed = int(np.searchsorted(total, variance - 1e-12)) + 1
    rows = [
        (c + 1, float(shares[c]), float(total[c]), c < needed, f, float(loadings[i, c]) if c < 2 else None)
        for c in range(len(features))
        for i, f in enumerate(features)
    ]
    schema = "component int, explained double, cumulative double, kept boolean, feature string, loading double"
    return model, df.sparkSession.createDataFrame(rows, schema)


def pca_reduced(df: DataFrame, features: Sequence[str], *, variance: float = 0.95) -> DataFrame:
    """``df`` with ``PC1`` .. ``PCk`` in place of the features, as column expressions.

    The fewest components that explain ``variance`` of the standardised features
    stay.  Their weights come from one aggregate of moments over rows that have all
    features; in a component the first of the largest weights is positive.  A row
    with gaps has NULL components, and ``gaps`` counts its missing features.
    A constant feature has no weight.  Without complete rows there is PC1 alone, NULL.
    """
    names = list(features)
    others = [c for c in df.columns if c not in names]
    gaps = F.size(F.filter(F.array(*[F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in names]), lambda g: g)).alias("gaps")
    if df.select(*names).na.drop("any").isEmpty():
        return df.select(*others, F.lit(None).cast("double").alias("PC1"), gaps)
    _, means, cov = column_moments(df, names)
    sd = np.sqrt(np.diag(cov))
    scale = np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 0)
    values, vectors = np.linalg.eigh(cov * np.outer(scale, scale))
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    total = np.cumsum(values) / (values.sum() or 1.0)
    needed = min(int(np.searchsorted(total, variance - 1e-12)) + 1, len(names))

    def component(weights: np.ndarray) -> Column:
        first = np.flatnonzero(np.abs(weights) >= np.abs(weights).max() - 1e-9)[0]
        weights = weights * np.sign(weights[first])
        value = F.lit(0.0)
        for c, w, m, s in zip(names, weights.tolist(), means.tolist(), scale.tolist()):
            value = value + (F.col(c).cast("double") - m) * (w * s)
        return F.when(~F.isnan(value), value)

    return df.select(*others, *[component(vectors[:, i]).alias(f"PC{i + 1}") for i in range(needed)], gaps)


def select_by_importance(df: DataFrame, features: Sequence[str], target: str, *, threshold: float = 0.01, **params) -> list[str]:
    scores = forest_importance(df, features, target, **params)
    return [f for f in features if scores[f] > threshold]


def select_with_priority(features: Sequence[str], importance: dict[str, float], *, max_features: int = 15, priority: Sequence[str] = ("_lag_1", "_ma_", "trend")) -> list[str]:
    """Priority features first (all of them), then by importance up to
    ``max_features``."""
    first = [f for mark in priority for f in features if mark in f]
    chosen = list(dict.fromkeys(first))
    for f in sorted(features, key=lambda f: -importance[f]):
        if len(chosen) >= max_features:
            break
        if f not in chosen:
            chosen.append(f)
    return chosen


def select_features(df: DataFrame, features: Sequence[str], target: str, *, vif_threshold: float = 50.0, vif_max: int = 30, importance: float = 0.01, keep: int = 20, **params) -> list[str]:
    """VIF, then importance, then recursive elimination."""
    with held(df.select(*features, target)) as frame:
        kept = select_by_vif(frame, features, threshold=vif_threshold, max_features=vif_max)
        kept = select_by_importance(frame, kept, target, threshold=importance, **params) or kept
        return rfe_forest(frame, kept, target, keep=min(keep, len(kept)), **params)
