"""Model weights and weighted forecasts from long prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.expressions import ratio
from seriesloom.operators.metrics import metric_columns, t_critical


def weights_inverse_mse(metrics: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """``(1/mse) / sum(1/mse)`` over the models of a key."""
    inverse = ratio(F.lit(1.0), "mse")
    return metrics.select(*keys, "model", ratio(inverse, F.sum(inverse).over(Window.partitionBy(*keys))).alias("weight"))


def weights_r2(metrics: DataFrame, *, keys: Sequence[str], floor: float = 0.001) -> DataFrame:
    """``max(0, R2) + floor``, normalised; inverse MSE where every R2 is negative."""
    whole = Window.partitionBy(*keys)
    clipped = F.greatest(F.col("r2"), F.lit(0.0)) + floor
    raw = F.when(F.max("r2").over(whole) < 0, ratio(F.lit(1.0), "mse")).otherwise(clipped)
    scored = metrics.withColumn("_raw", raw)
    return scored.select(*keys, "model", ratio("_raw", F.sum("_raw").over(whole)).alias("weight"))


def ensemble_predict(
    predictions: DataFrame,
    weights: DataFrame,
    *,
    keys: Sequence[str],
    row: Sequence[str],
    yhat: str = "yhat",
    confidence: float = 0.95,
) -> DataFrame:
    """Weighted mean, spread and t-interval per row.

    ``predictions`` is long, one row per model; ``weights`` has one row per
    key and model.  The interval uses the population deviation across the
    models and models - 1 degrees of freedom.
    """
    joined = predictions.join(weights, [*keys, "model"])
    out = joined.groupBy(*keys, *row).agg(
        ratio(F.sum(F.col(yhat) * F.col("weight")), F.sum("weight")).alias("prediction"),
        F.stddev_pop(yhat).alias("std"),
        F.count("*").alias("n_models"),
    )
    reach = t_critical(F.col("n_models"), confidence) * F.col("std")
    return out.withColumns({"lower": F.col("prediction") - reach, "upper": F.col("prediction") + reach})


def ensemble_mean(predictions: DataFrame, *, keys: Sequence[str], row: Sequence[str], yhat: str = "yhat") -> DataFrame:
    return predictions.groupBy(*keys, *row).agg(F.avg(yhat).alias("prediction"))


def ensemble_evaluate(
    predictions: DataFrame,
    stored: DataFrame,
    *,
    keys: Sequence[str],
    row: Sequence[str],
    y: str = "y",
    yhat: str = "yhat",
    floor: float = 0.01,
    least: float = 0.1,
) -> DataFrame:
    """Accuracy of the ensemble weighted on the evaluated rows themselves.

    This is in-sample weighting: ``max(0, R2) + floor`` of the same rows, or
    the stored weights where those sum to less than ``least``.  The metrics
    under the stored weights stand beside it (``stored_*``).
    """
    whole = Window.partitionBy(*keys)
    scores = predictions.groupBy(*keys, "model").agg(metric_columns(y, yhat)["r2"].alias("r2"))
    scores = scores.withColumn("_raw", F.greatest(F.col("r2"), F.lit(0.0)) + floor)
    scores = scores.withColumn("_sum", F.sum("_raw").over(whole)).join(stored, [*keys, "model"])
    weights = scores.select(
        *keys,
        "model",
        F.when(F.col("_sum") < least, F.col("weight")).otherwise(ratio("_raw", "_sum")).alias("w"),
        F.col("weight").alias("w0"),
    )
    joined = predictions.join(weights, [*keys, "model"])
    combined = joined.groupBy(*keys, *row).agg(
        F.max(y).alias("_y"),
        ratio(F.sum(F.col(yhat) * F.col("w")), F.sum("w")).alias("_p"),
        ratio(F.sum(F.col(yhat) * F.col("w0")), F.sum("w0")).alias("_p0"),
        F.stddev_pop(yhat).alias("_sd"),
        F.count("*").alias("_n"),
    )
    reach = t_critical(F.col("_n"), 0.95) * F.col("_sd")
    inside = F.abs(F.col("_y") - F.col("_p")) <= reach
    now, before = metric_columns("_y", "_p"), metric_columns("_y", "_p0")
    return combined.groupBy(*keys).agg(
        *[now[m].alias(m) for m in ("mae", "rmse", "r2")],
        F.avg(inside.cast("double")).alias("coverage"),
        F.avg(reach * 2).alias("mean_width"),
        *[before[m].alias(f"stored_{m}") for m in ("rmse", "r2")],
    )


def merge_weights(stored: DataFrame, added: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Weights of the models in use, ``added`` listing them as ``(keys, model)``:
    stored weights are kept, the mass they leave is shared equally among the
    models without one, and all are renormalised."""
    whole = Window.partitionBy(*keys)
    models = added.select(*keys, "model").distinct()
    joined = models.join(stored, [*keys, "model"], "left")
    used = F.coalesce(F.sum("weight").over(whole), F.lit(0.0))
    fresh = F.count_if(F.col("weight").isNull()).over(whole)
    shared = ratio(F.greatest(1 - used, F.lit(0.0)), fresh)
    scored = joined.withColumn("_raw", F.coalesce(F.col("weight"), shared))
    return scored.select(*keys, "model", ratio("_raw", F.sum("_raw").over(whole)).alias("weight"))
