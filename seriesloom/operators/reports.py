"""Whole preparations and reports composed from the other operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.expressions import ratio
from seriesloom.functions.windows import rolling, series_window
from seriesloom.operators.features import lag_exprs
from seriesloom.operators.impute import clean, fill_knn
from seriesloom.operators.outliers import clip_flagged_series
from seriesloom.operators.panel import align_sources, outer_merge_many
from seriesloom.operators.quality import flagged_sources, quality_report
from seriesloom.session import settled


def treat_source(df: DataFrame, *, keys: Sequence[str], date: str, cols: Sequence[str]) -> DataFrame:
    """``keys``, ``date`` and ``cols`` of one source, clipped where flagged and without gaps."""
    clipped = clip_flagged_series(df.select(*keys, date, *cols), cols, keys=keys)
    return fill_knn(clipped, keys=keys, date=date, cols=cols)


def prepare_panel(
    sources: Mapping[str, DataFrame],
    *,
    keys: Sequence[str],
    date: str,
    value: Mapping[str, str],
    target: str,
    lags: Sequence[int] = (1, 2, 3),
    windows: Sequence[int] = (3, 12),
) -> DataFrame:
    """Clip flagged series of every source, fill its gaps from the nearest rows,
    align the sources on their common months, take logs of the target and add its
    lags and rolling means.

    Treated sources are settled, as aligning reads them for the range and for the
    values; everything after the alignment shares one partitioning.
    """
    aligned = align_sources(
        {n: settled(treat_source(df, keys=keys, date=date, cols=[value[n]])) for n, df in sources.items()}, keys=keys, date=date, value=value
    )
    log_name = f"log_{target}"
    logged = aligned.withColumn(log_name, F.when(F.col(target) > 0, F.ln(target)))
    w = series_window(keys, date)
    features = lag_exprs([log_name], lags, w) | {f"{log_name}_mean_{n}": rolling(log_name, n, F.avg, w) for n in windows}
    return logged.withColumns(features)


def complete_dataset(sources: Mapping[str, DataFrame], *, keys: Sequence[str], date: str, value: Mapping[str, str]) -> DataFrame:
    """Full outer merge of the sources, then the standard cleaning."""
    merged = outer_merge_many(sources, on=[*keys, date], value=value)
    return clean(merged, keys=keys, date=date)


def clean_flagged(sources: Mapping[str, DataFrame], *, keys: Sequence[str], dates: Mapping[str, str]) -> dict[str, DataFrame]:
    """Clean the sources whose quality report says so; the others pass through."""
    flagged = set(flagged_sources(quality_report(sources, dates=dates)))
    return {n: clean(df, keys=keys, date=dates[n]) if n in flagged else df for n, df in sources.items()}


def insight_report(df: DataFrame, *, keys: Sequence[str], date: str, target: str, drivers: tuple[str, str], max_lag: int = 12) -> DataFrame:
    """``(keys, insight, value)``: peak and trough month, correlations, the
    best lead of each driver and the drivers' shares in a joint regression.

    Lags come from one window and everything else from one aggregate per key.
    """
    w = series_window(keys, date)
    lags = {f"_{d}_{k}": F.lag(d, k).over(w) for d in drivers for k in range(max_lag + 1)}
    a, b = drivers
    months = [F.struct(F.avg(F.when(F.month(date) == m, F.col(target))).alias("v"), F.lit(m).alias("m")) for m in range(1, 13)]
    leads = {
        d: F.array(*[F.struct(F.abs(F.corr(target, f"_{d}_{k}")).alias("c"), F.lit(-k).alias("k")) for k in range(max_lag + 1)])
        for d in drivers
    }
    table = df.withColumns(lags).groupBy(*keys).agg(
        F.corr(target, a).alias("ya"),
        F.corr(target, b).alias("yb"),
        F.corr(a, b).alias("ab"),
        F.array(*months).alias("months"),
        *[lead.alias(f"lead_{d}") for d, lead in leads.items()],
    )
    seen = F.filter("months", lambda x: x["v"].isNotNull())
    top = F.array_max(F.transform(seen, lambda x: F.struct(x["v"].alias("v"), (-x["m"]).alias("m"))))
    pull_a, pull_b = F.abs(F.col("ya") - F.col("ab") * F.col("yb")), F.abs(F.col("yb") - F.col("ab") * F.col("ya"))
    insights = {
        "peak_month": -top["m"],
        "trough_month": F.array_min(seen)["m"],
        f"corr_{a}": F.col("ya"),
        f"corr_{b}": F.col("yb"),
        **{f"best_lag_{d}": -F.array_max(f"lead_{d}")["k"] for d in drivers},
        f"importance_{a}": ratio(pull_a, pull_a + pull_b),
        f"importance_{b}": ratio(pull_b, pull_a + pull_b),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("insight"), c.cast("double").alias("value")) for n, c in insights.items()])
    return table.select(*keys, F.inline(rows))
