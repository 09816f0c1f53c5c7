"""Resampling, alignment and merging of panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.windows import filled_forward, series_window, spread
from seriesloom.operators.impute import edge_filled, interpolate


def densify(df: DataFrame, *, keys: Sequence[str], date: str, step: str = "1 day") -> DataFrame:
    """Insert the missing periods between a key's first and last date.

    Every row is stretched to just before its successor, so one shuffle by key
    does the work of a spine and a join.  Inserted rows are NULL but for keys
    and date.
    """
    w = series_window(keys, date)
    one = F.expr(f"interval {step}")
    following = F.lead(date).over(w)
    until = F.coalesce((following - one).cast("date"), F.col(date))
    grown = df.withColumn("_until", F.greatest(until, F.col(date)))
    grown = grown.withColumn("_at", F.explode(F.sequence(F.col(date), F.col("_until"), one)))
    rest = [c for c in df.columns if c not in (*keys, date)]
    observed = F.col("_at") == F.col(date)
    return grown.select(*keys, F.col("_at").alias(date), *[F.when(observed, F.col(c)).alias(c) for c in rest])


def reindex(df: DataFrame, *, keys: Sequence[str], date: str, start: str, end: str, step: str = "1 month") -> DataFrame:
    """Put every key on the grid ``start .. end``; off-grid rows are dropped."""
    grid = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"interval {step}"))
    spine = df.select(*keys).distinct().withColumn(date, F.explode(grid))
    return spine.join(df, [*keys, date], "left")


def resample_last(df: DataFrame, *, keys: Sequence[str], date: str, cols: Sequence[str], unit: str = "month") -> DataFrame:
    """Last non-missing value of every period (two-phase aggregate)."""
    period = F.trunc(F.col(date).cast("date"), unit)
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(date))).alias(c) for c in cols]
    return df.groupBy(*keys, period.alias(date)).agg(*last)


def upsample_ffill(df: DataFrame, *, keys: Sequence[str], date: str, cols: Sequence[str], step: str = "1 day") -> DataFrame:
    dense = densify(df, keys=keys, date=date, step=step)
    w = series_window(keys, date)
    return dense.withColumns({c: filled_forward(c, w) for c in cols})


def outer_merge(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "full")


def outer_merge_many(sources: Mapping[str, DataFrame], *, on: Sequence[str], value: Mapping[str, str]) -> DataFrame:
    """Full outer merge of N sources with one shuffle: stack them in long form
    and aggregate; ``value`` names the value column of every source, which has at
    most one row per key (``outer_merge_rows`` takes several rows and columns)."""
    stacked = [
        df.select(*on, F.lit(name).alias("_source"), F.col(value[name]).cast("double").alias("_value"))
        for name, df in sources.items()
    ]
    long = reduce(DataFrame.unionByName, stacked)
    return long.groupBy(*on).agg(
        *[F.max(F.when(F.col("_source") == name, F.col("_value"))).alias(name) for name in sources]
    )


def outer_merge_rows(sources: Mapping[str, DataFrame], *, on: Sequence[str]) -> DataFrame:
    """Full outer merge of N sources with any columns and any number of rows per key.

    Equals a chain of full joins: each combination of the rows that share a key is
    one row, a source without the key is NULL in it, NULL keys meet each other.  A
    column that several sources have is called ``{column}_{source}``.

    The sources are stacked and shuffled once.  Each row gets its occurrence index
    within key and source, is sent to every combination that holds this index, and
    the parts of a combination are put together.  No list of a key's rows is built;
    the rows in flight are those of the result, once per source.
    """
    names, on = list(sources), list(on)
    own = {n: [c for c in sources[n].columns if c not in on] for n in names}
    every = [c for n in names for c in own[n]]
    parts = []
    for i, n in enumerate(names):
        cells = F.struct(F.lit(True).alias("_in"), *[F.col(c) for c in own[n]])
        parts.append(sources[n].select(*on, F.lit(i).alias("_source"), cells.alias(f"_row{i}")))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    by_key = Window.partitionBy(*on)
    cells = [F.col(f"_row{i}") for i in range(len(names))]
    place = F.row_number().over(Window.partitionBy(*on, "_source").orderBy(*cells)) - 1
    sizes = [F.greatest(F.count(c).over(by_key), F.lit(1)) for c in cells]
    sized = stacked.select("*", place.cast("long").alias("_place"), *[s.alias(f"_size{i}") for i, s in enumerate(sizes)])
    size = [F.col(f"_size{i}") for i in range(len(names))]

    def pick(values: Sequence[Column]) -> Column:
        return reduce(lambda rest, iv: F.when(F.col("_source") == iv[0], iv[1]).otherwise(rest), enumerate(values), F.lit(1).cast("long"))

    def product(cols: Sequence[Column]) -> Column:
        return reduce(lambda a, b: a * b, cols, F.lit(1).cast("long"))

    low = pick([product(size[i + 1 :]) for i in range(len(names))])
    high = pick([product(size[:i]) for i in range(len(names))])
    spread_out = sized.withColumns({"_low": low, "_own": pick(size), "_other": F.explode(F.sequence(F.lit(0).cast("long"), low * high - 1))})
    beside = F.expr("_other div _low") * F.col("_own") * F.col("_low")
    numbered = spread_out.withColumn("_combination", beside + F.col("_place") * F.col("_low") + F.col("_other") % F.col("_low"))
    merged = numbered.groupBy(*on, "_combination").agg(*[F.first(c, ignorenulls=True).alias(f"_row{i}") for i, c in enumerate(cells)])
    out = [F.col(f"_row{i}")[c].alias(c if every.count(c) == 1 else f"{c}_{n}") for i, n in enumerate(names) for c in own[n]]
    return merged.select(*on, *out)


def inner_merge(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "inner")


def suffix_merge(target: DataFrame, others: Mapping[str, DataFrame], *, on: Sequence[str]) -> DataFrame:
    """Left-align sources to the target's rows; their value columns get
    ``_{source}``, the target's keep their names."""
    out = target
    for name, df in others.items():
        renamed = df.withColumnsRenamed({c: f"{c}_{name}" for c in df.columns if c not in on})
        out = out.join(renamed, list(on), "left")
    return out


def align_sources(
    sources: Mapping[str, DataFrame],
    *,
    keys: Sequence[str],
    date: str,
    value: Mapping[str, str],
    exact: bool = True,
) -> DataFrame:
    """Bring sources to the month-start grid of their common range.

    The range runs from the latest first to the earliest last date of the
    sources.  ``exact`` keeps observations that lie on the grid and drops the
    others; otherwise the last observation of the month counts.  Gaps are
    interpolated by elapsed days and the edges filled.

    All sources are stacked and aggregated in one shuffle.  The range is a
    scalar subquery over the dates, so each source is read twice: settle
    (``session.settled``) a source that is costly to derive.
    """
    names, k = list(sources), list(keys)
    stacked = [
        df.select(
            *k,
            F.trunc(F.col(date).cast("date"), "month").alias(date),
            F.col(date).cast("date").alias("_raw"),
            F.lit(name).alias("_source"),
            F.col(value[name]).cast("double").alias("_value"),
        )
        for name, df in sources.items()
    ]

    def observed(name: str) -> Column:
        own = F.col("_source") == name
        if exact:
            return F.max(F.when(own & (F.col("_raw") == F.col(date)), F.col("_value")))
        return F.max_by("_value", F.when(own & F.col("_value").isNotNull(), F.col("_raw")))

    def raw(fn, name: str) -> Column:
        return fn(F.when(F.col("_source") == name, F.col("_raw")))

    merged = reduce(DataFrame.unionByName, stacked).groupBy(*k, date).agg(
        *[observed(n).alias(n) for n in names],
        *[raw(F.min, n).alias(f"_from_{n}") for n in names],
        *[raw(F.max, n).alias(f"_to_{n}") for n in names],
    )
    latest = _extreme(F.greatest, [F.min(f"_from_{n}") for n in names])
    first = F.when(F.trunc(latest, "month") == latest, latest).otherwise(F.add_months(F.trunc(latest, "month"), 1))
    last = F.trunc(_extreme(F.least, [F.max(f"_to_{n}") for n in names]), "month")
    span = merged.agg(F.struct(first.alias("start"), last.alias("end")).alias("r"))
    ranged = merged.select(*k, date, *names, span.scalar().alias("_r"))
    aligned = _stretch(ranged, k, date, F.col("_r.start"), F.col("_r.end"), names)
    timed = interpolate(aligned, keys=keys, date=date, cols=names, by="time")
    return edge_filled(timed, keys=keys, date=date, cols=names)


def _extreme(fn, cols: Sequence[Column]) -> Column:
    return fn(*cols) if len(cols) > 1 else cols[0]


def _stretch(df: DataFrame, keys: Sequence[str], date: str, start: Column, end: Column, cols: Sequence[str]) -> DataFrame:
    """Monthly grid ``start .. end`` for every key, without a spine join: each
    row covers the months up to its successor, the first row also those
    before it.  Rows outside the range only lend their key."""
    w = series_window(keys, date)
    one = F.expr("interval 1 month")
    opens = F.when(F.lag(date).over(w).isNull(), start).otherwise(F.col(date))
    closes = F.coalesce((F.lead(date).over(w) - one).cast("date"), end)
    grown = df.withColumns({"_a": F.greatest(opens, start), "_b": F.least(closes, end)}).filter(F.col("_a") <= F.col("_b"))
    grown = grown.withColumn("_at", F.explode(F.sequence("_a", "_b", one)))
    here = F.col("_at") == F.col(date)
    return grown.select(*keys, F.col("_at").alias(date), *[F.when(here, F.col(c)).alias(c) for c in cols])


def cubic_upsample(
    df: DataFrame, *, keys: Sequence[str], date: str, value: str, step_days: int = 1
) -> DataFrame:
    """Cubic (not-a-knot) interpolation of a coarse series onto a daily grid.

    One call per series: a few hundred knots, bounded by the calendar.  Series
    with fewer than four knots use the polynomial through all of them.
    """
    import numpy as np
    import pandas as pd

    def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = len(x)
        if n < 4:
            return np.polyval(np.polyfit(x, y, n - 1), at)
        h = np.diff(x)
        a = np.zeros((n, n))
        rhs = np.zeros(n)
        inner = np.arange(1, n - 1)
        a[inner, inner - 1], a[inner, inner], a[inner, inner + 1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
        rhs[inner] = 6 * (np.diff(y)[1:] / h[1:] - np.diff(y)[:-1] / h[:-1])
        a[0, :3] = h[1], -(h[0] + h[1]), h[0]
        a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
        m = np.linalg.solve(a, rhs)
        i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
        left, right = at - x[i], x[i + 1] - at
        curve = (m[i] * right**3 + m[i + 1] * left**3) / (6 * h[i])
        return curve + (y[i] / h[i] - m[i] * h[i] / 6) * right + (y[i + 1] / h[i] - m[i + 1] * h[i] / 6) * left

    def upsample(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[value]).sort_values(date)
        if pdf.empty:
            return pd.DataFrame(columns=[*keys, date, value])
        days = pd.to_datetime(pdf[date])
        x = (days - days.iloc[0]).dt.days.to_numpy(float)
        at = np.arange(0, x[-1] + 1, step_days, dtype=float)
        y = pdf[value].to_numpy(float)
        out = pd.DataFrame({date: (days.iloc[0] + pd.to_timedelta(at, "D")).date, value: spline(x, y, at)})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, date, value]]

    narrow = df.select(*keys, F.col(date).cast("date").alias(date), F.col(value).cast("double").alias(value))
    return spread(narrow, keys).groupBy(*keys).applyInPandas(upsample, narrow.schema)

