"""Filling missing values, per series key.

Statistics are pre-aggregated per key and joined back, so no key's rows are
gathered for them.  Order-dependent fills use windows over the panel, whose
partitions the calendar bounds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.expressions import as_col, numeric_columns, ratio
from seriesloom.functions.windows import filled_forward, position, series_window, spread

KNN_CELLS = 4_000_000  # cells of one distance block, about 32 MB
PATTERN_CELLS = 2_000_000  # numbers in the maps of all patterns, about 16 MB
_UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)


def _fill_with(df: DataFrame, keys: Sequence[str], stats: dict[str, Column]) -> DataFrame:
    """A NULL key is a series of its own, so the statistics join back null-safely."""
    table = df.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(*[s.alias(f"_fill_{c}") for c, s in stats.items()])
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    joined = df.join(table, same, "left") if keys else df.crossJoin(table)
    filled = joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_fill_{c}")) for c in stats})
    return filled.drop(*[f"_fill_{c}" for c in stats], *[f"_of_{k}" for k in keys])


def fill_mean(df: DataFrame, *, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return _fill_with(df, keys, {c: F.avg(c) for c in cols})


def fill_median(df: DataFrame, *, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Exact median of the series (panel grain: the calendar bounds a key)."""
    return _fill_with(df, keys, {c: F.median(c) for c in cols})


def fill_mode(df: DataFrame, *, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Most frequent value, the smallest on a tie.  Counted per value first,
    so a frequent value shrinks to one row before it moves."""
    out = df
    for c in cols:
        counts = df.filter(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count("*").alias("_n"))
        mode = counts.groupBy(*keys).agg(F.min_by(c, F.struct(-F.col("_n"), F.col(c))).alias("_mode"))
        out = out.join(mode, list(keys), "left").withColumn(c, F.coalesce(c, "_mode")).drop("_mode")
    return out


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.fill(0, subset=list(cols))


def fill_forward(df: DataFrame, *, keys: Sequence[str], date: str, cols: Sequence[str], then_back: bool = False) -> DataFrame:
    w = series_window(keys, date)
    out = df.withColumns({c: filled_forward(c, w) for c in cols})
    return fill_backward(out, keys=keys, date=date, cols=cols) if then_back else out


def fill_backward(df: DataFrame, *, keys: Sequence[str], date: str, cols: Sequence[str], then_forward: bool = False) -> DataFrame:
    """The mirrored window keeps the running frame linear in the series."""
    w = series_window(keys, F.col(date).desc())
    out = df.withColumns({c: filled_forward(c, w) for c in cols})
    return fill_forward(out, keys=keys, date=date, cols=cols) if then_forward else out


def edge_filled(df: DataFrame, *, keys: Sequence[str], date: str, cols: Sequence[str]) -> DataFrame:
    """Backward, then forward fill: what is left after interpolation."""
    return fill_backward(df, keys=keys, date=date, cols=cols, then_forward=True)


def interpolate(df: DataFrame, *, keys: Sequence[str], date: str, cols: Sequence[str], by: str = "position") -> DataFrame:
    """Linear interpolation by row position or by elapsed days.

    Interior gaps lie on the line between their neighbours, trailing gaps hold
    the last value, leading gaps stay NULL.
    """
    ahead = series_window(keys, date)
    back = series_window(keys, F.col(date).desc())
    at = position(ahead) if by == "position" else F.unix_date(F.col(date).cast("date"))
    out = df.withColumn("_at", at)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(c).cast("double").alias("x"))) for c in cols}
    out = out.withColumns({f"_prev_{c}": F.last(k, ignorenulls=True).over(ahead.rowsBetween(*_UP_TO_HERE)) for c, k in known.items()})
    out = out.withColumns({f"_next_{c}": F.last(k, ignorenulls=True).over(back.rowsBetween(*_UP_TO_HERE)) for c, k in known.items()})

    def line(c: str) -> Column:
        prev, nxt = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        rise = ratio((nxt.x - prev.x) * (F.col("_at") - prev.at), nxt.at - prev.at)
        inner = F.when(nxt.isNull(), prev.x).otherwise(prev.x + rise)
        return F.when(F.col(c).isNotNull(), F.col(c)).otherwise(inner)

    out = out.withColumns({c: line(c) for c in cols})
    return out.drop("_at", *[f"_{side}_{c}" for c in cols for side in ("prev", "next")])


def fill_knn(df: DataFrame, *, keys: Sequence[str], date: str, cols: Sequence[str], k: int = 5) -> DataFrame:
    """Mean of the ``k`` nearest rows of the same series that hold the value.

    Distance is Euclidean over the columns both rows have, scaled up by the
    share of columns present; ties go to the earlier row; a row that shares no
    column with any donor takes the column mean.  A series is at most one row
    per calendar period; distances are worked out for a chunk of incomplete
    rows at a time inside the task and no pair is ever emitted.
    """
    names = list(cols)

    def impute(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date, kind="stable").reset_index(drop=True)
        x = pdf[names].to_numpy(float)
        has = ~np.isnan(x)
        zero, filled = np.where(has, x, 0.0), x.copy()
        incomplete = np.flatnonzero(~has.all(axis=1))
        rows = max(KNN_CELLS // x.size, 1)
        for part in np.array_split(incomplete, len(incomplete) // rows + 1):
            both = has[part][:, None, :] & has[None, :, :]
            shared = both.sum(axis=2)
            square = np.where(both, (zero[None, :, :] - zero[part][:, None, :]) ** 2, 0.0).sum(axis=2)
            dist = np.where(shared > 0, square * len(names) / np.maximum(shared, 1), np.inf)
            dist = np.round(dist, 9)  # distances equal but for rounding are ties
            for j in range(len(names)):
                open_rows, donors = np.flatnonzero(~has[part, j]), np.flatnonzero(has[:, j])
                if not len(open_rows) or not len(donors):
                    continue
                d = dist[np.ix_(open_rows, donors)]
                near = np.argsort(d, axis=1, kind="stable")[:, :k]
                usable = np.isfinite(np.take_along_axis(d, near, axis=1))
                total, n = (x[donors[near], j] * usable).sum(axis=1), usable.sum(axis=1)
                filled[part[open_rows], j] = np.where(n > 0, total / np.maximum(n, 1), x[donors, j].mean())
        pdf[names] = filled
        return pdf

    fields = [
        T.StructField(f.name, T.DoubleType() if f.name in names else f.dataType, True) for f in df.schema.fields
    ]
    doubled = df.withColumns({c: F.col(c).cast("double") for c in names})
    return spread(doubled, keys).groupBy(*keys).applyInPandas(impute, T.StructType(fields))


def fill_iterative(df: DataFrame, *, keys: Sequence[str], cols: Sequence[str], rounds: int = 10, alpha: float = 1e-3, tolerance: float = 1e-3) -> DataFrame:
    """Regress every incomplete column on the others, up to ``rounds`` times.

    Starts from the key means (table means where a key has none).  Rows that
    lack the same columns form a pattern, and inside a pattern every round's values are one
    linear map of the start values.  So one aggregate of the start values' moments
    by pattern stands for all rows: the rounds work on these matrices
    alone, and one pass over the rows applies the last map.  They stop when the
    cells of no column move by more than ``tolerance`` of its deviation (root mean
    square).  A column without any value stays NULL and is no regressor.

    The maps travel to the rows as a table of at most ``PATTERN_CELLS`` numbers; with
    more patterns than that, each round is a pass over the rows instead.
    """
    from seriesloom.operators.stats import covariance

    names = list(cols)
    doubled = df.withColumns({c: F.col(c).cast("double") for c in names})
    marks = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in names])
    begun = fill_mean(doubled.withColumn("_gaps", marks), keys=keys, cols=names)
    start = begun.agg(*[F.avg(c).alias(c) for c in names]).first()
    used = [c for c in names if start[c] is not None]
    if not used:
        return begun.select(*df.columns)
    begun, k = begun.na.fill({c: start[c] for c in used}), len(used)
    moments = begun.groupBy("_gaps").agg(
        F.count("*").alias("n"),
        F.array(*[F.avg(c) for c in used]).alias("means"),
        F.array(*[F.covar_pop(x, y) for x, y in combinations_with_replacement(used, 2)]).alias("covs"),
    )
    most = PATTERN_CELLS // (k * (k + 1))
    rows = moments.limit(most + 1).collect()
    if len(rows) > most:
        return _fill_by_passes(begun, names, used, rounds, alpha, tolerance).select(*df.columns)
    at = [names.index(c) for c in used]
    gaps = np.array([[row["_gaps"][i] == "1" for i in at] for row in rows])
    centre = np.array([start[c] for c in used])
    sums = np.zeros((len(rows), k + 1, k + 1))
    for s, row in zip(sums, rows):
        mean = np.append(1.0, np.array(row["means"]) - centre)
        s[1:, 1:] = covariance(row["covs"], k)
        s[:] = row["n"] * (s + np.outer(mean, mean))
    maps = _pattern_maps(sums, gaps, rounds, alpha, tolerance)
    maps[:, 1:, 0] += centre - maps[:, 1:, 1:] @ centre
    table = [(row["_gaps"], m[1:].tolist()) for row, m in zip(rows, maps) if "1" in row["_gaps"]]
    lookup = df.sparkSession.createDataFrame(table, "_gaps string, _map array<array<double>>")
    joined = begun.join(F.broadcast(lookup), "_gaps", "left")

    def mapped(i: int) -> Column:
        row = F.col("_map")[i]
        value = row[0]
        for j, c in enumerate(used):
            value = value + row[j + 1] * F.col(c)
        return F.when(F.substring("_gaps", names.index(used[i]) + 1, 1) == "1", value).otherwise(F.col(used[i]))

    return joined.withColumns({c: mapped(i) for i, c in enumerate(used)}).select(*df.columns)


def _pattern_maps(sums: np.ndarray, gaps: np.ndarray, rounds: int, alpha: float, tolerance: float) -> np.ndarray:
    """For every pattern the map of (1, start values) to the values after the rounds.

    ``sums`` are the summed products of (1, start values), ``gaps`` the columns a
    pattern lacks.
    """
    from seriesloom.operators.stats import solve_centred

    k = gaps.shape[1]
    maps = np.repeat(np.eye(k + 1)[None], len(gaps), axis=0)
    total = sums.sum(axis=0)
    sd = np.sqrt(np.maximum(np.diag(total)[1:] / total[0, 0] - (total[0, 1:] / total[0, 0]) ** 2, 0.0))
    targets = [t for t in range(k) if gaps[:, t].any() and not gaps[:, t].all()]
    for _ in range(rounds if targets and k > 1 else 0):
        now = maps @ sums @ maps.transpose(0, 2, 1)
        after, still = maps.copy(), True
        for t in targets:
            m = now[~gaps[:, t]].sum(axis=0)
            order = [*[o for o in range(k) if o != t], t]
            mean = m[0, 1:] / m[0, 0]
            cov = m[1:, 1:] / m[0, 0] - np.outer(mean, mean)
            slopes, intercept, _ = solve_centred(cov[np.ix_(order, order)], mean[order], alpha)
            open_ = gaps[:, t]
            after[open_, t + 1] = np.einsum("o,pox->px", slopes, maps[open_][:, [o + 1 for o in order[:-1]]])
            after[open_, t + 1, 0] += intercept
            step = after[open_, t + 1] - maps[open_, t + 1]
            moved = np.einsum("px,pxy,py->", step, sums[open_], step) / sums[open_, 0, 0].sum()
            still &= bool(np.sqrt(max(moved, 0.0)) <= tolerance * (sd[t] or 1.0))
        maps = after
        if still:
            break
    return maps


def _fill_by_passes(begun: DataFrame, names: Sequence[str], used: Sequence[str], rounds: int, alpha: float, tolerance: float) -> DataFrame:
    """The rounds of ``fill_iterative`` as passes over the rows, for any number of patterns."""
    from seriesloom.operators.stats import covariance, solve_centred
    from seriesloom.session import settled

    def lacks(c: str) -> Column:
        return F.substring("_gaps", names.index(c) + 1, 1) == "1"

    work = settled(begun)
    start = work.agg(*[F.stddev_pop(c).alias(f"sd_{c}") for c in used], *[F.count_if(lacks(c)).alias(f"n_{c}") for c in used], F.count("*").alias("n")).first()
    targets = [c for c in used if 0 < start[f"n_{c}"] < start["n"]]
    for _ in range(rounds if targets and len(used) > 1 else 0):
        present = F.filter(F.array(*[F.when(~lacks(c), F.lit(c)) for c in targets]), lambda t: t.isNotNull())
        rows = work.withColumn("_target", F.explode(present)).groupBy("_target").agg(
            F.array(*[F.avg(c) for c in used]).alias("means"),
            F.array(*[F.covar_pop(x, y) for x, y in combinations_with_replacement(used, 2)]).alias("covs"),
        )
        moments, update = {row["_target"]: row for row in rows.collect()}, {}
        for c in targets:
            order = [*[used.index(o) for o in used if o != c], used.index(c)]
            cov = covariance(moments[c].covs, len(used))[np.ix_(order, order)]
            slopes, intercept, _ = solve_centred(cov, np.array(moments[c].means)[order], alpha)
            value = F.lit(intercept)
            for o, slope in zip(order, slopes.tolist()):
                value = value + F.col(used[o]) * slope
            update[c] = F.when(lacks(c), value).otherwise(F.col(c))
        moved = {f"_move_{c}": F.when(lacks(c), F.pow(update[c] - F.col(c), 2)) for c in targets}
        work = settled(work.withColumns({**update, **moved}))
        steps = work.agg(*[F.sqrt(F.avg(f"_move_{c}")).alias(c) for c in targets]).first()
        work = work.drop(*moved)
        if all(steps[c] <= tolerance * (start[f"sd_{c}"] or 1.0) for c in targets):
            break
    return work


def clean(
    df: DataFrame,
    *,
    keys: Sequence[str],
    date: str,
    methods: Mapping[str, str] | None = None,
    cap: bool = True,
) -> DataFrame:
    """Fill every column by its method, then edge-fill and cap at 3 deviations.

    Without ``methods``: text columns take the mode, numeric ones are
    interpolated.  Methods: drop, mean, median, mode, forward, backward,
    interpolate, time, zero, knn, iterative, none.
    """
    plan = dict(methods or {})
    values = [f for f in df.schema.fields if f.name not in (*keys, date)]
    for f in values:
        plan.setdefault(f.name, "mode" if isinstance(f.dataType, T.StringType) else "interpolate")

    def using(method: str) -> list[str]:
        return [f.name for f in values if plan[f.name] == method]

    out = df
    if using("drop"):
        out = out.na.drop("any", subset=using("drop"))
    if using("zero"):
        out = fill_zero(out, using("zero"))
    # One column alone has no distances, so its k-nearest fill is the mean.
    knn = using("knn")
    if using("mean") or len(knn) == 1:
        out = fill_mean(out, keys=keys, cols=[*using("mean"), *(knn if len(knn) == 1 else [])])
    if using("median"):
        out = fill_median(out, keys=keys, cols=using("median"))
    if using("mode"):
        out = fill_mode(out, keys=keys, cols=using("mode"))
    if len(knn) > 1:
        out = fill_knn(out, keys=keys, date=date, cols=knn)
    if using("iterative"):
        out = fill_iterative(out, keys=keys, cols=using("iterative"))
    if using("forward"):
        out = fill_forward(out, keys=keys, date=date, cols=using("forward"))
    if using("backward"):
        out = fill_backward(out, keys=keys, date=date, cols=using("backward"))
    for method, by in (("interpolate", "position"), ("time", "time")):
        if using(method):
            out = interpolate(out, keys=keys, date=date, cols=using(method), by=by)
    rest = [f.name for f in values if plan[f.name] != "none"]
    w = series_window(keys, date)
    back = series_window(keys, F.col(date).desc())
    out = out.withColumns({c: filled_forward(c, w) for c in rest})
    out = out.withColumns({c: filled_forward(c, back) for c in rest})
    numeric = [c for c in numeric_columns(out, exclude=[*keys, date]) if c in rest]
    return cap_per_key(out, keys=keys, cols=numeric) if cap and numeric else out


def cap_per_key(df: DataFrame, *, keys: Sequence[str], cols: Sequence[str], z_limit: float = 3.0) -> DataFrame:
    """Cap at mean +- ``z_limit`` sample deviations of the series (panel grain)."""
    whole = Window.partitionBy(*keys)
    out = df.withColumns({f"_mean_{c}": F.avg(c).over(whole) for c in cols} | {f"_sd_{c}": F.stddev_samp(c).over(whole) for c in cols})

    def capped(c: str) -> Column:
        mean, reach = F.col(f"_mean_{c}"), F.col(f"_sd_{c}") * z_limit
        bounded = F.least(F.greatest(F.col(c), mean - reach), mean + reach)
        return F.when(F.col(c).isNull() | reach.isNull(), as_col(c)).otherwise(bounded)

    return out.withColumns({c: capped(c) for c in cols}).drop(*[f"_{s}_{c}" for c in cols for s in ("mean", "sd")])
