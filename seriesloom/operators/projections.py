"""Column subsets, guards, transforms and feature-name resolution."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.expressions import attach_row, finite, numeric_columns, ratio


def numeric_projection(df: DataFrame, *, keep: Sequence[str] = (), drop: Sequence[str] = ()) -> DataFrame:
    """The numeric columns by declared type, plus ``keep``, minus ``drop``."""
    return df.select(*keep, *numeric_columns(df, exclude=[*keep, *drop]))


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(subset) if subset else None)


def drop_empty_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop columns without any value.

    Which columns stay is schema, so it has to be known while planning: one
    aggregate of one count per column is collected, never a data row.
    """
    names = list(cols or df.columns)
    counts = df.agg(*[F.count(c).alias(c) for c in names]).first()
    return df.drop(*[c for c in names if counts[c] == 0])


def drop_near_constant(df: DataFrame, cols: Sequence[str], *, min_sd: float = 1e-8) -> DataFrame:
    """Drop columns whose sample deviation is below ``min_sd`` (one aggregate)."""
    sds = df.agg(*[F.stddev_samp(finite(F.col(c).cast("double"))).alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if sds[c] is None or sds[c] < min_sd])


def replace_infinite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Infinities and missing values become the finite mean (0 if there is none)."""
    means = df.agg(*[F.avg(finite(c)).alias(c) for c in cols])
    out = attach_row(df, means, "_mean")
    return out.withColumns({c: F.coalesce(finite(c), F.col(f"_mean.{c}"), F.lit(0.0)) for c in cols}).drop("_mean")


# name -> (expression, smallest value allowed, whether that value itself is allowed)
_TRANSFORMS = {
    "log": (F.ln, 0.0, False),
    "log1p": (F.log1p, -1.0, False),
    "sqrt": (F.sqrt, 0.0, True),
}


def transform_columns(df: DataFrame, transforms: Mapping[str, str]) -> DataFrame:
    """Add ``{transform}_{column}``.

    A column with any value outside the domain is refused: the new column then
    carries the untransformed values, decided by a per-column minimum that
    arrives as a scalar subquery.
    """
    mins = df.agg(*[F.min(c).alias(c) for c in transforms])
    out = attach_row(df, mins, "_min")
    added = {}
    for c, name in transforms.items():
        fn, bound, closed = _TRANSFORMS[name]
        low = F.col(f"_min.{c}")
        ok = low >= bound if closed else low > bound
        added[f"{name}_{c}"] = F.when(ok, fn(c)).otherwise(F.col(c))
    return out.withColumns(added).drop("_min")


def log1p_shifted(df: DataFrame, col: str) -> DataFrame:
    """Add ``log1p_{col}`` and the shift it used (``-min`` when negative), so
    that ``expm1_restored`` can undo both."""
    low = df.agg(F.min(col).alias("m"))
    out = attach_row(df, low, "_low")
    shift = F.when(F.col("_low.m") < 0, -F.col("_low.m")).otherwise(F.lit(0.0))
    return (
        out.withColumn(f"{col}_shift", shift)
        .withColumn(f"log1p_{col}", F.log1p(F.col(col) + F.col(f"{col}_shift")))
        .drop("_low")
    )


def expm1_restored(df: DataFrame, col: str, *, name: str | None = None) -> DataFrame:
    return df.withColumn(name or f"{col}_restored", F.expm1(f"log1p_{col}") - F.col(f"{col}_shift"))


def _boxcox(x: Column, lam: Column) -> Column:
    """``(x^lam - 1) / lam``, the logarithm at zero."""
    tiny = F.abs(lam) < 1e-12
    return F.when(tiny, F.ln(x)).otherwise((F.pow(x, lam) - 1) / F.when(tiny, F.lit(1.0)).otherwise(lam))


def boxcox_likelihood(df: DataFrame, col: str, lams: Sequence[float]) -> list[tuple[float, float]]:
    """``(lam, llf)`` of the given powers: one aggregate with one variance per power.

    Values are divided by their geometric mean first, which leaves the
    likelihood unchanged and keeps the powers close to one.  Missing values and
    values that are not positive stay out; without any value the list is empty.
    """
    positive = df.select(F.col(col).cast("double").alias("x")).filter("x > 0")
    base = positive.agg(F.avg(F.ln("x")).alias("g"))
    scaled = attach_row(positive, base, "_b").select(F.exp(F.ln("x") - F.col("_b.g")).alias("z"), F.col("_b.g").alias("g"))
    spreads = [F.var_pop(_boxcox(F.col("z"), F.lit(lam))) for lam in lams]
    row = scaled.agg(F.count("*").alias("n"), F.max("g").alias("g"), F.array(*spreads).alias("v")).first()
    if not row.n:
        return []
    return [(lam, -row.n * row.g - row.n / 2 * math.log(v) if v > 0 else math.inf) for lam, v in zip(lams, row.v)]


def _grid(middle: float, reach: float, step: float) -> list[float]:
    return [round(middle + i * step, 10) for i in range(-round(reach / step), round(reach / step) + 1)]


def _most_likely(rows: Sequence[tuple[float, float]]) -> float:
    return max(rows, key=lambda r: (r[1], -abs(r[0]), r[0]))[0]


def boxcox_grid(df: DataFrame, col: str, *, lo: float = -2.0, hi: float = 2.0, steps: int = 40) -> DataFrame:
    """Profile log-likelihood ``(lam, llf, stage)`` on a grid, then on a ten times
    finer grid around the best value; one aggregate each, no row is repeated."""
    step = (hi - lo) / steps
    coarse = boxcox_likelihood(df, col, [round(lo + i * step, 10) for i in range(steps + 1)])
    near = _most_likely(coarse) if coarse else None
    fine = boxcox_likelihood(df, col, [round(near + i * step / 10, 10) for i in range(-9, 10) if i]) if coarse else []
    rows = [(*r, stage) for stage, part in (("coarse", coarse), ("fine", fine)) for r in part]
    return df.sparkSession.createDataFrame(rows, "lam double, llf double, stage string")


def boxcox_lambda(df: DataFrame, col: str, *, lo: float = -2.0, hi: float = 2.0, digits: int = 3) -> float | None:
    """The power of largest likelihood, the one closest to zero on a tie, to
    ``digits`` decimals with one aggregate for each; None without a positive value."""
    best, reach = (lo + hi) / 2, (hi - lo) / 2
    for digit in range(1, digits + 1):
        step = 10.0**-digit
        rows = boxcox_likelihood(df, col, _grid(best, reach, step))
        if not rows:
            return None
        best, reach = _most_likely(rows), step
    return best


def boxcox_columns(df: DataFrame, cols: Sequence[str], *, digits: int = 3) -> DataFrame:
    """Add ``boxcox_{c}`` and ``boxcox_lambda_{c}``.

    A column with any value that is not positive, or with none at all, is
    refused: it is carried over untransformed, its power NULL.
    """
    mins = df.agg(*[F.min(F.col(c).cast("double")).alias(c) for c in cols]).first()
    added = {}
    for c in cols:
        refused = mins[c] is None or not mins[c] > 0
        lam = None if refused else boxcox_lambda(df, c, digits=digits)
        added[f"boxcox_{c}"] = F.col(c).cast("double") if lam is None else _boxcox(F.col(c).cast("double"), F.lit(lam))
        added[f"boxcox_lambda_{c}"] = F.lit(lam).cast("double")
    return df.withColumns(added)


def derived_features(
    df: DataFrame,
    *,
    averages: Mapping[str, Sequence[str]] | None = None,
    spreads: Mapping[str, tuple[str, str]] | None = None,
    relatives: Mapping[str, tuple[str, str]] | None = None,
    totals: Mapping[str, Sequence[str]] | None = None,
    scaled: Mapping[str, tuple[str, float]] | None = None,
    floors: Mapping[str, tuple[str, float]] | None = None,
) -> DataFrame:
    """Row arithmetic: mean of columns, a-b, a/b-1, sum, c*factor, floor."""

    def total(cols: Sequence[str]) -> Column:
        acc = F.col(cols[0])
        for c in cols[1:]:
            acc = acc + F.col(c)
        return acc

    out: dict[str, Column] = {}
    out |= {n: total(cs) / len(cs) for n, cs in (averages or {}).items()}
    out |= {n: F.col(a) - F.col(b) for n, (a, b) in (spreads or {}).items()}
    out |= {n: ratio(a, b) - 1 for n, (a, b) in (relatives or {}).items()}
    out |= {n: total(cs) for n, cs in (totals or {}).items()}
    out |= {n: F.col(c) * k for n, (c, k) in (scaled or {}).items()}
    out |= {n: F.greatest(F.col(c), F.lit(k)) for n, (c, k) in (floors or {}).items()}
    return df.withColumns(out)


def minmax_normalize(df: DataFrame, cols: Sequence[str], *, keys: Sequence[str] = ()) -> DataFrame:
    """Scale to [0, 1], over the table or within each key; a constant column
    gives NULL.  Extremes are pre-aggregated and joined back, so a key with
    many rows is not gathered in one task."""
    extremes = [F.min(c).alias(f"_lo_{c}") for c in cols] + [F.max(c).alias(f"_hi_{c}") for c in cols]
    if keys:
        out = df.join(df.groupBy(*keys).agg(*extremes), list(keys), "left")
        prefix = ""
    else:
        out = attach_row(df, df.agg(*extremes), "_x")
        prefix = "_x."

    def lo(c: str) -> Column:
        return F.col(f"{prefix}_lo_{c}")

    def hi(c: str) -> Column:
        return F.col(f"{prefix}_hi_{c}")

    scaled = {f"{c}_norm": ratio(F.col(c) - lo(c), hi(c) - lo(c)) for c in cols}
    out = out.withColumns(scaled)
    return out.drop(*[f"_{e}_{c}" for c in cols for e in ("lo", "hi")], "_x")


def resolve_features(
    df: DataFrame,
    wanted: Sequence[str],
    *,
    aliases: Mapping[str, str] | None = None,
    suffixes: Sequence[str] = (),
    keep: Sequence[str] = (),
    default: float = 0.0,
) -> DataFrame:
    """Give ``df`` the feature columns a model was trained on.

    Tried in turn for every wanted name: the column itself, its alias, the
    name with or without one of the suffixes, its ``log_`` twin, the default.
    """
    have = set(df.columns)
    aliases = aliases or {}

    def candidates(name: str):
        yield name
        if name in aliases:
            yield aliases[name]
        for s in suffixes:
            yield name + s
            if name.endswith(s):
                yield name.removesuffix(s)
        yield f"log_{name}"

    picked = []
    for name in wanted:
        source = next((c for c in candidates(name) if c in have), None)
        column = F.lit(default) if source is None else F.coalesce(F.col(source).cast("double"), F.lit(default))
        picked.append(column.alias(name))
    return df.select(*keep, *picked)
