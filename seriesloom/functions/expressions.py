"""Null-safe column expressions shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NaN and both infinities become NULL."""
    c = as_col(c)
    return F.when(F.isnan(c) | c.isin(INF, -INF), F.lit(None)).otherwise(c)


def ratio(a: str | Column, b: str | Column) -> Column:
    """Division with NULL for a zero divisor."""
    return F.try_divide(as_col(a), as_col(b))


def rounded(c: str | Column, digits: int) -> Column:
    return F.round(as_col(c), digits)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns by declared type; never by looking at the data."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def round_columns(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Round the named columns, or every floating column when none is named."""
    names = cols or tuple(f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType)))
    return df.withColumns({c: F.round(c, digits) for c in names})


def melt(df: DataFrame, ids: list[str], cols: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Wide to long; the values are cast to double.  Written as a generator,
    which (unlike ``unpivot``) keeps the partitioning of its input."""
    rows = [F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols]
    return df.select(*ids, F.inline(F.array(*rows)))


def attach_row(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Add a one-row aggregate as a struct column through a scalar subquery.

    The aggregate runs once and reaches the tasks as a literal, so no join and
    no shuffle of ``df`` is planned.
    """
    packed = one_row.select(F.struct(*[F.col(c) for c in one_row.columns]).alias(name))
    return df.select("*", packed.scalar().alias(name))
