"""Source declarations: what a file is called, typed and keyed by."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class SourceSpec:
    """One input.

    ``rename`` maps known headers to column names.  Where none of them occurs
    and ``positional`` is given, the first columns take those names by
    position and the others are dropped.
    """

    path: str
    format: str = "parquet"
    schema: T.StructType | None = None
    date_col: str | None = None
    date_format: str | None = None
    numeric_cols: Sequence[str] = ()
    rename: Mapping[str, str] = field(default_factory=dict)
    positional: Sequence[str] = ()
    options: Mapping[str, str] = field(default_factory=dict)
    required: bool = True


def normalise_header(df: DataFrame) -> DataFrame:
    """Lower-case, strip and underscore the column names."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def _rename(df: DataFrame, spec: SourceSpec) -> DataFrame:
    known = {old: new for old, new in spec.rename.items() if old in df.columns}
    if known:
        return df.withColumnsRenamed(known)
    if spec.rename and spec.positional:
        if len(df.columns) < len(spec.positional):
            raise ValueError(f"{spec.path}: expected at least {len(spec.positional)} columns")
        kept = df.columns[: len(spec.positional)]
        return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, spec.positional)])
    return df


def coerce_types(
    df: DataFrame,
    *,
    dates: Mapping[str, str | None] | None = None,
    numerics: Sequence[str] = (),
) -> DataFrame:
    """Casts that turn bad values into NULL instead of failing.

    ``dates`` maps a column to its pattern (None for ISO dates).
    """
    casts = {}
    for c, pattern in (dates or {}).items():
        text = F.col(c).cast("string")
        parsed = F.try_to_timestamp(text, F.lit(pattern)) if pattern else F.try_to_timestamp(text)
        casts[c] = parsed.cast("date")
    for c in numerics:
        value = F.col(c).try_cast("double")
        casts[c] = F.when(F.isnan(value), F.lit(None)).otherwise(value)
    return df.withColumns(casts) if casts else df


def standardize_dates(df: DataFrame, date: str, pattern: str | None = None) -> DataFrame:
    """Parse the date column and drop the rows where that fails.

    No sort is planned: order exists only inside the windows that need it.
    """
    return coerce_types(df, dates={date: pattern}).filter(F.col(date).isNotNull())


def read_source(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    reader = spark.read.format(spec.format).options(**spec.options)
    if spec.schema is not None:
        reader = reader.schema(spec.schema)
    df = normalise_header(_rename(reader.load(spec.path), spec))
    df = coerce_types(df, numerics=spec.numeric_cols)
    return standardize_dates(df, spec.date_col, spec.date_format) if spec.date_col else df


def load_sources(spark: SparkSession, specs: Mapping[str, SourceSpec]) -> dict[str, DataFrame]:
    """Open every declared source; an optional source may be absent or hold
    no rows and is then left out with a warning, a required one raises."""
    loaded = {}
    for name, spec in specs.items():
        try:
            df = read_source(spark, spec)
        except AnalysisException as error:
            if spec.required or "PATH_NOT_FOUND" not in str(error):
                raise
            log.warning("source %s: %s does not exist, skipped", name, spec.path)
            continue
        if not spec.required and df.isEmpty():
            log.warning("source %s: no rows, skipped", name)
            continue
        loaded[name] = df
    return loaded
