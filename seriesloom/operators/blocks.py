"""Running operators on series of any length: fills, interpolation, running means and products.

The plain forms order a whole series in one task.  Here the series is cut into blocks of
consecutive rows by an expression of its order (a month, a range of ids).  Each block is
reduced to its boundary state, combined before the shuffle: its last and first known
value, its number of rows, its sums.  The states of the blocks before (or after) a block
are scanned in the block table, which has one row a block, and the result enters the
block as one more row ahead of its own; running windows then stay inside blocks.  The
result is the same for every choice of blocks, and rows of a hot series are spread over
as many tasks as it has blocks.

Rows without a key form a series of their own, like any other key.  ``order`` should be
unique inside a series: rows that tie come in any order, as in the plain forms.  Columns
that start with ``_`` are kept for the operators.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seriesloom.functions.expressions import ratio
from seriesloom.functions.windows import series_window

_START = Window.unboundedPreceding


@dataclass(frozen=True)
class Carry:
    """A running value that crosses blocks.

    ``own`` is what a row adds, ``reduce`` the state of a block, ``scan`` puts together states, or a state and rows,
    in order; ``ahead`` tells whether states come from the blocks before (else from those after).
    """

    own: Column
    reduce: Column
    scan: Callable[[Column], Column]
    ahead: bool = True


def _latest(c: Column) -> Column:
    return F.last(c, ignorenulls=True)


def _place(order: Sequence[str]) -> Column:
    return F.struct(*order)


def _known(c: str, order: Sequence[str], ahead: bool) -> Carry:
    """The nearest known value before (or after) a row, its own included."""
    pick, at = (F.max_by if ahead else F.min_by), F.when(F.col(c).isNotNull(), _place(order))
    return Carry(F.col(c), pick(c, at), _latest, ahead)


def _total(value: Column) -> Carry:
    return Carry(value, F.sum(value), F.sum)


def _mirrored(order: Sequence[str]) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in order]


def _between(keys: Sequence[str], ahead: bool) -> WindowSpec:
    """Blocks before (or after) a block."""
    return series_window(keys, F.col("_block").asc() if ahead else F.col("_block").desc()).rowsBetween(_START, -1)


def running(df: DataFrame, carries: Mapping[str, Carry], *, keys: Sequence[str], order: Sequence[str], block: Column) -> DataFrame:
    """``df`` with a column for each of ``carries``: the running value up to each row, the row included."""
    rows = df.withColumn("_block", block)
    states = rows.groupBy(*keys, "_block").agg(*[c.reduce.alias(f"_{name}") for name, c in carries.items()])
    scanned = states.select(*keys, "_block", *[c.scan(F.col(f"_{name}")).over(_between(keys, c.ahead)).alias(f"_{name}") for name, c in carries.items()])
    own = rows.select(*df.columns, "_block", F.lit(1).alias("_kind"), *[c.own.alias(f"_{name}") for name, c in carries.items()])
    both = own.unionByName(scanned.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    ahead = series_window([*keys, "_block"], "_kind", *order).rowsBetween(_START, 0)
    back = series_window([*keys, "_block"], "_kind", *_mirrored(order)).rowsBetween(_START, 0)
    out = both.withColumns({f"_{name}": c.scan(F.col(f"_{name}")).over(ahead if c.ahead else back) for name, c in carries.items()})
    out = out.filter("_kind = 1")
    return out.select(*[c for c in df.columns if c not in carries], *[F.col(f"_{name}").alias(name) for name in carries])


def fill_forward(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], block: Column, cols: Sequence[str]) -> DataFrame:
    """Every gap takes the last known value before it; gaps at the start stay."""
    return running(df, {c: _known(c, order, True) for c in cols}, keys=keys, order=order, block=block).select(*df.columns)


def fill_backward(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], block: Column, cols: Sequence[str]) -> DataFrame:
    """Every gap takes the next known value; gaps at the end stay."""
    return running(df, {c: _known(c, order, False) for c in cols}, keys=keys, order=order, block=block).select(*df.columns)


def fill_both(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], block: Column, cols: Sequence[str], forward_first: bool = True) -> DataFrame:
    """Forward, then backward fill (or the other way round), in one pass over the rows."""
    carries = {f"{c}__{side}": _known(c, order, side == "f") for c in cols for side in "fb"}
    out = running(df, carries, keys=keys, order=order, block=block)
    first, then = ("f", "b") if forward_first else ("b", "f")
    return out.withColumns({c: F.coalesce(f"{c}__{first}", f"{c}__{then}") for c in cols}).select(*df.columns)


def positions(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], block: Column, name: str = "position") -> DataFrame:
    """Zero-based position of every row in its series."""
    out = running(df, {name: _total(F.lit(1).cast("long"))}, keys=keys, order=order, block=block)
    return out.withColumn(name, F.col(name) - 1)


def interpolate(
    df: DataFrame, *, keys: Sequence[str], order: Sequence[str], block: Column, cols: Sequence[str], by: str = "position"
) -> DataFrame:
    """Linear interpolation by row position, or by the days of the first column of ``order``.

    Interior gaps lie on the line between their neighbours, gaps at the end hold the last value, gaps at the start stay.
    """
    rows = df.withColumn("_here", block)
    if by == "position":
        rows = positions(rows, keys=keys, order=order, block=F.col("_here"), name="_at")
    else:
        rows = rows.withColumn("_at", F.unix_date(F.col(order[0]).cast("date")).cast("long"))
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(c).cast("double").alias("x"))) for c in cols}
    rows = rows.withColumns({f"_known_{c}": k for c, k in known.items()})
    carries = {f"_{side}_{c}": _known(f"_known_{c}", order, side == "prev") for c in cols for side in ("prev", "next")}
    out = running(rows, carries, keys=keys, order=order, block=F.col("_here"))

    def line(c: str) -> Column:
        prev, nxt = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        rise = ratio((nxt.x - prev.x) * (F.col("_at") - prev.at), nxt.at - prev.at)
        inner = F.when(nxt.isNull(), prev.x).otherwise(prev.x + rise)
        return F.when(F.col(c).isNotNull(), F.col(c)).otherwise(inner)

    return out.withColumns({c: line(c) for c in cols}).select(*df.columns)


def expanding_mean(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], block: Column, cols: Sequence[str]) -> DataFrame:
    """``df`` with ``{c}_exp_mean``: the mean of the known values up to each row."""
    carries = {f"{c}__sum": _total(F.col(c).cast("double")) for c in cols}
    carries |= {f"{c}__n": _total(F.when(F.col(c).isNotNull(), 1).cast("long")) for c in cols}
    out = running(df, carries, keys=keys, order=order, block=block)
    return out.select(*df.columns, *[(F.col(f"{c}__sum") / F.col(f"{c}__n")).alias(f"{c}_exp_mean") for c in cols])


def running_gram(df: DataFrame, xs: Sequence[str], y: str, *, keys: Sequence[str], order: Sequence[str], block: Column) -> DataFrame:
    """``df`` with the sufficient statistics of the complete rows up to each row: ``n``, sums ``s_*`` and products ``g_*_*``."""
    names = [*xs, y]
    whole = F.lit(True)
    for c in names:
        whole = whole & F.col(c).isNotNull()

    def part(value: Column) -> Carry:
        return _total(F.when(whole, value).otherwise(F.lit(0).cast("double")))

    carries = {"n": _total(whole.cast("long"))}
    carries |= {f"s_{c}": part(F.col(c).cast("double")) for c in names}
    carries |= {f"g_{a}_{b}": part(F.col(a).cast("double") * F.col(b).cast("double")) for a, b in combinations_with_replacement(names, 2)}
    return running(df, carries, keys=keys, order=order, block=block)
