"""Exact quantiles of whole columns without holding a column in one task.

The built-in ``percentile`` keeps every distinct value of a group in a single
aggregation buffer.  That is right for one series of a panel, whose length the
calendar bounds, but not for a column of a row-level table.  Here the wanted
order statistics are narrowed down by histograms, all columns in one job:

1. counts and extremes of logarithmic bins over the whole column;
2. the same for linear bins inside each bin that holds a wanted rank, repeated
   until its smallest and largest value agree.

Each pass is a column-pruned scan with a map-side combined aggregate, and its
size depends on the number of bins, not of rows.  Every linear pass separates
the extremes of a bin, so the result always is exact; two or three passes are
usual.  Like ``DataFrame.approxQuantile`` this is an action.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.expressions import finite, melt

LOG_BINS_PER_UNIT = 256
LINEAR_BINS = 4096


@dataclass
class _Rank:
    """Order statistic number ``k`` (0-based) among the values in [lo, hi]."""

    metric: str
    k: int
    lo: float = -math.inf
    hi: float = math.inf

    def narrow(self, bins) -> None:
        """Move to the bin that holds the rank; ``bins`` are in value order."""
        for b in bins:
            if self.k < b.n:
                self.lo, self.hi = b.lo, b.hi
                return
            self.k -= b.n


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, dict[float, float | None]]:
    """``{column: {p: value}}``, linear between order statistics, None if empty."""
    long = melt(df, [], list(cols), "metric", "x").withColumn("x", finite("x")).filter(F.col("x").isNotNull())
    measures = [F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")]

    log_bin = F.floor(F.signum("x") * F.log1p(F.abs("x")) * LOG_BINS_PER_UNIT)
    rows = long.groupBy("metric", log_bin.alias("bin")).agg(*measures).orderBy("metric", "bin").collect()
    histogram = {c: [b for b in rows if b.metric == c] for c in cols}
    total = {c: sum(b.n for b in histogram[c]) for c in cols}

    wanted = {}
    for c in cols:
        for p in probs if total[c] else ():
            place = p * (total[c] - 1)
            wanted[c, p] = (_Rank(c, math.floor(place)), _Rank(c, math.ceil(place)), place - math.floor(place))
    ranks = [rank for low, high, _ in wanted.values() for rank in (low, high)]
    for rank in ranks:
        rank.narrow(histogram[rank.metric])

    while pending := [rank for rank in ranks if rank.lo < rank.hi]:
        spans = sorted({(rank.metric, rank.lo, rank.hi) for rank in pending})
        which, bin_ = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, (metric, lo, hi) in enumerate(spans):
            inside = (F.col("metric") == metric) & F.col("x").between(lo, hi)
            which = F.when(inside, F.lit(i)).otherwise(which)
            share = (F.col("x") / 2 - lo / 2) / (hi / 2 - lo / 2)  # halves: the span may overflow
            linear = F.when(F.col("x") == hi, F.lit(LINEAR_BINS)).otherwise(
                F.least(F.greatest(F.floor(share * LINEAR_BINS), F.lit(0)), F.lit(LINEAR_BINS - 1))
            )
            bin_ = F.when(inside, linear).otherwise(bin_)
        spread = long.select("x", which.alias("span"), bin_.alias("bin")).filter(F.col("span").isNotNull())
        rows = spread.groupBy("span", "bin").agg(*measures).orderBy("span", "bin").collect()
        bins = {span: [b for b in rows if b.span == i] for i, span in enumerate(spans)}
        for rank in pending:
            rank.narrow(bins[rank.metric, rank.lo, rank.hi])

    found: dict[str, dict[float, float | None]] = {c: dict.fromkeys(probs) for c in cols}
    for (c, p), (low, high, frac) in wanted.items():
        found[c][p] = low.lo + (high.lo - low.lo) * frac
    return found
