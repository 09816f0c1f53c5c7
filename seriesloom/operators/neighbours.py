"""Filling by nearest rows for series of any number of rows.

``impute.fill_knn`` compares all rows of a series and is exact; its cost is
quadratic in the series.  Here rows are put in order along each column and along random
directions that leave one column out, and are compared only with the rows of their
own and the two adjoining blocks of an order.  A row looks for neighbours in the orders
whose columns it has; there distances only shrink under projection, so near rows
stay close.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.impute import _fill_with
from seriesloom.session import settled

ROWS = 64  # whose distances are worked on at once


def _directions(columns: int, orders: int, seed: int) -> np.ndarray:
    """One row of weights an order: every column alone, then ``orders`` random
    directions over the others for every column left out."""
    random = np.random.default_rng(seed).normal(size=(orders * columns if columns > 2 else 0, columns))
    random[np.arange(len(random)), np.arange(len(random)) % columns] = 0.0
    return np.vstack([np.eye(columns), random / np.linalg.norm(random, axis=1, keepdims=True)])


def _first(dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` smallest finite cells of every row, by size, then column."""
    if dist.shape[1] > k:
        last = np.partition(dist, k - 1, axis=1)[:, k - 1 : k]
        r, c = np.nonzero((dist <= last) & (dist < np.inf))
    else:
        r, c = np.nonzero(dist < np.inf)
    order = np.lexsort((c, dist[r, c], r))
    r, c = r[order], c[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    return r[rank < k], c[rank < k]


def _open(own: pd.DataFrame, names: Sequence[str], weighs: np.ndarray) -> np.ndarray:
    """Places of the rows that have a missing cell and all columns their order ``weighs``."""
    lacks = own[names].isna().to_numpy()
    return np.flatnonzero(lacks.any(axis=1) & ~(lacks & weighs[own["_order"].to_numpy()]).any(axis=1))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance of every row of ``x`` to every row of ``y``; infinite where they share no column."""
    mine, theirs = ~np.isnan(x), ~np.isnan(y)
    square = np.zeros((len(x), len(y)))
    if np.isinf(x).any() or np.isinf(y).any():  # equal infinite values have no difference
        shared = np.zeros(square.shape)
        for j in range(x.shape[1]):
            with np.errstate(invalid="ignore"):
                step = x[:, j, None] - y[None, :, j]
            both = ~np.isnan(step)
            shared += both
            square += np.where(both, step, 0.0) ** 2
    else:
        shared = mine.astype(float) @ theirs.T.astype(float)
        filled, known = np.where(theirs, y, 0.0), theirs.astype(float)
        for j in range(x.shape[1]):
            has = np.flatnonzero(mine[:, j])
            step = x[has, j, None] - filled[None, :, j]
            step *= step
            step *= known[None, :, j]
            square[has] += step
    square *= x.shape[1]
    square /= np.maximum(shared, 1)
    return np.where(shared > 0, np.round(square, 9), np.inf)


def _nearest(own: pd.DataFrame, around: pd.DataFrame, names: Sequence[str], k: int, weighs: np.ndarray) -> pa.RecordBatch:
    """Up to ``k`` nearest rows of ``around`` for every missing cell of those rows of
    ``own`` that have all columns their order ``weighs``: a list a cell."""
    around = around.sort_values(["_at", "_id"], kind="stable")
    open_ = _open(own, names, weighs)
    x, y, ids = own[names].to_numpy(float)[open_], around[names].to_numpy(float), own["_id"].to_numpy()[open_]
    groups = pd.factorize(np.concatenate((own["_group"].to_numpy()[open_], around["_group"].to_numpy())))[0]
    at, number = around["_at"].to_numpy(), around["_id"].to_numpy()
    donors = [np.flatnonzero(~np.isnan(y[:, j])) for j in range(len(names))]
    cells, counts, found = [], [], []
    for a in range(0, len(x), ROWS):
        some = x[a : a + ROWS]
        dist = _distances(some, y)
        if groups.any():
            dist[groups[a : a + len(some), None] != groups[None, len(x) :]] = np.inf
        for j, given in enumerate(donors):
            rows = np.flatnonzero(np.isnan(some[:, j]))
            d = dist[rows][:, given]
            r, c = _first(d, k)
            n = np.bincount(r, minlength=len(rows))
            cells.append((ids[a + rows[n > 0]], np.full((n > 0).sum(), j, np.int32)))
            counts.append(n[n > 0])
            found.append((d[r, c], at[given[c]], number[given[c]], y[given[c], j]))
    near = pa.StructArray.from_arrays([pa.array(np.concatenate(f)) for f in zip(*found, strict=True)], ["dist", "at", "donor", "value"])
    ends = np.r_[0, np.cumsum(np.concatenate(counts))].astype(np.int32)
    cell = [pa.array(np.concatenate(f)) for f in zip(*cells, strict=True)]
    return pa.RecordBatch.from_arrays([*cell, pa.ListArray.from_arrays(ends, near)], ["_id", "_col", "near"])


def _sweep(names: Sequence[str], k: int, block: int, weighs: np.ndarray):
    """Rows of a partition in order, a block at a time between its neighbours; at
    most three blocks and one batch are held."""

    def found(before: pd.DataFrame | None, own: pd.DataFrame, after: pd.DataFrame | None) -> Iterator[pa.RecordBatch]:
        if len(_open(own, names, weighs)):  # most blocks only hold rows that look elsewhere
            yield _nearest(own, pd.concat([b for b in (before, own, after) if b is not None]), names, k, weighs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, own, rest = None, None, []
        for batch in batches:
            rest.append(batch.to_pandas())
            if sum(map(len, rest)) < block:
                continue
            waiting, at = pd.concat(rest), 0
            while len(waiting) - at >= block:
                after, at = waiting.iloc[at : at + block], at + block
                if own is not None:
                    yield from found(before, own, after)
                before, own = own, after
            rest = [waiting.iloc[at:]]
        last = pd.concat(rest) if rest else None
        if last is not None and not len(last):
            last = None
        if own is not None:
            yield from found(before, own, last)
        if last is not None:
            yield from found(own, last, None)

    return run


def block_neighbours(numbered: DataFrame, *, keys: Sequence[str], date: str, cols: Sequence[str], k: int, block: int, orders: int, seed: int) -> DataFrame:
    """``(_id, near)``: for every row with a missing cell, per column, the ``k``
    nearest rows found as ``(dist, at, donor, value)``.

    ``numbered`` has the number ``_id`` and the filled columns ``_full_{c}``.  Range
    partitions cut a long series into many tasks.  What leaves a task is ``k`` rows a
    missing cell and order.
    """
    names = list(cols)
    directions = _directions(len(names), orders, seed)

    def place(direction: np.ndarray) -> Column:
        total = F.lit(0.0)
        for c, weight in zip(names, direction.tolist()):
            total = total + F.coalesce(F.col(f"_full_{c}"), F.lit(0.0)) * weight
        return total

    places = F.array(*[place(d) for d in directions])
    group = F.concat_ws("/", F.to_json(F.struct(*keys)) if keys else F.lit(""), F.col("_order"))
    placed = numbered.select(*keys, "_id", F.unix_micros(F.col(date).cast("timestamp")).alias("_at"), *names, F.posexplode(places).alias("_order", "_place"))
    placed = placed.select(group.alias("_group"), "_order", "_place", "_id", F.coalesce("_at", F.lit(-(2**62))).alias("_at"), *names)
    tasks = int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(tasks, "_group", "_place", "_id").sortWithinPartitions("_group", "_place", "_id")
    cell = "array<struct<dist: double, at: long, donor: long, value: double>>"
    found = ordered.mapInArrow(_sweep(names, k, block, directions != 0), f"_id long, _col int, near {cell}")

    def nearest(j: int) -> Column:
        seen = F.flatten(F.collect_list(F.when(F.col("_col") == j, F.col("near"))))
        return F.slice(F.array_sort(F.array_distinct(seen)), 1, k)

    return found.groupBy("_id").agg(F.array(*[nearest(j) for j in range(len(names))]).alias("near"))


def fill_knn_blocks(
    df: DataFrame,
    *,
    keys: Sequence[str] = (),
    date: str,
    cols: Sequence[str],
    k: int = 5,
    block: int = 512,
    orders: int = 1,
    seed: int = 42,
) -> DataFrame:
    """Mean of the ``k`` nearest rows found that hold the value, as ``fill_knn`` but
    for series of any number of rows (the whole table without ``keys``).

    Distances, ties (earlier date) and the column mean for rows that share no column
    with a donor are those of ``fill_knn``.  A row is in one order for every column and
    in ``orders`` more for every column left out; neighbours are those of all its orders
    together, each exact inside three blocks of ``block`` rows, so a series inside
    one such stretch is filled exactly.  A column without any value in a series stays
    NULL; repeated rows count as rows of their own.
    """
    names = list(cols)
    numbered = settled(df.withColumns({c: F.col(c).cast("double") for c in names}).withColumn("_id", F.monotonically_increasing_id()))
    full = _fill_with(numbered.withColumns({f"_full_{c}": F.col(c) for c in names}), keys, {f"_full_{c}": F.avg(c) for c in names})
    near = block_neighbours(full, keys=keys, date=date, cols=names, k=k, block=block, orders=orders, seed=seed)
    joined = full.join(near.withColumnRenamed("_id", "_of"), F.col("_id") == F.col("_of"), "left")

    def value(j: int, c: str) -> Column:
        rows = F.col("near")[j]
        mean = F.try_divide(F.aggregate(rows, F.lit(0.0), lambda a, r: a + r["value"]), F.size(rows).cast("double"))
        return F.coalesce(F.col(c), mean, F.col(f"_full_{c}"))

    return joined.withColumns({c: value(j, c) for j, c in enumerate(names)}).select(*df.columns)
