"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the bytes and words of the whole text alone.  The trees are
grown in numpy on a bounded sample of labelled documents (``max_rows``) and kept
as flat arrays: scoring walks all trees of all documents of a batch at once.

Null and empty texts have all-zero statistics and get the score the trees give
those.  A document with several labels counts with their mean; rows without a
label are not learned from.  With no usable label at all every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import held_out, share_of, small_batches, utf8
from seriesloom.llm.lexing import SPACED, mix, windows, words

MAX_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 80, 4, 48, 0.15
CUTOFF = 0.3

#: Byte classes: 0 other, then lower, upper, digit, white space, beyond ASCII, and single marks.
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[32, 9, 11, 12, 13]] = 4
_CLASS[128:] = 5
_MARKS = b"!#$%&*|.,:;<>/\"'()[]{}=_-@+\n"
_CLASS[list(_MARKS)] = 6 + np.arange(len(_MARKS))
_CLASSES = 6 + len(_MARKS)


def _distinct(value: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    _, index = np.unique(mix(value ^ mix(owner.astype(np.uint64) + np.uint64(1))), return_index=True)
    return np.bincount(owner[index], minlength=n)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of numbers per text."""
    data, starts = utf8(column)
    n = len(starts) - 1
    size = np.diff(starts).astype(np.float64)
    owner = np.repeat(np.arange(n), np.diff(starts))
    classes = np.bincount(owner * _CLASSES + _CLASS[data], minlength=n * _CLASSES).reshape(n, _CLASSES) / np.maximum(size, 1)[:, None]
    w = words(data, starts, SPACED)
    count = np.diff(w.first).astype(np.float64)
    many = np.maximum(count, 1)
    of = w.owner()
    length = (w.end - w.start).astype(np.float64)
    mean = np.bincount(of, length, n) / many
    spread = np.sqrt(np.maximum(np.bincount(of, length**2, n) / many - mean**2, 0))
    pairs, inside = windows(w, 2)
    pair_of = of[: len(pairs)]
    repeated = np.bincount(pair_of[(w.value[: len(pairs)] == w.value[1 : len(pairs) + 1]) & inside], minlength=n) / many
    last = w.data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    ends_marked = np.bincount(of[(_CLASS[last] >= 6) & (last != 46) & (last != 44)], minlength=n) / many
    newline = np.ones(256, bool)
    newline[10] = False
    lines = words(data, starts, newline)
    line_count = np.maximum(np.diff(lines.first), 1)
    return np.column_stack(
        [
            np.log1p(size),
            np.log1p(count),
            mean,
            spread,
            np.bincount(of[length <= 2], minlength=n) / many,
            np.bincount(of[length >= 14], minlength=n) / many,
            _distinct(w.value, of, n) / many,
            _distinct(pairs[inside], pair_of[inside], n) / many,
            repeated,
            ends_marked,
            count / line_count,
            _distinct(lines.value, lines.owner(), n) / line_count,
            classes,
        ]
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Forest:
    """Complete trees of one depth: node k has children 2k + 1 and 2k + 2."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        depth = self.leaf.shape[1].bit_length() - 1
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += leaf[node - len(feature)]
        return _sigmoid(total)


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Forest:
    """Boost ``trees`` trees on logistic loss; splits are looked for among ``bins`` quantiles of a feature."""
    inner = 2**depth - 1
    if not len(y):
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)])
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    start = float(np.log(share / (1 - share)))
    margin = np.full(len(y), start)
    feature, limit, leaves = [], [], []
    for _ in range(trees):
        p = _sigmoid(margin)
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        tree_feature, tree_limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            base, width = 2**level - 1, 2**level
            best = np.full(width, 1e-3)
            at = node - base
            for j, cut in enumerate(edges):
                key = at * bins + binned[:, j]
                gs = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(axis=1)
                hs = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(axis=1)
                all_g, all_h = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (all_g - gs) ** 2 / (all_h - hs + 1) - all_g**2 / (all_h + 1)
                gain[(hs < 2) | (all_h - hs < 2)] = 0
                k = gain[:, : len(cut)].argmax(axis=1) if len(cut) else np.zeros(width, np.int64)
                top = gain[np.arange(width), k] if len(cut) else np.zeros(width)
                for i in np.flatnonzero(top > best):
                    best[i], tree_feature[base + i], tree_limit[base + i] = top[i], j, cut[k[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), tree_feature[node]] > tree_limit[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + 1)
        margin += leaf[at]
        feature.append(tree_feature)
        limit.append(tree_limit)
        leaves.append(leaf)
    return Forest(np.array(feature), np.array(limit), np.array(leaves), start)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pa.array(list(statistics(batch.column(1))), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), rows], ["id", "x"])


def fit(docs: DataFrame, labels: DataFrame, *, doc_id="doc_id", text="text", label="quality", max_rows: int = MAX_ROWS) -> Forest:
    """Learn from labelled documents that are not held out; about ``max_rows`` of them, chosen by a hash of the id."""
    small_batches(docs.sparkSession)
    usable = labels.filter(labels[label].isNotNull() & ~held_out(labels[doc_id]))
    share = min(1.0, max_rows / max(usable.count(), 1))
    known = usable.filter(share_of(labels[doc_id].cast("long"), share)).groupBy(labels[doc_id].cast("long").alias("id")).agg(F.avg(labels[label]).alias("y"))
    key = docs[doc_id].cast("long")
    texts = docs.filter(~held_out(docs[doc_id]) & share_of(key, share)).select(key.alias("id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    rows = texts.mapInArrow(_measure, "id long, x array<double>").join(known, "id").select("id", "x", (F.col("y") >= 0.5).cast("double").alias("y"))
    sample = rows.toArrow()
    if not sample.num_rows:
        return grow(np.zeros((0, 1)), np.zeros(0))
    x = sample["x"].combine_chunks().flatten().to_numpy().reshape(sample.num_rows, -1)
    y = sample["y"].to_numpy()
    order = np.lexsort((y, *x.T, sample["id"].to_numpy()))
    return grow(x[order], y[order])


def scorer(spark, forest: Forest):
    """Column function from a text to its score."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(forest)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield pa.array(shared.value.score(statistics(column)), pa.float64())

    return score.asNondeterministic()


def score_quality(docs: DataFrame, labels: DataFrame, *, doc_id="doc_id", text="text", cutoff: float = CUTOFF, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    score = scorer(docs.sparkSession, fit(docs, labels, doc_id=doc_id, text=text, **options))
    scored = docs.select(docs[doc_id].alias("doc_id"), held_out(docs[doc_id]).alias("held_out"), score(F.coalesce(docs[text], F.lit(""))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, *, doc_id="doc_id", text="text", cutoff: float = CUTOFF, **options) -> DataFrame:
    """Columns of ``docs``, without the rows whose score is below ``cutoff``."""
    score = scorer(docs.sparkSession, fit(docs, labels, doc_id=doc_id, text=text, **options))
    return docs.withColumn("__score", score(F.coalesce(docs[text], F.lit("")))).filter(F.col("__score") >= cutoff).select(*docs.columns)
