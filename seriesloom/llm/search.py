"""Ranked search of many items at once, with what they have in common worked out once.

A document's score for an item is a sum over the item's terms, so any set of terms that
several items hold can be summed once and added to each of them.  Such sets are mined in
two ways: Spark groups the terms by the items that hold them (a class: one sum), then
classes that stand side by side in several items, in the order of how many items hold
them, are joined to larger sets, round by round, until no two items share a pair.  The
result is a graph of additions with one root an item.

Items are dealt to blocks of about ``block_terms`` terms; a block's terms and graph are
broadcast, so their size is bounded, and each block takes two scans of the documents.  The first
counts documents, words, and in how many documents each term of the block occurs.  The
second lays the partial sums of the classes of a batch of documents out as rows of a
table, adds along the graph and keeps the best of each item; the tasks' best are combined
in two steps, by a salt of the document first.  All documents are scored, and no (item,
document) pair leaves a task but the best.

Null and empty texts have no terms and are not counted; an item without terms has no
rows.  Rows that share an id are documents of their own, equal rows take a rank each; a
null document id comes after all others of its score.  Rows of one item id are one item.
Very long texts are read in stretches.  Further columns of either table are not read.
Without documents or items the result is empty.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import checkpointed, fold, small_batches
from seriesloom.llm.lexing import ALNUM, FOLD, stretches

TOP = 10
BLOCK_TERMS = 200_000
SALTS = 32
ROWS = 64
STRETCH = 1 << 22
PENDING = 1 << 18
TERM = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
NO_ID = np.iinfo(np.int64).max
_TABLE = bytes(int(FOLD[b]) if ALNUM[FOLD[b]] else 32 for b in range(256))
_GAP = re.compile(b" ")


@dataclass
class Graph:
    """Additions that lead from class sums to item sums.

    Node i below ``classes`` is the sum of a class of terms, node ``classes + j`` is ``left[j] + right[j]``; the
    additions of ``levels[k] : levels[k + 1]`` only need nodes before them.  ``roots`` holds a node for each item.
    """

    classes: int
    left: np.ndarray
    right: np.ndarray
    levels: list[int]
    roots: np.ndarray

    def sums(self, parts: np.ndarray) -> np.ndarray:
        """Item sums, a row an item, from class sums, a row a class."""
        nodes = np.empty((self.classes + len(self.left), parts.shape[1]), np.int64)
        nodes[: self.classes] = parts
        for a, b in zip(self.levels[:-1], self.levels[1:], strict=True):
            nodes[self.classes + a : self.classes + b] = nodes[self.left[a:b]] + nodes[self.right[a:b]]
        return nodes[self.roots]


def share(holders: list[list[int]], items: int) -> Graph:
    """The graph of additions for items that hold classes; ``holders`` are the items of each class."""
    held: list[list[int]] = [[] for _ in range(items)]
    for node in sorted(range(len(holders)), key=lambda c: (-len(holders[c]), holders[c], c)):
        for item in holders[node]:
            held[item].append(node)
    pairs: list[tuple[int, int]] = []
    support = {node: len(own) for node, own in enumerate(holders)}

    def joined(own: list[int], wanted, known: dict[tuple[int, int], int]) -> list[int]:
        out, i = [], 0
        while i < len(own):
            pair = tuple(own[i : i + 2])
            if len(pair) == 2 and wanted(pair):
                if pair not in known:
                    known[pair] = len(holders) + len(pairs)
                    pairs.append(pair)
                out.append(known[pair])
                i += 2
            else:
                out.append(own[i])
                i += 1
        return out

    known: dict[tuple[int, int], int] = {}
    while True:  # sets that several items share
        seen = Counter(pair for own in held for pair in zip(own, own[1:]))  # noqa: B905
        if not any(n > 1 for n in seen.values()):
            break
        held = [joined(own, lambda pair: seen[pair] > 1, known) for own in held]  # noqa: B023
        support.update(Counter(node for own in held for node in own))
        held = [sorted(own, key=lambda node: (-support[node], node)) for own in held]
    while any(len(own) > 1 for own in held):  # what is left of each item
        held = [joined(own, lambda pair: True, known) for own in held]
    return _levelled(len(holders), pairs, [own[0] if own else 0 for own in held])


def _levelled(classes: int, pairs: list[tuple[int, int]], roots: list[int]) -> Graph:
    depth = [0] * classes
    for a, b in pairs:
        depth.append(1 + max(depth[a], depth[b]))
    order = sorted(range(len(pairs)), key=lambda j: depth[classes + j])
    place = np.arange(classes + len(pairs))
    for at, j in enumerate(order):
        place[classes + j] = classes + at
    sides = place[np.array([pairs[j] for j in order], np.int64).reshape(-1, 2)]
    counts = Counter(depth[classes:])
    levels = np.cumsum([0] + [counts[d] for d in sorted(counts)]).tolist()
    return Graph(classes, sides[:, 0], sides[:, 1], levels, place[np.array(roots, np.int64)])


@dataclass
class Block:
    """Items of a block: their ids, the number and class of each term, and the graph."""

    items: list[str | None]
    terms: dict[bytes, int]
    of_class: np.ndarray
    graph: Graph


@dataclass
class Weights:
    """What the first scan found: documents, words, and the weight of each term."""

    documents: int
    words: int
    weight: np.ndarray


def _item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    found = items.select(items[item_id].cast("string").alias("item"), F.explode(F.regexp_extract_all(fold(items[text]), F.lit(TERM), 0)).alias("term"))
    return checkpointed(found.distinct())


def _blocks(terms: DataFrame, block_terms: int) -> Iterator[Block]:
    blocks = max(1, math.ceil(terms.count() / block_terms))
    if blocks > 1:  # the blocks vary about their mean
        blocks += 1 + blocks // 10
    for k in range(blocks):
        part = terms.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        same = part.groupBy("term").agg(F.array_sort(F.collect_set(F.struct("item"))).alias("items")).groupBy("items").agg(F.collect_list("term").alias("terms"))
        rows = same.collect()
        if not rows:
            continue
        names = sorted({r.item for row in rows for r in row["items"]}, key=lambda x: (x is None, x or ""))
        number = {name: i for i, name in enumerate(names)}
        holders = [sorted(number[r.item] for r in row["items"]) for row in rows]
        known = {term.encode(): i for i, term in enumerate(t for row in rows for t in row["terms"])}
        of_class = np.repeat(np.arange(len(rows)), [len(row["terms"]) for row in rows])
        yield Block(names, known, of_class, share(holders, len(names)))


def term_counts(text: bytes, known: dict[bytes, int]) -> tuple[int, list[int], list[int]]:
    """Number of terms of a text, and which of the known terms occur how often."""
    seen: Counter = Counter()
    n = 0
    for part in stretches(text.translate(_TABLE), _GAP, STRETCH):
        words = part.split()
        n += len(words)
        seen.update(words)
    common = known.keys() & seen.keys()
    return n, [known[t] for t in common], [seen[t] for t in common]


def _statistics(texts: DataFrame, block) -> Weights:
    """First scan: N, L and the document frequency of each term of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = block.value.terms
        total, df = np.zeros(2, np.int64), np.zeros(len(known), np.int64)
        for batch in batches:
            for text in batch.column(1):
                n, terms, _ = term_counts(text.as_py(), known)
                df[terms] += 1
                total += (n > 0, n)
        own = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, own]), pa.array(np.r_[total, df[own]])], ["k", "n"])

    sums = texts.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    found = dict(sums.toPandas().itertuples(index=False))
    documents, words = int(found.get(-2, 0)), int(found.get(-1, 0))
    df = (int(found.get(k, 0)) for k in range(len(block.value.terms)))
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df]
    return Weights(documents, words, np.array(weight, np.int64))


class _Best:
    """Best documents of each item so far."""

    def __init__(self, items: int, top: int):
        self.top, self.rows, self.bar, self.size = top, [], np.ones(items, np.int64), 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.bar[:, None])
        self.rows.append((item, scores[item, doc], ids[doc]))
        self.size += len(item)
        if self.size > PENDING:
            self.tidy()

    def tidy(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        item, score, doc = (np.concatenate(x) for x in zip(*self.rows, strict=True)) if self.rows else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        first = np.searchsorted(item, np.arange(len(self.bar)))
        rank = np.arange(len(item)) - first[item]
        self.bar[item[rank == self.top - 1]] = score[rank == self.top - 1]
        kept = rank < self.top
        self.rows, self.size = [(item[kept], score[kept], doc[kept])], int(kept.sum())
        return self.rows[0]


def scores(block: Block, found: Weights, counts: list[tuple[int, list[int], list[int]]]) -> np.ndarray:
    """Scores of some documents, a row an item."""
    n = np.array([c[0] for c in counts], np.int64)
    doc = np.repeat(np.arange(len(counts)), [len(c[1]) for c in counts])
    term = np.array([t for c in counts for t in c[1]], np.int64)
    tf = np.array([t for c in counts for t in c[2]], np.int64)
    parts = np.zeros((block.graph.classes, len(counts)), np.int64)
    if len(term):
        m = 100 - 90 + (90 * n * found.documents) // found.words
        own = found.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        cell = block.of_class[term] * len(counts) + doc
        order = np.argsort(cell, kind="stable")
        cell, own = cell[order], own[order]
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        parts.reshape(-1)[cell[starts]] = np.add.reduceat(own, starts)
    return block.graph.sums(parts)


def _scan(texts: DataFrame, block, found: Weights, top: int) -> DataFrame:
    """Second scan: the best documents of each item among those of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = block.value
        best = _Best(len(own.items), top)
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, ROWS):
                counts = [term_counts(t.as_py(), own.terms) for t in batch.column(1).slice(at, ROWS)]
                best.add(scores(own, found, counts), ids[at : at + ROWS])
        item, score, doc = best.tidy()
        names = [own.items[i] for i in item.tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(doc, pa.int64(), mask=doc == NO_ID), pa.array(score, pa.int64())], ["item", "doc_id", "score"]
        )

    return texts.mapInArrow(run, "item string, doc_id long, score long")


def ranked(
    docs: DataFrame, items: DataFrame, *, doc_id="doc_id", text="text", item_id="item_id", item_text="text", top: int = TOP, block_terms: int = BLOCK_TERMS, salts: int = SALTS
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.encode(F.coalesce(docs[text], F.lit("")), "utf-8").alias("text"))
    best = spark.createDataFrame([], "item string, doc_id long, score long")
    for own in _blocks(_item_terms(items, item_id, item_text), block_terms):
        block = spark.sparkContext.broadcast(own)
        found = _statistics(texts, block)
        if found.words:
            best = best.unionByName(checkpointed(_scan(texts, block, found, top)))
        block.destroy()
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    best = best.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)
    return best.select(F.col("item").cast(items.schema[item_id].dataType).alias("item_id"), "rank", "doc_id", "score")
