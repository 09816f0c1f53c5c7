"""Benchmark decontamination by a broadcast hash set of n-grams.

Windows of ten consecutive words of the benchmark items (a shorter item is one
window) are hashed; documents are scanned for the hashes in one vectorised pass,
and every hit is verified by comparing its words.  One broadcast holds at most
``max_windows`` rows; a larger benchmark is cut into blocks of windows, each with
its own broadcast and scan, and a document's findings are put together after.

Null and empty texts and items have no words: nothing hits.  Items that share an
id count once; a null item id is left out of the item list but still hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm.common import checkpointed, small_batches, utf8
from seriesloom.llm.lexing import ALNUM, Words, windows, words

WINDOW = 10
MAX_WINDOWS = 400_000
_SIFT_BITS = 22
FOUND = "n_words long, spans array<int>, items array<string>"


def _phrase(w: Words, i: int, length: int) -> bytes:
    return b" ".join(w.data[s:e].tobytes() for s, e in zip(w.start[i : i + length], w.end[i : i + length], strict=True))


def _item_windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = words(*utf8(batch.column(1)), ALNUM)
            ids, sizes, hashes, phrases = [], [], [], []
            for item, a, b in zip(batch.column(0).to_pylist(), w.first[:-1], w.first[1:], strict=True):
                size = int(min(length, b - a))
                if not size:
                    continue
                part = Words(w.data, w.start[a:b], w.end[a:b], w.value[a:b], np.array([0, b - a]))
                for i, value in enumerate(windows(part, size)[0].astype(np.int64)):
                    ids.append(item)
                    sizes.append(size)
                    hashes.append(int(value))
                    phrases.append(_phrase(part, i, size))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.int64()), pa.array(phrases, pa.binary())],
                ["item", "size", "hash", "phrase"],
            )

    return run


class _Block:
    """Windows of one block, by length: sorted hashes, their phrases and items, and a sieve of hash bits."""

    def __init__(self, rows: list):
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, list[dict[bytes, list[str]]]]] = {}
        for size in {r["size"] for r in rows}:
            own: dict[int, dict[bytes, list[str]]] = {}
            for r in rows:
                if r["size"] == size:
                    items = own.setdefault(r["hash"] % 2**64, {}).setdefault(bytes(r["phrase"]), [])
                    if r["item"] is not None:
                        items.append(r["item"])
            keys = np.array(sorted(own), np.uint64)
            sieve = np.zeros(1 << _SIFT_BITS, bool)
            sieve[keys >> np.uint64(64 - _SIFT_BITS)] = True
            self.by_size[size] = keys, sieve, [own[int(k)] for k in keys]

    def scan(self, column: pa.Array) -> tuple[np.ndarray, list[list[int]], list[list[str]]]:
        """Words of each text, its hit words as spans [start, end, start, ...] and the items found."""
        w = words(*utf8(column), ALNUM)
        edge = np.zeros(len(w.value) + 1, np.int32)
        items: list[set[str]] = [set() for _ in range(w.texts())]
        for size, (keys, sieve, phrases) in self.by_size.items():
            value, whole = windows(w, size)
            at = np.flatnonzero(sieve[value >> np.uint64(64 - _SIFT_BITS)] & whole)
            slot = np.minimum(np.searchsorted(keys, value[at]), len(keys) - 1)
            exact = keys[slot] == value[at]
            at, slot = at[exact], slot[exact]
            owner = np.searchsorted(w.first, at, "right") - 1
            for i, k, text in zip(at.tolist(), slot.tolist(), owner.tolist(), strict=True):
                found = phrases[k].get(_phrase(w, i, size))
                if found is not None:
                    edge[i] += 1
                    edge[i + size] -= 1
                    items[text].update(found)
        covered = np.cumsum(edge[:-1]) > 0
        spans = []
        for a, b in zip(w.first[:-1], w.first[1:], strict=True):
            own = covered[a:b]
            spans.append(np.flatnonzero(np.diff(np.r_[False, own, False])).tolist() if own.any() else [])
        return np.diff(w.first), spans, [sorted(x) for x in items]


def _scanner(block):
    @F.arrow_udf(FOUND)
    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            n, spans, items = block.value.scan(column)
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], ["n_words", "spans", "items"]
            )

    return scan.asNondeterministic()


def _scanners(benchmark: DataFrame, item_id: str, text: str, length: int, max_windows: int) -> list:
    spark = benchmark.sparkSession
    small_batches(spark)
    rows = benchmark.select(benchmark[item_id].cast("string").alias("item"), F.coalesce(benchmark[text], F.lit("")).alias("text")).distinct()
    rows = checkpointed(rows.mapInArrow(_item_windows(length), "item string, size int, hash long, phrase binary").distinct())
    blocks = max(1, math.ceil(rows.count() / max_windows))
    if blocks > 1:  # the windows of a block vary about their mean
        blocks += 1 + blocks // 10
    for k in range(blocks):
        part = rows.filter(F.pmod(F.col("hash"), F.lit(blocks)) == k) if blocks > 1 else rows
        yield _scanner(spark.sparkContext.broadcast(_Block(part.collect())))


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, doc_id="doc_id", text="text", item_id="item_id", length=WINDOW, max_windows=MAX_WINDOWS
) -> DataFrame:
    """(doc_id, text_key, n_words, spans, items) of every row; spans are word positions start, end, start, end ..."""
    content = F.coalesce(docs[text], F.lit(""))
    parts = [
        docs.select(docs[doc_id].alias("doc_id"), F.sha2(content, 256).alias("text_key"), scan(content).alias("f"), F.lit(k).alias("block"))
        for k, scan in enumerate(_scanners(benchmark, item_id, text, length, max_windows))
    ]
    if len(parts) == 1:
        return parts[0].select("doc_id", "text_key", "f.*")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = every.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("block", "f")).alias("found"), F.max("f.n_words").alias("n_words"), F.expr(f"count(1) / {len(parts)}").cast("int").alias("copies")
    )
    merged = merged.withColumn("spans", _joined(F.flatten("found.f.spans"), F.transform("found.f.spans", F.size)))
    return merged.select(
        "doc_id", "text_key", "n_words", "spans", F.array_sort(F.array_distinct(F.flatten("found.f.items"))).alias("items"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy")
    ).drop("copy")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _joined(spans: pa.Array, sizes: pa.Array) -> pa.Array:
    """Union of spans of several scans."""
    out = []
    for flat in spans.to_pylist():
        merged: list[int] = []
        for start, end in sorted(zip(flat[::2], flat[1::2], strict=True)):
            if merged and start <= merged[-1]:
                merged[-1] = max(merged[-1], end)
            else:
                merged += [start, end]
        out.append(merged)
    return pa.array(out, pa.list_(pa.int32()))


def hit_words(spans) -> F.Column:
    """How many words ``spans`` cover."""
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


@F.arrow_udf(T.StringType())
def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        if not own:
            out.append(text)
            continue
        w = words(*utf8(pa.array([text])), ALNUM)
        raw, at, kept = text.encode(), 0, []
        for a, b in zip(own[::2], own[1::2], strict=True):
            kept.append(raw[at : w.start[a]])
            at = int(w.end[b - 1])
        out.append(b"".join([*kept, raw[at:]]).decode())
    return pa.array(out, pa.string())


def cut_spans(docs: DataFrame, benchmark: DataFrame, *, doc_id="doc_id", text="text", **options) -> DataFrame:
    """``docs`` with every hit passage cut out of the text; other columns unchanged."""
    marks = contamination(docs, benchmark, doc_id=doc_id, text=text, **options).filter(F.size("spans") > 0)
    marks = marks.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("spans").alias("__spans")).dropDuplicates(["__id", "__key"])
    key = F.sha2(F.coalesce(docs[text], F.lit("")), 256)
    joined = docs.join(marks, docs[doc_id].eqNullSafe(marks["__id"]) & (key == marks["__key"]), "left")
    return joined.withColumn(text, _cut(F.col(text), F.col("__spans"))).select(*docs.columns)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text="text", item_id="item_id", length=WINDOW, max_windows=MAX_WINDOWS) -> DataFrame:
    """Columns of ``docs``, without the rows in which a window of the benchmark occurs."""
    columns, out = docs.columns, docs
    for k, scan in enumerate(_scanners(benchmark, item_id, text, length, max_windows)):
        out = checkpointed(out) if k else out
        out = out.withColumn("__found", scan(F.coalesce(F.col(text), F.lit("")))).filter(F.size("__found.spans") == 0).select(*columns)
    return out
