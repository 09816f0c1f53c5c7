"""Language identification by prediction by partial matching.

Per language a byte context tree of orders 0 to 4 is counted and frozen.  A text's
code length under a tree is exact: in a context the next byte costs its share of
the counts, an unseen byte costs the escape (as many chances as distinct bytes
seen), then the next shorter context is asked with the bytes already ruled out
excluded, down to a uniform choice.  The language with the shortest code wins.

Texts are lower-cased and runs of ASCII characters that are no letters count as
one space.  Trees learn from a share of the text of each language, in blocks of at most
``CUT`` characters with a letter, chosen by a hash of id, place and content so that
about ``train_bytes`` are read per language; the block with the least hash is always
one of them, so every language with a letter gets a tree.

A null text or one without a letter is ``und`` with score 0.  Documents with no
language are not learned from; with no languages at all everything is ``und``.
Ties go to the language first in order.  The score is the posterior of the winner
among the learned languages, all equally likely beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import held_out, share_of, small_batches, utf8

ORDER = 4
TRAIN_BYTES = 1_500_000
BLOCK = 1 << 21
CUT = 4096
_TOP = 2**63 - 1
_SPACE = 32
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = _SPACE
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)


def grams(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ORDER + 1)-byte windows that end at each byte of the tidied texts, and per text the first (one more at the end).

    A text is preceded by spaces.
    """
    tidy = _PLAIN[data]
    blank = tidy == _SPACE
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    begin = starts[:-1][np.diff(starts) > 0]
    keep[begin] = ~blank[begin]
    before = np.concatenate(([0], np.cumsum(keep)))
    first = before[starts]
    tidy = tidy[keep]
    offset = np.arange(len(tidy)) - np.repeat(first[:-1], np.diff(first))
    key = tidy.astype(np.uint64)
    for k in range(1, ORDER + 1):
        back = np.full(len(tidy), _SPACE, np.uint64)
        back[k:] = tidy[:-k] if len(tidy) > k else tidy[:0]
        back[offset < k] = _SPACE
        key |= back << np.uint64(8 * k)
    return key, first


class Tree:
    """Frozen counts of one language."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.levels = []
        for order in range(ORDER, -1, -1):
            mask = np.uint64(2 ** (8 * (order + 1)) - 1)
            own, inverse = np.unique(keys & mask, return_inverse=True)
            count = np.bincount(inverse, counts, len(own))
            context, place = np.unique(own >> np.uint64(8), return_inverse=True)
            total, kinds = np.bincount(place, count, len(context)), np.bincount(place, minlength=len(context)).astype(float)
            self.levels.append([own, count, context, total, kinds, None, None])
        for i, (high, low) in enumerate(zip(self.levels[:-1], self.levels[1:], strict=True)):
            # what is left in the shorter context once the bytes of the longer one are excluded
            mask = np.uint64(2 ** (8 * (ORDER - i)) - 1)
            own, _, context, _, kinds, _, _ = high
            below = low[1][np.searchsorted(low[0], own & mask)]
            place = np.searchsorted(context, own >> np.uint64(8))
            parent = np.searchsorted(low[2], context & (mask >> np.uint64(8)))
            high[5] = low[3][parent] - np.bincount(place, below, len(context))
            high[6] = low[4][parent] - kinds

    def cost(self, keys: np.ndarray) -> np.ndarray:
        """Code length in bits of the last byte of each window."""
        bits = np.zeros(len(keys))
        open_ = np.ones(len(keys), bool)
        total = kinds = None  # where a longer context was seen: what it leaves here
        known = np.zeros(len(keys), bool)
        for i, (own, count, context, all_, different, left, left_kinds) in enumerate(self.levels):
            order = ORDER - i
            mask = np.uint64(2 ** (8 * (order + 1)) - 1)
            key = keys & mask
            place = np.minimum(np.searchsorted(context, key >> np.uint64(8)), len(context) - 1)
            here = context[place] == key >> np.uint64(8)
            t = np.where(known, total, all_[place]) if total is not None else all_[place]
            d = np.where(known, kinds, different[place]) if total is not None else different[place]
            slot = np.minimum(np.searchsorted(own, key), len(own) - 1)
            seen = open_ & here & (own[slot] == key)
            bits[seen] += np.log2((t[seen] + d[seen]) / count[slot[seen]])
            open_ &= ~seen
            escape = open_ & here & (d > 0)
            bits[escape] += np.log2((t[escape] + d[escape]) / d[escape])
            if left is not None:
                total, kinds = left[place], left_kinds[place]
            known = here
        root = self.levels[-1][4][0] if len(self.levels[-1][4]) else 0
        bits[open_] += np.log2(max(256 - root, 1))
        return bits


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        key, first = grams(*utf8(batch.column(1)))
        of = np.repeat(np.arange(len(langs)), np.diff(first))
        for lang in sorted(set(langs)):
            own, n = np.unique(key[(langs == lang)[of]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def fit(docs: DataFrame, *, doc_id="doc_id", text="text", lang="lang", train_bytes: int = TRAIN_BYTES) -> dict[str, Tree]:
    """Trees by language, from documents that have one and are not held out."""
    small_batches(docs.sparkSession)
    usable = docs.filter(docs[lang].isNotNull() & docs[text].isNotNull() & ~held_out(docs[doc_id]))
    cut = F.when(F.char_length(docs[text]) <= CUT, F.array(docs[text])).otherwise(F.regexp_extract_all(docs[text], F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)))
    blocks = usable.select(docs[lang].alias("lang"), docs[doc_id].alias("id"), F.posexplode(cut).alias("i", "text")).filter(F.col("text").rlike(r"\p{L}"))
    blocks = blocks.select("lang", "text", F.xxhash64(F.lit("lang"), "id", "i", "text").bitwiseAND(F.lit(_TOP)).alias("h"))
    sizes = {r[0]: (r[1], r[2]) for r in blocks.groupBy("lang").agg(F.sum(F.octet_length("text")), F.min("h")).collect()}
    if not sizes:
        return {}
    limits = F.create_map(*[x for k, (size, least) in sizes.items() for x in (F.lit(k), F.lit(max(least, int(train_bytes / size * _TOP) if size > train_bytes else _TOP)))])
    chosen = blocks.filter(F.col("h") <= F.element_at(limits, F.col("lang")))
    counts = (
        chosen.select("lang", F.lower("text").alias("text"))
        .mapInArrow(_counter, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names = np.array(counts["lang"].to_pylist(), object)
    keys, n = counts["gram"].to_numpy().astype(np.uint64), counts["n"].to_numpy().astype(float)
    return {k: Tree(keys[names == k], n[names == k]) for k in sorted(sizes) if (names == k).any()}


def code_lengths(trees: list[Tree], data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bits of each text under each tree."""
    key, first = grams(data, starts)
    out = np.zeros((len(starts) - 1, len(trees)))
    of = np.repeat(np.arange(len(starts) - 1), np.diff(first))
    for a in range(0, len(key), BLOCK):
        own, inverse = np.unique(key[a : a + BLOCK], return_inverse=True)
        for j, tree in enumerate(trees):
            out[:, j] += np.bincount(of[a : a + BLOCK], tree.cost(own)[inverse], len(out))
    return out


def identify(docs: DataFrame, *, doc_id="doc_id", text="text", **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``."""
    spark = docs.sparkSession
    trees = fit(docs, doc_id=doc_id, text=text, **options)
    shared = spark.sparkContext.broadcast((list(trees), list(trees.values())))

    @F.arrow_udf("lang string, score double")
    def guess(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, models = shared.value
        for column in texts:
            if not names:
                lang, score = ["und"] * len(column), np.zeros(len(column))
            else:
                nats = code_lengths(models, *utf8(column)) * np.log(2)
                best = nats.argmin(axis=1)
                lang = [names[i] for i in best]
                score = 1 / np.exp(np.minimum(nats.min(axis=1, keepdims=True) - nats, 0)).sum(axis=1)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    letters = F.coalesce(F.lower(docs[text]), F.lit("")).alias("text")
    has = F.coalesce(docs[text].rlike(r"\p{L}"), F.lit(False))
    found = docs.select(docs[doc_id].alias("doc_id"), held_out(docs[doc_id]).alias("held_out"), has.alias("has"), guess.asNondeterministic()(letters).alias("g"))
    return found.select(
        "doc_id", "held_out", F.when(F.col("has"), F.col("g.lang")).otherwise("und").alias("lang_pred"), F.when(F.col("has"), F.col("g.score")).otherwise(0.0).alias("score")
    )
