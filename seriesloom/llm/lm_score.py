"""Masked pseudo-likelihood of documents under a small bidirectional network.

Symbols are the most frequent words of the whole corpus and, for all others, hash
buckets.  The network predicts every symbol from the two before and the two after
it: one embedding table per place, a tanh layer, a softmax.  A document's score
is the sum of the log-probabilities of its words, each given both sides: that of
the symbol and, for a word of a bucket, that of the word inside the bucket.

Inside a bucket a word has its share of the bucket's occurrences in the corpus, less
``DISCOUNT``.  What the discounts and the words of over ``SPELLED`` bytes leave goes to
spelling, byte after byte given the byte before, as counted over all words; so a word
never seen and a text without spaces have a price too.  Probabilities of the words of
a bucket add up to one at most.  All words are counted and looked up by 64 hash bits:
the commonest, up to ``NEAR``, in the workers, all others by a join.

Training is distributed: in every round each partition starts from the shared
weights, learns from its own documents in numpy, and the weights are averaged, each
by the number of places learned from.  A round takes every ``rounds``-th place of each
text, from one on that moves with the round and differs by document, so that together
the rounds learn from every place of every document once.

Null and empty texts have no symbols and score 0.  Places beyond the ends of a text
hold a symbol of their own.  An empty table gives an empty result.  A network given
without ``shares`` scores symbols alone.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import checkpointed, small_batches, utf8
from seriesloom.llm.lexing import SPACED, Words, words

FREQUENT, BUCKETS, WIDTH, SIDE = 192, 64, 16, 2
ROUNDS, BATCH, RATE = 2, 512, 0.3
SCORE_BATCH, ROWS = 2048, 128  # places by batch of scoring; those whose logits are worked on at once
DISCOUNT, SPELLED, NEAR = 0.5, 32, 1 << 18
_EDGE = 256  # stands before and after the bytes of a word
_BLANKS = "\t\n\v\f\r"
PLACES = [k for k in range(-SIDE, SIDE + 1) if k]


@dataclass
class Network:
    frequent: np.ndarray  # sorted hashes of the frequent words
    inner: np.ndarray  # (places, symbols + 1, width)
    outer: np.ndarray  # (width, symbols)
    bias: np.ndarray  # (symbols,)

    @property
    def symbols(self) -> int:
        return len(self.bias)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.inner.ravel(), self.outer.ravel(), self.bias]).astype(np.float32)

    def filled(self, flat: np.ndarray) -> Network:
        a, b = self.inner.size, self.inner.size + self.outer.size
        parts = flat[:a].reshape(self.inner.shape), flat[a:b].reshape(self.outer.shape), flat[b:]
        return Network(self.frequent, *(x.astype(np.float32) for x in parts))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of a batch, each text fenced by SIDE end symbols, and the place of each text's first symbol."""
        return self.fenced(words(*utf8(column), SPACED))

    def fenced(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        own = (w.value % np.uint64(BUCKETS)).astype(np.int64) + len(self.frequent)
        if len(self.frequent):
            # few words share their last bits with a frequent one, so only these are searched for
            near = np.zeros(1 << 16, bool)
            near[self.frequent.astype(np.uint16)] = True
            maybe = np.flatnonzero(near[w.value.astype(np.uint16)])
            value = w.value[maybe]
            slot = np.minimum(np.searchsorted(self.frequent, value), len(self.frequent) - 1)
            common = self.frequent[slot] == value
            own[maybe[common]] = slot[common]
        out = np.full(len(own) + SIDE * (w.texts() + 1), self.symbols, np.int64)
        out[np.arange(len(own)) + SIDE * (w.owner() + 1)] = own
        return out, w.first + SIDE * (np.arange(len(w.first)) + 1)

    def room(self, rows: int) -> np.ndarray:
        """Memory for the logits of up to ``rows`` places, used again by every batch."""
        return np.empty((rows, self.symbols), np.float32)

    def hidden(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hidden layer at the places ``at``."""
        hidden = self.inner[0].take(symbols[at + PLACES[0]], axis=0)
        for table, k in zip(self.inner[1:], PLACES[1:], strict=True):
            hidden += table.take(symbols[at + k], axis=0)
        return np.tanh(hidden, out=hidden)

    def _blocks(self, hidden: np.ndarray, room: np.ndarray, *, apart: bool) -> Iterator[tuple[int, np.ndarray]]:
        """Exponentials of the logits of all symbols, ``ROWS`` places at once so that they stay in the cache, with the first
        place of each block; the blocks follow one another in ``room`` if ``apart``, else each takes the place of the last."""
        low = np.vstack([self.outer, self.bias])
        high = np.ones((len(hidden), len(low)), np.float32)
        high[:, :-1] = hidden
        bounded = np.abs(low).sum(axis=0).max(initial=0) < 59  # of the hidden layer nothing passes 1
        for a in range(0, len(hidden), ROWS):
            p = room[a * apart :][: len(hidden[a : a + ROWS])]
            np.matmul(high[a : a + ROWS], low, out=p)
            if not bounded:
                np.minimum(p, 60, out=p)
            yield a, np.exp(p, out=p)

    def exps(self, symbols: np.ndarray, at: np.ndarray, room: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hidden layer and exponentials of the logits of all symbols at the places ``at``; the latter lie in ``room``."""
        room = self.room(len(at)) if room is None else room
        hidden = self.hidden(symbols, at)
        for _ in self._blocks(hidden, room, apart=True):
            pass
        return hidden, room[: len(at)]

    def predict(self, symbols: np.ndarray, at: np.ndarray, room: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hidden layer and probabilities of all symbols at the places ``at``."""
        room = self.room(len(at)) if room is None else room
        hidden = self.hidden(symbols, at)
        for _, p in self._blocks(hidden, room, apart=True):
            p /= p.sum(axis=1, keepdims=True)
        return hidden, room[: len(at)]

    def logs(self, symbols: np.ndarray, at: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
        """Log-probability of the symbols at the places ``at``; the others are not divided out.  ``room`` has ``ROWS`` rows, or
        one for each place if these are fewer."""
        room = self.room(min(len(at), ROWS)) if room is None else room
        own, out = symbols[at], np.empty(len(at), np.float32)
        for a, p in self._blocks(self.hidden(symbols, at), room, apart=False):
            out[a : a + len(p)] = p[np.arange(len(p)), own[a : a + len(p)]] / p.sum(axis=1)
        return np.log(out, out=out)


@dataclass
class Shares:
    """What a word costs inside its hash bucket."""

    counts: DataFrame | None  # (h, n) of every word of at most SPELLED bytes, by hash
    total: np.ndarray  # occurrences by bucket
    escape: np.ndarray  # those of them that are left to spelling
    follow: np.ndarray  # log-probability of a byte after another
    near: np.ndarray  # sorted hashes of the commonest words
    near_n: np.ndarray

    def left(self) -> np.ndarray:
        """Log-share of spelling by bucket; all of it where no word is known."""
        return np.log(np.where(self.total > 0, self.escape / np.maximum(self.total, 1), 1.0))

    def price(self, w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the distinct words among the words ``at``: log-probability inside the bucket where it is known here (else
        that of spelling), whether a look-up is still needed, and which of them each word is."""
        value, first, which = np.unique(w.value[at], return_index=True, return_inverse=True)
        start, end = w.start[at[first]], w.end[at[first]]
        bucket = (value % np.uint64(BUCKETS)).astype(np.int64)
        logs = self.left()[bucket] + spelled(w.data, start, end, self.follow)
        short = end - start <= SPELLED
        n = np.zeros(len(value))
        if len(self.near):
            slot = np.minimum(np.searchsorted(self.near, value), len(self.near) - 1)
            n = np.where(short & (self.near[slot] == value), self.near_n[slot], 0)
        here = n > 0
        logs[here] = np.log((n[here] - DISCOUNT) / self.total[bucket[here]] + np.exp(logs[here]))
        return logs, short & ~here, which


def _pairs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every byte of the words and an edge after each, the byte or edge before it, and where each word begins."""
    size = end - start + 1
    stop = np.cumsum(size)
    begin = stop - size
    own = np.r_[data, 0].take(np.repeat(start - begin, size) + np.arange(int(size.sum()))).astype(np.int64)
    own[stop - 1] = _EDGE
    before = np.r_[_EDGE, own[:-1]][: len(own)]
    return own, before, begin


def spelled(data: np.ndarray, start: np.ndarray, end: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Log-probability of each word byte by byte."""
    own, before, begin = _pairs(data, start, end)
    return np.add.reduceat(follow.ravel().take(before * len(follow) + own), begin) if len(begin) else np.zeros(0)


class _Trainer:
    """Adagrad on one copy of the network."""

    def __init__(self, net: Network):
        self.net = net
        self.sums = [np.full_like(x, 1e-2) for x in (net.inner, net.outer, net.bias)]
        self.room = net.room(BATCH)
        self.cells = np.arange(net.inner[0].size).reshape(-1, WIDTH)

    def learn(self, symbols: np.ndarray, at: np.ndarray) -> None:
        net = self.net
        hidden, p = net.predict(symbols, at, self.room)
        p[np.arange(len(at)), symbols[at]] -= 1
        back = ((p @ net.outer.T) * (1 - hidden**2)).astype(float).ravel()
        inner = np.empty_like(net.inner)
        for table, k in zip(inner, PLACES, strict=True):
            cells = self.cells.take(symbols[at + k], axis=0).ravel()
            table[:] = np.bincount(cells, back, table.size).reshape(table.shape)
        for value, gradient, total in zip((net.inner, net.outer, net.bias), (inner, hidden.T @ p, p.sum(axis=0)), self.sums, strict=True):
            gradient /= len(at)
            total += gradient**2
            gradient *= RATE
            gradient /= np.sqrt(total)
            value -= gradient


def places(symbols: np.ndarray, first: np.ndarray, shift: np.ndarray, turn: int, rounds: int, end: int) -> np.ndarray:
    """Places of a batch that round ``turn`` learns from; all rounds together have each symbol below ``end`` once."""
    size = np.diff(np.r_[0, first, len(symbols)])
    at = np.arange(len(symbols)) - np.repeat(np.r_[0, first], size) + np.repeat(np.r_[0, shift, 0], size)
    return np.flatnonzero((symbols < end) & ((at + turn) % rounds == 0))


def _learner(shared, turn: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value.filled(shared.value.flat())
        trainer, seen = _Trainer(net), 0
        for batch in batches:
            symbols, first = net.encode(batch.column(0))
            at = places(symbols, first, batch.column(1).to_numpy(), turn, rounds, net.symbols)
            for a in range(0, len(at), BATCH):
                trainer.learn(symbols, at[a : a + BATCH])
            seen += len(at)
        if seen:
            flat = net.flat()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat.astype(float) * seen), pa.array(np.full(len(flat), float(seen)))], ["k", "v", "n"])

    return run


def word_counts(docs: DataFrame, *, text="text") -> DataFrame:
    """(word, n) of every word of all texts."""
    spaced = F.translate(F.coalesce(docs[text], F.lit("")), string.ascii_uppercase + _BLANKS, string.ascii_lowercase + " " * len(_BLANKS))
    each = docs.select(F.explode(F.split(spaced, " ")).alias("word")).filter("word <> ''")
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def frequent_words(counts: DataFrame, *, limit: int = FREQUENT) -> list[tuple[str, int]]:
    """The most frequent words (ties in word order) with their counts."""
    return [(r[0], r[1]) for r in counts.orderBy(F.desc("n"), "word").limit(limit).collect()]


def _hasher(frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = words(*utf8(batch.column(0)), SPACED)
            rare = ~np.isin(w.value, frequent)
            short = (w.end - w.start <= SPELLED)[rare]
            yield pa.RecordBatch.from_arrays([pa.array(w.value[rare].view(np.int64)), batch.column(1).filter(pa.array(rare)), pa.array(short)], ["h", "n", "short"])

    return run


def _speller(frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((_EDGE + 1) ** 2, np.int64)
        for batch in batches:
            w = words(*utf8(batch.column(0)), SPACED)
            rare = ~np.isin(w.value, frequent)
            own, before, _ = _pairs(w.data, w.start[rare], w.end[rare])
            total += np.bincount(before * (_EDGE + 1) + own, minlength=len(total))
        pairs = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(total[pairs])], ["k", "n"])

    return run


def fit_shares(counts: DataFrame, net: Network, *, near: int = NEAR) -> Shares:
    """Shares of all words that the network takes for a bucket, from (word, n) of the corpus."""
    hashed = checkpointed(counts.mapInArrow(_hasher(net.frequent), "h long, n long, short boolean"))
    total, escape = np.zeros(BUCKETS), np.zeros(BUCKETS)
    rest = F.when(F.col("short"), F.lit(DISCOUNT)).otherwise(F.col("n"))
    for r in hashed.groupBy(F.pmod("h", F.lit(BUCKETS)).alias("c")).agg(F.sum("n").alias("n"), F.sum(rest).alias("e")).collect():
        total[r["c"]], escape[r["c"]] = r["n"], r["e"]
    follow = np.full((_EDGE + 1) ** 2, 0.5)
    seen = counts.select("word").mapInArrow(_speller(net.frequent), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    follow[seen["k"].to_numpy(np.int64)] += seen["n"].to_numpy(float)
    follow = follow.reshape(_EDGE + 1, _EDGE + 1)
    known = hashed.filter("short").groupBy("h").agg(F.sum("n").alias("n"))
    # the least count whose words fit: by powers of two, so that few rows tell
    sizes = sorted(((r["p"], r["w"]) for r in known.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count(F.lit(1)).alias("w")).collect()), reverse=True)
    least, room = None, near
    for power, size in sizes:
        if size > room:
            break
        least, room = 2**power, room - size
    top = known.filter(F.col("n") >= least).toPandas() if least else None
    hashes = top["h"].to_numpy(np.int64).view(np.uint64) if least else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    n = top["n"].to_numpy(float)[order] if least else np.zeros(0)
    return Shares(known, total, escape, np.log(follow / follow.sum(axis=1, keepdims=True)), hashes[order], n)


def fit(docs: DataFrame, *, text="text", rounds: int = ROUNDS, limit: int = FREQUENT, counts: DataFrame | None = None) -> Network:
    """Count words, then ``rounds`` rounds of local training and averaging."""
    spark = docs.sparkSession
    small_batches(spark)
    top = frequent_words(counts or word_counts(docs, text=text), limit=limit)
    hashes = np.sort(words(*utf8(pa.array([" ".join(w for w, _ in top)])), SPACED).value)
    n = len(hashes) + BUCKETS
    rng = np.random.default_rng(7)
    start = rng.normal(0, 0.1, len(PLACES) * (n + 1) * WIDTH + WIDTH * n).astype(np.float32)
    net = Network(hashes, np.zeros((len(PLACES), n + 1, WIDTH)), np.zeros((WIDTH, n)), np.zeros(n)).filled(np.r_[start, np.zeros(n, np.float32)])
    texts = docs.select(F.coalesce(docs[text], F.lit("")).alias("text")).withColumn("shift", F.pmod(F.xxhash64("text"), F.lit(rounds)))
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(net)
        rows = texts.mapInArrow(_learner(shared, turn, rounds), "k long, v double, n double")
        mean = rows.groupBy("k").agg((F.sum("v") / F.sum("n")).alias("v")).toPandas()
        if not len(mean):
            break
        net = net.filled(mean.sort_values("k")["v"].to_numpy())
    return net


def score(docs: DataFrame, *, doc_id="doc_id", text="text", net: Network | None = None, shares: Shares | None = None, **options) -> DataFrame:
    """(doc_id, n_tokens, log_prob) of every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    if net is None:
        counts = checkpointed(word_counts(docs, text=text))
        net = fit(docs, text=text, counts=counts, **options)
        shares = fit_shares(counts, net)
    shared = spark.sparkContext.broadcast((net, shares and replace(shares, counts=None)))

    @F.arrow_udf("n_tokens long, log_prob double, h array<long>, spelled array<double>")
    def measure(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net, shares = shared.value
        room = net.room(ROWS)
        for column in texts:
            w = words(*utf8(column), SPACED)
            symbols, first = net.fenced(w)
            inside = symbols < net.symbols
            logs = np.zeros(len(symbols))
            at = np.flatnonzero(inside)
            for a in range(0, len(at), SCORE_BATCH):
                part = at[a : a + SCORE_BATCH]
                logs[part] = net.logs(symbols, part, room)
            asked, spelling = np.zeros(0, np.int64), np.zeros(0)
            if shares:
                rare = np.flatnonzero(symbols[at] >= len(net.frequent))
                price, ask, which = shares.price(w, rare)
                logs[at[rare]] += np.where(ask, 0, price)[which]
                asked, spelling = rare[ask[which]], price[which][ask[which]]
            total, count = np.r_[0.0, np.cumsum(logs)], np.r_[0, np.cumsum(inside)]
            ends = np.minimum(first, len(symbols))
            cuts = pa.array(np.searchsorted(asked, w.first), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, x) for x in (pa.array(w.value[asked].view(np.int64)), pa.array(spelling))]
            yield pa.StructArray.from_arrays([pa.array(np.diff(count[ends])), pa.array(np.diff(total[ends])), *lists], ["n_tokens", "log_prob", "h", "spelled"])

    found = docs.select(docs[doc_id].alias("doc_id"), F.monotonically_increasing_id().alias("row"), measure.asNondeterministic()(F.coalesce(docs[text], F.lit(""))).alias("m"))
    found = found.select("doc_id", "row", "m.*")
    if not shares:
        return found.select("doc_id", "n_tokens", "log_prob")
    found = checkpointed(found)
    each = found.select("row", "spelled", F.posexplode("h").alias("i", "h")).select("row", "h", F.col("spelled")[F.col("i")].alias("spelled"))
    known = shares.counts.select(F.col("h").alias("__h"), "n")
    bucket = F.array(*[F.lit(float(x)) for x in shares.total])[F.pmod("h", F.lit(BUCKETS)).cast("int")]
    own = F.when(F.col("n").isNull(), F.col("spelled")).otherwise(F.log((F.col("n") - DISCOUNT) / bucket + F.exp("spelled")))
    inner = each.join(known, each["h"] == known["__h"], "left").groupBy(F.col("row").alias("__row")).agg(F.sum(own).alias("__inner"))
    joined = found.join(inner, found["row"] == inner["__row"], "left")
    return joined.select("doc_id", "n_tokens", (F.col("log_prob") + F.coalesce("__inner", F.lit(0.0))).alias("log_prob"))
