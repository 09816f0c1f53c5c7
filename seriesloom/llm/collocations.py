"""Phrase collocations from sorted count streams.

Texts are lower-cased (A-Z), cut at ``[.,;:!?]`` and line ends into pieces and those into
words between blanks and tabs.  Three passes count words, pairs, and phrases of three to
five words; a pass leaves out phrases with a part that the pass before counted below
``least``, which a bitmap of hashes tells (a wrong pass only counts more; what is kept is
exact).  Each task combines its own counts and writes them as sorted, compressed streams, one a
bucket of phrases; the streams of a bucket are put together by one task.  The number of
buckets grows with the number of words, so that a bucket stays small.

Every phrase of two words or more is then cut after each of its words.  The cuts form two
streams, in prefix order by what stands before the cut and in suffix order by what
stands behind it, and each is merge-joined in lockstep with the counts of all phrases in
the same order: no hash table is built, tasks only read sorted streams on.  The prefix
stream gives the left counts and, from cuts before the last word, the largest count among
extensions to the right; the suffix stream gives the right counts and the extensions to
the left.  A phrase inside a longer one of no smaller count is also inside one that is a
single word longer, so these two suffice.

The best of a language are picked in two steps, first among phrases of a salt.

Null and empty texts have no words.  A null language is ``und``, together with a language
of that name.  Ids are not read: repeated rows count as often as they occur.  A very long
text is read in stretches of a megabyte and its phrases run on across them.  An empty table gives
an empty result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import checkpointed, small_batches
from seriesloom.llm.lexing import mix, stretches

LEAST = 100
LONGEST = 5
TOP = 2000
SALTS = 32
STRETCH = 1 << 20
TOKENS = 1 << 22
FORMS = 1 << 20
BUCKET_ROWS = 1 << 12
BUCKET_TOKENS = 1 << 21
COUNTS = "lang string, words int, phrase string, n long"
_SIGNS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(46 if b in _SIGNS else b + 32 if 65 <= b <= 90 else b for b in range(256))
_GAP = re.compile(rb"[ .\t]")


class _Forms(dict):
    """Numbers of word forms in order of appearance; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, form: bytes) -> int:
        self[form] = number = len(self)
        return number


class Bitmap:
    """Set of (lang, phrase) by hash; answers yes for everything put in and for a few others."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, len(bits) * 8 - 1

    def has(self, lang: bytes, phrases: list[bytes]) -> np.ndarray:
        start = zlib.crc32(lang + b"\0")
        spots = np.fromiter((zlib.crc32(p, start) for p in phrases), np.int64, len(phrases)) & self.mask
        return (self.bits[spots >> 3] >> (spots & 7).astype(np.uint8)) & 1 > 0


def bitmap(counts: DataFrame) -> Bitmap:
    """Bitmap of the phrases of ``counts``: 32 bits for each, between 2^17 and 2^27 in all (16 MB at most)."""
    wanted = counts.count()
    size = 1 << min(27, max(17, (32 * wanted).bit_length()))
    spot = F.crc32(F.concat(F.encode("lang", "utf-8"), F.lit(b"\0"), F.encode("phrase", "utf-8"))).bitwiseAND(size - 1)
    words = counts.select(spot.alias("s")).groupBy(F.shiftright("s", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 31 as int)))").alias("b"))
    found = words.toArrow()
    bits = np.zeros(size // 32, "<u4")
    bits[found.column("w").to_numpy()] = found.column("b").to_numpy().astype(np.uint32)
    return Bitmap(bits.view(np.uint8))


class _Counter:
    """Phrase counts of the texts of one task, handed on as sorted streams whenever the buffers are full."""

    def __init__(self, orders: tuple[int, ...], known: tuple[Bitmap, ...], buckets: int):
        """``known`` are the words and, for phrases beyond pairs, the pairs that may be part of a phrase."""
        self.orders, self.known, self.buckets = orders, known, buckets
        self.clear()

    def clear(self) -> None:
        self.forms, self.tokens, self.size = _Forms(), {}, 0

    def add(self, lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        own = self.tokens.setdefault(lang, [])
        for part in stretches(text.translate(_FOLD), _GAP, STRETCH):
            words = part.replace(b".", b" . ").split()
            own.append(np.fromiter(map(self.forms.__getitem__, words), np.int64, len(words)))
            self.size += len(words)
        own.append(np.zeros(1, np.int64))
        if self.size >= TOKENS or len(self.forms) >= FORMS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Numbers of forms become their ranks in byte order, so that phrases come out sorted; 0 stays the end of a piece."""
        names = sorted(form for form, number in self.forms.items() if number)
        rank = np.zeros(len(self.forms), np.int64)
        rank[[self.forms[name] for name in names]] = np.arange(1, len(names) + 1)
        names = [b".", *names]
        spread = np.fromiter(map(zlib.crc32, names), np.uint64, len(names))
        for lang, parts in self.tokens.items():
            yield from self.counted(lang, rank[np.concatenate(parts)], names, spread)
        self.clear()

    def counted(self, lang: str, ids: np.ndarray, names: list[bytes], spread: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not self.known:
            numbers, n = np.unique(ids[ids > 0], return_counts=True)
            yield self.streams(lang, 1, [names[i] for i in numbers.tolist()], n, spread[numbers])
            yield self.streams(lang, 0, [b""], n.sum(keepdims=True), np.zeros(1, np.uint64))
            return
        seen = np.unique(ids)
        good = np.zeros(len(names), bool)
        good[seen] = self.known[0].has(lang.encode(), [names[i] for i in seen.tolist()])
        good[0] = False
        whole = good[ids]
        place = np.flatnonzero(whole[:-1] & whole[1:])
        phrase, code, own = self.grown(ids[place], ids[place + 1], names, spread, names, spread)
        if 2 in self.orders:
            yield self.streams(lang, 2, phrase, np.bincount(code, minlength=len(phrase)), own)
            return
        good = self.known[1].has(lang.encode(), phrase)[code]
        pairs = np.zeros(len(ids), bool)
        pairs[place[good]] = True
        at = np.zeros(len(ids), np.int64)
        at[place] = code
        run = pairs
        for order in self.orders:
            run = run[:-1] & pairs[order - 2 :]
            place = np.flatnonzero(run)
            phrase, code, own = self.grown(at[place], ids[place + order - 1], phrase, own, names, spread)
            at[place] = code
            yield self.streams(lang, order, phrase, np.bincount(code, minlength=len(phrase)), own)

    @staticmethod
    def grown(head, last, heads: list[bytes], head_spread, names: list[bytes], spread) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct phrases (head, last word) in order, which of them each place has, and their hashes."""
        keys, code = np.unique(head * len(names) + last, return_inverse=True)
        before, after = np.divmod(keys, len(names))
        phrases = [heads[h] + b" " + names[w] for h, w in zip(before.tolist(), after.tolist(), strict=True)]
        return phrases, code, mix(head_spread[before] * np.uint64(31) + spread[after])

    def streams(self, lang: str, order: int, phrases: list[bytes], n: np.ndarray, spread: np.ndarray) -> pa.RecordBatch:
        """A sorted and compressed stream of phrases and counts for each bucket."""
        bucket = (mix(spread) % np.uint64(self.buckets)).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        filled, starts = np.unique(bucket[by_bucket], return_index=True)
        n = n[by_bucket].astype(np.int64)
        rows = []
        for k, i in enumerate(np.split(by_bucket, starts[1:]) if len(filled) else []):
            names = b"\n".join([phrases[j] for j in i.tolist()]) + b"\n"
            counts = n[starts[k] : starts[k] + len(i)].tobytes()
            rows.append((len(names), pa.compress(names, "zstd", asbytes=True), len(counts), pa.compress(counts, "zstd", asbytes=True)))
        columns = [pa.array([lang] * len(rows), pa.string()), pa.array([order] * len(rows), pa.int32()), pa.array(filled, pa.int64())]
        sizes, names, lengths, counts = zip(*rows, strict=True) if rows else ((),) * 4
        columns += [pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(lengths, pa.int64()), pa.array(counts, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "words", "bucket", "size", "phrases", "length", "counts"])


STREAMS = "lang string, words int, bucket long, size long, phrases binary, length long, counts binary"


def _merged(least: int):
    """Streams of one bucket put together: phrases that occur ``least`` times, and the number of words (order 0)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_pylist() for c in ("size", "phrases", "length", "counts")]
        names = b"".join(pa.decompress(p, s, "zstd", asbytes=True) for s, p in zip(*columns[:2], strict=True))
        counts = np.frombuffer(b"".join(pa.decompress(c, s, "zstd", asbytes=True) for s, c in zip(*columns[2:], strict=True)), np.int64)
        ends = np.flatnonzero(np.frombuffer(names, np.uint8) == 10)
        edges = np.r_[0, ends + 1]
        coded = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(edges), pa.py_buffer(names)]).dictionary_encode()
        total = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(total, coded.indices.to_numpy(), counts)
        kept = np.flatnonzero(total >= (least if key[1].as_py() else 0))
        phrases = [p[:-1].decode() for p in coded.dictionary.take(pa.array(kept)).to_pylist()]
        rows = len(kept)
        return pa.table({"lang": pa.array([key[0].as_py()] * rows, pa.string()), "words": pa.array([key[1].as_py()] * rows, pa.int32()), "phrase": pa.array(phrases, pa.string()), "n": total[kept]})

    return run


def _counts(texts: DataFrame, orders: tuple[int, ...], known: list, least: int, buckets: int) -> DataFrame:
    """Counts of phrases of ``orders`` words; rows of no words at all (order 0) carry the number of words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(orders, tuple(k.value for k in known), buckets)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from counter.add(lang, text.as_py())
        yield from counter.flush()

    return checkpointed(texts.mapInArrow(run, STREAMS).groupBy("lang", "words", "bucket").applyInArrow(_merged(least), COUNTS))


def phrase_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, words, phrase, n): phrases of up to ``longest`` words that occur ``least`` times, and the words of a language (0 words)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(docs[lang], F.lit("und")).alias("lang"), F.encode(F.coalesce(docs[text], F.lit("")), "utf-8").alias("text")).filter("length(text) > 0")
    passes = [_counts(texts, (1,), [], least, 1 + texts.count() // BUCKET_ROWS)]
    words = passes[0].filter("words = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = 1 + words // BUCKET_TOKENS
    known: list = []
    for orders in ((2,), tuple(range(3, longest + 1))):
        if orders and longest >= orders[0]:
            known.append(spark.sparkContext.broadcast(bitmap(passes[-1].filter("words > 0"))))
            passes.append(_counts(texts, orders, known, least, buckets))
    for own in known:
        own.destroy()
    every = passes[0]
    for more in passes[1:]:
        every = every.unionByName(more)
    return every


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases of two words or more that no longer phrase of their count contains."""
    phrases = counts.filter("words > 0").select("lang", "phrase", F.col("n").alias("a"))
    parts, m = F.split("phrase", " "), F.col("words")
    cuts = counts.filter("words > 1").select("lang", "phrase", F.col("n").alias("a"), m.alias("m"), parts.alias("p"), F.explode(F.sequence(F.lit(1), m - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "m", "k", F.array_join(F.slice("p", 1, F.col("k")), " ").alias("head"), F.array_join(F.slice("p", F.col("k") + 1, F.col("m")), " ").alias("tail")
    )
    prefix = phrases.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    suffix = phrases.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    left = cuts.join(prefix.hint("merge"), ["lang", "head"]).select("lang", "phrase", "a", "m", "k", "head", "l")
    right = cuts.join(suffix.hint("merge"), ["lang", "tail"]).select("lang", "phrase", "a", "m", "k", "tail", "r")
    none = F.lit(None).cast("long")
    onward = left.filter("k = m - 1").groupBy("lang", "head").agg(F.max("a").alias("x")).select("lang", F.col("head").alias("phrase"), "x")
    back = right.filter("k = 1").groupBy("lang", "tail").agg(F.max("a").alias("x")).select("lang", F.col("tail").alias("phrase"), "x")
    own = ("lang", "phrase", "a", "k")
    stream = left.select(*own, "l", none.alias("r"), none.alias("x")).unionByName(right.select(*own, none.alias("l"), "r", none.alias("x")))
    longer = onward.unionByName(back).select("lang", "phrase", none.alias("a"), F.lit(0).alias("k"), none.alias("l"), none.alias("r"), "x")
    # one row a cut, one more (cut 0) for the longest extension
    per_cut = stream.unionByName(longer).groupBy("lang", "phrase", "k").agg(*[F.max(c).alias(c) for c in ("a", "l", "r", "x")])
    totals = counts.filter("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    priced = per_cut.join(totals, "lang").withColumn("score", F.when(F.col("k") > 0, _score()))
    best = F.min(F.when(F.col("k") > 0, F.struct("score", "k", "l", "r")))
    out = priced.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("x").alias("x"), F.max("n").alias("n"), best.alias("cut"))
    kept = out.filter("cut is not null and (x is null or x < a)")
    return kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def _score() -> Column:
    """floor(1000 a n / (l r)) in decimals of 38 digits."""
    return F.expr("(cast(a as decimal(15, 0)) * cast(n as decimal(17, 0)) * cast(1000 as decimal(4, 0))) div (cast(l as decimal(15, 0)) * cast(r as decimal(15, 0)))")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, salts: int = SALTS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by score, count and phrase."""
    rows = scored(phrase_counts(docs, text=text, lang=lang, least=least, longest=longest))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
