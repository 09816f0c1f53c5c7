"""Near duplicates by HyperMinHash.

A document's set of word shingles is hashed into 256 buckets.  Of each bucket the
smallest value is stored in 16 bits: its leading-zero count and the ten bits after
the leading one (0: empty bucket).  Bands of five registers are the search keys:
51 bands miss a pair of similarity 0.75 with probability (1 - 0.75^5)^51 = 1e-6.
A small set leaves most buckets empty; in a band an empty bucket is stood for by
the first filled one of a fixed random order, so that every band of every set has
five values, each shared with the probability of the similarity.

Documents of equal sets are merged first, so groups below hold different sets.
Candidates of a band are tested against the smallest id of the band, never all
against all: first each document against its smallest partner, then against those
that are still in another component.  A pair first needs a Jaccard estimate (share of equal registers,
corrected for chance collisions of the stored bits) within five standard errors
of the threshold, then passes a comparison of its full sets.  Last, in every band
that still holds several components all pairs across components are tested: small
bands give the pairs as rows, larger ones are compared in blocks inside tasks.
There sets of at most 256 members, no longer than their registers would be useful
for, come whole: they are compared exactly and only give the links that join what
is still apart.  Pairs with a larger set give a row if they pass the estimate.  So
every pair that shares a band is either linked through others already or tested.

Nulls and texts without words have an empty set: linked with nothing and kept.
Ids are meant to be unique.  Rows that share an id are one node of the graph: a
link of one of their texts is a link of the id.  A row without an id is kept, has
no component and is not compared.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.common import checkpointed, keep_rows, small_batches, thinned, utf8
from seriesloom.llm.lexing import SPACED, mix, shingle_sets, words

WORDS = 5
REGISTERS = 256
BAND = 5
BANDS = REGISTERS // BAND
MANTISSA = 10
SMALL = 8
BLOCK = 1024
WHOLE = 256
PERCENT = 75


def registers(values: np.ndarray) -> np.ndarray:
    """Compressed registers of a sorted set of hashes."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(values):
        return out
    bucket = (values >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    rest = values[first] << np.uint64(8)
    zeros = np.minimum(63 - np.floor(np.log2(np.maximum(rest, np.uint64(1)).astype(np.float64))).astype(np.int64), 55)
    zeros = np.maximum(zeros, 0)
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out[bucket[first]] = ((zeros + 1) << MANTISSA) + mantissa.astype(np.int64)
    return out


def _orders() -> np.ndarray:
    """For every bucket a random order of all buckets that starts with itself."""
    out = np.argsort(np.random.default_rng(REGISTERS).random((REGISTERS, REGISTERS)), axis=1)
    return np.array([np.r_[i, row[row != i]] for i, row in enumerate(out)], np.uint8)


ORDERS = _orders()


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """Keys of the bands of one sketch that is not empty."""
    filled = sketch > 0
    if filled.all():
        source = np.arange(REGISTERS)
    else:
        source = ORDERS[np.arange(REGISTERS), np.argmax(filled[ORDERS], axis=1)].astype(np.int64)
    values = (source.astype(np.uint64) << np.uint64(16)) | sketch[source].astype(np.uint64)
    key = mix(np.arange(BANDS, dtype=np.uint64))
    for column in values[: BANDS * BAND].reshape(BANDS, BAND).T:
        key = mix(key ^ column)
    return key.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated Jaccard similarity of rows of registers, and how many registers tell of it."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    equal = ((a == b) & (a > 0)).sum(axis=1)
    zeros = np.arange(56)
    shares = []
    for size in (size_a, size_b):
        load = np.maximum(size / REGISTERS, 1e-3)[:, None]
        shares.append((1 - 0.5 ** (zeros + 1.0)) ** load - (1 - 0.5**zeros) ** load)
    chance = np.minimum((shares[0] * shares[1]).sum(axis=1) / 2**MANTISSA, 0.5)
    raw = equal / np.maximum(used, 1)
    return np.maximum(raw - chance, 0) / (1 - chance), used


def floor(used: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Share of equal registers five standard errors below the threshold.

    Used registers sample the union of both sets without replacement, so small sets have small errors.
    """
    j = percent / 100
    used = np.maximum(used, 1)
    union = np.maximum((size_a + size_b) / (1 + j), used)
    error = np.sqrt(j * (1 - j) / used * (union - used) / np.maximum(union - 1, 1))
    return j - 5 * error - 1 / used


def _sets(column: pa.Array, length: int) -> list[np.ndarray]:
    return shingle_sets(words(*utf8(column), SPACED), length)


def _binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def _sketcher(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets(batch.column(1), length)
            sums = [int(mix(s).sum(dtype=np.uint64)) for s in sets]
            folds = [int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))) if len(s) else 0 for s in sets]
            digest = [a.to_bytes(8, "big") + b.to_bytes(8, "big") for a, b in zip(sums, folds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), _binary(digest), _binary([registers(s).tobytes() for s in sets])],
                ["id", "n", "digest", "sketch"],
            )

    return run


def _bander(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [band_keys(row) for row in _matrix(batch.column(2))]
        if keys:
            ids, n = (np.repeat(batch.column(i).to_numpy(), BANDS) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(np.concatenate(keys))], ["id", "n", "band"])


def _set_maker(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary([s.tobytes() for s in _sets(batch.column(1), length)])], ["id", "members"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _estimator(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, n, m, left, right = (batch.column(i) for i in range(6))
            n, m = n.to_numpy(), m.to_numpy()
            found, used = similarity(_matrix(left), _matrix(right), n, m)
            passed = (found >= floor(used, n, m, percent)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(passed))

    return run


def _confirmer(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                both = np.concatenate((a, b))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                passed.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(passed, pa.bool_()))

    return run


def tidy(spark: SparkSession) -> None:
    """Let the cleaner remove the shuffle files and checkpoints of rounds that are over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _starred(edges: DataFrame) -> bool:
    """Whether every ``a`` has a single ``b`` and no ``b`` is an ``a``: then ``b`` is the root of ``a``."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("up")), F.struct(F.col("b").alias("id"), F.lit(0).alias("up")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.up").alias("up"), F.count(F.lit(1)).alias("n")).filter("up > 1 or up = 1 and n > 1").isEmpty()


def connected(links: DataFrame) -> DataFrame:
    """(id, root) of every id in ``links`` (a, b) that is not a root; root is the smallest reachable id.

    Alternates two steps that only need neighbours of one id: larger neighbours
    move to the smallest one, then smaller neighbours do.
    """
    edges = checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while not _starred(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = checkpointed(small.select("e.a", "e.b").filter("a <> b").distinct())
        tidy(edges.sparkSession)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))


def _rooted(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``links`` between different components of ``roots`` as links (a, b) of their roots."""
    left, right = (roots.select(F.col("id").alias(c), F.col("root").alias(f"r_{c}")) for c in "ab")
    moved = links.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("r_a", "a").alias("a"), F.coalesce("r_b", "b").alias("b"))
    return moved.filter("a <> b").distinct()


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` of ``connected`` after more ``links``: only the roots that these join are connected again."""
    more = checkpointed(_rooted(links, roots))
    if more.isEmpty():
        return roots
    new = connected(more)
    moved = roots.join(new.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    return checkpointed(moved.unionByName(new))


def _sized(a: str, b: str, percent: int) -> str:
    """Sets whose sizes differ too much cannot be that similar."""
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _pairs_of_small(groups: DataFrame, percent: int) -> DataFrame:
    """Pairs across components within bands of at most SMALL members."""
    lists = groups.groupBy("band").agg(F.collect_list(F.struct("id", "root", "n")).alias("all"))
    one = lists.select(F.explode("all").alias("x"), "all").select("x", F.explode(F.expr("filter(all, y -> y.id > x.id and y.root <> x.root)")).alias("y"))
    return one.filter(_sized("x.n", "y.n", percent)).select(F.col("y.id").alias("a"), F.col("x.id").alias("b")).distinct()


def _open_bands(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, id, n, root, size) of the members of bands that hold more than one component."""
    labelled = members.select("band", "id", "n").join(roots, "id", "left").select("band", "id", "n", F.coalesce("root", "id").alias("root"))
    several = labelled.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi")
    return labelled.join(several.select("band", "size"), "band")


class _Forest:
    """Components known so far inside one block pair."""

    def __init__(self, roots: np.ndarray):
        self.up = {int(r): int(r) for r in roots}

    def top(self, r: int) -> int:
        while self.up[r] != r:
            self.up[r] = r = self.up[self.up[r]]
        return r

    def tops(self, roots: np.ndarray) -> np.ndarray:
        return np.fromiter((self.top(int(r)) for r in roots), np.int64, len(roots))


def _exact_links(ids: np.ndarray, roots: np.ndarray, sizes: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links between whole small sets, as few as join what they join."""
    if len(ids) < 2:
        return
    forest, one = _Forest(roots), bool((sides == sides[0]).all())
    value, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(place, kind="stable")
    by_value, begin = owner[order], np.searchsorted(place[order], np.arange(len(value) + 1))
    ends = np.r_[0, np.cumsum(sizes)]
    now = forest.tops(roots)
    for i in range(len(ids) - 1):
        rest = np.arange(i + 1, len(ids))
        ok = (now[rest] != now[i]) & (100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i]))
        if not (ok if one else ok & (sides[rest] != sides[i])).any():
            continue
        rest = rest[ok if one else ok & (sides[rest] != sides[i])]
        spans = [by_value[begin[v] : begin[v + 1]] for v in place[ends[i] : ends[i + 1]]]
        common = np.bincount(np.concatenate(spans), minlength=len(ids))[rest]
        for j in rest[100 * common >= percent * (sizes[rest] + sizes[i] - common)]:
            x, y = forest.top(int(roots[i])), forest.top(int(roots[j]))
            if x != y:
                forest.up[max(x, y)] = min(x, y)
                now[(now == x) | (now == y)] = min(x, y)
                yield max(ids[i], ids[j]), min(ids[i], ids[j])


def _likely_pairs(ids: np.ndarray, roots: np.ndarray, sizes: np.ndarray, sides: np.ndarray, whole: np.ndarray, m: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs whose registers pass the estimate, but for those of two whole sets."""
    one = bool((sides == sides[0]).all())
    for i in range(len(ids) - 1):
        rest = np.arange(i + 1, len(ids))
        ok = ~(whole[rest] & whole[i]) & (roots[rest] != roots[i]) & (100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i]))
        rest = rest[ok & (one | (sides[rest] != sides[i]))]
        if len(rest):
            used = ((m[rest] > 0) | (m[i] > 0)).sum(axis=1)
            equal = ((m[rest] == m[i]) & (m[i] > 0)).sum(axis=1)
            for j in rest[equal >= used * floor(used, sizes[rest], sizes[i], percent)]:
                yield max(ids[i], ids[j]), min(ids[i], ids[j])


def _compared(rows: list[tuple], percent: int) -> Iterator[tuple[int, int, bool]]:
    """(a, b, sure) of one block pair (id, root, n, side, sketch, members): across sides, or all if there is one side.

    Sets of at most ``WHOLE`` members come whole and are compared exactly among themselves; every pair with a larger
    one must pass the estimate.
    """
    ids, roots, sizes, sides = (np.array([r[k] for r in rows]) for k in range(4))
    whole = np.array([r[5] is not None for r in rows])
    sets = {k: np.frombuffer(rows[k][5], np.uint64) for k in np.flatnonzero(whole).tolist()}
    for k, members in sets.items():
        sizes[k] = len(members)
    at = np.array(list(sets), np.int64)
    for a, b in _exact_links(ids[at], roots[at], sizes[at], sides[at], list(sets.values()), percent):
        yield a, b, True
    most = np.flatnonzero(100 * sizes >= percent * WHOLE)  # smaller ones have no partner beyond WHOLE
    if not whole[most].all():
        m = np.frombuffer(b"".join(registers(sets[k]).tobytes() if k in sets else rows[k][4] for k in most.tolist()), np.uint16)
        for a, b in _likely_pairs(ids[most], roots[most], sizes[most], sides[most], whole[most], m.reshape(len(most), REGISTERS), percent):
            yield a, b, False


def _block_comparer(percent: int):
    """Rows come sorted by block pair; a block pair holds two blocks at most."""

    def out(found: list[tuple]) -> pa.RecordBatch:
        ids = [pa.array([int(f[k]) for f in found], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*ids, pa.array([f[2] for f in found], pa.bool_())], ["a", "b", "sure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            found = []
            for *now, id_, root, n, side, sketch, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key:
                    found += _compared(rows, percent) if rows else []
                    key, rows = now, []
                rows.append((id_, root, n, side, sketch, members))
            yield out(found)
        yield out(list(_compared(rows, percent)) if rows else [])

    return run


def _pairs_of_large(groups: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, sure) within larger bands, whose members are compared block by block inside tasks.

    ``sets`` has the members of sets of at most ``WHOLE``; they travel in place of the registers.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = groups.withColumn("blocks", blocks).withColumn("side", F.expr("pmod(xxhash64(id), blocks)").cast("int"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    wide = sketches.filter(F.col("n") > WHOLE).select("id", "sketch", F.lit(None).cast("binary").alias("members"))
    wide = wide.unionByName(sets.select("id", F.lit(None).cast("binary").alias("sketch"), "members"))
    each = each.join(wide, "id")
    keyed = each.select("band", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "id", "root", "n", "side", "sketch", "members")
    return keyed.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y").mapInArrow(_block_comparer(percent), "a long, b long, sure boolean").distinct()


class _Search:
    def __init__(self, docs: DataFrame, length: int, percent: int):
        self.docs, self.length, self.percent = docs, length, percent

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, members): the full sets of the documents named by ``__wanted``."""
        docs = thinned(self.docs, "id", ids)
        return keep_rows(docs, ids, (docs["id"], "__wanted")).mapInArrow(_set_maker(self.length), "id long, members binary")

    def tested(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """Links among candidate ``pairs`` (a, b)."""
        pairs = checkpointed(pairs)
        if pairs.isEmpty():
            return pairs
        sketches = thinned(sketches, "id", pairs.select(F.explode(F.array("a", "b"))))
        left = sketches.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
        right = sketches.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
        near = checkpointed(
            pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(_estimator(self.percent), "a long, b long")
        )
        ids = near.select(F.explode(F.array("a", "b")).alias("__wanted")).distinct()
        sets = checkpointed(self.sets(ids))
        tidy(sketches.sparkSession)
        full = near.join(sets.select(F.col("id").alias("a"), F.col("members").alias("m_a")), "a")
        full = full.join(sets.select(F.col("id").alias("b"), F.col("members").alias("m_b")), "b")
        return checkpointed(full.select("a", "b", "m_a", "m_b").mapInArrow(_confirmer(self.percent), "a long, b long"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    whole = docs.select(docs[doc_id].cast("long").alias("id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    search = _Search(whole.filter("id is not null"), length, percent)
    sizes = checkpointed(whole.mapInArrow(_sketcher(length), "id long, n long, digest binary, sketch binary"))
    known = sizes.filter("n > 0 and id is not null")
    groups = checkpointed(known.groupBy("digest", "n", "sketch").agg(F.min("id").alias("id")))
    classes = groups.select("digest", F.col("n").alias("size"), F.col("id").alias("rep"))
    sketches = groups.select("id", "n", "sketch")
    bands = sketches.mapInArrow(_bander, "id long, n long, band long")
    first = (F.min("id").alias("lead"), F.min_by("n", "id").alias("lead_n"), F.max("id").alias("last"))
    shared = checkpointed(bands.groupBy("band").agg(*first).filter("lead <> last").select("band", "lead", "lead_n"))
    tidy(spark)
    members = checkpointed(thinned(bands, "band", shared.select("band")).join(shared, "band").select("band", "id", "n", "lead", "lead_n"))
    pairs = members.filter("id <> lead").filter(_sized("n", "lead_n", percent)).select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()
    pairs = checkpointed(pairs)
    roots = connected(search.tested(pairs.groupBy("a").agg(F.min("b").alias("b")), sketches))
    apart = pairs.join(roots.select(F.col("id").alias("a"), F.col("root").alias("r")), "a", "left").join(roots.select(F.col("id").alias("b"), F.col("root").alias("s")), "b", "left")
    apart = apart.filter("coalesce(r, a) <> coalesce(s, b)").select("a", "b")
    roots = extended(roots, search.tested(apart, sketches))
    members = checkpointed(_open_bands(members, roots))
    tidy(spark)
    left = _pairs_of_small(members.filter(F.col("size") <= SMALL), percent)
    wide = members.filter(F.col("size") > SMALL)
    if not wide.isEmpty():
        sets = checkpointed(search.sets(wide.filter(F.col("n") <= WHOLE).select(F.col("id").alias("__wanted")).distinct()))
        large = checkpointed(_pairs_of_large(wide, sketches, sets, percent))
        roots = extended(roots, large.filter("sure").select("a", "b"))
        left = left.unionByName(large.filter("not sure").select("a", "b")).distinct()
    roots = extended(roots, search.tested(left, sketches))
    rep_roots = roots.select(F.col("id").alias("rep"), "root")
    reps = checkpointed(classes.join(rep_roots, "rep", "left").select(F.col("digest").alias("key"), "size", F.coalesce("root", "rep").alias("root")))
    out = sizes.join(reps, (F.col("digest") == F.col("key")) & (F.col("n") == F.col("size")), "left")
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("root", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("root", "id"), F.lit(True)).alias("kept"),
    )


def drop_near(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Columns of ``docs``, one document of each component."""
    kept = near_duplicates(docs, doc_id=doc_id, text=text, length=length, percent=percent).filter("kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    return keep_rows(docs, kept, (docs[doc_id].cast("long"), "__kept_id"))
