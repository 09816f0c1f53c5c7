"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in native expressions.

A text is cut into short paragraphs: up to a newline or a mark of ``.!?``, and after 200
characters without one.  The distinct paragraphs' 60-bit digests are hashed into three
segments of eight cells; a cell holds how many digests fell into it, their exclusive-or
and that of their check values.  The cells and the number of paragraphs are the
fingerprint, of one size for every text.

Two fingerprints are compared by subtracting cell from cell: digests of both texts
cancel out.  Peeling takes a digest from each cell that holds a single one, out of its
other cells too, until all cells are empty.  Where peeling gets stuck the sketch was too
small: both texts' digests are sketched anew four times as large (by two more bits of
the digest, into a sketch each) and only what is still stuck is made larger again.
Digests that no bit of 28 parts would be compared as plain sets.  The likeness is the
share of digests both texts have among all of either; two empty texts are alike (1).

The next document of a row is the one that follows by ascending id; rows are dealt to
blocks of consecutive ids, and the first rows of a block visit the block before, so each
block sees its successor and no global order is ever built.

Null text is empty.  A null id is smaller than any other.  Rows that share an id are
documents of their own, in the order of their texts.  A single document is its own
next one.  Very long texts take more sketches, not larger ones: the work grows with
their length.  Further columns of the input are not read and may have any name.  An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_BITS = 3
LEVELS = 14
ROUNDS = 16
BLOCK_ROWS = 256
MAX_BLOCKS = 1 << 16
PARAGRAPH = r"[^.!?\n]{0,199}[.!?\n]|[^.!?\n]{1,200}"

_SIDE = 1 << SEGMENT_BITS
_CELLS = [(SEGMENT_BITS * i, p) for i in range(3) for p in range(_SIDE)]  # where a cell's place stands in a digest, and the place


def _check(key: str) -> str:
    """A check value that exclusive-or does not carry over from its parts."""
    return f"(({key} % 2147483629) * ({key} % 2147483587))"


def _hits(key: str, shift: int, place: int) -> str:
    return f"({key} & {(_SIDE - 1) << shift}L) = {place << shift}L"


def digests(text: str) -> str:
    """Distinct 60-bit digests of the paragraphs of ``text``."""
    pattern = PARAGRAPH.replace("\\", "\\\\")
    return f"array_distinct(transform(regexp_extract_all({text}, '{pattern}', 0), x -> cast(conv(left(md5(x), 15), 16, 10) as bigint)))"


def sketch(keys: str) -> str:
    """Cells (n, k, c) of a list of digests."""
    step = f"(s, k) -> struct(s.n + 1 as n, s.k ^ k as k, s.c ^ {_check('k')} as c)"
    cells = [f"aggregate(filter({keys}, k -> {_hits('k', *cell)}), struct(0 as n, 0L as k, 0L as c), {step})" for cell in _CELLS]
    return f"array({', '.join(cells)})"


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> struct(x.n - y.n as n, x.k ^ y.k as k, x.c ^ y.c as c))"


def peel(cells: str) -> str:
    """struct(cells, d, done): the cells left when no digest can be taken out any more, and how many were."""
    pure = f"array_distinct(filter(s.cells, c -> abs(c.n) = 1 and c.c = {_check('c.k')}))"
    without = "(c, q) -> struct(c.n - q.n as n, c.k ^ q.k as k, c.c ^ q.c as c)"
    cells_left = [f"aggregate(filter(pure, q -> {_hits('q.k', *cell)}), s.cells[{i}], {without})" for i, cell in enumerate(_CELLS)]
    taken = f"struct(array({', '.join(cells_left)}) as cells, s.d + size(pure) as d, false as done)"
    none = "struct(s.cells as cells, s.d as d, true as done)"
    step = f"if(s.done, s, transform(array({pure}), pure -> if(size(pure) = 0, {none}, {taken}))[0])"
    return f"aggregate(sequence(1, {ROUNDS}), struct({cells} as cells, 0 as d, false as done), (s, r) -> {step})"


def _peeled(a: str, b: str, cells: str) -> str:
    """array(struct(a, b, d)): what came out of one sketch; d is null where it was too small."""
    empty = "not exists(s.cells, c -> c.n <> 0 or c.k <> 0)"
    return f"transform(array({peel(cells)}), s -> struct({a} as a, {b} as b, if({empty}, s.d, null) as d))[0]"


def differing(a: str, b: str, cells_a: str, cells_b: str) -> str:
    """Number of digests that only one of the lists ``a`` and ``b`` has."""
    first = f"array({_peeled(a, b, subtract(cells_a, cells_b))})"
    part = "filter(r.{0}, k -> (shiftright(k, 58 - 2 * t) & 3) = q)"
    smaller = f"transform(sequence(0, 3), q -> struct({part.format('a')} as a, {part.format('b')} as b))"
    again = f"transform(flatten(transform(stuck, r -> {smaller})), o -> {_peeled('o.a', 'o.b', subtract(sketch('o.a'), sketch('o.b')))})"
    total = "aggregate(filter({0}, r -> r.d is not null), {1}, (n, r) -> n + r.d)"
    stuck = "filter({0}, r -> r.d is null)"
    start = f"transform(array({first}), f -> struct({stuck.format('f')} as stuck, {total.format('f', '0')} as d))[0]"
    more = f"transform(array(z.stuck), stuck -> transform(array({again}), f -> struct({stuck.format('f')} as stuck, {total.format('f', 'z.d')} as d))[0])[0]"
    every = f"aggregate(sequence(0, {LEVELS - 1}), {start}, (z, t) -> if(size(z.stuck) = 0, z, {more}))"
    plain = "aggregate(z.stuck, z.d, (n, r) -> n + size(array_except(r.a, r.b)) + size(array_except(r.b, r.a)))"
    return f"transform(array({every}), z -> {plain})[0]"


def likeness(a: str, b: str, d: str) -> str:
    """Shared digests among all digests of lists ``a`` and ``b`` that differ in ``d``."""
    both = f"(size({a}) + size({b}))"
    return f"if({both} = 0, 1.0D, cast({both} - {d} as double) / cast({both} + {d} as double))"


def written(keys: str, cells: str) -> str:
    """Fingerprint as text: number of paragraphs, then the cells."""
    return f"concat(size({keys}), ':', array_join(transform({cells}, c -> concat(c.n, '.', hex(c.k), '.', hex(c.c))), ','))"


def _blocks(docs: DataFrame, key: Column, block_rows: int) -> tuple[list[int], int | None]:
    """First ids of blocks of about ``block_rows`` rows (a sample by hash, ``MAX_BLOCKS`` or so at most), and the least id."""
    rows, least = docs.select(key.alias("k")).agg(F.count(F.lit(1)), F.min("k")).first()
    wanted = min(MAX_BLOCKS, rows // block_rows)
    if not wanted:
        return [], least
    drawn = docs.select(key.alias("k")).filter(F.pmod(F.xxhash64("k"), F.lit(rows)) < wanted).distinct()
    return sorted(r.k for r in drawn.collect() if r.k > least), least


def with_next(docs: DataFrame, columns: dict[str, str], *, doc_id: str = "doc_id", text: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, text, *columns, next_text, next_*) of every row; ``columns`` are expressions of ``text``."""
    key = F.coalesce(docs[doc_id].cast("long"), F.lit(-(2**63)))
    firsts, least = _blocks(docs, key, block_rows)
    bounds = f"cast(split('{','.join(map(str, firsts))}', ',') as array<bigint>)" if firsts else "cast(array() as array<bigint>)"
    steps = ", ".join(str(1 << i) for i in reversed(range(len(firsts).bit_length()))) or "0"
    rank = f"aggregate(array({steps}), 0, (lo, s) -> if(lo + s <= {len(firsts)}, if(get({bounds}, lo + s - 1) <= key, lo + s, lo), lo))"
    rows = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"), key.alias("key")).withColumn("block", F.expr(rank))
    own = F.struct(F.col("block"), F.lit(0).alias("visit"))
    before = F.when(F.expr(f"get({bounds}, block - 1) = key"), F.struct((F.col("block") - 1).alias("block"), F.lit(1).alias("visit")))
    around = F.when(F.col("key") == F.lit(least).cast("long"), F.struct(F.lit(len(firsts)).alias("block"), F.lit(2).alias("visit")))
    placed = rows.select("doc_id", "text", "key", F.explode(F.array_compact(F.array(own, before, around))).alias("at"))
    placed = placed.select("doc_id", "text", "key", "at.block", "at.visit").repartition("block")
    for name, expression in columns.items():
        placed = placed.withColumn(name, F.expr(expression))
    follow = Window.partitionBy("block").orderBy("visit", "key", "text")
    seen = placed.select("*", *[F.lead(c).over(follow).alias(f"next_{c}") for c in ("text", *columns)])
    return seen.filter("visit = 0").drop("key", "block", "visit")


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has the last quarter of the characters replaced by the first as many of the next document.
    """
    rows = with_next(docs, {"keys": digests("text"), "cells": sketch("keys")}, doc_id=doc_id, text=text, block_rows=block_rows)
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("cut", F.expr("n_chars div 4"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, int(n_chars - cut)), substring(next_text, 1, int(cut)))"))
    rows = rows.withColumn("edited_keys", F.expr(digests("edited"))).withColumn("edited_cells", F.expr(sketch("edited_keys")))
    rows = rows.withColumn("d_edited", F.expr(differing("keys", "edited_keys", "cells", "edited_cells")))
    rows = rows.withColumn("d_next", F.expr(differing("keys", "next_keys", "cells", "next_cells")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.expr(written("keys", "cells")).alias("fingerprint"),
        F.expr(written("edited_keys", "edited_cells")).alias("edited_fingerprint"),
        F.expr(likeness("keys", "edited_keys", "d_edited")).alias("near_edited"),
        F.expr(likeness("keys", "next_keys", "d_next")).alias("near_next"),
    )
