"""SentencePiece encoding and decoding by a max-plus scan.

The best segmentation of a text maximises the sum of its pieces' scores (as the
model file stores them); a character without a piece costs less than the worst
piece and becomes byte pieces.  Two ways lead to the same ids:

* Texts of at most ``chunk`` characters are segmented where they stand.
* Longer ones are cut into chunks of ``chunk`` characters, each a row of its own.
  A chunk's transfer matrix holds, for every number of its first characters that
  the last piece of the chunk before may cover and every number of characters by
  which its own last piece may reach into the next, the best score in between.
  Matrices multiply in the max-plus sense, 64 at a time and level by level; going
  down again the levels fix each chunk's two boundary states, and every chunk is
  backtraced on its own.

Where no piece holds a space mark after another character, the place before a mark
is a cut in every segmentation; stretches between cuts are solved once and kept in
a bounded cache.

A space is written as the mark, one mark goes before the text; a literal mark
becomes byte pieces, so decoding gives the text back exactly.  Null texts give null,
empty ones no ids.  Ties go to the longer last piece, in chunks as well: sums are exact
where the file's scores are whole numbers, as in the default file.
"""

from __future__ import annotations

import re
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import checkpointed, small_batches

MARK = "▁"
CHUNK = 32_768
FAN = 64
CACHE = 200_000
UNIT = 64
ROWS = 2048
TOGETHER = 1_000_000
NEVER = float("-inf")
PENALTY = 10.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces with their scores, and the segmentation of a stretch of text."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.scores = {model.id_to_piece(i): float(model.get_score(i)) for i in plain}
        self.byte_ids = {int(model.id_to_piece(i)[3:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = min(self.scores.values()) - PENALTY
        self.longest = max(map(len, self.ids))
        self.starts: dict[str, float | None] = {p[:k]: None for p in self.ids for k in range(1, len(p))}
        self.starts.update(self.scores)
        self.raw = [b""] * n
        for piece, i in self.ids.items():
            self.raw[i] = piece.encode()
        for b, i in self.byte_ids.items():
            self.raw[i] = bytes([b])
        own_bytes = frozenset(self.byte_ids.values())
        self.plain = [raw if i in own_bytes else raw.replace(MARK.encode(), b" ") for i, raw in enumerate(self.raw)]
        self.units = self._cut_rule()
        self._build_steps()
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.worth = np.zeros(n)
        for piece, i in self.ids.items():
            self.worth[i] = self.scores[piece]
        for b, i in self.byte_ids.items():  # a character without a piece counts once, at its leading byte
            self.worth[i] = self.unknown if b & 0xC0 != 0x80 else 0.0

    def _cut_rule(self) -> re.Pattern | None:
        """Stretches between places that no piece spans: before marks, around newlines, before some punctuation."""
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            return None
        joined = {x for p in self.ids for x, y in zip(p, p[1:], strict=False) if y in string.punctuation and x.isalnum()}
        alone = "\n" if not any("\n" in p for p in self.ids if len(p) > 1) else ""
        word = f"{MARK}*[^\\W_{re.escape(''.join(sorted(joined)))}]+(?=[{re.escape(string.punctuation)}{MARK}{alone}]|\\Z)"
        rest = f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+"
        return re.compile("|".join(x for x in (alone, word, rest) if x))

    def forward(self, text: str, start: int = 0, entering: list[float] | None = None) -> tuple[list[float], list[int]]:
        """Best score of reaching every position from ``start``, and where its last piece began.

        ``entering`` has the scores of reaching the first positions by pieces that began
        before the text, which are marked by -1 and win ties.
        """
        n = len(text)
        best, back = [NEVER] * (n + 1), [0] * (n + 1)
        best[start] = 0.0
        if entering is not None:
            begun = min(len(entering), n + 1)
            best[:begun], back[:begun] = entering[:begun], [-1] * begun
        get, unknown, longest = self.starts.get, self.unknown, self.longest
        for i in range(start, n):
            here = best[i]
            single = get(text[i])
            value = here + (unknown if single is None else single)
            if value > best[i + 1]:
                best[i + 1] = value
                back[i + 1] = i
            for j in range(i + 2, min(i + longest, n) + 1):
                s = get(text[i:j], False)
                if s is None:  # only the beginning of a piece
                    continue
                if s is False:
                    break
                value = here + s
                if value > best[j]:
                    best[j] = value
                    back[j] = i
        return best, back

    def trace(self, text: str, back: list[int], start: int, end: int, literal: str) -> bytes:
        """Ids, as int32 bytes, of the path from ``start`` to ``end``."""
        out: list[int] = []
        while end > start:
            begin = back[end]
            piece = text[begin:end]
            known = self.ids.get(piece)
            if known is None:
                piece = MARK if piece == literal else piece
                out.extend(self.byte_ids[b] for b in reversed(piece.encode()))
            else:
                out.append(known)
            end = begin
        out.reverse()
        return array("i", out).tobytes()

    def unit(self, text: str, literal: str) -> bytes:
        """Ids of a stretch between two cuts."""
        found = self.cache.get(text) or self.older.get(text)
        if found is None:
            _, back = self.forward(text)
            found = self.trace(text, back, 0, len(text), literal)
        if len(text) < UNIT and not (literal and literal in text):
            if len(self.cache) >= CACHE:  # what is still in use moves on, the rest goes with the next turn
                self.cache, self.older = {}, self.cache
            self.cache[text] = found
        return found

    def stretch(self, text: str, literal: str) -> bytes:
        """The same for any text that starts and ends at cuts."""
        if self.units is None:
            return self.unit(text, literal)
        if literal:
            return b"".join([self.unit(u, literal) for u in self.units.findall(text)])
        return self.stretches([text])[0]

    def stretches(self, texts: list[str]) -> list[bytes]:
        """Several texts without literal marks: what the cache lacks is solved for all of them at once."""
        cut = [self.units.findall(text) for text in texts]
        if len(self.cache) >= CACHE:  # what is still in use moves on, the rest goes with the next turn
            self.cache, self.older = {}, self.cache
        cache, older = self.cache, self.older
        fresh = set().union(*cut).difference(cache)
        cache.update((u, older[u]) for u in fresh if u in older)
        fresh.difference_update(older)
        short = [u for u in fresh if len(u) < UNIT]
        cache.update(zip(short, self.solve(short), strict=True))
        once = [u for u in fresh if len(u) >= UNIT]
        for u in once:
            cache[u] = self.unit(u, "")
        out = [b"".join(map(cache.__getitem__, units)) for units in cut]
        for u in once:
            del cache[u]
        return out

    def solve(self, units: list[str]) -> list[bytes]:
        """Ids of many short stretches, a block of similar lengths at a time."""
        order = sorted(range(len(units)), key=lambda k: len(units[k]))
        out = [b""] * len(units)
        for i in range(0, len(order), ROWS):
            part = order[i : i + ROWS]
            for k, ids in zip(part, self._solve_block([units[k] for k in part]), strict=True):
                out[k] = self.unit(units[k], "") if ids is None else ids
        return out

    def _solve_block(self, units: list[str]) -> list[bytes | None]:
        """``forward`` and ``trace`` over rows of characters; None where a character has no piece."""
        rows, width = len(units), len(units[-1])
        size = np.array([len(u) for u in units])
        chars = np.zeros((rows, width), np.int64)
        chars[np.arange(width) < size[:, None]] = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        best = np.full((width + 1, rows), NEVER)
        best[0] = 0.0
        back, last = np.zeros((width + 1, rows), np.int64), np.full((width + 1, rows), -1, np.int32)
        known = np.ones(rows, bool)
        for i in range(width):
            at = np.flatnonzero(size > i)
            node = np.zeros(len(at), np.int64)
            for j in range(i + 1, min(i + self.longest, width) + 1):
                node = self._step(node, chars[at, j - 1])
                going = node >= 0
                if j == i + 1:
                    first = np.full(len(at), -1, np.int32)
                    first[going] = self.node_ids[node[going]]
                    known[at[first < 0]] = False
                at, node = at[going], node[going]
                if not len(at):
                    break
                ids = self.node_ids[node]
                value = np.where(ids >= 0, best[i, at] + self.node_scores[node], NEVER)
                better = value > best[j, at]
                won = at[better]
                best[j, won], back[j, won], last[j, won] = value[better], i, ids[better]
        ids = np.full((rows, width), -1, np.int32)
        end, row = size.copy(), np.flatnonzero(known & (size > 0))
        while len(row):
            begin = back[end[row], row]
            ids[row, begin] = last[end[row], row]
            end[row] = begin
            row = row[begin > 0]
        filled = ids >= 0
        raw, stops = ids[filled].tobytes(), (4 * np.cumsum(filled.sum(axis=1))).tolist()
        return [raw[a:b] if ok else None for a, b, ok in zip([0, *stops], stops, known.tolist(), strict=False)]

    def _build_steps(self) -> None:
        """Beginnings of pieces as nodes; (node, character) leads to the next node through a hash table."""
        texts = ["", *sorted(self.starts)]
        number = {t: k for k, t in enumerate(texts)}
        self.node_ids = np.array([self.ids.get(t, -1) for t in texts], np.int32)
        self.node_scores = np.array([self.scores.get(t, 0.0) for t in texts])
        key = np.array([number[t[:-1]] << 21 | ord(t[-1]) for t in texts[1:]], np.int64)
        self.slots = 1 << max(4, (4 * len(key)).bit_length())
        self.slot_key, self.slot_node = np.full(self.slots, -1, np.int64), np.full(self.slots, -1, np.int64)
        todo, node, slot = key, np.arange(1, len(texts)), self._slot(key)
        while len(todo):
            free = self.slot_key[slot] < 0
            self.slot_key[slot[free]] = todo[free]  # of several on one slot the last stays
            mine = self.slot_key[slot] == todo
            self.slot_node[slot[mine]] = node[mine]
            todo, node, slot = todo[~mine], node[~mine], (slot[~mine] + 1) % self.slots

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(40)) % np.uint64(self.slots)).astype(np.int64)

    def _step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Node after one more character, -1 if no piece begins that way."""
        key = node << 21 | char
        slot = self._slot(key)
        out, found = self.slot_node[slot], self.slot_key[slot]
        again = np.flatnonzero((found != key) & (found >= 0))
        out[found != key] = -1
        while len(again):
            slot[again] = (slot[again] + 1) % self.slots
            found = self.slot_key[slot[again]]
            hit = found == key[again]
            out[again[hit]] = self.slot_node[slot[again[hit]]]
            again = again[~hit & (found >= 0)]
        return out

    def cuts(self, text: str, low: int, high: int) -> tuple[int, int] | None:
        """First cut at or after ``low`` and last one at or before ``high``."""
        if self.units is None:
            return None
        first = last = None
        for m in self.units.finditer(text):
            if low <= m.start() <= high:
                first = m.start() if first is None else first
                last = m.start()
        return None if first is None else (first, last)

    def transfer(self, text: str, n: int, literal: str = "") -> np.ndarray:
        """Matrix [covered at the start, reach beyond n] of the chunk text[:n]; the rest of ``text`` is what follows."""
        width = self.longest
        out = np.full((width, width), NEVER)
        cut = self.cuts(text, width, n)
        reach = range(len(text) - n + 1)
        for i in range(min(width, n + 1)):
            if cut:
                out[i, 0] = self.forward(text[: cut[0]], i)[0][-1]
            else:
                self._into(out[i], self._forward_to(text, n, i)[0], n, reach)
        if cut:
            head, (first, last) = out[:, 0].copy(), cut
            middle = float(self.worth[np.frombuffer(self.stretch(text[first:last], literal), np.int32)].sum())
            tail = np.full(width, NEVER)
            self._into(tail, self._forward_to(text[last:], n - last)[0], n - last, reach)
            out = head[:, None] + middle + tail[None, :]
        return out

    def _forward_to(self, text: str, n: int, start: int = 0, entering: list[float] | None = None) -> tuple[list[float], list[int]]:
        """``forward`` in which no piece begins at or after ``n``: that is the next chunk's work."""
        best, back = self.forward(text[:n], start, entering)
        best, back = best + [NEVER] * (len(text) - n), back + [0] * (len(text) - n)
        for i in range(max(0, n - self.longest + 1), n):
            for j in range(n + 1, min(i + self.longest, len(text)) + 1):
                s = self.scores.get(text[i:j])
                if s is not None and best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, i
        return best, back

    def head(self, text: str, n: int) -> tuple[str, int]:
        """What ``origins`` needs of the chunk text[:n]: all of it, or the part before a cut that all paths pass, with -1."""
        cut = self.cuts(text, self.longest, n)
        return (text[: cut[0]], -1) if cut else (text, n)

    def origins(self, head: str, n: int, entering: np.ndarray) -> np.ndarray:
        """For every reach beyond the chunk how many of its first characters the chunk before
        covers on the best path there; -1 where no path leads.  ``entering`` has the best
        scores of the whole text up to each of these characters."""
        whole = len(head) if n < 0 else n
        best, back = self._forward_to(head, whole, 0, entering.tolist())
        origin: list[int] = []
        for j, (score, begin) in enumerate(zip(best, back, strict=True)):
            origin.append(-1 if score == NEVER else j if begin < 0 else origin[begin])
        if n < 0:
            return np.full(self.longest, origin[-1], np.int32)
        out = np.full(self.longest, -1, np.int32)
        ends = origin[whole : whole + self.longest]
        out[: len(ends)] = ends
        return out

    @staticmethod
    def _into(row: np.ndarray, best: list[float], n: int, reach: range) -> None:
        for o in reach:
            if o < len(row):
                row[o] = best[n + o]

    def between(self, text: str, n: int, enter: int, leave: int, literal: str) -> bytes:
        """Ids of a chunk whose boundary states are known."""
        body, size = text[enter:], n - enter
        if size <= 0:
            return b""
        cut = self.cuts(body, 0, size)
        head = last = 0
        ids = b""
        if cut and cut[1] > 0:
            first, last = cut
            if first:
                _, back = self.forward(body[:first])
                ids = self.trace(body, back, 0, first, literal)
            head = last
            ids += self.stretch(body[first:last], literal)
        _, back = self._forward_to(body[head:], size - head)
        return ids + self.trace(body[head:], back, 0, size - head + leave, literal)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; byte pieces stand for their bytes, every other mark for a space."""
        return b"".join(map(self.plain.__getitem__, ids.tolist())).decode("utf-8", "replace")


def prepared(text: str) -> tuple[str, str]:
    """Text with marks for spaces and one in front; the character that stands for literal marks."""
    literal = ""
    if MARK in text:
        literal = next(c for c in map(chr, range(0xFDD0, 0x10FFFF)) if c not in text and not 0xD800 <= ord(c) < 0xE000)
        text = text.replace(MARK, literal)
    return MARK + text.replace(" ", MARK), literal


_LOADED: dict[str, Vocabulary] = {}


def loaded(path: str) -> Vocabulary:
    """The vocabulary, once per worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode_text(vocabulary: Vocabulary, text: str) -> np.ndarray:
    if not text:
        return np.zeros(0, np.int32)
    whole, literal = prepared(text)
    return np.frombuffer(vocabulary.stretch(whole, literal), np.int32)


def encode_texts(vocabulary: Vocabulary, texts: list[str | None]) -> Iterator[np.ndarray | None]:
    """Ids of every text; about ``TOGETHER`` characters are segmented at once."""
    i = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held < TOGETHER):
            held += len(texts[j] or "")
            j += 1
        whole = {k: prepared(texts[k]) for k in range(i, j) if texts[k]}
        plain = [k for k, (_, literal) in whole.items() if not literal and vocabulary.units]
        found = dict(zip(plain, vocabulary.stretches([whole[k][0] for k in plain]) if plain else [], strict=True))
        for k in range(i, j):
            if texts[k]:
                yield np.frombuffer(found[k] if k in found else vocabulary.stretch(*whole[k]), np.int32)
            else:
                yield None if texts[k] is None else np.zeros(0, np.int32)
        i = j


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    return pa.array(rows, pa.list_(pa.int32()))


def _chunker(path: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = loaded(path).longest - 1
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole, literal = prepared(text)
                for i, a in enumerate(range(0, len(whole), chunk)):
                    part, n = whole[a : a + chunk + over], min(chunk, len(whole) - a)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row], pa.int64()), pa.array([i], pa.int64()), pa.array([part], pa.string()), pa.array([n], pa.int32()), pa.array([literal], pa.string())],
                        ["row", "i", "part", "n", "literal"],
                    )

    return run


def _matrices(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(path)
        for batch in batches:
            part, n, literal = (batch.column(c).to_pylist() for c in (2, 3, 4))
            found = [vocabulary.transfer(*x).tobytes() for x in zip(part, n, literal, strict=True)]
            heads = [vocabulary.head(*x) for x in zip(part, n, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.binary()), pa.array([h for h, _ in heads], pa.string()), pa.array([k for _, k in heads], pa.int32())],
                ["row", "i", "m", "head", "n"],
            )

    return run


def _square(raw: bytes) -> np.ndarray:
    m = np.frombuffer(raw)
    return m.reshape(int(len(m) ** 0.5), -1)


def _product(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("i")
    whole = None
    for raw in group["m"]:
        whole = _square(raw) if whole is None else max_plus(whole, _square(raw))
    return pd.DataFrame({"row": [group["row"].iloc[0]], "i": [group["i"].iloc[0] // FAN], "m": [whole.tobytes()]})


def _entering(group: pd.DataFrame) -> pd.DataFrame:
    """Best scores before each of up to FAN matrices, from those before their product."""
    group = group.sort_values("i")
    scores, found = np.frombuffer(group["v"].iloc[0]), []
    for raw in group["m"]:
        found.append(scores.tobytes())
        scores = (scores[:, None] + _square(raw)).max(axis=0)
    return pd.DataFrame({"row": group["row"], "i": group["i"], "v": found})


def _origins(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(path)
        for batch in batches:
            head, n, v = (batch.column(c).to_pylist() for c in (2, 3, 4))
            found = [vocabulary.origins(h, k, np.frombuffer(raw)).tobytes() for h, k, raw in zip(head, n, v, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["row", "i", "e"])

    return run


def _composed(group: pd.DataFrame) -> pd.DataFrame:
    """Up to FAN maps from reach to origin as one."""
    group = group.sort_values("i")
    whole = None
    for raw in group["e"].iloc[::-1]:
        e = np.frombuffer(raw, np.int32)
        whole = e if whole is None else np.where(whole < 0, -1, e[whole]).astype(np.int32)
    return pd.DataFrame({"row": [group["row"].iloc[0]], "i": [group["i"].iloc[0] // FAN], "e": [whole.tobytes()]})


def _states(group: pd.DataFrame) -> pd.DataFrame:
    """Boundary states of up to FAN chunks or blocks whose last reach is known."""
    group = group.sort_values("i", ascending=False)
    states = [int(group["leave"].iloc[0])]
    for raw in group["e"]:
        states.append(int(np.frombuffer(raw, np.int32)[states[-1]]))
    return pd.DataFrame({"row": group["row"], "i": group["i"], "enter": states[1:], "leave": states[:-1]})


def _backtrace(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(path)
        for batch in batches:
            _, _, part, n, literal, enter, leave = (c.to_pylist() for c in batch.columns)
            ids = [np.frombuffer(vocabulary.between(*x), np.int32) for x in zip(part, n, enter, leave, literal, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(ids)], ["row", "i", "ids"])

    return run


def _climbed(lowest: DataFrame, most: int, combine, column: str) -> list[DataFrame]:
    """The rows and the levels above them, FAN rows to one, up to one row a text."""
    levels = [lowest]
    while most:
        most //= FAN
        above = levels[-1].groupBy("row", F.expr(f"i div {FAN}")).applyInPandas(combine, f"row long, i long, {column}")
        levels.append(checkpointed(above))
    return levels


def _below(level: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of a level with what is known of the row above each, and that row's number ``up``."""
    above = known.withColumnsRenamed({"row": "r", "i": "up"})
    return level.join(above, (F.col("row") == F.col("r")) & (F.expr(f"i div {FAN}") == F.col("up"))).drop("r")


def _long_texts(long: DataFrame, path: str, chunk: int) -> DataFrame:
    """(row, ids) of texts longer than a chunk: ``long`` has row and text."""
    chunks = checkpointed(long.mapInArrow(_chunker(path, chunk), "row long, i long, part string, n int, literal string").repartition("row", "i"))
    first = checkpointed(chunks.mapInArrow(_matrices(path), "row long, i long, m binary, head string, n int"))
    most = chunks.agg(F.max("i")).first()[0] or 0
    levels = _climbed(first.select("row", "i", "m"), most, _product, "m binary")
    start = np.full(loaded(path).longest, NEVER)
    start[0] = 0.0
    before = levels[-1].select("row", "i", F.lit(bytearray(start.tobytes())).alias("v"))
    for below in levels[-2::-1]:
        before = checkpointed(_below(below, before).groupBy("row", "up").applyInPandas(lambda g: _entering(g.drop(columns="up")), "row long, i long, v binary"))
    maps = first.join(before, ["row", "i"]).select("row", "i", "head", "n", "v").mapInArrow(_origins(path), "row long, i long, e binary")
    levels = _climbed(checkpointed(maps), most, _composed, "e binary")
    top = levels[-1].select("row", "i", F.lit(0).alias("leave"), "e")
    states = top.groupBy("row").applyInPandas(_states, "row long, i long, enter int, leave int")
    for below in levels[-2::-1]:
        known = states.select("row", "i", "leave")
        states = checkpointed(_below(below, known).groupBy("row", "up").applyInPandas(lambda g: _states(g.drop(columns="up")), "row long, i long, enter int, leave int"))
    ready = chunks.join(states, ["row", "i"]).select("row", "i", "part", "n", "literal", "enter", "leave")
    ids = ready.mapInArrow(_backtrace(path), "row long, i long, ids array<int>")
    return ids.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "ids"))), lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, *, text: str = "text", model: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with ``ids``, the pieces of the text."""
    path = model or default_model()
    small_batches(docs.sparkSession)
    others = [docs[c] for c in docs.columns if c != "ids"]

    @F.arrow_udf("array<int>")
    def short(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = loaded(path)
        for column in texts:
            yield _lists(list(encode_texts(vocabulary, column.to_pylist())))

    is_long = F.coalesce(F.char_length(docs[text]) > chunk, F.lit(False))
    near = docs.filter(~is_long).select(*others, short.asNondeterministic()(docs[text]).alias("ids"))
    far = checkpointed(docs.filter(is_long).select(*others).withColumn("__row", F.monotonically_increasing_id()))
    found = _long_texts(far.select(F.col("__row").alias("row"), F.col(text).alias("text")), path, chunk).withColumnRenamed("row", "__place")
    return near.unionByName(far.join(found, far["__row"] == found["__place"]).drop("__row", "__place"))


def decode(rows: DataFrame, *, ids: str = "ids", text: str = "decoded", model: str | None = None) -> DataFrame:
    """``rows`` with the text of their ids; null ids give null."""
    path = model or default_model()
    small_batches(rows.sparkSession)

    @F.arrow_udf("string")
    def back(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = loaded(path)
        for column in columns:
            flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
            yield pa.array([None if null else vocabulary.decode(flat[a:b])[1:] for a, b, null in zip(starts, starts[1:], column.is_null().to_pylist(), strict=False)], pa.string())

    return rows.withColumn(text, back.asNondeterministic()(F.col(ids)))
