"""Surrogates for personal data.

Entities are found by pattern (mail, phone, card, IBAN, social security number, IP
address, secret token, name) and each gets a surrogate that is fixed by the key,
the kind and the entity, so the same person reads the same everywhere.

Codes and mail names pass through a keyed four-round Feistel network over their
characters: every character stays in its class (digit, Latin or Cyrillic, vowel or
consonant, upper or lower case), so format, script and length survive, and two
entities never share a surrogate.  Phones keep their country code, cards their
check digit rule, mails their top-level domain; national phones their leading 0.
Given names move within the list of their gender and script; one that stands alone and
is drawn again passes through the permutation instead, whose reserve no list bounds.

Collision checks run over all documents: a surrogate that is itself an entity of
the corpus, or that two entities share, is drawn again with the next tweak until
none is left.  Where so few surrogates exist that ``TURNS`` draws found no free one,
only that no two entities share one is asked for.  Entities that were drawn again are rare; up to ``max_broadcast`` of
them travel by broadcast, more by a join with the documents.

Null texts stay null, texts without entities stay as they are.  Rows that share an
id and text get the same result.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import checkpointed, small_batches

KEY = b"surrogates"
MAX_BROADCAST = 50_000
TURNS = 16

# Given names by script and gender.
NAMES = {
    ("latin", "f"): "Anna Maria Emma Laura Julia Sarah Elena Sofia Lena Clara Alice Marie Camille Carmen Lucia Isabel Hannah Emily Olivia Charlotte".split(),
    ("latin", "m"): "Peter Paul Thomas Martin David Daniel Michael Lucas Carlos Pablo Javier Miguel Pierre Louis Hugo Felix Jonas James William Robert".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Андрей Михаил Николай Владимир Павел".split(),
}
# Character classes that surrogates keep.
_CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеиоуэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ"]
_HEX = ["0123456789abcdef", "0123456789ABCDEF"]
_OF = {c: (k, i) for k, group in enumerate(_CLASSES) for i, c in enumerate(group)}
_GIVEN = {name: key for key, names in NAMES.items() for name in names}

_FIND = re.compile(
    r"(?P<mail>(?<![\w.+-])[\w.+-]*\w@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,})"
    r"|(?P<secret>(?<![\w/+])(?=[A-Za-z_-]*\d)(?:[0-9a-f]{24,}|[0-9A-F]{24,}|(?:sk|pk|ghp|AKIA)[-_]?[A-Za-z0-9]{16,})(?![\w/+]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)"
    r"|(?<![\w+.,/-])(?:[2-9]\d{2}(?P<gap>[ .-])[2-9]\d{2}(?P=gap)\d{4}|[1-9]\d{2}-\d{3}-\d{4}|0\d{1,4}[ /-]\d{3,4} ?\d{3,5}|0\d(?:[ .-]\d{2}){4})(?![\w/-]|[.,]\d))"
    r"|(?P<card>(?<![\w-])(?:\d[ -]?){12,18}\d(?![\w-]))"
    r"|(?P<name>(?<!\w)(?:" + "|".join(sorted(_GIVEN, key=len, reverse=True)) + r")(?: (?!(?:The|And|Der|Die|Das|Les?|El|La|Los|Las|Un|Une|Una)\b)[A-ZÀ-ÞА-Я][a-zß-ÿа-яё]{2,})?(?!\w))"
)


_HINT = re.compile(r"[0-9@]|" + "|".join(sorted(_GIVEN)))


def _word(key: bytes, *parts: str) -> bytes:
    return hmac.new(key, "\x1f".join(parts).encode(), hashlib.sha256).digest()


def permuted(text: str, key: bytes, kind: str, tweak: int, hexadecimal: bool = False) -> str:
    """Keyed permutation of the strings that have the character classes of ``text``; other characters stay."""
    groups = _HEX if hexadecimal else _CLASSES
    upper = hexadecimal and any(c in "ABCDEF" for c in text)
    place = [(int(upper), _HEX[upper].index(c)) if hexadecimal and c in _HEX[upper] else None if hexadecimal else _OF.get(c) for c in text]
    at = [i for i, p in enumerate(place) if p]
    half = (len(at) + 1) // 2
    value = {i: place[i][1] for i in at}
    shape = "".join(c if p is None else chr(65 + p[0]) for c, p in zip(text, place, strict=True))
    for turn in range(4):
        from_, to = (at[:half], at[half:]) if turn % 2 else (at[half:], at[:half])
        seed = _word(key, kind, str(tweak), str(turn), shape, ",".join(str(value[i]) for i in from_))
        stream = b"".join(hashlib.sha256(seed + bytes([k])).digest() for k in range(len(to) // 16 + 1))
        for n, i in enumerate(to):
            value[i] = (value[i] + int.from_bytes(stream[2 * n : 2 * n + 2], "big")) % len(groups[place[i][0]])
    return "".join(groups[place[i][0]][value[i]] if i in value else c for i, c in enumerate(text))


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _card(text: str, key: bytes, tweak: int) -> str:
    digits = re.sub(r"\D", "", text)
    if _luhn(digits[:-1]) != int(digits[-1]):
        fresh = permuted(digits, key, "number", tweak)
        while len(fresh) > 1 and _luhn(fresh[:-1]) == int(fresh[-1]):  # walk on to the next number that is no card either
            fresh = permuted(fresh, key, "number", tweak)
    else:
        body = permuted(digits[:-1], key, "card", tweak)
        fresh = body + str(_luhn(body))
    rest = iter(fresh)
    return re.sub(r"\d", lambda _: next(rest), text)


def _ip(text: str, key: bytes, tweak: int) -> str:
    parts = [int(x) for x in text.split(".")]
    for turn in range(4):
        from_, to = ((0, 1), (2, 3)) if turn % 2 else ((2, 3), (0, 1))
        seed = _word(key, "ip", str(tweak), str(turn), f"{parts[from_[0]]}.{parts[from_[1]]}")
        for n, i in enumerate(to):
            parts[i] = (parts[i] + seed[n]) % 256
    return ".".join(map(str, parts))


def _name(text: str, key: bytes, tweak: int) -> str:
    given, _, family = text.partition(" ")
    names = NAMES[_GIVEN[given]]
    if not family and tweak:
        return permuted(given, key, "given", tweak)
    if not family:
        order = sorted(names, key=lambda n: _word(key, "given", str(tweak), n))
        return order[(order.index(given) + 1) % len(order)]
    turn = _word(key, "turn", str(tweak), family)[0]
    return names[(names.index(given) + 1 + turn % (len(names) - 1)) % len(names)] + " " + permuted(family, key, "family", tweak)


def canonical(kind: str, text: str) -> str:
    """What makes two spellings one entity: the case of a mail address does not count."""
    return text.lower() if kind == "mail" else text


def surrogate(kind: str, text: str, key: bytes = KEY, tweak: int = 0) -> str:
    if kind == "mail":
        local, _, domain = text.lower().rpartition("@")
        host, _, top = domain.rpartition(".")
        return permuted(f"{local}@{host}", key, "mail", tweak) + "." + top
    if kind == "phone":
        lead = re.match(r"\+\d{1,3}(?=[ .(-])|0(?=\d)", text)
        return (lead[0] if lead else "") + permuted(text[lead.end() if lead else 0 :], key, "phone" + (lead[0] if lead else ""), tweak)
    if kind == "iban":
        return text[:2] + permuted(text[2:], key, "iban" + text[:2], tweak)
    if kind == "card":
        return _card(text, key, tweak)
    if kind == "ip":
        return _ip(text, key, tweak)
    if kind == "name":
        return _name(text, key, tweak)
    if kind == "secret" and (lead := re.match(r"(?:sk|pk|ghp|AKIA)[-_]?", text)):
        return lead[0] + permuted(text[lead.end() :], key, "secret" + lead[0], tweak)
    return permuted(text, key, kind, tweak, hexadecimal=kind == "secret" and bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text)))


def _digits(text: str) -> int:
    return sum(c.isdigit() for c in text)


def entities(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of every entity of a text; only lines that can hold one are searched."""
    at = 0
    while (hint := _HINT.search(text, at)) is not None:
        begin = text.rfind("\n", at, hint.start()) + 1 or at
        at = text.find("\n", hint.end())
        at = len(text) if at < 0 else at
        yield from _within(text, begin, at)


def _within(text: str, begin: int, end: int) -> Iterator[tuple[int, int, str]]:
    for m in _FIND.finditer(text, begin, end):
        if m.lastgroup == "card" and not 13 <= _digits(m[0]) <= 19 or m.lastgroup == "phone" and not 8 <= _digits(m[0]) <= 15:
            continue
        yield m.start(), m.end(), m.lastgroup


def replaced(text: str, key: bytes, again: dict[tuple[str, str], int]) -> tuple[str, int]:
    out, at, n = [], 0, 0
    for start, end, kind in entities(text):
        own = text[start:end]
        out += [text[at:start], surrogate(kind, own, key, again.get((kind, canonical(kind, own)), 0))]
        at, n = end, n + 1
    return "".join([*out, text[at:]]), n


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = sorted({(kind, canonical(kind, t[a:b])) for t in batch.column(0).to_pylist() if t for a, b, kind in entities(t)})
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["kind", "entity"])


def drawn(docs: DataFrame, *, text="text", key: bytes = KEY) -> DataFrame:
    """(kind, entity, surrogate, tweak) of every distinct entity, free of collisions."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def draw(kinds: pa.Array, owns: pa.Array, tweaks: pa.Array) -> pa.Array:
        return pa.array([surrogate(k, o, key, t) for k, o, t in zip(kinds.to_pylist(), owns.to_pylist(), tweaks.to_pylist(), strict=True)], pa.string())

    draw = draw.asNondeterministic()
    known = docs.select(docs[text]).filter(docs[text].isNotNull()).mapInArrow(_finder, "kind string, entity string").distinct().withColumn("tweak", F.lit(0))
    table = checkpointed(known.withColumn("surrogate", draw("kind", "entity", "tweak")))
    while True:
        real = table.select(F.col("kind").alias("k"), F.col("entity").alias("surrogate"))
        taken = table.join(real, (table["kind"] == real["k"]) & (table["surrogate"] == real["surrogate"]), "left_semi").filter(table["tweak"] < TURNS).select("kind", "entity")
        twice = table.groupBy("kind", "surrogate").agg(F.min("entity").alias("stays"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = table.join(twice, ["kind", "surrogate"]).filter("entity <> stays").select("kind", "entity")
        clash = checkpointed(taken.unionByName(shared).distinct())
        if clash.isEmpty():
            return table
        marked = table.join(clash.withColumn("clash", F.lit(1)), ["kind", "entity"], "left")
        redrawn = marked.select("kind", "entity", (F.col("tweak") + F.coalesce("clash", F.lit(0))).alias("tweak"), "surrogate", "clash")
        fresh = redrawn.filter("clash = 1").drop("surrogate", "clash").withColumn("surrogate", draw("kind", "entity", "tweak"))
        table = checkpointed(redrawn.filter("clash is null").drop("clash").unionByName(fresh))


def pseudonymise(docs: DataFrame, *, text="text", key: bytes = KEY, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``docs`` with surrogates in the text, and ``n_entities``."""
    again = drawn(docs, text=text, key=key).filter("tweak > 0")
    others = [docs[c] for c in docs.columns if c not in (text, "n_entities")]
    few = again.limit(max_broadcast + 1).collect()
    result = "text string, n long"
    if len(few) <= max_broadcast:
        shared = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["entity"]): r["tweak"] for r in few})

        @F.arrow_udf(result)
        def change(texts: pa.Array) -> pa.Array:
            return _changed(texts.to_pylist(), key, [shared.value] * len(texts))

        changed = docs.select(*others, change.asNondeterministic()(docs[text]).alias("__r"))
    else:

        @F.arrow_udf("array<struct<kind:string,entity:string>>")
        def find(texts: pa.Array) -> pa.Array:
            rows = [sorted({(k, canonical(k, t[a:b])) for a, b, k in entities(t)}) if t else [] for t in texts.to_pylist()]
            return pa.array([[{"kind": k, "entity": e} for k, e in r] for r in rows], pa.list_(pa.struct([("kind", pa.string()), ("entity", pa.string())])))

        content = F.sha2(docs[text], 256)
        each = docs.select(content.alias("__key"), F.explode(find.asNondeterministic()(docs[text])).alias("e")).select("__key", "e.kind", "e.entity").distinct()
        own = each.join(again, ["kind", "entity"]).groupBy("__key").agg(F.collect_list(F.struct("kind", "entity", "tweak")).alias("__again"))

        @F.arrow_udf(result)
        def change_own(texts: pa.Array, lists: pa.Array) -> pa.Array:
            return _changed(texts.to_pylist(), key, [{(x["kind"], x["entity"]): x["tweak"] for x in r or []} for r in lists.to_pylist()])

        joined = docs.join(own, content == own["__key"], "left")
        changed = joined.select(*others, change_own.asNondeterministic()(docs[text], F.col("__again")).alias("__r"))
    return changed.select(*[c for c in docs.columns if c not in (text, "n_entities")], F.col("__r.text").alias(text), F.col("__r.n").alias("n_entities"))


def _changed(texts: list, key: bytes, again: list[dict]) -> pa.Array:
    rows = [(None, 0) if t is None else replaced(t, key, a) for t, a in zip(texts, again, strict=True)]
    return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["text", "n"])
