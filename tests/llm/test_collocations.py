"""Collocations against a brute-force count."""

import random
import re
from collections import Counter

import pyarrow as pa

from seriesloom.llm import collocations


def _brute(rows, least, top):
    f, n, out = Counter(), Counter(), []
    for _, text, lang in rows:
        lang = lang or "und"
        folded = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    kept = {k: a for k, a in f.items() if a >= least}
    for (lang, p), a in kept.items():
        if len(p) == 1:
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        inside = any(g == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), b in kept.items())
        if not inside:
            out.append((lang, score, a, " ".join(p), left, right, n[lang]))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[1], -r[2], r[3].encode()))[:top]
        ranked += [(lang, i + 1, p, a, left, right, total, s) for i, (_, s, a, p, left, right, total) in enumerate(own)]
    return sorted(ranked)


def _texts(seed):
    rng = random.Random(seed)
    words = ["a", "B", "c", "dé", "É", "e-f", "x\x1cy", "it's"] + [f"w{i}" for i in range(60)]
    fixed = ["new york city", "a B c dé É", "york city", "c c c c c c"]
    rows = [(1, None, "en"), (2, "", None), (3, " \t.,;\n", "en")]
    for k in range(150):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(1, 60))]
        text = "".join(p + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " \r", "\x0b", " "]) for p in parts)
        rows.append((k, text, rng.choice(["en", "de", None, "und"])))
    return rows + rows[-3:]


def test_against_brute_force(spark):
    rows = _texts(1)
    frame = spark.createDataFrame([(k, t, g, 1) for k, t, g in rows], "doc_id long, text string, lang string, phrase int")
    for least, top in ((12, 1000), (5, 20)):
        got = sorted(tuple(r) for r in collocations.collocations(frame, least=least, top=top).collect())
        assert got == _brute(rows, least, top) and len(got) > 10
    assert collocations.collocations(frame.limit(0)).count() == 0


def test_stretches_and_full_buffers_lose_nothing(monkeypatch):
    text = " ".join(["one two three four five six"] * 50) + ". " + "x" * 300 + " one two"

    def counts():
        total = Counter()
        counter = collocations._Counter((3, 4, 5), (_All(), _All()), 3)
        batches = [*counter.add("en", text.encode()), *counter.add("en", text.encode()), *counter.flush()]
        for batch in batches:
            for r in batch.to_pylist():
                part = pa.table({k: [r[k]] for k in r})
                for p in collocations._merged(1)((pa.scalar(r["lang"]), pa.scalar(r["words"])), part).to_pylist():
                    total[p["phrase"]] += p["n"]
        return total

    whole = counts()
    monkeypatch.setattr(collocations, "STRETCH", 40)
    monkeypatch.setattr(collocations, "TOKENS", 10)
    assert counts() == whole and whole["six one two three four"] == 98


class _All:
    def has(self, lang, phrases):
        import numpy as np

        return np.ones(len(phrases), bool)


def test_bitmap_has_what_was_put_in(spark):
    rows = [("en", f"w{i} é") for i in range(5000)]
    known = collocations.bitmap(spark.createDataFrame(rows, "lang string, phrase string"))
    assert known.has(b"en", [p.encode() for _, p in rows]).all()
    assert known.has(b"de", [p.encode() for _, p in rows]).mean() < 0.1


def test_large_numbers_are_exact(spark):
    big = 4 * 10**12
    rows = [("en", 0, "", 9 * 10**13), ("en", 1, "a", big + 1), ("en", 1, "b", big + 3), ("en", 2, "a b", big)]
    (row,) = collocations.scored(spark.createDataFrame(rows, collocations.COUNTS)).collect()
    assert row.score == 1000 * big * 9 * 10**13 // ((big + 1) * (big + 3))
