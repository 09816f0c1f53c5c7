"""Ranked search against a brute-force score; the graph of additions against plain sums."""

import math
import random
import re
from collections import Counter

import numpy as np

from seriesloom.llm import search


def _terms(text):
    folded = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", folded)


def _brute(docs, items, top=10):
    words = [(k, Counter(_terms(t))) for k, t in docs]
    n_docs, total = sum(1 for _, c in words if c), sum(sum(c.values()) for _, c in words)
    df = Counter(t for _, c in words for t in c)
    sets = {}
    for item, text in items:
        sets.setdefault(item, set()).update(_terms(text))
    out = []
    for item, terms in sets.items():
        found = []
        for k, c in words:
            score = 0
            for t in terms & c.keys():
                m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, k is None, k or 0))
        out += [(str(item), i + 1, None if none else k, -s) for i, (s, none, k) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(120)] + ["É", "Tür2", "x_y"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 80)))) for k in range(300)]
    docs += [(None, "w1 W2 w3"), (400, None), (401, ""), (402, "--- ___"), (403, "w5 " * 5000), (7, "w1 w2"), (7, "w1 w2")]
    common = " ".join(words[:12])
    items = [(f"i{k}", (common if k % 3 == 0 else "") + " " + " ".join(rng.choice(words) for _ in range(rng.randint(1, 15)))) for k in range(40)]
    items += [("none", None), ("odd", "..."), (None, "w9 w8"), ("twice", "w1"), ("twice", "w2 w1"), ("far", "nowhere")]
    frame = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, score int").repartition(5)
    wanted = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id string, text string, doc_id int")
    for block_terms in (search.BLOCK_TERMS, 60):
        got = search.ranked(frame, wanted, block_terms=block_terms).collect()
        assert sorted(((str(r.item_id), r["rank"], r.doc_id, r.score) for r in got), key=str) == _brute(docs, items)
    assert search.ranked(frame.limit(0), wanted).count() == 0
    assert search.ranked(frame, wanted.limit(0)).count() == 0


def test_graph_adds_what_items_hold():
    rng = random.Random(4)
    for _ in range(30):
        items, classes = rng.randint(1, 25), rng.randint(1, 40)
        holders = [sorted(rng.sample(range(items), rng.randint(1, items))) for _ in range(classes)]
        graph = search.share(holders, items)
        parts = np.array([[rng.randint(0, 10**12) for _ in range(3)] for _ in range(classes)])
        want = np.array([sum((parts[c] for c in range(classes) if i in holders[c]), np.zeros(3, np.int64)) for i in range(items)])
        held = np.array([any(i in h for h in holders) for i in range(items)])
        assert (graph.sums(parts)[held] == want[held]).all()


def test_shared_sets_are_added_once():
    holders = [[0, 1, 2, 3]] * 8 + [[i] for i in range(4)]
    assert len(search.share(holders, 4).left) == 7 + 4


def test_long_texts_in_stretches(monkeypatch):
    text = ("alpha Beta gamma-2 " * 500).encode()
    whole = search.term_counts(text, {b"beta": 0, b"2": 1})
    monkeypatch.setattr(search, "STRETCH", 37)
    assert search.term_counts(text, {b"beta": 0, b"2": 1}) == whole
