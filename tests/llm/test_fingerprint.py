"""Fingerprints and likenesses against plain sets, next documents against a sorted list."""

import hashlib
import random
import re

from seriesloom.llm import fingerprint

HARD = [(None, "no id. here\n"), (1, None), (2, ""), (3, "a. b. c. d. " * 30), (4, "x" * 3000), (4, "x" * 3000), (4, "Ünö. tèxt. "), (9, "one. two. three. four.")]


def _digests(text):
    return {int(hashlib.md5(x.encode()).hexdigest()[:15], 16) for x in re.findall(fingerprint.PARAGRAPH, text)}


def _brute(rows):
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for i, (k, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        near = []
        for other in (edited, after):
            a, b = _digests(t), _digests(other)
            near.append(len(a & b) / len(a | b) if a | b else 1.0)
        out.append((str(k), len(t), hashlib.sha256(edited.encode()).hexdigest(), *near))
    return sorted(out)


def _rows(df):
    return sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in df.collect())


def test_hard_rows(docs):
    frame = docs(HARD, "fingerprint")
    assert _rows(fingerprint.fingerprints(frame)) == _brute(HARD)
    assert _rows(fingerprint.fingerprints(frame, block_rows=1)) == _brute(HARD)
    assert fingerprint.fingerprints(frame.limit(0)).count() == 0
    assert _rows(fingerprint.fingerprints(docs([(5, "alone. again.")]))) == _brute([(5, "alone. again.")])


def test_any_difference_is_recovered(docs):
    rng = random.Random(3)
    rows = []
    for k in range(120):
        size = rng.choice([0, 1, 5, 12, 20, 40, 200, 1500])
        start = rng.randrange(3) * 7
        rows.append((k * 10, " ".join(f"sentence {i}." for i in range(start, start + size))))
    for block_rows in (7, 10_000):
        assert _rows(fingerprint.fingerprints(docs(rows), block_rows=block_rows)) == _brute(rows)


def test_equal_texts_have_equal_fingerprints(docs):
    rows = fingerprint.fingerprints(docs([(1, "a. b."), (2, "c. d."), (3, "a. b."), (4, "a. b. c.")])).collect()
    by_id = {r.doc_id: r.fingerprint for r in rows}
    assert by_id[1] == by_id[3] and len(set(by_id.values())) == 3


def test_plan_has_no_python_and_one_text_shuffle(spark, docs):
    plan = fingerprint.fingerprints(docs(HARD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
