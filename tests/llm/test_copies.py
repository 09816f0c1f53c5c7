"""Exact copies, near copies, repeated lines and benchmark passages against brute force."""

import hashlib
import random
import re

import numpy as np

from seriesloom.llm import decontaminate, exact_dedup, line_dedup, near_dedup
from seriesloom.llm.common import checkpointed, table
from seriesloom.llm.queries import op6_decontaminate  # noqa: F401 - imported by name elsewhere

HARD = [(None, "a b c d e f"), (1, None), (2, ""), (3, "A b\nC"), (4, "a B\nc"), (4, "a B\nc"), (5, "É"), (6, "é"), (7, "long " * 40_000), (8, "long " * 40_000)]


def test_exact_against_brute_force(docs):
    rows = exact_dedup.exact_duplicates(docs(HARD, "keep_id")).collect()
    norm = {}
    for k, t in HARD:
        norm.setdefault((t or "").translate({c: c + 32 for c in range(65, 91)}), []).append(k)
    want = sorted(
        (str(k), str(max((x for x in ks if x is not None), default=None)), len(ks), hashlib.sha256(t.encode()).hexdigest()) for t, ks in norm.items() for k in ks
    )
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in rows) == want


def test_drop_exact_leaves_one(docs):
    frame = docs(HARD, "keep_id")
    out = exact_dedup.drop_exact(frame)
    assert out.columns == frame.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(["None", "2", "4", "5", "6", "8"])
    assert exact_dedup.drop_exact(frame.limit(0)).count() == 0


def _near_brute(rows, percent=75):
    sets = {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((k, len(s), find(k), find(k) == k) for k, s in sets.items())


def test_near_against_brute_force(docs):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, k = [(900, None), (901, ""), (902, "one two"), (903, "ONE two"), (904, "one  two three four five"), (905, "x " * 5000)], 0
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 20, 60, 200]))] + rng.choice([passage, []])
        for _ in range(rng.choice([1, 2, 12, 30])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((k, " ".join(copy)))
            k += 1
    got = near_dedup.near_duplicates(docs(rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == _near_brute(rows)


def test_blocks_against_brute_force():
    rng = np.random.default_rng(8)
    for sides in ([0], [0, 1]):
        rows, base = [], None
        for k in range(120):
            if k % 12 == 0:
                base = np.unique(rng.integers(0, 2**63, rng.choice([6, 40, 250, 300]), dtype=np.uint64))
            members = np.unique(np.concatenate((base[rng.random(len(base)) > 0.08], rng.integers(0, 2**63, 1, dtype=np.uint64))))
            small = len(members) <= near_dedup.WHOLE
            rows.append((k, k, len(members), sides[k % len(sides)], None if small else near_dedup.registers(members).tobytes(), members.tobytes() if small else None))
            rows[-1] += (set(members.tolist()),)
        found = list(near_dedup._compared([r[:6] for r in rows], 75))
        linked = {(b[0], a[0]): len(a[6] & b[6]) * 100 >= 75 * len(a[6] | b[6]) for a in rows for b in rows if a[0] < b[0] and (len(sides) == 1 or a[3] != b[3])}
        true = [p for p, yes in linked.items() if yes]
        assert all(linked[(a, b)] for a, b, sure in found if sure)

        def classes(pairs):
            up = list(range(120))
            for a, b in sorted(pairs):
                x, y = up[a], up[b]
                up = [min(x, y) if u in (x, y) else u for u in up]
            return up

        assert true and classes([(a, b) for a, b, sure in found if sure or linked[(a, b)]]) == classes(true)


def test_near_hard_cases(docs):
    frame = docs([(None, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, "")])
    out = near_dedup.drop_near(frame)
    assert out.columns == frame.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "4", "None"]
    assert near_dedup.near_duplicates(frame.limit(0)).count() == 0


def _leaks(rows, items, size=10):
    import re

    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    lower = {c: c + 32 for c in range(65, 91)}
    grams = {}
    for k, t in items:
        w = word.findall((t or "").translate(lower))
        n = min(size, len(w))
        for i in range(len(w) - n + 1) if n else []:
            grams.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = []
    for k, t in rows:
        w, hit, found = word.findall((t or "").translate(lower)), set(), set()
        for g, ks in grams.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found |= ks
        out.append((k, len(w), len(hit), sorted(map(str, found))))
    return sorted(out)


def test_leaks_against_brute_force_in_one_and_many_blocks(spark, docs):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(40)] + ["été", "x1"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 10, 14, 25])))) for i in range(30)] + [(30, None), (31, "")]
    rows = [(900, None), (901, ""), (902, "...")]
    for k in range(80):
        part = items[rng.randrange(30)][1].upper().split() if k % 2 else []
        rows.append((k, ", ".join([rng.choice(vocabulary) for _ in range(rng.randint(0, 30))] + part[rng.randint(0, 2) :])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = _leaks(rows, items)
    for limit in (10_000, 40):
        got = decontaminate.contamination(docs(rows, "spans"), bench, max_windows=limit).collect()
        assert sorted((r.doc_id, r.n_words, sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2])), r["items"]) for r in got) == want
        kept = decontaminate.drop_contaminated(docs(rows, "spans"), bench, max_windows=limit).collect()
        assert sorted(r.doc_id for r in kept) == [k for k, _, n, _ in want if not n]
    cut = {r.doc_id: r.text for r in decontaminate.cut_spans(docs(rows, "spans"), bench).collect()}
    before = dict(rows)
    assert all((cut[k] == before[k]) == (not n) for k, _, n, _ in want)


def test_no_items_and_no_documents(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs([(1, "a b")]), bench).collect()[0]["items"] == []
    assert decontaminate.drop_contaminated(docs([(1, "a b")]).limit(0), bench).count() == 0


def test_repeated_lines(docs):
    rows = [(2, "a\nb\nc\nd"), (1, "x\na\nb\nc\ny"), (3, "p\np\np\np"), (4, "a\nb"), (5, None), (6, ""), (None, "q\nr\ns"), (7, "q\nr\ns")]
    out = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.drop_repeated_lines(docs(rows, "gone")).collect()}
    assert out[1] == (5, 0, "x\na\nb\nc\ny") and out[2] == (4, 3, "d") and out[3] == (4, 3, "p")
    assert out[4] == (2, 0, "a\nb") and out[5] == (0, 0, None) and out[6] == (1, 0, "")
    assert out[None] == (3, 0, "q\nr\ns") and out[7] == (3, 3, "")


def test_long_lines_are_cut(docs):
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    passage, prose = words(51), " ".join(words(rng.randrange(5, 20)) + "." for _ in range(9))
    rows = [(1, f"{words(9)}\n{passage}\n{words(7)}"), (2, f"{words(30)}\n{passage}"), (3, passage), (4, words(60)), (5, f"{words(20)}. {prose}"), (6, f"{words(41)}. {prose} {words(3)}")]
    texts = dict(rows)
    for text in [*texts.values(), " a  b.\n\n c! d \n", "x" * 100_000, ". . .\n"]:
        assert "".join(re.findall(line_dedup.LINE, text)) == text
    out = {r.doc_id: r for r in line_dedup.drop_repeated_lines(docs(rows, "gone")).collect()}
    assert out[1].text == texts[1] and out[4].text == texts[4] and out[5].text == texts[5]
    assert out[2].text == texts[2].split("\n")[0] and out[3].text == ""
    assert out[6].n_removed >= 3 and texts[6].startswith(out[6].text[:200])


def test_no_long_line_stays_twice(spark):
    rows = line_dedup.drop_repeated_lines(table(spark, "/root/testdata/sf0.01", "documents")).select("text").collect()
    lines = [x for r in rows for x in (r.text or "").split("\n") if len(x.split()) > 50]
    assert lines and len(lines) == len(set(lines))


def test_many_lines_and_no_lines(docs):
    many = "\n".join(["same"] * 40_000)
    out = line_dedup.drop_repeated_lines(docs([(1, many), (2, many + "\nend")], "n_lines")).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in out} == {1: (40_000, 39_999, "same"), 2: (40_001, 40_000, "end")}
    assert line_dedup.drop_repeated_lines(docs([(1, "a")]).limit(0)).collect() == []


def test_components_with_more_links(spark, monkeypatch):
    rng = random.Random(2)
    made = []
    monkeypatch.setattr(near_dedup, "checkpointed", lambda df: made.append(1) or checkpointed(df))
    frame = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    roots = near_dedup.connected(frame([(5, 1), (1, 7), (9, 2), (9, 2), (4, 4)]))
    assert sorted(map(tuple, roots.collect())) == [(5, 1), (7, 1), (9, 2)] and len(made) == 1  # stars need no round
    first, second = ([(rng.randrange(200), rng.randrange(200)) for _ in range(n)] for n in (90, 60))
    chain = [(i, i + 1) for i in range(300, 340)]
    roots = near_dedup.connected(frame(first + chain))
    assert near_dedup.extended(roots, frame(first[:20])) is roots
    up = {k: k for pair in first + second + chain + [(20, 330)] for k in pair}

    def top(k):
        return k if up[k] == k else top(up[k])

    def want(pairs):
        for a, b in pairs:
            x, y = sorted((top(a), top(b)))
            up[y] = x
        return sorted((k, top(k)) for k in up if top(k) != k)

    assert sorted(map(tuple, roots.collect())) == want(first + chain)
    assert sorted(map(tuple, near_dedup.extended(roots, frame(second + [(20, 330)])).collect())) == want(second + [(20, 330)])
