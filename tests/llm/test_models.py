"""Learned operators: exactness of their parts, held-out accuracy, hard cases."""

import numpy as np
import pyarrow as pa

from seriesloom.llm import language_id, lm_score, quality
from seriesloom.llm.common import table, utf8

SF = "/root/testdata/sf0.01"


def test_code_lengths_are_exact():
    text = "the cat sat on the mat and the dog sat too " * 9
    keys, _ = language_id.grams(*utf8(pa.array([text])))
    own, n = np.unique(keys, return_counts=True)
    tree = language_id.Tree(own, n.astype(float))
    for key in [*own[:25], np.uint64(0x2020202020)]:
        every = (key & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
        assert abs((2.0 ** -tree.cost(every)).sum() - 1) < 1e-9


def test_language_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_hard_cases(spark):
    schema = "doc_id long, text string, lang string, score int"
    rows = [(i, f"the house and the garden number {i}", "en", 1) for i in range(40)] + [(100 + i, f"das haus und der garten nummer {i}", "de", 1) for i in range(40)]
    rows += [(200, None, None, 1), (201, "", "en", 1), (202, "123 ...", "en", 1), (None, "der garten", None, 1), (203, "the house " * 50_000, None, 1)]
    out = {r.doc_id: (r.lang_pred, r.held_out) for r in language_id.identify(spark.createDataFrame(rows, schema)).collect()}
    assert [out[k][0] for k in (200, 201, 202, None, 203)] == ["und", "und", "und", "de", "en"] and out[None][1]
    alone = spark.createDataFrame([(1, "abc", None, 1)], schema)
    assert language_id.identify(alone).first().lang_pred == "und" and language_id.identify(alone.limit(0)).count() == 0


def test_quality_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = quality.score_quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.quality == r.predicted for r in rows) / len(rows) > 0.95


def test_quality_hard_cases(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (None, "a b", "s"), (3, "w " * 100_000, "s")], "doc_id long, text string, __score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.score_quality(docs, none).collect()
    assert len(out) == 4 and all(r.score == 0.5 for r in out)
    assert quality.drop_low_quality(docs.drop("__score"), none).count() == 4
    some = spark.createDataFrame([(1, 1, 0), (1, None, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality.score_quality(docs, some).collect())
    assert quality.score_quality(docs.limit(0), some).count() == 0


def test_trees_walk_as_they_were_grown():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < 0)).astype(float)
    forest = quality.grow(x, y, trees=30)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.97

    def one(row):
        total = forest.start
        for f, limit, leaf in zip(forest.feature, forest.limit, forest.leaf):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(row[f[k]] > limit[k])
            total += leaf[k - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([one(r) for r in x[:50]], forest.score(x[:50]))


def test_scores_against_one_place_at_a_time(spark):
    docs = table(spark, SF, "documents").limit(60)
    net = lm_score.fit(docs, rounds=1)
    rows = {r.doc_id: r for r in lm_score.score(docs, net=net).collect()}
    for d in docs.limit(5).collect():
        symbols, _ = net.encode(pa.array([d.text]))
        at = np.flatnonzero(symbols < net.symbols)
        want = sum(float(np.log(net.predict(symbols, at[i : i + 1])[1][0, symbols[at[i]]])) for i in range(len(at)))
        assert rows[d.doc_id].n_tokens == len(at) and abs(rows[d.doc_id].log_prob - want) < 1e-2 * max(1, abs(want) ** 0.5)


def test_network_beats_word_shares(spark):
    docs = table(spark, SF, "documents")
    net = lm_score.fit(docs)
    got = lm_score.score(docs, net=net).toPandas()
    counts = np.zeros(net.symbols)
    for r in docs.select("text").collect():
        s, _ = net.encode(pa.array([r.text]))
        counts += np.bincount(s[s < net.symbols], minlength=net.symbols)
    share = counts / counts.sum()
    unigram = (counts[counts > 0] * np.log(share[counts > 0])).sum()
    assert got["n_tokens"].sum() == counts.sum() and got["log_prob"].sum() > unigram


def test_score_hard_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "a", 1), (3, "a b " * 60_000, 1)], "doc_id long, text string, log_prob int")
    out = {r.doc_id: r for r in lm_score.score(docs).collect()}
    assert out[1].log_prob == out[2].log_prob == 0 and out[None].n_tokens == 1 and out[3].n_tokens == 120_000 and out[3].log_prob < 0
    assert lm_score.score(docs.limit(0)).count() == 0


def test_words_of_a_bucket_have_their_own_price(spark):
    """Counts, spelling and look-up against the plain formula; garbled words and texts without spaces cost more."""
    many = [f"word{i % 300:03d}" for i in range(3000)] + ["zwilling"] * 4 + ["qxjzkw"]
    docs = spark.createDataFrame([(1, " ".join(many)), (2, "zwilling"), (3, "qxjzkw"), (4, "nospace" * 40)], "doc_id long, text string")
    counts = lm_score.word_counts(docs)
    net = lm_score.fit(docs, counts=counts)
    n = {r.word: r.n for r in counts.collect()}
    assert n["zwilling"] == 5
    symbols = {r.doc_id: r.log_prob for r in lm_score.score(docs, net=net).collect()}
    for near in (0, 1 << 18):
        shares = lm_score.fit_shares(counts, net, near=near)
        assert len(shares.near) == (near and sum(len(w) <= lm_score.SPELLED for w in n) - len(net.frequent))
        got = {r.doc_id: r.log_prob for r in lm_score.score(docs, net=net, shares=shares).collect()}

        def inner(word):
            w = lm_score.words(*utf8(pa.array([word])), lm_score.SPACED)
            if w.value[0] in net.frequent:
                return 0.0
            c = int(w.value[0] % np.uint64(lm_score.BUCKETS))
            codes = [256, *word.encode(), 256]
            spell = shares.escape[c] / shares.total[c] * np.exp(sum(shares.follow[a, b] for a, b in zip(codes, codes[1:])))
            return np.log((n[word] - 0.5 if len(word) <= lm_score.SPELLED else 0) / shares.total[c] + spell)

        for r in docs.collect():
            assert abs(got[r.doc_id] - symbols[r.doc_id] - sum(map(inner, r.text.split()))) < 1e-6 * abs(got[r.doc_id])
        unseen = spark.createDataFrame([(1, "zwillinge"), (2, "zwilling"), (3, "#~^%")], "doc_id long, text string")
        out = {r.doc_id: r.log_prob - s.log_prob for r, s in zip(*(sorted(lm_score.score(unseen, net=net, **o).collect()) for o in ({"shares": shares}, {})))}
        assert max(out[1], out[3]) < out[2] < 0 and got[4] < got[3] < got[2] and np.isfinite(list(out.values())).all()


def test_rounds_learn_from_every_place_once(spark):
    net = lm_score.fit(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))
    texts = pa.array(["a b c d e f g", "", "a", "b c"])
    symbols, first = net.encode(texts)
    for rounds in (1, 2, 3):
        shift = np.arange(len(texts)) % rounds
        at = [lm_score.places(symbols, first, shift, k, rounds, net.symbols) for k in range(rounds)]
        assert sorted(np.concatenate(at)) == list(np.flatnonzero(symbols < net.symbols))
    # short texts teach words on the left: the second word of a text moves the table of the place before it
    start = lm_score.fit(spark.createDataFrame([(k, "a b") for k in range(40)], "doc_id long, text string"), rounds=0)
    taught = lm_score.fit(spark.createDataFrame([(k, "a b") for k in range(40)], "doc_id long, text string"))
    a = int(taught.encode(pa.array(["a"]))[0][lm_score.SIDE])
    assert not np.allclose(start.inner[1][a], taught.inner[1][a])


def test_few_long_texts_still_teach_their_language(spark):
    rng = np.random.default_rng(0)
    long = {lang: [" ".join("".join(rng.choice(list(letters), 5)) for _ in range(12_000)) for _ in range(8)] for lang, letters in (("xx", "abcde"), ("yy", "vwxyz"))}
    rows = [(100 * n + k, t, lang) for n, (lang, texts) in enumerate(long.items()) for k, t in enumerate(texts)] + [(999, "42 - 17", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for train_bytes, most in ((1, 4096), (60_000, 120_000)):
        trees = language_id.fit(docs, train_bytes=train_bytes)
        learned = {k: t.levels[-1][3].sum() for k, t in trees.items()}
        assert sorted(trees) == ["xx", "yy"] and all(0 < n <= most for n in learned.values()), learned
    out = language_id.identify(docs, train_bytes=60_000).collect()
    assert all(r.lang_pred == ("xx" if r.doc_id < 100 else "yy") for r in out if r.doc_id < 999)


def test_log_probabilities_without_dividing_all():
    rng = np.random.default_rng(3)
    n = 40
    net = lm_score.Network(np.zeros(0, np.uint64), *(rng.normal(0, s, shape).astype(np.float32) for s, shape in ((1, (4, n + 1, 16)), (30, (16, n)), (1, n))))
    symbols = np.r_[n, n, rng.integers(0, n, 300), n, n]
    room = net.room(128)
    for at in (np.arange(2, 130), np.arange(130, 302 - 40), np.zeros(0, np.int64)):
        _, p = net.predict(symbols, at)
        np.testing.assert_array_equal(net.logs(symbols, at, room[: max(len(at), 1)] if len(at) <= 128 else None), np.log(p[np.arange(len(at)), symbols[at]]))
        hidden, shared = net.exps(symbols, at[:128], room)
        assert np.shares_memory(shared, room) or not len(at)


def test_many_places_need_few_rows():
    """Blocks of places in a room of one block give what all places at once give; logits past the bound too."""
    rng, n = np.random.default_rng(4), 40
    symbols = np.r_[n, n, rng.integers(0, n, 500), n, n]
    at = np.arange(2, 502)
    for high in (0, 60):
        net = lm_score.Network(np.zeros(0, np.uint64), *(rng.normal(0, 0.3, shape).astype(np.float32) for shape in ((4, n + 1, 16), (16, n), (n,))))
        net.bias[:3] += high
        logits = np.minimum(np.tanh(sum(net.inner[j][symbols[at + k]] for j, k in enumerate(lm_score.PLACES))) @ net.outer + net.bias, 60)
        want = logits - np.log(np.exp(logits.astype(float)).sum(axis=1, keepdims=True))
        got = net.logs(symbols, at, net.room(lm_score.ROWS))
        np.testing.assert_array_equal(got, net.logs(symbols, at))
        np.testing.assert_allclose(got, want[np.arange(500), symbols[at]], rtol=1e-4, atol=1e-4)
        np.testing.assert_allclose(net.predict(symbols, at)[1], np.exp(want), rtol=1e-3, atol=1e-6)


def test_learning_step_against_the_plain_formula():
    rng, n = np.random.default_rng(5), 30
    net = lm_score.Network(np.zeros(0, np.uint64), *(rng.normal(0, 0.5, shape).astype(np.float32) for shape in ((4, n + 1, 16), (16, n), (n,))))
    symbols = np.r_[n, n, rng.integers(0, n, 300), n, n]
    at = np.arange(2, 302)
    hidden, p = net.predict(symbols, at)
    p = p - np.eye(n)[symbols[at]]
    back = (p @ net.outer.T) * (1 - hidden**2)
    inner = np.zeros(net.inner.shape)
    for j, k in enumerate(lm_score.PLACES):
        np.add.at(inner[j], symbols[at + k], back)
    want = [x - lm_score.RATE * g / 300 / np.sqrt(1e-2 + (g / 300) ** 2) for x, g in ((net.inner, inner), (net.outer, hidden.T @ p), (net.bias, p.sum(axis=0)))]
    lm_score._Trainer(net).learn(symbols, at)
    for x, y in zip((net.inner, net.outer, net.bias), want, strict=True):
        np.testing.assert_allclose(x, y, atol=1e-4)


def test_symbols_of_words_that_share_their_last_bits():
    frequent = np.sort(np.array([5, 5 + (1 << 16), 9 + (1 << 40)], np.uint64))
    net = lm_score.Network(frequent, np.zeros((4, 68, 16)), np.zeros((16, 67)), np.zeros(67))
    value = np.array([5, 5 + (1 << 16), 5 + (1 << 17), 9, 9 + (1 << 40), (1 << 64) - 1], np.uint64)
    spot = np.arange(len(value))
    symbols, first = net.fenced(lm_score.Words(np.zeros(6, np.uint8), spot, spot + 1, value, np.array([0, 6])))
    assert list(symbols) == [67, 67, 0, 1, 3 + 5, 3 + 9, 2, 3 + 63, 67, 67] and list(first) == [2, 10]


def test_words_between_every_blank(spark):
    docs = spark.createDataFrame([(1, " A\tb\n\nB\v\u00c4a\f\rb\u00a0\u0085 "), (2, None), (3, "")], "doc_id long, text string")
    assert {r.word: r.n for r in lm_score.word_counts(docs).collect()} == {"a": 1, "b": 2, "\u00c4a": 1, "b\u00a0\u0085": 1}
