"""Pieces, pages, surrogates and the pipeline."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from seriesloom.llm import exact_dedup, html_text, pii
from seriesloom.llm import sentencepiece_scan as sp
from seriesloom.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return sp.Vocabulary(sp.default_model())


def test_same_ids_as_the_library(vocabulary):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(sp.default_model(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1  # best segmentation instead of merges, over the same pieces
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for text in ["Hello  world\n x", "été äöü 漢字 \U0001f600 ok", "a" * 40 + " " + "the" * 30, "tab\tx  \n\n y, (z). m².", " lead"]:
        assert sp.encode_text(vocabulary, text).tolist() == library.encode(text)


def test_chunked_scan_equals_direct(spark, docs):
    rng = random.Random(1)
    rows = [(None, None), (1, ""), (2, "lit▁mark ▁▁ x " * 30)]
    for k in range(3, 40):
        letters = rng.choice(["ab the", "abcdefgh ▁", "éa\n b", "thein", "x,. y"])
        rows.append((k, "".join(rng.choice(letters) for _ in range(rng.randint(1, 900)))))
    direct = {r.doc_id: r.ids for r in sp.encode(docs(rows, "__other")).collect()}
    for chunk in (17, 50):
        out = sp.decode(sp.encode(docs(rows, "ids"), chunk=chunk)).collect()
        assert len(out) == len(rows)
        for r in out:
            assert r.decoded == r.text
            assert r.ids == direct[r.doc_id]
    assert sp.encode(docs(rows).limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [500, 2000])
def test_chunks_give_the_ids_of_whole_texts(spark, chunk):
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    direct = {r.doc_id: r.ids for r in sp.encode(texts).collect()}
    assert {r.doc_id: r.ids for r in sp.encode(texts, chunk=chunk).collect()} == direct


def test_many_at_once_equal_one_by_one(vocabulary):
    rng = random.Random(9)
    letters = "abcdefghinorstuy ´ñéß²▁\n.,漢😀" + "etaoin " * 3
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 9, 80, 900]))) for _ in range(200)] + [None, "", "x" * 3000, "ee " * 2000]
    got = list(sp.encode_texts(vocabulary, texts))
    for text, ids in zip(texts, got, strict=True):
        if text is None:
            assert ids is None
        else:
            whole, literal = sp.prepared(text)
            _, back = vocabulary.forward(whole)
            want = vocabulary.trace(whole, back, 0, len(whole), literal) if text else b""
            assert ids.tobytes() == want


def test_max_plus_is_associative():
    rng = np.random.default_rng(2)
    a, b, c = rng.integers(-50, 0, (3, 6, 6)).astype(float)
    assert (sp.max_plus(sp.max_plus(a, b), c) == sp.max_plus(a, sp.max_plus(b, c))).all()


PAGE = (
    "<html><head><title>t</title><style>p{}</style><script>x='<p>'</script></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></li></ul></nav>"
    "<div class='cookie-notice'>We use cookies</div><article><h1>Head &amp; line</h1><p>One\n two <b>three</b></p><div class=\"ad\">Buy</div><p><b>Four<br><p>5</p>"
    "<form><input><button>Send</button></form></article><aside>More</aside><section id=comments><p>Nice</p></section><footer>&copy; x</footer></body></html>"
)


def test_pages(spark):
    assert html_text.main_text(PAGE) == "Head & line\n\nOne two three\n\nFour\n\n5"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>a</nav>") == ""
    free = "<div><a href=1>menu one</a></div><p>" + "long text " * 20 + "</p><p>x</p><p>" + "end text " * 9 + "</p><div class=footer>f</div>"
    assert html_text.main_text(free).split("\n\n") == ["long text " * 19 + "long text", "x", "end text " * 8 + "end text"]
    assert html_text.main_text("<!-- open <p>a") == "" and html_text.main_text("<p>a<script>b") == "a"
    rows = spark.createDataFrame([(1, "u", PAGE, "z"), (1, "u", PAGE, "z"), (None, None, None, "z")], "page_id long, url string, html string, text string")
    out = html_text.extract(rows).collect()
    assert [r.n_chars for r in out] == [len(html_text.main_text(PAGE))] * 2 + [0] and html_text.extract(rows.limit(0)).count() == 0


def test_unmarked_pages_with_an_interruption():
    first, second = "early words " * 20, "late words " * 9
    boxes = {"advert": "<div class=ad><p>Buy</p><p>more</p><p>now</p><p>!</p></div>", "links": "<ul>" + "<li><a href=x>one other page</a></li>" * 4 + "</ul>"}
    for box in boxes.values():
        page = f"<div><a href=1>menu</a></div><div><p>{first}</p>{box}<p>{second}</p></div>"
        assert html_text.main_text(page).split("\n\n") == [first.strip(), second.strip()]
    cited = f"<p>{first}</p><p>See <a href=x>the whole report of the year</a></p><p>{second}</p><p><a href=y>imprint</a></p>"
    assert html_text.main_text(cited).split("\n\n") == [first.strip(), "See the whole report of the year", second.strip()]


def test_attributes_that_hide_nothing():
    body = "<p>some words of the text</p>"
    for box in ('div style="overflow:hidden"', 'div aria-hidden="false"', 'div class="overflow-hidden"', 'div class="content share-enabled"', 'div data-x="hidden"', 'div class="menu"', 'div id=login'):
        for inner in ("main class=\"with-sidebar\"", 'article class="post no-comments"', "article class='comment'"):
            end = inner.split()[0]
            assert html_text.main_text(f"<{box}><{inner}>{body}</{end}></div>") == "some words of the text", (box, inner)
        if "menu" not in box and "login" not in box:
            assert html_text.main_text(f"<{box}>{body}</div>") == "some words of the text", box
    for box in ("hidden", 'aria-hidden="true"', "style='color:red; display: none'", "style=visibility:hidden", "class='x ad'", "id=comments", "class=cookie-notice", "class=related-posts", "role=navigation"):
        assert html_text.main_text(f"<article><p>in</p><div {box}><p>out</p></div></article>") == "in", box
    assert html_text.main_text(f"<main>{body}<section id=comments><article class=comment><p>Nice</p></article></section></main>") == "some words of the text"
    assert html_text.main_text(f"<main><article>{body}</article><section id=comments><article class=comment><p>Nice</p></article></section></main>") == "some words of the text"


def test_what_follows_the_article():
    body = "<article><h1>T</h1><p>some words of the text</p></article>"
    for after in (
        "<article class='comment'><p>Nice, thanks a lot for these words</p></article>",
        "<section class='user-comments'><article><p>Nice, thanks a lot for these words</p></article></section>",
        "<div class=more><article><h2>Another story</h2><p>with a few words to lead on</p></article></div>",
        "<p>Copyright 2020 by somebody</p>",
    ):
        assert html_text.main_text(body + after) == "T\n\nsome words of the text", after
    for notice in ("© 2024 Some House", "&copy; 2024", "(c) 2020 x", "Copyright 2020 by somebody"):
        assert html_text.main_text(f"<div><p>{'long text ' * 9}</p><p>x</p></div><p>{notice}</p>") == "long text " * 8 + "long text\n\nx", notice
    both = "<article><p>the first part of it</p></article><article><p>the second part of it</p></article>"
    assert html_text.main_text(both) == "the first part of it\n\nthe second part of it"


def _kept(weights, surge):
    """Line by line from the definition: after a surge, with no dive since."""
    sums = [sum(weights[i : i + 3]) for i in range(len(weights))]
    inside = [any(sums[s] > surge and all(sums[s : i + 1]) for s in range(i + 1)) for i in range(len(weights))]
    begins = [i for i in range(len(inside)) if inside[i] and not (i and inside[i - 1])]
    inside = [x or any(i < s <= i + 3 and all(weights[i:s]) for s in begins) for i, x in enumerate(inside)]
    return [any(weights[j] and all(inside[j : i + 1]) for j in range(i + 1)) for i in range(len(weights))]


def test_windows_against_the_definition():
    rng = random.Random(3)
    for _ in range(400):
        marked = rng.random() < 0.4
        blocks = [(rng.choice(["text", "text", "links"]), rng.choice([1, 4, 9, 30, 80]), rng.random() < 0.6) for _ in range(rng.randrange(14))]
        texts, page, weights = [], "", []
        for i, (kind, size, inside) in enumerate(blocks):
            text = (chr(97 + i) * 5 + " ") * (size // 5) + chr(97 + i)
            inner = f"<p>{text}</p>" if kind == "text" else f"<p><a href=x>{text}</a></p>"
            page += f"<article>{inner}</article>" if marked and inside else inner
            texts.append(text)
        if marked and any(x[2] for x in blocks):
            weights = [len(t) + html_text.SURGE if x[2] else 0 for t, x in zip(texts, blocks)]
            allowed = [x[2] for x in blocks]
        else:
            weights, allowed = [len(t) if x[0] == "text" else 0 for t, x in zip(texts, blocks)], [True] * len(blocks)
        keep = _kept(weights, html_text.SURGE)
        if not any(keep):
            keep = _kept(weights, 0)
        assert html_text.main_text(page) == "\n\n".join(t for t, k, ok in zip(texts, keep, allowed) if k and ok)


def test_a_very_long_page():
    page = "<nav>" + "<a href=x>menu</a>" * 1000 + "</nav><article>" + "<p>one line of the text</p>" * 50_000 + "</article>"
    assert html_text.main_text(page).count("one line of the text") == 50_000


def test_pages_without_their_marks(spark):
    for r in table(spark, "/root/testdata/sf0.01", "pages").collect():
        assert html_text.main_text(re.sub("(</?)article", r"\1div", r.html)) == html_text.main_text(r.html), r.page_id


def test_pages_of_the_data(spark):
    for p, r in zip(table(spark, SF, "pages").orderBy("page_id").collect(), html_text.extract(table(spark, SF, "pages")).orderBy("page_id").collect()):
        body = re.search("<article>(.*)</article>", p.html, re.S)[1]
        import html

        parts = [" ".join(html.unescape(re.sub("<(?!br)[^>]*>", "", x).replace("<br>", " ")).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(x for x in parts if x)


def test_surrogates_keep_format_and_differ():
    rng = random.Random(0)
    phones = {f"+49 ({rng.randint(100, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}" for _ in range(3000)}
    out = {pii.surrogate("phone", p) for p in phones}
    assert len(out) == len(phones) and all(re.fullmatch(r"\+49 \(\d{3}\) \d{3}-\d{4}", p) for p in out)
    cards = {"4111 1111 1111 1111", "5500-0000-0000-0004"}
    assert all(pii._luhn(re.sub(r"\D", "", pii.surrogate("card", c))[:-1]) == int(pii.surrogate("card", c)[-1]) for c in cards)
    numbers = {f"{i:016d}" for i in range(5000)}
    assert len({pii.surrogate("card", n) for n in numbers}) == len(numbers)
    for name, names in ((n, v) for v in pii.NAMES.values() for n in v):
        assert pii.surrogate("name", name) in names and pii.surrogate("name", name) != name
    assert pii.surrogate("ip", "10.0.0.1") != pii.surrogate("ip", "10.0.0.2")
    assert pii.surrogate("mail", "Ab.c@x.org") == pii.surrogate("mail", "ab.C@X.org") != pii.surrogate("mail", "ab.c@x.org", b"other")


def test_surrogates_in_documents(spark, docs):
    rows = [(1, "Anna Schmidt, a.b@mail.com, +49 (30) 1234-5678"), (2, "again a.b@mail.com\nand 97.51.17.173"), (None, None), (4, ""), (5, "nothing here"), (2, "again a.b@mail.com\nand 97.51.17.173")]
    out = pii.pseudonymise(docs(rows, "n_entities")).collect()
    by = {r.doc_id: r for r in out}
    mail = pii.surrogate("mail", "a.b@mail.com")
    assert mail in by[1].text and mail in by[2].text and "97.51" not in by[2].text and by[1].n_entities == 3
    assert by[None].text is None and by[4].text == "" and by[5].text == "nothing here" and len(out) == 6
    again = pii.pseudonymise(docs(rows, "n_entities"), max_broadcast=-1).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert pii.pseudonymise(docs(rows).limit(0)).count() == 0


def test_collisions_are_drawn_again(spark, docs):
    first = pii.surrogate("ssn", "123-45-6789")
    table_ = pii.drawn(docs([(1, f"123-45-6789 and {first}")])).collect()
    out, real = {r.surrogate for r in table_}, {r.entity for r in table_}
    assert len(out) == len(table_) == 2 and not out & real


def test_whole_list_of_given_names_ends(spark, docs):
    names = [n for v in pii.NAMES.values() for n in v]
    table_ = pii.drawn(docs([(k, f"{n}.") for k, n in enumerate(names)])).collect()
    out, real = {r.surrogate for r in table_}, {r.entity for r in table_}
    assert real == set(names) and len(out) == len(names) and not out & real


def test_national_phones():
    for phone in ("555-123-4567", "030 1234567", "06 12 34 56 78", "212.555.0199", "030/123 4567"):
        text = f"call {phone}, please"
        assert [(text[a:b], k) for a, b, k in pii.entities(text)] == [(phone, "phone")], phone
        fresh = pii.surrogate("phone", phone)
        assert fresh != phone and re.sub(r"\d", "9", fresh) == re.sub(r"\d", "9", phone) and (fresh[0] == "0") >= (phone[0] == "0")
    for other in ("0.123 4567", "1999-2004", "12-03-2024", "room 030", "3.14159 26535"):
        assert not list(pii.entities(other)), other


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, SF)
        assert out.columns == docs.columns, name
        assert not set(r.doc_id for r in out.collect()) - set(r.doc_id for r in seen.collect()), name
        if name == "exact_dedup":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in exact_dedup.exact_duplicates(seen).filter("kept").collect()}
        seen = spark.createDataFrame(out.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, seen, SF).collect()
    texts = {r.doc_id: r.text for r in seen.collect()}
    v = sp.loaded(sp.default_model())
    assert len(last) == len(texts) and all(v.decode(np.array(r.ids, int))[1:] == texts[r.doc_id] for r in last)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(texts)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_pipeline_stages_take_hard_rows(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    rows = [(None, None, None, None, None, "k"), (1, "", None, None, 0, "k"), (1, "", None, None, 0, "k"), (2, "a b c d e f", "en", "s", 11, "k"), (3, "w " * 50_000, "en", "s", 1, "k")]
    frame = spark.createDataFrame(rows, schema)
    assert stage[1](spark, frame, SF).count() <= 5 and stage[1](spark, frame.limit(0), SF).count() == 0
