"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one per block element.  A line weighs as much as
its text; a line that is mostly links or a copyright notice weighs nothing.  Lines of
menus, headers, footers, sidebars, notices, adverts, forms and reader comments leave
before the windows are formed and are never kept.  Weights are summed over a sliding
window of three lines.  Where the sum rises above the threshold lies a surge, where it
falls to nothing for a whole window a dive; the text of every stretch between is kept,
with the short lines directly before it, a window of them at most.

Where a page marks its article, the mark is a weight too: a line inside weighs a surge
more, so that short headings count, one outside weighs nothing and is never kept.

Attributes are parsed: an element is hidden by its ``hidden`` attribute, by
``aria-hidden=true`` or by its style, and outside by a class, id or role that is an
outside word or a compound of outside and neutral words.  Class, id and role never
exclude a main element or the page's first article, nor do those of the elements around
them; later articles, and articles inside main, are tested like other elements.

Null and empty pages, and pages without text, give an empty text.  Broken markup
is read as it stands: an end tag closes the nearest open element of its name,
unclosed comments, scripts and styles run to the end of the page.  Pages of any length
are read whole, in time linear in their length; repeated rows each give their row.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import small_batches

WINDOW = 3
SURGE = 25

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|svg|iframe|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_NOTICE = re.compile(r"(?:©|\(c\)\s|copyright\b)", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")
# Elements that stand for a block, that hold others, and that never hold the article's text.
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_OPEN = frozenset("article main div section aside nav header footer form ul ol li dl table tr td figure menu dialog details fieldset blockquote a span button p".split())
_OUT = frozenset("nav header footer aside form menu dialog button head".split())
_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal "
    "newsletter subscribe signup sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments reply replies discussion disqus "
    "related recommended more teaser teasers share sharing social widget toolbar pagination pager login search contentinfo complementary".split()
)


# Words that a compound with an outside word may hold beside it.
_NEUTRAL = frozenset(
    "site page main global top bottom left right center primary secondary inner outer box bar block area section container wrapper wrap list item items link links "
    "icon icons button buttons form field slot unit panel text content title heading row column col group post posts article articles story stories entry entries "
    "image js id google user users reader readers visitor visitors the and of for our".split()
)
_BY_NAME, _BY_ELEMENT = 1, 2


def _outside_word(word: str) -> bool:
    if word in _OUT_WORDS:
        return True
    parts = [x for x in _PARTS.split(word) if x and not x.isdigit()]
    return not _OUT_WORDS.isdisjoint(parts) and all(x in _OUT_WORDS or x in _NEUTRAL for x in parts)


def _outside(name: str, rest: str, exempt: bool) -> int:
    """What puts an element outside: 0 nothing, _BY_NAME its class, id or role (unless ``exempt``), _BY_ELEMENT what it is or that it is hidden."""
    if name in _OUT:
        return _BY_ELEMENT
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    if "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or _HIDDEN.search(found.get("style", "")):
        return _BY_ELEMENT
    if not exempt and any(_outside_word(w) for k in ("class", "id", "role") for w in found.get(k, "").lower().split()):
        return _BY_NAME
    return 0


def lines(page: str) -> list[tuple[str, bool, bool, int]]:
    """Blocks in page order: text, whether it is outside the article by its element, inside a marked article, characters in links."""
    out: list[tuple[str, bool, bool, int]] = []
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    out_depth = main_depth = link_depth = links = 0
    state = (False, False)
    marked = False

    def flush() -> None:
        nonlocal parts, links
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, *state, links))
        parts, links = [], 0

    def leave(name: str, away: int) -> None:
        nonlocal out_depth, main_depth, link_depth
        out_depth -= away > 0
        main_depth -= name in ("article", "main")
        link_depth -= name == "a"

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            links += len(piece.strip()) * (link_depth > 0)
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in _BLOCKS:
            flush()
        if name not in _OPEN and name not in _OUT:
            continue
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if out_depth and any(x[1] for x in stack[k:]):
                        flush()
                    for x in stack[k:]:
                        leave(*x)
                    del stack[k:]
                    break
        elif not m[0].endswith("/>"):
            if name == "p" and stack and stack[-1][0] == "p":
                leave(*stack.pop())
            exempt = name == "main" or name == "article" and not marked
            away = _outside(name, m[4] or "", exempt)
            if away:
                flush()
            elif exempt and not any(x[1] == _BY_ELEMENT for x in stack):
                marked = True
                out_depth = 0
                stack = [(x[0], 0) for x in stack]
            stack.append((name, away))
            out_depth += away > 0
            main_depth += name in ("article", "main")
            link_depth += name == "a"
        state = (out_depth > 0, main_depth > 0)
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def between(weights: list[int], threshold: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Stretches from a surge of the windowed sums, or the weighty lines up to a window before it, to the next dive."""
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    found, start = [], None
    for i, s in enumerate(sums):
        if start is None and s > threshold:
            start = i
            while start and i - start < window and weights[start - 1]:
                start -= 1
        elif start is not None and s == 0:
            found.append((start, i))
            start = None
    if start is not None:
        found.append((start, len(weights)))
    return found


def main_text(page: str | None, surge: int = SURGE, window: int = WINDOW) -> str:
    """The article of one page, its blocks joined by an empty line."""
    rows = [row for row in lines(page or "") if not row[1]]
    marked = any(inside for _, _, inside, _ in rows)

    def weight(text: str, inside: bool, links: int) -> int:
        if marked:
            return len(text) + surge if inside else 0
        return 0 if 2 * links > len(text) or _NOTICE.match(text) else len(text)

    weights = [weight(text, inside, links) for text, _, inside, links in rows]
    kept = []
    for a, b in between(weights, surge, window) or between(weights, 0, window):
        first = next(i for i in range(a, b) if weights[i])
        kept += [text for text, _, inside, _ in rows[first:b] if inside or not marked]
    return "\n\n".join(kept)


def extract(pages: DataFrame, *, page_id="page_id", url="url", html_col="html", surge: int = SURGE, window: int = WINDOW) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    small_batches(pages.sparkSession)

    @F.arrow_udf("string")
    def read(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in column:
            yield pa.array([main_text(x, surge, window) for x in part.to_pylist()], pa.string())

    texts = pages.select(pages[page_id].alias("page_id"), pages[url].alias("url"), read.asNondeterministic()(F.coalesce(pages[html_col], F.lit(""))).alias("text"))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
