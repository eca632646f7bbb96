"""Main text of web pages by two passes over their blocks.

The first pass decides blocks by stop-word density, length and link density, and by the element they stand in.  Short or
otherwise ambiguous blocks are left open; the second pass gives them the label of the nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from martlight.llm.base import columns_of, map_slices, table

# The commonest function words of four languages.
STOP_WORDS = frozenset(
    # English
    "a an and are as at be been but by for from had has have he her his i in is it its more not of on one or she so"
    " that the their there they this to was we were what when which who will with would you"
    # German
    " aber als auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für haben hat ich"
    " im in ist mit nach nicht noch nur oder sich sie sind so über um und von vor war wie wird zu zum zur"
    # French
    " au aux avec ce cette ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus"
    " pour qu que qui sa sans se ses son sont sur un une vous"
    # Spanish
    " al como con de del el ella en entre era es esta este fue ha hay la las lo los más me no para pero por que se"
    " sin sobre su sus también un una y ya".split()
)
#: Elements that hold no text of an article.
OUTSIDE = frozenset(
    "head nav header footer aside form button select option textarea fieldset label menu dialog noscript template"
    " iframe object svg canvas audio video map".split()
)
#: Names in class, id or role of an element that is no part of an article.
OUTSIDE_NAMES = frozenset(
    "ad ads adbox adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies"
    " consent gdpr notice notices alert popup modal overlay dialog sidebar aside menu nav navbar navigation breadcrumb"
    " breadcrumbs header footer masthead topbar toolbar comment comments disqus respond reply replies share sharing"
    " social related recommended newsletter subscribe subscription signup login widget pagination pager copyright"
    " legal disclaimer contentinfo complementary search commentlist commentform sharebar adsense adsbygoogle"
    " relatedposts cookiebar topnav subnav".split()
)
#: Of these, the names of what readers wrote.
READERS = frozenset("comment comments reply replies disqus".split())
#: Parts before a name that make it the property of a wrapper.
NEGATIONS = frozenset("has have no not with without hide show".split())
#: Last parts that leave the name before them what it is: ``comments-area``, ``ad-slot``.
PLACES = frozenset(
    "area box slot unit buttons links list body inner outer left right top bottom container wrapper wrap message posts"
    " form bar item items block section panel holder region row col column group thread module".split()
)
#: Last parts that say so after a name of ``READERS`` only.
REMARKS = frozenset("content text title author meta count date".split())
#: Parts before a name that make ``content-sidebar-wrap`` a wrapper of both.
WHOLES = frozenset("content main".split())
BLOCKS = frozenset(
    "html body p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption section article main"
    " header footer nav aside form blockquote pre hr address figure figcaption details summary fieldset center title".split()
)
#: Elements that must be closed for what follows to be outside of them.
CONTAINERS = OUTSIDE | frozenset("html body div section article main ul ol dl table blockquote figure details span p li".split())
VOID = frozenset("br hr img input meta link source wbr area base col embed track param".split())
ARTICLES = ("article", "main")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Characters under which a block is short, the link density that no article text has, and stop-word densities.
SHORT, LINKED, LOW, HIGH = 70, 0.5, 0.15, 0.3
#: Stop-word density of a page's longer blocks under which its language is taken for one whose words are not known.
UNKNOWN = 0.05

PART = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|xmp|noembed|noframes)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
UNSHOWN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
NUMBER = re.compile(r"\d+(?:x\d+)?")
FORM = re.compile(r"<(/?)form\b", re.IGNORECASE)
#: Elements that make the form around them one of the whole page.
PAGE_PARTS = re.compile(r"<(?:main|article|nav|footer|h1)\b", re.IGNORECASE)
#: Scripts whose characters say as much as several letters.
DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
WORD = re.compile(r"\w+")
SPACE = re.compile(r"\s+")


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    heading: bool = False
    article: int = 0  # number of the article it stands in, 0: none
    outside: bool = False
    doubtful: int = 0  # number of an article inside an element that only its name puts outside
    text: str = ""
    good: bool | None = None


def _attributes(text: str) -> dict[str, str]:
    """Values by name; of a repeated name the first counts."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), "".join(values))
    return found


def _names_outside(attributes: str) -> int:
    """2: hidden, 1: by a name, 0: not outside."""
    if not attributes or attributes.isspace():
        return 0
    own = _attributes(attributes)
    if "hidden" in own or own.get("aria-hidden", "").strip().lower() == "true" or UNSHOWN.search(own.get("style", "")):
        return 2
    names = " ".join(own.get(key, "") for key in ("class", "id", "role"))
    return int(any(_names_itself(name) for name in names.lower().split()))


def _names_itself(name: str) -> bool:
    """Whether a class, id or role says what the element is, by its last part but numbers and places: ``site-header``,
    ``cookie_notice``, ``comment-42``, ``sidebar-inner``; ``has-sidebar`` and ``post-with-comments`` say what stands in
    or beside it, ``search-results`` what was found, ``content-sidebar-wrap`` what it wraps."""
    parts = re.findall(r"[a-z0-9]+", name)
    n = len(parts)
    while len(parts) > 1 and (parts[-1] in PLACES or NUMBER.fullmatch(parts[-1]) or (parts[-1] in REMARKS and parts[-2] in READERS)):
        parts.pop()
    if not parts or parts[-1] not in OUTSIDE_NAMES or not NEGATIONS.isdisjoint(parts[:-1]):
        return False
    return len(parts) == n or WHOLES.isdisjoint(parts[:-1])


def _page_forms(page: str) -> set[int]:
    """Where forms begin that hold the page rather than fields; one that is never closed reaches to the end."""
    marks = [(m.start(), bool(m[1])) for m in FORM.finditer(page)]
    wide = set()
    for i, (start, closing) in enumerate(marks):
        if not closing:
            end = marks[i + 1][0] if i + 1 < len(marks) else len(page)
            if PAGE_PARTS.search(page, start, end) or (i + 1 < len(marks) and not marks[i + 1][1]):
                wide.add(start)
    return wide


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order; comments, scripts and styles are gone, character references are decoded."""
    found: list[Block] = []
    # Element, stands outside an article (1: by a name, 2: by an element), number of the article, of a doubtful one.
    stack: list[tuple[str, int, int, int]] = []
    articles, links, link_depth = 0, 0, 0
    current = Block()
    page_forms = _page_forms(page)

    def cut(depth: int) -> None:
        nonlocal links
        del stack[depth:]
        links = links if len(stack) >= link_depth else 0  # a link left open ends with the element it began in

    def close() -> None:
        nonlocal current
        if current.parts:
            current.text = SPACE.sub(" ", html.unescape("".join(current.parts))).strip()
            if current.text:
                found.append(current)
        outside, article, doubtful = stack[-1][1:] if stack else (0, 0, 0)
        current = Block(outside=bool(outside), article=article, doubtful=doubtful)

    def add(text: str) -> None:
        if text:
            current.parts.append(text)
            if links:
                current.linked += len(text.strip())

    at = 0
    for match in PART.finditer(page):
        add(page[at : match.start()])
        at = match.end()
        name = (match[3] or match[6] or "").lower()
        if not name:
            continue
        closing, attributes = bool(match[2] or match[5]), match[4] or match[7] or ""
        if name == "a":
            links, link_depth = int(not closing and "href" in _attributes(attributes)), len(stack)
            continue
        if name == "br":
            add("\n")
            continue
        if name in BLOCKS or name in OUTSIDE:
            close()
            links = 0 if name in ("article", "main", "footer") or (closing and name not in CONTAINERS) else links
        if name in CONTAINERS and name not in VOID:
            if closing:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == name:
                        cut(depth)
                        break
                    if stack[depth][0] in ARTICLES and name not in ("html", "body", *ARTICLES):
                        break  # a stray end of something opened outside the article
            elif not attributes.rstrip().endswith("/"):
                if name == "p" or name == "li":
                    # An end tag may be missing: a new one ends the last, with what was left open inside it.
                    for depth in range(len(stack) - 1, -1, -1):
                        if stack[depth][0] == name:
                            cut(depth)
                            break
                        if stack[depth][0] not in ("span", "p"):
                            break
                if name in ARTICLES:
                    while stack and stack[-1][1] and stack[-1][0] in ("nav", "header", "head", "ul", "li", "p", "span"):
                        stack.pop()  # never closed: an article does not begin inside a menu
                elif name in ("body", "footer") and stack:
                    stack[:] = [s for s in stack if s[0] not in ("head", "nav", "p", "span")]
                outside, article, doubtful = stack[-1][1:] if stack else (0, 0, 0)
                if name in ARTICLES:
                    if not article and not doubtful and outside < 2:
                        articles += 1
                        if not outside or name == "main":
                            outside, article = 0, articles
                        else:
                            doubtful = articles
                elif name not in ("html", "body") and match.start() not in page_forms and (
                    own := 2 if name in OUTSIDE else _names_outside(attributes)
                ):
                    outside, doubtful = max(outside, own), 0
                stack.append((name, outside, article, doubtful))
            if name in BLOCKS or name in OUTSIDE or (stack and (bool(stack[-1][1]), stack[-1][3]) != (current.outside, current.doubtful)):
                close()
        if name in HEADINGS and not closing:
            current.heading = True
        if name == "title":
            current.outside = True
    add(page[at:])
    close()
    return found


def _size(text: str) -> int:
    """Characters, those of dense scripts counted as three."""
    return len(text) if text.isascii() else len(text) + 2 * len(DENSE.findall(text))


def decide(blocks: list[Block]) -> None:
    """First pass: sets ``good`` where stop words, length, links or the element decide.

    On a page whose longer blocks hold next to none of the stop words, its language is not among those known here; its
    long blocks are then decided by length and links alone.
    """
    has_article = any(b.article for b in blocks)
    found = []
    for b in blocks:
        words = WORD.findall(b.text.lower())
        found.append((sum(w in STOP_WORDS for w in words), len(words)))
    long = [n for b, n in zip(blocks, found, strict=True) if not b.outside and _size(b.text) >= SHORT]
    known = sum(stops for stops, _ in long) >= UNKNOWN * sum(n for _, n in long)
    for b, (stops, n_words) in zip(blocks, found, strict=True):
        stops = stops / n_words if n_words else 0.0
        density = b.linked / len(b.text)
        if b.outside or (has_article and not b.article):
            b.good = False
        elif density > LINKED:
            b.good = False
        elif _size(b.text) < SHORT:
            b.good = False if b.linked and not has_article else None
        elif not known and not has_article:
            b.good = not b.heading or None
        elif stops >= HIGH:
            b.good = not b.heading or None
        elif stops < LOW and not has_article:
            b.good = False


def inherit(blocks: list[Block]) -> None:
    """Second pass: open blocks take the label of the nearest decided neighbours.

    The ends of an article count as article text, and what stands outside by its element is passed over there.  Where
    both neighbours are as near and differ, the block stays; a page without any decided text keeps its open blocks.
    """
    has_article = any(b.article for b in blocks)
    decided_good = any(b.good for b in blocks)
    before: list[tuple[int, bool] | None] = []
    last: tuple[int, bool] | None = None
    rows = [b for b in blocks if not (has_article and b.good is False and (b.outside or not b.article))]
    for i, b in enumerate(rows):
        if i == 0 or rows[i - 1].article != b.article:
            last = (i - 1, True) if b.article else None
        before.append(last)
        if b.good is not None:
            last = (i, b.good)
    after: list[tuple[int, bool] | None] = [None] * len(rows)
    last = None
    for i in range(len(rows) - 1, -1, -1):
        if i + 1 == len(rows) or rows[i + 1].article != rows[i].article:
            last = (i + 1, True) if rows[i].article else None
        after[i] = last
        if rows[i].good is not None:
            last = (i, rows[i].good)
    for i, b in enumerate(rows):
        if b.good is None:
            near = [(abs(i - at), not good) for at, good in filter(None, (before[i], after[i]))]
            b.good = not min(near)[1] if near and (decided_good or has_article) else not near or not decided_good


def main_text(page: str | None) -> str:
    """Blocks of the article, joined by an empty line; the empty text if there are none.

    An article inside an element that only its name puts outside counts where nothing else on the page does.
    """
    blocks = blocks_of(page or "")
    decide(blocks)
    if any(b.doubtful for b in blocks) and not any(b.good or b.article for b in blocks):
        for b in blocks:
            b.outside, b.article, b.good = b.outside and not b.doubtful, b.doubtful, None
        decide(blocks)
    inherit(blocks)
    return "\n\n".join(b.text for b in blocks if b.good)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``: one row per row of ``pages``; null and empty pages give the empty text."""

    def handle(columns):
        texts = [main_text(page) for page in columns[2]]
        return [columns[0], columns[1], texts, list(map(len, texts))]

    own = columns_of(pages, {"page_id": id_col, "url": url_col, "html": html_col})
    return map_slices(own, handle, "page_id long, url string, text string, n_chars long")


def op10_block_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op10_block_extraction": op10_block_extraction}
SQL: dict[str, str] = {}
