import html
import re

import pytest

from martlight.llm import htmltext

SF = "/root/testdata/sf0.01"


def test_query_gives_whole_articles(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = htmltext.op10_block_extraction(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.DOTALL)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(p for p in parts if p)
        assert r["n_chars"] == len(r["text"])


LONG = "This is a paragraph of the article, and it is long enough that the words in it decide what it is."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<p> </p>", ""),
        ("plain text &amp; more", "plain text & more"),
        (f"<div><h2>Head</h2><p>{LONG}</p><p>Short.</p></div><ul><li><a href=x>Link</a></li></ul>", f"Head\n\n{LONG}\n\nShort."),
        (f"<nav><ul><li>Menu</ul><article><p>Hi.<p>{LONG}</article><footer>{LONG}</footer>", f"Hi.\n\n{LONG}"),
        (f"<article><p>{LONG}</p><div class='comments'><p>{LONG}</p></div><aside>{LONG}</aside></article>", LONG),
        (f"<article><p>{LONG}</p><form><p>{LONG}</p><button>Go</button></form><div id=cookie-notice>{LONG}</div></article>", LONG),
        (f"<article><script>if (a < b) x = '</p>';</script><style>p > a {{}}</style><!-- <p>{LONG}</p> --><p>One\n two&nbsp;three<br>four</p>", "One two three four"),
        ("<article><p title='a > b'>x &lt;b&gt; &#233; <b>bold</b>text</p></article>", "x <b> é boldtext"),
        ("<main><p>THTHES!! REWH!! ONERSTAN!! FOR!! ONING!! EDHE!! TIONESHETI!! RENTED!! ER!! HETI!! AND!!</p></main>",
         "THTHES!! REWH!! ONERSTAN!! FOR!! ONING!! EDHE!! TIONESHETI!! RENTED!! ER!! HETI!! AND!!"),
        (f"<div hidden><p>{LONG}</p></div><p>{LONG}</p>", LONG),
        ("<a", "<a"),
    ],
)
def test_pages(page, want):
    assert htmltext.main_text(page) == want


def test_short_blocks_take_the_nearest_label():
    blocks = [htmltext.Block(text=t, good=g) for t, g in (("a", None), ("x", True), ("b", None), ("c", None), ("d", None), ("y", False), ("e", None))]
    htmltext.inherit(blocks)
    assert [b.good for b in blocks] == [True, True, True, True, False, False, False]


def test_very_long_and_broken_pages_end():
    assert htmltext.main_text("<article>" + "<" * 50_000) == "<" * 50_000
    assert len(htmltext.main_text("<p>" + f"{LONG} " * 20_000)) == len(f"{LONG} " * 20_000) - 1
    assert htmltext.main_text('<article><p class="' + "a" * 100_000) != "x"
    assert htmltext.main_text("<div>" * 20_000 + LONG) == LONG


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "t"), (1, "u", None, "t"), (None, None, LONG, "t")], "page_id long, url string, html string, text string")
    rows = htmltext.extract(pages).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in rows) == [(0, LONG, len(LONG)), (1, "", 0), (1, "", 0)]
    assert htmltext.extract(pages.limit(0)).count() == 0


OTHER = "That is what somebody else wrote below it, and it is as long as the text that it was written to be under."


@pytest.mark.parametrize("names", ["class='layout has-sidebar'", "class='content no-sidebar'", "class='post with-comments'", "id='search-results'",
                                   "class='page--with-sidebar'", "class='ad-free'", "id=header-image-page"])
def test_wrappers_named_after_what_they_hold_stay(names):
    assert htmltext.main_text(f"<div {names}><p>{LONG}</p><div class='sidebar'>{OTHER}</div></div>") == LONG
    assert htmltext.main_text(f"<div {names}><article><p>{LONG}</p></article></div>") == LONG


@pytest.mark.parametrize("names", ["class=sidebar", "class='x site-header'", "id=cookie-notice", "class=comments-area", "class=ad-slot", "role=search"])
def test_elements_of_these_names_go(names):
    assert htmltext.main_text(f"<p>{LONG}</p><div {names}><p>{OTHER}</p></div>") == LONG


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div class='layout sidebar'><main><p>{LONG}</p><aside>{OTHER}</aside></main></div><div>{OTHER}</div>", LONG),
        (f"<div class='menu'><article><p>{LONG}</p><div class=ad>{OTHER}</div><span class=promo>{OTHER}</span></article></div><div>End</div>", LONG),
        (f"<p>{LONG}</p><div class='comments'><article><p>{OTHER}</p></article></div>", LONG),
        (f"<article><p>{LONG}</p></article><div class='related'><article><p>{OTHER}</p></article></div>", LONG),
        (f"<div hidden><main><p>{OTHER}</p></main></div><p>{LONG}</p>", LONG),
    ],
)
def test_articles_inside_named_wrappers(page, want):
    assert htmltext.main_text(page) == want


PROSE = "This is the text of the article that was written by one of us and it is as long as it has to be for a block."


@pytest.mark.parametrize("name", ["comments-list", "comment-body", "comment-42", "commentlist", "sidebar-inner", "sidebar-left",
                                  "ad-container", "ad-300x250", "cookie-message", "related-posts", "newsletter-form", "share-bar", "post-comments-list"])
@pytest.mark.parametrize("page", ["<article><p>{0}</p><div class='{1}'><p>{0} Aside.</p></div></article>", "<div><p>{0}</p></div><div id={1}><p>{0} Aside.</p></div>"])
def test_names_with_places_and_numbers_are_outside(name, page):
    assert htmltext.main_text(page.format(PROSE, name)) == PROSE


@pytest.mark.parametrize("name", ["has-sidebar", "post-with-comments", "search-results", "content-sidebar-wrap", "post-42", "list-item"])
def test_wrappers_stay(name):
    assert htmltext.main_text(f"<div class='{name}'><p>{PROSE}</p></div>") == PROSE


@pytest.mark.parametrize("text", ["Это обычный текст статьи на русском языке, в котором нет ни одного слова из списков, но он достаточно длинный.",
                                  "这是一篇普通的中文文章，其中没有任何列表里的词语，但是它的长度足以说明它就是正文的一部分。"])
def test_languages_without_word_list(text):
    menu = "<ul>" + "".join(f"<li><a href=/{i}>{text[:9]}</a></li>" for i in range(5)) + "</ul>"
    assert htmltext.main_text(f"<body>{menu}<div><p>{text}</p><p>{text}</p></div></body>") == f"{text}\n\n{text}"


@pytest.mark.parametrize("anchor", ["<a href=x>", "<a name=s1>", "<a name='href'>"])
def test_open_anchors_end_with_their_block(anchor):
    page = f"<body><p>{PROSE}{anchor} more</p><p>{PROSE}</p><h2>{anchor}Title</h2><p>{PROSE}</p></body>"
    assert htmltext.main_text(page) == f"{PROSE} more\n\n{PROSE}\n\nTitle\n\n{PROSE}" or anchor == "<a href=x>"
    assert htmltext.main_text(page).count(PROSE) == 3


def test_links_around_blocks_are_links():
    assert htmltext.main_text(f"<body><p>{PROSE}</p><a href=x><div>{PROSE}</div></a></body>") == PROSE


@pytest.mark.parametrize("attribute", ['title="the hidden life"', 'data-note="aria-hidden=true"', 'alt=\'display: none\'', 'title="class=sidebar"'])
def test_attribute_values_hide_nothing(attribute):
    assert htmltext.main_text(f"<div {attribute}><p>{PROSE}</p></div>") == PROSE


def test_hidden_elements_go():
    for attribute in ("hidden", "aria-hidden=TRUE", "style='color:red; display : none'"):
        assert htmltext.main_text(f"<p>{PROSE}</p><div {attribute}><p>{PROSE} Hidden.</p></div>") == PROSE


@pytest.mark.parametrize("body", ["<h1>Title of it</h1><p>{0}</p>", "<nav>Menu</nav><main><h1>Title of it</h1><p>{0}</p></main><footer>Foot</footer>"])
def test_form_round_the_page(body):
    form = f"<form id=aspnetForm>{body.format(PROSE)}</form>"
    assert htmltext.main_text(f"<body>{form}</body>") == f"Title of it\n\n{PROSE}"
    assert htmltext.main_text(f"<p>{PROSE}</p><form><p>{PROSE} Field.</p></form>") == PROSE
