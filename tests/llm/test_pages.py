"""Main text of pages."""

import numpy as np
import pytest

from quire.llm import html_text
from quire.llm.html_text import main_text

TREE = html_text.default_tree()
CASES = [
    (None, ""), ("", ""), ("plain text without any markup at all, but it is long enough to be kept as a text", None),
    ("<article><p>Tom &amp; Jerry&#8217;s\n\n  tale<br>goes on</p><p>Of.</p></article>", "Tom & Jerry’s tale goes on\nOf."),
    ("<article><h1>T</h1><script>if (a<b) x('</p>')</script><p>One<style>p{}</style> two</p><!-- <p>no</p> --></article>", "T\nOne two"),
    ("<nav><a href='/'>Home</a></nav><article><p>Body text here</p></article><footer>&copy; x</footer>", "Body text here"),
    ("<article><p>Kept words</p><div class='ad-slot ad'>Buy now, it is cheap and good</div><p>more</p></article>", "Kept words\nmore"),
    ("<article><p>Kept</p></article><section id=comments><p>" + "opinion " * 60 + "</p></section>", "Kept"),
    ("<main><form><p>name</p><input></form><p>Text <b>bold</b> <a href=x>link</a></p></main>", "Text bold link"),
    ("<article><p>cut off in the mid", "cut off in the mid"), ("<article><p>cut off in a tag</p><a hre", "cut off in a tag"),
    ("<article><P CLASS='lead'>upper</P><div hidden>no</div></ARTICLE>", "upper"),
    ("<article><p>one</p><p class='x>two</p></article>", "one\ntwo"), ("<article><p>it's 3 < 4 and \"so\"</p></article>", "it's 3 < 4 and \"so\""),
    ("<article><p>a</p></article><div>" + "<div>" * 3000 + "deep", "a"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_pages(page, want):
    got = main_text(page, TREE)
    assert got == want if want is not None else got == page


BODY = "<h1>A title of the text</h1><p>" + "word " * 40 + "</p><p>" + "more " * 25 + "</p>"
WRAPPERS = ["<form action='/x'>%s</form>", "<div class='site has-sidebar'>%s</div>", "<div class=content-widget>%s</div>", "<div id=header-fixed><form>%s</form></div>"]


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("inner", ["<article>%s</article>", "<main>%s</main>", "<div>%s</div>"])
def test_wrappers_of_the_whole_page(wrapper, inner):
    page = "<body>" + wrapper % ("<nav><a>Home</a></nav>" + inner % BODY + "<div class=sidebar><p>" + "aside " * 20 + "</p></div>") + "</body>"
    assert main_text(page, TREE) == "\n".join(["A title of the text", " ".join(["word"] * 40), " ".join(["more"] * 25)])


def test_boilerplate_stays_boilerplate():
    comments = "<section class=comments><p>" + "opinion " * 200 + "</p></section>"
    for page in ("<body><article>" + BODY + "</article>" + comments, "<body><div>" + BODY + "</div>" + comments):
        assert "opinion" not in main_text(page, TREE) and "word word" in main_text(page, TREE)


def test_tree_learns_its_table_and_holds_out():
    x, y = html_text.labelled_table()
    assert np.mean([html_text.keeps(TREE, r) for r in x] == y) > 0.97
    rng = np.random.default_rng(5)
    right = []
    for _ in range(10):
        test = rng.random(len(y)) < 0.2
        tree = html_text.train_tree(x[~test], y[~test])
        right += [html_text.keeps(tree, r) == g for r, g in zip(x[test], y[test], strict=True)]
    assert np.mean(right) > 0.9


def test_query(spark):
    pages = spark.createDataFrame([(k, "u", p, "mine", 1) for k, (p, _) in enumerate(CASES)], "page_id long, url string, html string, text string, n_chars int")
    rows = {r.page_id: r for r in html_text.extract_text(pages).collect()}
    for k, (p, want) in enumerate(CASES):
        assert rows[k].text == (p if want is None else want) and rows[k].n_chars == len(rows[k].text)
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_given_pages(spark):
    """The article of the driver's pages, found by a pattern that fits only them."""
    import html as h
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html_text.extract_text(pages).collect():
        m = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)
        parts = [" ".join(h.unescape(re.sub(r"<[^>]*(>|$)", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", m[1])] if m else []
        assert r.text == "\n".join(p for p in parts if p)


W50, W10 = " ".join(["word"] * 50), " ".join(["ten"] * 10)
LINKED = [
    ("<body><nav><a>Home page of our site</a></nav><article><p>%s</p></article>" % W50, W50),
    ("<body><article><p>%s</p></article><footer><a>All about our company and terms</a><p>%s</p></footer>" % (W10, W50), W10),
    ("<body><article><h1><a>The long title of this article</a></h1><p>%s</p></article>" % W10, "The long title of this article\n" + W10),
    ("<body><article><p>%s</p><ul><li><a>First source of all</a></li><li><a>Second source</a></li></ul><p>End of the text.</p></article>" % W50,
     W50 + "\nFirst source of all\nSecond source\nEnd of the text."),
    ("<body><div class=breadcrumb><a>Home</a> <a>News</a></div><div><p>%s</p></div>" % W50, W50),
    ("<body><div><a>Home</a> <a>News</a></div><div><p>%s</p></div>" % W50, W50),
]


@pytest.mark.parametrize("page,want", LINKED)
def test_linked_blocks(page, want):
    assert main_text(page, TREE) == want


# Hand-written pages that the tree has not seen: what is kept is marked by "keep".
HELD_OUT = [
    "<body><header><a>Site</a></header><nav><ul><li><a>one</a><li><a>two</a></ul></nav><main><h1>keep title</h1><p>keep %s</p><p><a>keep source</a></p></main><footer>c 2020</footer>",
    "<body><div id=menu><a>a</a> <a>b</a></div><h1>keep heading</h1><p>keep %s</p><p>keep %s</p><div id=footer>contact us</div>",
    "<body><article><h2>keep a</h2><p>keep %s <a>keep link</a></p><div class=advert>buy</div><p>keep short</p></article><aside><p>%s</p></aside>",
    "<body><main><blockquote>keep %s</blockquote><table><tr><td>keep cell<td>keep 2</table></main><section id=comments><p>%s</p></section>",
]


@pytest.mark.parametrize("page", HELD_OUT)
def test_held_out_pages(page):
    got = main_text(page.replace("%s", " ".join(["plain"] * 30)), TREE).split("\n")
    assert len(got) == len([b for b in page.split(">") if b.startswith("keep") and "link" not in b]) and all(b.startswith("keep") for b in got)


@pytest.mark.parametrize("page", ["<div>" * 40_000 + "</section>" * 40_000, "<button>" * 60_000, "<select><svg><object>" * 30_000, "</b>" * 200_000])
def test_broken_markup_takes_linear_time(page):
    import time

    t0 = time.process_time()
    main_text(page, TREE)
    assert time.process_time() - t0 < 20
