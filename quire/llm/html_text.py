"""Main text of web pages: flat text blocks, shallow features of a block and its neighbours, a decision tree.

A page is read once, left to right, into flat blocks: text between block-level tags, with
character references decoded and white space turned into single spaces. A block's
features are its words and link density, those of the blocks before and after it, and
what the open elements say: inside or outside of the page's article, under an element
whose name, role, class or id speaks of boilerplate, a heading or not. A small decision
tree, trained here on the labelled pages below, keeps or drops each block; the kept ones
are joined by line feeds in page order.

Markup may be broken or cut off anywhere: closing tags close what is open above them or
nothing, an unclosed tag at the end is dropped. Rows: one result per page; null and empty
pages have an empty text; whole pages are read; equal pages give equal rows; other
columns are kept, ``text`` and ``n_chars`` are replaced.
"""

from __future__ import annotations

import functools
import html
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.llm.batches import add_columns, prepared

# Element names and the words in classes, ids and roles that speak of boilerplate.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header html main menu nav ol section span table td th tr ul li p a".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("button canvas iframe noembed noframes noscript object script select style svg template textarea title xmp".split())
#: Of these, the ones that reach to the end of the page if nothing closes them.
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE_NAMES = frozenset("aside dialog footer form header menu nav".split())
OUTSIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising advertorial aside banner breadcrumb breadcrumbs byline captcha comment comments "
    "commentlist consent cookie cookies copyright dialog discussion disqus dropdown feedback foot footer footnav form gdpr head header hidden "
    "legal login masthead menu menubar message modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo "
    "promoted promotion rail recommended recommendations register related replies reply respond responses search share sharing shoutbox sidebar sidenav "
    "signin signup skip social sponsor sponsored subscribe subscription tags teaser toc toolbar topbar tracking warning widget widgets".split()
)
ARTICLE_NAMES = frozenset(["article", "main"])
ARTICLE_WORDS = frozenset("article entry story".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']|[\"'])*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
SEPARATOR = re.compile(r"[^a-z0-9]+")

# Labelled pages: +n is a block of n words of main text, -n one of boilerplate.
LABELLED = (
    "<body><nav><ul><li><a>-1</a><li><a>-2</a><li><a>-1</a></ul></nav><article><h1>+8</h1><p>+60<p>+3<p>+1<p>+45 <a>+4</a><p>+120</article><footer>-9</footer>",
    "<body><header><h1>-3</h1><a>-2</a></header><main><h1>+5</h1><p>+30</p><p>+2</p><ul><li>+4<li>+6</ul><p>+70</main><aside><p>-25</p><p>-14</p></aside><footer>-12 <a>-3</a></footer>",
    "<body><div class=menu><a>-1</a> <a>-1</a> <a>-2</a></div><div><h1>+6</h1><p>+48</p><p>+90</p><p>+33</p></div><div class=sidebar><h3>-3</h3><p>-21</p></div><div class=footer>-14</div>",
    "<body><div id=cookie-notice><p>-24</p></div><div><h1>+9</h1><p>+52<p>+27<p>+18<p>+64</div><div class=comments><h3>-2</h3><p>-30<p>-44<p>-6</div>",
    "<body><ul><li><a>-2</a><li><a>-1</a><li><a>-3</a><li><a>-2</a></ul><div><p>+80</p><p>+41</p><p>+25</p></div><div><a>-3</a> -1 <a>-2</a></div><div>-4</div>",
    "<body><div>-2</div><div><a>-5</a></div><div><p>+35</p><p>+58</p><p>+15</p></div><div><a>-7</a></div><div><a>-6</a></div><div>-5</div>",
    "<body><article><h1>+4</h1><div class=ad>-11</div><p>+20<p>+2<p>+38<div class=share><a>-2</a><a>-1</a></div><p>+5</article><div class=related><a>-8</a><a>-9</a></div><div>-13</div>",
    "<body><form><p>-6</p></form><article><p>+1<p>+6<p>+2<p>+11</article><section class=comments><p>-40<p>-2<p>-70</section><div><p>-19</p></div>",
    "<body><article><h2>+3</h2><p>+16 <a>+9</a><p><a>+4</a><p>+50<ul><li><a>+3</a> +8<li>+9</ul></article><nav><a>-2</a><a>-2</a></nav><p>-8</p>",
    "<body><div><a>-1</a></div><div><a>-1</a></div><h1>+7</h1><p>+66</p><p>+22 <a>+2</a></p><h2>+3</h2><p>+54</p><div>-3</div><div><a>-4</a></div>",
    "<body><main><div class=promo><p>-32</p></div><p>+28<p>+3<div class=newsletter><p>-9</p></div><p>+44</main><footer><p>-30</p><p><a>-2</a></p></footer>",
    "<body><div><a>-2</a></div><div><a>-3</a></div><div><a>-2</a> <a>-5</a></div><h1>+5</h1><p>+70</p><p>+31</p><p>+6</p><p>+52</p><div><a>-9</a></div><div><a>-12</a></div><div><a>-2</a></div>",
    "<body><table><tr><td><a>-1</a><td><a>-4</a><td><a>-2</a></table><div><h1>+4</h1><p>+26</p><p>+19 <a>+3</a></p><p>+44</p></div><p><a>-6</a></p><p><a>-3</a></p>",
    "<body><ul><li><a>-5</a><li><a>-8</a><li><a>-6</a></ul><p>+55</p><p>+61</p><p>+17</p><ul><li><a>-7</a><li><a>-11</a></ul><div>-4 <a>-3</a></div>",
    "<body><main><p>+14 <a>+5</a></p><p>+30</p><ul><li><a>+2</a> +7</li><li>+12</li></ul></main><p><a>-3</a></p><p>-9</p><div><p>-28</p></div>",
    "<body><div><p>-45</p><p>-33</p></div><article><h1>+7</h1><p>+34</p><p>+4</p><p>+29</p></article><div><p>-38</p><p>-24</p><p>-61</p></div>",
    "<body><p>-27</p><main><p>+15</p><p>+31</p><h2>+2</h2><p>+3</p></main><div>-52</div><div>-29</div><p>-36</p>",
    "<body><div><p>-23</p></div><article><p>+25</p><p>+90</p></article><p>-47</p><p>-64 <a>-3</a></p><p>-31</p>",
    "<body><h1>+6</h1><p>+38</p><p>+12</p><p>+47</p><h2>+4</h2><p>+29</p><p>+9</p><p>+68</p><ul><li><a>-2</a><li><a>-2</a></ul><p>-6</p>",
    "<body><div><h1>+3</h1><p>+24</p><p>+8</p><p>+33</p><p>+14</p><p>+26</p></div><div>-2</div><div><a>-2</a></div><div>-3</div>",
    "<body><ul><li><a>-3</a><li><a>-1</a></ul><h1>+5</h1><p>+30 <a>+14</a></p><p>+33 <a>+9</a> +8</p><p>+21</p>",
    "<body><div><a>-1</a> <a>-2</a></div><p>+60</p><p>+17 <a>+6</a></p><p>+42</p><p>+74</p>",
    "<body><p>+36</p><p>+10</p><p>+28</p><p>+19</p>",
    "<body><article><p>+1</p><p>+2</p><p>+1</p><p>+3</p></article><div><a>-4</a></div>",
    "<body><form><nav><a>-1</a> <a>-2</a></nav><article><h1>+5</h1><p>+37</p><p>+4</p><p>+52</p></article><footer>-8</footer></form>",
    "<body><div class='site has-sidebar'><div><a>-2</a></div><div><h1>+6</h1><p>+41</p><p>+23</p><p>+58</p></div><div class=sidebar><p>-22</p></div></div>",
    "<body><nav><a>-6</a></nav><article><p>+50</p><p>+7</p></article><footer><a>-7</a><p>-50</p></footer>",
    "<body><article><h1><a>+6</a></h1><p>+10</p><p>+31</p><p><a>+5</a></p></article><div><a>-6</a></div>",
    "<body><main><p>+44</p><ul><li><a>+6</a></li><li><a>+5</a></li><li><a>+7</a></li></ul><p>+5</p></main><p><a>-4</a></p>",
    "<body><div><a>-1</a> <a>-2</a> -1</div><div><p>+50</p></div>",
    "<body><div><a>-2</a> <a>-1</a></div><div><p>+34</p><p>+3</p></div>",
    "<body><article><header><h1>+6</h1></header><p>+40<aside><p>-17</p></aside><p>+9<form>-5</form><p>+1</article>",
)
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "place", "outside", "heading")
#: Splits by what the markup says: boilerplate or not; out of the page's article, no article, in it.
MARKUP = ((FEATURES.index("outside"), 0.5), (FEATURES.index("place"), -0.5), (FEATURES.index("place"), 0.5))


@dataclass
class Block:
    text: str
    words: int
    density: float
    place: int  # in the article 1, elsewhere -1, 0 if the page has none
    outside: int
    heading: int


def _speaks(name: str, attributes: str, inside: bool, spared: bool = False) -> tuple[bool, bool, bool]:
    """Whether an element speaks of boilerplate, whether it is the article, and whether only a form or a class speaks of boilerplate.

    Where it is spared, a form and a class do not count.
    """
    # A header within the article holds its title.
    outside = name in OUTSIDE_NAMES and name != "form" and not (inside and name == "header")
    weak = name == "form"
    article = name in ARTICLE_NAMES
    if attributes and not outside:
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if key == "role":
                outside |= value in OUTSIDE_ROLES
                article |= value in ("main", "article")
            elif key in ("class", "id"):
                words = SEPARATOR.split(value)
                weak |= not OUTSIDE_WORDS.isdisjoint(words) and name not in ("body", "html", "article", "main")
                article |= name != "body" and not ARTICLE_WORDS.isdisjoint(words)
            elif key == "style":
                outside |= "display:none" in value.replace(" ", "")
            else:
                outside |= value in ("", "true", "hidden")
    weak = weak and not outside and not spared
    outside |= weak
    return outside, article and not outside, weak


@functools.lru_cache(maxsize=32)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I)


def blocks_of(page: str) -> list[Block]:
    """The page's flat blocks in order, without empty ones.

    A form, or an element whose class speaks of boilerplate, is not boilerplate if it wraps the page's text: if it
    holds all of its articles (where it has none, its top headings) and most of its unlinked words, or its only article. On a page with neither it must hold nine tenths of the words.
    """
    out, wrappers = _scan(page, frozenset())
    return _scan(page, wrappers)[0] if wrappers else out


def _scan(page: str, spared: frozenset[int]) -> tuple[list[Block], frozenset[int]]:
    """The blocks, and the numbers of the elements that wrap the page's text although a form or class speaks against it."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # name, outside, article; both as of the element and those around it
    open_names: dict[str, int] = {}
    unclosed: set[str] = set()  # names without a further closing tag
    n_elements = unlinked = 0
    weak: dict[int, tuple[int, int]] = {}  # by stack position: number of the element, unlinked words before it
    held: list[tuple[int, int, int]] = []  # weak elements: their number, the last one inside, unlinked words
    articles: list[int] = []
    tops: list[int] = []

    def closed(i: int) -> None:
        """Takes the stack down to ``i`` elements."""
        while weak and next(reversed(weak)) >= i:
            _, (number, before) = weak.popitem()
            held.append((number, n_elements, unlinked - before))
        for name, _, _ in stack[i:]:
            open_names[name] -= 1
        del stack[i:]
    pieces: list[tuple[str, bool]] = []
    heading = linked = False

    def flush() -> None:
        nonlocal heading, unlinked
        if pieces:
            words = html.unescape("".join(t for t, _ in pieces)).split()
            if words:
                in_links = sum(len(html.unescape(t).split()) for t, a in pieces if a)
                _, outside, article = stack[-1] if stack else ("", False, False)
                unlinked += max(0, len(words) - in_links)
                out.append(Block(" ".join(words), len(words), min(1.0, in_links / len(words)), int(article), int(outside), int(heading)))
            pieces.clear()
        heading = False

    at = 0
    while m := TOKEN.search(page, at):
        if at < m.start():
            pieces.append((page[at : m.start()], linked))
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in SILENT:
            pieces.append((" ", linked))
            if not closing and not m[3].endswith("/") and name not in unclosed:
                end = _closing(name).search(page, at)
                at = end.end() if end else len(page) if name in RAW else at
                if not end:
                    unclosed.add(name)
            continue
        if name in BLOCKS:
            flush()
            heading = name in HEADINGS and not closing
            if name == "h1" and not closing:
                n_elements += 1
                tops.append(n_elements)
        elif name == "br":
            pieces.append((" ", linked))
        if name == "a":
            linked = not closing
        if closing:
            # Names that are not open close nothing; what a closing tag passes on its way is closed with it.
            for i in range(len(stack) - 1, -1, -1) if open_names.get(name) else ():
                if stack[i][0] == name:
                    closed(i)
                    break
        elif name in CONTAINERS and name not in VOID and not m[3].endswith("/"):
            if name in ("p", "li", "td", "th", "tr", "a") and stack and stack[-1][0] == name:
                closed(len(stack) - 1)  # these close their like
            _, outside, article = stack[-1] if stack else ("", False, False)
            n_elements += 1
            own_outside, own_article, own_weak = _speaks(name, m[3], article, n_elements in spared)
            if own_article and not article:
                articles.append(n_elements)
            if own_weak:
                weak[len(stack)] = n_elements, unlinked
            # Boilerplate inside the article stays outside of the text, and so does an article inside boilerplate.
            open_names[name] = open_names.get(name, 0) + 1
            stack.append((name, outside or own_outside, (article or own_article) and not (outside or own_outside)))
    if at < len(page):
        pieces.append((page[at:], linked))
    flush()
    closed(0)
    inner = articles or tops
    most = 0.5 if inner else 0.9
    wrappers = {number for number, last, n in held if all(number <= i <= last for i in inner) and (n > most * unlinked or len(articles) == 1)}
    has_article = any(b.place for b in out)
    for b in out:
        b.place = (1 if b.place else -1) if has_article else 0
    return out, frozenset(wrappers)


def features_of(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), len(FEATURES)))
    for i, b in enumerate(blocks):
        x[i, [0, 1, 6, 7, 8]] = b.words, b.density, b.place, b.outside, b.heading
    x[1:, 2:4] = x[:-1, 0:2]
    x[:-1, 4:6] = x[1:, 0:2]
    return x


def train_tree(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2, first: tuple[tuple[int, float], ...] = MARKUP):
    """A decision tree by Gini impurity: a leaf is a bool, a node is (feature, threshold, low, high).

    The splits ``first`` are made before any other: what the markup says is asked before numbers decide.
    """
    majority = bool(2 * y.sum() >= len(y))
    if first and len(y):
        (f, t), later = first[0], first[1:]
        low = x[:, f] <= t
        if low.all() or not low.any():
            return train_tree(x, y, depth, least, later)
        return f, t, train_tree(x[low], y[low], depth, least, later), train_tree(x[~low], y[~low], depth, least, later)
    if depth == 0 or y.all() or not y.any():
        return majority
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, good = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        p, q = good[:-1] / n, (good[-1] - good[:-1]) / (len(y) - n)
        impurity = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
        for i in np.flatnonzero((v[1:] > v[:-1]) & (n >= least) & (len(y) - n >= least)):
            if best is None or impurity[i] < best[0] - 1e-12:
                best = (impurity[i], f, (v[i] + v[i + 1]) / 2)
    if best is None:
        return majority
    _, f, t = best
    low = x[:, f] <= t
    return f, t, train_tree(x[low], y[low], depth - 1, least, ()), train_tree(x[~low], y[~low], depth - 1, least, ())


def keeps(tree, row) -> bool:
    while not isinstance(tree, bool):
        f, t, low, high = tree
        tree = low if row[f] <= t else high
    return tree


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled pages' blocks."""
    xs, ys = [], []
    for page in LABELLED:
        blocks = blocks_of(re.sub(r"([+-])(\d+)", lambda m: " ".join([("good" if m[1] == "+" else "bad")] * int(m[2])), page))
        xs.append(features_of(blocks))
        ys += [b.text.startswith("good") for b in blocks]
    return np.concatenate(xs), np.array(ys)


@functools.lru_cache(maxsize=1)
def default_tree():
    return train_tree(*labelled_table())


def main_text(page: str | None, tree) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    return "\n".join(b.text for b, row in zip(blocks, features_of(blocks), strict=True) if keeps(tree, row))


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` of the main text."""
    prepared(pages.sparkSession)
    tree = default_tree()

    def make():
        def row(page):
            text = main_text(page, tree)
            return text, len(text)

        return row

    return add_columns(pages, [column], [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], make)
