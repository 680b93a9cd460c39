"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks of text at every tag that is not inline. A block has a word count and a link density (the
share of its words inside links), those of the block before and after it, and what its surroundings say: whether a
landmark such as ``nav`` or ``footer`` encloses it, whether an enclosing class, id or role is a name of boilerplate (2
for names that mean nothing else, such as comments, 1 for those that an article may have too, such as tags), whether an
``article`` or ``main`` encloses it, all three in one number, its place, and whether it is a heading. The tree is grown
from the labelled blocks of PAGES, a small table of page layouts, when the operator is called; it alone decides which
blocks are the article.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common  # noqa: F401  workers need no copy of this module

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|canvas|object)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?<=/)>"
    r"|<(script|style|noscript|template|title|textarea|iframe|object|svg|annotation-xml|annotation|select|canvas)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[/!?a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter picture progress q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr"
    " math semantics maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover".split()
)
CONTAINERS = frozenset("html body article main section div nav header footer aside form menu dialog fieldset ul ol li dl dt dd table tbody thead tfoot tr td th blockquote figure figcaption details summary center button pre address search".split())
LANDMARKS = frozenset("nav footer aside form menu dialog fieldset button search head".split())
#: Names of boilerplate, those that an article may have too, and words of layout that go with either.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising alert alertdialog banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright"
    " dialog disclaimer disqus footer form gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion replies"
    " reply respond sidebar signup skip sponsor sponsored subscribe subscription".split()
)
WEAK_NAMES = frozenset("author bio byline more rail recommended related search share sharing social tag tags teaser toolbar".split())
LAYOUT = frozenset(
    "area article bar block blog body bottom box col column container content desktop entry group inner item items left link links list main mobile outer page panel post read reader"
    " right row section site slot small story text title top unit user widget wrap wrapper".split()
)
#: A header that is named after one of these is that of the article.
OWN_HEADER = frozenset("article blog content entry news post story text title".split())
ARTICLE = frozenset({"article", "main"})


class Block(NamedTuple):
    text: str
    words: int
    links: float
    landmark: int
    named: int
    article: int
    heading: int


def _named(attrs: str, in_article: bool) -> int:
    """2 if a class, id or role is a name of boilerplate, or the element is hidden, 1 if it is a weak one, else 0.

    A name counts if it is made of names and words of layout alone: notice-of-appeal is none.
    """
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTR.finditer(attrs)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return 2
    level = 0
    for token in " ".join(found.get(k, "") for k in ("class", "id", "role")).split():
        words = {w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower()) if len(w) > 1}
        rest = words - LAYOUT
        if rest and rest <= NAMES | WEAK_NAMES | ({"header"} if not in_article and not words & OWN_HEADER else set()):
            level = max(level, 1 if rest <= WEAK_NAMES else 2)
    return level


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order. Markup, comments, scripts, styles and drawings are dropped; references are decoded.

    A closing tag without an open one is passed over; how many are open is counted by name, so that the time of a page is
    in proportion to its length.
    """
    out: list[Block] = []
    opened: dict[str, int] = {}
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]  # name, landmark, named, article
    text: list[str] = []
    linked: list[str] = []
    in_link = heading = 0

    def flush() -> None:
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                n = whole.count(" ") + 1
                in_a = len(" ".join(linked).split())
                out.append(Block(whole, n, min(1.0, in_a / n), *stack[-1][1:], heading))
            text.clear()
            linked.clear()

    def add(piece: str) -> None:
        if piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if in_link:
                linked.append(piece)

    at = 0
    for m in TAG.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name, closing = name.lower(), bool(m[2])
        if name in INLINE:
            if name == "a":
                in_link = 0 if closing else 1
            elif name == "br":
                add(" ")
            continue
        flush()
        if len(name) == 2 and name[0] == "h" and name[1] in "123456":
            heading = 0 if closing else 1
        elif not closing:
            heading = 0
        if name not in CONTAINERS and name != "head":
            continue
        if closing:
            while opened.get(name):
                last = stack.pop()[0]
                opened[last] -= 1
                if last == name:
                    break
            in_link = 0
        elif not m[4].endswith("/"):
            _, landmark, named, article = stack[-1]
            article |= name in ARTICLE
            landmark |= name in LANDMARKS or (name == "header" and not article)
            if m[4] and name not in ("html", "body"):
                named = max(named, _named(m[4], bool(article)))
            stack.append((name, int(landmark), int(named), int(article)))
            opened[name] = opened.get(name, 0) + 1
    add(page[at:])
    flush()
    return out


FEATURES = ("place", "words", "links", "words_before", "links_before", "words_after", "links_after", "landmark", "named", "article", "heading")


def place(b: Block) -> int:
    """0 within a landmark or a strong name, 2 within an article without any name, else 1."""
    return 0 if b.landmark or b.named == 2 else 2 if b.article and not b.named else 1


def features(found: list[Block]) -> list[tuple]:
    edge = (0, 0.0)
    size = [edge, *((b.words, b.links) for b in found), edge]
    return [(place(b), b.words, b.links, *size[i], *size[i + 2], b.landmark, b.named, b.article, b.heading) for i, b in enumerate(found)]


#: Labelled blocks in their pages: {label:words} is a block of so many words, {label:words/linked} has so many in links.
PAGES = [
    # an article of its own element, with menus and footers round it
    "<nav><ul><li>{0:1/1}</li><li>{0:2/2}</li><li>{0:1/1}</li></ul></nav><div class=ad>{0:7}</div><article><h1>{1:8}</h1><p>{1:60}</p><p>{1:55}</p><p>{1:3}</p><p>{1:140}</p></article><footer>{0:9}</footer>",
    "<header><div>{0:3/3}</div><nav>{0:6/6}</nav></header><main><h1>{1:5}</h1><p>{1:1}</p><p>{1:22}</p><ul><li>{1:9}</li><li>{1:4}</li></ul></main><aside><h3>{0:2}</h3><p>{0:25/4}</p></aside><footer><p>{0:12/5}</p></footer>",
    "<article><h2>{1:6}</h2><p>{1:200/6}</p><aside>{0:45}</aside><blockquote>{1:30}</blockquote><table><tr><td>{1:2}</td><td>{1:1}</td></tr></table><footer>{0:7}</footer></article>",
    "<article><h1>{1:7}</h1><div class=ad>{0:14}</div><p>{1:80}</p><div class=newsletter>{0:20}<form>{0:3}</form></div><p>{1:12}</p></article><section class=comments><p>{0:55}</p><p>{0:8}</p><p>{0:120}</p></section>",
    "<main><p>{1:70}</p><ul><li>{1:6/6}</li><li>{1:5/5}</li></ul><p>{1:40}</p><div class=comments><h3>{0:2}</h3><p>{0:90}</p></div></main>",
    "<article><p>{1:35}</p><div class=share>{0:3/3}</div><p>{1:50}</p><div class=tags>{0:2/1}{0:0}</div><div class=related><h4>{0:2}</h4><ul><li>{0:8/8}</li><li>{0:6/6}</li></ul></div></article>",
    # notices, banners and hidden text
    "<div class=cookie-notice>{0:34/2}</div><div id=banner>{0:10}</div><h1>{1:9}</h1><p>{1:65}</p><p>{1:48}</p><p>{1:75}</p><div class=copyright>{0:8}</div>",
    "<div hidden>{0:40}</div><div role=dialog>{0:25}</div><article><p>{1:90}</p><p hidden>{1:11}</p></article>",
    "<div class=sidebar><p>{0:60}</p><p>{0:44}</p></div><div class=content><p>{1:85}</p><p>{1:52}</p></div>",
    "<div class=sponsored><h3>{0:6}</h3><p>{0:70}</p></div><div><h1>{1:6}</h1><p>{1:110}</p><p>{1:64}</p></div><div class=replies><p>{0:66}</p><p>{0:18}</p></div>",
    # names that an article may have too, round its text and round boilerplate
    "<div class=related><p>{1:60}</p><p>{1:60}</p></div>", "<div class=share><p>{1:75}</p><p>{1:38}</p><p>{1:50}</p></div><div class=social>{0:4/4}</div>",
    "<div class='tags story'><h1>{1:7}</h1><p>{1:60}</p><p>{1:58}</p></div><div class=tags>{0:3/3}</div>", "<div class=search>{0:2}</div><div><p>{1:95}</p><p>{1:40}</p></div><div class=toolbar>{0:5}</div>",
    "<div class=recommended><ul><li>{0:9/9}</li><li>{0:7/7}</li><li>{0:11/11}</li></ul></div><div class=teaser>{0:12/5}</div><div><p>{1:130}</p></div>",
    "<article><h1>{1:6}</h1><p>{1:80}</p><div class=author-bio>{0:5}</div><div class=read-more>{0:3/3}</div></article>", "<article><p>{1:44}</p><p>{1:90}</p><div class=author-bio><p>{0:38/2}</p></div></article><div class=more>{0:6/6}</div>",
    "<main><p>{1:150}</p><div class=byline>{0:2}</div><p>{1:33}</p><div class=social>{0:2/2}</div><div class=related><p>{0:26/8}</p></div></main>",
    # an article of short and linked blocks, and long texts round it
    "<article><h1>{1:1}</h1><p>{1:1}</p><p>{1:2}</p><p>{1:1/1}</p><ul><li>{1:5/5}</li><li>{1:2/2}</li><li>{1:9/9}</li><li>{1:1/1}</li></ul><p>{1:3/2}</p><p>{1:1}</p></article><footer><p>{0:60}</p><p>{0:90}</p></footer>",
    "<main><table><tr><td>{1:1/1}</td><td>{1:2}</td><td>{1:3/3}</td><td>{1:1}</td></tr><tr><td>{1:4/4}</td><td>{1:1}</td><td>{1:7/7}</td><td>{1:2}</td></tr></table><p>{1:30/25}</p><p>{1:14/14}</p></main><section class=comments><p>{0:150}</p><p>{0:33}</p><p>{0:41}</p><p>{0:70}</p></section>",
    "<aside><p>{0:130}</p><p>{0:75}</p></aside><article><p>{1:2/2}</p><h2>{1:2/2}</h2><p>{1:6/4}</p><ul><li>{1:8/8}</li><li>{1:20/20}</li><li>{1:3/3}</li></ul><p>{1:1}</p></article><div class=replies><p>{0:100}</p><p>{0:85}</p></div>",
    "<main><p>{1:1}</p><p>{1:1/1}</p><p>{1:2/2}</p><p>{1:40/30}</p><p>{1:6/6}</p><p>{1:12/12}</p><p>{1:16/9}</p></main><nav><p>{0:45}</p><p>{0:80/2}</p></nav><div class=disclaimer><p>{0:110}</p><p>{0:65}</p></div>",
    # headings and bylines of a page without an element for the article
    "<div class=entry><h2>{1:2}</h2><p>{1:60}</p></div>", "<h1>{1:2}</h1><p>{1:3}</p><p>{1:58}</p><p>{1:41}</p>", "<div class=post-header><h1>{1:4}</h1></div><div class=post><p>{1:70}</p><h2>{1:1}</h2><p>{1:52}</p></div>",
    "<div>{0:2/2}</div><div>{0:3/3}</div><div><h1>{1:1}</h1><p>{1:90}</p><h3>{1:3}</h3><p>{1:25}</p></div><div>{0:4/4}</div>", "<h3>{0:2}</h3><ul><li>{0:2/2}</li><li>{0:4/4}</li></ul><h1>{1:3}</h1><p>{1:64}</p>",
    # pages without an element for the article: running text and its headings against scraps and lists of links
    "<div>{0:2/2}</div><div>{0:3/3}</div><div>{0:1/1}</div><h1>{1:9}</h1><p>{1:70}</p><p>{1:8}</p><p>{1:66}</p><p>{1:16}</p><p>{1:45/4}</p><div>{0:6}</div><div>{0:3/3}</div>",
    "<table><tr><td>{0:2/2}</td><td>{0:2/2}</td></tr></table><div><h2>{1:5}</h2><p>{1:50}</p><h2>{1:6}</h2><p>{1:44}</p><p>{1:28}</p></div><div>{0:4/4}</div><div>{0:2/2}</div>",
    "<div><p>{1:300}</p><p>{1:12}</p><p>{1:250}</p></div><div>{0:5}</div><div>{0:3/3}</div><div>{0:4/3}</div>", "<p>{1:24/5}</p><p>{1:50}</p><p>{1:33}</p><div>{0:9/8}</div><div>{0:20/18}</div>",
    "<div>{0:4/4}</div><div>{0:4}</div><div>{0:3/3}</div><div>{0:40/28}</div><div>{0:5/5}</div><div>{0:10/8}</div>", "<ul><li>{0:8/8}</li><li>{0:6/6}</li><li>{0:9/9}</li></ul><p>{1:80}</p><p>{1:61}</p><ul><li>{0:7/7}</li><li>{0:4/4}</li></ul>",
    "<h1>{1:4}</h1><div>{0:3}</div><div>{0:2/2}</div><p>{1:42}</p><p>{1:57}</p>", "<div>{0:1/1}</div><div>{0:12/9}</div><p>{1:36}</p><p>{1:120}</p><p>{1:18}</p><p>{1:90}</p><div>{0:6/6}</div>",
    "<p>{1:47}</p>", "<p>{1:20}</p><p>{1:31}</p>", "<h2>{0:4}</h2><ul><li>{0:3/3}</li><li>{0:5/5}</li></ul>", "<div>{0:2}</div><div>{0:3}</div><div>{0:2/2}</div>",
]


def labelled(pages: list[str]) -> list[tuple]:
    """FEATURES and the label of each block of such pages."""
    out = []
    for page in pages:
        labels: list[int] = []

        def block(m: re.Match) -> str:
            words, linked = int(m[2]), int(m[3] or 0)
            if words:
                labels.append(int(m[1]))
            return " ".join(["word"] * (words - linked)) + (f" <a href=x>{' '.join(['word'] * linked)}</a>" if linked else "")

        found = blocks(re.sub(r"\{([01]):(\d+)(?:/(\d+))?\}", block, page))
        if len(found) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(found)} blocks: {page}")
        out += [(*row, label) for row, label in zip(features(found), labels)]
    return out


def grow(rows: list[tuple], depth: int = 8) -> tuple:
    """A binary tree by Gini impurity: (label,) or (feature, bound, left, right), left for values up to the bound."""
    ones = sum(r[-1] for r in rows)
    best = None
    if 0 < ones < len(rows) and depth:
        for f in range(len(rows[0]) - 1):
            values = sorted({r[f] for r in rows})
            for low, high in zip(values, values[1:]):
                bound, impurity = (low + high) / 2, 0.0
                for side in ([r[-1] for r in rows if r[f] <= bound], [r[-1] for r in rows if r[f] > bound]):
                    p = sum(side) / len(side)
                    impurity += len(side) * p * (1 - p)
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, bound)
    if best is None:
        return (int(2 * ones >= len(rows)),)
    _, f, bound = best
    return (f, bound, grow([r for r in rows if r[f] <= bound], depth - 1), grow([r for r in rows if r[f] > bound], depth - 1))


def decide(tree: tuple, row: tuple) -> int:
    while len(tree) == 4:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def is_article(tree: tuple, row: tuple) -> int:
    """Whether a block is of the article, as the tree says."""
    return decide(tree, row)


def main_text(page: str | None, tree: tuple) -> str:
    """The article's blocks in page order, one line each."""
    found = blocks(page or "")
    return "\n".join(b.text for b, row in zip(found, features(found)) if is_article(tree, row))


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", examples: list[str] | None = None) -> DataFrame:
    """`pages` without `html_col`, with the main text as `text_col`; a column of that name is replaced.

    A null or empty page has an empty text; repeated rows and other columns, whatever their names, pass as they are; an
    empty table stays empty. One pass, nothing is shuffled; a worker holds one page at a time, whatever its length.
    `examples`: pages with labels to grow the tree from, as PAGES.
    """
    tree = grow(labelled(PAGES if examples is None else examples))
    kept = [c for c in pages.columns if c not in (html_col, text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(x.as_py(), tree) for x in b.column(b.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], [*b.schema.names[:-1], text_col])

    given = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(html_col))
    schema = given.drop(html_col).schema.add(text_col, "string")
    return given.mapInArrow(run, schema)
