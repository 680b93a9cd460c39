"""Cases that an operator once left out."""

from structcheck.llm import html_blocks


def test_drawings_formulas_and_lists_of_links_in_an_article():
    tree = html_blocks.grow(html_blocks.labelled(html_blocks.PAGES))
    for tag in ('<svg class="i"/>', "<canvas />", '<object data="x"/>', "<svg><path d='m'/></svg>"):
        assert html_blocks.main_text(f"<article><p>one {tag} two</p><p>three</p></article><footer><svg></svg>f</footer>", tree) == "one two\nthree"
    assert html_blocks.main_text("<article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math> holds</p></article>", tree) == "so x=1 holds"
    links = "<ul>" + "".join(f"<li><a href=/{i}>Source number {i}</a></li>" for i in range(4)) + "</ul>"
    assert html_blocks.main_text(f"<nav>{links}</nav><article><p>Text of it.</p>{links}<div class=related>{links}</div></article>", tree).count("Source") == 4


def test_words_of_a_class_alone_decide_nothing():
    tree = html_blocks.grow(html_blocks.labelled(html_blocks.PAGES))
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    for name in ("notice-of-appeal", "search-engines", "related", "share", "tags story", "formula", "menus-of-france"):
        assert html_blocks.main_text(f'<div class="{name}"><p>{a}</p><p>{b}</p></div>', tree) == f"{a}\n{b}", name
    for n in (30, 60, 200):
        p = " ".join(["word"] * n)
        assert html_blocks.main_text(f"<article><p>{p}</p><ul><li><a href=/x>one two three four five six</a></li></ul><p>{p}</p></article>", tree).count(p) >= 2
    for name in ("comments", "site-footer", "cookie-notice", "adBanner", "article-comments"):
        assert html_blocks.main_text(f'<article><p>{a}</p><div class="{name}"><p>{b}</p></div></article>', tree) == a, name


def words(n, x="word"):
    return " ".join([x] * n)


def test_pages_without_an_element_for_the_article():
    tree = html_blocks.grow(html_blocks.labelled(html_blocks.PAGES))
    p = words(60)
    menu = "<div><a href=/>Home</a></div><div><a href=/n>News today</a></div>"
    for page, want in (
        (f'<div class="entry"><h2>A Day</h2><p>{p}</p></div>', f"A Day\n{p}"),
        (f'<div class="post-header"><h1>The headline here</h1></div><div class=post><p>{p}</p></div>', f"The headline here\n{p}"),
        (f"{menu}<h1>Hello there</h1><p>{p}</p><h3>Later on</h3><p>{p}</p><div class=site-footer>{words(30)}</div>", f"Hello there\n{p}\nLater on\n{p}"),
        (f'<div id="site-header">{words(9)}</div><p>{p}</p><p>{p}</p><section class=comments><p>{words(80)}</p></section>', f"{p}\n{p}"),
        (f"{menu}<aside>{words(50)}</aside><p>{p}</p>{menu}", p),
    ):
        assert html_blocks.main_text(page, tree) == want


def test_names_within_an_article():
    tree = html_blocks.grow(html_blocks.labelled(html_blocks.PAGES))
    p = words(60)
    bio = '<div class="author-bio">Ann writes here often.</div><div class="read-more"><a href=/x>Read this as well</a></div>'
    assert html_blocks.main_text(f"<article><h1>A</h1><p>{p}</p>{bio}</article>", tree) == f"A\n{p}"
    short = "<article>" + "".join(f"<p>{words(n)}</p>" for n in range(1, 40)) + "".join(f"<p><a href=/x>{words(n)}</a></p>" for n in range(1, 40)) + "</article>"
    assert html_blocks.main_text(short, tree).count("\n") == 77  # the tree keeps every block of an article that nothing encloses


def test_references_are_decoded_within_a_piece_of_text():
    assert [b.text for b in html_blocks.blocks("<p>a &amp;lt; b</p><p>&am<b>p;lt;</b></p><p>&eacute;&#x41;</p>")] == ["a &lt; b", "&amp;lt;".replace("&amp;", "&am").replace("lt;", "p;lt;"), "éA"]


def test_time_is_in_proportion_to_the_page():
    import time

    for unit in ("<div>", "</ul>", "<ul><li>", "<div>x</p></ul>"):
        sizes = []
        for n in (1 << 14, 1 << 16):
            page = "<div>" * (n // 2) + unit * n
            began = time.perf_counter()
            html_blocks.blocks(page)
            sizes.append(time.perf_counter() - began)
        assert sizes[1] < 12 * sizes[0] + 1


def test_tables_without_rows_and_with_clashing_columns(spark):
    given = spark.createDataFrame([(1, "<article><p>one</p></article>", "old", "x"), (1, None, None, None)], "page_id long, html string, text string, place string")
    assert [tuple(r) for r in html_blocks.extract(given).collect()] == [(1, "x", "one"), (1, None, "")]
    assert html_blocks.extract(given.limit(0)).collect() == [] and html_blocks.extract(given, text_col="HTML_text").columns == ["page_id", "text", "place", "HTML_text"]
