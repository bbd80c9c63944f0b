import html

import numpy as np
import pytest

from flowlab.llm.html_text import LABELLED, blocks_of, extract_text, features, fit_tree, labelled_tree, main_texts

PROSE = "Rivers rise in the hills &amp; run to the sea, past towns that were built where a ford was found."
TREE = labelled_tree()


def text_of(page):
    return main_texts([page], TREE)[0]


def test_article_among_furniture():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{a:b}}</style><script>var x = "<p>no</p>";</script></head><body class="has-sidebar">
    <header><h1>My site</h1><p>{PROSE}</p></header><nav><ul><li><a href="/a">Home</a></li><li>About</li></ul></nav>
    <div class="cookie-notice"><p>{PROSE}</p><button>Accept all of it now</button></div><form><label>Search the site</label><input></form>
    <div class="adSlot ad">{PROSE}</div><!-- {PROSE} --><noscript>{PROSE}</noscript>
    <article><h1>The  title</h1><p><b>One<br><p>Two &quot;quoted&quot; &lt;b&gt; &amp;amp; caf&eacute;&nbsp;x &#8364; &unknown;.</p><div class="ad">Buy</div>
    <ul><li>Item</li><li><a href="x">A link</a></li></ul><section class="reader-comments"><h2>Comments</h2><article><p>{PROSE}</p></article></section></article>
    <aside><p>{PROSE}</p><article><p>{PROSE}</p></article></aside><div id="sidebar"><p>{PROSE}</p></div><footer><p>{PROSE}</p></footer></body></html>"""
    assert text_of(page) == "The title\nOne\nTwo \"quoted\" <b> &amp; café x € &unknown;.\nItem\nA link"


@pytest.mark.parametrize("page", [
    f"<body><ul><li><a>Home</a><li><a>News</a><li><a>Sport</a></ul><div id=page><h2>A heading here</h2><p>{PROSE}<p>{PROSE}<p>Short end.</div><p><a>Next page</a></body>",
    f"<div class=menu><a>Home</a> <a>News</a></div><h2>A heading here</h2><p>{PROSE}</p><p>{PROSE}</p><p>Short end.</p><div class=related><a>x y</a><p>{PROSE}</p></div>",
    f"<main><h2 >A heading here</H2><P title='a > b'>{PROSE}</p><p class=\"advert\">{PROSE}</p><p>{PROSE}</p>Short end.</main><footer>{PROSE}",
])
def test_pages_with_and_without_main_containers(page):
    prose = html.unescape(PROSE)
    assert text_of(page) == f"A heading here\n{prose}\n{prose}\nShort end."


def test_only_furniture_and_broken_markup():
    assert text_of("<nav><a>Home</a></nav><footer>All rights reserved by us</footer>") == ""
    assert text_of("") == text_of(None) == text_of("<article></article>") == text_of("<!-- never closed <article>text") == ""
    assert text_of("<article>a < b and <b c=\"unclosed>d</article>") == "a < b and d"
    assert text_of("<article><p>one</div></p>two<script>var a = 1; never closed <p>x") == "one\ntwo"
    assert text_of("plain text without any tag at all") == "plain text without any tag at all"
    assert text_of("<article><p>" + "<a \"" * 20000 + "</article>") is not None


def test_long_page():
    words = " ".join(f"w{i}" for i in range(200_000))
    page = "<nav><a>Home</a></nav><article>" + f"<p>{words}</p>" * 3 + "</article>"
    assert text_of(page) == "\n".join([words] * 3)


def right(tree, pages):
    t = np.array([row for page in pages for row in page])
    first = np.concatenate([[0], np.cumsum([len(p) for p in pages])])
    return tree.predict(features(t[:, 1], t[:, 2], t[:, 3] > 0, t[:, 0], t[:, 0] == 3, first)) == t[:, 4]


def test_tree_on_its_table_and_on_pages_held_out():
    assert right(TREE, LABELLED).all()
    held_out = np.concatenate([right(labelled_tree([p for p in LABELLED if p is not page]), [page]) for page in LABELLED])
    assert held_out.mean() >= 0.85


def test_fit_tree_on_a_known_rule():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 20, (400, 3)).astype(float)
    y = ((x[:, 1] > 7.5) & (x[:, 2] <= 11.5)).astype(np.int64)
    tree = fit_tree(x, y)
    assert (tree.predict(x) == y).all() and (tree.feature >= 0).sum() == 2
    assert (fit_tree(x, np.ones(400, dtype=np.int64)).predict(x) == 1).all()


def test_neighbours_of_a_block():
    b = blocks_of("<p>a b</p><p><a>c d</a> e f</p><p>g</p>")
    assert [(x.words, x.linked) for x in b] == [(2, 0), (4, 2), (1, 0)]
    x = features(*(np.array([getattr(v, n) for v in b]) for n in ("words", "linked", "heading", "says", "sticky")), np.array([0, 2, 3]))
    assert x[:, :6].tolist() == [[2, 0, 0, 0, 4, .5], [4, .5, 2, 0, 0, 0], [1, 0, 0, 0, 0, 0]]


def test_frame(spark):
    rows = [(1, "u", None, 5, "x"), (1, "u", None, 5, "x"), (None, None, "", 5, "x"), (2, "v", "<article><p>one &amp; two</p>", 6, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, N_CHARS int, `odd.name x` string")
    got = extract_text(pages)
    assert got.columns == ["page_id", "url", "odd.name x", "text", "n_chars"]
    assert sorted(got.collect(), key=repr) == sorted([(1, "u", "x", "", 0)] * 2 + [(None, None, "x", "", 0), (2, "v", "y", "one & two", 9)], key=repr)
    assert extract_text(pages.filter("false")).count() == 0
