import pytest

from peopleweave.llm import html_blocks as H

LONG = "word " * 30
TITLE = "Six words stand in this title"


@pytest.mark.parametrize("html, text", [
    ("", ""),
    ("<p", ""),
    (f"<nav><a>menu</a></nav><article><h1>Title &amp; more</h1><p>{LONG}</p><p>a<br>b&nbsp;c &lt;d&gt;</p></article><footer>end</footer>", "Title & more " + LONG + "a b c <d>"),
    (f"<article><p>one <b>t</b>wo<p>three<script>if (a<b) {{ '</p>' }}</script><style>p{{}}</style></article><aside>{LONG}</aside>", "one two three"),
    (f"<main><p>{LONG}</p><div class='ad-box'>{LONG}</div><form><p>{LONG}</p></form><section id=comments><p>{LONG}</p></section>last</main>", LONG + "last"),
    (f"<header><p>{LONG}</p></header><article><header><h1>Head</h1></header><p>x</p><footer>{LONG}</footer></article>", "Head x"),
    (f"<div id=content><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div><div class=cookieConsent>{LONG}</div>", LONG.strip()),
    (f"<!-- <p>{LONG}</p> --><article><p title='a > b'>kept</p><!-- open comment", "kept"),
    (f"<article><p>before</p><div style='display: none'>{LONG}</div><noscript>{LONG}</noscript>after</article>", "before after"),
    (f"<p>{LONG}<p>{LONG}", LONG + LONG.strip()),
])
def test_pages(html, text):
    assert H.main_text(html) == text.strip()


def test_tree_learns_the_labelled_table():
    x, y = H.training_rows()
    assert len(y) > 90 and ((H.trained().predict(x) >= 0.5) == y).all()
    # Each page is told by a tree that has not seen it.
    right = total = 0
    for i, page in enumerate(H.PAGES):
        own, labels = H.training_rows([page])
        tree = H.Tree(*H.training_rows(H.PAGES[:i] + H.PAGES[i + 1:]))
        right, total = right + int(((tree.predict(own) >= 0.5) == labels).sum()), total + len(labels)
    assert right >= 0.85 * total


def test_operator(spark):
    rows = [(1, "u", f"<article><p>{LONG}é</p></article>", "x"), (1, "u", f"<article><p>{LONG}é</p></article>", "x"), (None, None, None, None), (2, "u", "", "x"), (3, "u", "<p>" * 20_000 + "<a href='x" * 50, "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")
    out = H.extract(frame)
    assert out.columns == ["page_id", "url", "html", "text", "n_chars"]
    got = sorted(((r.page_id, r.text, r.n_chars) for r in out.collect()), key=repr)
    assert got[:2] == [(1, LONG + "é", len(LONG) + 1)] * 2 and (None, "", 0) in got and (2, "", 0) in got
    assert H.extract(frame.limit(0)).collect() == []


@pytest.mark.parametrize("html", [
    f"<form id=aspnetForm><nav>a b</nav><article><h1>{TITLE}</h1><p>{LONG}</p></article></form>",
    f"<form action=x><div class=menu><a>a</a></div><div id=content><h1>{TITLE}</h1><p>{LONG}</p></div></form>",
    f"<div class='has-sidebar'><article><h1>{TITLE}</h1><p>{LONG}</p></article><div class=sidebar>{LONG}</div></div>",
    f"<div class='layout with-sidebar'><article><h1>{TITLE}</h1><p>{LONG}</p></article></div>",
    f"<div id='reader'><article><h1>{TITLE}</h1><p>{LONG}</p></article><section id=comments><article><p>{LONG}</p></article></section></div>",
    f"<div class='page nav-open'><main><h1>{TITLE}</h1><p>{LONG}</p></main><ul class='menu menu-open'><li>{LONG}</ul></div>",
    f"<article><header class='entry-header'><h1>{TITLE}</h1></header><p>{LONG}</p></article>",
    f"<header><h2>s</h2></header><article><h1>{TITLE}</h1><p>{LONG}</p></article><div id=comments><article><h1>c</h1><p>{LONG}</p></article></div>",
    f"<form><div class=popup><main hidden>{LONG}</main></div><article><h1>{TITLE}</h1><p>{LONG}</p></article></form>",
])
def test_wrappers_of_the_article_are_no_furniture(html):
    assert H.main_text(html) == f"{TITLE} {LONG}".strip()


def test_deeply_nested_marks_take_linear_time():
    assert H.main_text("<div class=nav><article>" * 20_000 + "x") in ("", "x")
