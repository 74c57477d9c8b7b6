import html
import re
import time

import numpy as np

from orrerylake.llm import main_text as M
from orrerylake.llm import queries
from orrerylake.llm.labelled_pages import _page

SF = "/root/testdata/sf0.001"


def test_tree_on_pages_it_has_not_seen():
    tree = M.trained_tree()
    right = []
    for k in range(5_000, 5_100):
        page = M.cut(_page(k))
        label = np.array([b.label for b in page.blocks])
        right += (M.keeps(tree, M.features(page)) == label)[label >= 0].tolist()
    assert np.mean(right) > 0.97


LONG = [
    "The river rose in the night and took the lower bridge with it, so the mail came over the hill for a week.",
    "Nobody in the town could say when the bridge had been built, but the stones were older than the church.",
    "A mason from the valley looked at what was left of the arch and said that it could be set again before winter.",
]
BODY = "".join(f"<p>{x}</p>" for x in LONG)
LINKS = "".join(f'<a href="/{k}">Link {k}</a> ' for k in range(6))
#: Layouts that the generator of the labelled pages does not make; each holds the article LONG and nothing else to keep.
OTHER_LAYOUTS = {
    "table": f"<table width=100%><tr><td>{LINKS}</td></tr><tr><td><table><tr><td width=150>{LINKS}</td><td>{BODY}</td></tr></table></td></tr><tr><td>All rights reserved</td></tr></table>",
    "wrong wrappers": f'<div id="page-header-wrap"><div class="widget-area content"><ul><li>{LINKS}</li></ul>{BODY}</div></div><footer>Imprint and contact</footer>',
    "wrong class": f'<nav>{LINKS}</nav><article class="social-media-study">{BODY}</article><footer>Imprint and contact</footer>',
    "breaks": f"<center>{LINKS}</center><br><br>{'<br><br>'.join(LONG)}<hr>{LINKS}",
    "center": f"<center>{LINKS}</center><font size=2>{BODY}</font><center>{LINKS}</center>",
    "role": f'<div role="navigation">{LINKS}</div><div role="main">{BODY}</div><div role="contentinfo">Imprint and contact</div>',
    "definitions": f"<div class=x1>{LINKS}</div><div class=x2>{BODY}</div><div class=x3><dl><dt>{LINKS}<dd>{LINKS}</dl></div>",
    "comments": f'<header>News of the town</header><section>{BODY}</section><ol class="commentlist"><li><p>I walked over it last week and it was fine.<li><p>So did I, twice, and with the dog.</ol>',
    "object": f"<nav>{LINKS}</nav><main><object><p>{LONG[0]}</p></object><noscript><p>{LONG[1]}</p></noscript><p>{LONG[2]}</p></main>",
}


def test_other_layouts():
    for name, page in OTHER_LAYOUTS.items():
        assert M.main_text(f"<html><body>{page}</body></html>") == " ".join(LONG), name


HOSTILE = ["<span>" * 8 + "</i>x", '<a "', "<i><div></i>", "<td><p>x", "<svg>", "<span><br>x", '<a b="', "<a='", "<", "</", "<!--", "<p ", "&#" + "9" * 5_000 + ";x", "<li><p>x", "<table><tr><td>x", "<b><p></b>x"]


def test_hostile_pages_take_time_in_proportion():
    for part in HOSTILE:
        took = []
        for size in (250_000, 500_000):
            start = time.perf_counter()
            M.main_text(part * (size // len(part)))
            took.append(time.perf_counter() - start)
        assert took[1] < 3 * took[0] + 0.5, (part[:20], took)
    start = time.perf_counter()
    M.main_text(('<a "' + "<span>" * 50 + "</i>") * 3_000)
    assert time.perf_counter() - start < 10
    for opening in ("<i>" * 40_000 + "<div>" * 40_000, "<span>" * 80_000):
        start = time.perf_counter()
        M.main_text(opening + "</i>" * 40_000 + "<br>x" * 10_000)
        assert time.perf_counter() - start < 10


def test_query_returns_the_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op2_main_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", inner))).split())
        assert (r.text, r.n_chars) == (want, len(want))


PAGES = {
    "<main><p>A paragraph <b>with bo</b>ld &amp; more &eacute;&#233; text in it, of some length to be read <br>and another line": "A paragraph with bold & more éé text in it, of some length to be read and another line",
    '<body class="has-sidebar"><main><header>Head</header><article><h1>Title</h1><p>One   two\n three.<p>Four<div class="ad-box">Buy now</div><aside>More</aside><ul><li>a<li>b</ul></article></main>'
    '<div id="comments"><p>I liked this text about the river a lot, thank you.</p></div></body>': "Title One two three. Four a b",
    '<article><p title="a > b">x < y</p><script>if (a<b) document.write("<p>no</p>")</script><style>p{}</style><!-- <p>no</p> --><p>z</p></article>': "x < y z",
    "<article><p>cut off <scr": "cut off <scr",
    '<div class="cookie-notice">We use cookies on this site</div><article><form>Your name <input></form><p>Text</p><section class="responses"><p>Reply</p></section></article>': "Text",
}


def test_single_pages():
    for page, want in PAGES.items():
        assert M.main_text(page) == want


def test_edge_cases(spark):
    long = "<article>" + "<p>word &lt; word</p>" * 60_000 + "</article>"
    rows = [(1, None, "x"), (2, "", "x"), (3, "<nav>only</nav>", "x"), (4, "<article><p>a</p></article>", "x"), (4, "<article><p>a</p></article>", "x"), (5, long, None)]
    df = spark.createDataFrame(rows, "page_id int, html string, main_text string")
    got = M.extract(df)
    assert got.columns == df.columns
    assert sorted((r.page_id, len(r.main_text)) for r in got.collect()) == [(1, 0), (2, 0), (3, 0), (4, 1), (4, 1), (5, 60_000 * 12 - 1)]
    assert M.extract(df.limit(0)).count() == 0


def test_attributes_of_any_value(spark):
    """Marks that only labelled pages bear may mean anything elsewhere."""
    for value in ("Price", "", "-1", "99999999999999999999", "1", "0", None):
        mark = "" if value is None else f' data-label="{value}"'
        page = f"<html><body><nav>{LINKS}</nav><article{mark}>{BODY}<table><tr><td{mark}>10</td></tr></table></article></body></html>"
        assert M.extract(spark.createDataFrame([(1, page)], "page_id int, html string")).first().main_text.startswith(" ".join(LONG)), value
