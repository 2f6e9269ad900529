import numpy as np
import pytest

from rosterlens.llm import pages
from rosterlens.llm.dom import leaves

LONG = "It is a sentence of some words, and then there is more of it. Another one follows, as long as it has to be."


@pytest.fixture(scope="module")
def chain(spark):
    return pages.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_blocks():
    found = leaves(
        "<!doctype html><title>No</title><script>var a='</p><p>no'</script><body><!-- <p>no --><p class='x ad-box'>One &amp; <b>two\n</b>&nbsp;three<br>four"
        "<p>five<ul><li><a href='a>b'>six</a><li>seven</ul></div>eight < nine<style>no</style><h2>ten</h2"
    )
    assert [x.text for x in found] == ["One & two three four", "five", "six", "seven", "eight < nine", "ten"]
    assert {".x", ".ad", ".box", "^p"} <= found[0].around and found[2].linked == 1 and found[3].linked == 0
    assert "^ul" not in found[4].around


PAGES = [
    (f"<nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav><article><h1>A title</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; 2020 Somebody</footer>", f"A title\n{LONG}\nShort."),
    (f"<div class=menu><a href=a>Home</a> | <a href=b>News</a></div><div id=content><h1>A title</h1><p>{LONG}</p><div class=ad>Buy now, it is cheap.</div><p>{LONG}</p></div><div class=sidebar><h3>Popular</h3><p>Some teaser text here.</p></div>", f"A title\n{LONG}\n{LONG}"),
    (f"<div class='cookie-notice'>We use cookies to make it better. <a href=p>More</a></div><main><h1>Title</h1><p>{LONG}<p>{LONG}</main><section id=comments><h2>Comments</h2><div class=comment><p>{LONG}</p></div></section>", f"Title\n{LONG}\n{LONG}"),
    (f"<header><h1>The site</h1></header><article><h1>Title</h1><p>{LONG}</p></article><form><p>Subscribe to our newsletter.</p><label>Mail</label></form><aside><p>{LONG}</p></aside>", f"Title\n{LONG}"),
    ("", ""),
    ("<nav><a href=a>Home</a></nav>", ""),
    (None, ""),
]


@pytest.mark.parametrize("html,text", PAGES)
def test_main_text(chain, html, text):
    assert pages.main_text(html, chain) == text


def test_held_out_layouts(chain):
    made = pages.Layouts([LONG, "Other words in other places, with some more to come."] * 3, ["Home", "News"], seed=77)
    blocks = wrong = 0
    for _ in range(200):
        found, labels = made.page()
        blocks += len(labels)
        wrong += sum(a != b for a, b in zip(labels, chain.decode(found)))
    assert wrong < 0.03 * blocks


def test_decoding_is_the_best_path(chain):
    r = np.random.default_rng(0)
    for _ in range(50):
        found = [sorted(r.choice(len(pages.NAMES), 6, replace=False).tolist()) for _ in range(r.integers(1, 8))]
        score = lambda y: sum(chain.node[f, k].sum() for f, k in zip(found, y)) + chain.start[y[0]] + sum(chain.pair[a, b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        best = max(np.ndindex(*[2] * len(found)), key=score)
        assert abs(score(chain.decode(found)) - score(best)) < 1e-9


@pytest.mark.parametrize("html", ["<div>" * 30_000 + "x", "<p>" * 30_000, "</div>" * 30_000, "<b" * 50_000, "<!--" * 30_000, '<a href="' * 20_000])
def test_long_pages(chain, html):
    assert isinstance(pages.main_text(html, chain), str)


def test_query_rows(spark, chain):
    rows = [(i, None if i == 2 else f"u{i}", h, "mine") for i, (h, _) in enumerate(PAGES)] + [(0, "u0", PAGES[0][0], "mine"), (None, None, PAGES[1][0], None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = pages.extract(frame, chain).collect()
    want = [(i, u, pages.main_text(h, chain), len(pages.main_text(h, chain))) for i, u, h, _ in rows]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    empty = frame.where("false")
    assert pages.texts(empty).count() == 0


def test_quotes_open_a_value_only_after_an_equals_sign():
    def texts(page):
        return [x.text for x in leaves(page)]

    assert texts("<p title=it's>One two three.</p><p>Don't lose four five six.</p><p>Seven</p>") == ["One two three.", "Don't lose four five six.", "Seven"]
    assert texts('<p><img alt="5" wide">One</p><p>it\'s "two"</p>') == ["One", 'it\'s "two"']
    assert texts('<p title="never closed>One</p><p>Two</p>') == ["One", "Two"]
    assert texts("<p title='never closed>One</p><p>Two</p>") == ["One", "Two"]
    assert texts("<p a='x > y' class = \"b > c\" d>One</p><p e=f=\"g\">Two</p>") == ["One", "Two"]
    (leaf,) = leaves("<p class='mainText' title=it's>One</p>")
    assert {".main", ".text"} <= leaf.around
