"""Main text of pages: planted pages with known articles, markup that is broken, and the given table."""

import html
import re
import time

import pytest

from foliotab.llm import html_text
from foliotab.llm.html_text import main_text

P = [f"Paragraph {i}, which says a thing or two, and then some more, so that it is long enough to count." for i in range(6)]
TEXT = "\n\n".join(P)
PS = "".join(f"<p>{p}</p>" for p in P)
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(9)) + "</ul>"
LOUD = "".join(f"<p>I think, {i}, that this is wrong, wrong, wrong, and very long too, as remarks go, alas.</p>" for i in range(30))

PAGES = {
    "article": (f"<html><body><nav>{MENU}</nav><article>{PS}</article><footer>© Us</footer></body></html>", TEXT),
    "divs only": (f'<body><div id="top">{MENU}</div><div id="x"><div>{PS}</div></div><div>About us | Contact</div></body>', TEXT),
    "heading beside": (f"<body><div><h1>The title</h1><div>{PS}</div></div>{MENU}</body>", "The title\n\n" + TEXT),
    "article header": (f"<article><header><h1>The title</h1><div>by Someone</div></header>{PS}<footer>Filed</footer></article>", "The title\n\n" + TEXT),
    "site header": (f"<header><h1>Site</h1>{MENU}</header><main>{PS}</main>", TEXT),
    "aside": (f"<main>{PS}<aside><p>{P[0]}</p></aside></main>", TEXT),
    "comments": (f'<body><div class="post">{PS}</div><div id="comments"><h2>30 comments</h2>{LOUD}</div></body>', TEXT),
    "comments inside": (f'<article>{PS}<section class="comment-list">{LOUD}</section></article>', TEXT),
    "comment articles": (f'<article>{PS}</article><div class="post-comments"><article class="comment">{LOUD}</article></div>', TEXT),
    "cookie notice": (f'<div class="cookie-banner"><p>{P[0]}</p></div><div class="content">{PS}</div>', TEXT),
    "adverts": (f'<article><p>{P[0]}</p><div class="ad-slot">Buy, buy, buy!</div>' + "".join(f"<p>{p}</p>" for p in P[1:]) + "</article>", TEXT),
    "sidebar": (f'<div class="wrap"><div class="entry">{PS}</div><div class="sidebar"><p>{P[0]}</p>{MENU}</div></div>', TEXT),
    "form": (f'<article>{PS}<form><label>Mail</label><input name="a"><button>Send</button></form></article>', TEXT),
    "page in a form": (f'<form id="aspnetForm"><div>{MENU}</div><div>{PS}</div></form>', TEXT),
    "hidden": (f'<article>{PS}<div style="display: none">No</div><div hidden>No</div><p aria-hidden="true">No</p></article>', TEXT),
    "body class": (f'<body class="has-sidebar comments-open"><div>{PS}</div></body>', TEXT),
    "article class": (f'<article class="post category-cookies tag-ads no-comments">{PS}</article>', TEXT),
    "link list inside": (f"<article>{PS}{MENU}</article>", TEXT),
    "list": (f"<article>{PS}<ul><li>one<li>two, <a href=x>three</a></ul></article>", TEXT + "\n\none\n\ntwo, three"),
    "table": (f"<article>{PS}<table><tr><th>a<th>b<tr><td>1<td>2</table></article>", TEXT + "\n\na b\n\n1 2"),
    "short ones": (f"<article><p>Ha.</p>{PS}<p>So.</p></article>", "Ha.\n\n" + TEXT + "\n\nSo."),
    "pre": (f"<article>{PS}<pre>a\n   b</pre></article>", TEXT + "\n\na b"),
    "references": ("<article><p>&lt;b&gt; &amp; &eacute;&#233;&#xe9;&nbsp;&copy &bogus; fine, &amp;amp; so on &am</p></article>", "<b> & ééé © &bogus; fine, &amp; so on &am"),
    "inline": ("<article><p>a<b>b</b>c <i>d</i>\n\te<br>f<span>g</span></p></article>", "abc d e fg"),
    "open tags": ("<article><p><b>one<br><p>two <i>three<p>four</b> five</article>", "one\n\ntwo three\n\nfour five"),
    "unclosed": ("<html><head><title>T</title><body><article><p>one, two<p>three", "one, two\n\nthree"),
    "raw": ("<article><p>a</p><script>var x = '<p>no</p>';</script><style>p{}</style><p>b</p></article>", "a\n\nb"),
    "comment": ("<article><p>a<!-- <p>no</p> -->b</p><!--><p>c</p><!-- open", "ab\n\nc"),
    "quoted >": ('<article><p title="a > b" data-x=\'<p>\'>text</p></article>', "text"),
    "less than": ("<article><p>1 < 2 and <3, a<b></p></article>", "1 < 2 and <3, a"),
    "plain": ("no markup,  at all", "no markup, at all"),
    "empty": ("", ""),
    "blank": (" \n ", ""),
    "only a menu": (f"<nav>{MENU}</nav>", ""),
    "after body": ("<body><article><p>one</p></article></body></html>", "one"),
    "parts": ("<body>" + "".join(f"<section><p>{p}</p></section>" for p in P) + "</body>", TEXT),
}


@pytest.mark.parametrize("name", PAGES)
def test_planted(name):
    source, text = PAGES[name]
    assert main_text(source) == text


@pytest.mark.parametrize("part", ["<div>", "<a ", "<!-- ", "<p><b>", "</p>", "<table><td>", '<a x="', "&", "<", "<ul><li>", "<script>", "<b><p></b>", "<svg/>", "</"])
def test_broken_pages_take_linear_time(part):
    times = []
    for n in (10_000, 40_000):
        t0 = time.perf_counter()
        main_text(part * n + "x" + part)
        times.append(time.perf_counter() - t0)
    assert times[1] < 12 * times[0] + 0.5


def test_given_table(spark):
    """The article of each given page, taken out by patterns that know how these pages are made."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer|\Z)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", lambda t: " " if t[0] == "<br>" else "", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        want = "\n\n".join(b for b in blocks if b)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (want, len(want))


def test_edge_rows(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "", None), (2, None, "<p>a\U0001f600</p>", ""), (3, "v", f"<article>{PS * 3000}</article>", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = sorted([(r["page_id"] or 0, r["text"][:2], r["n_chars"]) for r in got.collect()])
    assert out == [(0, "", 0), (1, "", 0), (1, "", 0), (2, "a\U0001f600", 2), (3, "Pa", 3000 * (len(TEXT) + 2) - 2)]
    assert html_text.extract(df.limit(0)).collect() == []
