"""Pages with the text that a reader would call their main text."""

import functools
from collections import Counter

import pyarrow.parquet as pq
import pytest

from strandlake.llm.html_extract import best_run, count_kinds, extract, html_extract, tokens, weights_of

PROSE = "The old mill stands by the river and nobody in the village knows who built it."
MENU = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
FOOT = "<footer>&copy; 2020 Example</footer>"


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{margin:0}}</style></head><body>{MENU}{body}{FOOT}</body></html>"


CASES = {
    "landmark": (page(f"<article><h1>T</h1><p>{PROSE}</p></article>"), f"T {PROSE}"),
    "no landmark": (page(f"<div id=page><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p></div>"), f"T {PROSE} {PROSE}"),
    "bare less-than": (page("<article><p>if a < b and c > d then 1<2 holds</p></article>"), "if a < b and c > d then 1<2 holds"),
    "bare less-than at the end": ("<article><p>x <", "x <"),
    "everyday word in a class": (page(f'<div class="content social-science"><p>{PROSE}</p></div>'), PROSE),
    "notice board in an article": (page(f'<article><p class="notice-board">{PROSE}</p><p>Two.</p></article>'), f"{PROSE} Two."),
    "header of an article by class": (page(f'<article><div class="post-header"><h1>T</h1></div><p>{PROSE}</p></article>'), f"T {PROSE}"),
    "header of a page by class": (page(f'<div class="site-header">Example dot com</div><div><p>{PROSE}</p></div>'), PROSE),
    "unclosed quote": (page(f'<article><p>A <a href="x>link</a> here.</p><p>{PROSE}</p></article>'), f"A link here. {PROSE}"),
    "quote without an equals sign": (page(f"<article><p title=it's>{PROSE}</p><p>It's two.</p></article>"), f"{PROSE} It's two."),
    "greater-than in a value": (page(f'<article><p title="a > b">{PROSE}</p></article>'), PROSE),
    "wrapper with a removed name": (page(f'<div class="social"><p>{PROSE}</p><p>{PROSE}</p></div>'), f"{PROSE} {PROSE}"),
    "wrapper form": (page(f"<form action=x><div><p>{PROSE}</p><p>{PROSE}</p></div></form>"), f"{PROSE} {PROSE}"),
    "comments longer than the article": (page(f'<div><p>Short but whole article.</p></div><section class="comments"><p>{PROSE * 3}</p></section>'), "Short but whole article."),
    "comments as articles": (page(f'<article><p>{PROSE}</p></article><article class="comment"><p>{PROSE * 3}</p></article>'), PROSE),
    "adverts and cookies": (page(f'<div class="cookie-notice">We use cookies.</div><div><p>{PROSE}</p><div class="ad-box">Buy!</div><p>More.</p></div>'), f"{PROSE} More."),
    "forms, scripts and comments in an article": (page(f"<article><p>{PROSE}</p><form><input>Send</form><script>if(a<b)x()</script><!-- no --><p>More.</p></article>"), f"{PROSE} More."),
    "references": (page("<article><p>A &amp; B&nbsp;&lt;c&gt; &#233;&#x41;</p></article>"), "A & B <c> éA"),
    "inline and blocks": (page("<article><p>on<b>e</b> two<br>three<li>four<td>five</article>"), "one two three four five"),
    "open paragraphs": ("<article><p>one<p class=advert><b>buy<p>two</article>", "one two"),
    "open menu": (f"<nav><a href=x>Home</a><article><p>{PROSE}</article>", PROSE),
    "links around": (page(f"<div><a href=1>One more link</a> <a href=2>and another</a></div><div><p>{PROSE}</p></div><ul><li><a href=3>third of all</a></ul>"), None),
    "custom elements": (page(f"<x-{'y' * 60}><p>{PROSE}</p></x-{'y' * 60}>"), PROSE),
    "long names": (page(f"<article><p class={'z' * 5000}>{PROSE}</p></article>"), PROSE),
    "nothing but menus": (f"<body>{MENU}{FOOT}</body>", ""),
    "no markup": ("just text", "just text"),
    "empty": ("", ""),
    "null": (None, ""),
}


@functools.cache
def learned():
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet", columns=["html"]).column(0).to_pylist()
    return weights_of(sum((count_kinds(p) for p in pages if p), Counter()))


@pytest.mark.parametrize("name", CASES)
def test_page(name):
    html, want = CASES[name]
    for weights in ({}, learned()):
        got = extract(html, weights)
        assert got == want if want is not None else PROSE in got


def test_best_run_is_the_largest_sum():
    values = [1.0, -2.0, 3.0, -1.0, 2.0, -5.0, 4.0, 0.0]
    sums = {(a, b): sum(values[a:b]) for a in range(8) for b in range(a + 1, 9)}
    a, b = best_run(values)
    assert sums[a, b] == max(sums.values()) == 4.0 and best_run([-1.0]) == (0, 0) and best_run([]) == (0, 0)


def test_kinds_are_bounded():
    html = "".join(f"<tag{i}>x</tag{i}>" for i in range(5000))
    assert len({(t, k) for t, k, *_ in tokens(html)}) < 10


def test_long_pages_and_odd_quotes_take_linear_time():
    assert extract("<article>" + "<p class='a>x</p>" * 20_000, {}) != ""
    assert extract("<" * 200_000, {}) != ""
    assert len(extract("<article><p>" + "word " * 400_000, {})) == 1_999_999


def test_table(spark):
    html = CASES["landmark"][0]
    pages = spark.createDataFrame([(0, "u", html, "t", 1), (None, "u", html, "t", 1), (1, "u", None, "t", 1), (2, None, "", "t", 1), (0, "u", html, "t", 1)], "page_id long, url string, html string, text string, n_chars int")
    got = html_extract(pages).collect()
    n = len(CASES["landmark"][1])
    assert sorted((-1 if r["page_id"] is None else r["page_id"], r["n_chars"]) for r in got) == [(-1, n), (0, n), (0, n), (1, 0), (2, 0)]
    assert html_extract(pages.where("false")).collect() == []
