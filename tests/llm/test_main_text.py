"""Main text of pages against what a generator put into their articles, over templates of many kinds."""

import random
import re
import time
from html import unescape

import pytest
from posegrid.llm import main_text

NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Contact us</a></li></ul></nav>'
FOOT = "<footer>&copy; example.com &middot; All rights kept. Every one of them, for good.</footer>"
AD = '<div class="ad">Buy this now, it is cheap, and it is good. Really, buy it.</div>'
COMMENTS = '<section class="comments"><h3>Comments</h3><div class="comment"><p>What a long and thoughtful comment this is, with commas, and with stops. It goes on, and on, and on.</p></div></section>'
ASIDE = "<aside><p>Sidebars tell of other things, at length. They have sentences, too.</p></aside>"
COOKIE = '<div id="cookie-banner" role="dialog">We use cookies. <button>Accept</button></div>'
FORM = '<form action="/s"><label>Search</label><input name="q"><select><option>All</option></select></form>'
SCRIPT = '<script>var t="</p>"; if (a<b) { track("<article>no</article>"); }</script><style>p{margin:0}</style><!-- <p>hidden</p> -->'


def sentence(rng):
    words = ["the", "of", "stone", "river", "walked", "caf&eacute;", "R&amp;D", "again", "<b>bold</b>", '<a href="/x">linked</a>', "x&lt;y", "naïve", "under", "bridge"]
    return " ".join(rng.choice(words) for _ in range(rng.randrange(6, 30))).capitalize() + rng.choice([".", "!", ", so they say."])


def body(rng):
    """Markup of an article and the text that it stands for."""
    parts = ["<h1>A title of some length</h1>"]
    for i in range(rng.randrange(3, 9)):
        kind = rng.random()
        text = " ".join(sentence(rng) for _ in range(rng.randrange(1, 5)))
        if i in (0, 2) or kind < 0.6:
            parts.append(f"<p>{text}</p>" if kind < 0.5 else f"<p>{text}\n" if i else f"<p><i>{text}</i><br>\n  {sentence(rng)}</p>")
        elif kind < 0.7:
            parts.append(f"<ul><li>{sentence(rng)}<li>{sentence(rng)}</li></ul>")
        elif kind < 0.8:
            parts.append(f"<h2>Part {i}</h2>")
        elif kind < 0.9:
            parts.append(f"<blockquote><p>{text}</p></blockquote>")
        else:
            parts.append(f"<table><tr><td>{i}</td><td>cell</td></tr></table>")
    if not parts[-1].startswith("<p"):
        parts.append(f"<p>{sentence(rng)} {sentence(rng)}</p>")
    markup = "".join(parts)
    inline = re.sub(r"</?(b|i|a)\b[^>]*>", "", markup)
    return markup, " ".join(unescape(re.sub(r"<[^>]*>", " ", inline)).split())


def page(rng, kind):
    markup, text = body(rng)
    if kind == "article":
        middle = f"{NAV}{AD}<article>{markup}</article>{COMMENTS}"
    elif kind == "unclosed":
        return f"<html><head><title>T</title>{SCRIPT}<body>{NAV}{AD}<article>{markup}", text
    elif kind == "main":
        middle = f'<div id="wrap"><header><h2>Site name, since 1900.</h2>{NAV}</header>{COOKIE}<main class="content has-sidebar">{markup}{AD}{FORM}</main>{ASIDE}</div>'
    elif kind == "nested":
        middle = f'{NAV}<main><article class="post">{markup}<div class="share-buttons"><a href="#">Share this</a></div>{COMMENTS}<footer>By someone</footer></article>{ASIDE}</main>'
    elif kind == "divs":
        middle = f'<div id="top"><div class="x1"><a href="/">Home</a> <a href="/n">News</a></div></div><div class="y"><div class="z">{markup}</div></div><div class="w"><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li><li><a href="/3">Three</a></li></ul></div>'
    elif kind == "role":
        middle = f'<div role="banner">The banner says, at some length, hello.</div><div role="main">{markup}</div><div role="complementary"><p>Other matters, of less weight, follow here.</p></div>'
    else:
        middle = f'<div class="notice">Our site moves, in May. Please note it.</div><div class="sidebar-left">{NAV}<p>About us, and about them, in a few words.</p></div><section id="story">{markup}</section><section id="respond">{FORM}{COMMENTS}</section>'
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Title &amp; more</title>{SCRIPT}</head><body class="single comments-open sidebar-right">{middle}{SCRIPT}{FOOT}</body></html>', text


@pytest.mark.parametrize("kind", ["article", "unclosed", "main", "nested", "divs", "role", "hints"])
def test_templates(kind):
    rng = random.Random(kind)
    for _ in range(60):
        source, text = page(rng, kind)
        assert main_text.main_text(source) == text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""), ("", ""), ("   ", ""), ("just text, without a tag", "just text, without a tag"), (NAV + FOOT, ""), ("<p>one<p>two &amp three &am", "one two & three &am"), ("a < b and 3 <4 <", "a < b and 3 <4 <"),
        ("<p>x&nbsp;&#160; y\t\n z</p>", "x y z"), ("<article><p>in<b>line</b>s<br>next</p></article>", "inlines next"), ("<p title='a > b' class=\"p\">shown</p>", "shown"), ('<p title="never closed>shown</p><p>too</p>', "shown too"),
        ("<article>text <!-- comment", "text"), ("<article>text <script>x", "text"), ("<article>text <a href=", "text"), ("<article><p>&#x1F600; &#0; &bogus; &lt;p&gt;</p></article>", "\U0001f600 � &bogus; <p>"),
        ("<article><header><h1>Own</h1></header><p>Body text.</p><nav>menu</nav></article>", "Own Body text."), ('<article class="comment">No, I disagree.</article><article>Yes.</article>', "Yes."), ("<head><title>t</title><p>text without a body", "text without a body"),
        ('<div class="has-comments"><p>Kept, as it is.</p></div>', "Kept, as it is."), ("</p></div><article>stray</article></b>", "stray"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a b c"),
    ],
)
def test_single_pages(source, text):
    assert main_text.main_text(source) == text


def test_long_and_deep_pages_take_linear_time():
    pages = ["<div>" * n + "text, deep down. " + "</div>" * (n // 2) for n in (20_000, 80_000)]
    pages += ["<p>word, " * n for n in (20_000, 80_000)] + ["<a href='" * n for n in (20_000, 80_000)] + ["<ul><li><div>" * n for n in (5_000, 20_000)] + ["<" * n for n in (20_000, 80_000)] + ['<b x="' + "=' " * n for n in (20_000, 80_000)]
    took = []
    for p in pages:
        start = time.perf_counter()
        main_text.main_text(p)
        took.append(time.perf_counter() - start)
    for small, large in zip(took[::2], took[1::2], strict=True):
        assert large < 12 * small + 0.5


def test_extract(spark):
    rng = random.Random(3)
    made = [(i, *page(rng, kind)) for i, kind in enumerate(["article", "main", "divs", "hints"] * 3)]
    rows = [(i, f"u{i}", source, "x", 5) for i, source, _ in made] + [(None, None, None, "x", 5), (7, "u7", made[7][1], "x", 5), (99, "u", "", "x", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = main_text.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    expected = [(i, f"u{i}", t, len(t)) for i, _, t in made] + [(None, None, "", 0), (7, "u7", made[7][2], len(made[7][2])), (99, "u", "", 0)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    assert main_text.extract(pages.filter("page_id < 0")).collect() == []
