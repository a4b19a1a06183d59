import random

import pytest

from keelson.llm import html_main

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header class="top"><h1>Site</h1></header><nav><ul><li><a href="/x">x, y</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy, buy, buy this thing now, please.</div><div id="cookie-notice">We use cookies, sorry.</div>
%s
<section class="comments"><p>First, I say, this is a very long reader comment, really long, and wrong.</p></section>
<div class="sidebar"><p>Related things, and more.</p></div><form><p>Mail, please</p></form><footer>&copy; us</footer></body></html>"""
BODY = "<h1>A &amp;amp; B</h1><p><b>First&nbsp;one,\n two.<br><p>Second &lt;i&gt;   <i>one</i>.</p><p> </p><ul><li>x<li>y</ul>"
WANT = "A &amp; B\nFirst one, two.\nSecond <i> one.\nx\ny"


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main><div>%s</div></main>", '<div class="content">%s</div>'])
def test_article_only(wrap):
    assert html_main.main_text(PAGE % (wrap % BODY)) == WANT


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("plain   text", "plain text"), ("<p>a<p>b", "a\nb"), ("<p>1 < 2 & 3</p>", "1 < 2 & 3"),
        ("<article><p>cut off <b", "cut off"), ("<script>x</script>", ""), ("<article>Re.</article><footer>f", "Re."),
        ("<body class='no-sidebar'><p>kept, yes</p></body>", "kept, yes"), ("<p>x</p></div></p><p>y</p>", "x\ny"),
        ("<div><p>one, two</p></div><div hidden><p>not, this, one, at, all</p></div>", "one, two"),
    ],
)
def test_small_pages(html, text):
    assert html_main.main_text(html) == text


def test_siblings_of_the_best_container():
    long = "Some words, and some more, " * 12
    html = f"<div><p>{long}</p><p>{long}</p></div><div><p>{long}</p></div><p>Short.</p><div><a href=x>{long}</a></div>"
    assert html_main.main_text(html) == "\n".join([long.strip()] * 3 + ["Short."])


def test_hostile_markup_is_linear():
    for html in ("<" * 100_000, "<div>" * 20_000, "<a b='" * 30_000, "<!--" * 50_000, "<p x=\"" * 30_000):
        html_main.main_text(html)


def test_frame(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>"), (2, None, None), (1, "u", "<p>a</p>")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.text) for r in html_main.extract(pages).collect())
    assert got == [(1, "a"), (1, "a"), (2, "")]
    assert html_main.extract(pages.limit(0)).count() == 0


def test_all_sections_of_pages_without_article():
    long, short = "<p>Some words, and some more, and yet more of them.</p>" * 10, "<p>" + "A short section of the same article, " * 3 + "</p>"
    menu = "<div><ul><li><a href=/a>One page</a></li><li><a href=/b>Other page</a></li></ul></div>"
    rest = f"<ul><li>First point</li></ul><table><tr><td>Cell</td></tr></table><blockquote>Said</blockquote>{menu}"
    for html in (
        f"<div><div>{long}</div><div>{short * 2}</div>{rest}</div>",
        f"<div><div><div>{long}</div></div><div><div>{short * 2}</div></div></div>{rest}",
    ):
        lines = html_main.main_text(html).split("\n")
        assert len(lines) == 15 and lines[10:] == [("A short section of the same article, " * 3).strip()] * 2 + ["First point", "Cell", "Said"]
    assert html_main.main_text(f"<body>Before, all by itself. <a href=/>x</a><div>{long}</div>After.</body>").split("\n")[::11] == ["Before, all by itself. x", "After."]


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>Let <math><semantics><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding='tex'>x=1</annotation></semantics></math> be.</p>", "Let x=1 be."),
        ("<p>a <object data=x>b</object> <canvas>c</canvas> <noscript>d</noscript></p>", "a b c d"),
        ("<div><p>a <button>b</p><p>c</p></div><p>d</p>", "a\nc\nd"), ("<div>a <select><option>b</div><p>c</p>", "a\nc"),
        ("<p>a <svg><text>b</text><p>c</p>", "a\nc"), ("<p>a <svg><g><svg>b</svg>c</svg> d</p>", "a d"),
        ("<p>a <button>b<div>c</div></button> d</p>", "a\nd"), ("<ul><li>a<template><li>b</li></template></li><li>c</li></ul>", "a\nc"),
        ("<article><p title='how a class=ad is hidden'>a</p><p data-x='role=form'>b</p><p title=\"style='display:none'\">c</p></article>", "a\nb\nc"),
        ("<article><p title='x' class=\"ad\">a</p><p HIDDEN>b</p><p Style='display: none'>c</p><p>d</p></article>", "d"),
        ("<html><head><title>t</title><body><p>a</p></body>", "a"), ("<article><p>a</p><script>b</p>", "a"),
    ],
)
def test_nothing_else_is_lost(html, text):
    assert html_main.main_text(html) == text


LONG = "Some words, and some more, and yet more of them, so that it counts."


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<article><p>{LONG}</p><section id='related-work'><p>Others did it.</p></section></article>", f"{LONG}\nOthers did it."),
        (f"<article><p>{LONG}</p><p class='market-share'>A third.</p></article>", f"{LONG}\nA third."),
        (f"<div class='print'><article><p>{LONG}</p></article></div>", LONG),
        (f"<div class='post-with-sidebar'><p>{LONG}</p></div>", LONG),
        (f"<article><p>{LONG}</p></article><article><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
        (f"<article><p>{LONG}</p></article><article class=comment><p>{LONG}</p></article>", LONG),
        (f"<article class='post tag-ads'><p>{LONG}</p></article>", LONG),
        (f"<p>{LONG}</p><div class='postComments'><p>{LONG}</p></div><div id=social-share-bar>Tell</div><div class='ad-slot top'>Buy</div>", LONG),
        (f"<p>{LONG}</p><div class='sidebar'><p>{LONG}</p></div><div class='cookie-notice-bar'><p>{LONG}</p></div>", LONG),
        (f"<html><head><title>t<body><p>{LONG}</p>", ""), (f"<html><head><meta charset=x><body><p>{LONG}</p>", LONG),
        (f"<article><p>{LONG}</p><button>x<p>After.</p></article>", f"{LONG}\nAfter."),
    ],
)
def test_names_are_judged_whole(html, text):
    assert html_main.main_text(html) == text


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<div class='layout-sidebar'><p>{LONG}</p><p>{LONG}</p></div><footer>f</footer>", f"{LONG}\n{LONG}"),
        (f"<div class='content-sidebar'><article><p>{LONG}</p></article><p>Side.</p></div>", LONG),
        (f"<div id='overlay'><h1>Title</h1><p>{LONG}</p></div><p>Imprint, all of it.</p>", f"Title\n{LONG}\nImprint, all of it."),
        (f"<article><h2 class='section-header'>One</h2><h2 class='header'>Two</h2><p>{LONG}</p></article>", f"One\nTwo\n{LONG}"),
        (f"<article><p>{LONG}</p><table><tr class='header'><td>Cell</td></tr></table><p class='related'>More.</p></article>", f"{LONG}\nCell\nMore."),
        (f"<article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article><article><p>Short.</p></article>", "\n".join([LONG] * 3 + ["Short."])),
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><div><p><a href=x>All of it is a link.</a></p><p>But this here is none.</p></div>", f"{LONG}\n{LONG}\nAll of it is a link.\nBut this here is none."),
        (f"<main><p>Short, but main.</p></main><article><p>{LONG}</p></article>", "Short, but main."),
        (f"<article>Re.</article><section class='comments'><p>{LONG}</p><p>{LONG}</p></section>", "Re."),
        (f"<p>{LONG}</p><div class='comments'><h1>Comments</h1><p>{LONG}</p><p>{LONG}</p></div>", LONG),
    ],
)
def test_names_are_held_against_the_text(html, text):
    assert html_main.main_text(html) == text


@pytest.mark.parametrize("seed", range(40))
def test_made_pages_with_names_from_outside_the_lists(seed):
    """Wrappers and headings named as sites name them, whatever words that takes; what is left out stands beside them."""
    rng = random.Random(seed)
    say = lambda: ", ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(3, 9))) for _ in range(rng.randrange(12, 30))) + "."
    wanted = [say() for _ in range(rng.randrange(4, 9))]
    shapes = ["<h2 class='block-header'>%s</h2>", "<p class='intro-teaser'>%s</p>", "<h3 id='alert'>%s</h3>", "<p class='notice-text'>%s</p>", "<p class='widget'>%s</p>", "<div class='elementor-12'><p>%s</p></div>", "<p>%s</p>"]
    inner = "".join(rng.choice(shapes) % x for x in wanted)
    wrap = rng.choice(["<div class='layout-sidebar'>%s</div>", "<div class='td-ss-main-sidebar'><article>%s</article></div>", "<div id='page-overlay'><div class='col-8'>%s</div></div>", "<div class='has-toolbar wp-block'>%s</div>", "<article class='c-story share'>%s</article>", "<section class='promo' id=x9><h1>%s</h1></section>"])
    body = wrap % inner if "<h1>" not in wrap else wrap.replace("%s", wanted[0]).replace("</h1>", "</h1>" + "".join(rng.choice(shapes) % x for x in wanted[1:]))
    page = f"<body><header><p>{say()}</p></header><nav>{say()}</nav><div class='comments'>{say()}</div>{body}<div class='cookie-bar'>{say()}</div><footer>{say()}</footer></body>"
    assert html_main.main_text(page) == "\n".join(wanted)


@pytest.mark.parametrize("seed", range(60))
def test_made_pages_against_what_was_put_in(seed):
    """Pages made of blocks that belong to the article and of what is left out, in many kinds of markup."""
    rng = random.Random(seed)
    say = lambda: ", ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(3, 9))) for _ in range(rng.randrange(8, 30))) + "."
    wanted = []

    def block():
        text = say()
        wanted.append(text)
        half = len(text) // 2
        shown = rng.choice([text, f"<b>{text[:half]}</b>{text[half:]}", f"<a href=/x>{text[:5]}</a>{text[5:]}", text.replace(" ", " \n ", 1), text.replace(",", "&#44;", 1)])
        return rng.choice(["<p>%s</p>", "<p class=lead>%s", "<h2>%s</h2>", "<blockquote>%s</blockquote>", "<ul><li>%s</li></ul>", "<div>%s</div>", "<section id=s1><p>%s</p></section>"]) % shown

    def noise():
        text = say()
        return rng.choice(
            ["<nav>%s</nav>", "<footer><p>%s</p></footer>", "<div class=ad>%s</div>", "<aside>%s</aside>", "<div id=comments><p>%s</p></div>",
             "<script>%s</script>", "<style>%s</style>", "<!-- %s -->", "<form><p>%s</p></form>", "<div role=navigation>%s</div>", "<div class='sidebar right'>%s</div>",
             "<div class='newsletter-box'><p>%s</p></div>", "<div hidden>%s</div>", "<svg><text>%s</text></svg>"]
        ) % text

    inner = "".join(block() + (noise() if rng.random() < 0.3 else "") for _ in range(rng.randrange(3, 9)))
    body = rng.choice(["<article>%s</article>", "<main>%s</main>", "<div class=content>%s</div>", "<div><div>%s</div></div>"]) % inner
    page = f"<!doctype html><html><head><title>{say()}</title></head><body>{noise()}{body}{noise()}</body></html>"
    assert html_main.main_text(page) == "\n".join(wanted)
