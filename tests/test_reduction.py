"""What a model is shown of a page."""

from keelson.operators import reduction
from keelson.sources.page_events import events_of


def lines(spark, html, url="https://a.com/docs/", **limits):
    rows = reduction.reduced(spark.createDataFrame([(1, url, html)], "page_id long, url string, html string"), **limits).orderBy("ordinal").collect()
    return [r.line for r in rows], any(r.truncated for r in rows)


def test_events_in_page_order():
    html = "<title>T &amp; t</title><!-- <a href=no>x</a> --><h2>A <a href='/x' title=tip>lab<b>el</b></a></h2><a href=1>one<a href=2>two<script src=s.js></script><script>var a = '<a href=3>';</script><div data-url=/s></div><meta name=n content=c>"
    assert [(e["kind"], e["text"], e["href"]) for e in events_of(html)] == [
        ("title", "T & t", None), ("link", "tip lab el", "/x"), ("heading", "A label", None), ("link", " one", "1"), ("script", "var a = '<a href=3>';", None), ("attribute", None, "/s"), ("tag_meta", "n c", None), ("link", " two", "2"),
    ]


def test_all_kinds_of_items(spark):
    html = """<title>My "API"</title><link rel=stylesheet href=swagger.css><link rel="alternate" type="application/json" href="/feed"><link rel=service-desc href=/d><meta name=description content="The OpenAPI page"><h1>Docs</h1><h1> </h1>
      <a href="/openapi.json">Spec</a><a href="/openapi.json">Spec</a><a href="#top">OpenAPI</a><a href="mailto:x">swagger</a><a href="/about">About us</a><redoc spec-url="v1/s.yaml"></redoc><script>x = 1; SwaggerUI({url: 'u'})</script>"""
    assert lines(spark, html) == ([
        "TITLE \"My 'API'\"", 'L1 TAG link rel="alternate" https://a.com/feed', 'L2 TAG link rel="service-desc" https://a.com/d', "TAG meta description The OpenAPI page", 'HEADING "Docs"', 'L3 LINK https://a.com/openapi.json "Spec"',
        "L4 ATTRIBUTE <redoc spec-url> https://a.com/docs/v1/s.yaml", "SCRIPT x = 1; SwaggerUI({url: 'u'})",
    ], False)


def test_specification_links_stay_first_and_the_page_ends_at_its_budget(spark):
    html = "".join(f"<a href='/guide/{k}'>guide</a>" for k in range(5)) + "<a href='/swagger'>x</a>"
    assert lines(spark, html, most_links=2) == (['L1 LINK https://a.com/guide/0 "guide"', 'L2 LINK https://a.com/swagger "x"'], True)
    first = len('L1 LINK https://a.com/guide/0 "guide"') + 1
    assert lines(spark, html, most_chars=2 * first) == (['L1 LINK https://a.com/guide/0 "guide"', 'L2 LINK https://a.com/guide/1 "guide"'], True)
    assert lines(spark, html, most_chars=2 * first - 1)[0] == ['L1 LINK https://a.com/guide/0 "guide"'] and len(lines(spark, html, most_items=3)[0]) == 3


def test_snippets_around_keywords_and_their_number(spark):
    far = "-" * 1000
    html = f"<script>{far}redoc{far}openapi{'.' * 300}swagger{far}</script>" + "".join(f"<script>redoc {k}</script>" for k in range(5)) + "<h3>a</h3>" * 3 + "".join(f"<h3>{k}</h3>" for k in range(9))
    found, _ = lines(spark, html)
    scripts = [x for x in found if x.startswith("SCRIPT")]
    assert len(scripts) == 4 and len(scripts[0]) == len("SCRIPT ") + 200 + 5 + 200 and scripts[1].endswith("…") and scripts[2:] == ["SCRIPT redoc 0", "SCRIPT redoc 1"]
    assert [x for x in found if x.startswith("HEADING")] == ['HEADING "a"', 'HEADING "0"', 'HEADING "1"', 'HEADING "2"']


def test_pages_without_anything(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<p>x</p>")], "page_id long, url string, html string")
    assert reduction.reduced(pages).count() == 0
