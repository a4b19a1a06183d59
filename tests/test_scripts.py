"""Literals in scripts, and what pages say through them."""

import pytest

from keelson.operators import pages
from keelson.sources.scripts import NotLiteral, configured, object_at


def members(text):
    return object_at(text, 0)


@pytest.mark.parametrize(
    "text, found",
    [
        ("{url: '/a.json', dom_id: \"#x\"}", {"url": ("text", "/a.json"), "dom_id": ("text", "#x")}),
        ("{ /* { */ 'url' : \"/a\\\"b\" , // don't }\n b: {c: {d: {e: [1, ')']}}}, f(x) { return {} }, g }", {"url": ("text", '/a"b'), "b": ("raw", "{c: {d: {e: [1, ')']}}}"), "f": ("raw", "(x) { return {} }"), "g": ("raw", "")}),
        ("{urls: [{url: '/1', name: 'a'}, {\"url\": '/2'},], x: `t {`}", {"urls": ("texts", ["/1", "/2"]), "x": ("raw", "`t {`")}),
        ("{url: BASE + '/a', urls: f([])}", {"url": ("raw", "BASE + '/a'"), "urls": ("raw", "f([])")}),
        ("{url: '/a' + b}", {"url": ("raw", "'/a' + b")}), ("{}", {}), ("{url: '/1', url: '/2'}", {"url": ("text", "/2")}), ("{urls: []}", {"urls": ("texts", [])}),
    ],
)
def test_members_of_an_object(text, found):
    assert members(text) == found


@pytest.mark.parametrize("text", ["cfg)", "{url: '/x'", "{...rest}", "{a: `${b}`}", "{a: 'x\ny'}", "{a: '\\n'}", "{a: (]}", "{a: /* }", "{urls: [x]}", "{urls: [{name: 'a'}]}", "{urls: [{url: u}]}", "{1: 2}", ""])
def test_what_isnt_literal(text):
    with pytest.raises(NotLiteral):
        members(text)


def test_calls_in_order_and_bounded():
    rows = configured("SwaggerUI({url: '/s'});" * 25 + "Redoc.init( /* c */ '/r', {}); Redoc.init(u)")
    assert sum(r["kind"] == "call" for r in rows) == 20 and rows[40]["kind"] == "unread"
    assert [(r["kind"], r["value"]) for r in rows if r["viewer"] == "redoc"] == [("text", "/r"), ("raw", None)]


@pytest.mark.parametrize("piece", ["SwaggerUI({a:", "SwaggerUI({'", "/*", "[{(", "SwaggerUI({urls:[{url:'x'},", "'\\", "`$"])
def test_hostile_scripts_are_read_in_linear_time(piece):
    configured(piece * 20_000)


def rows_of(found):
    return sorted(tuple(r)[1:] for r in found.collect())


def viewed(spark, html):
    return [(m, r) for m, r in sorted(((r.mechanism, r.reference) for r in pages.viewer_references(spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string")).collect()), key=str)]


@pytest.mark.parametrize(
    "code, found",
    [
        ("SwaggerUIBundle({url: '/a.json', x: {y: {z: {}}}})", [("swagger_ui_config", "/a.json")]),
        ("SwaggerUIBundle({ // don't\n url: '/a.json'})", [("swagger_ui_config", "/a.json")]),
        ("SwaggerUIBundle({url: '/a.json', t: `no ${''[0]}`})".replace("${''[0]}", ""), [("swagger_ui_config", "/a.json")]),
        ("SwaggerUIBundle({spec: {\"openapi\": \"3.0.3\"}})", [("embedded_spec", '{"openapi": "3.0.3"}')]), ("SwaggerUIBundle({spec: {openapi: v}})", [("spec_not_literal", None)]),
        ("SwaggerUI({url: f()}); SwaggerUI({configUrl: w}); SwaggerUI({dom_id: '#x'}); SwaggerUI(c)", [("configUrl_not_literal", None), ("configuration_not_literal", None), ("no_literal_source", None), ("url_not_literal", None)]),
        ("SwaggerUI({queryConfigEnabled: true, url: '/x'})", [("query_config_enabled", None), ("swagger_ui_config", "/x")]), ("SwaggerUI({queryConfigEnabled: false, url: '/x'})", [("swagger_ui_config", "/x")]),
        ("var SwaggerUIBundleX = 1; f('/openapi.json', \"swagger.json\", '//c/openapi.json', '${b}/openapi.json', `a=https://a.io/api/spec.yaml?v=1`, '/v3/api-docs')", [("script_literal", "/openapi.json"), ("script_literal", "/v3/api-docs"), ("script_literal", "https://a.io/api/spec.yaml?v=1")]),
    ],
)
def test_what_viewers_are_configured_to_show(spark, code, found):
    assert viewed(spark, f"<script>{code}</script>") == sorted(found, key=str)


def test_comments_are_no_part_of_a_page(spark):
    html = "<!-- <script>SwaggerUI({url: '/no.json'})</script> --><script>/* <!-- */ SwaggerUI({url: '/yes.json'}) // --></script><!-- <title>no</title><a href=/no>x</a><link rel=service-doc href=/no> --><title>yes</title>"
    assert viewed(spark, html) == [("swagger_ui_config", "/yes.json")]
    page = spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string")
    assert pages.typed_links(page).count() == 0
    (found,) = pages.anatomy(page).collect()
    assert (found.title, found.anchors, len(found.inline_scripts)) == ("yes", [], 1)


@pytest.mark.parametrize(
    "content, found",
    [
        ('{"urls": [{"url": "/1"}, {"name": "x"}, "junk", {"url": " "}, {"url": 3}], "spec": "x"}', [("spec_not_an_object", None), ("swagger_config_url_entry", "/1"), ("urls_entry_invalid", None)]),
        ('﻿{"url": "/o.json", "spec": {"openapi": "3.1.0"}}', [("embedded_spec", '{"openapi":"3.1.0"}'), ("swagger_config_url_entry", "/o.json")]),
        ('{"urls": "x"}', [("urls_not_a_list", None)]), ("", []), ("[]", []), ("{}", []), ('{"theme": "dark"}', []), ("null", []), ("not json", []), ('{"url": 5}', []),
    ],
)
def test_json_behind_a_configuration(spark, content, found):
    rows = pages.config_references(spark.createDataFrame([(1, content)], "page_id long, content string")).collect()
    assert sorted(((r.mechanism, r.reference) for r in rows), key=str) == sorted(found, key=str)


def test_modules_of_apidoc(spark):
    rows = [(1, "https://x.test/doc/js/main.js", "define(['api_data', './api_project.js', 'jquery'])"), (2, "https://x.test/m.js", "var api_data = 1; require(['https://evil/x.js'])")]
    found = pages.apidoc_modules(spark.createDataFrame(rows, "page_id long, script_url string, code string")).collect()
    assert sorted(r.url for r in found) == ["https://x.test/doc/js/./api_project.js", "https://x.test/doc/js/api_data.js"]
