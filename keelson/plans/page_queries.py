"""Links, hosts and URLs of the pages table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import text
from keelson.operators import discovery, links, matching, pages, reduction, search, targets
from keelson.plans.registry import query, table


#: The form that every anchor of the test pages has; the SQL knows no other, and scores the whole href, which is a path there.
PLAIN_LINK = r'<a href="([^"]*)"[^>]*>([^<]*)</a>'


def _score_sql() -> str:
    cases = " + ".join(f"CASE WHEN regexp_matches(said, '{p}') THEN {w} ELSE 0 END" for p, w in links.KEYWORDS)
    return f"""CASE WHEN regexp_matches(lower(href), '{links.ASSET}') OR regexp_matches(said, '{links.NEGATIVE}') THEN 0
      ELSE least({cases}, {links.HIGHEST}) END"""


_LINKS = f"""
a AS (SELECT page_id, regexp_extract_all(html, '{PLAIN_LINK}', 1) AS hrefs, regexp_extract_all(html, '{PLAIN_LINK}', 2) AS labels FROM pages),
l AS (SELECT page_id, i AS pos, hrefs[i + 1] AS href, labels[i + 1] AS label, lower(hrefs[i + 1] || ' ' || labels[i + 1]) AS said
      FROM (SELECT *, unnest(range(len(hrefs))) AS i FROM a)),
s AS (SELECT *, {_score_sql()} AS score FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rank FROM s)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.links_of(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("score", links.score(F.col("url"), F.col("label"))).drop("url")


@query("f10_link_scores", f"WITH {_LINKS} SELECT page_id, pos::BIGINT AS pos, href, score::BIGINT AS score FROM s")
def f10_link_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("page_id", F.col("pos").cast("long").alias("pos"), "href", F.col("score").cast("long").alias("score"))


@query("l5_best_links_of_pages", f"WITH {_LINKS} SELECT page_id, rank::BIGINT AS rank, href FROM r WHERE rank <= 6")
def l5_best_links_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.best_of_page(scored(spark, sf_dir)).select("page_id", F.col("rank").cast("long").alias("rank"), "href")


@query(
    "l6_links_within_budget",
    f"""WITH {_LINKS}, u AS (SELECT *, sum(length(href) + length(label) + 1) OVER (PARTITION BY page_id ORDER BY rank) AS used FROM r)
        SELECT page_id, 'L' || rank::VARCHAR AS shown_id, used::BIGINT AS used FROM u WHERE rank <= 30 AND used <= 60""",
)
def l6_links_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = links.best_of_page(scored(spark, sf_dir), most=30)
    return links.within_budget(ranked, 30, 60).select("page_id", "shown_id", F.col("used").cast("long").alias("used"))


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query(
    "f1_host_relations",
    f"""WITH h AS (SELECT DISTINCT {_HOST} AS host FROM pages), s(server) AS (VALUES ('example.com'), ('net'), ('api.example.org'), ('example.net'))
        SELECT host, server, CASE WHEN host = server THEN 'same' WHEN ends_with(host, '.' || server) THEN 'target_under_server'
        ELSE 'server_under_target' END AS relation FROM h, s
        WHERE server <> 'net' AND (host = server OR ends_with(host, '.' || server) OR ends_with(server, '.' || host))""",
)
def f1_host_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which hosts of pages relate to a few servers: equi-joins on host suffixes both ways, no host meets every server."""
    hosts = table(spark, sf_dir, "pages").select(matching.normal_host(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)).alias("host")).distinct()
    servers = spark.createDataFrame([("example.com",), ("net",), ("api.example.org",), ("example.net",)], "server string")
    below = hosts.withColumn("key", F.explode(matching.host_suffixes(F.col("host")))).join(servers.withColumn("key", F.col("server")), "key")
    above = hosts.withColumn("key", F.col("host")).join(servers.withColumn("key", F.explode(matching.host_suffixes(F.col("server")))), "key")
    pairs = below.select("host", "server").unionByName(above.select("host", "server")).distinct()
    return pairs.withColumn("relation", matching.host_relation(F.col("host"), F.col("server"))).where("relation IS NOT NULL")


@query(
    "s17_provider_keys",
    f"""WITH h AS (SELECT DISTINCT string_split({_HOST}, '.') AS l FROM pages),
        k AS (SELECT array_to_string(l, '.') AS host, i, array_to_string(list_slice(l, i, len(l)), '.') AS key FROM (SELECT l, unnest(range(1, len(l) + 1)) AS i FROM h))
        SELECT host, i AS rank, key FROM k WHERE key NOT IN ('com', 'net', 'org') AND i <= 4""",
)
def s17_provider_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names under which each host would be looked up, most specific first."""
    hosts = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host")).distinct()
    return hosts.select("host", F.posexplode(matching.provider_keys(F.col("host"))).alias("pos", "key")).select(
        "host", (F.col("pos") + 1).cast("long").alias("rank"), "key"
    )


@query(
    "s13_common_locations",
    f"""SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]*') || p AS candidate FROM pages,
        (VALUES ('/openapi.json'), ('/openapi.yaml'), ('/swagger.json')) c(p)""",
)
def s13_common_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usual places of a contract below each origin."""
    origins = table(spark, sf_dir, "pages").select(search.origin(F.col("url")).alias("origin")).distinct()
    return search.common_locations(origins).select("candidate")


@query(
    "s14_spec_like_urls",
    """SELECT page_id, page_id % 5 IN (0, 1, 2) AS spec_like FROM pages""",
)
def s14_spec_like_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs whose path ends as a contract's file does: each page's with one of five endings."""
    endings = ("x.JSON?v=1", "x.yaml#top", "x.yml", "x.html?f=x.json", "xjson")
    url = F.concat(search.origin(F.col("url")), F.lit("/"), F.get(F.array(*map(F.lit, endings)), (F.col("page_id") % 5).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", search.looks_like_contract(url).alias("spec_like"))


@query(
    "j15_operations_of_paths",
    """WITH p AS (SELECT page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages)
       SELECT page_id, template FROM p, (VALUES ('/{lang}/{id}', '^/[^/]+/[^/]+$'), ('/en/{id}.html', '^/en/[^/]+\\.html$'), ('/fr/{id}/', '^/fr/[^/]+/$')) t(template, pattern)
       WHERE regexp_matches(path, pattern)""",
)
def j15_operations_of_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("request_id"), F.lit(None).cast("string").alias("method"), F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("path")
    )
    operations = spark.createDataFrame([("GET", "/{lang}/{id}"), ("GET", "/en/{id}.html"), ("GET", "/fr/{id}/")], "method string, template string")
    return matching.find_operations(requests, operations).select(F.col("request_id").alias("page_id"), "template")


@query(
    "a8_barriers_of_hosts",
    f"""SELECT host, status, arg_min(url, page_id) AS first_url, count(*) - 1 AS others FROM
        (SELECT page_id, url, {_HOST} AS host, CASE page_id % 4 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 200 ELSE 404 END AS status FROM pages) WHERE status IN (401, 403) GROUP BY 1, 2""",
)
def a8_barriers_of_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page was tried and got one of four answers; one finding for each host and status that asked for authentication."""
    n = F.col("page_id") % 4
    status = F.when(n == 0, 401).when(n == 1, 403).when(n == 2, 200).otherwise(404)
    attempts = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("seq"), "url", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), status.alias("status")
    )
    return search.collapsed_barriers(attempts)


@query(
    "a12_search_status",
    f"""WITH c AS (SELECT {_HOST} AS host, count_if(page_id % 7 = 0) AS accepted, count_if(page_id % 14 = 0) AS confirmed,
        count_if(page_id % 5 = 1) AS rejected, count_if(page_id % 5 = 2) AS inaccessible FROM pages GROUP BY 1)
        SELECT host, CASE WHEN accepted > 1 THEN 'ambiguous' WHEN accepted = 1 AND confirmed = 1 THEN 'validated' WHEN accepted = 1 THEN 'unconfirmed'
        WHEN rejected > 0 THEN 'rejected' WHEN inaccessible > 0 THEN 'inaccessible' ELSE 'not_found' END AS status FROM c""",
)
def a12_search_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    counts = table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host")).agg(
        F.count_if(page % 7 == 0).alias("accepted"), F.count_if(page % 14 == 0).alias("confirmed"),
        F.count_if(page % 5 == 1).alias("rejected"), F.count_if(page % 5 == 2).alias("inaccessible"),
    )
    return counts.select("host", matching.status(*(F.col(c) for c in ("accepted", "confirmed", "rejected", "inaccessible"))).alias("status"))


@query(
    "x10_decoded_segments",
    "SELECT page_id, replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/', '|') || '|a b+' || page_id || '/c|é|%zz' AS segments FROM pages",
)
def x10_decoded_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escapes decoded a segment at a time: a space, a slash and a letter; a plus stays, a bad escape too."""
    path = F.concat(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), F.lit("/a%20b+"), "page_id", F.lit("%2Fc/%C3%A9/%zz"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(text.decoded_segments(path), "|").alias("segments"))


@query(
    "p3_normal_targets",
    """SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host,
       CASE WHEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '://[^/?#]*([^?#]*)', 1) END AS path,
       CASE WHEN contains(url, '#') THEN 'fragment' END AS problem FROM pages""",
)
def p3_normal_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = targets.normal_target(F.col("url"))
    found = table(spark, sf_dir, "pages").select("page_id", target.alias("t"))
    return found.select("page_id", "t.scheme", "t.host", "t.path", "t.problem")


@query(
    "a16_coverage_of_searches",
    f"""SELECT {_HOST} AS request, count_if(page_id % 6 <> 5) AS examined, count_if(page_id % 6 = 5) AS unexamined,
        coalesce(string_agg(DISTINCT CASE WHEN page_id % 6 = 5 THEN CASE WHEN page_id % 4 = 1 THEN 'time' ELSE 'bytes' END END, ','
        ORDER BY CASE WHEN page_id % 6 = 5 THEN CASE WHEN page_id % 4 = 1 THEN 'time' ELSE 'bytes' END END), '') AS limits FROM pages GROUP BY 1""",
)
def a16_coverage_of_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    ended = F.col("page_id") % 6 == 5
    attempts = table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("request"), "url", F.when(ended, "budget_exhausted").otherwise("retrieved").alias("outcome"),
        F.when(ended, F.when(F.col("page_id") % 4 == 1, "time").otherwise("bytes")).alias("limit"),
    )
    return discovery.coverage(attempts).withColumn("limits", F.array_join("limits", ","))


@query(
    "j18_suggested_links",
    f"""WITH {_LINKS}, g AS (SELECT page_id, 'L' || (page_id % 9 + 1)::VARCHAR AS shown_id FROM pages)
        SELECT g.page_id, shown_id, r.page_id IS NOT NULL AS known FROM g LEFT JOIN r ON r.page_id = g.page_id AND 'L' || r.rank::VARCHAR = shown_id AND r.rank <= 6""",
)
def j18_suggested_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One suggestion for each page: was that link shown?"""
    shown = links.best_of_page(scored(spark, sf_dir)).select("page_id", F.concat(F.lit("L"), "rank").alias("shown_id"))
    suggested = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("L"), F.col("page_id") % 9 + 1).alias("shown_id"))
    known, unknown = discovery.known_suggestions(suggested, shown)
    return known.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False)))


@query(
    "p22_server_expansions",
    """WITH t AS (SELECT DISTINCT regexp_extract(url, '://[^.]*\\.(.*?)/', 1) AS contract FROM pages WHERE regexp_extract(url, '://[^.]*\\.(.*?)/', 1) <> '')
       SELECT contract, 'https://' || r || '.' || contract || '/' || v AS server FROM t, (VALUES ('eu'), ('us')) a(r), (VALUES ('v1'), ('v2')) b(v)""",
)
def p22_server_expansions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Server templates with two variables of two values each, filled in."""
    contract = F.regexp_extract("url", r"://[^.]*\.(.*?)/", 1)
    names = F.create_map(F.lit("r"), F.array(F.lit("eu"), F.lit("us")), F.lit("v"), F.array(F.lit("v1"), F.lit("v2"), F.lit("v1")))
    servers = table(spark, sf_dir, "pages").select(contract.alias("contract")).where("contract <> ''").distinct()
    servers = servers.select("contract", F.concat(F.lit("https://{r}."), "contract", F.lit("/{v}")).alias("url"), names.alias("variables"))
    return discovery.expanded_servers(servers).select("contract", "server")


_MADE = """concat(html, '<base href="https://docs.example/v', page_id % 3, '/">', '<link rel="Service-Desc next" href="openapi/', page_id, '.json" type="application/json">',
  '<a rel=service-doc href=/guide title="The guide">g</a>', '<redoc spec-url="/spec/', page_id, '.yaml"></redoc>', '<h2>API ', page_id, '</h2>', '<script src="swagger-init.js" data-main="js/main"></script>',
  '<script>const ui = SwaggerUIBundle({ url: "/swagger/', page_id, '.json", dom_id: "#x" }); load("/files/api-docs.json?x=', page_id, '", "/files/app.js");</script>',
  '<script>Redoc.init(''https://docs.example/redoc.yaml''); SwaggerUI({ urls: [{ url: "/a.json", name: "a" }, { "url": "/b.json" }], configUrl: "/cfg" }); SwaggerUI(cfg)</script>')"""


def made_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with what pages of documentation have put behind it."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.expr(_MADE).alias("html"))


@query(
    "p17_typed_links",
    """SELECT page_id, 'https://docs.example/v' || page_id % 3 || '/openapi/' || page_id || '.json' AS url, 'service-desc' AS rel, 'application/json' AS type, NULL::VARCHAR AS title FROM pages
       UNION ALL SELECT page_id, 'https://docs.example/guide', 'service-doc', NULL, 'The guide' FROM pages""",
)
def p17_typed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.typed_links(made_pages(spark, sf_dir)).select("page_id", "url", "rel", "type", "title")


@query(
    "p17_link_headers",
    """SELECT page_id, 'https://h.example/a,' || page_id AS url, 'service-desc' AS rel, 'x;y' AS type, NULL::VARCHAR AS title FROM pages
       UNION ALL SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || '/doc', 'service-doc', NULL, 'T, u' FROM pages
       UNION ALL SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || '/doc', 'api-catalog', NULL, 'T, u' FROM pages""",
)
def p17_link_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link headers with commas and semicolons inside addresses and quotes, and a relation of no interest."""
    header = F.concat(F.lit('<https://h.example/a,'), "page_id", F.lit('>; rel=service-desc; type="x;y", </doc>; title="T, u"; rel="service-doc api-catalog", <x>; rel=next'))
    found = pages.header_links(table(spark, sf_dir, "pages").select("page_id", "url", header.alias("header")))
    return found.select("page_id", "url", "rel", "type", "title")


@query(
    "p18_page_anatomy",
    """SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, len(regexp_extract_all(html, '<h[1-3]>')) + 1 AS headings, len(regexp_extract_all(html, '<a href')) + 1 AS anchors,
       'https://docs.example/v' || page_id % 3 || '/swagger-init.js' AS script, 'https://docs.example/v' || page_id % 3 || '/js/main.js' AS data_main,
       len(regexp_extract_all(html, '<script>')) + 2 AS inline_scripts, 'https://docs.example/spec/' || page_id || '.yaml' AS spec_attribute FROM pages""",
)
def p18_page_anatomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.anatomy(made_pages(spark, sf_dir))
    count = lambda c: F.size(c).cast("long").alias(c)
    one = lambda c, name: F.array_join(c, " ").alias(name)
    return found.select(
        "page_id", "title", count("headings"), count("anchors"), one("scripts", "script"), one("data_main", "data_main"), count("inline_scripts"), one("spec_attributes", "spec_attribute")
    )


@query(
    "p16_viewer_configurations",
    """SELECT page_id, mechanism, replace(reference, '@', page_id::VARCHAR) AS reference FROM pages, (VALUES ('swagger_ui_config', '/swagger/@.json'), ('swagger_ui_config', '/a.json'), ('swagger_ui_config', '/b.json'),
       ('redoc_config', 'https://docs.example/redoc.yaml'), ('config_url', '/cfg'), ('configuration_not_literal', NULL), ('script_literal', '/files/api-docs.json?x=@')) v(mechanism, reference)""",
)
def p16_viewer_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What viewers of contracts are configured to show, and addresses in scripts that look like contracts."""
    return pages.viewer_references(made_pages(spark, sf_dir)).select("page_id", "mechanism", "reference")


# Scripts whose literals come from each page's own address and title.
_SCRIPTED = """concat('<!-- <script>SwaggerUI({ url: "/commented/', page_id, '.json" })</script> -->',
  '<script>SwaggerUIBundle({ url: "', url, '/deep.json", plugins: { a: { b: { c: ["}", page_', page_id, '] } } } })</script>',
  '<script>SwaggerUI({ // don\\'t stop here
    "url": \\'', url, '/quoted.json\\', t: `', page_id, ' {` })</script>',
  '<script>SwaggerUI({ spec: {"openapi": "3.0.', page_id % 4, '", "info": {"title": "', host, '"}}, configUrl: "', url, '/cfg" }); SwaggerUI({ url: `${', host_name, '}/x.json` })</script>',
  '<script>SwaggerUI({ url: "', url, '/" + version, dom_id: "#', page_id, '" }); load("/files/', host_name, '-openapi.yaml", "//cdn/openapi.json", "/', host_name, '.css")</script>')"""
_SCRIPTED_SQL = """SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS host, replace(regexp_extract(url, '://([^/?#]*)', 1), '.', '_') AS host_name FROM pages"""


@query(
    "p16_script_literals",
    f"""WITH p AS ({_SCRIPTED_SQL})
    SELECT page_id, 'swagger_ui_config' AS mechanism, url || '/deep.json' AS reference FROM p UNION ALL SELECT page_id, 'swagger_ui_config', url || '/quoted.json' FROM p
    UNION ALL SELECT page_id, 'embedded_spec', '{{"openapi": "3.0.' || page_id % 4 || '", "info": {{"title": "' || host || '"}}}}' FROM p UNION ALL SELECT page_id, 'config_url', url || '/cfg' FROM p
    UNION ALL SELECT page_id, 'configuration_not_literal', NULL FROM p UNION ALL SELECT page_id, 'url_not_literal', NULL FROM p
    UNION ALL SELECT page_id, 'script_literal', '/files/' || host_name || '-openapi.yaml' FROM p""",
)
def p16_script_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested braces, comments with apostrophes, templates, embedded contracts and dynamic values; nothing in HTML comments."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    scripted = table(spark, sf_dir, "pages").withColumns({"host": host, "host_name": F.replace(host, F.lit("."), F.lit("_"))})
    found = pages.viewer_references(scripted.select("page_id", "url", F.expr(_SCRIPTED).alias("html")))
    return found.select("page_id", "mechanism", "reference")


@query(
    "p18_configurations_served",
    """SELECT page_id, 'swagger_config_url_entry' AS mechanism, url || '/v' || k AS reference FROM pages, (VALUES (1), (2)) v(k) UNION ALL SELECT page_id, 'urls_entry_invalid', NULL FROM pages
       UNION ALL SELECT page_id, 'embedded_spec', '{"openapi":"3.1.' || page_id % 5 || '"}' FROM pages WHERE url LIKE 'https:%' UNION ALL SELECT page_id, 'spec_not_an_object', NULL FROM pages WHERE url NOT LIKE 'https:%'""",
)
def p18_configurations_served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON that each page's configUrl would serve: entries of its address, one without, and a contract inside or none."""
    entry = lambda k: F.named_struct(F.lit("url"), F.concat("url", F.lit(f"/v{k}")), F.lit("name"), F.col("page_id").cast("string"))
    spec = F.when(F.startswith("url", F.lit("https:")), F.concat(F.lit('{"openapi":"3.1.'), F.col("page_id") % 5, F.lit('"}'))).otherwise(F.to_json(F.array("url")))
    listed = F.array(entry(1), entry(2), F.named_struct(F.lit("url"), F.lit(None).cast("string"), F.lit("name"), F.col("url")), entry(1))
    content = F.concat(F.lit('{"urls": '), F.to_json(listed), F.lit(', "spec": '), spec, F.lit("}"))
    return pages.config_references(table(spark, sf_dir, "pages").select("page_id", content.alias("content"))).select("page_id", "mechanism", "reference")


def _refused(made: str, problem: str) -> tuple[str, ...]:
    return (made, "NULL", "NULL", "NULL", "NULL", f"'{problem}'")


#: Forms of a target, made of each page's own host and number: how it is made, then scheme, host, port, path and problem, all in SQL.
_FORMS = (
    ("'  ' || host || ' '", "'https'", "host", "NULL", "'/'", "NULL"), ("host || ':' || port", "'https'", "host", "port", "'/'", "NULL"),
    ("'HTTP://' || upper(host) || ':' || port || '/p?q=1'", "'http'", "host", "port", "'/p'", "NULL"),
    ("'http://[2001:DB8:0:0:0:0:0:' || printf('%X', port) || ']/a'", "'http'", "'2001:db8::' || printf('%x', port)", "NULL", "'/a'", "NULL"),
    ("'http://[::ffff:10.0.0.' || port % 256 || ']:81'", "'http'", "'::ffff:10.0.0.' || port % 256", "81", "'/'", "NULL"),
    ("'http://bücher.' || host", "'http'", "'xn--bcher-kva.' || host", "NULL", "'/'", "NULL"), ("'10.1.2.' || port % 256", "'https'", "'10.1.2.' || port % 256", "NULL", "'/'", "NULL"),
    _refused("host || '/x'", "no_scheme"), _refused("'http://' || host || ':' || (port + 65535)", "port"), _refused("'http://' || host || ':'", "port"), _refused("'http://' || host || ':0'", "port"),
    _refused("'ftp://' || host", "scheme"), _refused("'http://u@' || host", "credentials"), _refused("'http://' || host || '/#f'", "fragment"), _refused("'http://a b.' || host", "control_characters"),
    _refused("'http://-a.' || host", "host"), _refused("'http://[1:2:3:4:5:6:' || port % 7 || ']'", "host"),
)
_FORM_HOSTS = "SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, CAST(1 + page_id % 65000 AS INT) AS port FROM pages"


@query(
    "p3_targets_of_all_forms",
    f"""SELECT page_id, target, scheme, p2.host AS host, p2.port::INT AS port, path, problem FROM ({_FORM_HOSTS}) p, (VALUES {", ".join(f"({chr(44).join(form)})" for form in _FORMS)}) p2(target, scheme, host, port, path, problem)""",
)
def p3_targets_of_all_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare hosts, ports, addresses and names in other scripts, made of each page's own host and number, and what is refused."""
    hosts = table(spark, sf_dir, "pages").selectExpr("page_id", "lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host", "CAST(1 + page_id % 65000 AS INT) AS port")
    asked = hosts.select("page_id", F.explode(F.array(*(F.expr(form[0]) for form in _FORMS))).alias("target"))
    found = asked.select("page_id", "target", targets.normal_target(F.col("target")).alias("t"))
    fine = F.col("t.problem").isNull()
    return found.select("page_id", "target", *(F.when(fine, F.col(f"t.{c}")).alias(c) for c in ("scheme", "host", "port", "path")), "t.problem")


#: Rules as a public suffix list has them; a longer list is passed where one is at hand.
SUFFIX_RULES = ("com", "org", "net", "io", "uk", "co.uk", "*.ck", "!www.ck", "jp", "*.kobe.jp", "!city.kobe.jp", "github.io", "*.compute.example.com")
_TENANTS = """SELECT DISTINCT host FROM (SELECT unnest([h, 'a.b.' || h, n || '.co.uk', 'x.' || n || '.co.uk', n || '.ck', 'y.' || n || '.ck', 'www.ck', 'z' || page_id % 7 || '.www.ck', n || '.kobe.jp', 't.' || n || '.kobe.jp',
   'p' || page_id % 5 || '.city.kobe.jp', n || '.github.io', n || '.unlisted', 'q.' || n || '.unlisted', 'r.' || n || '.compute.example.com', '10.0.0.' || page_id % 9]) AS host
   FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS h, split_part(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '.', 1) || page_id % 11 AS n FROM pages))"""
_RULES_SQL = rf"""
rules AS (SELECT regexp_replace(rule, '^(!|\*\.)', '') AS key, rule LIKE '!%' AS excepts, rule LIKE '*.%' AS wild FROM (VALUES {", ".join(f"('{r}')" for r in SUFFIX_RULES)}) v(rule)),
t AS ({_TENANTS}), l AS (SELECT host, string_split(host, '.') AS ls FROM t),
m AS (SELECT host, ls, len(string_split(key, '.')) + CASE WHEN wild THEN 1 WHEN excepts THEN -1 ELSE 0 END AS size, excepts FROM l JOIN rules ON host = key OR ends_with(host, '.' || key)),
d AS (SELECT l.host, l.ls, coalesce(max(size) FILTER (excepts), max(size) FILTER (NOT excepts AND size <= len(l.ls)), 1) AS n FROM l LEFT JOIN m USING (host) GROUP BY ALL),
s AS (SELECT host, CASE WHEN NOT regexp_matches(host, '^[0-9.]+$') THEN array_to_string(ls[-n:], '.') END AS suffix, CASE WHEN NOT regexp_matches(host, '^[0-9.]+$') AND len(ls) > n THEN array_to_string(ls[-n - 1:], '.') END AS domain FROM d)"""


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts under shared and own domains, made of the pages' hosts."""
    h = "lower(regexp_extract(url, '://([^/?#:]*)', 1))"
    made = table(spark, sf_dir, "pages").selectExpr("page_id", f"{h} AS h", f"split_part({h}, '.', 1) || page_id % 11 AS n")
    listed = _TENANTS[_TENANTS.index("unnest([") + 8 : _TENANTS.index("]) AS host")]
    return made.select(F.explode(F.expr(f"array({listed})")).alias("host")).distinct()


@query("f12_registrable_domains", f"WITH {_RULES_SQL} SELECT host, suffix, domain FROM s")
def f12_registrable_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be registered of every host, by rules with wildcards and exceptions."""
    rules = targets.suffix_rules(spark.createDataFrame([(r,) for r in SUFFIX_RULES], "rule string"))
    return targets.registrable_domains(tenants(spark, sf_dir), rules)


@query(
    "f1_relations_by_rules",
    f"""WITH {_RULES_SQL}, p AS (SELECT host AS target, CASE WHEN len(string_split(host, '.')) > 2 THEN array_to_string(string_split(host, '.')[2:], '.') ELSE host END AS server FROM t)
        SELECT target, server, CASE WHEN target = server THEN 'same' WHEN ends_with(target, '.' || server) AND NOT regexp_matches(target, '^[0-9.]+$') AND (SELECT domain IS NOT NULL FROM
        (SELECT CASE WHEN len(string_split(server, '.')) > coalesce(max(size) FILTER (excepts), max(size) FILTER (NOT excepts AND size <= len(string_split(server, '.'))), 1) THEN server END AS domain
         FROM (SELECT len(string_split(key, '.')) + CASE WHEN wild THEN 1 WHEN excepts THEN -1 ELSE 0 END AS size, excepts FROM rules WHERE server = key OR ends_with(server, '.' || key)))) THEN 'target_under_server' END AS relation FROM p""",
)
def f1_relations_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each host against the one above it: tenants of a shared suffix aren't related through it."""
    above = F.when(F.size(F.split("host", r"\.")) > 2, F.regexp_replace("host", r"^[^.]*\.", "")).otherwise(F.col("host"))
    rules = targets.suffix_rules(spark.createDataFrame([(r,) for r in SUFFIX_RULES], "rule string"))
    return targets.host_relations(tenants(spark, sf_dir).select(F.col("host").alias("target"), above.alias("server")), rules)


_SHOWN = """concat('<base href="https://docs.example/b', page_id % 4, '/"><title>Page ', page_id, ' of ', host, '</title><h1>', host, '</h1><h2>API "', page_id, '"</h2><!-- <a href="/swagger">no</a> --><a href="/openapi/', page_id, '.json">Spec ', page_id,
  '</a><a href="#openapi">here</a><a href="guide/', page_id % 5, '" title="The">Guide</a><a href="guide/', page_id % 5, '" title="The">Guide</a><link rel="service-desc" href="desc-', page_id, '"><link rel="icon" href="swagger.ico"><meta name="about" content="swagger of ', host,
  '"><redoc spec-url="/v', page_id % 3, '/s.yaml"></redoc><script>ui(', page_id, ', "redoc")</script><p>', host, '</p>')"""


@query(
    "p20_reduced_pages",
    """WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages),
       i AS (SELECT page_id, unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS ordinal, unnest(['title', 'heading', 'heading', 'link', 'link', 'tag', 'tag', 'attribute', 'script']) AS kind,
         unnest(['TITLE "Page ' || page_id || ' of ' || host || '"', 'HEADING "' || host || '"', 'HEADING "API ''' || page_id || '''"', 'LINK https://docs.example/openapi/' || page_id || '.json "Spec ' || page_id || '"',
           'LINK https://docs.example/b' || page_id % 4 || '/guide/' || page_id % 5 || ' "The Guide"', 'TAG link rel="service-desc" https://docs.example/b' || page_id % 4 || '/desc-' || page_id, 'TAG meta about swagger of ' || host,
           'ATTRIBUTE <redoc spec-url> https://docs.example/v' || page_id % 3 || '/s.yaml', 'SCRIPT ui(' || page_id || ', ''redoc'')']) AS line,
         unnest([NULL, NULL, NULL, 'L1', 'L2', 'L3', NULL, 'L4', NULL]) AS shown_id FROM p)
       SELECT page_id, ordinal::BIGINT AS ordinal, kind, concat_ws(' ', shown_id, line) AS line, shown_id FROM i""",
)
def p20_reduced_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is shown of each page: lines of all kinds in page order, numbered where they can be chosen."""
    hosts = table(spark, sf_dir, "pages").withColumn("host", F.regexp_extract("url", "://([^/?#]*)", 1))
    found = reduction.reduced(hosts.select("page_id", "url", F.expr(_SHOWN).alias("html")))
    return found.select("page_id", "ordinal", "kind", "line", "shown_id")
