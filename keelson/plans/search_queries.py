"""Searches over the pages, events and nations tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.operators import discovery, matching, search
from keelson.plans.registry import query, table

_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_ORIGIN = "regexp_extract(url, '^[a-z]+://[^/?#]*')"


def host(url) -> F.Column:
    return F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1)


@query("s3_fetches", "SELECT url, CASE WHEN page_id % 3 = 0 THEN 1000 END AS cap, count(*) AS asked FROM pages GROUP BY 1, 2")
def s3_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (URL, cap) is fetched once, however many places named it."""
    return search.once_each(table(spark, sf_dir, "pages").select("url", F.when(F.col("page_id") % 3 == 0, 1000).alias("cap")))


@query(
    "s4_results_of_every_location",
    """WITH l AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN 1000 END AS cap FROM pages),
       f AS (SELECT DISTINCT url, cap, length(url) AS size FROM l WHERE NOT contains(url, '/de/'))
       SELECT page_id, l.url, l.cap, f.size FROM l LEFT JOIN f ON l.url = f.url AND l.cap IS NOT DISTINCT FROM f.cap""",
)
def s4_results_of_every_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results fanned out to every location; addresses below /de/ gave none."""
    locations = table(spark, sf_dir, "pages").select("page_id", "url", F.when(F.col("page_id") % 3 == 0, 1000).alias("cap"))
    fetched = search.once_each(locations).where("NOT contains(url, '/de/')").select("url", "cap", F.length("url").cast("long").alias("size"))
    return search.fanned_out(locations, fetched)


@query(
    "t3_budget_replay",
    """WITH r AS (SELECT user_id AS run_id, event_id AS seq, event_type AS host, strlen(props) AS bytes FROM events),
       b AS (SELECT *, row_number() OVER (PARTITION BY run_id, host ORDER BY seq) = 1 AS new_host FROM r),
       s AS (SELECT *, row_number() OVER w - 1 AS n, coalesce(sum(bytes) OVER p, 0) AS total, coalesce(sum(new_host::INT) OVER p, 0) AS hosts FROM b
             WINDOW w AS (PARTITION BY run_id ORDER BY seq), p AS (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
       d AS (SELECT *, CASE WHEN n >= 12 THEN 'request_limit' WHEN n >= 10 THEN 'navigation_limit' WHEN total >= 150 THEN 'total_size_limit'
             WHEN new_host AND hosts >= 3 THEN 'host_limit' END AS "limit" FROM s),
       e AS (SELECT *, min(CASE WHEN "limit" IS NOT NULL THEN seq END) OVER (PARTITION BY run_id) AS ended FROM d)
       SELECT run_id, seq, CASE WHEN ended IS NULL OR seq < ended THEN 'fetched' WHEN seq = ended THEN "limit" ELSE 'skipped' END AS decision FROM e""",
)
def t3_budget_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("host"), F.octet_length("props").alias("bytes")
    )
    return search.budget_replay(requests, 12, 2, 150, 3).select("run_id", "seq", "decision")


_LISTING = """
g AS (SELECT 'example.' || (['com', 'net', 'org'])[n_nationkey % 3 + 1] AS key, n_nationkey AS k, n_name AS name FROM nation),
l AS (SELECT key, CASE WHEN k BETWEEN 3 AND 4 THEN key ELSE key || ':' || lower(name) END AS entry,
      CASE WHEN k % 4 <> 1 THEN 'https://own.example/a b/' || k END AS origin, CASE WHEN k % 5 <> 2 THEN 'https://copy.example/' || k END AS copy FROM g)
"""


@query(
    "l7_directory_entries",
    f"""WITH {_LISTING}, h AS (SELECT DISTINCT {_HOST} AS host FROM pages),
        k AS (SELECT host, i, array_to_string(list_slice(string_split(host, '.'), i, 99), '.') AS key FROM (SELECT host, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM h) WHERE i <= 4),
        m AS (SELECT *, min(i) OVER (PARTITION BY host) AS best FROM k JOIN l USING (key) WHERE key NOT IN ('com', 'net', 'org') AND coalesce(origin, copy) IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY entry <> key, entry) AS rank, bool_or(entry = key) OVER (PARTITION BY host) AS prime FROM m WHERE i = best)
        SELECT host, key, entry, rank, CASE WHEN entry = key OR NOT prime THEN 'primary' ELSE 'secondary' END AS scope, replace(coalesce(origin, copy), ' ', '%20') AS url,
        CASE WHEN origin IS NOT NULL THEN 'provider' ELSE 'directory_copy' END AS source_kind FROM r WHERE rank <= 8""",
)
def l7_directory_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that a listing (made of the nations) has for the hosts of the pages; the cap of eight is the feature."""
    k = F.col("n_nationkey")
    key = F.concat(F.lit("example."), F.get(F.array(*map(F.lit, ("com", "net", "org"))), (k % 3).cast("int")))
    entry = F.when(k.between(3, 4), key).otherwise(F.concat(key, F.lit(":"), F.lower("n_name")))
    listing = table(spark, sf_dir, "nation").select(
        key.alias("key"), entry.alias("entry"), F.when(k % 4 != 1, F.concat(F.lit("https://own.example/a b/"), k)).alias("origin"),
        F.when(k % 5 != 2, F.concat(F.lit("https://copy.example/"), k)).alias("copy"),
    )
    hosts = table(spark, sf_dir, "pages").select(host("url").alias("host")).distinct()
    return search.directory_entries(hosts, listing).withColumn("rank", F.col("rank").cast("long"))


@query(
    "s16_documentation_seeds",
    f"""WITH o AS (SELECT DISTINCT {_ORIGIN} AS o FROM pages), u AS (SELECT o || '/api' AS target, o FROM o)
        SELECT target, CASE WHEN contains(o, '.net') THEN o || '/d' || r ELSE o || CASE r WHEN 0 THEN '/docs' ELSE '/documentation' END END AS seed, r AS rank
        FROM u, range(3) x(r) WHERE r < CASE WHEN contains(o, '.net') THEN 3 ELSE 2 END""",
)
def s16_documentation_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of each origin: four given ones below .net (three are taken), else the usual two."""
    at = table(spark, sf_dir, "pages").select(search.origin(F.col("url")).alias("o")).distinct()
    given = F.when(F.contains("o", F.lit(".net")), F.array(*(F.concat("o", F.lit(f"/d{i}")) for i in (0, 1, 2, 3))))
    return search.documentation_seeds(at.select(F.concat("o", F.lit("/api")).alias("target"), given.alias("seeds"))).withColumn("rank", F.col("rank").cast("long"))


@query(
    "s16_trusted_candidates",
    f"""WITH t AS (SELECT page_id, url, {_HOST} AS target, {_ORIGIN} AS o FROM pages),
        c AS (SELECT target, url, min(page_id) AS pos FROM t WHERE page_id % 3 <> 0 GROUP BY 1, 2)
        SELECT target, url, rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY pos, url) AS rank FROM c) WHERE rank <= 10""",
)
def s16_trusted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of documentation pages; every third page was led away to another origin, so its links don't count."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", host("url").alias("target"))
    seeds = search.documentation_seeds(pages.select("target", F.lit(None).cast("array<string>").alias("seeds"), "url").select("target", F.array(search.origin(F.col("url"))).alias("seeds")).distinct())
    away = F.when(F.col("page_id") % 3 == 0, F.lit("https://away.example/x")).otherwise(F.col("url"))
    links = pages.select("target", away.alias("final_url"), F.col("page_id").alias("pos"), "url")
    return search.trusted_candidates(seeds, links).withColumn("rank", F.col("rank").cast("long"))


@query(
    "j14_mappings_of_candidates",
    f"""WITH r AS (SELECT page_id, url AS spec_url, {_ORIGIN} AS provenance_url, CASE WHEN page_id % 2 = 0 THEN 'provider_mapping' ELSE 'directory' END AS method FROM pages),
        m AS (SELECT spec_url, provenance_url, arg_min(page_id, page_id % 7 * 1000000 + page_id) AS mapping_id FROM r GROUP BY 1, 2)
        SELECT page_id, CASE WHEN method = 'provider_mapping' THEN mapping_id END AS mapping_id FROM r JOIN m USING (spec_url, provenance_url)""",
)
def j14_mappings_of_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    found = table(spark, sf_dir, "pages").select(
        "page_id", F.col("url").alias("spec_url"), search.origin(F.col("url")).alias("provenance_url"),
        F.when(page % 2 == 0, "provider_mapping").otherwise("directory").alias("method"),
    )
    mappings = found.select("spec_url", "provenance_url", F.col("page_id").alias("mapping_id"), (page % 7 * 1_000_000 + page).alias("rank"))
    return search.mapping_of(found, mappings).select("page_id", "mapping_id")


_WAYS = ("direct_url", "provider_mapping", "directory", "documentation_link")


@query(
    "check_provenance",
    f"""WITH p AS (SELECT page_id, {_HOST} AS host, ({list(_WAYS)!r})[page_id % 4 + 1] AS method, (['example.com', 'net', 'cdn.other.io'])[page_id % 3 + 1] AS served FROM pages),
        r AS (SELECT *, host = served OR (ends_with(host, '.' || served) AND served <> 'net') OR ends_with(served, '.' || host) AS related FROM p)
        SELECT page_id, CASE WHEN method IN ('direct_url', 'provider_mapping') OR related THEN 'match' ELSE 'indeterminate' END AS outcome,
        method = 'documentation_link' AS linked FROM r""",
)
def check_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (page % n).cast("int"))
    own = host("url")
    found = table(spark, sf_dir, "pages").select("page_id", own.alias("host"), pick(_WAYS, 4).alias("method"), pick(("example.com", "net", "cdn.other.io"), 3).alias("served"))
    outcome = search.provenance_check(F.col("method"), F.col("host"), F.col("served"), F.col("host"))
    return found.select("page_id", outcome.alias("outcome"), search.linked_from_related(F.col("method"), F.col("host"), F.col("host")).alias("linked"))


@query(
    "check_operation",
    """WITH r AS (SELECT o_orderkey AS k, o_orderkey % 10 AS c FROM orders)
       SELECT k AS request_id, CASE c WHEN 0 THEN 'match' WHEN 1 THEN 'match' WHEN 2 THEN 'mismatch' WHEN 3 THEN 'mismatch' WHEN 4 THEN 'indeterminate' WHEN 5 THEN 'not_requested'
              WHEN 6 THEN 'indeterminate' WHEN 7 THEN 'match' WHEN 8 THEN 'mismatch' ELSE 'indeterminate' END AS outcome,
              CASE c WHEN 0 THEN '/pets/{id}' WHEN 1 THEN '/pets' WHEN 7 THEN '/v2/files/{name}.json' END AS template FROM r""",
)
def check_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order asks for one of ten things of a contract with a base path; the labels of the answers are the SQL."""
    key = F.col("o_orderkey")
    forms = (
        ("GET", "/v2/pets/@"), (None, "/pets/"), ("POST", "/v2/pets/@"), (None, "/v2/owners/@"), (None, "/guide"),
        (None, "/"), ("GET", "/"), ("GET", "/v2/files/a@.json"), ("GET", "/v2/files/a@.xml"), ("GET", "/gone/@"),
    )
    pick = lambda n: F.get(F.array(*(F.lit(f[n]) for f in forms)), (key % 10).cast("int"))
    contract = F.when(key % 10 == 9, "hidden").otherwise("open")
    asked = table(spark, sf_dir, "orders").select(
        key.alias("request_id"), contract.alias("contract"), pick(0).alias("method"), F.replace(pick(1), F.lit("@"), key.cast("string")).alias("path")
    )
    operations = [(c, m, t) for c in ("open", "hidden") for m, t in (("GET", "/pets/{id}"), ("GET", "/pets"), ("GET", "/v2/files/{name}.json"), ("PUT", "/pets/{id}"))]
    operations = spark.createDataFrame(operations, "contract string, method string, template string")
    contracts = spark.createDataFrame([("open", ["/v2", ""], False), ("hidden", [""], True)], "contract string, bases array<string>, hidden boolean")
    return search.operation_checks(asked, operations, contracts)


_HINT = "CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'v2' WHEN 2 THEN '2.1' WHEN 3 THEN 'latest' WHEN 4 THEN '2024-01-02' ELSE 'V3-beta1' END"


@query(
    "check_api_version",
    """SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'not_requested' WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 6 IN (1, 2) THEN 'match' ELSE 'mismatch' END
       WHEN c_custkey % 6 IN (1, 2) THEN 'match' WHEN c_custkey % 6 = 3 THEN 'indeterminate' ELSE 'mismatch' END AS outcome FROM customer""",
)
def check_api_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints against a mapping (every fifth row has one, for 2) and else against the segment v2 of a server."""
    key = F.col("c_custkey")
    mapped = F.when(key % 5 == 0, "2")
    found = table(spark, sf_dir, "customer").select(key, F.expr(_HINT).alias("asked"), mapped.alias("mapped"))
    outcome = discovery.version_check(F.col("asked"), F.col("mapped"), F.array(F.lit("v2")), F.lit("7.0"), F.lit(False))
    return found.select("c_custkey", outcome.alias("outcome"))


@query(
    "check_product",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'not_requested' WHEN p_partkey % 4 = 3 THEN 'mismatch' ELSE 'match' END AS outcome FROM part""",
)
def check_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product asked for by the first word of a part's name, by two words, or by one that it lacks."""
    words = F.split("p_name", " ")
    asked = F.when(F.col("p_partkey") % 4 == 1, F.upper(F.get(words, F.lit(0)))).when(F.col("p_partkey") % 4 == 2, F.array_join(F.slice(words, 1, 2), "-")).when(F.col("p_partkey") % 4 == 3, "no such thing")
    return table(spark, sf_dir, "part").select("p_partkey", discovery.product_check(asked, F.array("p_name", F.lit(None).cast("string"))).alias("outcome"))


@query(
    "check_server_host",
    f"""WITH h AS (SELECT DISTINCT {_HOST} AS host FROM pages), c(contract, servers) AS (VALUES ('own', ['https://api.example.com/v1', 'https://other.io']),
        ('relative', ['/v1', 'https://other.io']), ('foreign', ['https://other.io', 'http://example.dev:8080/x']), ('wide', ['https://example.net']))
        SELECT host AS target, contract, CASE WHEN list_bool_or(list_transform(list_filter(servers, lambda s: starts_with(s, 'http')), lambda s:
          regexp_extract(s, '://([^/:]*)', 1) = host OR ends_with(host, '.' || regexp_extract(s, '://([^/:]*)', 1)) OR ends_with(regexp_extract(s, '://([^/:]*)', 1), '.' || host))) THEN 'match'
          WHEN contract = 'relative' THEN 'indeterminate' ELSE 'mismatch' END AS outcome FROM h, c""",
)
def check_server_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every host of the pages against the servers of four contracts; each host asks about each contract, as a target does about its candidates."""
    rows = [("own", "https://api.example.com/v1"), ("own", "https://other.io"), ("relative", "/v1"), ("relative", "https://other.io"),
            ("foreign", "https://other.io"), ("foreign", "http://example.dev:8080/x"), ("wide", "https://example.net")]
    servers = spark.createDataFrame(rows, "contract string, server string")
    names = F.array(*(F.lit(c) for c in ("own", "relative", "foreign", "wide")))
    hosts = table(spark, sf_dir, "pages").select(host("url").alias("host")).distinct()
    targets = hosts.select(F.col("host").alias("target"), "host", F.explode(names).alias("contract"))
    return discovery.server_host_checks(targets, servers)


@query(
    "x22_rejection_parts",
    """SELECT page_id, CASE WHEN page_id % 3 < 2 THEN 'matching' END AS stage, CASE WHEN page_id % 3 < 2 THEN 'host_' || CASE page_id % 3 WHEN 0 THEN 'a' ELSE 'b' END END AS code,
       CASE WHEN page_id % 3 < 2 THEN 'no: ' || url ELSE 'plain ' || url END AS reason FROM pages""",
)
def x22_rejection_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    told = F.when(page % 3 == 0, F.concat(F.lit("matching:host_a: no: "), "url")).when(page % 3 == 1, F.concat(F.lit("matching:host_b: no: "), "url")).otherwise(F.concat(F.lit("plain "), "url"))
    return table(spark, sf_dir, "pages").select("page_id", search.rejection_parts(told).alias("r")).select("page_id", "r.*")


@query(
    "x23_json_of_answers",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN props WHEN 2 THEN NULL ELSE '{"a": {"b": "}"}}' END AS found FROM events""",
)
def x23_json_of_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON object in what a model says around it; a broken one is none."""
    n = F.col("event_id") % 4
    said = F.when(n == 0, F.col("props")).when(n == 1, F.concat(F.lit("Here: "), "props", F.lit(" as asked"))).when(n == 2, F.concat(F.lit("{ "), "props")).otherwise(F.lit('so {"a": {"b": "}"}} ok'))
    return table(spark, sf_dir, "events").select("event_id", search.json_within(said).alias("found"))


@query(
    "t7_recorded_answers",
    """WITH p AS (SELECT conv_id, turn, sha256(text) AS fingerprint FROM conversations), r AS (SELECT fingerprint, min(conv_id * 1000 + turn) AS answer FROM p WHERE turn % 2 = 0 GROUP BY 1)
       SELECT conv_id, turn, answer, CASE WHEN answer IS NULL THEN 'not_recorded' ELSE 'cached' END AS outcome FROM p LEFT JOIN r USING (fingerprint)""",
)
def t7_recorded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as prompts; even turns were recorded, and an equal prompt gets the first recorded answer."""
    place = F.col("conv_id") * 1000 + F.col("turn")
    prompts = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("fingerprint"), place.alias("place"))
    recorded = prompts.where("turn % 2 = 0").select("fingerprint", F.col("place").alias("answer"), F.col("place").alias("seq"))
    return search.replayed(prompts, recorded).select("conv_id", "turn", "answer", "outcome")


@query(
    "f5_api_paths",
    """SELECT page_id, page_id % 5 IN (0, 1, 3) AS api FROM pages""",
)
def f5_api_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths below a base, with a version, and others, made for each page."""
    forms = ("/v1/pets/@", "/base/@", "/v1", "/2024-01-02/x@", "/docs/@")
    path = F.replace(F.get(F.array(*map(F.lit, forms)), (F.col("page_id") % 5).cast("int")), F.lit("@"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", search.looks_like_api_path(path, F.array(F.lit("/base"), F.lit(""))).alias("api"))


@query(
    "t8_selected_candidates",
    """WITH o AS (SELECT o_custkey AS request, o_orderkey AS url FROM orders), c AS (SELECT c_custkey AS request, c_custkey * 4 AS url FROM customer)
       SELECT o.request, o.url FROM o JOIN c ON o.request = c.request AND o.url = c.url""",
)
def t8_selected_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers choose one order by number; only a choice among their own candidates counts."""
    outcomes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("url"))
    choices = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request"), (F.col("c_custkey") * 4).alias("url"))
    return search.selected(outcomes, choices)


@query(
    "o4_strategies_in_order",
    f"""SELECT {_ORIGIN} || '/openapi.json' AS url, 0 AS strategy_rank FROM pages UNION ALL SELECT url, 1 FROM pages WHERE contains(url, '/en/')""",
)
def o4_strategies_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("url")
    return search.in_strategy_order(pages.select(F.concat(search.origin(F.col("url")), F.lit("/openapi.json")).alias("url")), pages.where("contains(url, '/en/')"))


@query(
    "t2_verdicts_of_candidates",
    """WITH c AS (SELECT o_custkey AS request_id, o_orderkey AS candidate, o_orderkey % 5 AS host, o_orderkey % 3 AS op, o_orderkey % 4 AS ver FROM orders)
       SELECT request_id, candidate, CASE WHEN host = 0 THEN 'server_host' WHEN op = 0 THEN 'operation' WHEN ver = 0 THEN 'api_version' END AS rejected_by, op = 1 OR ver = 1 AS confirmed FROM c""",
)
def t2_verdicts_of_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of every candidate (an order of a customer): the first mismatch rejects, a confirming match confirms."""
    outcome = lambda n: F.when(n == 0, "mismatch").when(n == 1, "match").otherwise("indeterminate")
    key = F.col("o_orderkey")
    made = [("server_host", key % 5), ("operation", key % 3), ("api_version", key % 4)]
    checks = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(name).alias("check"), outcome(n).alias("outcome")) for i, (name, n) in enumerate(made)))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request_id"), key.alias("candidate"), F.explode(checks).alias("c"))
    return matching.verdict(rows.select("request_id", "candidate", "c.*"))
