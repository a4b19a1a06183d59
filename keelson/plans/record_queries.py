"""Smaller formats written and read again, and judging what searches returned."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import text
from keelson.operators import discovery, structure
from keelson.operators.staging import staging_folder
from keelson.plans.registry import query, table
from keelson.sources import bundles, records

_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


def folder(spark: SparkSession, name: str) -> str:
    return f"{staging_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "s15_providers_of_hosts",
    f"""WITH h AS (SELECT DISTINCT {_HOST} AS host FROM pages), p AS (SELECT n_nationkey AS k, lower(n_name) AS id, 'https://spec.example/' || n_nationkey % 5 AS spec_url, n_nationkey * 10 AS cap FROM nation),
        m AS (SELECT host, id, spec_url, max(cap) OVER (PARTITION BY spec_url) AS allowance, k FROM p, (SELECT host, length(host) % 7 AS n FROM h) x WHERE p.k % 7 = x.n)
        SELECT host, id, spec_url, allowance FROM m""",
)
def s15_providers_of_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of the nations, written and read: each lists some hosts of the pages; all mappings of a host stay, with the largest cap of a URL."""
    hosts = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host")).distinct()
    listed = hosts.groupBy((F.length("host") % 7).alias("n")).agg(F.collect_list("host").alias("hosts"))
    own = table(spark, sf_dir, "nation").withColumn("n", F.col("n_nationkey") % 7).join(listed, "n", "left").select(
        F.lower("n_name").alias("id"), F.coalesce("hosts", F.array().cast("array<string>")).alias("hosts"),
        F.concat(F.lit("https://spec.example/"), F.col("n_nationkey") % 5).alias("spec_url"), (F.col("n_nationkey") * 10).cast("long").alias("max_document_bytes"),
    )
    path = folder(spark, "registry")
    own.agg(F.lit(1).alias("schema_version"), F.collect_list(F.struct("*")).alias("providers")).write.json(path)
    return records.providers_of(hosts, records.load_registry(spark, path)).select("host", "id", "spec_url", "allowance")


@query(
    "s9_ledger_lines",
    """SELECT event_id::VARCHAR AS timestamp, CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' ELSE 'cached' END AS outcome, event_id AS input_tokens, false AS unreadable,
       (ceil(event_id / 3.0) * 2 + 1000) / 1e6 AS worst_usd FROM events
       UNION ALL SELECT NULL, NULL, NULL, true, NULL FROM region""",
)
def s9_ledger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of the events appended in two parts and read back; a line for each region can't be read."""
    n = F.col("event_id")
    entries = table(spark, sf_dir, "events").select(
        n.cast("string").alias("timestamp"), F.when(n % 3 == 0, "ok").when(n % 3 == 1, "error").otherwise("cached").alias("outcome"), n.alias("input_tokens")
    )
    path = folder(spark, "ledger")
    records.append_ledger(entries.where("outcome = 'ok'"), path)
    records.append_ledger(entries.where("outcome <> 'ok'"), path)
    table(spark, sf_dir, "region").select(F.concat(F.lit('{"timestamp": '), "r_name")).write.mode("append").text(path)
    found = records.read_ledger(spark, path)
    worst = records.worst_case_usd(F.col("input_tokens"), 100, 2.0, 10.0)
    return found.select("timestamp", "outcome", "input_tokens", F.col("unreadable").isNotNull().alias("unreadable"), worst.alias("worst_usd"))


@query(
    "s20_links_of_catalogues",
    """SELECT page_id, 'https://a.example/' || page_id AS anchor, relation, replace(href, '@', page_id::VARCHAR) AS href, type FROM pages,
       (VALUES ('service-desc', '/d@.json', 'application/json'), ('item', '/i@', NULL), ('item', '/j', NULL)) l(relation, href, type)""",
)
def s20_links_of_catalogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link set for each page; a relation of no interest is passed over."""
    content = F.expr("""concat('{"linkset":[{"anchor":"https://a.example/', page_id, '","service-desc":[{"href":"/d', page_id, '.json","type":"application/json"}],"item":[{"href":"/i', page_id, '"},{"href":"/j"}],"license":[{"href":"/l"}]}]}')""")
    return records.linkset_links(table(spark, sf_dir, "pages").select("page_id", content.alias("content")))


@query(
    "k2a_unsafe_paths",
    """WITH b AS (SELECT s_suppkey AS bundle FROM supplier)
       SELECT bundle, '/abs' AS path, 'form' AS problem FROM b UNION ALL SELECT bundle, 'a/../b', 'form' FROM b UNION ALL SELECT bundle, 'odd name', 'form' FROM b
       UNION ALL SELECT bundle, 'Refs/' || bundle, 'case' FROM b UNION ALL SELECT bundle, 'dir', 'folder' FROM b""",
)
def k2a_unsafe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles of each supplier with good paths and bad ones of each kind."""
    key = F.col("s_suppkey").cast("string")
    paths = F.array(*map(F.lit, ("root.json", "/abs", "a/../b", "odd name", "dir", "dir/file.json")), F.concat(F.lit("refs/"), key), F.concat(F.lit("Refs/"), key))
    return records.unsafe_paths(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("bundle"), F.explode(paths).alias("path")))


_KINDS = ("openapi3", "swagger2", "asyncapi", "smithy", "google_discovery", "postman", None)


@query("p19_described_as", f"SELECT o_orderkey, ([{', '.join('NULL' if k is None else repr(k) for k in _KINDS)}])[o_orderkey % 7 + 1] AS kind FROM orders")
def p19_described_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = (
        '{"openapi":"3.0.1"}', '{"swagger":"2.0"}', '{"asyncapi":"2.6.0"}', '{"smithy":"2.0"}', '{"kind":"discovery#restDescription"}',
        '{"info":{"schema":"https://schema.getpostman.com/json/collection/v2.1.0"}}', '{"paths":{}}',
    )
    content = F.get(F.array(*map(F.lit, forms)), (F.col("o_orderkey") % 7).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", records.described_as(content).alias("kind"))


@query(
    "j16_merged_contracts",
    """WITH p AS (SELECT o_custkey AS request, o_orderkey AS candidate, 'f' || (o_orderkey % 6) AS fingerprint, 'l' || (o_orderkey % 3) AS loose, o_orderkey % 6 < 3 AS has_servers, o_orderkey AS rank FROM orders),
       o AS (SELECT request, fingerprint, loose, arg_min(candidate, rank) AS candidate, bool_or(has_servers) AS has_servers, min(rank) AS rank FROM p GROUP BY 1, 2, 3),
       b AS (SELECT request, loose, bool_or(has_servers) AS anyone, arg_min(candidate, rank) AS candidate, min(rank) AS rank FROM o GROUP BY 1, 2)
       SELECT request, loose AS loose_fingerprint, candidate, rank FROM o WHERE has_servers UNION ALL SELECT request, loose, candidate, rank FROM b WHERE NOT anyone""",
)
def j16_merged_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as contracts that a customer's search found; of six forms, three declare servers, and each equals another but for them."""
    key = F.col("o_orderkey")
    packages = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("request"), key.alias("candidate"), F.concat(F.lit("f"), key % 6).alias("fingerprint"), F.concat(F.lit("l"), key % 3).alias("loose_fingerprint"),
        (key % 6 < 3).alias("has_servers"), key.alias("rank"),
    )
    return discovery.merged_duplicates(packages)


def _labels() -> str:
    return "CASE c_custkey % 8 WHEN 0 THEN 'correct_empty' WHEN 1 THEN 'false_positive' WHEN 2 THEN 'miss' WHEN 3 THEN 'hit' WHEN 4 THEN 'false_positive' WHEN 5 THEN 'wrong_alternative' WHEN 6 THEN 'ambiguous_hit' ELSE 'correct_empty' END"


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as targets of a benchmark, each with one of eight answers to its label."""
    n, key = F.col("c_custkey") % 8, F.col("c_custkey").cast("string")
    good, bad = F.concat(F.lit("https://good.example/"), key), F.concat(F.lit("https://good.example/old/"), key)
    expect = F.when(n < 2, "none").when(n < 7, "found").otherwise("any")
    sources = F.when(n.isin(0, 2, 7), F.array().cast("array<string>")).when(n == 5, F.array(good, bad)).when(n.isin(1, 4), F.array(bad)).when(n == 6, F.array(good, good)).otherwise(F.array(good))
    outcome = discovery.benchmark_verdict(expect, sources, F.array(F.lit("good.example")), F.array(F.lit("/old/")), n == 6)
    return table(spark, sf_dir, "customer").select("c_custkey", expect.alias("expect"), (F.size(sources) > 0).alias("returned"), outcome.alias("outcome"))


@query("j17_benchmark_verdicts", f"SELECT c_custkey, {_labels()} AS outcome FROM customer")
def j17_benchmark_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).select("c_custkey", "outcome")


@query(
    "a6_benchmark_summary",
    f"""WITH v AS (SELECT c_custkey % 8 AS n, {_labels()} AS outcome FROM customer), c AS (SELECT count(*) AS targets, count_if(n BETWEEN 2 AND 6)::BIGINT AS found_targets,
        count_if(n BETWEEN 2 AND 6 AND outcome IN ('hit', 'ambiguous_hit'))::BIGINT AS hits, count_if(n NOT IN (0, 2, 7))::BIGINT AS returned,
        count_if(n NOT IN (0, 2, 7) AND outcome IN ('hit', 'ambiguous_hit'))::BIGINT AS correct FROM v)
        SELECT *, round_even(hits / nullif(found_targets, 0), 3) AS recall, round_even(correct / nullif(returned, 0), 3) AS precision FROM c""",
)
def a6_benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.benchmark_summary(verdicts(spark, sf_dir))


@query(
    "y5_attempt_outcomes",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'retrieved' WHEN 1 THEN 'budget_exhausted' WHEN 2 THEN 'not_found' WHEN 3 THEN 'inaccessible' WHEN 4 THEN 'invalid_url' ELSE 'inaccessible' END AS outcome FROM events""",
)
def y5_attempt_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 6
    code = F.when(n == 1, "deadline").when(n.isin(2, 3), "http_error").when(n == 4, "invalid_url").when(n == 5, "timeout")
    status = F.when(n == 2, 410).when(n == 3, 500)
    return table(spark, sf_dir, "events").select("event_id", discovery.attempt_outcome(n == 0, code, status).alias("outcome"))


@query(
    "x14_prompt_fingerprints",
    "SELECT conv_id, turn, sha256(unhex(sha256(role) || sha256(text))) AS fingerprint FROM conversations",
)
def x14_prompt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.fingerprint_of([F.col("role"), F.col("text")]).alias("fingerprint"))


@query(
    "x15_strict_times",
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ts END AS at FROM events",
)
def x15_strict_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the one form of a time is read; every second event has another."""
    own = text.utc_text(F.col("ts"))
    said = F.when(F.col("event_id") % 2 == 0, own).otherwise(F.replace(own, F.lit("+00:00"), F.lit("Z")))
    return table(spark, sf_dir, "events").select("event_id", text.strict_time(said).cast("timestamp_ntz").alias("at"))


@query(
    "s5a_rejected_payloads",
    """SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'duplicate_key' WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'scalar_root' WHEN 4 THEN 'reserved_key' END AS rejection FROM events""",
)
def s5a_rejected_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads as they are, and four kinds of faults."""
    n = F.col("event_id") % 5
    payload = F.when(n == 0, F.col("props")).when(n == 1, '{"a":1,"a":2}').when(n == 2, F.concat("props", F.lit("}"))).when(n == 3, "17").otherwise('{"[]":1}')
    return structure.with_structure(table(spark, sf_dir, "events").select("event_id", payload.alias("json"))).select("event_id", "rejection")


#: Packages of suppliers: a root in JSON or YAML with or without servers, keys in two orders, and two referenced documents.
_PACKAGES = """
s AS (SELECT s_suppkey AS package, s_nationkey AS n, s_suppkey % 3 = 0 AS yaml, s_suppkey % 2 = 0 AS served, '"title":"nation ' || s_nationkey || '","version":"1"' AS info FROM supplier),
r AS (SELECT package, n, served, '{"info":{' || info || '},"openapi":"3.0.3","paths":{}' || CASE WHEN served THEN ',"servers":[{"url":"/v' || n % 4 || '"}]' ELSE '' END || '}' AS whole, '{"info":{' || info || '},"openapi":"3.0.3","paths":{}}' AS bare FROM s),
x AS (SELECT *, CASE WHEN n % 2 = 0 THEN [sha256('{"n":' || n || '}'), sha256('["' || n || '",1.5]')] ELSE [sha256('{"n":' || n || '}'), sha256('{"n":' || n || '}')] END AS rest FROM r)
"""


def packages_of_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """package, path, is_root and content; packages of a nation differ in layout and in having servers."""
    n, key = F.col("s_nationkey").cast("string"), F.col("s_suppkey")
    yaml = F.concat(F.lit("openapi: 3.0.3\ninfo:\n  version: '1'\n  title: nation "), n, F.when(key % 2 == 0, F.concat(F.lit("\nservers:\n- url: /v"), F.col("s_nationkey") % 4)).otherwise(""), F.lit("\npaths: {}\n"))
    served = F.when(key % 2 == 0, F.concat(F.lit('"servers": [ {"url": "/v'), F.col("s_nationkey") % 4, F.lit('"} ], '))).otherwise("")
    plain = F.concat(F.lit('{"openapi": "3.0.3", '), served, F.lit('"info": {"version": "1",\t"title": "nation '), n, F.lit('"}, "paths": {}}'))
    shared, other = F.concat(F.lit('{"n" : '), n, F.lit("}")), F.concat(F.lit('[ "'), n, F.lit('", 1.50]'))
    member = lambda path, root, content: F.struct(F.lit(path).alias("path"), F.lit(root).alias("is_root"), content.alias("content"))
    second = F.when(F.col("s_nationkey") % 2 == 0, other).otherwise(shared)
    listed = F.array(member("api/root", True, F.when(key % 3 == 0, yaml).otherwise(plain)), member("refs/a.json", False, shared), member("refs/b.json", False, second))
    return table(spark, sf_dir, "supplier").select(key.alias("package"), F.explode(listed).alias("m")).select("package", "m.*")


@query(
    "a9_fingerprints_of_contracts",
    f"""WITH {_PACKAGES} SELECT package, sha256(unhex(sha256(whole) || array_to_string(list_sort(rest), ''))) AS fingerprint,
        sha256(unhex(sha256(bare) || array_to_string(list_sort(rest), ''))) AS loose_fingerprint, served AS has_servers FROM x""",
)
def a9_fingerprints_of_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity of contracts with and without servers, however they are written."""
    return bundles.package_fingerprints(packages_of_suppliers(spark, sf_dir).drop("path"))


@query(
    "x12_canonical_forms",
    r"""SELECT c_custkey, '{"a":["é' || c_custkey || '",' || c_nationkey || ',true,null],"z":{}}' AS normalized, '{"a":["\u00e9' || c_custkey || '",' || c_nationkey || ',true,null],"z":{}}' AS identity,
       '{"a": ["é' || c_custkey || '", ' || c_nationkey || ', true, null], "z": {}}' AS record FROM customer""",
)
def x12_canonical_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical forms of one value for each customer: compact, in ASCII, and with spaces."""
    content = F.concat(F.lit('{"z": {}, "a": ["é'), "c_custkey", F.lit('",'), "c_nationkey", F.lit(", true, null]}"))
    found = table(spark, sf_dir, "customer").select("c_custkey", bundles.canonical_forms(content).alias("f"))
    return found.select("c_custkey", "f.normalized", "f.identity", "f.record")


_NEW_LINE = "' || chr(10) || '"
_YAML = f"'openapi: 3.0.3{_NEW_LINE}info:{_NEW_LINE}  version: ''1''{_NEW_LINE}  title: nation ' || n || CASE WHEN served THEN '{_NEW_LINE}servers:{_NEW_LINE}- url: /v' || n % 4 ELSE '' END || '{_NEW_LINE}paths: {{}}{_NEW_LINE}'"
_PLAIN = """'{"openapi": "3.0.3", ' || CASE WHEN served THEN '"servers": [ {"url": "/v' || n % 4 || '"} ], ' ELSE '' END || '"info": {"version": "1",' || chr(9) || '"title": "nation ' || n || '"}, "paths": {}}'"""
_MANIFEST = """'{"documents":[' || array_to_string(list_transform([['api/root', root], ['refs/a.json', a], ['refs/b.json', b]], lambda d: '{"path":"' || d[1] || '","sha256":"' || sha256(d[2]) || '","size":' || strlen(d[2]) || '}'), ',')
  || '],"entry_point":"api/root","format":1,"normalization_version":"1","normalized":{"sha256":"' || sha256(n::VARCHAR) || '","size":' || strlen(n::VARCHAR) || '}}'"""
_BUNDLES = f"""{_PACKAGES}, o AS (SELECT package, n, CASE WHEN yaml THEN {_YAML} ELSE {_PLAIN} END AS root, '{{"n" : ' || n || '}}' AS a, CASE WHEN n % 2 = 0 THEN '[ "' || n || '", 1.50]' ELSE '{{"n" : ' || n || '}}' END AS b FROM s),
  m AS (SELECT package, n, sha256({_MANIFEST}) AS bundle FROM o)"""


@query(
    "s8_bundles_read_back",
    f"""WITH {_BUNDLES} SELECT DISTINCT bundle, CASE n % 6 WHEN 1 THEN 'corrupted_file' WHEN 2 THEN 'missing_file' WHEN 3 THEN 'corrupted_manifest' WHEN 4 THEN 'missing_manifest' WHEN 5 THEN 'corrupted_file' END AS problem FROM m""",
)
def s8_bundles_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles of all packages, written once each and read back; those of five nations in six come back damaged, each in its way."""
    members = packages_of_suppliers(spark, sf_dir)
    nation = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("package"), F.col("s_nationkey").alias("n"))
    place = folder(spark, "bundles")
    stored = bundles.put(members, nation.select("package", F.col("n").cast("string").alias("normalized"), F.lit("1").alias("version")), place)
    of_bundle = stored.join(nation, "package").select(F.col("fingerprint").alias("bundle"), "n").distinct()
    files, way = bundles.files_in(spark, place).join(of_bundle, "bundle"), F.col("n") % 6
    touched = (way == 1) & (F.col("name") == "original/refs/a.json") | (way == 3) & (F.col("name") == "manifest.json") | (way == 5) & (F.col("name") == "normalized")
    lost = (way == 2) & (F.col("name") == "original/api/root") | (way == 4) & (F.col("name") == "manifest.json")
    worn = F.when(touched, F.concat("content", F.lit(" ").cast("binary"))).otherwise(F.col("content"))
    problems = bundles.verified(files.where(~lost).select("bundle", "name", worn.alias("content")))[1]
    return of_bundle.select("bundle").distinct().join(problems, "bundle", "left")


@query(
    "k2_bundles_put_once",
    f"""WITH {_BUNDLES}, f AS (SELECT DISTINCT bundle FROM m WHERE package % 2 = 0) SELECT package, bundle AS fingerprint, bundle NOT IN (SELECT bundle FROM f) AS new FROM m""",
)
def k2_bundles_put_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of suppliers with even numbers are put first, then all: only what isn't there is written."""
    members = packages_of_suppliers(spark, sf_dir)
    nation = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("package"), F.col("s_nationkey").cast("string").alias("normalized"), F.lit("1").alias("version"))
    place = folder(spark, "bundles")
    bundles.put(members.where("package % 2 = 0"), nation.where("package % 2 = 0"), place).count()
    return bundles.put(members, nation, place).select("package", "fingerprint", "new")
