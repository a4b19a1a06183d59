"""Searching for contracts over tables: what to fetch once, budgets replayed, listings, seeds, provenance, barriers.

A search is a table of rows with a request's key; nothing here fetches.  Orders within
a request are windows over that request alone, whose rows a search bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.operators.matching import find_operations, host_relation, provider_keys
from keelson.operators.staging import near

#: Usual places of a contract and of documentation; file endings of a contract; caps of the searches.
COMMON_LOCATIONS = ("/openapi.json", "/openapi.yaml", "/swagger.json")
DOCUMENTATION_SEEDS = ("/docs", "/documentation")
MOST_ENTRIES, MOST_SEEDS, MOST_CANDIDATES = 8, 3, 10
#: Ways of finding that start from a page of documentation, and rejections that only say "no contract here".
DOCUMENTATION_METHODS = (
    "documentation_link", "swagger_ui_config", "redoc_config", "spec_url_attribute", "service_desc_link", "api_catalog",
    "swagger_config_url", "swagger_config_url_entry", "embedded_spec", "script_literal", "documentation_navigation", "llm_suggestion",
)
NO_CONTRACT = ("empty_document", "html_document", "not_json_or_yaml", "not_an_object", "not_openapi")
#: The pattern of a version as a path segment.
VERSION_SEGMENT = r"v\d+(?:\.\d+)?|\d{4}-\d{2}-\d{2}"


def origin(url: Column) -> Column:
    """Scheme and authority of a URL."""
    return F.regexp_extract(url, "^[a-z]+://[^/?#]*", 0)


def path_of_url(url: Column) -> Column:
    return F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def quoted(url: Column) -> Column:
    """A URL without bare spaces."""
    return F.replace(url, F.lit(" "), F.lit("%20"))


def common_locations(origins: DataFrame) -> DataFrame:
    """origin and candidate: the usual places below each origin; exploded, not joined."""
    paths = F.array(*(F.lit(p) for p in COMMON_LOCATIONS))
    return origins.select("origin", F.explode(paths).alias("path")).select("origin", F.concat("origin", "path").alias("candidate"))


def looks_like_contract(url: Column) -> Column:
    """Whether a URL's path ends as a contract's file does."""
    return F.lower(path_of_url(url)).rlike(r"\.(?:json|ya?ml)$")


def once_each(locations: DataFrame) -> DataFrame:
    """What to fetch: each (url, cap) once, and how many locations asked for it."""
    return locations.groupBy("url", "cap").agg(F.count(F.lit(1)).alias("asked"))


def fanned_out(locations: DataFrame, fetched: DataFrame) -> DataFrame:
    """Every location with the result of its fetch; ``fetched`` has url, cap and results; a null cap is a cap of its own."""
    results = [c for c in fetched.columns if c not in ("url", "cap")]
    there = fetched.select(F.col("url").alias("fetched_url"), F.col("cap").alias("fetched_cap"), *results)
    same = (F.col("url") == F.col("fetched_url")) & F.col("cap").eqNullSafe(F.col("fetched_cap"))
    return locations.join(there, same, "left").drop("fetched_url", "fetched_cap")


def budget_replay(requests: DataFrame, most_requests: int, reserve: int, most_bytes: int, most_hosts: int) -> DataFrame:
    """Requests (run_id, seq, host, bytes) with what their run's budget says: fetched, the limit that ended it, or skipped.

    A limit ends its run, so sums up to the first one are exact and what follows is skipped.
    """
    order = Window.partitionBy("run_id").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    first_of_host = F.row_number().over(Window.partitionBy("run_id", "host").orderBy("seq")) == 1
    seen = requests.withColumn("new_host", first_of_host)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    seen = seen.withColumns({
        "requests_before": F.row_number().over(order) - 1, "bytes_before": total(F.col("bytes")), "hosts_before": total(F.col("new_host").cast("int")),
    })
    limit = (
        F.when(F.col("requests_before") >= most_requests, "request_limit")
        .when(F.col("requests_before") >= most_requests - reserve, "navigation_limit")
        .when(F.col("bytes_before") >= most_bytes, "total_size_limit")
        .when(F.col("new_host") & (F.col("hosts_before") >= most_hosts), "host_limit")
    )
    ended = F.min(F.when(F.col("limit").isNotNull(), F.col("seq"))).over(Window.partitionBy("run_id"))
    out = seen.withColumn("limit", limit).withColumn("ended", ended)
    decision = F.when(F.col("ended").isNull() | (F.col("seq") < F.col("ended")), "fetched").when(F.col("seq") == F.col("ended"), F.col("limit")).otherwise("skipped")
    return out.select(*requests.columns, decision.alias("decision"))


def directory_entries(hosts: DataFrame, listing: DataFrame) -> DataFrame:
    """Entries of a third-party listing for each host: host, key, entry, rank, scope, url and source_kind.

    ``listing``: key, entry, origin, copy.  The most specific key of a host that has a
    listing is used; its own entry comes first, then the others by id, MOST_ENTRIES in
    all.  Entries beside a primary one are secondary; the provider's own source is taken
    before the listing's copy.
    """
    usable = listing.where("origin IS NOT NULL OR copy IS NOT NULL")
    asked = hosts.select("host", F.posexplode(provider_keys(F.col("host"))).alias("specificity", "key"))
    met = asked.join(usable, "key")
    best = Window.partitionBy("host")
    met = met.withColumn("best", F.min("specificity").over(best)).where("specificity = best")
    order = Window.partitionBy("host").orderBy(F.col("entry") != F.col("key"), "entry")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MOST_ENTRIES)
    has_primary = F.max(F.col("entry") == F.col("key")).over(best)
    return ranked.select(
        "host", "key", "entry", "rank", F.when((F.col("entry") == F.col("key")) | ~has_primary, "primary").otherwise("secondary").alias("scope"),
        quoted(F.coalesce("origin", "copy")).alias("url"), F.when(F.col("origin").isNotNull(), "provider").otherwise("directory_copy").alias("source_kind"),
    )


def documentation_seeds(targets: DataFrame) -> DataFrame:
    """target, seed, rank: given seeds (an array, or null) or the usual ones below the target's origin, at most MOST_SEEDS."""
    usual = F.transform(F.array(*(F.lit(p) for p in DOCUMENTATION_SEEDS)), lambda p: F.concat(origin(F.col("target")), p))
    chosen = F.slice(F.array_distinct(F.coalesce("seeds", usual)), 1, MOST_SEEDS)
    return targets.select("target", F.posexplode(chosen).alias("rank", "seed"))


def trusted_candidates(seeds: DataFrame, pages: DataFrame) -> DataFrame:
    """Candidates (target, url) that documentation links to, by first place, at most MOST_CANDIDATES a target.

    ``pages``: target, final_url, pos and url of each link; a page that a redirect led
    away from the origins of the target's seeds isn't trusted.
    """
    origins = seeds.select("target", origin(F.col("seed")).alias("page_origin")).distinct()
    trusted = pages.withColumn("page_origin", origin(F.col("final_url"))).join(origins, ["target", "page_origin"], "left_semi")
    once = trusted.groupBy("target", "url").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("target").orderBy("pos", "url")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MOST_CANDIDATES).drop("pos")


def mapping_of(retrieved: DataFrame, mappings: DataFrame) -> DataFrame:
    """Retrieved candidates with the provider mapping that led to them: the first by rank of equal URL and provenance."""
    key = ["spec_url", "provenance_url"]
    first = mappings.groupBy(*key).agg(F.min_by("mapping_id", "rank").alias("found_mapping"))
    met = retrieved.join(first, key, "left")
    return met.withColumn("mapping_id", F.when(F.col("method") == "provider_mapping", F.col("found_mapping"))).drop("found_mapping")


def provenance_check(method: Column, target: Column, served: Column, page: Column) -> Column:
    """Where a contract comes from: match or indeterminate, never a rejection.  ``page`` is the host of the page that led to it."""
    related = host_relation(target, served).isNotNull()
    return F.when(method.isin("direct_url", "provider_mapping") | F.coalesce(related, F.lit(False)), "match").otherwise("indeterminate")


def linked_from_related(method: Column, target: Column, page: Column) -> Column:
    """Whether a page of a related host links to the contract: a connection to be noted, no proof."""
    return method.isin(*DOCUMENTATION_METHODS) & F.coalesce(host_relation(target, page).isNotNull(), F.lit(False))


def guessed_miss(method: Column, stage: Column, code: Column) -> Column:
    """A guessed location that holds no contract at all is a miss, not a rejection."""
    return (method != "provider_mapping") & F.coalesce((stage == "validation") & code.isin(*NO_CONTRACT), F.lit(False))


def looks_like_api_path(path: Column, bases: Column) -> Column:
    """A path below a server's base, or with a version segment and another one."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    versions = F.exists(segments, lambda s: s.rlike(f"^(?i)(?:{VERSION_SEGMENT})$"))
    others = F.exists(segments, lambda s: ~s.rlike(f"^(?i)(?:{VERSION_SEGMENT})$"))
    return F.exists(bases, lambda b: (b != "") & F.startswith(path, F.concat(b, F.lit("/")))) | (versions & others)


def operation_checks(requests: DataFrame, operations: DataFrame, contracts: DataFrame) -> DataFrame:
    """request_id, outcome and template of the check of operations.

    ``requests``: request_id, contract, method (null for any), path.  ``contracts``:
    contract, bases (paths of its servers, '' for none), hidden (references or variables
    hide some operations).  The longest base is taken off first, then the path is tried
    as it is.  All requests may ask for one contract, so contracts and operations, whose
    bytes are counted, come to the requests where they are small.
    """
    told = F.sum(64 + F.octet_length("contract") + F.aggregate("bases", F.lit(0), lambda n, b: n + 16 + F.octet_length(b)))
    contracts = near(contracts, contracts.agg(F.coalesce(told, F.lit(0)).alias("n")).first()["n"])
    trim = lambda p: F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", ""))
    asked = requests.join(contracts, "contract").withColumn("path", F.coalesce(F.nullif(trim(F.col("path")), F.lit("")), F.lit("/")))
    below = F.filter(F.array_union("bases", F.array(F.lit(""))), lambda b: (b == "") | (F.col("path") == b) | F.startswith(F.col("path"), F.concat(b, F.lit("/"))))
    tried = asked.select("request_id", "contract", "method", F.explode(below).alias("base"), "path").select(
        F.struct("request_id", F.length("base").alias("taken")).alias("request_id"), "contract", "method",
        F.coalesce(F.nullif(trim(F.substr("path", F.length("base") + 1)), F.lit("")), F.lit("/")).alias("path"),
    )
    found = find_operations(tried, operations, ["contract"])
    # Dealt by request before they are grouped: texts are grouped by sorting, and what one task finds grows with its split.
    found = found.select(F.col("request_id.request_id").alias("request_id"), F.col("request_id.taken").alias("taken"), "template").repartition("request_id")
    best = found.groupBy("request_id").agg(F.min_by("template", F.struct(-F.col("taken"), F.col("template"))).alias("template"))
    whole = F.col("path") == "/"
    outcome = (
        F.when(whole, F.when(F.col("method").isNull(), "not_requested").otherwise("indeterminate"))
        .when(F.col("template").isNotNull(), "match")
        .when(F.col("method").isNull(), F.when(~F.col("hidden") & looks_like_api_path(F.col("path"), F.col("bases")), "mismatch").otherwise("indeterminate"))
        .when(F.col("hidden"), "indeterminate")
        .otherwise("mismatch")
    )
    return asked.join(best, "request_id", "left").select("request_id", outcome.alias("outcome"), F.when(~whole, F.col("template")).alias("template"))


def collapsed_barriers(attempts: DataFrame) -> DataFrame:
    """One row for each host and status that asks for authentication: host, status, first_url and how many others."""
    barred = attempts.where(F.col("status").isin(401, 403))
    return barred.groupBy("host", "status").agg(F.min_by("url", "seq").alias("first_url"), (F.count(F.lit(1)) - 1).alias("others"))


def in_strategy_order(*found: DataFrame) -> DataFrame:
    """The results of strategies, one after another, with the number of the strategy."""
    out = None
    for rank, rows in enumerate(found):
        rows = rows.withColumn("strategy_rank", F.lit(rank))
        out = rows if out is None else out.unionByName(rows)
    return out


def selected(outcomes: DataFrame, choices: DataFrame) -> DataFrame:
    """Ambiguous outcomes (request, url) resolved by an explicit choice (request, url) of one of their own candidates."""
    return outcomes.join(choices, ["request", "url"], "left_semi")


def rejection_parts(text: Column) -> Column:
    """struct(stage, code, reason) of ``stage:code: reason``; another text is all reason."""
    form = r"(?s)^([a-z_]+):([a-z_]+): (.*)$"
    fits = text.rlike(form)
    part = lambda n: F.when(fits, F.regexp_extract(text, form, n))
    return F.struct(part(1).alias("stage"), part(2).alias("code"), F.coalesce(part(3), text).alias("reason"))


def json_within(text: Column) -> Column:
    """The JSON object inside a model's answer: from the first brace to the last, null if that is none."""
    start, end = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    inner = F.when((start > 0) & (end > start), F.substr(text, start, end - start + 1))
    return F.when(F.try_parse_json(inner).isNotNull(), inner)


def replayed(prompts: DataFrame, recorded: DataFrame) -> DataFrame:
    """Prompts (fingerprint) with the recorded answer of the same fingerprint; of several the first by seq."""
    first = recorded.groupBy("fingerprint").agg(F.min_by("answer", "seq").alias("answer"))
    return prompts.join(first, "fingerprint", "left").withColumn("outcome", F.when(F.col("answer").isNull(), "not_recorded").otherwise("cached"))


def pages_for_model(links: DataFrame, least_score: int = 1) -> DataFrame:
    """Pages in the order in which a model reads them: those with most links that score come first."""
    counted = links.groupBy("page_id").agg(F.count_if(F.col("score") >= least_score).alias("eligible"))
    return counted.orderBy(F.col("eligible").desc(), "page_id")
