"""Does a contract belong to a target: hosts, operations, versions, products; and what the search came to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.operators.staging import near

#: Public suffixes under which no two hosts are related; a small table, passed where a longer one is at hand.
PUBLIC_SUFFIXES = ("com", "org", "net", "io", "dev", "co.uk", "org.uk", "com.au", "co.jp", "github.io", "de", "fr", "es", "uk")
SAME, UNDER_SERVER, UNDER_TARGET = "same", "target_under_server", "server_under_target"


def normal_host(host: Column) -> Column:
    """Lower case without the closing dot; null where a label has a form that no host has."""
    plain = F.lower(F.regexp_replace(host, r"\.$", ""))
    return F.when(plain.rlike(r"^[a-z0-9_](?:[a-z0-9_-]{0,61}[a-z0-9_])?(?:\.[a-z0-9_](?:[a-z0-9_-]{0,61}[a-z0-9_])?)*$"), plain)


def host_relation(target: Column, server: Column, suffixes=PUBLIC_SUFFIXES) -> Column:
    """How two normal hosts relate, or null; a public suffix relates nothing, an address only to itself."""
    address = r"^[0-9.]+$"
    under = lambda a, b: F.endswith(a, F.concat(F.lit("."), b)) & ~b.isin(*suffixes) & ~a.rlike(address)
    return F.when(target == server, SAME).when(under(target, server), UNDER_SERVER).when(under(server, target), UNDER_TARGET)


def host_suffixes(host: Column) -> Column:
    """The host and its parents, most specific first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))


def provider_keys(host: Column, suffixes=PUBLIC_SUFFIXES, most: int = 4) -> Column:
    """Names to look a host up by: itself and its parents, down to the registrable domain."""
    return F.slice(F.filter(host_suffixes(host), lambda h: ~h.isin(*suffixes)), 1, most)


def template_pattern(template: Column) -> Column:
    """A path template as an anchored pattern: a parameter is one or more characters of one segment."""
    quoted = F.regexp_replace(template, r"([\\.\[\]()*+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\{[^{}]*\}", "[^/]+"), F.lit("$"))


def find_operations(requests: DataFrame, operations: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Requests (keys, request_id, method, path) with the operations (keys, method, template) they name.

    A template's segments with parameters are its mask.  A path is masked in each way
    that some template of its length has (there are few), and masked paths meet masked
    templates in an equi-join, so a path meets only templates with its own literal
    segments; what a segment holds besides its parameter is compared last.  A null
    method asks for any.  Where the operations' counted bytes are few, they come to the
    requests, as all requests may share their keys.
    """
    keys = keys or []
    segments = lambda c: F.split(c, "/")
    is_open = lambda s: F.contains(s, F.lit("{"))
    mask = F.array_join(F.transform(segments(F.col("template")), lambda s: F.when(is_open(s), "*").otherwise("=")), "")
    masked = F.array_join(F.transform(segments(F.col("template")), lambda s: F.when(is_open(s), "*").otherwise(s)), "/")
    offered = operations.select(
        *keys, F.col("method").alias("offered_method"), "template", F.size(segments(F.col("template"))).alias("segments"),
        mask.alias("mask"), masked.alias("masked"), template_pattern(F.col("template")).alias("pattern"),
    )
    of_keys = (F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in keys)
    size = operations.agg(F.coalesce(F.sum(sum(of_keys, 200 + 8 * F.octet_length("template"))), F.lit(0)).alias("n")).first()["n"]
    masks = offered.groupBy(*keys, "segments").agg(F.collect_set("mask").alias("masks"))
    asked = requests.withColumn("segments", F.size(segments(F.col("path")))).join(near(masks, size), [*keys, "segments"])
    asked = asked.withColumn("mask", F.explode("masks")).drop("masks")
    own = F.array_join(F.transform(segments(F.col("path")), lambda s, i: F.when(F.substr("mask", i + 1, F.lit(1)) == "*", "*").otherwise(s)), "/")
    return (
        asked.withColumn("masked", own)
        .join(near(offered, size), [*keys, "segments", "mask", "masked"])
        .where("(method IS NULL OR method = offered_method) AND path RLIKE pattern")
        .select(*keys, "request_id", F.col("offered_method").alias("method"), "path", "template")
    )


def verdict(checks: DataFrame) -> DataFrame:
    """One row for each candidate: any mismatch rejects (the first by rank names the code), any match confirms."""
    first = F.min_by("check", F.when(F.col("outcome") == "mismatch", F.col("rank")))
    confirming = F.col("check").isin("operation", "api_version", "product", "provenance") & (F.col("outcome") == "match")
    return checks.groupBy("request_id", "candidate").agg(
        first.alias("rejected_by"), F.max(F.when(confirming, 1).otherwise(0)).cast("boolean").alias("confirmed")
    )


def status(accepted: Column, confirmed: Column, rejected: Column, inaccessible: Column) -> Column:
    """What a search came to, from counts of its candidates."""
    return (
        F.when(accepted > 1, "ambiguous")
        .when((accepted == 1) & (confirmed == 1), "validated")
        .when(accepted == 1, "unconfirmed")
        .when(rejected > 0, "rejected")
        .when(inaccessible > 0, "inaccessible")
        .otherwise("not_found")
    )
