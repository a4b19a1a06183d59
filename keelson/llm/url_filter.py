"""Operator 2: URL filters, in DataFrame operations only.

A URL is expanded into its host suffixes (at dots) and, for each, its path prefixes of
the lengths that rules with so many labels have; these lengths come from a small
joined table, not from the driver.  Each expression's short hash prefix is equi-joined
with the rules'; the full digest is compared on what meets, and precedence decides.
Only distinct (host, path) pairs are judged, so a host that holds a third of all rows
costs no more than its distinct paths.

Precedence: the list of the least ``rank``; in it the longest rule (host and path
together), then the longer host, then ``block``, then the rule's text.

Cases: a null URL or one without ``://`` has an empty host and path and no rule
fits it; very long URLs are expanded at the lengths that rules have only; a rule listed twice in a list counts once, and of two actions for the same
rule ``block`` wins; rows with equal URLs get equal verdicts, repeated rows stay
repeated; extra columns of any other name pass through, clashing output names are
refused; empty tables of URLs or rules give empty results or the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import ascii_lower, fresh

#: Rules of up to so many bytes (their texts and BYTES_A_RULE for each) are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
BYTES_A_RULE = 200
#: Hex digits of the short hash prefix.
SHORT = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; null or no ``://``: empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def hash_rules(rules: DataFrame) -> DataFrame:
    """Rules (rule, host, path, action) with short and full digests; one row for each (rank, host, path)."""
    rank = F.col("rank") if "rank" in rules.columns else F.lit(0)
    return (
        rules.groupBy(rank.alias("rule_rank"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path"))
        .agg(F.max("action").alias("action"), F.min("rule").alias("rule"))
        .select(
            F.sha2(F.concat("rule_host", F.lit("\n"), "rule_path"), 256).alias("rule_digest"),
            F.size(F.split("rule_host", r"\.")).alias("labels"),
            F.length("rule_host").alias("host_length"),
            F.length("rule_path").alias("path_length"),
            "rule_rank", "rule", "action",
        )
        .withColumn("rule_short", F.left("rule_digest", F.lit(SHORT)))
    )


def rule_bytes(rules: DataFrame) -> tuple[int, int]:
    """How much memory a rule table takes, about, and its shapes: at most each number of labels with each length of path."""
    texts = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("rule", "host", "path")), F.lit(BYTES_A_RULE))
    deepest, longest = F.max(F.size(F.split("host", r"\."))), F.max(F.length("path"))
    found = rules.agg(F.coalesce(F.sum(texts), F.lit(0)).alias("n"), F.coalesce(deepest, F.lit(0)).alias("d"), F.coalesce(longest, F.lit(0)).alias("l")).first()
    return found["n"], BYTES_A_RULE * found["d"] + 8 * found["d"] * (found["l"] + 1)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule, rule_rank (null where no rule fits) and verdict.

    ``rules`` has rule, host, path, action (allow or block) and maybe rank (0 where it
    is missing).
    """
    clash = {c.lower() for c in pages.columns} & {"host", "path", "rule", "rule_rank", "verdict"}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")
    hashed = hash_rules(rules)
    # A row for each number of labels, with the lengths of paths: small however many rules there are, and never a key to shuffle by.
    shapes = hashed.groupBy("labels").agg(F.collect_set("path_length").alias("lengths"))
    of_rules, of_shapes = rule_bytes(rules)
    near = lambda df, size: F.broadcast(df) if size <= BROADCAST_BYTES else df
    split_urls = pages.withColumns({"host": host_of(F.col(f"`{url}`")), "path": path_of(F.col(f"`{url}`"))})
    expressions = (
        split_urls.select("host", "path")
        .distinct()
        .withColumn("labels", F.explode(F.sequence(F.lit(1), F.size(F.split("host", r"\.")))))
        .join(near(shapes, min(of_shapes, of_rules)), "labels")
        .withColumn("length", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))))
        .select(
            "host", "path",
            F.sha2(F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -F.col("labels")), F.lit("\n"), F.left("path", F.col("length"))), 256).alias("digest"),
        )
        .withColumn("short", F.left("digest", F.lit(SHORT)))
    )
    met = expressions.join(near(hashed, of_rules), F.col("short") == F.col("rule_short")).where("digest = rule_digest")
    order = F.struct(-F.col("rule_rank"), F.col("host_length") + F.col("path_length"), "host_length", "action", "rule")
    held = fresh("won", pages)
    won = met.groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_rank", "action"), order).alias(held))
    return split_urls.join(won, ["host", "path"], "left").select(
        *(F.col(f"`{c}`") for c in pages.columns), "host", "path", F.col(f"{held}.rule").alias("rule"),
        F.col(f"{held}.rule_rank").alias("rule_rank"), F.coalesce(F.col(f"{held}.action"), F.lit(default)).alias("verdict"),
    )
