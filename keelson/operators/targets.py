"""Hosts and targets as they are written: internationalised names, addresses, registrable domains.

Native throughout.  Suffix rules are a table in the form of the public suffix list
(``com``, ``*.ck``, ``!www.ck``); each host's suffixes meet it in an equi-join, and the
longest rule is an aggregate.  The table is broadcast if its counted bytes allow it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.operators.links import bound
from keelson.operators.matching import SAME, UNDER_SERVER, UNDER_TARGET
from keelson.operators.staging import near, staged

_LABEL = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
LONGEST_HOST = 253


def ipv6(text: Column) -> Column:
    """The compressed form of an IPv6 address (with its zone, if any), or null where it is none."""
    groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
    # A dotted end counts as two groups.
    dotted = F.transform(F.split(F.regexp_extract(text, r"([0-9.]*)(?:%.*)?$", 1), r"\."), lambda o: o.try_cast("int"))
    pair = lambda o, i: F.lower(F.hex(F.get(o, F.lit(i)) * 256 + F.get(o, F.lit(i + 1))))
    ends_dotted = F.regexp_extract(text, r":([0-9]+\.[0-9.]+)(?:%.*)?$", 1)
    zone = F.regexp_extract(text, "(%.*)$", 1)
    bare = F.regexp_replace(text, "%.*$", "")
    plain = F.when(ends_dotted == "", bare).when(ends_dotted.rlike(IPV4), F.concat(F.regexp_replace(bare, r"[0-9.]+$", ""), pair(dotted, 0), F.lit(":"), pair(dotted, 2)))
    one = lambda p: F.size(F.split(p, "::", -1))
    left, right = (lambda p: groups(F.get(F.split(p, "::", -1), F.lit(0)))), (lambda p: groups(F.coalesce(F.get(F.split(p, "::", -1), F.lit(1)), F.lit(""))))
    missing = lambda p: F.lit(8) - F.size(left(p)) - F.size(right(p))
    whole = lambda p: F.concat(left(p), F.array_repeat(F.lit("0"), F.greatest(missing(p), F.lit(0))), right(p))
    fits = lambda p: (
        p.rlike("^[0-9a-f:]+$") & F.contains(p, F.lit(":")) & ~p.rlike("[0-9a-f]{5}|:::") & (one(p) <= 2) & ~p.rlike("^:[^:]|[^:]:$")
        & F.when(one(p) == 2, missing(p) >= 1).otherwise(missing(p) == 0)
    )
    joined = lambda p: F.array_join(F.transform(whole(p), lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")

    def squeezed(full: Column) -> Column:
        """The longest run of two or more zeros, the first of equals, becomes two colons."""
        run = lambda n: r"(?:^|(?<=:))0(?::0){%d}(?=:|$)" % (n - 1)
        tidy = lambda n: F.regexp_replace(F.regexp_replace(full, f"^(.*?){run(n)}", "$1@"), ":?@:?", "::")
        return F.coalesce(*(F.when(full.rlike(run(n)), tidy(n)) for n in range(8, 1, -1)), full)

    def mapped(short: Column) -> Column:
        """An IPv4 address within is written as one."""
        half = lambda n: F.conv(F.regexp_extract(short, "^::ffff:([0-9a-f]+):([0-9a-f]+)$", n), 16, 10).cast("int")
        octets = lambda n: F.concat_ws(".", F.shiftright(half(n), 8), half(n) % 256)
        return F.when(short.rlike("^::ffff:[0-9a-f]+:[0-9a-f]+$"), F.concat(F.lit("::ffff:"), octets(1), F.lit("."), octets(2))).otherwise(short)

    found = bound(F.lower(plain), lambda p: F.when(fits(p), bound(bound(joined(p), squeezed), mapped)))
    return F.when(zone.isin("%") | F.contains(F.substr(zone, F.lit(2)), F.lit("%")), None).otherwise(F.concat(found, zone))


def ascii_host(host: Column) -> Column:
    """A host name in ASCII (IDNA 2003, as the JVM has it) and lower case, or null where a label has a form that no host has."""
    encoded = F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host))
    plain = lambda h: F.regexp_replace(h, r"\.$", "")
    return bound(encoded, lambda h: F.when(plain(h).rlike(rf"^{_LABEL}(?:\.{_LABEL})*$") & (F.length(plain(h)) <= LONGEST_HOST), h))


def normal_target(url: Column) -> Column:
    """struct(scheme, host, port, path, query, url, problem) of a target: an HTTP(S) URL, or a bare host, which means https.

    White space around it is dropped.  Rejected are what has spaces, control characters,
    backslashes, a fragment, a path without a scheme, another scheme, credentials, no
    host or one that can't be, and a port that is empty, no number or not in 1 to 65535.
    """

    def parts(target: Column) -> Column:
        bare = ~F.contains(target, F.lit("://"))
        whole = F.when(bare, F.concat(F.lit("https://"), target)).otherwise(target)
        scheme, authority = F.lower(F.regexp_extract(whole, "^([^:]*)://", 1)), F.regexp_extract(whole, "^[^:]*://([^/?#]*)", 1)
        place = F.regexp_extract(authority, "([^@]*)$", 1)
        bracketed = F.startswith(place, F.lit("["))
        name = F.when(bracketed, F.regexp_extract(place, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(place, "^([^:]*)", 1))
        after = F.when(bracketed, F.regexp_extract(place, r"^\[[^\]]*\](.*)$", 1)).otherwise(F.regexp_extract(place, "^[^:]*(.*)$", 1))
        number = F.regexp_extract(after, "^:([0-9]+)$", 1).try_cast("int")
        host = F.when(bracketed, ipv6(name)).when(name.rlike(IPV4), name).otherwise(ascii_host(name))
        path, query = F.regexp_extract(whole, "^[^:]*://[^/?#]*([^?#]*)", 1), F.regexp_extract(whole, r"^[^?]*(\?.*)$", 1)
        path = F.when(path == "", "/").otherwise(path)
        problem = (
            F.when(F.coalesce(target == "", F.lit(True)), "empty").when(target.rlike(r"[\x00-\x20\x7F\s]"), "control_characters").when(F.contains(target, F.lit("\\")), "backslash")
            .when(F.contains(target, F.lit("#")), "fragment").when(bare & target.rlike("[/?]"), "no_scheme").when(~scheme.isin("http", "https"), "scheme")
            .when(F.contains(authority, F.lit("@")), "credentials").when(name == "", "host").when((after != "") & ~F.coalesce(number.between(1, 65535), F.lit(False)), "port")
            .when(host.isNull(), "host")
        )
        shown = F.concat(scheme, F.lit("://"), F.when(bracketed, F.concat(F.lit("["), host, F.lit("]"))).otherwise(host), F.coalesce(F.concat(F.lit(":"), number.cast("string")), F.lit("")), path, F.when(query == "?", "").otherwise(query))
        return F.struct(
            scheme.alias("scheme"), host.alias("host"), number.alias("port"), path.alias("path"), F.regexp_replace(query, r"^\?", "").alias("query"),
            F.when(problem.isNull(), shown).alias("url"), problem.alias("problem"),
        )

    return bound(F.regexp_replace(url, r"^\s+|\s+$", ""), parts)


def suffix_rules(lines: DataFrame) -> DataFrame:
    """Rules (key, kind, size) of lines (rule) of a public suffix list; comments and blank lines are none.

    ``kind`` is plain, wildcard or exception; ``size`` is the number of labels of the
    suffix that it gives: an exception's is one less than its own.
    """
    rule = F.lower(F.regexp_extract("rule", r"^\s*(\S*)", 1))
    found = lines.select(rule.alias("rule")).where("rule <> '' AND NOT startswith(rule, '//')").distinct()
    key = F.regexp_replace("rule", r"^(?:!|\*\.)", "")
    kind = F.when(F.startswith("rule", F.lit("!")), "exception").when(F.startswith("rule", F.lit("*.")), "wildcard").otherwise("plain")
    labels = F.size(F.split(key, r"\."))
    return found.select(key.alias("key"), kind.alias("kind"), (labels + F.when(kind == "wildcard", 1).when(kind == "exception", -1).otherwise(0)).alias("size"))


def registrable_domains(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """host, suffix and domain (what an organisation can register; null where the host is a suffix) of each different host.

    The longest rule that fits gives the suffix, an exception before all; a host that no
    rule fits has its last label as suffix.  Addresses have neither.
    """
    labels = F.split(F.lower(F.regexp_replace(F.col(f"`{host}`"), r"\.$", "")), r"\.")
    known = hosts.select(F.col(f"`{host}`").alias("host"), labels.alias("labels")).where("host IS NOT NULL").distinct()
    tail = lambda n: F.array_join(F.slice("labels", F.size("labels") - n + 1, n), ".")
    candidates = known.select("host", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("n")).withColumn("key", tail(F.col("n")))
    rules = staged(rules)
    bytes_of = rules.agg(F.sum(F.octet_length("key") + 48)).head()[0] or 0
    met = candidates.join(near(rules, bytes_of), "key").where("size <= size(labels)")
    longest = met.groupBy(F.col("host").alias("its_host")).agg(F.max(F.when(F.col("kind") == "exception", F.col("size"))).alias("except"), F.max(F.when(F.col("kind") != "exception", F.col("size"))).alias("size"))
    found = known.join(longest, F.col("host") == F.col("its_host"), "left").withColumn("n", F.coalesce("except", "size", F.lit(1)))
    address = F.col("host").rlike(IPV4) | F.contains("host", F.lit(":"))
    return found.select(
        "host", F.when(~address, tail(F.col("n"))).alias("suffix"), F.when(~address & (F.size("labels") > F.col("n")), tail(F.col("n") + 1)).alias("domain")
    )


def host_relations(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """``pairs`` (target, server: hosts) with relation: same, or one below the other where that isn't a public suffix, or null."""
    both = pairs.select(F.explode(F.array("target", "server")).alias("host"))
    suffixes = staged(registrable_domains(both, rules).where("domain IS NULL AND suffix IS NOT NULL").select(F.col("host").alias("suffix_host")))
    of = lambda side: suffixes.select(F.col("suffix_host").alias(f"{side}_suffix"))
    size = 64 * suffixes.count()
    joined = pairs.join(near(of("target"), size), F.col("target") == F.col("target_suffix"), "left").join(near(of("server"), size), F.col("server") == F.col("server_suffix"), "left")
    address = lambda c: F.col(c).rlike(IPV4) | F.contains(F.col(c), F.lit(":"))
    under = lambda a, b: F.endswith(F.col(a), F.concat(F.lit("."), F.col(b))) & F.col(f"{b}_suffix").isNull() & ~address(a)
    relation = F.when(F.col("target") == F.col("server"), SAME).when(under("target", "server"), UNDER_SERVER).when(under("server", "target"), UNDER_TARGET)
    return joined.withColumn("relation", relation).drop("target_suffix", "server_suffix")
