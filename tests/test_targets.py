"""Targets, addresses and registrable domains against Python's own."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from keelson.operators import targets


def test_ipv6_is_that_of_the_standard_library(spark):
    rng = random.Random(4)
    group = lambda: rng.choice(["0", "0", "0", "00", "a", "0b1", "FFFF", "10"])
    texts = [":".join(group() for _ in range(8)) for _ in range(150)]
    for _ in range(250):
        n = rng.randrange(0, 9)
        k = rng.randrange(0, n + 1)
        texts.append(":".join(group() for _ in range(k)) + "::" + ":".join(group() for _ in range(n - k)))
    texts += ["::", "::1", "1::", ":::", "1:::2", "1::2::3", ":1::2", "1::2:", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.256", "::01.2.3.4", "1.2.3.4", "12345::", "g::", "", "fe80::1%eth0", "fe80::1%", "1:2:3:4:5:6:7:8:9", "::1.2.3", "1.2.3.4::"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", targets.ipv6(F.col("t")).alias("found")).collect()

    def plain(text):
        try:
            return ipaddress.IPv6Address(text).compressed.lower()
        except ValueError:
            return None

    assert [(r.t, r.found) for r in rows] == [(t, plain(t)) for t in texts]


@pytest.mark.parametrize(
    "host, found",
    [("Example.COM", "example.com"), ("bücher.example", "xn--bcher-kva.example"), ("faß.de", "fass.de"), ("例え.jp", "xn--r8jz45g.jp"), ("a_b.com", None), ("-a.com", None), ("a..b", None), ("x" * 64 + ".com", None), ("a.com.", "a.com."), ("", None)],
)
def test_names_in_ascii(spark, host, found):
    assert spark.createDataFrame([(host,)], "h string").select(targets.ascii_host(F.col("h"))).head()[0] == found


def test_targets(spark):
    cases = {
        " a.com ": ("https://a.com/", None), "a.com:8080": ("https://a.com:8080/", None), "a.com/x": (None, "no_scheme"), "http://a.com:99999": (None, "port"), "http://a.com:": (None, "port"), "http://a.com:x1": (None, "port"),
        "HTTPS://A.com?q": ("https://a.com/?q", None), "http://[::0]:8/p": ("http://[::]:8/p", None), "http://[::g]": (None, "host"), "http://": (None, "host"), "": (None, "empty"), None: (None, "empty"), "a b": (None, "control_characters"),
        "http://u:p@a.com": (None, "credentials"), "x\\y": (None, "backslash"), "http://a.com/#": (None, "fragment"), "file:///a": (None, "scheme"), "http://a.com:0080/": ("http://a.com:80/", None),
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select(targets.normal_target(F.col("u")).alias("t")).collect()
    assert {u: (r.t.url, r.t.problem) for u, r in zip(cases, rows)} == cases


def test_suffix_rules(spark):
    lines = ["// a comment", "", "com", "*.ck", "!www.ck", "co.uk // trailing", "uk", "*.kawasaki.jp", "!city.kawasaki.jp", "jp", "github.io", "io"]
    want = {
        "api.acme.co.uk": "acme.co.uk", "co.uk": None, "github.io": None, "someone.github.io": "someone.github.io", "ck": None, "a.ck": None, "b.a.ck": "b.a.ck", "www.ck": "www.ck", "x.www.ck": "www.ck",
        "a.kawasaki.jp": None, "b.a.kawasaki.jp": "b.a.kawasaki.jp", "x.city.kawasaki.jp": "city.kawasaki.jp", "kawasaki.jp": "kawasaki.jp", "a.b.unlisted": "b.unlisted", "unlisted": None, "Acme.Com.": "acme.com", "1.2.3.4": None, "::1": None,
    }
    rules = targets.suffix_rules(spark.createDataFrame([(x,) for x in lines], "rule string"))
    hosts = spark.createDataFrame([(h,) for h in want], "host string")
    assert {r.host: r.domain for r in targets.registrable_domains(hosts, rules).collect()} == want
    pairs = spark.createDataFrame([("a.co.uk", "co.uk"), ("x.a.co.uk", "a.co.uk"), ("a.com", "x.a.com"), ("u.github.io", "github.io"), ("1.2.3.4", "2.3.4"), ("a.com", "a.com")], "target string, server string")
    assert {(r.target, r.server): r.relation for r in targets.host_relations(pairs, rules).collect()} == {
        ("a.co.uk", "co.uk"): None, ("x.a.co.uk", "a.co.uk"): "target_under_server", ("a.com", "x.a.com"): "server_under_target", ("u.github.io", "github.io"): None, ("1.2.3.4", "2.3.4"): None, ("a.com", "a.com"): "same",
    }
