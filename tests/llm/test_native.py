"""URL filters, license scans and decontamination against plain versions."""

import random
import re

import pytest

from keelson.llm import decontaminate, license_scan, url_filter
from keelson.llm.entries import BASE_RULES, _rules

URLS = [
    None, "", "no scheme", "http://", "http://x.NET", "http://x.net/", "HTTP://A.Example.NET/en/1?x", "http://example.net/english/", "http://example.net/en/",
    "x://y.example.com/de/a#b", "http://xexample.com/de/", "http://org/fr/", "http://a.b.org/fr/x", "http://a.org/de/", "http://net.", "a://b?c://d.net/", "http://é.net/en/",
    "http://x.net/", "//x.net/", "q\n://x.net/a\nb",
]


def plain_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, a) for h, p, a in BASE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("limit", [10**9, 0])
def test_url_filter(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", limit)
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(URLS)], "page_id long, url string, short int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, _rules(spark, BASE_RULES)).collect()}
    assert got == {i: plain_verdict(u) for i, u in enumerate(URLS)}
    assert url_filter.judge(pages.limit(0), _rules(spark, BASE_RULES)).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, _rules(spark, ())).collect()} == {"allow"}
    with pytest.raises(ValueError):
        url_filter.judge(pages.withColumnRenamed("short", "Rule"), _rules(spark, BASE_RULES))


def test_url_precedence_and_clashes(spark):
    rules = [("a.b/", "a.b", "/", "allow"), ("b/xx", "b", "/xx", "block"), ("c/", "c", "/", "allow"), ("c/", "c", "/", "block")]
    rules = spark.createDataFrame(rules, "rule string, host string, path string, action string")
    pages = spark.createDataFrame([("http://a.b/xx", 1, 2), ("http://c/", 3, 4), ("http://d/", 5, 6)], "url string, won int, digest int")
    got = {r.url: (r.won, r.digest, r.rule, r.verdict) for r in url_filter.judge(pages, rules, default="none").collect()}
    assert got == {"http://a.b/xx": (1, 2, "a.b/", "allow"), "http://c/": (3, 4, "c/", "block"), "http://d/": (5, 6, None, "none")}
    ranked = rules.selectExpr("*", "CASE host WHEN 'b' THEN 0 ELSE 1 END AS rank")
    assert {r.url: r.rule for r in url_filter.judge(pages, ranked).collect()}["http://a.b/xx"] == "b/xx"


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered) if w]


LICENSES = [
    None, "", "MIT", "The MIT License. mit-license", "Apache License apache  license, Version 2.0", "general public license general public licence",
    "É Licensed under CC BY-NC 4.0.", "Permission is hereby granted, free of charge, to any one person obtaining a copy of this software and associated documentation files",
    "mit é license", "GENERAL PUBLIC general public license", "The MIT License. mit-license",
]


def test_license_scan(spark):
    rows = [(i, t) for i, t in enumerate(LICENSES)] + [(3, LICENSES[3]), (None, LICENSES[3])]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for row in got:
        words = words_of(LICENSES[3 if row.doc_id is None else row.doc_id])
        places = [(i, label) for phrase, label in license_scan.BASE_PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in places]
        assert (row.n_words, row.n_base, row.first_word, row.last_word) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert row.base_labels == ",".join(sorted({x for _, x in places})) and set(row.base_labels.split(",")) <= {*row.labels.split(","), ""}
        assert 0 <= row.score <= 1
    labels = {r.doc_id: r.labels for r in got}
    assert labels[6] == "cc-by-nc" and labels[7] == "mit" and labels[8] == "" and labels[4] == "apache"
    assert [r.score for r in got if r.doc_id == 6] == [1.0]
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_notices(text):
    """Labels of notices: some stretch where enough of the template's words stand on grams at their places, up to the drift."""
    words, found = words_of(text), set()
    for phrase, label in license_scan.NOTICES:
        own = phrase.split()
        width = min(license_scan.GRAM, len(own))
        at = {}
        for i in range(len(words) - width + 1):
            for j in range(len(own) - width + 1):
                if words[i : i + width] == own[j : j + width]:
                    at.setdefault(i - j, set()).add(j)
        for d in at:
            near = [x for e in at if abs(d - e) <= license_scan.DRIFT for x in at[e]]
            best = all(len(at[d]) >= len(at[e]) for e in at if abs(d - e) <= license_scan.DRIFT)
            if best and len({j + k for j in near for k in range(width)}) >= license_scan.COVER * len(own):
                found.add(label)
    return found


def test_notices_against_a_plain_version(spark):
    rng = random.Random(3)
    texts = ["licensed under cc by cc by 4", "Licensed under CC BY 4.0", None, "x " * 3000 + "licensed under cc by sa 4 0"]
    for phrase, _ in license_scan.NOTICES * 3:
        own = phrase.split()
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(own))
            own[at : at + rng.randrange(2)] = rng.choice(([], ["one"], ["of", "the"]))
        texts.append("so " * rng.randrange(3) + " ".join(own) + " and more")
    docs = spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)], "doc_id long, text string, gram string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    base = {label for _, label in license_scan.BASE_PHRASES}
    for i, text in enumerate(texts):
        wanted = plain_notices(text) | set(got[i].base_labels.split(",")) - {""}
        assert set(got[i].labels.split(",")) - {""} == wanted, (text, base)
    assert got[0].labels == "" and got[1].labels == "cc-by" and got[3].labels == "cc-by-sa"


def plain_contamination(text, items, width=13):
    words = words_of(text)
    hit, names = set(), set()
    for name, item in items:
        own = words_of(item)
        span = min(width, len(own))
        for s in range(len(own) - span + 1 if own else 0):
            for i in range(len(words) - span + 1):
                if words[i : i + span] == own[s : s + span]:
                    hit |= set(range(i, i + span))
                    names.add(str(name))
    return len(words), len(hit), len(names), ",".join(sorted(names)), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("limit", [10**9, -1])
def test_decontamination(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    rng = random.Random(8)
    vocabulary = ["a", "b", "c", "d", "é", "Éa"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, say(20)), (10, say(13)), (2, say(5)), (3, "a"), (4, None), (5, "..."), (2, say(14)), (7, "zz not there")]
    docs = [(i, say(rng.randrange(60))) for i in range(25)]
    docs += [(100, items[0][1].upper() + " x " + items[1][1]), (101, None), (102, ""), (103, "q " * 900 + items[0][1]), (100, items[0][1]), (None, items[1][1])]
    docs += [docs[-3], (104, items[0][1] + " " + items[0][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(str((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated)) for r in decontaminate.judge(frame, benchmark).collect())
    assert got == sorted(str((i, *plain_contamination(t, items))) for i, t in docs)
    kept = decontaminate.clean(frame.selectExpr("*", "1 AS bad_id"), benchmark)
    assert sorted(map(str, kept.collect())) == sorted(f"Row(doc_id={i}, text={t!r}, bad_id=1)" for i, t in docs if not plain_contamination(t, items)[-1])
    assert decontaminate.judge(frame.limit(0), benchmark).count() == 0
    assert decontaminate.judge(frame, benchmark.limit(0)).where("contaminated OR n_hit > 0").count() == 0


def plain_near(text, items, counts, slop, width=13):
    """(item, phrases met) by the two rarest words that the corpus has, tried at all their places."""
    words, found = words_of(text), {}
    for name, item in items:
        own = words_of(item)
        span = min(width, len(own))
        met = set()
        for s in range(len(own) - span + 1 if own else 0):
            phrase = own[s : s + span]
            ranked = sorted((counts[w], w, at) for at, w in enumerate(phrase) if w in counts)
            if len(ranked) > 1:
                (_, a, i), (_, b, j) = ranked[:2]
                places = [(p, q) for p, w in enumerate(words) if w == a for q, v in enumerate(words) if v == b]
                if any(abs((q - j) - (p - i)) <= slop for p, q in places):
                    met.add(tuple(phrase))
        if met:
            found[str(name)] = len(met)
    return found


@pytest.mark.parametrize("slop", [0, 2])
def test_proximity(spark, slop):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice("xy") for _ in range(n))
    items = [(1, "one two three four five"), (2, say(16)), (3, say(13) + " nowhere"), (4, "five"), (5, "one two three four five")]
    docs = [(1, items[0][1]), (2, "one two x three four five"), (3, "five x x x x x four three two one"), (4, None), (5, items[1][1].replace("a", "z"))]
    docs += [(6, items[2][1].replace(" nowhere", " here")), (7, "one two three q five")] + [(i, say(40)) for i in range(10, 20)]
    counts = {}
    for _, text in docs:
        for w in words_of(text):
            counts[w] = counts.get(w, 0) + 1
    names = {w for _, t in items for w in words_of(t)}
    counts = {w: n for w, n in counts.items() if w in names}
    frame, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in decontaminate.near_items(frame, benchmark, slop).collect():
        got.setdefault(r.doc_id, {})[r.item_id] = r.n
    assert got == {i: near for i, t in docs if (near := plain_near(t, items, counts, slop))}
    assert {"1", "5"} <= set(got[1]) and "3" in got[6] and (slop == 0 or "1" in got[2])


def exchanges(df):
    """The columns that each exchange of a plan moves, with its keys."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [x for x in plan.split("\n\n") if re.search(r"^\(\d+\) Exchange", x.strip())]


def test_rare_words_that_are_many_dont_shuffle_texts_by_word(spark, monkeypatch):
    """Beyond the bound, what is joined by word is bare; texts move once, by their key."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    plans, settle = [], decontaminate.settle
    monkeypatch.setattr(decontaminate, "settle", lambda df: plans.extend(exchanges(df)) or settle(df))
    frame = spark.createDataFrame([(1, "one two three four"), (2, "two three")], "doc_id long, text string")
    decontaminate.judge(frame, spark.createDataFrame([(1, "two three")], "item_id long, text string")).collect()
    by_term = [x for x in plans if re.search(r"hashpartitioning\(term", x)]
    assert by_term and not [x for x in by_term if re.search(r"\bwords#", x)]


def test_many_rules_dont_shuffle_by_labels(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 1000)
    rules = spark.createDataFrame([(f"h{k}.org/", f"h{k}.org", "/", "block") for k in range(50)], "rule string, host string, path string, action string")
    pages = spark.createDataFrame([(1, "http://a.h3.org/x"), (2, "http://h9.com/")], "page_id long, url string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # what isn't hinted is shuffled, as large rules would be
    try:
        judged = url_filter.judge(pages, rules)
        moved = exchanges(judged)
        found = sorted((r.page_id, r.verdict) for r in judged.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Rules are aggregated by their number of labels; URLs are never dealt by it.
    by_labels = [x for x in moved if "hashpartitioning(labels" in x]
    assert moved and not [x for x in by_labels if re.search(r"\bhost#", x)]
    assert found == [(1, "block"), (2, "allow")]
