import pickle
import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keelson.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card":
                ds = [int(d) for d in reversed(digits)]
                total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(ds))
                if not 14 <= len(ds) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((kind, *m.span()))
    return sorted(found, key=lambda x: (x[1], list(PLAIN).index(x[0])))


@pytest.mark.parametrize("alphabet", ["a@.b", "a@.b-%+", "12.", "1 2-.3", "+1 (2)-.3 ", "+12345 67890-", "é1@a.+ -\n"])
def test_base_spans_are_the_plain_ones(alphabet):
    rng = random.Random(alphabet)
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == plain(text), text


def test_planted_spans_and_long_runs():
    text = "x 34@mail7.example.com, 97.51.17.173 is 4111 1111-1111 1111 or +1 (017) 555-7713."
    assert [s[0] for s in pii.base_spans(text)] == ["email", "ip", "card", "phone"] == [s[0] for s in plain(text)]
    for run in ("1" * 200_000, "a" * 200_000 + " @", "+" * 50_000, "1." * 100_000, "@a" * 50_000):
        pii.candidates(run)


def test_em_finds_the_unreliable_labeler():
    counts = {"card|++0+0+": 500, "card|+++00+": 80, "card|0-00--": 400, "card|0-000-": 300, "iban|++++0+": 20}
    soft = pii.estimate(counts)
    assert soft["card|++0+0+"] > 0.9 and soft["card|0-00--"] < 0.1
    counts = {f"{k}|2 1ssw": n for k, n in counts.items()}
    model = pii.train(counts)
    assert model["iban|++++0+|2 1ssw"] > 0.5 > model["card|0-000-|2 1ssw"]


def test_spans_of_equal_votes_differ_by_their_features():
    counts = {"card|+++00+|2 1ssw": 500, "card|0-00--|2m1ddd": 400, "name|0000++|10lssw": 30, "name|0000++|1m1ddd": 30}
    model = pii.train(counts)
    assert model["name|0000++|10lssw"] > 5 * model["name|0000++|1m1ddd"]


def test_planted_spans_of_the_smallest_tables(spark):
    """The query itself: counts, digest and spans against the plain patterns; planted secrets and numbers are found."""
    from keelson.llm import entries

    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text or "" for r in rows}
    got = {r.doc_id: r for r in entries.op9_pii(spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == set(texts)
    secrets = 0
    for k, r in got.items():
        base = plain(texts[k])
        kinds = Counter(kind for kind, _, _ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[x] for x in PLAIN)
        joined = ",".join(f"{kind}:{a}:{b}" for kind, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert {tuple(map(str, x)) for x in base} <= {tuple(x) for x in spans}
        for m in re.finditer(r'token = "([0-9a-f]{40})"', texts[k]):
            secrets += 1
            assert ["secret", str(m.start(1)), str(m.end(1))] in spans
        assert base or all(x[0] in ("secret", "birth", "name", "card", "phone", "iban", "ssn", "email") for x in spans)
    assert secrets
    assert pii.train({}) == {}


def test_query_shape_and_redaction(spark):
    rows = [(1, "mail a.b@c.de now", 17, "q"), (2, None, None, "q"), (3, "", 0, "q"), (4, "é +1 (017) 555-7713 x", 21, "q"), (1, "mail a.b@c.de now", 17, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, kind string")
    found = {r.doc_id: [tuple(s)[:3] for s in r.pii_spans] for r in pii.find(docs).collect()}
    assert found == {1: [("email", 5, 13)], 2: [], 3: [], 4: [("phone", 2, 19)]}
    assert pii.find(docs).columns == ["doc_id", "n_chars", "kind", "pii_spans"]
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.dtypes == docs.dtypes
    assert sorted(map(tuple, clean.collect()), key=str) == sorted(
        [(1, "mail <EMAIL> now", 16, "q")] * 2 + [(2, None, None, "q"), (3, "", 0, "q"), (4, "é <PHONE> x", 11, "q")], key=str
    )
    assert pii.find(docs.limit(0)).count() == 0


def test_added_spans_keep_clear_of_base_ones(spark):
    text = "tel (017) 555-7713 and GB82 WEST 1234 5698 7654 32, born 12.03.1984; card 4111111111111112 but 4111111111111111"
    found = pii.candidates(text)
    base = [(a, b) for _, a, b, is_base, _ in found if is_base]
    assert {c[0] for c in found} >= {"phone", "iban", "birth", "card"}
    for _, a, b, is_base, _ in found:
        assert is_base or all(b <= x or y <= a for x, y in base)


def test_overlapping_candidates_are_judged_before_they_bar_each_other():
    card, ssn = "4111 1111 1111 1111", "123-45-6789"
    texts = {
        f"card {card} 123": ("card", card), "card 4111-1111-1111-1111 12": ("card", "4111-1111-1111-1111"),
        f"card 12 {card}": ("card", card), f"card 1234 {card}": ("card", card), f"card {card} 1234": ("card", card),
        "card 3782 822463 10005 1234": ("card", "3782 822463 10005"), f"ssn {ssn} 2020-01-01": ("ssn", ssn),
    }
    counts = Counter(c[4] for t in [*texts, "order 1234 5678 9012 3456 78", "born 2020-01-01"] * 20 for c in pii.candidates(t))
    model = pii.train(counts)
    for text, (kind, want) in texts.items():
        assert kind not in {s[0] for s in pii.base_spans(text)}, text
        found = pii.accepted(pii.candidates(text), model)
        assert (kind, want) in {(k, text[a:b]) for k, a, b, _ in found}, text
        assert all(a[2] <= b[1] for a, b in zip(found, found[1:]))
        assert want not in pii.redact_text(text, [c[:4] for c in pii.judged(pii.candidates(text), model)])


def test_of_accepted_ones_that_overlap_the_most_probable_stays():
    text = "card 1234 4111 1111 1111 1111"
    found = {text[a:b]: pattern for _, a, b, _, pattern in pii.candidates(text)}
    assert set(found) == {"1234 4111 1111 1111", "4111 1111 1111 1111"}
    model = {found["1234 4111 1111 1111"]: 0.6, found["4111 1111 1111 1111"]: 0.9}
    assert [text[a:b] for _, a, b, _ in pii.accepted(pii.candidates(text), model)] == ["4111 1111 1111 1111"]
    assert pii.redact_text(text, [c[:4] for c in pii.judged(pii.candidates(text), model)]) == "card <CARD>"


def test_nothing_is_added_inside_a_long_base_span():
    """An e-mail whose local part holds thirty addresses, and then what looks like a number of another kind."""
    text = "_".join(f"10.0.{i}.1" for i in range(30)) + "_123-45-6789@example.com"
    base = [(a, b) for kind, a, b in pii.base_spans(text) if kind == "email"]
    assert base == [(0, len(text))]
    assert all(is_base for _, _, _, is_base, _ in pii.candidates(text))


@pytest.mark.parametrize(
    "text, want",
    [
        ("api_key=" + "aB3" * 50, "aB3" * 50), ("token: " + "x9_" * 4000, "x9_" * 4000),
        ("auth token: eyJhbGci0i.eyJzdWIi1.SflKxw2", "eyJhbGci0i.eyJzdWIi1.SflKxw2"), ("Bearer eyJhbGci0i.eyJzdWIi1.SflKxw2 sent", "eyJhbGci0i.eyJzdWIi1.SflKxw2"),
        ("password: hunter2.", "hunter2"), ("Password = 'p@ss!w0rd#' ok", "p@ss!w0rd#"), ("sk-" + "a1B2" * 60, "sk-" + "a1B2" * 60), ("pwd: correcthorsebattery", "correcthorsebattery"),
    ],
)
def test_secrets_are_whole_runs_of_any_length(text, want):
    assert want in [text[a:b] for kind, a, b in pii.loose_spans(text) if kind == "secret"]


def test_words_after_a_colon_are_no_secrets():
    assert not [s for s in pii.loose_spans("The password: please ask. Token: none. Key: see below. url: https://a.b/c1") if s[0] == "secret"]


def test_the_model_is_sent_as_weights_and_judges_unseen_patterns():
    counts = {"name|0000++|10lssw": 50, "name|0000-+|10lssw": 40, "iban|++++0+|2 1ssw": 30, "card|0-000-|2 1ssw": 20}
    model = pii.train(counts)
    known = {p: model[p] for p in counts}
    sent = pickle.loads(pickle.dumps(model))
    assert len(sent) == 0 and {p: sent[p] for p in counts} == known and 0 < sent["ssn|+++00+|1-hssw"] < 1
