"""WARC, language, quality and the pipeline."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from keelson.llm import lang_cnn, quality_ledger, warc


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/é b", "<p>x</p>", 0), (2, None, "<p>x</p>", 0), (3, "u", None, 0), (4, "u\r\nX: y", "", 0), (None, "u", "<p>x</p>", 0), (5, "u", "é" * 100_000, 0), (2, "v", "<p>x</p>", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int").repartition(3)
    folder = f"{tmp_path}/archives"
    index = warc.write(pages, folder)
    got = warc.read(index, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h for i, _, h, _ in rows if i == r.page_id) or ""
        peers = [i for i, _, h, _ in rows if (h or "") == html and i is not None]
        kind = ("response", None) if r.page_id == max(peers) else ("revisit", max(peers))
        assert (r.read_type, r.read_refers_to) == kind == (r.record_type, r.refers_to)
        assert r.read_digest == warc.digest_of(html.encode()) and r.read_bytes == len(html.encode())
        assert kind[0] == "revisit" or bytes(r.payload) == html.encode()
    assert warc.unmatched_revisits(warc.read(index, folder)).count() == 0
    assert warc.unmatched_revisits(warc.read(index.where("record_type = 'revisit'"), folder)).count() == sum(r.record_type == "revisit" for r in got)
    ids = set()
    for archive in {r.archive for r in got}:
        raw = open(archive, "rb").read()
        for r in (x for x in got if x.archive == archive):
            fields, n, _ = warc.parse(raw[r.offset : r.offset + r.length])
            ids.add(fields["warc-record-id"])
            assert n == r.read_bytes and ("warc-refers-to-target-uri" in fields) == (r.read_type == "revisit")
    assert len(ids) == len(rows)
    some = warc.read(index.where("page_id = 5"), folder).collect()
    assert len(some) == 1 and hashlib.sha1(some[0].payload).digest() == hashlib.sha1(rows[5][2].encode()).digest()
    assert warc.write(pages.limit(0), f"{tmp_path}/none").count() == 0


def test_ranges_are_coalesced():
    reads = list(warc.spans([(0, 10), (10, 5), (100_000, 5), (100_005, 9 << 20), (100_005 + (9 << 20), 1)]))
    assert [(a, b, n) for a, b, n in reads][0] == (0, 15, [0, 1])
    assert sum(len(n) for _, _, n in reads) == 5 and all(b - a <= warc.READ or len(n) == 1 for a, b, n in reads)


def test_language(spark, monkeypatch):
    rng = random.Random(1)
    syllables = {"xx": ["ka", "to", "mi"], "yy": ["schu", "ber", "ung"], "zz": ["ça", "été", "où"]}
    say = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=2)) for _ in range(n))
    rows = [(i, say(lang, rng.randrange(3, 200)), lang) for i, lang in enumerate(rng.choices(list(syllables), k=400))]
    odd = [(1000, None, "xx"), (1001, "", None), (1002, "123 !", "yy"), (1003, say("zz", 3000), None), (None, say("xx", 30), None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    net = lang_cnn.fit(docs)
    got = {r.doc_id: r for r in lang_cnn.identify(docs, net).collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 50 and sum(got[i].lang_pred == lang for i, lang in held) >= 0.98 * len(held)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "zz", "xx"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in lang_cnn.identify(docs.drop("lang"), None).collect()} == {"und"}
    assert lang_cnn.fit(docs.where("lang IS NULL")) is None and lang_cnn.identify(docs.limit(0), net).count() == 0
    # The held-out fold is never learned from: other labels there change nothing.
    spoiled = docs.withColumn("lang", F.when(lang_cnn.fold(F.col("doc_id")) == 2, "xx").otherwise(F.col("lang")))
    again = lang_cnn.fit(spoiled)
    assert all((a == b).all() for a, b in zip(net.filters, again.filters))


def test_language_of_the_smallest_tables(spark):
    """Held-out accuracy on real rows; columns named like the working ones pass through."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert_docs = docs.withColumn("prediction", F.lit(1))
    found = lang_cnn.identify(assert_docs, lang_cnn.fit(docs)).where((lang_cnn.fold(F.col("doc_id")) == 2) & F.col("lang").isNotNull())
    right, n = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert n > 100 and right >= 0.97 * n


#: Digests of what was published; a change of a rule needs a new policy version (prose-1 is as of its last change).
POLICY_DIGESTS = {"base-1": "c74cd54833f29d94", "prose-1": "b67de99ff1bedfe7"}


def test_published_policies_stay():
    """A policy's version stands for its mask and for the text of the rules it enforces."""
    def digest(version):
        rules = [f"{r.bit} {r.name} {r.fails}" for r in quality_ledger.RULES if quality_ledger.POLICIES[version] >> r.bit & 1]
        return hashlib.sha256("\n".join(rules).encode()).hexdigest()[:16]

    assert {v: digest(v) for v in quality_ledger.POLICIES} == POLICY_DIGESTS


def plain_measures(text):
    text = text or ""
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


@pytest.mark.parametrize("alphabet", ["ab ", "a b\n", "é#|\x0b\x1c\xa0 a\n", "A!b \r\n"])
def test_measures(alphabet):
    rng = random.Random(alphabet)
    for _ in range(150):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(80)))
        assert quality_ledger.measure(text)[:5] == plain_measures(text), text
    assert quality_ledger.measure(None) == (0,) * 9


def test_ledger_policies_and_ablation(spark):
    clean = " ".join(f"word{i} of{i} a{i} sentence{i}" for i in range(40)) + "."
    texts = [clean, "few words", ("same thing " * 40), clean.replace(" ", " ### "), clean.upper(), None, clean]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    entries = quality_ledger.ledger(docs).cache()
    kept = [r.doc_id for r in entries.where(quality_ledger.passes("prose-1")).orderBy("doc_id").collect()]
    assert kept == [0, 6]
    for row in quality_ledger.ablation(entries, "prose-1").collect():
        bit = next(r.bit for r in quality_ledger.RULES if r.name == row.rule)
        bits = [r.failed_bits for r in entries.collect()]
        assert row.n_kept == 2 and row.n_fail == sum(b >> bit & 1 for b in bits)
        assert row.n_kept_without == sum(b & ~(1 << bit) == 0 for b in bits)
    none = quality_ledger.ablation(entries.limit(0), "prose-1").collect()
    assert len(none) == len(quality_ledger.RULES) and all(r.n_fail == r.n_fail_only_this == r.n_kept == r.n_kept_without == 0 for r in none)
    assert quality_ledger.ledger(docs.withColumn("measures", F.lit(1))).where("measures = 1").count() == len(texts)
    with pytest.raises(ValueError):
        quality_ledger.ledger(docs.withColumnRenamed("doc_id", "N_Words"))


def test_pipeline_against_plain_versions(spark):
    """Each stage on the smallest table: what it keeps, and that it keeps it whole."""
    import public_tokenizers
    import tiktoken
    from test_native import plain_contamination
    from test_pii import plain
    from test_simhash import plain_groups, plain_print

    import corpus_pipeline as pipeline
    from keelson.llm import bpe

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "q", None), (9002, "12 34", "en", "q", 5)], docs.schema)
    docs = docs.unionByName(odd)
    seen = [docs]
    for name, stage in pipeline.STAGES:
        out = stage(spark, seen[-1], sf)
        seen.append(out.cache())
        assert name == "token_ids" or (out.columns == docs.columns and out.dtypes == docs.dtypes)
    kept = [{r.doc_id: r for r in x.collect()} for x in seen]
    assert kept[1] == {k: v for k, v in kept[0].items() if k < 9000}
    ids = sorted(kept[1])
    classes = plain_groups([plain_print(kept[1][i].text) for i in ids])
    assert set(kept[2]) == {ids[c] for c in set(classes)} and all(kept[2][k] == kept[1][k] for k in kept[2])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(kept[3]) == {k for k, r in kept[2].items() if not plain_contamination(r.text, items)[-1]}
    assert set(kept[4]) == set(kept[3])
    for k, r in kept[4].items():
        assert not plain(r.text) and r.n_chars == len(r.text)
        assert plain(kept[3][k].text) or r.text == kept[3][k].text
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coder = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for k, r in kept[5].items():
        assert r.token_ids == coder.encode_ordinary(kept[4][k].text)
        assert r.decoded_sha256 == hashlib.sha256(kept[4][k].text.encode()).hexdigest()
