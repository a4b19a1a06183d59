"""Cases that every operator must stand: nulls, empty and very long texts, repeated rows, clashing columns, empty tables."""

import pytest
from pyspark.sql import functions as F

from keelson.llm import bpe, decontaminate, html_main, lang_cnn, license_scan, pii, quality_ledger, simhash

LONG = "A long text of the MIT License, and more words; " * 20_000
TEXTS = [(1, "The MIT License says hello to the world."), (2, None), (3, ""), (4, LONG), (1, "The MIT License says hello to the world."), (None, "x y z")]
#: Columns named like the operators' own working columns.
CLASHING = ("held", "prediction", "candidates", "measures", "won", "gram", "hash", "uses", "place", "bits", "phrase", "pair", "bad_id", "stays_id", "template")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return rows.withColumns({c: F.lit(7) for c in CLASHING}).withColumn("lang", F.lit("en"))


def net_of(docs):
    return lang_cnn.fit(docs.select("doc_id", "text", "lang"))


OPERATORS = {
    "simhash": lambda d: simhash.groups(d), "license": lambda d: license_scan.scan(d), "html": lambda d: html_main.extract(d, html="text", out="main"),
    "language": lambda d: lang_cnn.identify(d, net_of(d)), "pii": lambda d: pii.find(d), "redacted": lambda d: pii.redact(d), "quality": lambda d: quality_ledger.ledger(d),
    "bpe": lambda d: bpe.encode(d, {bytes([b]): b for b in range(256)}, r"(?s).{1,9}"),
    "decontaminate": lambda d: decontaminate.judge(d, d.select(F.lit(1).alias("item_id"), F.lit("more words a long text").alias("text")).limit(1)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_stay_as_many_and_equal_ones_equal(docs, name):
    out = OPERATORS[name](docs)
    got = [r.asDict(recursive=True) for r in out.collect()]
    assert len(got) == len(TEXTS)
    first = [r for r in got if r["doc_id"] == 1]
    assert len(first) == 2 and first[0] == first[1]
    if name in ("html", "language", "redacted", "quality", "bpe"):
        assert all(r[c] == 7 for r in got for c in CLASHING)
    by_id = {r["doc_id"]: r for r in got}
    long, none = by_id[4], by_id[2]
    if name == "license":
        assert (long["n_base"], long["n_words"], none["n_words"]) == (20_000, 200_000, 0)
    if name == "html":
        assert long["main"] == " ".join(LONG.split()) and none["main"] == ""
    if name == "language":
        assert (long["lang_pred"], none["lang_pred"]) == ("en", "und")
    if name == "pii":
        assert long["pii_spans"] == none["pii_spans"] == []
    if name == "bpe":
        assert bytes(long["token_ids"]) == LONG.encode() and none["token_ids"] == []
    if name == "decontaminate":
        assert long["n_hit"] == 5 * 19_999 and none["n_words"] == 0
    if name == "simhash":
        assert none["bits"] == by_id[3]["bits"] == 0 and none["component_id"] == 2


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(docs, name):
    assert OPERATORS[name](docs.limit(0)).count() == 0
