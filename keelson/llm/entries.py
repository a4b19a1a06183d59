"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import bpe, decontaminate, html_main, lang_cnn, license_scan, merkle, pii, quality_ledger, simhash, suffix_dedup, url_filter, vector_codes, warc
from keelson.llm.common import ascii_lower, table

#: Operator 2: the base rules, as (host, path, action).
BASE_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: Operator 2: the method's own list; it judges only where no base rule fits.
OWN_RULES = (("casino-win.example.com", "/", "block"), ("cheap-pills.example.com", "/", "block"))


def _rules(spark: SparkSession, *lists) -> DataFrame:
    """Rules of lists in the order of their precedence, as a table."""
    return spark.createDataFrame(
        [(h + p, h, p, a, rank) for rank, rules in enumerate(lists) for h, p, a in rules],
        "rule string, host string, path string, action string, rank int",
    )


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_of(F.col("bits")).alias("fingerprint"), "component_id")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge(pages, _rules(spark, BASE_RULES, OWN_RULES))
    return judged.select("page_id", "host", "path", F.when(F.col("rule_rank") == 0, F.col("rule")).alias("rule"), "verdict")


def op3_byte_bpe(spark: SparkSession, sf_dir: str, rank_file: str | None = None) -> DataFrame:
    ranks = bpe.load_ranks(rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, ranks, public_tokenizers.PATTERN).drop("text")
    return bpe.decode(ids, ranks).select("doc_id", *bpe.digests())


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_main.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


def op6_warc(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    folder = folder or warc.new_folder(spark)
    index = warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(index, folder, payloads=False).select(
        "page_id", F.col("read_bytes").alias("payload_bytes"), F.col("read_digest").alias("payload_digest"),
        F.col("read_type").alias("record_type"), F.col("read_refers_to").alias("refers_to"),
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = decontaminate.judge(docs, table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated"
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = lang_cnn.fit(docs)
    held_out = F.coalesce(lang_cnn.fold(F.col("doc_id")) == lang_cnn.HELD_OUT_FOLD, F.lit(False))
    return lang_cnn.identify(docs.select("doc_id", "text"), net).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii_spans", lambda s: s["is_base"])
    kinds = F.transform(base, lambda s: s["kind"])
    of_kind = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select(
        "doc_id", *of_kind, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("pii_spans")).alias("spans")
    )


def op10_quality_ledger(spark: SparkSession, sf_dir: str, policy: str = "prose-1") -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    entries = quality_ledger.ledger(docs)
    base_failed = ~quality_ledger.passes("base-1")
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & quality_ledger.passes(policy)).alias("kept"),
    )


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.digested(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of the manifest of ``documents``; every fifth document by its hash is tampered with: its letters A-Z are lower-cased."""
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    fields = [F.col(c) for c in merkle.FIELDS]
    own, tampered = merkle.digest_of(*fields), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = merkle.digest_of(*fields[:-1], ascii_lower(F.col("text")))
    leaves = docs.select(F.col("source").alias("tree"), "doc_id", own.alias("leaf"), F.when(tampered, other).alias("claim"))
    manifest = merkle.build(leaves.withColumn("claim", F.coalesce("claim", "leaf")))
    root, folded = F.lit(manifest.root).cast("string"), merkle.fold(F.col("claim"), F.col("path"))
    found = merkle.proofs(manifest).select(
        "doc_id", "leaf", "subroot", root.alias("root"), merkle.joined(merkle.siblings(F.col("path"))).alias("proof_sha256"),
        folded.alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, dimension = vector_codes.kept(
        table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", vector_codes.SCALE, vector_codes.PARTS
    )
    books = vector_codes.fit(rows, dimension)
    found = vector_codes.with_label_errors(vector_codes.encode(rows, books))
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    from keelson.llm import oracles

    return {k: v for k, v in oracles.SQL.items() if k in queries()}
