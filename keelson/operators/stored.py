"""The form in which contracts are kept: canonical bytes that only their content decides, and comparing from it.

A package is one row a document: its keys, ``url``, ``is_root`` and ``content``.  The
stored text holds every document that can be parsed, keyed by its place relative to the
root, so neither the address nor the format (JSON or YAML, order of keys) of a document
matters.  Rebuilt packages have addresses of their own, under which relative references
between documents still resolve.
"""

from __future__ import annotations

import json
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from keelson.operators import contract_diff
from keelson.sources.contracts import read_contracts
from keelson.sources.documents import Rejected, canonical, parsed

FORMAT, VERSION = "contract.normalized", "openapi-canonical-1"
ROOT = "@root"
BASE, ELSEWHERE = "https://stored.invalid/contract/", "https://stored.invalid/external/"
ENTRIES = ArrayType(StructType([StructField("key", StringType()), StructField("text", StringType())]))


@F.arrow_udf(StringType())
def canonical_text(contents: pa.Array) -> pa.Array:
    """Canonical JSON of documents, null where one can't be parsed."""

    def one(content: str | bytes | None) -> str | None:
        try:
            return canonical(parsed(content))
        except Rejected:
            return None

    return pa.array([one(c.as_py()) for c in contents], pa.string())


@F.arrow_udf(ENTRIES)
def stored_documents(texts: pa.Array) -> pa.Array:
    """The documents of stored texts, null where one isn't ours."""

    def one(text: str | None) -> list[dict] | None:
        try:
            found = json.loads(text or "")
        except ValueError:
            return None
        if not isinstance(found, dict) or found.get("format") != FORMAT or found.get("normalization_version") != VERSION:
            return None
        return [{"key": k, "text": canonical(v)} for k, v in sorted(found["documents"].items())]

    return pa.array([one(t.as_py()) for t in texts], pa.list_(pa.struct([("key", pa.string()), ("text", pa.string())])))


def relative_key(url: Column, root: Column) -> Column:
    """The place of a document relative to the folder of the root; one of another origin keeps its authority."""
    split = lambda u: F.split(F.regexp_extract(u, "^[a-z]+://[^/?#]*(/[^?#]*)?", 1), "/")
    folder, own = F.slice(split(root), 2, F.greatest(F.size(split(root)) - 2, F.lit(0))), F.slice(split(url), 2, F.greatest(F.size(split(url)) - 1, F.lit(0)))
    upto = F.sequence(F.lit(0), F.least(F.size(folder), F.size(own) - 1))
    common = F.array_max(F.filter(upto, lambda n: F.slice(folder, F.lit(1), n) == F.slice(own, F.lit(1), n)))
    climbed = F.concat(F.array_repeat(F.lit(".."), F.size(folder) - common), F.slice(own, common + 1, F.size(own)))
    query = F.regexp_extract(url, r"(\?[^#]*)", 1)
    same = F.regexp_extract(url, "^[a-z]+://[^/?#]*", 0) == F.regexp_extract(root, "^[a-z]+://[^/?#]*", 0)
    return F.concat(F.when(same, F.array_join(climbed, "/")).otherwise(F.regexp_extract(url, "^[a-z]+:(//[^/?#]*[^?#]*)", 1)), query)


def normalized(packages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, normalized (text), normalized_sha256 and normalization_version of packages; one without a readable root has null."""
    read = packages.withColumn("text", canonical_text("content")).where("text IS NOT NULL OR is_root")
    whole = read.groupBy(*keys).agg(
        F.max(F.when(F.col("is_root"), F.col("url"))).alias("root"), F.max(F.when(F.col("is_root"), F.col("text"))).alias("root_text"),
        F.collect_list(F.struct("url", "is_root", "text")).alias("documents"),
    )
    named = F.transform(F.col("documents"), lambda d: F.struct(F.when(d["is_root"], ROOT).otherwise(relative_key(d["url"], F.col("root"))).alias("key"), d["text"].alias("text")))
    entry = lambda d: F.concat(F.regexp_replace(F.to_json(F.array(d["key"])), r"^\[|\]$", ""), F.lit(":"), d["text"])
    version = F.coalesce(F.get_json_object("root_text", "$.openapi"), F.lit(""))
    text = F.concat(
        F.lit('{"documents":{'), F.array_join(F.transform(F.array_sort(named), entry), ","),
        F.lit(f'}},"format":"{FORMAT}","normalization_version":"{VERSION}","openapi":"'), version, F.lit('"}'),
    )
    found = whole.select(*keys, F.when(F.col("root_text").isNotNull(), text).alias("normalized"))
    return found.withColumns({"normalized_sha256": F.sha2("normalized", 256), "normalization_version": F.lit(VERSION)})


def rebuilt(stored: DataFrame, keys: list[str]) -> DataFrame:
    """Packages (keys, url, is_root, content) rebuilt from stored texts; those that aren't ours are left out."""
    found = stored.select(*keys, stored_documents("normalized").alias("documents")).where("documents IS NOT NULL")
    climbs = F.transform("documents", lambda d: F.when(F.startswith(d["key"], F.lit("../")), F.regexp_count(d["key"], F.lit(r"\.\./"))).otherwise(0))
    folders = F.array_repeat(F.lit("d/"), F.array_max(climbs))
    rows = found.select(*keys, folders.alias("folders"), F.explode("documents").alias("d"))
    up = F.regexp_count("d.key", F.lit(r"\.\./"))
    below = F.concat(F.lit(BASE), F.array_join(F.slice("folders", F.lit(1), F.size("folders") - up), ""), F.regexp_replace("d.key", r"^(?:\.\./)+", ""))
    url = F.when(F.startswith("d.key", F.lit("//")), F.concat(F.lit(ELSEWHERE), F.substr("d.key", F.lit(3)))).otherwise(below)
    root = F.concat(F.lit(BASE), F.array_join("folders", ""), F.lit("root"))
    is_root = F.col("d.key") == ROOT
    return rows.select(*keys, F.when(is_root, root).otherwise(url).alias("url"), is_root.alias("is_root"), F.col("d.text").alias("content"))


def compare_stored(references: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings and limitations of stored texts (pair, normalized) against newer ones."""
    sides = references.select("pair", F.lit("before").alias("side"), "normalized").unionByName(current.select("pair", F.lit("after").alias("side"), "normalized"))
    return contract_diff.compare(read_contracts(rebuilt(sides, ["pair", "side"]), url="url"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
