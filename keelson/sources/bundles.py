"""Contracts in folders: canonical forms, fingerprints of packages, content-addressed bundles, labelled cases.

A bundle is a folder named by the digest of its manifest, which lists every document with
its digest.  Bundles are put once: of equal ones one is written, and one that is there
stays.  Its files come first and its manifest last, so a bundle that was cut off has none.
Reading goes through ``binaryFile``: every file is a row, its bundle and name come from
its path, and what doesn't hold is told for each bundle.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.operators.staging import staged
from keelson.sources.documents import Rejected, parsed
from keelson.sources.records import unsafe_paths

#: The form of bundles.
MANIFEST_FORMAT, MANIFEST, ORIGINAL, NORMALIZED = 1, "manifest.json", "original", "normalized"
#: The four canonical forms, as (ASCII only, separators, largest size in bytes).
FORMS = {
    "normalized": (False, (",", ":"), None), "identity": (True, (",", ":"), None), "manifest": (True, (",", ":"), None), "record": (False, (", ", ": "), 4 << 20),
}
_FORM_FIELDS = ", ".join(f"{name} string" for name in FORMS)


def form_of(value: object, name: str) -> str | None:
    """One canonical form: keys sorted, lists in their order; null where it is too large."""
    ascii_only, separators, most = FORMS[name]
    text = json.dumps(value, sort_keys=True, ensure_ascii=ascii_only, separators=separators, allow_nan=False)
    return text if most is None or len(text.encode()) <= most else None


def canonical_forms(content: Column) -> Column:
    """struct of FORMS, and ``loose`` (the identity form without a root's servers), has_servers and rejection of JSON or YAML."""

    @F.arrow_udf(f"{_FORM_FIELDS}, loose string, has_servers boolean, rejection string")
    def forms(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts:
            try:
                value = parsed(text.as_py())
                row = {name: form_of(value, name) for name in FORMS} | {"rejection": None}
                root = isinstance(value, dict)
                row |= {"loose": form_of({k: v for k, v in value.items() if k != "servers"}, "identity") if root else row["identity"], "has_servers": root and bool(value.get("servers"))}
            except Rejected as code:
                row = dict.fromkeys([*FORMS, "loose"]) | {"has_servers": False, "rejection": str(code)}
            rows.append(row)
        fields = [(n, pa.string()) for n in (*FORMS, "loose")] + [("has_servers", pa.bool_()), ("rejection", pa.string())]
        return pa.array(rows, pa.struct(fields))

    return forms(content)


def package_fingerprints(members: DataFrame) -> DataFrame:
    """package, fingerprint, loose_fingerprint (without the root's servers) and has_servers of members (package, is_root, content).

    A document's digest is that of its identity form, so JSON, YAML, layout and the order
    of keys don't matter; one that can't be read counts by its bytes.  The root's digest
    comes first, then those of the others, sorted; equal ones count as often as they are there.
    """
    read = members.withColumn("forms", canonical_forms(F.col("content")))
    own = F.sha2(F.coalesce("forms.identity", "content"), 256)
    loose = F.sha2(F.coalesce("forms.loose", "content"), 256)
    read = read.select("package", "is_root", own.alias("own"), loose.alias("loose"), "forms.has_servers")
    root = lambda c: F.max(F.when(F.col("is_root"), F.col(c)))
    packages = read.groupBy("package").agg(
        root("own").alias("own"), root("loose").alias("loose"), F.coalesce(root("has_servers"), F.lit(False)).alias("has_servers"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("is_root"), F.col("own")))), "").alias("rest"),
    )
    whole = lambda c: F.sha2(F.unhex(F.concat(c, "rest")), 256)
    return packages.select("package", whole("own").alias("fingerprint"), whole("loose").alias("loose_fingerprint"), "has_servers")


def manifests(members: DataFrame, normalized: DataFrame) -> DataFrame:
    """package, manifest (canonical text) and fingerprint of members (package, path, is_root, content) and normalized (package, normalized, version)."""
    entry = F.struct("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("size"))
    listed = members.groupBy("package").agg(F.array_sort(F.collect_list(entry)).alias("documents"), F.max(F.when(F.col("is_root"), F.col("path"))).alias("entry_point"))
    form = F.struct(F.sha2("normalized", 256).alias("sha256"), F.octet_length("normalized").alias("size"))
    text = F.to_json(F.struct("documents", "entry_point", F.lit(MANIFEST_FORMAT).alias("format"), F.col("version").alias("normalization_version"), form.alias("normalized")))
    return listed.join(normalized, "package").select("package", text.alias("manifest")).withColumn("fingerprint", F.sha2("manifest", 256))


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:") and not path.startswith("file://") else path)


def files_in(spark: SparkSession, folder: str) -> DataFrame:
    """bundle, name and content of every file of the bundles in a folder; an empty frame where there is none yet."""
    system, base = _opened(folder)
    system.create_dir(base, recursive=True)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    place = r"/([0-9a-f]{64})/(.+)$"
    found = rows.select(F.regexp_extract("path", place, 1).alias("bundle"), F.regexp_extract("path", place, 2).alias("name"), "content")
    return found.where("bundle <> ''")


def put(members: DataFrame, normalized: DataFrame, folder: str) -> DataFrame:
    """Write the bundles that the folder lacks, each once; package and fingerprint of all, and whether its bundle is new.

    Unsafe paths are refused before anything is written.
    """
    spark = members.sparkSession
    unsafe = unsafe_paths(members.select(F.col("package").alias("bundle"), "path")).limit(1).collect()
    if unsafe:
        raise ValueError(f"a document can't be kept: {unsafe[0]['path']!r} ({unsafe[0]['problem']})")
    made = manifests(members, normalized)
    there = files_in(spark, folder).where(F.col("name") == MANIFEST).select(F.col("bundle").alias("fingerprint"))
    new = made.join(there, "fingerprint", "left_anti").groupBy("fingerprint").agg(F.min("package").alias("package"), F.first("manifest").alias("manifest"))

    def named(name: str | Column, content: Column, last: bool = False) -> tuple[Column, ...]:
        return (F.lit(name) if isinstance(name, str) else name).alias("name"), content.cast("binary").alias("content"), F.lit(last).alias("last")

    of = new.select("fingerprint", "package")
    files = (
        members.join(of, "package").select("fingerprint", *named(F.concat(F.lit(f"{ORIGINAL}/"), "path"), F.col("content")))
        .unionByName(normalized.join(of, "package").select("fingerprint", *named(NORMALIZED, F.col("normalized"))))
        .unionByName(new.select("fingerprint", *named(MANIFEST, F.col("manifest"), True)))
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(folder)
        for batch in batches:
            for bundle, name, content in zip(*(batch.column(c).to_pylist() for c in ("fingerprint", "name", "content"))):
                place = f"{base}/{bundle}/{name}"
                system.create_dir(place.rpartition("/")[0], recursive=True)
                with system.open_output_stream(place, compression=None) as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([batch.column("fingerprint"), batch.column("last")], ["fingerprint", "last"])

    # Files of a bundle are written by one task, the manifest last; equal content written again changes nothing.
    written = files.repartition("fingerprint").sortWithinPartitions("fingerprint", "last", "name").mapInArrow(write, "fingerprint string, last boolean")
    done = staged(written.where("last").select("fingerprint", F.lit(True).alias("new")))
    return made.select("package", "fingerprint").join(done, "fingerprint", "left").withColumn("new", F.coalesce("new", F.lit(False)))


MANIFEST_SCHEMA = (
    "documents array<struct<path:string,sha256:string,size:bigint>>, entry_point string, format bigint, normalization_version string, normalized struct<sha256:string,size:bigint>"
)


def verified(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound bundles' documents (bundle, path, is_root, content), and what is wrong: bundle and problem, each once.

    missing_manifest, corrupted_manifest (not the bundle's digest), unsupported_format,
    invalid_manifest (its shape, unsafe or repeated paths, an entry point that isn't
    listed), missing_file and corrupted_file.  Files that no manifest lists don't matter.
    """
    manifest = files.where(F.col("name") == MANIFEST).select("bundle", "content", F.from_json(F.col("content").cast("string"), MANIFEST_SCHEMA).alias("m"))
    digest = lambda c: F.coalesce(F.col(c).rlike("^[0-9a-f]{64}$"), F.lit(False))
    paths = F.transform("m.documents", lambda d: d["path"])
    sound = F.forall("m.documents", lambda d: d.isNotNull() & F.coalesce(d["sha256"].rlike("^[0-9a-f]{64}$"), F.lit(False)) & d["path"].isNotNull())
    shaped = (
        (F.size("m.documents") > 0) & sound & digest("m.normalized.sha256") & F.col("m.normalization_version").isNotNull() & (F.size(F.array_distinct(paths)) == F.size(paths)) & F.array_contains(paths, F.col("m.entry_point"))
    )
    judged = manifest.select(
        "bundle", "m",
        F.when(F.sha2("content", 256) != F.col("bundle"), "corrupted_manifest").when(F.col("m").isNull() | F.col("m.format").isNull() | (F.col("m.format") != MANIFEST_FORMAT), "unsupported_format")
        .when(~F.coalesce(shaped, F.lit(False)), "invalid_manifest").alias("problem"),
    )
    good = judged.where("problem IS NULL")
    unsafe = unsafe_paths(good.select("bundle", F.explode(paths).alias("path"))).select("bundle", F.lit("invalid_manifest").alias("problem")).distinct()
    good = good.join(unsafe, "bundle", "left_anti").select("bundle", "m")
    listed = good.select("bundle", "m.entry_point", F.explode(F.concat(
        F.transform("m.documents", lambda d: F.struct(F.concat(F.lit(f"{ORIGINAL}/"), d["path"]).alias("name"), d["sha256"].alias("sha256"))),
        F.array(F.struct(F.lit(NORMALIZED).alias("name"), F.col("m.normalized.sha256").alias("sha256"))),
    )).alias("d")).select("bundle", "entry_point", "d.*")
    met = listed.join(files.where(F.col("name") != MANIFEST).withColumn("there", F.sha2("content", 256)), ["bundle", "name"], "left")
    of_file = F.when(F.col("there").isNull(), "missing_file").when(F.col("there") != F.col("sha256"), "corrupted_file")
    lost = files.select("bundle").distinct().join(manifest.select("bundle"), "bundle", "left_anti").select("bundle", F.lit("missing_manifest").alias("problem"))
    problems = judged.where("problem IS NOT NULL").select("bundle", "problem").unionByName(unsafe).unionByName(lost)
    problems = problems.unionByName(met.select("bundle", of_file.alias("problem")).where("problem IS NOT NULL")).distinct()
    whole = met.where(F.col("name") != NORMALIZED).join(problems.select("bundle"), "bundle", "left_anti")
    path = F.regexp_replace("name", f"^{ORIGINAL}/", "")
    return whole.select("bundle", path.alias("path"), (path == F.col("entry_point")).alias("is_root"), "content"), problems


def cases_in(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled cases of a folder: name, and before, after, expected and meta as texts (meta may be missing).

    Each case is a folder of ``before.json``, ``after.json``, ``expected.json`` and maybe ``meta.json``.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder)
    place = r"/([^/]+)/(before|after|expected|meta)\.json$"
    found = rows.select(F.regexp_extract("path", place, 1).alias("name"), F.regexp_extract("path", place, 2).alias("file"), F.col("content").cast("string").alias("text")).where("file <> ''")
    return found.groupBy("name").pivot("file", ["before", "after", "expected", "meta"]).agg(F.first("text"))


EXPECTED = "findings array<struct<rule_id:string,method:string,path:string,target:string,parameter:string,category:string>>, limitations array<string>"


def expected_findings(cases: DataFrame) -> DataFrame:
    """name, rule_id, method, path, target and category of what cases expect."""
    found = cases.select("name", F.explode(F.from_json("expected", EXPECTED)["findings"]).alias("f"))
    blank = lambda *c: F.coalesce(*c, F.lit(""))
    return found.select("name", "f.rule_id", blank(F.col("f.method")).alias("method"), blank(F.col("f.path")).alias("path"), blank(F.col("f.target"), F.col("f.parameter")).alias("target"), "f.category")


for _name in (__name__, "keelson.sources.documents"):
    cloudpickle.register_pickle_by_value(sys.modules[_name])
