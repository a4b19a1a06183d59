"""Identity of contents, text functions, measuring against labels, keyed differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import text
from keelson.operators import contract_diff, evaluation, history, identity, references
from keelson.operators.staging import staged
from keelson.plans.registry import query, table


@query(
    "k3_contents_stored_once",
    """SELECT sha256(text) AS digest, max(strlen(text))::BIGINT AS bytes, count(*) AS origins, min(source) AS first_origin,
       'refs/' || left(sha256(text), 32) AS path FROM documents GROUP BY 1""",
)
def k3_contents_stored_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.stored_once(table(spark, sf_dir, "documents").select("text", "source"), "text", "source")


@query(
    "a9_package_fingerprints",
    """WITH d AS (SELECT doc_id // 10 AS package, doc_id % 10 = 0 AS is_root, sha256(text) AS own FROM documents)
       SELECT package, sha256(unhex(max(own) FILTER (is_root) || coalesce(string_agg(DISTINCT own, '' ORDER BY own) FILTER (NOT is_root), ''))) AS fingerprint
       FROM d GROUP BY 1""",
)
def a9_package_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / 10).alias("package"), (F.col("doc_id") % 10 == 0).alias("is_root"), "text"
    )
    return identity.package_fingerprint(docs, "package", "is_root", "text")


@query(
    "j20_bundle_verification",
    """WITH m AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS wanted FROM documents),
       f AS (SELECT CASE WHEN lang = 'fr' THEN 'old/' || doc_id ELSE doc_id::VARCHAR END AS path, sha256(CASE WHEN lang = 'de' THEN text || '!' ELSE text END) AS found FROM documents)
       SELECT path, CASE WHEN found IS NULL THEN 'missing' WHEN wanted IS NULL THEN 'unexpected' ELSE 'altered' END AS problem
       FROM (SELECT coalesce(m.path, f.path) AS path, wanted, found FROM m FULL JOIN f ON m.path = f.path) WHERE wanted IS DISTINCT FROM found""",
)
def j20_bundle_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of all documents against the files kept of them: those in French lie under another name, those in German were altered."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "lang", "text")
    manifest = docs.select("path", identity.digest(F.col("text")).alias("digest"))
    kept = F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    path = F.when(F.col("lang") == "fr", F.concat(F.lit("old/"), "path")).otherwise(F.col("path"))
    return identity.verify(docs.select(path.alias("path"), identity.digest(kept).alias("digest")), manifest)


@query(
    "x1_texts_that_read_the_same",
    r"SELECT sha256('t:' || trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1",
)
def x1_texts_that_read_the_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.sha2(text.text_key(F.col("text")), 256)
    return table(spark, sf_dir, "documents").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query(
    "x2_shown_texts",
    r"""SELECT doc_id, sha256(CASE WHEN length(text) <= 1000 THEN text ELSE left(text, 1000) || '…' END) AS shown,
        left(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g'), 80) AS clean,
        sha256(CASE WHEN instr(text, '. ') > 0 THEN left(text, instr(text, '. ')) ELSE text END) AS first_sentence FROM documents""",
)
def x2_shown_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(text.shown(own), 256).alias("shown"), text.clean_text(own, 80).alias("clean"),
        F.sha2(text.first_sentence(own), 256).alias("first_sentence"),
    )


@query(
    "x8_versions_agree",
    r"""WITH v AS (SELECT c_custkey AS id, (c_custkey % 3)::VARCHAR || '.' || (c_custkey % 2)::VARCHAR AS found,
        CASE WHEN c_custkey % 5 = 0 THEN ' V' ELSE 'v' END || (c_custkey % 4)::VARCHAR AS asked FROM customer),
        k AS (SELECT id, regexp_replace(lower(trim(asked)), '^v([0-9])', '\1') AS a, regexp_replace(lower(trim(found)), '^v([0-9])', '\1') AS b FROM v)
        SELECT id, a = b OR starts_with(a, b || '.') OR starts_with(b, a || '.') AS agree FROM k""",
)
def x8_versions_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    found = F.concat(key % 3, F.lit("."), key % 2)
    asked = F.concat(F.when(key % 5 == 0, " V").otherwise("v"), key % 4)
    return table(spark, sf_dir, "customer").select(key.alias("id"), text.versions_agree(asked, found).alias("agree"))


@query(
    "x7_product_tokens",
    """WITH t AS (SELECT p_partkey, list_transform(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+'),
         lambda w: CASE WHEN length(w) > 3 AND ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END) AS tokens FROM part)
       SELECT p_partkey, array_to_string(tokens, ' ') AS tokens, contains(' ' || array_to_string(tokens, ' ') || ' ', ' ' || tokens[1] || ' ') AS named FROM t""",
)
def x7_product_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = text.product_tokens(F.concat_ws(" ", "p_name", "p_type"))
    parts = table(spark, sf_dir, "part").select("p_partkey", tokens.alias("t"))
    return parts.select("p_partkey", F.array_join("t", " ").alias("tokens"), text.contains_run(F.col("t"), F.slice("t", 1, 1)).alias("named"))


@query(
    "x15_times_as_text",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS at, strftime(ts, '%Y-%m-%d') AS day FROM events""",
)
def x15_times_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.utc_text(F.col("ts")).alias("at"), F.to_date("ts").cast("string").alias("day"))


@query(
    "x3_pointers",
    "SELECT o_orderkey, '/orders/' || replace(replace(o_orderpriority || '/~x', '~', '~0'), '/', '~1') AS pointer FROM orders",
)
def x3_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.array(F.lit("orders"), F.concat("o_orderpriority", F.lit("/~x")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.pointer(path).alias("pointer"))


_LABELLED = """
e AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS expected FROM labels),
r AS (SELECT doc_id, CASE WHEN regexp_matches(text, 'idiot|moron|stupid') THEN 'toxic' ELSE 'clean' END AS returned FROM documents),
p AS (SELECT coalesce(e.doc_id, r.doc_id) AS doc_id, expected, returned FROM e FULL JOIN r ON e.doc_id = r.doc_id)
"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label against what every document is found to be; documents without a label have no expectation."""
    expected = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("category"))
    returned = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("text").rlike("idiot|moron|stupid"), "toxic").otherwise("clean").alias("category")
    )
    return evaluation.matched(expected, returned, ["doc_id"])


@query("j12_expected_against_returned", f"WITH {_LABELLED} SELECT doc_id, expected, returned FROM p WHERE expected IS NULL OR returned IS NULL OR expected <> returned")
def j12_expected_against_returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).where("expected IS NULL OR returned IS NULL OR expected <> returned").select("doc_id", "expected", "returned")


@query("a5_confusion", f"WITH {_LABELLED} SELECT coalesce(expected, 'none') AS expected, coalesce(returned, 'none') AS returned, count(*) AS n FROM p GROUP BY 1, 2")
def a5_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(labelled(spark, sf_dir))


@query(
    "a6_precision_and_recall",
    f"""WITH {_LABELLED}, g AS (SELECT doc_id % 5 AS fold, count(expected) AS n_expected, count(returned) AS n_returned,
        count(*) FILTER (expected IS NOT NULL AND returned IS NOT NULL) AS n_found, count(*) FILTER (expected = returned) AS n_right FROM p GROUP BY 1)
        SELECT fold, n_expected, n_returned, n_found, n_right, round_even(n_found / nullif(n_returned, 0), 3) AS precision,
        round_even(n_found / nullif(n_expected, 0), 3) AS recall, round_even(n_right / nullif(n_found, 0), 3) AS accuracy FROM g""",
)
def a6_precision_and_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.report(labelled(spark, sf_dir).withColumn("fold", F.col("doc_id") % 5), ["fold"])


@query(
    "w1_last_turn_wins",
    "SELECT conv_id, role, turn, sha256(text) AS said FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1",
)
def w1_last_turn_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Override by key: of each conversation and role the last turn stays."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.sha2("text", 256).alias("said"))
    return history.last_wins(turns, ["conv_id", "role"], "turn", ["said"])


@query(
    "a14_first_turn_wins",
    "SELECT conv_id, role, turn, sha256(text) AS said FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) WHERE n = 1",
)
def a14_first_turn_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplication by key that keeps the first."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.sha2("text", 256).alias("said"))
    return history.first_wins(turns, ["conv_id", "role"], "turn", ["said"])


_KEYED = """
o AS (SELECT p_brand AS brand, p_partkey % 500 AS key, min(p_size) AS size FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2),
n AS (SELECT p_brand AS brand, (p_partkey - 1) % 500 AS key, min(p_size) AS size FROM part WHERE p_partkey % 2 = 1 GROUP BY 1, 2)
"""


@query(
    "j2_keyed_difference",
    f"""WITH {_KEYED} SELECT coalesce(o.brand, n.brand) AS brand, coalesce(o.key, n.key) AS key,
        CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' ELSE 'changed' END AS kind, o.size AS old_size, n.size AS new_size
        FROM o FULL JOIN n ON o.brand = n.brand AND o.key = n.key WHERE o.size IS DISTINCT FROM n.size""",
)
def j2_keyed_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a keyed table: one full outer join tells what was added, removed and changed."""
    parts, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    side = F.when(key % 2 == 0, "before").otherwise("after")
    rows = parts.select(F.col("p_brand").alias("brand"), F.when(key % 2 == 0, key % 500).otherwise((key - 1) % 500).alias("key"), side.alias("side"), "p_size")
    both = contract_diff.two_sides(rows, ["brand", "key"], F.min, "p_size")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select("brand", "key", kind.alias("kind"), F.col("old").alias("old_size"), F.col("new").alias("new_size"))


@query(
    "o2_members_gone_and_come",
    """WITH a AS (SELECT c_nationkey AS k, list(DISTINCT c_mktsegment) FILTER (c_custkey % 2 = 0) AS old, list(DISTINCT c_mktsegment) FILTER (c_custkey % 2 = 1) AS new FROM customer GROUP BY 1)
       SELECT k, coalesce(array_to_string(list_sort(list_filter(old, lambda x: NOT list_contains(coalesce(new, []), x))), ','), '') AS gone,
       coalesce(array_to_string(list_sort(list_filter(new, lambda x: NOT list_contains(coalesce(old, []), x))), ','), '') AS came FROM a""",
)
def o2_members_gone_and_come(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set differences both ways of the members that two versions of a group have."""
    side = F.when(F.col("c_custkey") % 2 == 0, "before").otherwise("after")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), side.alias("side"), "c_mktsegment")
    gone, came = contract_diff.gone_and_come(F.col("old"), F.col("new"))
    shown = lambda members: F.array_join(F.array_sort(members), ",")
    return contract_diff.two_sides(rows, ["k"], F.collect_set, "c_mktsegment").select("k", shown(gone).alias("gone"), shown(came).alias("came"))


_LINKED = """concat('{"a":{"$ref":"#/b/', p_partkey % 3, '"},"b":[{"$ref":"https://docs.example/', p_size, '#/a"},{"$ref":"', CASE WHEN p_partkey % 2 = 0 THEN '#/b' ELSE '#/c~1d' END,
  '"},1],"c/d":{"x":{"$ref":"https://docs.example/', p_size, '#/a"}},"n":{"$ref":"#name"}}')"""
_REFS = f"""
d AS (SELECT p_partkey AS k, p_size, 'https://docs.example/p/' || p_partkey AS url FROM part),
r AS (SELECT k, url, '/a' AS pointer, '#/b/' || (k % 3) AS ref, 'local' AS kind FROM d
      UNION ALL SELECT k, url, '/b/0', 'https://docs.example/' || p_size || '#/a', 'external' FROM d
      UNION ALL SELECT k, url, '/b/1', CASE WHEN k % 2 = 0 THEN '#/b' ELSE '#/c~1d' END, 'local' FROM d
      UNION ALL SELECT k, url, '/c~1d/x', 'https://docs.example/' || p_size || '#/a', 'external' FROM d
      UNION ALL SELECT k, url, '/n', '#name', 'anchor' FROM d)
"""


def linked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url and content of a document for each part, with references inside, to others and to an anchor."""
    return table(spark, sf_dir, "part").select(F.concat(F.lit("https://docs.example/p/"), "p_partkey").alias("url"), F.expr(_LINKED).alias("content"), "p_size")


@query("a13_occurrences", f"WITH {_REFS} SELECT url, ref, kind, count(*) AS n, min(pointer) AS first_pointer FROM r GROUP BY 1, 2, 3")
def a13_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document holds each reference, and where first."""
    return references.occurrences(references.references(references.places(linked_documents(spark, sf_dir))))


@query("p9_dangling_references", f"WITH {_REFS} SELECT url, pointer, ref FROM r WHERE kind = 'external'")
def p9_dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References whose target isn't among the documents: every external one here, as every place inside exists."""
    found = staged(references.places(linked_documents(spark, sf_dir)))
    return references.dangling(references.references(found), found).select("url", "pointer", "ref")


@query(
    "s19_captured_documents",
    """WITH d AS (SELECT DISTINCT 'https://docs.example/p/' || p_partkey AS root, 'https://docs.example/' || p_size AS leaf FROM part)
       SELECT root, root AS url, 0 AS depth, NULL::VARCHAR AS problem FROM d
       UNION ALL SELECT root, leaf, 1, CASE WHEN regexp_extract(leaf, '[0-9]+$')::INT % 2 = 1 THEN 'not_captured' END FROM d
       UNION ALL SELECT root, 'https://elsewhere.example/x', 2, 'other_origin' FROM d WHERE regexp_extract(leaf, '[0-9]+$')::INT % 2 = 0""",
)
def s19_captured_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each part's document needs: documents of even sizes are there and refer to another origin."""
    own = linked_documents(spark, sf_dir)
    size = F.col("p_size")
    leaves = own.select(size).distinct().where(size % 2 == 0).select(F.concat(F.lit("https://docs.example/"), size).alias("url"), F.lit('{"a":{"$ref":"https://elsewhere.example/x#/y"}}').alias("content"))
    documents = staged(own.select("url", "content").unionByName(leaves))
    refs = references.references(references.places(documents))
    return references.capture(own.select(F.col("url").alias("root")), refs, documents)


@query(
    "l9_capped_with_flag",
    """SELECT l_suppkey AS scope, n AS ordinal, l_orderkey, total > 20 AS truncated FROM (SELECT l_suppkey, l_orderkey, row_number() OVER
       (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS n, count(*) OVER (PARTITION BY l_suppkey) AS total FROM lineitem) WHERE n <= 20""",
)
def l9_capped_with_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 findings of each scope in walk order, and whether there were more (a limit that is the feature)."""
    found = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("scope"), "l_orderkey", "l_linenumber")
    kept = contract_diff.capped(found, ["scope"], ["l_orderkey", "l_linenumber"], 20)
    return kept.select("scope", F.col("n").cast("long").alias("ordinal"), "l_orderkey", "truncated")
