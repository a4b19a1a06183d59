"""Cases of the smaller operators that the tables don't hold."""

from pyspark.sql import functions as F

from keelson.functions import text
from keelson.operators import history, identity, links, matching
from keelson.streaming import checks


def one(spark, column, **values):
    frame = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return frame.select(column).first()[0]


def test_text_functions(spark):
    assert one(spark, text.version_key(F.col("v")), v=" V2.1 ") == "2.1"
    assert one(spark, text.versions_agree(F.lit("v2"), F.lit("2.1.0"))) and not one(spark, text.versions_agree(F.lit("2"), F.lit("21")))
    assert one(spark, F.array_join(text.decoded_segments(F.lit("/a%2Fb/c+d/%zz")), "|")) == "|a/b|c+d|%zz"
    assert one(spark, text.pointer(F.array(F.lit("a/b"), F.lit("~")))) == "/a~1b/~0"
    assert one(spark, text.ratio(F.lit(1), F.lit(0))) is None and one(spark, text.ratio(F.lit(1), F.lit(16))) == 0.062
    assert one(spark, text.strict_time(F.lit("2026-01-02"))) is None
    assert one(spark, text.normal_path(F.lit("/a/{x}/b-{y}"))) == "/a/{}/b-{}"


def test_links(spark):
    score = lambda path, label="": one(spark, links.score(F.lit(path), F.lit(label)))
    assert [score("/openapi.json"), score("/docs/api-reference", "API docs"), score("/pricing"), score("/swagger.css"), score("/x")] == [10, 12, 0, 0, 0]


def test_links_in_any_form(spark):
    html = """<a class=x href="/api">API</a><A HREF='/docs'>x <i>y</i></A><a name=n>no</a><!-- <a href="/c">c</a> --><script>"<a href='/s'>s</a>"</script>
    <a href="/openapi.json"><b>OpenAPI</b>
    spec</a><a title="Read > this" href=../reference?x=1>r<a data-x='href="/no"' href = "//x.com/api" aria-label="On X"></a><a href="https://blog.acme.com/api">d</a>
    <a href="/v1/../app.js?v=2">api</a><a href="mailto:api@acme.com">api</a><a href="https://developers.acme.com/">here</a><a href="/swagger">cut"""
    pages = spark.createDataFrame([(1, "https://acme.com/guide/a/b", html), (2, "https://medium.com/a", "<a href=/api>x</a>"), (3, None, None),
        (4, "https://acme.com/", "<base href='https://acme.com/docs/'><a href=x>x</a>" + "<a ''''" * 5000)], "page_id int, url string, html string")
    found = links.links_of(pages).withColumn("score", links.score(F.col("url"), F.col("label"))).orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.pos, r.href, r.label, r.score) for r in found] == [
        (1, 0, "/api", "API", 5), (1, 1, "/docs", "x y", 4), (1, 2, "/openapi.json", "OpenAPI spec", 12), (1, 3, "../reference?x=1", "Read > this r", 7),
        (1, 4, "//x.com/api", "On X", 0), (1, 5, "https://blog.acme.com/api", "d", 5), (1, 6, "/v1/../app.js?v=2", "api", 0), (1, 7, "mailto:api@acme.com", "api", 0),
        (1, 8, "https://developers.acme.com/", "here", 0), (1, 9, "/swagger", "cut", 10), (2, 0, "/api", "x", 0), (4, 0, "x", "x", 4),
    ]
    paths = [one(spark, links.path_of(F.lit(u))) for u in ("https://a.b/x/../y/./z?q#f", "/../a", "//h", "a/b")]
    assert paths == ["/y/z", "/a", "", "a/b"]


def test_hosts_and_templates(spark):
    relation = lambda a, b: one(spark, matching.host_relation(F.lit(a), F.lit(b)))
    assert relation("api.acme.com", "acme.com") == matching.UNDER_SERVER and relation("acme.com", "api.acme.com") == matching.UNDER_TARGET
    assert relation("acme.com", "com") is None and relation("xacme.com", "acme.com") is None and relation("1.2.3.4", "3.4") is None
    requests = spark.createDataFrame([(1, "GET", "/a/1/b"), (2, None, "/a/1"), (3, "GET", "/a//b")], "request_id int, method string, path string")
    operations = spark.createDataFrame([("GET", "/a/{id}/b"), ("PUT", "/a/{id}"), ("GET", "/a.b/{x}")], "method string, template string")
    assert {(r.request_id, r.template) for r in matching.find_operations(requests, operations).collect()} == {(1, "/a/{id}/b"), (2, "/a/{id}")}


def test_references_and_budget(spark):
    log = spark.createDataFrame(
        [(1, "s", 1, "first", "a"), (2, "s", 2, "failed", None), (3, "s", 3, "changed", "b"), (4, "s", 4, "unchanged", "c")],
        "seq int, source_id string, finished_at int, status string, snapshot_id string",
    )
    assert [r.before_snapshot_id for r in history.with_reference(log).orderBy("seq").collect()] == [None, "a", "a", "b"]
    calls = spark.createDataFrame([(1, 1, i, 40, 50) for i in range(4)], "run_id int, ts int, seq int, micro_usd int, worst_micro_usd int")
    assert [r.decision for r in history.budget_audit(calls, 100).orderBy("seq").collect()] == [
        "allowed", "allowed", "budget_would_be_exceeded", "budget_exhausted",
    ]


def test_verification(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "path string, digest string")
    manifest = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3")], "path string, digest string")
    assert {tuple(r) for r in identity.verify(files, manifest).collect()} == {("b", "altered"), ("c", "missing"), ("d", "unexpected")}


def test_verdicts(spark):
    rows = [(1, "x", "server_host", 1, "match"), (1, "x", "operation", 2, "match"), (1, "y", "operation", 2, "mismatch"), (1, "y", "product", 4, "mismatch")]
    found = matching.verdict(spark.createDataFrame(rows, "request_id int, candidate string, check string, rank int, outcome string"))
    assert {(r.candidate, r.rejected_by, r.confirmed) for r in found.collect()} == {("x", None, True), ("y", "operation", False)}


def test_unmarked_batch_is_not_seen(spark, tmp_path):
    put = checks.append_to(str(tmp_path))
    put(spark.range(3), 0)
    put(spark.range(3, 5), 1)
    put(spark.range(3, 5), 1)  # once more, as after a restart
    spark.range(9).write.parquet(f"{tmp_path}/rows/batch=2")  # cut off before its marker
    assert sorted(r.id for r in checks.published(spark, str(tmp_path)).collect()) == [0, 1, 2, 3, 4]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(i, f"k{i % 2}") for i in range(50)], "at long, key string").select(F.timestamp_seconds("at").alias("at"), "key")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = checks.counts_in_windows(checks.read_log(spark, f"{tmp_path}/in", events.schema, 1), "at", "key", "10 seconds", "1 hour")
    stream.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start().awaitTermination()
    batch = checks.counts_in_windows(events, "at", "key", "10 seconds", "1 hour")
    assert sorted(map(str, spark.table("counted").collect())) == sorted(map(str, batch.collect()))
