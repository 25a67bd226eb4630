"""Catalog merge, page extraction and run-log helpers (``page_small``, ``errors_small``)."""

from telemark.operators import catalog as C
from telemark.operators import pages as H
from telemark.operators import runlog as G

PAGE = ("<html><h1>AppTraces</h1>\n<p>Trace <b>rows</b> &amp; more.</p>"
        "<table><tr><th>Name</th><th>Type</th><th>Description</th></tr>"
        "<tr><td>Message</td><td>string</td><td>text</td></tr><tr><td>SeverityLevel</td><td>int</td></tr></table>"
        "<h2>Errors</h2><p>Failed ones</p><pre><code>AppTraces\n| where x &gt; 1</code></pre>"
        "<h3>No code</h3><p>nothing</p><h3>Inline</h3><code>T | take 1</code>"
        "<p>Resource type: <strong>microsoft.insights/components</strong></p></html>")


def test_pages(spark):
    df = spark.createDataFrame([(1, PAGE)], "page_id int, html string")
    assert df.select(H.page_description("html")).collect()[0][0] == "Trace rows &amp; more."
    rows = H.column_table_rows(df).orderBy("row_no").collect()
    assert [(r.name, r.type, r.description) for r in rows] == [("Message", "string", "text"),
                                                                ("SeverityLevel", "int", "")]
    blocks = H.query_blocks(df).orderBy("block_no").collect()
    assert [(b.name, b.code) for b in blocks] == [("Errors", "AppTraces\n| where x > 1"), ("Inline", "T | take 1")]
    assert blocks[0].description == "Failed ones"
    assert df.select(H.resource_type_label("html")).collect()[0][0] == "Microsoft.insights/components"


def test_suggestion_merge_precedence(spark):
    e = spark.createDataFrame([
        ("T", "m1", "T | take 1", 0, 1), ("T", "m2", None, 0, 2), ("T", "m3", "T | take 1", 0, 3),
        ("T", "c1", "T  | take 1".replace("  ", " "), 1, 4), ("T", "c2", "T | count\r\n\r\n", 1, 5),
        ("T", "d1", "T | count", 2, 6), ("T", "d2", "", 2, 7), ("U", "d3", "T | count", 2, 8)],
        "table_name string, name string, code string, source_rank int, pos int")
    kept = sorted(r.name for r in C.suggestion_merge(e).collect())
    # manifest kept whole (also without code / duplicates); c1 duplicates m1; d1 duplicates c2; d2 has no code
    assert kept == ["c2", "d3", "m1", "m2", "m3"]
    # an entry of unknown rank gives way to a ranked one, and stays where it is the only one
    e = spark.createDataFrame([("T", "x0", "X", None, 1), ("T", "x1", "X", 1, 2), ("T", "y0", "Y", None, 3), ("T", "y1", "Y", None, 4), ("T", "z0", "Z", None, 5), ("T", "m", "Z", 0, 6)],
                              "table_name string, name string, code string, source_rank int, pos int")
    assert sorted(r.name for r in C.suggestion_merge(e).collect()) == ["m", "x1", "y0"]


def test_resource_types(spark):
    tables = spark.createDataFrame([("A",), ("B",), ("Z",)], "name string")
    mp = spark.createDataFrame([("A", "p1/x", "f", 2), ("A", "p2/y", "f", 1), ("B", "p1/x", "f", 3)],
                               "table_name string, resource_type string, manifest_file string, pos int")
    att = {r.name: (r.resource_type, r.resource_types) for r in C.attach_resource_types(tables, mp).collect()}
    assert att["A"] == ("p2/y", ["p2/y", "p1/x"]) and att["Z"][0] == "Unknown"
    ps = {r.provider: (r.tables, r.resource_types) for r in C.provider_summary(tables, mp).collect()}
    assert ps == {"p1": (2, 1), "p2": (1, 1)}
    split = {r.name: r.in_manifest for r in C.matched_split(tables, mp).collect()}
    assert split == {"A": True, "B": True, "Z": False}


def test_error_classes_and_status(spark):
    msgs = ["401 Unauthorized", "Rate limit hit 429", "Deployment not found", "empty completion", "content policy",
            "read timeout", "connection reset", "HTTP error 500", "something else", None]
    df = spark.createDataFrame([(m,) for m in msgs], "m string")
    got = [r[0] for r in df.select(G.error_class("m")).collect()]
    assert got == ["auth_error", "rate_limit", "deployment_not_found", "empty_content", "content_filtered",
                   "timeout", "connection_error", "http_error", "generic_error", None]
    st = spark.createDataFrame([(None, "QueryStatus.SUCCESS"), ("partial", None), (None, None)],
                               "s string, raw string")
    n = st.select(G.normalize_status("s", "raw").alias("n")).select("n", G.ui_status("n")).collect()
    assert [tuple(r) for r in n] == [("SUCCESS", "success"), ("PARTIAL", "error"), ("UNKNOWN", "failed")]


def test_innermost_message(spark):
    nested = 'Failure. Inner error: {"code": "x", "innererror": {"innererror": {"message": "deep one"}}} tail'
    df = spark.createDataFrame([(nested,), ('{"error": {"message": "m2"}}',), ("plain",),
                                ('a "message": "first" b "message": "last"',), ('{"error_message": "only this"}',),
                                ('Inner error: {"message": "top", "innererror": {"message": "in"}}',), (None,)], "e string")
    got = [r[0] for r in df.select(G.innermost_message("e")).collect()]
    assert got == ["deep one", "m2", "plain", "last", "only this", "in", None]


def test_informative(spark):
    df = spark.createDataFrame([("Failed to resolve table X", "bad"), ("no value here at all", "short one")],
                               "a string, b string")
    got = [r[0] for r in df.select(G.more_informative("a", "b")).collect()]
    assert got == ["Failed to resolve table X", "short one"]


def test_innermost_message_objects(spark):
    cases = [
        ('failed. Inner error: {"code": "a", "message": "near \\"x\\" on\\nline 2"} tail "message": "late"', 'near "x" on\nline 2'),
        ('Inner error: {"message":"outer","details":[{"message":"detail"}],"innererror":{"details":[{"message":"d"}],"message":"own"}} {"message":"later"}', "own"),
        ('Inner error: {"details":[{"message":"detail"}],"message":"own"}', "own"),
        ('Inner error: {"error":{"message":{"errorMessage":"deep"}}}', "deep"),
        ('Inner error: {"error":"Inner error: {\\"message\\":\\"in a string\\"}"}', "in a string"),
        ('Inner error: {"message":"cut', 'Inner error: {"message":"cut'),
        ('Inner error: {no json} {"message":"last"}', "last"),
        ('Inner error: {"code":"x"} tail', '{"code":"x"}'),
        ('{"error":{"code":7,"message":8}}', "8"), ("plain", "plain"), ("", ""), (None, None),
        ('{"z": 1, "code": 2}', '{"z": 1, "code": 2}'), ('Inner error: {"z": 1,  "a": 2} x', '{"z": 1,  "a": 2}'),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, e string")
    got = [r[1] for r in df.select("i", G.innermost_message("e")).orderBy("i").collect()]
    assert got == [w for _, w in cases]
