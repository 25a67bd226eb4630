"""Loaders and sinks on small hand-made files (``csv_small``, ``md_small``, ``manifest_small``)."""

import json
import os

from pyspark.sql import functions as F

from telemark.sources import corpus as S
from telemark.sources import manifest as M
from telemark.sources import sinks as K


def _w(d, name, text):
    p = os.path.join(d, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_prompt_csv_variants(spark, tmp_dir):
    a = _w(tmp_dir, "a.csv", 'Question,KQL\n"how many pods","KubePodInventory | count"\n')
    b = _w(tmp_dir, "b.csv", 'prompt;expected\nerrors today;AppRequests | where Success == false\n')
    c = _w(tmp_dir, "c.csv", 'NL\tQuery\nlatency\tT | take 1\n')
    d = _w(tmp_dir, "d.csv", '"list nodes","KubeNodeInventory | distinct Computer"\n')
    e = _w(tmp_dir, "e.csv", '﻿Prompt,Query\n"multi\nline, with comma","T\n| where x == ""y"""\n,\n')
    got = {k: S.read_prompt_csv(spark, p).collect() for k, p in dict(a=a, b=b, c=c, d=d, e=e).items()}
    assert got["a"][0].prompt == "how many pods" and got["a"][0].expected_query == "KubePodInventory | count"
    assert got["b"][0].expected_query == "AppRequests | where Success == false"
    assert got["c"][0].prompt == "latency"
    assert got["d"][0].prompt == "list nodes"
    assert len(got["e"]) == 1 and got["e"][0].prompt == "multi\nline, with comma"
    assert got["e"][0].expected_query == 'T\n| where x == "y"'


def test_prompt_lines_unquoted_commas(spark, tmp_dir):
    p = _w(tmp_dir, "q.csv", "Prompt,Query\nshow pods, nodes, and errors,T | take 5\n")
    r = S.read_prompt_lines(spark, p).collect()
    assert r[0].prompt == "show pods, nodes, and errors" and r[0].expected_query == "T | take 5"


def test_eval_dataset(spark, tmp_dir):
    j = _w(tmp_dir, "d.jsonl", json.dumps({"id": "1", "prompt": "p", "expected_kql": "q",
                                           "required_columns": ["a"], "tolerances": {"numeric_abs": 0.1}}) + "\n")
    c = _w(tmp_dir, "d.csv", 'id,prompt,expected_kql,required_columns,tolerances\n2,p2,q2,a|b,"{""numeric_rel"": 0.2}"\n')
    rj = S.read_eval_dataset(spark, j).collect()[0]
    rc = S.read_eval_dataset(spark, c).collect()[0]
    assert rj.required_columns == ["a"] and rj.tolerances == {"numeric_abs": 0.1}
    assert rc.required_columns == ["a", "b"] and rc.tolerances == {"numeric_rel": 0.2}


def test_markdown_examples(spark, tmp_dir):
    _w(tmp_dir, "m1.md", "# T\n**How many?**\n\n```kql\nT | count\n```\n**No fence here**\ntext\n"
                         "**Second?**\n```KQL\nT\n| take 1\n```\n")
    _w(tmp_dir, "m2.md", "Q: legacy one\nKQL:\nT | take 2\n\nQ: legacy two\nKQL:\nT | count\n")
    rows = S.read_markdown_examples(spark, os.path.join(tmp_dir, "*.md")).collect()
    got = sorted((r.question, r.kql) for r in rows)
    assert ("How many?", "T | count") in got
    assert ("legacy one", "T | take 2") in got and ("legacy two", "T | count") in got
    # the unfenced question is paired with the next fence, as the reference does
    assert ("No fence here", "T\n| take 1") in got


def test_markdown_catalog(spark, tmp_dir):
    _w(tmp_dir, "c.md", "# Title A\n```\nT | take 1\n```\n## Title B\nAppRequests | count\n```\nno pipe\n```\n")
    rows = S.read_markdown_catalog(spark, os.path.join(tmp_dir, "c.md")).orderBy("pos").collect()
    assert [(r.title, r.kql) for r in rows] == [("Title A", "T | take 1"), ("Title B", "AppRequests | count")]
    heads = S.read_markdown_catalog(spark, os.path.join(tmp_dir, "c.md"), headings_only=True).collect()
    assert [h.title for h in heads] == ["Title A"]


def test_manifest_flatten(spark, tmp_dir):
    m1 = {"type": "Microsoft.Insights/components", "tables": ["AppRequests", {"name": "AppTraces",
          "columns": [{"name": "Message", "type": "string", "description": "text"}]}],
          "queries": [{"name": "q1", "relatedTables": ["AppTraces", "AppRequests"]}, {"name": "q2"}]}
    m2 = {"resources": [{"meta": {"type": "Microsoft.ContainerService/managedClusters",
                                  "children": [{"tables": [{"tableName": "KubePodInventory"}]}]}}]}
    _w(tmp_dir, "m1.json", json.dumps(m1))
    _w(tmp_dir, "m2.json", json.dumps(m2))
    _w(tmp_dir, "m3.json", "{broken")
    flat = M.manifest_nodes(M.read_manifest_texts(spark, os.path.join(tmp_dir, "*.json")))
    t = {(r.resource_type, r.table_name) for r in M.manifest_tables(flat).collect()}
    assert ("Microsoft.Insights/components", "AppRequests") in t
    assert ("Microsoft.ContainerService/managedClusters", "KubePodInventory") in t
    cols = M.manifest_columns(flat).collect()
    assert [(c.table_name, c.column_name, c.column_type) for c in cols] == [("AppTraces", "Message", "string")]
    qs = sorted(((r.query_name, r.table_name) for r in M.manifest_queries(flat).collect()), key=str)
    assert qs == [("q1", "AppRequests"), ("q1", "AppTraces"), ("q2", None)]
    assert [r.content for r in M.unparsable_manifests(flat).collect()] == ["{broken"]


def _layout(content):
    """Brute force: the nodes of one document, in its order."""
    def walk(path, v):
        kind = {dict: "object", list: "list", str: "text"}.get(type(v), "other")
        yield tuple(path), kind, v if kind == "text" else None
        for k, x in v.items() if kind == "object" else enumerate(v) if kind == "list" else ():
            yield from walk([*path, str(k)], x)
    return list(walk([], json.loads(content)))


def test_manifest_nodes_by_level(spark):
    deep = "leaf"
    for i in range(12):
        deep = {f"k{i}": deep, "n": [i, None, True, 1.5, "[not a list]"], "": {}} if i % 2 else [deep, "\u00e9\"q\"\n", "{x}", []]
    good = {"a": json.dumps({"z": 1, "a": ["2", {"b": "c"}], "m": {}}), "b": json.dumps(deep), "c": " [] ", "d": '"s"', "e": "3", "f": "null"}
    bad = {"g": "{broken", "h": "", "i": None, "j": "{} x", "k": '{"a": 1, "a": 2}', "l": '{"a": 1}, {"b": 2}'}
    nodes = M.manifest_nodes(spark.createDataFrame([*good.items(), *bad.items()], "path string, content string"))
    rows = nodes.orderBy("file", "pos").collect()
    for f, content in good.items():
        assert [(tuple(r.path), r.kind, r.text) for r in rows if r.file == f] == _layout(content), f
    assert {r.file: r.text for r in rows if r.kind == "unparsable"} == bad
    empty = M.manifest_nodes(spark.createDataFrame([], "path string, content string"))
    assert empty.count() == 0 and M.manifest_tables(empty).count() == 0


def test_large_manifest_is_no_single_task(spark):
    types = [{"type": f"a/b{i}", "tables": [{"name": f"T{i}_{j}", "columns": [{"name": "c"}]} for j in range(20)]} for i in range(200)]
    nodes = M.manifest_nodes(spark.createDataFrame([("f", json.dumps({"resources": types}))], "path string, content string"))
    entries = nodes.filter((F.size("path") == 2) & (F.col("kind") == "object")).withColumn("raw", F.lit('{"x": 1}'))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shares = M._opened(entries).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r["count"] for r in shares) == 200 and max(r["count"] for r in shares) < 100    # of one document
    tables = M.manifest_tables(nodes)
    assert tables.count() == 4000 and tables.groupBy("resource_type").count().filter("count <> 20").count() == 0
    assert M.manifest_columns(nodes).count() == 4000


def test_sinks(spark, tmp_dir):
    df = spark.createDataFrame([(1, "x", "why", {"status": "ok", "elapsed_sec": "0.1"})],
                               "case_id int, llm_grade string, reasoning string, gen_stats map<string,string>")
    flat = K.flatten_exec_stats(K.strip_report_fields(df), {"gen_stats": ["status", "elapsed_sec", "elapsed.sec"]})
    assert flat.columns == ["case_id", "gen_status", "gen_elapsed_sec", "gen_elapsed_sec_2"]
    assert tuple(flat.collect()[0]) == (1, "ok", "0.1", None)
    assert "gen_stats" in K.flatten_exec_stats(df).columns
    rec = K.runlog_record(spark.createDataFrame([("a" * 300,)], "content string")).collect()[0]
    assert len(rec.content_hash) == 16 and rec.content_preview.endswith("...TRUNCATED...")
    assert len(rec.content_preview) == 240 + len("...TRUNCATED...")
    rows = spark.createDataFrame([("d1", 1), ("d2", 2)], "domain string, id int")
    out = os.path.join(tmp_dir, "idx")
    K.write_index(rows, out)
    K.write_index(spark.createDataFrame([("d1", 9)], "domain string, id int"), out)
    got = sorted((r.domain, r.id) for r in spark.read.parquet(out).collect())
    assert got == [("d1", 9), ("d2", 2)]      # d1 replaced, d2 untouched


def test_prompts_get_different_ids_and_bad_rows_are_kept_apart(spark, tmp_dir):
    _w(tmp_dir, "p.csv", "prompt,expected_query\nsame,T\nsame,T\n,Q\nother,T\n")
    path = os.path.join(tmp_dir, "p.csv")
    rows = S.read_prompt_csv(spark, path).collect()
    assert [r.prompt for r in rows].count("same") == 2 and len({r.case_id for r in rows}) == 3
    assert [r.expected_query for r in S.bad_prompt_rows(spark, path).collect()] == ["Q"]


def test_index_sink_replaces_only_given_domains(spark, tmp_dir):
    path = os.path.join(tmp_dir, "idx")
    K.write_index(spark.createDataFrame([("a", 1), ("b", 1)], "domain string, x int"), path)
    K.write_index(spark.createDataFrame([("b", 2)], "domain string, x int"), path)
    assert sorted((r.domain, r.x) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2)]
