"""Text labels, fingerprints and hybrid retrieval (T-1..T-19)."""

from pyspark.sql import functions as F

from telemark.functions import text as TX
from telemark.operators import labels as LB
from telemark.operators import retrieve as RT


def test_normalize_and_fingerprint(spark):
    df = spark.createDataFrame([("T // c\n| where  x == 'a' /* b\n c */ | order by y desc",),
                                ("T | WHERE x=='a' | ORDER BY y",)], "q string")
    r = df.select(TX.normalize_query("q").alias("n"), TX.fingerprint_text("q").alias("f")).collect()
    assert r[0].n == "T | where x == 'a' | order by y desc"
    # the fingerprint keeps comments (only "// meta" lines go), drops "desc", tightens operators
    assert r[0].f == 'T // c|where x=="a" /* b c */|order by y'
    assert r[1].f == 'T|where x=="a"|order by y'
    f2 = df.select(TX.fingerprint("q")).collect()
    assert len(f2[0][0]) == 16


def test_validity_and_cleanup(spark):
    df = spark.createDataFrame([("```kql\nT | take 5\n```",), ("ok",), (".show tables",),
                                ("Sorry, I cannot do that",), ("// Error: nope",)], "t string")
    got = [r[0] for r in df.select(TX.validity_label(TX.clean_response("t"))).collect()]
    assert got == ["valid", "empty", "leading_dot", "error_response", "generation_error"]


def test_domain_and_intent(spark):
    df = spark.createDataFrame([
        ("pods pending in the app",), ("failed requests last 2 weeks",), ("error rate of happenings",),
        ("show KubePodInventory for my app",), ("count of traces past hour",), ("why is latency high",)], "q string")
    r = df.select(LB.domain_label("q").alias("d"), LB.domain_label("q", whole_token=True).alias("dt"),
                  LB.time_window("q").alias("w"), LB.metric_intent("q").alias("m"),
                  TX.wants_explanation("q").alias("x")).collect()
    assert [x.d for x in r] == ["containers", "appinsights", "appinsights", "containers", "appinsights",
                                "containers"]
    assert r[2].dt == "appinsights"
    assert [x.w for x in r] == ["", "14d", "", "", "1h", ""]
    assert r[2].m.metric_mode == "rate" and r[2].m.raw_metric_hint == "error rate"
    assert r[4].m.metric_mode == "count" and r[5].x


def test_context_notes_and_time_bound(spark):
    df = spark.createDataFrame([("slow crash with latency and restart",), ("T | where TimeGenerated > ago(7d)",)],
                               "q string")
    r = df.select(LB.context_notes("q").alias("n"), LB.has_time_bound("q").alias("b"),
                  LB.lookback_days("q").alias("d")).collect()
    assert len(r[0].n) == 2 and not r[0].b
    assert r[1].b and r[1].d == 7.0


def _brute(qs, es, k=4):
    import re

    def tok(t):
        return {x for x in re.split(r"[^a-z0-9]+", t.lower()) if len(x) > 1}

    out = []
    for qid, qt, qv in qs:
        qtok = tok(qt)
        scored = []
        for eid, et, ev in es:
            etok = tok(et)
            h = (10 if et.lower() in qt.lower() else 0) + len(qtok & etok)
            if ("workload" in etok and "workload" in qtok) or ("latency" in etok and "latency" in qtok):
                h += 2
            if ({"pod", "pods"} & etok) and ({"pod", "pods"} & qtok):
                h += 2
            cos = sum(a * b for a, b in zip(qv, ev)) if qv and ev else 0.0
            scored.append((eid, h, cos))
        hmax = max(h for _, h, _ in scored)
        fin = sorted(((0.55 * (h / hmax if hmax > 0 else 0.0) + 0.45 * c, eid) for eid, h, c in scored),
                     key=lambda x: (-x[0], x[1]))
        top = [x for x in fin if x[0] > 0][:k] or fin[:k]
        out += [(qid, i + 1, eid) for i, (_, eid) in enumerate(top)]
    return sorted(out)


def test_hybrid_topk_matches_brute_force_and_blocks(spark):
    qs = [(1, "pods pending with latency spikes in workload api", [1.0, 0.0]),
          (2, "nothing matches here at all", None), (3, "requests failed", [0.0, -1.0])]
    es = [(10, "pending pods", [0.6, 0.8]), (11, "latency of workload", [1.0, 0.0]), (12, "failed requests", None),
          (13, "zz", [0.0, 1.0]), (14, "pods", [-1.0, 0.0])]
    q = spark.createDataFrame(qs, "qid int, text string, v array<double>")
    e = spark.createDataFrame(es, "eid int, text string, v array<double>")
    want = _brute(qs, es)
    one = RT.hybrid_topk(q, e, q_id="qid", q_text="text", e_id="eid", e_text="text", q_vec="v", e_vec="v")
    many = RT.hybrid_topk(q, e, q_id="qid", q_text="text", e_id="eid", e_text="text", q_vec="v", e_vec="v", block=2)
    assert sorted((r.qid, r.rank, r.eid) for r in one.collect()) == want
    assert sorted((r.qid, r.rank, r.eid) for r in many.collect()) == want


def test_hybrid_topk_bounds_and_short_examples(spark):
    """Examples inside words, of one token, of none, both forms of pod, missing vectors and texts, any block size."""
    import random
    rnd = random.Random(4)
    words = ["pod", "pods", "latency", "workload", "api", "errors", "node", "x1", "of", "the"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    vec = lambda: rnd.choice([None, [rnd.uniform(-1, 1) for _ in range(3)], [0.0, 0.0, 0.0]])
    qs = [(i, text(rnd.choice((0, 1, 4, 12))) + rnd.choice(["", " apis", " xpodsx", "!? nodeless"]), vec()) for i in range(40)]
    es = [(100 + i, t, vec()) for i, t in enumerate(["", "?", "api", "ode", "ds", "pod api", "the node of", "Errors of"] + [text(rnd.choice((1, 3, 6))) for _ in range(12)])]
    q = spark.createDataFrame(qs, "qid int, text string, v array<double>")
    e = spark.createDataFrame(es, "eid int, text string, v array<double>")
    for k, block in ((4, 1024), (2, 3), (12, 7)):
        got = RT.hybrid_topk(q, e, q_id="qid", q_text="text", e_id="eid", e_text="text", q_vec="v", e_vec="v", k=k, block=block).collect()
        assert sorted((r.qid, r.rank, r.eid) for r in got) == _brute(qs, es, k)
    plain = RT.hybrid_topk(q, e, q_id="qid", q_text="text", e_id="eid", e_text="text").collect()
    assert sorted((r.qid, r.rank, r.eid) for r in plain) == _brute([(i, t, None) for i, t, _ in qs], es)
    assert RT.hybrid_topk(q, e.limit(0), q_id="qid", q_text="text", e_id="eid", e_text="text").count() == 0
    assert RT.hybrid_topk(q.limit(0), e, q_id="qid", q_text="text", e_id="eid", e_text="text").count() == 0


def test_hybrid_topk_plan(spark):
    """One plan: pairs come from equi-joins, no job runs while it is made."""
    q = spark.createDataFrame([(1, "a b c", [1.0])], "qid int, text string, v array<double>")
    e = spark.createDataFrame([(1, "b c d", [1.0])], "eid int, text string, v array<double>")
    jobs = lambda: max(spark.sparkContext.statusTracker().getJobIdsForGroup(None), default=-1)
    before = jobs()
    df = RT.hybrid_topk(q, e, q_id="qid", q_text="text", e_id="eid", e_text="text", q_vec="v", e_vec="v")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert jobs() == before
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "FlatMapGroupsInArrow" in plan


def test_heuristic_pairs_are_summed_once(spark):
    """Containment is joined to the summed pairs, which are not summed (and shuffled) again with it."""
    import re
    q = spark.createDataFrame([(1, "a pod is b", ["pod", "is"])], "qid int, qlow string, qtok array<string>")
    e = spark.createDataFrame([(2, "pod is", ["pod", "is"])], "eid int, elow string, etok array<string>")
    pairs = RT.heuristic_pairs(q, e)
    assert not re.search(r"Aggregate \[qid#\d+, eid#\d+\], [^\n]*sum[^\n]*\n[^\n]*Union", pairs._jdf.queryExecution().optimizedPlan().toString())
    assert [tuple(r) for r in pairs.collect()] == [(1, 2, 14)]


def test_index_header_and_dirty(spark):
    rows = spark.createDataFrame([("d1", 1, "q1", "k1"), ("d1", 2, "q2", "k2"), ("d2", 3, "q3", "k3")],
                                 "domain string, id int, q string, k string")
    cur = RT.index_header(RT.index_rows(rows, "domain", "id", "q", "k"))
    old = RT.index_header(RT.index_rows(rows.filter(F.col("id") != 2), "domain", "id", "q", "k"))
    d = {r.domain: r.reason for r in RT.dirty_domains(old, cur).collect()}
    assert d == {"d1": "hash", "d2": "ok"}
    ref = RT.reference_corpus_hash(rows, "domain", "id", "q", "k").collect()
    import hashlib
    h = hashlib.sha256(b"q1||k1\nq2||k2\n").hexdigest()[:32]
    assert {r.domain: r.examples_hash for r in ref}["d1"] == h


def test_dirty_domains_sees_a_pair_of_equal_rows(spark):
    one = [("d1", 1, "q", "k")]
    h = lambda rows: RT.index_header(RT.index_rows(spark.createDataFrame(rows, "domain string, id long, q string, k string"), "domain", "id", "q", "k"))
    got = RT.dirty_domains(h(one), h(one + 2 * [("d1", 2, "x", "y")])).collect()
    assert [(r.dirty, r.reason) for r in got] == [(True, "hash")]
    assert [r.reason for r in RT.dirty_domains(h(one), h(one)).collect()] == ["ok"]
