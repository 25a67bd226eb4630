"""T-5 in its older form, against all pairs by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from telemark.operators import retrieve as RT


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _score(q, e):
    q, e = (q or "").lower(), (e or "").lower()
    a, b = ({t for t in re.split("[^a-z0-9]+", x) if t} for x in (q, e))
    h = 10 * (e in q or q in e) + len(a & b) + any(_edits(x, y) <= 2 for x in a for y in b)
    h += 2 * bool({"workload", "latency"} & a & b) + 2 * bool({"pod", "pods"} & a and {"pod", "pods"} & b)
    return h


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_tokens_by_hand(spark, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("ab1") for _ in range(rnd.randint(1, 9))) for _ in range(120)]
    words += ["x" * 5000, "x" * 4998 + "y", "x" * 2000 + "zz" + "x" * 3000, "x" * 5003]
    left, right = words[::2] + words[-4:], words[1::2] + words[-4:]
    frame = lambda w: spark.createDataFrame([(x,) for x in w], "tok string")
    got = sorted(map(tuple, RT.near_tokens(frame(left), frame(right)).collect()))
    short = lambda x: len(x) < 100
    want = {(a, b) for a in left for b in right if short(a) and short(b) and _edits(a, b) <= 2}
    assert {p for p in got if short(p[0])} == want and len(got) == len(set(got))
    long = {p for p in got if not short(p[0])}
    assert ("x" * 5000, "x" * 4998 + "y") in long and ("x" * 5000, "x" * 2000 + "zz" + "x" * 3000) in long and ("x" * 5000, "x" * 5003) not in long


@pytest.mark.parametrize("k", [1, 3, 7])
def test_legacy_topk_by_hand(spark, k):
    rnd = random.Random(k)
    vocabulary = ["pod", "pods", "latency", "workload", "errors", "error", "cpu", "memory", "node", "restarts", "a", "qqqqqqqqqqqq", "zzzzzzzzz", "wwwwwwww"]
    text = lambda: " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 3)))
    examples = [(i, text()) for i in range(40)] + [(40, None), (41, ""), (42, "odd?!"), (43, "vvvvvvvvvvvvvv")]
    asked = [(i, text()) for i in range(30)] + [(30, None), (31, "kkkkkkkkkkkkkkkkkkkkk"), (32, "Pods!"), (33, "wwwwwwyy"), (34, "od")]
    got = RT.legacy_topk(spark.createDataFrame(asked, "q int, t string"), spark.createDataFrame(examples, "e int, t string"), q_id="q", q_text="t", e_id="e", e_text="t", k=k)
    want = []
    for i, t in asked:
        best = sorted(((-_score(t, x), e) for e, x in examples))[:k]
        want += [(i, r, e, -h) for r, (h, e) in enumerate(best, 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_legacy_topk_empty(spark):
    q, e = spark.createDataFrame([(1, "a")], "q int, t string"), spark.createDataFrame([(2, "a")], "e int, t string")
    run = lambda a, b: RT.legacy_topk(a, b, q_id="q", q_text="t", e_id="e", e_text="t").count()
    assert run(q, e) == 1 and run(q.filter(F.lit(False)), e) == 0 and run(q, e.filter(F.lit(False))) == 0


def shuffled_rows(df) -> int:
    """Rows that all exchanges of a finished query wrote."""
    df.collect()

    def rows(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return rows(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return rows(node.plan())
        own = node.metrics().get("shuffleRecordsWritten").get().value() if name == "ShuffleExchangeExec" else 0
        below = node.children()
        return own + sum(rows(below.apply(i)) for i in range(below.size()))
    return rows(df._jdf.queryExecution().executedPlan())


def test_legacy_topk_near_tokens_make_no_pairs(spark):
    """Each token of 300 questions is near each token of 60 examples: no row for each such pair."""
    rnd = random.Random(5)
    left, right = ([a + b for a in x for b in "0123456789"] for x in ("abcd", "efgh"))
    asked = [(i, " ".join(rnd.sample(left, 20))) for i in range(300)]
    examples = [(i, " ".join(rnd.sample(right, 20))) for i in range(60)]
    got = RT.legacy_topk(spark.createDataFrame(asked, "q int, t string"), spark.createDataFrame(examples, "e int, t string"), q_id="q", q_text="t", e_id="e", e_text="t")
    assert shuffled_rows(got) < 50 * len(asked)
    assert sorted(map(tuple, got.collect())) == [(q, r, r - 1, 1) for q in range(300) for r in range(1, 5)]
