"""Operator 9 against all pairs, and the pipeline against brute-force stages."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from telemark.llm import jaccard, mixing, quality, tiling
from telemark.llm.graph import components
from telemark.llm.queries import QUERIES
from tests.conftest import SF001, SF01
from tests.llm.test_fingerprint_tiling import _brute_op8
from tests.llm.test_output_mix_shard_secrets import _check_tokens

LOWER = str.maketrans(jaccard.UPPER, jaccard.LOWER)


def _set(text, k):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def _components(rows, k, percent):
    """Least number of each row's component, by all pairs that share a shingle."""
    sets = [_set(t, k) for t in rows]
    found, root = defaultdict(list), list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        shared = Counter(j for e in s for j in found[e])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                root[b] = a
        for e in s:
            found[e].append(i)
    return sets, [top(i) for i in range(len(rows))]


def test_op9_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect())
    sets, top = _components([t for _, t in docs], 4, 85)
    want = {d: (len(s), docs[c][0]) for (d, _), s, c in zip(docs, sets, top)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op9_jaccard_join"](spark, SF01).collect()}
    assert got == want


def _made(seed, n, percent):
    """Near copies around the threshold, chains of them, common passages, short texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 5)))
    passages = [[word() for _ in range(25)] for _ in range(3)]
    texts = []
    while len(texts) < n:
        w = [word() for _ in range(rnd.choice((1, 2, 3, 4, 5, 9, 30, 80, 300)))]
        if rnd.random() < 0.5:
            w[rnd.randint(0, len(w)):0] = rnd.choice(passages)
        for _ in range(rnd.choice((1, 1, 2, 12))):
            texts.append(" ".join(w))
            if rnd.random() < 0.7:
                w = [word() if rnd.random() < rnd.choice((0.01, 0.03, 0.05)) else x for x in w]
            if rnd.random() < 0.2:
                w = w[:max(1, int(len(w) * 0.95))]
    return texts[:n]


@pytest.mark.parametrize("k, percent, block", [(4, 85, 4), (5, 80, 1024), (2, 60, 8)])
def test_op9_made_tables(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)        # postings cut into many blocks
    texts = _made(k, 260, percent)
    _, top = _components(texts, k, percent)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.id: r.component for r in jaccard.linked(docs, shingle=k, percent=percent).collect()}
    assert got == dict(enumerate(top))


EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (None, "a b c d e f g"), (9, "a b c d e f g"), (7, "A b c d e f g"), (7, "A b c d e f g"),
        (8, "x " * 40_000), (10, "É b c d e f"), (11, "é b c d e f")]


def test_op9_edges(spark):
    docs = spark.createDataFrame([(*r, "z", 1) for r in EDGE], "doc_id long, text string, component string, C long")
    got = Counter((r.id, r.n_shingles, r.component) for r in jaccard.linked(docs).collect())
    assert got == Counter([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (None, 3, 7), (9, 3, 7), (7, 3, 7), (7, 3, 7), (8, 1, 8), (10, 2, 10), (11, 2, 11)])
    kept = jaccard.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 8, 10, 11]
    assert jaccard.linked(docs.limit(0)).count() == 0 and jaccard.deduplicate(docs.limit(0)).count() == 0
    nulls = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert jaccard.deduplicate(nulls).count() == 9


def test_op9_copies_and_near_misses_are_left_out_early(spark, monkeypatch):
    rnd, seen, written = random.Random(5), defaultdict(list), jaccard.C.written

    def counted(df, name, codec=None):
        out = written(df, name, codec)
        seen[name].append(out.count())
        return out

    monkeypatch.setattr(jaccard.C, "written", counted)
    texts = [[f"w{rnd.random()}" for _ in range(200)] for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts * 4)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "doc_id long, text string")     # each copy in a partition of its own
    got = {r.id: r.component for r in jaccard.linked(docs, shingle=4, percent=85).collect()}
    assert got == {i: i % 30 for i in range(120)}
    assert seen["often"] == [0]         # no element of different documents
    seen.clear()
    near = [[f"x{rnd.random()}" if i % 30 == 7 else w for i, w in enumerate(t)] for t in texts]     # 169 shingles of 225 in common
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts + near)], "doc_id long, text string")
    got = {r.id: r.component for r in jaccard.linked(docs, shingle=4, percent=85).collect()}
    assert got == {i: i for i in range(60)}
    assert seen["often"][0] > 0 and seen["pairs"] == [0, 0]


def test_sketches_keep_all_links():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 40, 450, 3000, 20_000):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        for share in (1, 0.97, 0.93, 0.92, 0.9, 0.8, 0.5, 0):
            b = np.concatenate([a[:int(n * share)], rng.integers(0, 2**63, int(n * rng.uniform(0, 0.1)) + n - int(n * share), dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            for size in ((128, 128), (512, 512), (1024, 512), (128, 2048)):
                sketch = [np.frombuffer(jaccard._sketch(x, z), np.uint64)[None] for x, z in zip((a, b), size)]
                may = jaccard._may_link(*sketch, np.array([len(a)]), np.array([len(b)]), 85)
                assert may[0] or 100 * both < 85 * (len(a) + len(b) - both)
            if n == 3000 and share <= 0.8:
                fine = [np.frombuffer(jaccard._sketch(x, 2048), np.uint64)[None] for x in (a, b)]
                assert not jaccard._may_link(*fine, np.array([len(a)]), np.array([len(b)]), 85)[0]


def test_components_of_chains(spark):
    rnd = random.Random(3)
    edges = [(f"n{i:04}", f"n{i + 1:04}") for i in range(150) if i % 50 != 49] + [("m1", "m2"), ("m2", "m1"), ("z", "z")]
    rnd.shuffle(edges)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {**{f"n{i:04}": f"n{i // 50 * 50:04}" for i in range(150)}, "m1": "m1", "m2": "m1"}


def test_pipeline_stages(spark):
    start = spark.read.parquet(f"{SF001}/documents.parquet")
    docs, rows = start, {r.doc_id: r for r in start.collect()}
    stages = dict(P.STAGES)
    assert list(stages) == ["quality", "dedup", "decontaminate", "mix", "tokens"]

    kept = stages["quality"](spark, docs, SF001)
    model = quality.fit(docs, spark.read.parquet(f"{SF001}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert kept.columns == start.columns and {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s >= quality.THRESHOLD}

    unique = stages["dedup"](spark, docs, SF001)
    order = sorted(rows)
    _, top = _components([rows[i].text for i in order], 5, 80)
    assert unique.columns == start.columns and {r.doc_id for r in unique.collect()} == {order[c] for c in top}

    clean = stages["decontaminate"](spark, docs, SF001)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    hit = {d for d, _, _ in _brute_op8([(i, r.text) for i, r in rows.items()], items)}
    assert clean.columns == start.columns and {r.doc_id for r in clean.collect()} == set(rows) - hit

    mixed = stages["mix"](spark, docs, SF001)
    want = Counter({r.id: r.copies for r in mixing.plan(docs).collect()})
    assert mixed.columns == start.columns and Counter(r.doc_id for r in mixed.collect()) == +want

    _check_tokens(stages["tokens"](spark, docs, SF001).collect(), sorted((i, r.text) for i, r in rows.items()))


def test_pipeline_run(spark):
    out = P.run(spark, SF001).collect()
    assert out and set(out[0].asDict()) == {"doc_id", "start", "n_tokens", "ids_crc32"}
    out.sort(key=lambda r: r.start)
    assert all(a.start + a.n_tokens == b.start and a.doc_id <= b.doc_id for a, b in zip(out, out[1:]))


def test_pipeline_on_empty_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a text of some words", "en", "s", 3)], spark.read.parquet(f"{SF001}/documents.parquet").schema)
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF001).count() == 0, name
        assert stage(spark, docs, SF001).count() >= 0, name


def test_bitmap_packed_in_tasks(spark, monkeypatch):
    import numpy as np
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    from telemark.llm import common
    monkeypatch.setattr(Classic, "toLocalIterator", None)        # no row by row pass
    rng = np.random.default_rng(5)
    for bits, n in ((23, 5000), (18, 3), (10, 50), (20, 0)):
        slots = rng.integers(0, 1 << bits, n)
        want = np.zeros(1 << (bits - 3), np.uint8)
        for s in slots.tolist():
            want[s >> 3] |= 1 << (s & 7)
        df = spark.createDataFrame([(int(s),) for s in slots] * 2, "slot long")
        assert np.array_equal(common.bitmap(df, bits), want)
