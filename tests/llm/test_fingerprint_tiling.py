"""Operators 3 and 8 against brute-force versions, and their edge rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemark.llm import phrases, tiling
from telemark.llm.queries import QUERIES
from tests.conftest import SF001, SF01

EDGE = [(1, None), (2, ""), (3, "a"), (4, "same text here"), (5, "same text here"), (5, "same text here"), (7, "word " * 60_000), (None, "no id"), (8, "ééé字🙂" * 9), (9, "aaaaaaaaaaaaaaaa")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, "x", "y") for r in EDGE], "doc_id long, text string, fingerprint string, id string")


def _plain_levels(raw):
    """The parse of one text, symbol by symbol."""
    toss = lambda a, b: (lambda k: 2 * k + (b >> k & 1))(((a ^ b) & -(a ^ b)).bit_length() - 1 if a != b else 0)
    v, out = list(raw), []
    for level in range(3):
        runs = []
        for x in v:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        if level == 0:
            sym = [x for x, _ in runs]
            names = phrases._mix(np.array([x + (n << 8) for x, n in runs], np.uint64)).tolist()
        else:
            sym = names = [int(phrases._mix(np.array([x], np.uint64) + np.array([n], np.uint64) * phrases._M3)[0]) if n > 1 else x for x, n in runs]
        lab = sym
        for _ in range(3 if level == 0 else 4):
            lab = [(lab[i] & 1) if i == 0 else toss(lab[i - 1], lab[i]) for i in range(len(lab))]
        at = [i for i in range(len(lab)) if i == 0 or i < len(lab) - 1 and lab[i] > lab[i - 1] and lab[i] > lab[i + 1]]
        v = []
        for a, z in zip(at, [*at[1:], len(lab)]):
            h = sum(names[i] * int(phrases._PLACE[(i - a) & 63]) for i in range(a, z)) % (1 << 64)
            v.append(int(phrases._mix(np.array([h], np.uint64))[0]))
        out.append(v)
    return out


def test_parse_equals_plain_version(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").limit(12).collect()] + [t or "" for _, t in EDGE if len(t or "") < 1000]
    raws = [t.encode() for t in texts]
    got = phrases.levels(raws)
    for i, raw in enumerate(raws):
        if raw:
            want = _plain_levels(raw)
            for level in range(3):
                assert got[level][0][got[level][1] == i].tolist() == want[level]
        else:
            assert not any((owner == i).any() for _, owner in got)


def test_equal_substrings_share_interior_names():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(1, 9)))
    core = " ".join(word() for _ in range(400))
    a, b = (" ".join(word() for _ in range(n)) + core + " ".join(word() for _ in range(n)) for n in (13, 57))
    for level in range(3):
        x, y, z = (set(phrases.levels([t.encode()])[level][0].tolist()) for t in (core, a, b))
        assert len(x & y & z) >= 0.8 * len(x) - 3
    assert phrases.likeness(*phrases.fingerprints([core, core])) == 1.0
    other = " ".join(word() for _ in range(400))
    assert phrases.likeness(*phrases.fingerprints([core, other])) < 0.1


def _brute_op3(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        h = len(t) // 2
        e = t[:len(t) - h] + n[:h]
        f = phrases.fingerprints([t, e, n])
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f[0], f[1], phrases.likeness(f[0], f[1]), phrases.likeness(f[0], f[2])))
    return sorted(map(str, out))


def test_op3_brute_force(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    rows = QUERIES["op3_fingerprints"](spark, SF001).collect()
    assert sorted(str(tuple(r)) for r in rows) == _brute_op3(docs)
    near = [r.near_edited for r in rows if r.n_chars > 200]
    assert 0.35 < sum(near) / len(near) < 0.65


def test_op3_edges(edge):
    assert sorted(str(tuple(r)) for r in phrases.compare_with_next(edge).collect()) == _brute_op3([(i, t or "") for i, t in EDGE])
    one = phrases.compare_with_next(edge.filter("doc_id = 8")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert phrases.compare_with_next(edge.limit(0)).count() == 0
    nulls = phrases.compare_with_next(edge.withColumn("doc_id", F.lit(None).cast("long")))
    assert nulls.count() == len(EDGE)


def _brute_tiles(pattern, text, least):
    """Greedy string tiling without hashes: the longest match of unmarked words, again and again."""
    up, ut, tiles = set(), set(), []
    while True:
        best = (least - 1, 0, 0)
        for p in range(len(pattern)):
            for t in range(len(text)):
                k = 0
                while p + k < len(pattern) and t + k < len(text) and p + k not in up and t + k not in ut and pattern[p + k] == text[t + k]:
                    k += 1
                if k > best[0]:
                    best = (k, p, t)
        k, p, t = best
        if k < least:
            return tiles
        tiles.append(k)
        up.update(range(p, p + k))
        ut.update(range(t, t + k))


def test_tiles_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(150):
        p, t = ([rnd.randint(1, rnd.choice((2, 4, 40))) for _ in range(rnd.randint(0, 40))] for _ in range(2))
        for _ in range(rnd.randint(0, 3)):
            a = rnd.randint(0, max(len(p) - 1, 0))
            t[rnd.randint(0, len(t)):0] = p[a:a + rnd.randint(3, 20)]
        least = rnd.choice((2, 3, 5))
        got = tiling.greedy_tiles(p, t, least)
        for a, b, k in got:
            assert p[a:a + k] == t[b:b + k] and k >= least
        for side in (0, 1):
            spans = sorted((m[side], m[side] + m[2]) for m in got)
            assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        want = _brute_tiles(p, t, least)
        assert max((k for *_, k in got), default=0) == max(want, default=0)
        assert sum(k for *_, k in got) >= 0.8 * sum(want)


def _tok(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def _brute_op8(docs, items):
    out = set()
    for i, t in items:
        p = _tok(t)
        grams = {tuple(p[j:j + 5]) for j in range(len(p) - 4)}
        for d, text in docs:
            w = _tok(text)
            if any(tuple(w[j:j + 5]) in grams for j in range(len(w) - 4)):
                c = sum(k for _, _, k in tiling.greedy_tiles([hash(x) % 2 ** 60 for x in p], [hash(x) % 2 ** 60 for x in w], 5))
                if c >= 0.5 * len(p):
                    out.add((d, i, c))
    return out


def test_op8_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id, r.covered) for r in QUERIES["op8_decontaminate"](spark, SF01).collect()}
    assert got and got == _brute_op8(docs, items)


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def test_op8_reordered_and_edges(spark, edge):
    w = ITEM.split()
    bench = spark.createDataFrame([(1, ITEM, "x"), (1, ITEM, "x"), (2, None, "x"), (3, "", "x"), (4, "too few words", "x")], "item_id int, text string, blob string")
    texts = [(30, "Start. " + " ".join(w[12:20]) + " middle words of mine " + " ".join(w[:7]) + " end"),      # reordered: 15 of 20
             (31, " ".join(w[:9]) + " and other things"), (32, ITEM.upper().replace(" ", ", ")), (33, " ".join(w[:5]) + " x " + " ".join(w[5:10])), (34, "too few words")]
    docs = edge.select("doc_id", "text", "id").union(spark.createDataFrame([(*t, "z") for t in texts], "doc_id long, text string, id string"))
    docs = docs.union(docs.filter("doc_id = 32"))
    rows = tiling.contaminated(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.covered) for r in rows) == sorted([(30, 1, 15), (32, 1, 20), (33, 1, 10)] * 2 + [(32, 1, 20)] * 2)
    kept = tiling.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted([i or -1 for i, _ in EDGE] + [31, 34])
    assert tiling.contaminated(docs.limit(0), bench).count() == 0
    assert tiling.contaminated(docs, bench.limit(0)).count() == 0
    assert tiling.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_op8_repeated_line_item(spark):
    """An item of one line again and again has few different seeds, and is found all the same."""
    item = " ".join(["oh my dear clementine lost"] * 12)
    docs = spark.createDataFrame([(1, f"before it {item} after it"), (2, "oh my dear clementine lost and gone"), (3, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([("song", item)], "item_id string, text string")
    found = [tuple(r) for r in tiling.contaminated(docs, items).collect()]
    assert [(r[0], r[1], r[3], r[4]) for r in found] == [(1, "song", 60, 1.0)]
    assert [r[0] for r in tiling.decontaminate(docs, items).orderBy("doc_id").collect()] == [2, 3]


@pytest.mark.parametrize("text", ["la " * 400, "x" * 1000, ("=" * 40 + "\n") * 30, "ab" * 300])
def test_repetitive_texts_are_like_near_copies(text):
    a, b, other = phrases.fingerprints([text, text + "y", "The mayor opened a bridge over the river. " * 20])
    assert phrases.likeness(a, b) >= 0.4
    assert phrases.likeness(a, other) == 0.0


def test_one_rule_for_all_lengths():
    """Whether level 1 is kept hangs on the names of level 2 alone, so near copies on both sides of 256 bytes compare."""
    rnd = random.Random(9)
    base = " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(60))
    for n in (100, 200, 253, 300, 400):
        a, b = phrases.fingerprints([base[:n], base[:n] + "zyx"])
        assert phrases.likeness(a, b) >= 0.5
        for f in (a, b):
            one, two, _ = f.split(".")
            assert bool(one) == (len(two) < 8 * phrases.ENOUGH[1])


def test_op8_short_items(spark, edge):
    """Items under five words are found whole, as words and in order, by brute force."""
    bench = spark.createDataFrame([(1, "too few words"), (2, "alpha"), (3, ""), (4, None), (5, "two words"), (5, "two words"), (6, ITEM), (7, "a b a b")], "item_id int, text string")
    texts = [(40, "Too FEW, words!"), (41, "too few other words"), (42, "alphabet"), (43, "x alpha y alpha"), (44, "words two words"), (45, ITEM), (46, "b a b a b"), (47, "two"), (48, "few words too")]
    docs = edge.select("doc_id", "text").union(spark.createDataFrame([*texts, (46, "b a b a b")], "doc_id long, text string"))
    want = []
    for i, t in [(r.item_id, r.text) for r in bench.collect()]:
        p = _tok(t)
        for d, text in [tuple(r) for r in docs.collect()]:
            w = _tok(text)
            if p and any(w[j:j + len(p)] == p for j in range(len(w) - len(p) + 1)):
                want.append((d, i, len(p), 1.0))
    rows = tiling.contaminated(docs, bench, short_items=True).collect()
    assert sorted((r.doc_id, r.item_id, r.covered, r.coverage) for r in rows) == sorted(want)
    assert {(40, 1), (43, 2), (44, 5), (45, 6), (46, 7)} <= {(r.doc_id, r.item_id) for r in rows}
    kept = {r.doc_id for r in tiling.decontaminate(docs, bench, short_items=True).collect()}
    assert kept >= {41, 42, 47, 48} and not kept & {40, 43, 44, 45, 46}
    assert tiling.contaminated(docs.limit(0), bench, short_items=True).count() == 0
    assert tiling.contaminated(docs, bench.limit(0), short_items=True).count() == 0


def test_words_are_looked_at_in_slices(monkeypatch):
    """A batch of many texts does not become arrays over all its words at once."""
    import pyarrow as pa

    class Items:
        def mapInArrow(self, run, schema):
            self.run = run
            return self

    n = 5 * tiling.SLICE + 3
    flat = np.arange(10 * n)
    batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, 10 * n + 1, 10), pa.int32()), pa.array(flat))], names=["w"])
    most, seen, seeds = [], [], tiling.seeds
    monkeypatch.setattr(tiling, "seeds", lambda flat, offsets, k: most.append(len(offsets) - 1) or seeds(flat, offsets, k))
    monkeypatch.setattr(tiling.C, "bitmap", lambda slots, bits: seen.extend(x for b in slots.run([batch]) for x in b.column("slot").to_pylist()))
    tiling._bitmap(Items(), 5, 26)
    h, inside = seeds(flat, np.arange(0, 10 * n + 1, 10), 5)
    assert set(seen) == set((h[inside] >> np.uint64(38)).tolist()) and max(most) <= tiling.SLICE and sum(most) == n
