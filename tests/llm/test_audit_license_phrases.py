"""Operators 11 to 13 against brute-force versions, and their odd rows."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from telemark.llm import collocations as K
from telemark.llm import filter_audit as A
from telemark.llm import licenses as L
from telemark.llm.queries import QUERIES
from tests.conftest import SF001

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UP, LOW)


# --- 11 ---------------------------------------------------------------------

def _audit(docs, labels):
    """Every order applied to the documents, filter by filter."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rows = []
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum(c in UP for c in t) > 10 * len(t),
                 "D": bool(set(t) & set("#$%&*|")), "E": i is not None and i > least[t]}
        rows.append((part or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                removed = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                shapley[part, x] += len(removed)
                out[part, order, step] = [len(left), len(removed), sum(x in r[1] for r in own) - len(removed), sum(r[1] == {x} for r in own), sum(r[2] for r in removed), sum(r[3] for r in removed)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def _got_audit(docs, labels):
    marks = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    rows = A.audit(A.cells(A.failure_rows(docs), labels, marks), "ABCDE", tuple(marks)).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(got) == len(rows)
    return got


def test_op11_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF001}/documents.parquet"), spark.read.parquet(f"{SF001}/labels.parquet")
    want = _audit([(r.doc_id, r.text, r.lang) for r in docs.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in QUERIES["op11_filter_audit"](spark, SF001).collect()}
    assert got == want


def test_op11_odd_rows(spark):
    many = "Wort " * 60_000
    docs = [(1, None, None), (2, "", "en"), (3, "", "en"), (3, "", "en"), (None, "", "en"), (None, None, ""), (4, "A b#", "de"), (5, " A  b# ", "de"), (6, many, "de"), (7, many, None), (8, many, None),
            (9, " ".join(f"w{i}" for i in range(150)), "de"), (10, "É É é \x1f word\x85word", "fr"), (8, "| x", "de")]
    labels = [(1, 1, 0), (1, 0, 1), (3, 1, 1), (6, None, 1), (None, 1, 1), (9, 1, None), (99, 1, 1)]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, lang string, part string, N int").repartition(4)
    l = spark.createDataFrame([(*r, 5) for r in labels], "doc_id long, quality int, toxic int, part int")
    assert _got_audit(d, l) == _audit(docs, labels)
    assert _got_audit(d, l.limit(0)) == _audit(docs, [])
    assert _got_audit(d.limit(0), l) == {}


# --- 12 ---------------------------------------------------------------------

def _words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(FOLD))


def _licenses(text):
    """Every block against every template, and every place of a phrase."""
    w, places, base, labels, score = _words(text), [], set(), set(), 0.0
    for i, t in enumerate(L.TEMPLATES):
        own, s = L.words_of(t.text), L.stride(t)
        for b in range(0, len(w), s):
            block = w[b:b + 2 * s]
            shared = len(set(own) & set(block))
            if 100 * shared < t.percent * len(set(own)):
                continue
            if t.phrase:
                here = [b + j for j in range(min(s, len(block))) if block[j:j + len(own)] == own]
                if not here:
                    continue
                places += here * (i < len(L.BASE))
            labels.add(t.label)
            base |= {t.label} if i < len(L.BASE) else set()
            score = max(score, shared / len(set(own)))
    every = sorted(j for t in L.BASE for j in range(len(w)) if w[j:j + len(L.words_of(t.text))] == L.words_of(t.text))
    assert sorted(places) == every      # blocks lose no place and count none twice
    return (len(w), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(base)), ",".join(sorted(labels)), pytest.approx(score))


def _made_licenses(seed, n):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        w = [rnd.choice(["the", "by", "all", "public", "license", "rights", "cc", "x", "é", "y9", "software", "of"]) for _ in range(rnd.choice((0, 1, 3, 40, 300)))]
        for _ in range(rnd.randint(0, 4)):
            t = L.words_of(rnd.choice(L.TEMPLATES).text)
            if rnd.random() < 0.5:
                t = [x for x in t if rnd.random() < 0.9]
            if rnd.random() < 0.3:
                rnd.shuffle(t)
            at = rnd.randint(0, len(w))
            w[at:at] = t
        out.append("".join(x.upper() + rnd.choice([" ", "-", ", ", "\n"]) if rnd.random() < 0.3 else x + " " for x in w))
    return out


def test_op12_brute_force(spark):
    texts = [*_made_licenses(1, 150), None, "", " \t", "cc by", "CC-BY cc by", "all rights reserved " * 3000, "x" * 3_000_000 + " CC BY", ("word é, " * 300_000) + "general public license by cc by all rights reserved"]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, ID int").repartition(5)
    got = {r.id: tuple(r)[1:] for r in L.report(docs).collect()}
    assert got == {i: _licenses(t) for i, t in enumerate(texts)}


def test_op12_documents_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    rows = QUERIES["op12_license_scan"](spark, SF001).collect()
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in rows}
    assert len(rows) == len(docs) and got == {r.doc_id: _licenses(r.text) for r in docs}
    odd = spark.createDataFrame([(None, "cc by cc by"), (None, "cc by cc by"), (1, "cc by"), (1, "all rights reserved"), (1, None)], "doc_id long, text string")
    assert Counter((r.id, r.n_base, r.labels) for r in L.report(odd).collect()) == Counter([(None, 2, "cc-by"), (None, 2, "cc-by"), (1, 1, "cc-by"), (1, 1, "reserved"), (1, 0, "")])
    assert L.report(odd.limit(0)).count() == 0


def test_op12_join_is_on_rare_words(spark):
    """The prefix of a template holds its rarest words by the counts of all documents."""
    index = L.Index(L.TEMPLATES, {w: {"license": 5, "public": 9, "general": 7}.get(w, 100) for t in L.TEMPLATES for w in L.words_of(t.text)})
    gpl = next(i for i, t in enumerate(L.TEMPLATES) if t.text == "general public license")
    assert [index.order[p[1]] for p in index.prefix if p[2] == gpl] == ["license"]


# --- 13 ---------------------------------------------------------------------

def _pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD))]


def _collocations(docs, least=30, top=2000):
    f = defaultdict(Counter)
    for text, lang in docs:
        for w in _pieces(text):
            for i in range(len(w)):
                for n in range(1, 5):
                    if i + n <= len(w):
                        f[lang or "und" if lang is None else lang][tuple(w[i:i + n])] += 1
    out = []
    for lang, c in f.items():
        total = sum(v for k, v in c.items() if len(k) == 1)
        cand = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        longest = Counter()
        for k, v in cand.items():
            for n in range(2, len(k)):
                for i in range(len(k) - n + 1):
                    longest[k[i:i + n]] = max(longest[k[i:i + n]], v)
        rows = []
        for k, a in cand.items():
            score, _, l, r = min((2000000 * a // (c[k[:j]] + c[k[j:]]), j, c[k[:j]], c[k[j:]]) for j in range(1, len(k)))
            if 100 * longest[k] < 80 * a:
                rows.append((-score, -a, " ".join(k).encode(), a, l, r))
        out += [(lang, i, p.decode(), a, l, r, total, -s) for i, (s, _, p, a, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def _made_phrases(seed, n):
    rnd = random.Random(seed)
    vocabulary = ["a", "b", "c", "É", "é", "d#", "\x1f", "zz", "Q"]
    out = []
    for _ in range(n):
        w = [rnd.choice(vocabulary) for _ in range(rnd.choice((0, 1, 2, 3, 4, 5, 6, 30, 200)))]
        w[len(w) // 2:len(w) // 2] = rnd.choice([[], "one two Three four five six".split(), ["la"] * 40])
        out.append(("".join(x + rnd.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " "]) for x in w), rnd.choice(["en", "en", "de", None])))
    return out


def test_op13_brute_force(spark):
    rows = [*_made_phrases(1, 200), (None, "en"), ("", None), ("only one", "fr"), ("ha " * 20_000, "de"), ("x y " * 400_000, "fr"), ("z" * 2_000_000, "fr")]
    docs = spark.createDataFrame([(*r, "p", 1) for r in rows], "text string, lang string, part string, F int").repartition(5)
    for least, top in ((30, 2000), (3, 25)):
        got = sorted(tuple(r) for r in K.mine(docs, least=least, top=top).collect())
        assert got == _collocations(rows, least, top)
    assert K.mine(docs.limit(0)).count() == 0


def test_op13_documents(spark):
    docs = [(r.text, r.lang) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    rows = QUERIES["op13_collocations"](spark, SF001).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(tuple(r) for r in rows) == _collocations(docs)


@pytest.mark.parametrize("held, piece, own", [(1 << 19, 1 << 20, 1024), (50, 30, 5), (7, 1, 4)])
def test_parse_counts_each_occurrence_once(monkeypatch, held, piece, own):
    """Whatever the chunk, slice and batch borders, n-grams by their chunks are n-grams of the texts."""
    monkeypatch.setattr(K, "HELD_WORDS", held)
    monkeypatch.setattr(K, "CHUNK_WORDS", own)
    monkeypatch.setattr(K.B, "SLICE", piece)
    monkeypatch.setattr(K.B.slices, "__defaults__", (piece, b" "))
    rows = _made_phrases(7, 60)
    batch = pa.RecordBatch.from_pydict({"part": [p or "und" for _, p in rows], "text": [t for t, _ in rows]})
    got = Counter()
    for r in K._parse(iter([batch])):
        for part, chunk, is_open, weight in zip(*(c.to_pylist() for c in r.columns)):
            w = chunk.decode().split(" ")
            for i in range(len(w) - K.OVERLAP if is_open else len(w)):
                for n in range(1, 5):
                    if i + n <= len(w):
                        got[part, tuple(w[i:i + n])] += weight
    want = Counter()
    for t, p in rows:
        for w in _pieces(t):
            want.update((p or "und", tuple(w[i:i + n])) for i in range(len(w)) for n in range(1, 5) if i + n <= len(w))
    assert got == want


def test_equal_passages_give_equal_chunks():
    passage = [f"w{i * i % 97}" for i in range(400)]
    texts = [" ".join(f"a{i}" for i in range(k)) + " " + " ".join(passage) for k in (0, 5, 33)]
    sets = [set(next(iter(K._parse(iter([pa.RecordBatch.from_pydict({"part": ["x"], "text": [t]})])))).column("chunk").to_pylist()) for t in texts]
    assert len(sets[0] & sets[1] & sets[2]) >= 0.8 * len(sets[0])


def test_long_chunks_are_counted_few_at_a_time(spark, monkeypatch):
    """Words counted together are bounded by bytes, whatever a chunk's length; none is left out or counted twice."""
    class Chunks:
        def mapInArrow(self, run, schema):
            self.run = run
            return self

        def __getattr__(self, name):
            return lambda *a, **k: self

    monkeypatch.setattr(K, "HELD_WORDS", 1000)
    monkeypatch.setattr(K.C, "written", lambda df, name: df)
    sizes, grams = [], K._grams
    monkeypatch.setattr(K, "_grams", lambda t, *a: sizes.append(sum(map(len, t.column("chunk").to_pylist()))) or grams(t, *a))
    chunk = [b" ".join([b"w%d" % (i % 7)] * n) for i, n in enumerate([1000] * 40 + [1] * 500 + [5000] + [3] * 50)]
    n = len(chunk)
    batches = [pa.RecordBatch.from_pydict({"part": ["en"] * n, "chunk": pa.array(chunk, pa.binary()), "open": [False] * n, "weight": [2] * n})] * 2
    chunks = Chunks()
    K._level(chunks, 1, None, 1, 10)
    got = Counter()
    for b in chunks.run(batches):
        for phrase, f in zip(b.column("phrase").to_pylist(), b.column("f").to_pylist()):
            got[phrase] += f
    want = Counter(w.decode() for c in chunk for w in c.split())
    assert got == Counter({w: 4 * f for w, f in want.items()}) + Counter({None: 4 * want.total()})
    assert max(sizes) <= 6000 + max(map(len, chunk)) and sum(sizes) == 2 * sum(map(len, chunk))
