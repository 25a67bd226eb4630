"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of hashed word shingles.  Two documents link when
``100 * intersection >= percent * union``.  Wanted are the components of the
links, so a link inside a component already known need not be drawn.

Prefixes.  If two sets share ``o`` elements, their first ``size - o + l``
elements in any common order share at least ``l``.  Each document first keeps
such a prefix in hash order, long enough for ``l = 1 + SPARE % of its size``
matches (its list).  The document frequency of every listed element is counted
over all documents; copies in several partitions are listed once, but for a
few.  Lists are then put in order of frequency, and a prefix of
a list is taken by the same rule: elements of one document need not be indexed
at all, and passages that many documents share come last.  This second prefix
is lengthened, and ``k`` shared elements required, for the ``k`` of least
estimated cost: postings read plus candidates to verify.

Candidates.  All documents of a posting are first paired with one hub, the
member whose elements are together the most frequent (edited copies have rare
ones instead); verified pairs give components.
Then only pairs of different components remain.  They are enumerated in blocks
of a posting, and leave a task only where sizes and sketches allow a link.
A pair leaves from one of its common postings if its documents' ``HEAD`` least
elements show ``k`` common ones: from that of the ``k``-th; else from each, to
be counted.  Pairs that share ``k`` elements are verified on their whole sets.

Sketches.  A sketch has one bit a slot: whether an odd number of the set's
elements fall there.  Two sets differ in at least as many elements as their
sketches in bits, so no pair that links is left out by them.  Larger sets, which
fill a short sketch, have a second of four bits an element for pairs already
made; it folds to any shorter one.  Hubs' pairs pass these sketches as well.

No step brings a whole posting, component or table to one task; only bitmaps
of fixed size are broadcast.

Defined results: a null, empty or blank text has no shingles and links with
nothing; one of fewer words than a shingle has the whole sequence as its one
shingle; equal word sequences share a component; repeated rows stay; a null id
takes part but never names a component that has another id; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telemark.llm import common as C
from telemark.llm.graph import components

SHINGLE = 5
PERCENT = 80
SPARE = 10          # percent of a set's size by which lists are longer than a plain prefix
MAX_MATCHES = 4     # the most shared elements that a second prefix may require
VERIFY_COST = 8     # cost of verifying a candidate, in postings
SKETCH = 128        # bytes of a sketch
FINE = 2048         # bytes of the longest sketch of a larger set
HEAD = 8            # least indexed elements that tell a pair's common postings
BLOCK = 1024        # documents of a posting that meet in one task
HUB_BLOCK = 256     # documents verified against one copy of a hub's set
BITS = 23
OFTEN_BITS = 26     # of the bitmap of elements that several documents list

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text) -> F.Column:
    """Hashed words, A to Z in lower case; none for null."""
    w = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return F.transform(w, lambda x: F.xxhash64(x))


def shingles(w: np.ndarray, k: int) -> np.ndarray:
    """The sorted set of hashed shingles of one document."""
    if not len(w):
        return np.zeros(0, np.uint64)
    v = w.view(np.uint64)
    n = max(len(v) - k + 1, 1)
    h = np.full(n, np.uint64(min(len(v), k)))
    for j in range(min(k, len(v))):
        h = h * _BASE + v[j:j + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(29)))


def _documents(batch: pa.RecordBatch):
    """(row, words, digest) of each document of a batch, the digest in 8 and 4 bytes."""
    column = batch.column("w")
    off, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        w = flat[off[i]:off[i + 1]]
        h = hashlib.blake2b(w.tobytes(), digest_size=12).digest()
        yield i, w, int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


class Sizes:
    """Prefix lengths by set size, for numbers and columns alike."""

    def __init__(self, percent: int, spare: int):
        self.percent, self.spare = percent, spare

    def overlap(self, n: int) -> int:
        return -(-self.percent * n // 100)

    def matches(self, n: int) -> int:
        return min(self.overlap(n), 1 + self.spare * n // 100)

    def listed(self, n: int) -> int:
        return n - self.overlap(n) + self.matches(n)

    def required(self, n) -> F.Column:
        """Listed elements that a document shares with any it links to, at
        least: as many as the smallest such document's list allows."""
        t = F.expr(f"({self.percent} * {n} + 99) div 100")
        return F.least(F.floor((t * self.percent + 99) / 100), 1 + F.floor(t * self.spare / 100)).cast("int")


SLICE = 256         # documents of a batch that a task holds in more than one form


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return C.sliced(batches, SLICE)


def _sketch(s: np.ndarray, size: int = SKETCH) -> bytes:
    odd = np.bincount((s >> np.uint64(7)).astype(np.int64) % (8 * size), minlength=8 * size) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` elements can link by their sketches, in rows of 64-bit words."""
    while a.shape[1] != b.shape[1]:     # the longer folds
        a, b = (a, b) if a.shape[1] > b.shape[1] else (b, a)
        a = a[:, :a.shape[1] // 2] ^ a[:, a.shape[1] // 2:]
    apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    most = (n + m - apart) // 2
    return 100 * most >= percent * (n + m - most)


def _profiles(k: int, sizes: Sizes):
    schema = pa.schema([("row", pa.int64()), ("c", pa.int64()), ("dn", pa.int64()), ("list", pa.list_(pa.int64())), ("sketch", pa.binary()), ("fine", pa.binary()), ("part", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen: set = set()       # documents of this partition
        for b in _sliced(batches):
            out = {f.name: [] for f in schema}
            for i, w, c, d in _documents(b):
                s, listed, sketch, fine = None, None, None, None
                if (c, d) not in seen:
                    seen.add((c, d))
                    s = shingles(w, k)
                    listed = s[:sizes.listed(len(s))].view(np.int64)
                    sketch = _sketch(s)
                    if len(s) > 4 * SKETCH:
                        fine = _sketch(s, min(FINE, 1 << (len(s) // 2 - 1).bit_length()))
                n = len(s) if s is not None else len(shingles(w, k))
                for name, value in zip(out, (i, c, (d << 32) | n, listed, sketch, fine, part)):
                    out[name].append(value)
            r = pa.RecordBatch.from_pydict(out, schema=schema)
            yield pa.RecordBatch.from_arrays([b.column("id"), *r.columns[1:]], names=["id", *schema.names[1:]])
    return run


def _node(c: str, dn: str) -> F.Column:
    """A document's node: its digest, as text."""
    return F.concat_ws(".", F.col(c).cast("string"), F.shiftright(F.col(dn), 32).cast("string"))


_N = "cast({} & 2147483647 as int)"


def _once(profile: DataFrame):
    """``(rows, keep)``: the lists, and a filter of their batches that leaves out
    copies of a document from partitions other than its first.  By the keys alone:
    a first bitmap holds the copies, a second the other rows that hit it.  So one
    row of each document stays for certain, and few copies do."""
    slot = F.shiftrightunsigned(F.xxhash64("c", "dn", "part"), 64 - BITS).alias("slot")
    rows = profile.filter("list is not null")
    # not more entries than partitions
    parts = rows.groupBy("c", "dn").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    parts = C.written(parts, "parts")
    copies = C.bitmap(parts.select("c", "dn", F.explode(F.expr("slice(parts, 2, size(parts))")).alias("part")).select(slot), BITS)
    sc = profile.sparkSession.sparkContext
    gone = sc.broadcast(copies)

    def hits(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            yield b.filter(pa.array(C.probe(gone.value, b.column("slot").to_numpy().astype(np.uint64))))

    kept = sc.broadcast(C.bitmap(parts.select("c", "dn", F.expr("parts[0]").alias("part")).select(slot).mapInArrow(hits, "slot long"), BITS))
    C.spent(parts)

    def keep(b: pa.RecordBatch) -> pa.RecordBatch:
        at = b.column("slot").to_numpy().astype(np.uint64)
        return b.filter(pa.array(~C.probe(gone.value, at) | C.probe(kept.value, at)))

    return rows.select("c", "dn", "list", slot), keep


def _index(profile: DataFrame, sizes: Sizes) -> DataFrame:
    """``(e, c, dn, k, pop)``: the elements under which a document is found, the
    matches it requires, and how often others list its elements (logarithms of
    the frequencies, summed)."""
    lists, keep = _once(profile)

    def elements(batches: Iterator[pa.RecordBatch]):
        for b in _sliced(batches):
            yield pa.RecordBatch.from_arrays([keep(b).column("list").flatten()], names=["e"])

    often = lists.mapInArrow(elements, "e long").groupBy("e").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    often = C.written(often, "often")
    # most elements are of one document: a bitmap of the others leaves them out before the lists are dealt by element
    shared = profile.sparkSession.sparkContext.broadcast(C.bitmap(often.select(F.shiftrightunsigned("e", 64 - OFTEN_BITS).alias("slot")), OFTEN_BITS))

    def listed(batches: Iterator[pa.RecordBatch]):
        bits = shared.value
        for b in map(keep, _sliced(batches)):
            column = b.column("list")
            e = column.flatten().to_numpy()
            row = np.repeat(np.arange(b.num_rows), np.diff(column.offsets.to_numpy()))
            met = C.probe(bits, e.view(np.uint64) >> np.uint64(64 - OFTEN_BITS))
            at = pa.array(row[met])
            yield pa.RecordBatch.from_arrays([b.column("c").take(at), b.column("dn").take(at), pa.array(e[met])], names=["c", "dn", "e"])

    rows = lists.mapInArrow(listed, "c long, dn long, e long")
    rows = rows.join(often, "e").dropDuplicates(["e", "c", "dn"])
    doc = W.partitionBy("c", "dn")
    rows = (rows.withColumn("n", F.expr(_N.format("dn"))).withColumn("q", sizes.required("n"))
            .withColumn("m", F.count(F.lit(1)).over(doc)).filter("m >= q")
            .withColumn("at", F.row_number().over(doc.orderBy("df", "e"))))
    cost = []
    for k in range(1, MAX_MATCHES + 1):
        s = F.sum(F.when(F.col("at") <= F.col("m") - F.col("q") + k, F.col("df")).otherwise(0)).over(doc)
        cost.append(F.when(F.lit(k) <= F.col("q"), F.struct((s * (1 + VERIFY_COST / k)).alias("cost"), F.lit(k).alias("k"))))
    pop = F.sum(F.floor(F.log2("df") * 16).cast("long")).over(doc)
    rows = rows.select("e", "c", "dn", "m", "q", "at", F.least(*cost)["k"].alias("k"), pop.alias("pop"))
    index = C.written(rows.filter("at <= m - q + k").select("e", "c", "dn", "k", "pop"), "index")
    C.spent(often)
    return index


def _allowed(a: str, b: str, percent: int) -> F.Column:
    """Whether two sizes allow a link."""
    x, y = F.expr(_N.format(a)), F.expr(_N.format(b))
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _hub_pairs(index: DataFrame, percent: int) -> DataFrame:
    hubs = index.groupBy("e").agg(F.max(F.struct("pop", "c", "dn")).alias("h")).select("e", F.col("h.c").alias("ac"), F.col("h.dn").alias("adn"))
    return (index.select("e", F.col("c").alias("bc"), F.col("dn").alias("bdn")).join(hubs, "e")
            .filter((F.col("ac") != F.col("bc")) | (F.col("adn") != F.col("bdn"))).filter(_allowed("adn", "bdn", percent))
            .select("ac", "adn", "bc", "bdn").distinct())


def _each(index: DataFrame, profile: DataFrame) -> DataFrame:
    """``(c, dn, k, head, sketch, fine)`` of each document of the index."""
    head = F.slice(F.sort_array(F.collect_list("e")), 1, HEAD)      # of one document's elements
    each = index.groupBy("c", "dn").agg(F.first("k").alias("k"), head.alias("head"))
    sketches = profile.filter("sketch is not null").groupBy("c", "dn").agg(F.first("sketch").alias("sketch"), F.first("fine").alias("fine"))
    return C.written(each.join(sketches, ["c", "dn"]), "each")


def _possible(pairs: DataFrame, each: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches allow a link."""
    for x in ("a", "b"):
        mine = each.select(F.col("c").alias(f"{x}c"), F.col("dn").alias(f"{x}dn"), F.coalesce("fine", "sketch").alias(f"{x}sketch"))
        pairs = pairs.join(mine, [f"{x}c", f"{x}dn"])
    names = ["ac", "adn", "bc", "bdn"]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            n, m = (b.column(x).to_numpy() & 0x7FFFFFFF for x in ("adn", "bdn"))
            u, v = (b.column(x).to_pylist() for x in ("asketch", "bsketch"))
            may = [bool(_may_link(np.frombuffer(u[i], np.uint64)[None], np.frombuffer(v[i], np.uint64)[None], n[i:i + 1], m[i:i + 1], percent)[0]) for i in range(len(u))]
            yield b.select(names).filter(pa.array(may, pa.bool_()))

    return pairs.select(*names, "asketch", "bsketch").mapInArrow(run, "ac long, adn long, bc long, bdn long")


def _cross_pairs(index: DataFrame, labels: DataFrame, each: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share the required matches."""
    mark = labels.select(F.col("node").alias("node_"), "label")
    each = each.withColumn("node", _node("c", "dn"))
    each = each.join(mark, each.node == mark.node_, "left").select("c", "dn", "k", "head", F.xxhash64(F.coalesce("label", "node")).alias("label"), "sketch")
    each = C.written(each, "each")
    rows = index.select("e", "c", "dn").join(each.select("c", "dn", "label"), ["c", "dn"])
    mixed = rows.groupBy("e").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi")
    mixed = mixed.select("e", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    # a document of a posting of many blocks meets each other block once
    own = F.pmod(F.xxhash64("c", "dn"), F.col("blocks")).cast("int")
    rows = rows.select("e", "c", "dn").join(mixed, "e").withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("e", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "c", "dn").join(each, ["c", "dn"])
    rows = rows.repartition("e", "i", "j").sortWithinPartitions("e", "i", "j", "c", "dn")
    schema = "ac long, adn long, bc long, bdn long, n int, k int"

    def run(batches: Iterator[pa.RecordBatch]):
        for t in _runs(batches, ("e", "i", "j")):
            yield from _block_pairs(t, percent)

    pairs = rows.mapInArrow(run, schema)
    return pairs.groupBy("ac", "adn", "bc", "bdn").agg(F.sum("n").alias("n"), F.first("k").alias("k")).filter("n >= k").select("ac", "adn", "bc", "bdn")


def _runs(batches: Iterator[pa.RecordBatch], keys) -> Iterator[pa.Table]:
    """Consecutive rows of equal keys, over batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in keys]
        new = np.zeros(b.num_rows, bool)
        new[0] = last is not None and tuple(c[0] for c in cols) != last
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cut = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for a, z in zip(cut, cut[1:]):
            if new[a] and held:
                yield pa.Table.from_batches(held)
                held = []
            if z > a:
                held.append(b.slice(a, z - a))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def _block_pairs(t: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    if t.num_rows < 2:
        return
    c, dn, k, label, own, i, j = (t.column(x).to_numpy() for x in ("c", "dn", "k", "label", "own", "i", "j"))
    sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH // 8)
    heads, e = [set(h) for h in t.column("head").to_pylist()], t.column("e")[0].as_py()
    n = dn & 0x7FFFFFFF
    for lo in range(0, len(n), 64):
        a = slice(lo, lo + 64)
        ok = (np.minimum(n[a][:, None], n[None]) * 100 >= np.maximum(n[a][:, None], n[None]) * percent) & (label[a][:, None] != label[None])
        # each pair once: within a block by position, between two blocks from the first to the second
        ok &= (np.arange(len(n))[a][:, None] < np.arange(len(n))[None]) if i[0] == j[0] else (own[a][:, None] == i[0]) & (own[None] == j[0])
        x, y = np.nonzero(ok)
        x += lo
        for s in range(0, len(x), 1 << 16):
            p, r = x[s:s + (1 << 16)], y[s:s + (1 << 16)]
            keep = _may_link(sketch[p], sketch[r], n[p], n[r], percent)
            p, r = p[keep], r[keep]
            need = np.minimum(k[p], k[r]).tolist()
            found = np.ones(len(p), np.int32)
            for at, (x_, y_, m_) in enumerate(zip(p.tolist(), r.tolist(), need)):
                common = sorted(heads[x_] & heads[y_])
                if len(common) >= m_:       # the pair's m_-th common posting speaks for all
                    found[at] = m_ if common[m_ - 1] == e else 0
            p, r, found = p[found > 0], r[found > 0], found[found > 0]
            if len(p):
                flip = (c[p] > c[r]) | ((c[p] == c[r]) & (dn[p] > dn[r]))
                p, r = np.where(flip, r, p), np.where(flip, p, r)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (c[p], dn[p], c[r], dn[r], found, np.minimum(k[p], k[r]).astype(np.int32))], names=["ac", "adn", "bc", "bdn", "n", "k"])


def _verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int, text_col: str) -> DataFrame:
    """``(a, b)``: the nodes of the pairs that link, by their whole sets; the
    written ``pairs`` are removed then.

    Sets are made anew from the texts of the documents in question, and meet by
    the first document of their pairs, in blocks.
    """
    spark = docs.sparkSession
    many = pairs.groupBy("ac", "adn").agg(F.ceil(F.count(F.lit(1)) / HUB_BLOCK).cast("int").alias("blocks"))
    placed = pairs.join(many, ["ac", "adn"]).withColumn("block", F.pmod(F.xxhash64("bc", "bdn"), F.col("blocks")).cast("int"))
    placed = C.written(placed, "placed")
    hub = placed.select(F.col("ac").alias("c"), F.col("adn").alias("dn"), "ac", "adn", "block", F.lit(0).alias("role")).distinct()
    member = placed.select(F.col("bc").alias("c"), F.col("bdn").alias("dn"), "ac", "adn", "block", F.lit(1).alias("role"))
    wanted = C.written(hub.union(member), "wanted")
    C.spent(placed)
    slot = F.shiftrightunsigned("c", 64 - BITS)
    shared = spark.sparkContext.broadcast(C.bitmap(wanted.select(slot.alias("slot")), BITS))

    def sets(batches: Iterator[pa.RecordBatch]):
        bits, seen = shared.value, set()
        for b in _sliced(batches):
            out = {"c": [], "dn": [], "s": []}
            for _, w, c, d in _documents(b):
                if (c, d) in seen or not C.probe(bits, np.array([c & 0xFFFFFFFFFFFFFFFF], np.uint64) >> np.uint64(64 - BITS))[0]:
                    continue
                seen.add((c, d))
                s = shingles(w, k)
                for name, value in zip(out, (c, (d << 32) | len(s), s.tobytes())):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("c", pa.int64()), ("dn", pa.int64()), ("s", pa.binary())]))

    whole = docs.select(words(F.col(text_col)).alias("w")).mapInArrow(sets, "c long, dn long, s binary")
    rows = whole.join(wanted, ["c", "dn"]).select("ac", "adn", "block", "role", "c", "dn", "s")
    rows = rows.repartition("ac", "adn", "block").sortWithinPartitions("ac", "adn", "block", "role")

    def check(batches: Iterator[pa.RecordBatch]):
        key, hub_set = None, None
        for b in _sliced(batches):
            out = {x: [] for x in ("ac", "adn", "c", "dn")}
            for ac, adn, block, role, c, dn, s in zip(*(b.column(x).to_pylist() for x in ("ac", "adn", "block", "role", "c", "dn", "s"))):
                s = np.frombuffer(s, np.uint64)
                if role == 0:
                    key, hub_set = (ac, adn, block), s
                elif key == (ac, adn, block) and len(hub_set):
                    both = int((hub_set[np.minimum(np.searchsorted(hub_set, s), len(hub_set) - 1)] == s).sum())
                    if 100 * both >= percent * (len(s) + len(hub_set) - both):
                        for x, v in zip(out, (ac, adn, c, dn)):
                            out[x].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(x, pa.int64()) for x in out]))

    links = rows.mapInArrow(check, "ac long, adn long, c long, dn long").select(_node("ac", "adn").alias("a"), _node("c", "dn").alias("b")).distinct()
    links = C.written(links, "links")
    C.spent(pairs, wanted)
    return links


def linked(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``(id, n_shingles, component)`` for every row of ``docs``: the size of
    its set and the least id among the documents its links reach."""
    C.small_batches(docs.sparkSession)
    sizes = Sizes(percent, SPARE)
    rows = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    id_type = docs.schema[id_col].dataType.simpleString()
    profile = C.written(rows.mapInArrow(_profiles(shingle, sizes), f"id {id_type}, c long, dn long, list array<long>, sketch binary, fine binary, part int"), "profiles")
    index = _index(profile, sizes)
    each = _each(index, profile)
    links = _verified(docs, C.written(_possible(_hub_pairs(index, percent), each, percent), "pairs"), shingle, percent, text_col)
    labels = components(links)
    pairs = C.written(_possible(_cross_pairs(index, labels, each, percent), each, percent), "pairs")
    C.spent(index, each)
    more = _verified(docs, pairs, shingle, percent, text_col)
    if more.head(1):
        labels = components(links.union(more))
    own = profile.select("id", F.expr(_N.format("dn")).cast("long").alias("n_shingles"), _node("c", "dn").alias("node"))
    mark = labels.withColumnRenamed("node", "node_")
    own = own.join(mark, own.node == mark.node_, "left").select("id", "n_shingles", F.coalesce("label", "node").alias("label"))
    least = own.filter("n_shingles > 0").groupBy("label").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("label", "least")
    some = own.filter("n_shingles > 0").join(least, "label", "left").select("id", "n_shingles", F.coalesce("least", "id").alias("component"))
    return some.union(own.filter("n_shingles = 0").select("id", "n_shingles", "id"))


def deduplicate(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: the least by id (null last),
    then by a hash of the text.  Rows without words all stay, but of rows that
    repeat id and text one stays."""
    text = F.sha2(F.coalesce(F.col(text_col), F.lit("\x00")), 256)
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), text)
    rows = docs.withColumn("key_", key)
    name = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("key_").alias("key"))
    own = C.written(linked(rows.select(name.alias("name"), F.col(text_col).alias("text")), "name", "text", shingle, percent).select("id", "component"), "components")
    gone = own.filter(~F.col("id").eqNullSafe(F.col("component"))).select(F.col("id.key").alias("key_"))
    twice = C.written(own.filter(F.col("id").eqNullSafe(F.col("component"))).groupBy(F.col("id.key").alias("key_")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key_"), "repeated")
    kept = C.without(rows, "key_", gone.union(twice))
    if twice.head(1):
        kept = kept.union(rows.join(twice, "key_", "left_semi").dropDuplicates(["key_"]).select(rows.columns))
    return kept.drop("key_")
