"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased words of letters and digits, hashed.  A seed is a run of
``MIN_MATCH`` words.  Documents keep only the stretches in which some seed may
occur (a bitmap of fixed size, filled from the benchmark, tells), and
documents and items that share a seed are joined on it.  For each such pair,
running Karp-Rabin finds the longest common stretches; they are marked as
tiles, longest first, never overlapping, down to ``MIN_MATCH`` words.  Tiles
may lie in any order, so reordered passages are caught.  A document is
contaminated by an item when its tiles cover at least ``COVERAGE`` of the
item's words.  With ``short_items`` an item of fewer than ``MIN_MATCH`` words is
one seed of its own length and contaminates the documents in which it stands
whole; the registered query and the pipeline ask for that.

Equal texts share one verdict, keyed by their SHA-256.

Defined results: null and empty texts and items match nothing, nor do
items of fewer than ``MIN_MATCH`` words without ``short_items``; repeated items give one row
each; empty tables give no rows; extra columns are ignored (and kept by
``decontaminate``).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemark.llm import common as C

MIN_MATCH = 5
COVERAGE = 0.5
SLICE = 256             # texts whose words are looked at together
BITMAP_BITS = 26        # the bitmap takes 2 ** 26 bits, whatever the benchmark's size
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text) -> F.Column:
    """Hashes of the lower-cased words of letters and digits; none for null."""
    w = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.transform(w, lambda x: F.xxhash64(x))


def seeds(flat: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of all runs of ``k`` words, and whether each lies within one text."""
    n = max(len(flat) - k + 1, 0)
    h = np.zeros(n, np.uint64)
    v = flat.view(np.uint64)
    for j in range(k):
        h = h * _BASE + v[j:j + n]
    h ^= h >> np.uint64(29)
    inside = np.ones(n, bool)
    for end in range(1, k):
        cut = offsets[1:-1] - end
        inside[cut[(cut >= 0) & (cut < n)]] = False
    return h, inside


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    off = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]].astype(np.int64, copy=False), off - off[0]


def greedy_tiles(pattern: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Tiles ``(pattern start, text start, length)`` by running Karp-Rabin
    greedy string tiling; a negative word in ``text`` matches nothing."""
    mod = (1 << 61) - 1
    used_p, used_t = [False] * len(pattern), [w < 0 for w in text]
    tiles = []

    def windows(seq, used, s):
        """(start, hash) of the runs of s unused words, by a rolling hash."""
        top, h, held = pow(31, s, mod), 0, 0
        for i, w in enumerate(seq):
            if used[i]:
                h, held = 0, 0
                continue
            h, held = (h * 31 + w) % mod, held + 1
            if held > s:
                h = (h - seq[i - s] * top) % mod
            if held >= s:
                yield i - s + 1, h

    s = max(least, min(len(pattern), 32))
    while True:
        table = defaultdict(list)
        for t, h in windows(text, used_t, s):
            table[h].append(t)
        matches, longest = [], 0
        for p, h in windows(pattern, used_p, s):
            for t in table.get(h, ()):
                k = 0
                while p + k < len(pattern) and t + k < len(text) and not used_p[p + k] and not used_t[t + k] and pattern[p + k] == text[t + k]:
                    k += 1
                if k >= s:
                    matches.append((k, p, t))
                    longest = max(longest, k)
        if longest > 2 * s:
            s = longest
            continue
        again = False
        for k, p, t in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if not any(used_p[p:p + k]) and not any(used_t[t:t + k]):
                tiles.append((p, t, k))
                used_p[p:p + k] = used_t[t:t + k] = [True] * k
            else:
                again = True        # what is left of it may be a shorter match
        if again and longest > s:
            continue
        if s == least:
            return tiles
        s = max(least, s // 2)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few texts, so that a task's arrays over all their words stay small."""
    return C.sliced(batches, SLICE)


def _bitmap(items: DataFrame, min_match: int, bits: int) -> np.ndarray:
    def slots(batches: Iterator[pa.RecordBatch]):
        for b in _slices(batches):
            flat, off = _flat(b.column("w"))
            h, inside = seeds(flat, off, min_match)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(h[inside] >> np.uint64(64 - bits)).astype(np.int64))], names=["slot"])

    return C.bitmap(items.mapInArrow(slots, "slot long"), bits)


def matches(docs: DataFrame, benchmark: DataFrame, text_col="text", item_col="item_id", item_text_col="text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, bits: int = BITMAP_BITS, short_items: bool = False) -> DataFrame:
    """``(blob, item_id, n_tiles, covered, coverage)``: the text (by SHA-256) and
    item pairs at or above the threshold."""
    spark = docs.sparkSession
    C.small_batches(spark)
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("w"))
    whole = C.written(items.filter(F.size("w") > 0), "items")
    items, short = whole.filter(F.size("w") >= min_match), whole.filter(F.size("w") < min_match)
    # fewer than min_match lengths
    lengths = sorted(r[0] for r in short.select(F.size("w")).distinct().collect()) if short_items else []
    shared = spark.sparkContext.broadcast(_bitmap(items.select("w"), min_match, bits))

    def stretches(batches: Iterator[pa.RecordBatch]):
        bitmap = shared.value
        for b in _slices(batches):
            flat, off = _flat(b.column("w"))
            h, inside = seeds(flat, off, min_match)
            slot = h >> np.uint64(64 - bits)
            hit = np.flatnonzero(C.probe(bitmap, slot) & inside)
            if not len(hit):
                continue
            owner = np.searchsorted(off, hit, side="right") - 1
            blob = b.column("blob")
            rows = {"blob": [], "seeds": [], "w": []}
            for lo, hi in zip(*_groups(owner)):
                at = hit[lo:hi]
                gap = np.flatnonzero(np.diff(at) > min_match)
                text = []
                for a, z in zip([0, *(gap + 1)], [*gap, len(at) - 1]):
                    text += [*flat[at[a]:at[z] + min_match].tolist(), None]
                rows["blob"].append(blob[int(owner[lo])].as_py())
                rows["seeds"].append(np.unique(h[at].view(np.int64)).tolist())
                rows["w"].append(text)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("blob", pa.string()), ("seeds", pa.list_(pa.int64())), ("w", pa.list_(pa.int64()))]))

    def item_seeds(batches: Iterator[pa.RecordBatch]):
        for b in _slices(batches):
            flat, off = _flat(b.column("w"))
            h, inside = seeds(flat, off, min_match)
            at = np.flatnonzero(inside)
            item = b.column("item").to_numpy()[np.searchsorted(off, at, side="right") - 1] if len(at) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(item), pa.array(np.diff(off)[np.searchsorted(off, at, side="right") - 1].astype(np.int32) if len(at) else np.zeros(0, np.int32))], names=["seed", "item", "n_words"])

    found = docs.select(F.sha2(F.col(text_col), 256).alias("blob"), words(F.col(text_col)).alias("w")).filter(F.size("w") >= min_match)
    found = found.mapInArrow(stretches, "blob string, seeds array<long>, w array<long>").dropDuplicates(["blob"])
    found = C.written(found, "stretches")
    index = (items.select("item", "w").mapInArrow(item_seeds, "seed long, item long, n_words int")
             .groupBy("seed", "item", "n_words").agg(F.count(F.lit(1)).alias("occurs")))
    pairs = (found.select("blob", F.explode("seeds").alias("seed")).join(index, "seed")
             .groupBy("blob", "item").agg(F.sum("occurs").alias("n"), F.first("n_words").alias("n_words"))
             # shared seeds that occur n times in the item cover n * min_match of its words at most
             .filter(F.col("n") * min_match >= F.col("n_words") * F.lit(coverage)).select("blob", "item"))
    both = pairs.join(found.select("blob", "w"), "blob").join(items.select("item", "item_id", F.col("w").alias("p")), "item")
    out_type = benchmark.schema[item_col].dataType.simpleString()

    def tile(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            out = {"n_tiles": [], "covered": [], "coverage": []}
            for p, w in zip(b.column("p").to_pylist(), b.column("w").to_pylist()):
                tiles = greedy_tiles([x + (1 << 63) for x in p], [-1 if x is None else x + (1 << 63) for x in w], min_match)
                c = sum(k for _, _, k in tiles)
                out["n_tiles"].append(len(tiles))
                out["covered"].append(c)
                out["coverage"].append(c / len(p))
            made = [pa.array(out[x], t) for x, t in (("n_tiles", pa.int64()), ("covered", pa.int64()), ("coverage", pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column("blob"), b.column("item_id"), *made], names=["blob", "item_id", *out])

    tiled = both.mapInArrow(tile, f"blob string, item_id {out_type}, n_tiles long, covered long, coverage double").filter(F.col("coverage") >= coverage)
    return tiled.union(_whole(docs, short, lengths, text_col, bits)) if lengths else tiled


def _whole(docs: DataFrame, short: DataFrame, lengths: list[int], text_col: str, bits: int) -> DataFrame:
    """``matches`` for items of these few lengths: the pairs in which the whole item stands."""
    schema = "seed long, n_words int"

    def runs(b: pa.RecordBatch, n: int):
        flat, off = _flat(b.column("w"))
        h, inside = seeds(flat, off, n)
        at = np.flatnonzero(inside)
        return h[at], np.searchsorted(off, at, side="right") - 1

    def item_seeds(batches: Iterator[pa.RecordBatch]):
        for b in _slices(batches):
            size = np.diff(_flat(b.column("w"))[1])
            for n in lengths:
                h, owner = runs(b, n)
                own = size[owner] == n
                yield pa.RecordBatch.from_arrays([pa.array(h[own].view(np.int64)), pa.array(np.full(own.sum(), n, np.int32)), b.column("item").take(pa.array(owner[own]))],
                                                 names=["seed", "n_words", "item"])

    index = C.written(short.select("item", "w").mapInArrow(item_seeds, schema + ", item long"), "short")
    shared = docs.sparkSession.sparkContext.broadcast(C.bitmap(index.select(F.shiftrightunsigned("seed", 64 - bits).alias("slot")), bits))

    def text_seeds(batches: Iterator[pa.RecordBatch]):
        bitmap = shared.value
        for b in _slices(batches):
            for n in lengths:
                h, owner = runs(b, n)
                hit = C.probe(bitmap, h >> np.uint64(64 - bits))
                each = pa.table({"seed": h[hit].view(np.int64), "owner": owner[hit]}).group_by(["seed", "owner"]).aggregate([])
                yield pa.RecordBatch.from_arrays([each.column("seed").combine_chunks(), pa.array(np.full(each.num_rows, n, np.int32)),
                                                  b.column("blob").take(each.column("owner").combine_chunks())], names=["seed", "n_words", "blob"])

    texts = docs.select(F.sha2(F.col(text_col), 256).alias("blob"), words(F.col(text_col)).alias("w")).filter(F.size("w") >= lengths[0])
    pairs = texts.mapInArrow(text_seeds, schema + ", blob string").join(index, ["seed", "n_words"]).select("blob", "item", "n_words").distinct()
    return pairs.join(short.select("item", "item_id"), "item").select(
        "blob", "item_id", F.lit(1).cast("long").alias("n_tiles"), F.col("n_words").cast("long").alias("covered"), F.lit(1.0).alias("coverage"))


def _groups(sorted_ids: np.ndarray) -> tuple[list[int], list[int]]:
    cut = (np.flatnonzero(np.diff(sorted_ids)) + 1).tolist()
    return [0, *cut], [*cut, len(sorted_ids)]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """``(doc_id, item_id, n_tiles, covered, coverage)`` for every contaminated document."""
    found = C.written(matches(docs, benchmark, text_col, **options), "matches")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.col(text_col), 256).alias("blob"))
    return rows.join(found, "blob").drop("blob")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col="text", **options) -> DataFrame:
    """``docs`` without the contaminated documents."""
    found = matches(docs, benchmark, text_col, **options).select(F.col("blob").alias("blob_"))
    # a null text has no blob and matches nothing
    rows = docs.withColumn("blob_", F.coalesce(F.sha2(F.col(text_col), 256), F.lit("")))
    return C.without(rows, "blob_", found).drop("blob_")
