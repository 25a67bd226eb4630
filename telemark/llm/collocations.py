"""Phrase collocations by prefix-free parsing.

Parsing.  Words of a piece (a run of text between punctuation) are cut into
overlapping chunks: a window of ``OVERLAP`` words whose hash is a multiple of
``PERIOD`` ends one chunk and begins the next, so equal passages give equal
chunks wherever they stand.  The distinct chunks with their numbers of
occurrences form the dictionary; it is all that later steps read.

Counting.  An n-gram belongs to the chunk in which it *starts*; starts in the
closing overlap belong to the next chunk.  With an overlap of ``MAX_WORDS - 1``
words every occurrence lies whole in its chunk and counts once, weighted by the
chunk's occurrences.  Level by level, an n-gram is counted only if both n-grams
of one word less may be frequent, which a bitmap of fixed size tells without a
miss; counts themselves are sums over the words as they are.

A hot chunk or phrase is summed within the tasks before it is shuffled.  A
chunk has at most ``CHUNK_WORDS`` own words; a longer run without a trigger is
cut there, which moves no occurrence.

Defined results: a null or empty text has no words; a null part is ``und``;
repeated rows count each; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telemark.llm import bytewords as B
from telemark.llm import common as C

MAX_WORDS = 4
OVERLAP = MAX_WORDS - 1
PERIOD = 16             # one window in so many is a trigger
CHUNK_WORDS = 1024
LEAST = 30
HELD_WORDS = 1 << 19    # words that are parsed or counted together
BITS = 26

#: Pieces end at . , ; : ! ? and line feed to carriage return; words at space and tab.
#: A piece's end is a byte that UTF-8 lacks.
END = b"\xff"
TABLE = B.table(b" \t", b".,;:!?\n\x0b\x0c\r", END[0])
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _window_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of ``n`` words that begin at each word (the last
    ``n - 1`` have none)."""
    out = h[:len(h) - n + 1].copy()
    for j in range(1, n):
        out = out * _BASE + h[j:len(h) - n + 1 + j]
    return _mixed(out)


def _chunks(flat: list[bytes], part_ids: np.ndarray, borders: list[int]) -> tuple:
    """Chunks of a list of words in which ``END`` closes each piece: part
    numbers, chunks, whether each is open, and occurrences, without repeats.
    A border begins a chunk that other words will complete; it is left out."""
    d = pa.array(flat, pa.binary()).dictionary_encode()
    ids = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = ids == d.dictionary.index(pa.scalar(END, pa.binary())).as_py()
    at = np.flatnonzero(ends)
    begins = ~ends
    begins[1:] &= ends[:-1]
    if len(ids) > MAX_WORDS:
        trigger = _window_hash(_word_hashes(d.dictionary)[ids], OVERLAP)[1:-1] % np.uint64(PERIOD) == 0
        for j in range(MAX_WORDS + 1):      # words before and behind the window are of its piece
            trigger &= ~ends[j:j + len(trigger)]
        begins[1:1 + len(trigger)] |= trigger
    ghost = np.zeros(len(ids), bool)
    ghost[borders] = True
    start = np.flatnonzero(begins | ghost)
    stop = at[np.searchsorted(at, start)]
    following = np.minimum(np.append(start[1:], len(ids)), stop)
    long = np.flatnonzero(following - start > CHUNK_WORDS + OVERLAP)
    if len(long):
        more = np.concatenate([np.arange(a + CHUNK_WORDS, z - OVERLAP, CHUNK_WORDS) for a, z in zip(start[long], following[long])])
        start = np.unique(np.concatenate([start, more]))
        stop = at[np.searchsorted(at, start)]
        following = np.minimum(np.append(start[1:], len(ids)), stop)
    opened = following < stop
    own = ~ghost[start]
    start, opened, size = start[own], opened[own], np.where(opened, following + OVERLAP, stop)[own] - start[own]
    offsets = np.concatenate([[0], np.cumsum(size)])
    words = d.dictionary.take(pa.array(ids[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]))
    chunks = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words), b" ").dictionary_encode()
    code = (part_ids[start] * len(chunks.dictionary) + chunks.indices.to_numpy(zero_copy_only=False)) * 2 + opened
    code, weight = np.unique(code, return_counts=True)
    return code // 2 // max(len(chunks.dictionary), 1), chunks.dictionary.take(pa.array(code // 2 % max(len(chunks.dictionary), 1))), code % 2 == 1, weight


def _segments(text: bytes) -> Iterator[tuple[list[bytes], bool]]:
    """Words of a text with ``END`` between pieces, a long text in parts.  A part
    that ends inside a piece is open: the next one repeats its last words."""
    tail: list[bytes] = []
    cuts = B.slices(text) if len(text) > B.SLICE else [text]
    at = 0
    for cut in cuts:
        at += len(cut)
        words = tail + cut.replace(END, b" " + END + b" ").split()
        n = 0
        while n <= OVERLAP and n < len(words) and words[-1 - n] != END:
            n += 1
        if at == len(text) or not n:
            tail = []
            yield words, False
        elif n > OVERLAP:
            tail = words[-OVERLAP:]
            yield words, True
        else:
            tail = words[-n:]
            yield words[:-n], False


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("part", pa.string()), ("chunk", pa.binary()), ("open", pa.bool_()), ("weight", pa.int64())])
    flat: list[bytes] = []
    names: dict[str, int] = {}
    lengths: list[tuple[int, int]] = []
    borders: list[int] = []

    def out() -> pa.RecordBatch:
        ids, size = np.array(lengths, np.int64).T
        part, chunk, opened, weight = _chunks(flat, np.repeat(ids, size), borders)
        r = pa.RecordBatch.from_arrays([pa.array(list(names), pa.string()).take(pa.array(part)), chunk, pa.array(opened), pa.array(weight.astype(np.int64))], schema=schema)
        for x in (flat, lengths, borders):
            x.clear()
        return r

    for b in batches:
        for part, text in zip(b.column("part").to_pylist(), B.raw(b.column("text"))):
            for words, is_open in _segments(text.translate(TABLE)):
                flat += words
                if is_open:
                    borders.append(len(flat) - OVERLAP)
                flat.append(END)
                lengths.append((names.setdefault(part, len(names)), len(words) + 1))
                if len(flat) >= HELD_WORDS:
                    yield out()
    if flat:
        yield out()


def dictionary(docs: DataFrame, text_col="text", part_col="lang") -> DataFrame:
    """``(part, chunk, open, weight)``: the distinct chunks of each part's parse
    and their occurrences; an open chunk's last ``OVERLAP`` words begin the next."""
    rows = docs.select(F.coalesce(F.col(part_col).cast("string"), F.lit("und")).alias("part"), F.col(text_col).alias("text")).filter("text is not null")
    parsed = rows.mapInArrow(_parse, "part string, chunk binary, open boolean, weight long")
    return parsed.groupBy("part", "chunk", "open").agg(F.sum("weight").alias("weight"))


def _split(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Word numbers of all chunks, the offsets of each, and the words."""
    lists = pc.split_pattern(chunks, b" ")
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    d = lists.flatten().dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py(), d.dictionary


def _word_hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def _slots(ids, words: pa.Array, part_ids, parts: list, n: int, bits: int) -> np.ndarray:
    """The bitmap slots of the windows of ``n`` words that begin at each word."""
    own = np.array([xxhash.xxh64_intdigest(p, seed=n) for p in parts], np.uint64)
    return (_mixed(_window_hash(_word_hashes(words)[ids], n) ^ own[part_ids[:len(ids) - n + 1]]) >> np.uint64(64 - bits)).astype(np.int64)


def _sums(code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position and summed weight of each distinct code."""
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], code[order][1:] != code[order][:-1]]))
    return order[first], np.add.reduceat(weight[order], first)


def _grams(t: pa.Table, n: int, bits_of, bits: int) -> pa.RecordBatch:
    """``(part, phrase, f)`` of the n-grams that start in these chunks; with one
    word, also the sum of all words of a part under a null phrase."""
    ids, offsets, words = _split(t.column("chunk").combine_chunks())
    d = t.column("part").combine_chunks().dictionary_encode()
    lengths = np.diff(offsets)
    chunk = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(ids)) - offsets[:-1][chunk]
    owned = np.where(t.column("open").to_numpy(), lengths - OVERLAP, lengths)
    part_ids = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)[chunk]
    parts = d.dictionary.to_pylist()
    start = np.flatnonzero((at < owned[chunk]) & (at + n <= lengths[chunk]))
    if n > 1 and len(ids) >= n and len(start):
        seen = C.probe(bits_of, _slots(ids, words, part_ids, parts, n - 1, bits).astype(np.uint64))
        start = start[seen[start] & seen[start + 1]]
    weight = t.column("weight").to_numpy()[chunk[start]]
    cols: list = [[], [], []]
    if len(start):
        code = part_ids[start] * len(words) + ids[start]
        for j in range(1, n):
            code = np.unique(code, return_inverse=True)[1].astype(np.int64) * len(words) + ids[start + j]
        first, f = _sums(code, weight)
        phrase = pc.binary_join_element_wise(*[words.take(pa.array(ids[start[first] + j])) for j in range(n)], b" ") if n > 1 else words.take(pa.array(ids[start[first]]))
        cols = [d.dictionary.take(pa.array(part_ids[start[first]])), phrase.cast(pa.string()), f]
        if n == 1:
            one, total = _sums(part_ids[start], weight)
            cols = [pa.concat_arrays([cols[0], d.dictionary.take(pa.array(part_ids[start[one]]))]), pa.concat_arrays([cols[1], pa.nulls(len(one), pa.string())]), np.concatenate([f, total])]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["part", "phrase", "f"])


def _level(chunks: DataFrame, n: int, below: DataFrame | None, least: int, bits: int) -> DataFrame:
    """``(part, phrase, f)`` of the n-grams with ``f >= least``, and for one word
    the totals."""
    shared = None
    if below is not None:
        def slots(batches: Iterator[pa.RecordBatch]):
            for b in batches:
                b = b.filter(pc.is_valid(b.column("phrase")))
                ids, offsets, words = _split(b.column("phrase").cast(pa.binary()))
                d = b.column("part").dictionary_encode()
                part_ids = np.repeat(d.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(offsets))
                got = _slots(ids, words, part_ids, d.dictionary.to_pylist(), n - 1, bits)[offsets[:-1]] if b.num_rows else []
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64())], names=["slot"])
        shared = chunks.sparkSession.sparkContext.broadcast(C.bitmap(below.mapInArrow(slots, "slot long"), bits))

    def count(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        size = 0
        bits_of = shared.value if shared is not None else None
        for b in batches:
            # cut by bytes, since one chunk may be a thousand words long
            ends = np.cumsum(pc.binary_length(b.column("chunk")).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < b.num_rows:
                before = int(ends[lo - 1]) if lo else 0
                hi = max(int(np.searchsorted(ends, before + HELD_WORDS * 6 - size, side="left")) + 1, lo + 1)
                held.append(b.slice(lo, hi - lo))
                lo = min(hi, b.num_rows)
                size += int(ends[lo - 1]) - before
                if size >= HELD_WORDS * 6:
                    yield _grams(pa.Table.from_batches(held), n, bits_of, bits)
                    held, size = [], 0
        if held:
            yield _grams(pa.Table.from_batches(held), n, bits_of, bits)

    found = chunks.mapInArrow(count, "part string, phrase string, f long").groupBy("part", "phrase").agg(F.sum("f").alias("f"))
    return C.written(found.filter((F.col("f") >= least) | F.col("phrase").isNull()), f"grams{n}")


def frequent(chunks: DataFrame, least: int = LEAST, bits: int = BITS) -> list[DataFrame]:
    """The frequent n-grams of one to ``MAX_WORDS`` words."""
    levels = [_level(chunks, 1, None, least, bits)]
    for n in range(2, MAX_WORDS + 1):
        levels.append(_level(chunks, n, levels[-1], least, bits))
    return levels


def _phrase(words, start, length) -> F.Column:
    return F.array_join(F.slice(words, start, length), " ")


def _wide(c: str) -> F.Column:
    """A count as a decimal: its products may pass 64 bits."""
    return F.col(c).cast("decimal(38,0)")


def mine(docs: DataFrame, text_col="text", part_col="lang", least: int = LEAST, top: int = 2000, bits: int = BITS) -> DataFrame:
    """``(part, rank, phrase, a, l, r, n, score)``: each part's first ``top``
    collocations, without those that a longer one explains."""
    chunks = C.written(dictionary(docs, text_col, part_col), "chunks")
    one, *longer = frequent(chunks, least, bits)
    totals = one.filter("phrase is null").select(F.col("part").alias("part_"), F.col("f").alias("n"))
    candidates = longer[0].union(longer[1]).union(longer[2]).select("part", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    parts = one.filter("phrase is not null").union(longer[0]).union(longer[1]).select(F.col("part").alias("part_"), F.col("phrase").alias("phrase_"), F.col("f").alias("f_"))
    cut = candidates.select("part", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cut = cut.select("part", "phrase", "a", "k", _phrase(F.col("w"), F.lit(1), F.col("k")).alias("first"), _phrase(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    for side, name in (("first", "l"), ("rest", "r")):
        cut = cut.join(parts, (cut.part == parts.part_) & (cut[side] == parts.phrase_)).drop("part_", "phrase_", side).withColumnRenamed("f_", name)
    cut = cut.withColumn("score", F.expr("cast(cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)"))
    lowest = cut.groupBy("part", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("part", "phrase", "a", "m.l", "m.r", "m.score")
    inside = candidates.filter(F.size("w") > 2).select("part", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("size"))
    inside = inside.select("part", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
    inside = inside.groupBy(F.col("part").alias("part_"), _phrase(F.col("w"), F.col("at"), F.col("size")).alias("phrase_")).agg(F.max("a").alias("longest"))
    kept = lowest.join(inside, (lowest.part == inside.part_) & (lowest.phrase == inside.phrase_), "left").filter(F.col("longest").isNull() | (_wide("longest") * 100 < _wide("a") * 80)).drop("part_", "phrase_", "longest")
    order = W.partitionBy("part").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(totals, best.part == totals.part_).select("part", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
