"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, phrases of phrases, and so on.  At each
level runs of equal symbols become one symbol; deterministic coin tossing
(rounds of "lowest bit in which a symbol differs from its left neighbour, and
that bit") brings the labels below six while neighbours stay different; a
phrase starts at each local maximum of the labels.  A phrase is named by a hash
of its symbols, which are the names of the level below.  Borders depend on a
few neighbouring symbols alone, so equal substrings have the same names inside,
wherever they stand.

A fingerprint is the smallest names (32 bits each) of three levels, as hex:
``level1.level2.level3``, at most ``KEEP`` of each; level 1 is kept for texts
with too few names of level 2 only, whatever their length; there a run of
``LONG_RUN`` bytes or more also gives a name of its symbol alone.  The likeness
of two fingerprints is the Dice coefficient of the highest level on which both
have enough names, else of the lowest on which both have any.

Defined results: a null text is the empty one, with fingerprint ``..``; two
empty texts have likeness 1, an empty and another text 0; texts are taken in
descending id, null ids last, equal ids by text; a single document is its own
next; an empty table gives no rows; extra columns are ignored.  Memory is in
proportion to the longest single text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemark.llm import common as C

KEEP = (16, 24, 64)
ENOUGH = (1, 4, 8)
LONG_RUN = 256
_SYMBOL = np.uint64(1 << 63)
BATCH_BYTES = 1 << 20


def _toss_table(bits: int) -> np.ndarray:
    """(left, own) -> 2 * lowest differing bit + own bit there; 0 differing bits count as bit 0."""
    left, own = np.meshgrid(np.arange(1 << bits), np.arange(1 << bits), indexing="ij")
    x = left ^ own
    low = np.zeros_like(x)
    for k in range(bits - 1, -1, -1):
        low[(x >> k) & 1 == 1] = k
    return (2 * low + ((own >> low) & 1)).astype(np.uint8).ravel()


_T8, _T7, _T4, _T3 = (_toss_table(b) for b in (8, 7, 4, 3))
_LOW16 = np.array([(i & -i).bit_length() - 1 if i else 0 for i in range(1 << 16)], dtype=np.uint8)
_PLACE = np.random.default_rng(3).integers(1, 2 ** 63, 64, dtype=np.uint64) | np.uint64(1)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _round(lab: np.ndarray, table: np.ndarray, bits: int, first: np.ndarray) -> np.ndarray:
    out = np.empty(len(lab), np.uint8)
    out[1:] = table[(lab[:-1].astype(np.uint16) << np.uint16(bits)) | lab[1:]]
    out[first] = lab[first] & 1     # a text's first symbol has no neighbour
    return out


def _toss_names(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The first round on 64-bit names: labels below 128."""
    x = v[1:] ^ v[:-1]
    low = _LOW16[(x & np.uint64(0xFFFF)).astype(np.uint16)]
    for i in np.flatnonzero((x & np.uint64(0xFFFF)) == 0):
        low[i] = (int(x[i]) & -int(x[i])).bit_length() - 1 if x[i] else 0
    out = np.empty(len(v), np.uint8)
    out[1:] = 2 * low + ((v[1:] >> low.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    out[first] = (v[first] & np.uint64(1)).astype(np.uint8)
    return out


def _runs(v: np.ndarray, first: np.ndarray):
    """Symbols without repeats, the lengths of their runs, and the texts' first symbols."""
    new = np.empty(len(v), bool)
    np.not_equal(v[1:], v[:-1], out=new[1:])
    new[0] = True
    new[first] = True
    at = np.flatnonzero(new)
    return v[at], np.diff(at, append=len(v)), np.searchsorted(at, first)


def _phrases(lab: np.ndarray, names: np.ndarray, first: np.ndarray):
    """The names of the phrases that start at local maxima of the labels."""
    peak = np.zeros(len(lab), bool)
    peak[1:-1] = (lab[1:-1] > lab[:-2]) & (lab[1:-1] > lab[2:])
    peak[np.append(first[1:], len(lab)) - 1] = False        # a text's last symbol starts nothing
    peak[first] = True
    at = np.flatnonzero(peak)
    place = np.arange(len(lab)) - np.repeat(at, np.diff(at, append=len(lab)))
    return _mix(np.add.reduceat(names * _PLACE[place & 63], at)), np.searchsorted(at, first)


def levels(raws: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level, the phrase names of all texts (and, on the first, the
    symbols of long runs) and the number of the text each belongs to."""
    size = np.array([len(r) for r in raws])
    some = np.flatnonzero(size)
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if not len(some):
        return [none] * len(KEEP)
    v, first = np.frombuffer(b"".join(raws), np.uint8), np.concatenate([[0], np.cumsum(size[some])[:-1]])
    out = []
    for level in range(len(KEEP)):
        v, run, first = _runs(v, first)
        if level == 0:
            lab = _round(v, _T8, 8, first)
            names = _mix(v.astype(np.uint64) + (run.astype(np.uint64) << np.uint64(8)))
            long = np.flatnonzero(run >= LONG_RUN)
            alone = _mix(v[long].astype(np.uint64) | _SYMBOL), some[np.searchsorted(first, long, side="right") - 1]
        else:
            many = run > 1
            if many.any():
                v = v.copy()
                v[many] = _mix(v[many] + run[many].astype(np.uint64) * _M3)
            lab, names = _round(_toss_names(v, first), _T7, 7, first), v
        lab = _round(_round(lab, _T4, 4, first), _T3, 3, first)
        v, first = _phrases(lab, names, first)
        owner = some[np.repeat(np.arange(len(some)), np.diff(first, append=len(v)))]
        out.append((np.concatenate([v, alone[0]]), np.concatenate([owner, alone[1]])) if level == 0 else (v, owner))
    return out


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text."""
    raws = [t.encode("utf-8", "replace") for t in texts]
    out = []
    for lo, hi in _slices([len(r) for r in raws]):
        some = raws[lo:hi]
        lists = []
        found = levels(some)
        few = np.bincount(np.unique((found[1][1].astype(np.uint64) << np.uint64(32)) | (found[1][0] >> np.uint64(32))) >> np.uint64(32), minlength=len(some)) < ENOUGH[1]
        for level, (names, owner) in enumerate(found):
            if level == 0:
                names, owner = names[few[owner]], owner[few[owner]]
            both = np.unique((owner.astype(np.uint64) << np.uint64(32)) | (names >> np.uint64(32)))
            cut = np.searchsorted(both, np.arange(len(some) + 1, dtype=np.uint64) << np.uint64(32))
            raw = both.astype(np.uint32).astype(">u4").tobytes().hex()
            lists.append([raw[8 * a:8 * min(z, a + KEEP[level])] for a, z in zip(cut[:-1].tolist(), cut[1:].tolist())])
        out += [".".join(parts) for parts in zip(*lists)]
    return out


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > BATCH_BYTES:
            yield lo, i
            lo, held = i, 0
        held += n
    if sizes:
        yield lo, len(sizes)


def likeness(a: str, b: str) -> float:
    """Dice coefficient, 0 to 1, estimated from the smallest names."""
    if a == b:
        return 1.0
    for level, x, y in reversed(list(zip(range(len(KEEP)), a.split("."), b.split(".")))):
        x, y = ({s[i:i + 8] for i in range(0, len(s), 8)} for s in (x, y))
        if len(x) >= ENOUGH[level] and len(y) >= ENOUGH[level]:
            low = set(sorted(x | y)[:KEEP[level]])
            j = len(low & x & y) / len(low)
            return 2 * j / (1 + j)
    for x, y in zip(a.split("."), b.split(".")):        # strongly repetitive texts
        x, y = ({s[i:i + 8] for i in range(0, len(s), 8)} for s in (x, y))
        if x and y:
            return 2 * len(x & y) / (len(x) + len(y))
    return 0.0


def edited(text: str, other: str) -> str:
    """``text`` with its last half replaced by the start of ``other``."""
    h = len(text) // 2
    return text[:len(text) - h] + other[:h]


_LEAST = -(1 << 63)
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]):
    """Rows in order of (range descending, own rows before borrowed ones, id
    descending, text): each own row meets the row after it."""
    left = None     # the last row, still without its next

    def rows(group):
        texts = [r[2] for r in group]
        new = fingerprints([t for r, t in zip(group, texts) if r[3] is None])
        it = iter(new)
        prints = [r[3] if r[3] is not None else next(it) for r in group]
        at = [i for i in range(len(group) - 1) if not group[i][1]]
        changed = [edited(texts[i], texts[i + 1]) for i in at]
        other = fingerprints(changed)
        out = [[group[i][0], len(texts[i]), hashlib.sha256(c.encode("utf-8", "replace")).hexdigest(), prints[i], o, likeness(prints[i], o), likeness(prints[i], prints[i + 1])]
               for i, c, o in zip(at, changed, other)]
        return out, (*group[-1][:3], prints[-1])

    for b in batches:
        ids, lent, texts = (b.column(c).to_pylist() for c in ("id", "lent", "text"))
        group, held = [left] if left else [], 0
        for row in zip(ids, lent, texts):
            group.append((*row, None))
            held += len(row[2])
            if held >= BATCH_BYTES:
                out, left = rows(group)
                yield _batch(out)
                group, held = [left], 0
        if len(group) > 1 or group and left is None:
            out, left = rows(group)
            yield _batch(out)


def _batch(rows: list[list]) -> pa.RecordBatch:
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 7, schema)], schema=schema)


def compare_with_next(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likenesses.

    The texts are shuffled once, by ranges of id.  The first document of each
    range (in descending id) is also sent to the range before it, so that every
    document meets its next; ranges and first documents come from two passes
    over the ids alone.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST))
    ids = docs.select(key.alias("key"))
    n = 4 * C.partitions(spark)
    marks = ids.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    bounds = np.unique(np.array(marks, dtype=np.int64))

    def highest(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            k = b.column("key").to_numpy()
            part = np.searchsorted(bounds, k)
            top = np.full(len(bounds) + 1, _LEAST)
            np.maximum.at(top, part, k)
            seen = np.unique(part)
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(top[seen])], names=["part", "top"])

    # one number a range
    tops = sorted((r["part"], r["top"]) for r in ids.mapInArrow(highest, "part int, top long").groupBy("part").agg(F.max("top").alias("top")).collect())
    # the documents with this id are lent to the range above; the highest to the lowest
    to = {top: (tops[i + 1][0] if i + 1 < len(tops) else tops[0][0]) for i, (_, top) in enumerate(tops)}

    def deal(batches: Iterator[pa.RecordBatch]):
        top = np.array(sorted(to), dtype=np.int64)
        goal = np.array([to[t] for t in top.tolist()], dtype=np.int32)
        for b in batches:
            k = b.column("key").to_numpy()
            part = np.searchsorted(bounds, k).astype(np.int32)
            at = np.searchsorted(top, k)
            lent = np.flatnonzero((at < len(top)) & (top[np.minimum(at, len(top) - 1)] == k))
            own = pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(k), np.int32)), *(b.column(c) for c in ("key", "id", "text"))], names=["part", "lent", "key", "id", "text"])
            yield own
            if len(lent):
                few = b.take(pa.array(lent))
                yield pa.RecordBatch.from_arrays([pa.array(goal[at[lent]]), pa.array(np.ones(len(lent), np.int32)), *(few.column(c) for c in ("key", "id", "text"))], names=["part", "lent", "key", "id", "text"])

    rows = docs.select(key.alias("key"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.mapInArrow(deal, "part int, lent int, key long, id long, text string")
    rows = rows.repartition("part").sortWithinPartitions(F.desc("part"), "lent", F.desc("key"), "text")
    return rows.select("id", "lent", "text").mapInArrow(_compare, OUT)
