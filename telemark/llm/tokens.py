"""Token-ID output: texts are encoded, closed with an end id, laid end to end in
ascending id order, and written as directly addressable codes.

The file format is a folder of two Parquet tables:

``segments``  one row a segment of whole documents (about ``SEGMENT_TOKENS``
              ids; a longer document has a segment of its own): ``part, seg,
              at`` (ids of its part before it), ``n_tokens``, ``doc_ids``,
              ``doc_tokens`` and ``codes``, a DAC block (see dac.py)
``parts``     one row a part (a range of ids): ``part, base`` (ids before it),
              ``n_tokens, n_docs``

A global token position is found by its part's base, its segment's ``at`` and
one access in the DAC block; no other segment is read and no block decoded.

Defined results: a null text is empty and has the end id alone; ids come
nulls first, rows of equal id by text; an empty table gives no segments; extra
columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telemark.llm import common as C
from telemark.llm import dac

END_ID = 2
SEGMENT_TOKENS = 1 << 17
SEGMENTS = "part int, seg int, at long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, codes binary"

#: Known words kept by a Python worker, so that a frequent word is encoded
#: seldom; as many again of the generation before stay at hand.  A word takes
#: some 150 bytes, and the words of all workers of an executor must fit beside its heap.
KNOWN_WORDS = 200_000
#: Words handed to the library as one text: its time a word grows with the text's length.
TOGETHER = 100
#: Texts encoded at once.  Their pieces are looked up once, so more are faster,
#: and take more memory: for 1024 texts of 2,000 characters 75 MB more than for 256.
TEXTS = 1024

_BREAK = re.compile(r"(?<=\S) (?=\S)")
#: A text whose white space is not single spaces and one or two line breaks between words.
_ODD = r"[\t\v\f\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|^[ \n]|[ \n]$|  | \n|\n |\n\n\n"
#: Words whose line breaks, one or two at a time, are ids of their own.
_LINES = re.compile(r"\S+(?:\n\n?\S+)*").fullmatch
#: A word with ASCII marks after a letter or digit of the Latin blocks.
_MARKED = r"(?s)^(?P<stem>.*[0-9A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])(?P<marks>[[:punct:]]+)$"

_ENCODERS: dict = {}


class WordEncoder:
    """Encodes texts with a byte-level BPE of the tokenizers library, each
    distinct word once as long as it is known.

    Such a tokenizer treats the pieces of its pre-tokenizer one by one, and a
    piece never reaches over the border between a character that is no white
    space and a single space before another such character, nor over a line
    break between such characters, nor from a letter or digit to a mark.  Texts
    are cut at these borders, and only unknown pieces go through the library,
    many at a time with a line break between, which is an id of its own.
    ``whole`` encodes without any of this, for tokenizers of another kind and
    for tests.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        pre = self.lib.pre_tokenizer
        state = pre.__getstate__() if pre is not None else b""
        self.added = [x.content for x in self.lib.get_added_tokens_decoder().values()]
        self.newline = self.whole("\n").tolist()
        self.by_word = (self.lib.normalizer is None and b'"ByteLevel"' in state and b'"add_prefix_space":false' in state
                        and b'"use_regex":true' in state and len(self.newline) == 1)
        self.words: dict[str, bytes] = {}       # pieces after a space
        self.older: dict[str, bytes] = {}       # the generation before
        self.firsts: dict[str, bytes] = {}      # pieces without a space before

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, new: list[str], into: dict[str, bytes], lead: str) -> None:
        for i in range(0, len(new), TOGETHER):
            some = new[i:i + TOGETHER]
            ids = np.array(self.lib.encode_batch_fast([lead + ("\n" + lead).join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            breaks = np.flatnonzero(ids == self.newline[0])
            if len(breaks) != len(some) - 1:
                into.update((w, self.whole(lead + w).tobytes()) for w in some)
                continue
            raw, at = ids.tobytes(), 0
            for w, end in zip(some, [*(4 * breaks).tolist(), len(raw)]):
                into[w] = raw[at:end]
                at = end + 4

    def _spaced(self, asked: list[str]) -> list[bytes]:
        """The ids of pieces after a space."""
        words, older = self.words, self.older
        found = list(map(words.get, asked))
        gaps = [i for i, v in enumerate(found) if v is None]
        new = []
        for i in gaps:
            w = asked[i]
            v = older.get(w)
            if v is None:
                new.append(w)
            else:
                words[w] = v
        self._learn(new, words, " ")
        for i in gaps:
            found[i] = words[asked[i]]
        return found

    def _bare(self, asked: list[str]) -> list[bytes]:
        """The ids of pieces without a space before."""
        firsts = self.firsts
        self._learn(list({x for x in asked if x not in firsts}), firsts, "")
        return [firsts[x] for x in asked]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return [self.whole(t).tobytes() for t in texts]
        if len(self.words) > KNOWN_WORDS:
            self.older, self.words = self.words, {}
        if not self.firsts or len(self.firsts) > KNOWN_WORDS // 2:
            self.firsts = {"": b"", "\n": self.whole("\n").tobytes()}
        column = pa.array(texts, pa.large_string())
        added = np.zeros(len(texts), bool)
        for x in self.added:
            added |= pc.match_substring(column, x).to_numpy(zero_copy_only=False)
        odd = ~added & pc.match_substring_regex(column, _ODD).to_numpy(zero_copy_only=False)
        plain = ~added & ~odd
        out = [b""] * len(texts)
        for i in np.flatnonzero(added).tolist():
            out[i] = self.whole(texts[i]).tobytes()
        for mask, kind in ((odd, self._odd), (plain, self._plain)):
            where = np.flatnonzero(mask)
            if len(where):
                for i, raw in zip(where.tolist(), kind(column.take(pa.array(where)))):
                    out[i] = raw
        return out

    def _odd(self, texts: pa.Array) -> list[bytes]:
        """The ids of ``_ODD`` texts; their words may hold white space."""
        cut = [_BREAK.split(t) for t in texts.to_pylist()]
        new = list({x for w in cut for x in w[1:]} - self.words.keys())
        lines = {x: x.split("\n") for x in new if _LINES(x)}
        self._spaced(list({x[0] for x in lines.values()}))
        self._bare([y for x in lines.values() for y in x[1:]])
        nl = self.firsts["\n"]
        for x in new:
            if x not in lines:
                self.words[x] = self.whole(" " + x).tobytes()
            elif len(lines[x]) > 1:
                self.words[x] = nl.join([self.words[lines[x][0]], *[self.firsts[y] for y in lines[x][1:]]])
        return [self.whole(w[0]).tobytes() + b"".join([self.words[x] for x in w[1:]]) for w in cut]

    def _plain(self, texts: pa.Array) -> list[bytes]:
        """The ids of other texts.  Each piece of them all is looked up once,
        and the ids are gathered by the pieces' numbers."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        bounds, flat = split.offsets.to_numpy(), split.flatten()
        each = flat.dictionary_encode()
        word, code = each.dictionary, each.indices.to_numpy()
        # a line break, and what stands after one or begins a text, has no space before
        bare = code == pc.index(word, "\n").as_py()
        bare[1:] |= bare[:-1].copy()
        bare[bounds[:-1]] = True
        cut = pc.extract_regex(word, _MARKED)
        stem = pc.coalesce(pc.struct_field(cut, "stem"), word).dictionary_encode()
        marks = pc.struct_field(cut, "marks").dictionary_encode()
        names, stem = stem.dictionary.to_numpy(zero_copy_only=False), stem.indices.to_numpy()[code]
        spaced, first = np.zeros((2, len(names)), bool)
        spaced[stem[~bare]] = first[stem[bare]] = True
        some = [*self._spaced(names[spaced].tolist()), *self._bare(names[first].tolist()), b""]
        which = np.empty((len(code), 2), np.int64)
        which[:, 0] = np.where(bare, spaced.sum() + np.cumsum(first)[stem], np.cumsum(spaced)[stem]) - 1
        which[:, 1] = len(some) + marks.indices.fill_null(-1).to_numpy()[code]
        some += self._bare(marks.dictionary.to_pylist())
        which = which.ravel()
        size = np.fromiter(map(len, some), np.int64, len(some)) // 4
        start, n = np.cumsum(size) - size, size[which]
        end = np.cumsum(n)
        ids = np.frombuffer(b"".join(some), "<u4")[np.repeat(start[which] - end + n, n) + np.arange(end[-1])].tobytes()
        at = [0, *(4 * end[2 * bounds[1:] - 1]).tolist()]
        return [ids[a:z] for a, z in zip(at, at[1:])]


def encoder(path: str) -> WordEncoder:
    """One encoder a Python worker and file, until the worker reads tokens back."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Let go of the worker's encoders, whose words it would keep for whatever it does next."""
    _ENCODERS.clear()


def _segments(path: str, end_id: int, segment_tokens: int, at_once: int = TEXTS):
    def run(batches):
        from pyspark import TaskContext

        part, seg, at, ids, docs = TaskContext.get().partitionId(), 0, 0, [], []

        def row():
            values = np.frombuffer(b"".join(ids), "<u4")
            return pa.RecordBatch.from_pylist([{"part": part, "seg": seg, "at": at, "n_tokens": len(values), "doc_ids": [d for d, _ in docs],
                                                "doc_tokens": [n for _, n in docs], "codes": dac.encode(values)}], schema=SCHEMA)

        enc, stop, held = encoder(path), np.array([end_id], "<u4").tobytes(), 0
        for b in C.sliced(batches, at_once):
            for name, raw in zip(b.column("id").to_pylist(), enc.encode([t or "" for t in b.column("text").to_pylist()])):
                n = len(raw) // 4 + 1
                if held and held + n > segment_tokens:
                    yield row()
                    seg, at, held, ids, docs = seg + 1, at + held, 0, [], []
                ids += [raw, stop]
                docs.append((name, n))
                held += n
        if held:
            yield row()
    return run


SCHEMA = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()),
                    ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("codes", pa.binary())])


def write(docs: DataFrame, path: str, tokenizer: str, id_col="doc_id", text_col="text", end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS, at_once: int = TEXTS) -> None:
    """Write the ids of ``docs`` below ``path``.  One shuffle, by ranges of id;
    a part's segments are cut as its sorted rows stream by."""
    spark = docs.sparkSession
    C.small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    rows.mapInArrow(_segments(tokenizer, end_id, segment_tokens, at_once), SEGMENTS).write.option("compression", "zstd").parquet(f"{path}/segments")
    segs = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    parts = segs.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.sum(F.size("doc_ids")).alias("n_docs"))
    # one row a part
    base = F.coalesce(F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts.select("part", base.alias("base"), "n_tokens", "n_docs").write.parquet(f"{path}/parts")


def _tables(spark: SparkSession, path: str):
    return (spark.read.schema(SEGMENTS).parquet(f"{path}/segments"),
            spark.read.schema("part int, base long, n_tokens long, n_docs long").parquet(f"{path}/parts").select("part", "base"))


def _documents(ids: bool):
    def run(batches):
        forget()        # what is read has been written
        for b in C.sliced(batches, 1):
            for seg in b.to_pylist():
                values = dac.decode(seg["codes"])
                ends = np.cumsum(seg["doc_tokens"])
                raw, at = memoryview(values.astype("<u4").tobytes()), [0, *ends[:-1].tolist()]
                cols = [pa.array([seg["part"]] * len(ends), pa.int32()), pa.array(seg["doc_ids"], pa.int64()), pa.array(seg["at"] + np.array(at, dtype=np.int64)),
                        pa.array(seg["doc_tokens"], pa.int64()), pa.array([zlib.crc32(raw[4 * a:4 * z]) for a, z in zip(at, ends.tolist())], pa.int64())]
                names = ["part", "doc_id", "at", "n_tokens", "ids_crc32"]
                if ids:
                    cols, names = [*cols, pa.ListArray.from_arrays(pa.array([*at, len(values)], pa.int32()), pa.array(values.astype(np.int32)))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """One row per document, read back from the files: ``doc_id, start,
    n_tokens, ids_crc32`` and, on request, ``ids``."""
    C.small_batches(spark)
    segs, parts = _tables(spark, path)
    docs = segs.mapInArrow(_documents(ids), "part int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)
    return docs.join(parts, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def lookup(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """``(position, id)`` for global token positions: each goes to its segment
    by a join on the directory, and only those segments' codes are read."""
    segs, parts = _tables(spark, path)
    where = segs.select("part", "seg", "at", "n_tokens").join(parts, "part").select("part", "seg", (F.col("base") + F.col("at")).alias("first"), (F.col("base") + F.col("at") + F.col("n_tokens") - 1).alias("last"))
    # an equi-join on cells of positions: a segment covers few cells
    cell = SEGMENT_TOKENS
    where = where.withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / cell), F.floor(F.col("last") / cell))))
    asked = positions.select("position", F.floor(F.col("position") / cell).alias("cell"))
    hit = asked.join(where, "cell").filter("position between first and last").groupBy("part", "seg").agg(F.collect_set("position").alias("asked"), F.min("first").alias("first"))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                p = sorted(r["asked"])
                got = dac.access(r["codes"], np.array(p, dtype=np.int64) - r["first"])
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(got.astype(np.int64))], names=["position", "id"])

    return hit.join(segs.select("part", "seg", "codes"), ["part", "seg"]).select("asked", "first", "codes").mapInArrow(run, "position long, id long")
