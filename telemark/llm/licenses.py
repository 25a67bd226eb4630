"""License scan by an exact set-similarity join of text blocks and templates.

A template is a set of words that a block of text must contain to a share of
``percent``: at least ``o = ceil(percent * size)`` of its words.  Templates of
alike length form a class; a text is read in overlapping blocks of twice that
length, so that every place of a template lies whole in one of them.

Words are ordered by the number of documents that hold them, counted over all
documents, rarest first.  If a block holds ``o`` words of a template, then

* prefix filter: one of the template's ``size - o + 1`` rarest words is among
  the block's ``m - o + 1`` rarest (of its ``m`` template words);
* length filter: ``m >= o``;
* positional filter: the words shared so far and those left behind the last
  shared one, on the shorter side, reach ``o``.

Blocks leave a task only with a word of some template's prefix and are joined to
the templates by those words; what passes the filters is verified on the whole
sets.  A template marked as a phrase must besides stand word by word in the
block, and each such place counts once, for the block in whose first half it
starts.

Defined results: a null text is empty and has no label; equal rows get equal
results; null ids are documents like others; an empty table gives no rows; extra
columns are ignored.  A word of any length is read whole; texts are read in
slices of about a megabyte with the words that blocks share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemark.llm import bytewords as B
from telemark.llm import common as C


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    percent: int = 80       # of the template's different words
    phrase: bool = False    # must stand word by word


#: The base phrases, then the method's own templates, well-known
#: sentences of license notices.
BASE = (
    Template("cc-by", "cc by", 100, True),
    Template("gpl", "general public license", 100, True),
    Template("reserved", "all rights reserved", 100, True),
)
MORE = (
    Template("apache-2.0", "licensed under the apache license version 2 0", 100),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", 85),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 85),
    Template("cc-by-nc", "licensed under cc by nc 4 0", 100),
    Template("cc-by-sa", "licensed under cc by sa 4 0", 100),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", 85),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", 85),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", 100),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 85),
    Template("lgpl", "gnu lesser general public license", 100),
    Template("mit", "released under the mit license", 100),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", 85),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", 85),
    Template("unlicense", "this is free and unencumbered software released into the public domain", 85),
)
TEMPLATES = BASE + MORE

#: Words are runs of 0-9, a-z and characters beyond ASCII, A to Z in lower case.
TABLE = B.table([*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)])
LEAST_STRIDE = 4


def words_of(text: str) -> list[str]:
    return [w.decode() for w in text.encode().translate(TABLE).split()]


def stride(template: Template) -> int:
    """Half the length of the blocks a template is looked for in: the least
    power of two that holds its words."""
    s = LEAST_STRIDE
    while s < len(words_of(template.text)):
        s *= 2
    return s


def _numbers(batches: Iterator[pa.RecordBatch], number: dict[bytes, int]):
    """(batch, row, number of words before, word numbers) of each slice of each
    text; -1 for a word of no template."""
    for b in batches:
        for i, text in enumerate(B.raw(b.column("text"))):
            before = 0
            for cut in B.slices((text or b"").translate(TABLE)):
                ids = np.array([number.get(w, -1) for w in cut.split()], np.int32)
                yield b, i, before, ids
                before += len(ids)
            yield b, i, before, None


def frequencies(docs: DataFrame, vocabulary: list[str], text_col="text") -> dict[str, int]:
    """Documents that hold each word of the templates, over all documents; one
    count for each word of ``vocabulary`` reaches the driver."""
    number = {w.encode(): i for i, w in enumerate(vocabulary)}

    def count(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(len(number), np.int64)
        held: list = []
        for _, _, _, ids in _numbers(batches, number):
            if ids is not None:
                held.append(np.unique(ids[ids >= 0]))
            elif held:
                total[np.unique(np.concatenate(held))] += 1
                held = []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(number)), pa.int32()), pa.array(total)], names=["i", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    n = {r.i: r.n for r in rows}
    return {w: n.get(i, 0) for i, w in enumerate(vocabulary)}


class Index:
    """The templates with their words numbered in the global order."""

    def __init__(self, templates, often: dict[str, int]):
        self.order = sorted(often, key=lambda w: (often[w], w))
        self.number = {w.encode(): i for i, w in enumerate(self.order)}
        self.rows, self.prefix = [], []
        self.strides = sorted({stride(t) for t in templates})
        for i, t in enumerate(templates):
            w = [self.number[x.encode()] for x in words_of(t.text)]
            s = sorted(set(w))
            o = -(-t.percent * len(s) // 100)
            self.rows.append((i, t.label, stride(t), o, s, w if t.phrase else None))
            self.prefix += [(stride(t), s[at], i, at, len(s), o) for at in range(len(s) - o + 1)]

    def templates(self, spark) -> DataFrame:
        return C.written(spark.createDataFrame(self.rows, "template int, label string, stride int, o int, template_set array<int>, phrase array<int>"), "templates")

    def prefixes(self, spark) -> DataFrame:
        return C.written(spark.createDataFrame(self.prefix, "stride int, word int, template int, i int, size int, o int"), "prefixes")


_BLOCKS = "key string, n_words long, stride int, block long, m int, set array<int>, seq array<int>, id "


def _blocks(index: Index):
    """One row for each document with its number of words, and one for each of
    its blocks that holds a word of a template's prefix."""
    number, strides = index.number, index.strides

    def mask(numbers) -> np.ndarray:
        m = np.zeros(len(number) + 1, bool)     # -1 meets the last, which is False
        m[list(numbers)] = True
        return m

    wanted = {s: mask(p[1] for p in index.prefix if p[0] == s) for s in strides}
    vocabulary = {s: mask(w for r in index.rows if r[2] == s for w in r[4]) for s in strides}
    least = {s: min(r[3] for r in index.rows if r[2] == s) for s in strides}

    def found(ids: np.ndarray, s: int, first: int, end: int):
        """(block, set, sequence) in ``ids``, whose first word begins block
        ``first``; only blocks before ``end`` are whole."""
        at = np.flatnonzero(wanted[s][ids])
        if len(at):
            blocks = np.unique(np.concatenate([at // s, at // s - 1]))
            for block in blocks[(blocks >= 0) & (first + blocks < end)].tolist():
                seq = ids[block * s:block * s + 2 * s]
                own = np.unique(seq[vocabulary[s][seq]])
                if len(own) >= least[s]:
                    yield first + block, own, seq

    def run(batches: Iterator[pa.RecordBatch]):
        out: list = []
        last, rest, keys, schema = None, {}, [], None

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for b, i, before, ids in _numbers(batches, number):
            if b is not last:
                last, keys, names = b, b.column("key").to_pylist(), b.column("id").to_pylist()
                schema = pa.schema([("key", pa.string()), ("n_words", pa.int64()), ("stride", pa.int32()), ("block", pa.int64()), ("m", pa.int32()),
                                    ("set", pa.list_(pa.int32())), ("seq", pa.list_(pa.int32())), b.schema.field("id")])
            for s in strides:
                first, held = rest.get(s, (0, np.zeros(0, np.int32)))
                if ids is not None:
                    held = np.concatenate([held, ids]) if len(held) else ids
                    end = first + max(len(held) // s - 1, 0)       # later blocks wait for the next slice
                else:
                    end = first + -(-len(held) // s)
                out += [(keys[i], None, s, block, len(own), own, seq, None) for block, own, seq in found(held, s, first, end)]
                rest[s] = (end, held[(end - first) * s:])
            if ids is None:
                out.append((keys[i], before, None, None, None, None, None, names[i]))
                rest = {}
            if len(out) >= 2000:
                yield rows()
                out = []
        if out:
            yield rows()
    return run


def blocks_found(blocks: DataFrame, index: Index) -> DataFrame:
    """``(key, block, template, label, shared, containment, starts)`` of the
    blocks that meet a template's threshold; ``starts`` of a phrase's places."""
    spark = blocks.sparkSession
    one = blocks.filter("stride is not null").dropDuplicates(["key", "stride", "block"])
    probe = one.select("key", "stride", "block", "m", "set", "seq", F.posexplode("set").alias("j", "word"))
    met = probe.join(index.prefixes(spark), ["stride", "word"]).filter("m >= o and j <= m - o")
    met = met.groupBy("key", "stride", "block", "template").agg(
        F.count(F.lit(1)).alias("shared"), F.max("i").alias("i"), F.max("j").alias("j"), F.first("m").alias("m"), F.first("size").alias("size"), F.first("o").alias("o"),
        F.first("set").alias("set"), F.first("seq").alias("seq"))
    met = met.filter("shared + least(size - i - 1, m - j - 1) >= o")
    met = met.join(index.templates(spark).drop("stride", "o"), "template").withColumn("shared", F.size(F.array_intersect("set", "template_set")))
    place = F.filter(F.sequence(F.lit(0), F.least(F.col("stride"), F.size("seq")) - 1), lambda at: F.slice("seq", at + 1, F.size("phrase")) == F.col("phrase"))
    starts = F.when(F.col("phrase").isNotNull(), F.transform(place, lambda at: F.col("block") * F.col("stride") + at))
    met = met.filter("shared >= o").withColumn("starts", starts).filter("phrase is null or size(starts) > 0")
    return met.select("key", "block", "stride", "template", "label", "shared", (F.col("shared") / F.col("size")).alias("containment"), "starts")


def scan(docs: DataFrame, templates=TEMPLATES, id_col="doc_id", text_col="text") -> tuple[DataFrame, DataFrame]:
    """Rows of documents as ``(id, key, n_words)`` and the blocks found, by key.
    The key names an id with its text: rows that repeat both share results."""
    vocabulary = sorted({w for t in templates for w in words_of(t.text)})
    index = Index(templates, frequencies(docs, vocabulary, text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.sha2(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), text), 256)
    rows = docs.select(F.col(id_col).alias("id"), name.alias("key"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = C.written(rows.mapInArrow(_blocks(index), _BLOCKS + kind), "blocks")
    return blocks.filter("stride is null").select("id", "key", "n_words"), blocks_found(blocks, index)


def report(docs: DataFrame, templates=TEMPLATES, n_base: int = len(BASE), id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: ``id, n_words, n_base, first_word, last_word,
    base_labels, labels, score``; ``score`` is the highest containment of a
    template found, 0 where none is."""
    ids, found = scan(docs, templates, id_col, text_col)
    base = F.col("template") < n_base
    per = found.groupBy(F.col("key").alias("key_")).agg(
        F.sum(F.when(base, F.size("starts"))).alias("n_base"),
        F.min(F.when(base, F.array_min("starts"))).alias("first_word"), F.max(F.when(base, F.array_max("starts"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("containment").alias("score"))
    return ids.join(per, ids.key == per.key_, "left").select(
        "id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
