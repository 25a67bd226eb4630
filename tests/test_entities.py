"""Character references against the standard library's decoder."""

import html
import html.entities
import random

from pyspark.sql import functions as F

from telemark.functions import text as X


def _decode(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    return [r.d for r in df.select("i", X.unescape_entities("s").alias("d")).orderBy("i").collect()]


def test_every_name(spark):
    names = sorted(html.entities.html5)
    texts = [f"a&{n}b" for n in names] + [f"&{n.rstrip(';')}" for n in names] + [f"&{n};&{n}" for n in names]
    got = _decode(spark, texts)
    assert [t for t, g in zip(texts, got) if g != html.unescape(t)] == []


def test_every_numeric_form(spark):
    points = [*range(0x120), 0x2019, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFEFF, 0xFFFD, 0xFFFE, 0xFFFF,
              0x1F600, 0x1FFFE, 0x10FFFD, 0x10FFFF, 0x110000, 2**31, 2**32 + 65, 2**64 + 65, 10**30]
    texts = [t for n in points for t in (f"x&#{n};y", f"&#{n}z", f"&#x{n:x};", f"&#X{n:X};&#000{n};", f"&#x0000{n:x}g")]
    got = _decode(spark, texts)
    assert [(t, g) for t, g in zip(texts, got) if g != html.unescape(t)] == []


def test_mixed_texts(spark):
    rng = random.Random(5)
    bits = ["&", "amp", "lt", ";", "#", "x", "39", "&amp;", "&notit;", "&not", "&#x27;", "&unknown;", " ", "\n", "<b>", "é", "&&gt;", "&#;", "&#x;", "&amp;lt;", "&ampamp;"]
    texts = ["", "no reference", "&", "&;", "a" * 5000 + "&copy;" * 300, "&" + "n" * 40 + ";"] + ["".join(rng.choices(bits, k=rng.randrange(1, 12))) for _ in range(400)]
    assert _decode(spark, texts) == [html.unescape(t) for t in texts]
    assert _decode(spark, [None]) == [None]


def test_strip_tags_decodes_once(spark):
    df = spark.createDataFrame([("<p>a&nbsp;&lt;b&gt; &amp;lt; <i>&eacute;</i></p>",)], "s string")
    assert df.select(X.strip_tags("s")).collect()[0][0] == "a <b> &lt; é"
