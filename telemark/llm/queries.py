"""The registered queries of the operators, over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemark.llm import common as C
from telemark.llm import collocations, filter_audit, htmltext, jaccard, langid, licenses, mixing, phrases, quality, secrets, sharding, tiling, tokens

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_rows(docs: DataFrame, at_once: int = tokens.TEXTS) -> DataFrame:
    spark = docs.sparkSession
    path = C.shared_dir(spark, "tokens")
    tokens.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"), at_once=at_once)
    return tokens.read(spark, path, ids=False)


@register("op1_token_output")
def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(_table(spark, sf_dir, "documents"))


@register("op2_mix_sources")
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mixing.plan(_table(spark, sf_dir, "documents"))
    return p.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


@register("op3_fingerprints")
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.compare_with_next(_table(spark, sf_dir, "documents"))


def fold(modulus: int) -> F.Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


@register("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), fold(5) != 0)
    return quality.score(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def _spans_sql() -> str:
    """Matches and the gaps between them by one pattern a kind, as the contract
    lists them; sums of lengths give the positions."""
    kinds = [
        ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24), ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
        ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1), ("forge", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1)]
    one = "SELECT doc_id, {0} AS k, '{1}' AS kind, {4} AS least, regexp_split_to_array(t, '{2}') AS gaps, regexp_extract_all(t, '{2}') AS found, regexp_extract_all(t, '{2}', {3}) AS held FROM d"
    return """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (""" + " UNION ALL ".join(one.format(i, kind, p.replace("'", "''"), group, least) for i, (kind, p, group, least) in enumerate(kinds)) + """),
x AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m),
y AS (SELECT doc_id, k, kind, length(found[i]) AS size,
             CAST(list_sum(list_transform(gaps[1:i], lambda v: length(v))) AS BIGINT)
             + coalesce(CAST(list_sum(list_transform(found[1:i - 1], lambda v: length(v))) AS BIGINT), 0) AS start
      FROM x WHERE length(held[i]) >= least),
z AS (SELECT doc_id, k, start, kind || ':' || start || ':' || (start + size) AS span FROM y),
g AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
             string_agg(span, ',' ORDER BY start, k) FILTER (WHERE k < 3) AS base, string_agg(span, ',' ORDER BY start, k) AS spans FROM z GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""


@register("op5_secret_scan", _spans_sql())
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    ledger = secrets.Ledger(spark, C.shared_dir(spark, "ledger"))
    ledger.update(docs)
    n = [F.coalesce(F.col("n")[i], F.lit(0)).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(secrets.BASE)]
    return ledger.of_paths(docs).select(F.col("id").alias("doc_id"), *n, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


@register("op6_main_text")
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@register("op7_shard_shuffle")
def op7_shard_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sharding.shard(_table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    return d.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
                    F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register("op8_decontaminate")
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each contaminated document and the benchmark item in it."""
    return tiling.contaminated(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), short_items=True)


@register("op9_jaccard_join", """WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(m.least, s.doc_id) AS component_id
FROM s LEFT JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY 1) m ON s.doc_id = m.doc_id
""")
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = jaccard.linked(_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, percent=85)
    return d.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@register("op10_language")
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.select("doc_id", "text", "lang"), fold(4) != 2)
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


@register("op11_filter_audit", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t),
                    regexp_matches(t, '[#$%&*|]'), w.doc_id > first] AS m, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
i AS (SELECT unnest(range(1, 6)) AS i),
p AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, i AS step, o[i] AS own, o[:i - 1] AS prior FROM p, i),
r AS (SELECT part, array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') AS filter_order, step, own,
             coalesce(sum(n) FILTER (WHERE NOT m[own] AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (WHERE m[own] AND NOT gone), 0) AS removed,
             coalesce(sum(n) FILTER (WHERE m[own] AND gone), 0) AS redundant,
             coalesce(sum(n) FILTER (WHERE m[own] AND len(list_filter(m, lambda x: x)) = 1), 0) AS unique_fails,
             coalesce(sum(good) FILTER (WHERE m[own] AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE m[own] AND NOT gone), 0) AS toxic_lost
      FROM (SELECT *, len(list_filter(prior, lambda x: m[x])) > 0 AS gone FROM c, s) GROUP BY part, o, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
""")
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_audit.failure_rows(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    marks = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    return filter_audit.audit(filter_audit.cells(rows, _table(spark, sf_dir, "labels"), marks), "ABCDE", tuple(marks))


def _templates_sql() -> str:
    """Every block against every template of its class, with sets and places."""
    rows = []
    for i, t in enumerate(licenses.TEMPLATES):
        w = licenses.words_of(t.text)
        least = -(-t.percent * len(set(w)) // 100)
        rows.append(f"({i}, '{t.label}', {licenses.stride(t)}, {least}, {w}, {t.phrase})")
    base = len(licenses.BASE)
    return r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                            '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
t(i, label, s, o, words, phrase) AS (VALUES """ + ",\n  ".join(rows) + f"""),
b AS (SELECT doc_id, s, b, w[b * s + 1:b * s + 2 * s] AS q FROM (SELECT doc_id, w, s, unnest(range(0, (len(w) + s - 1) // s)) AS b FROM w, (SELECT DISTINCT s FROM t))),
m AS (SELECT b.*, i, label, phrase, len(list_intersect(list_distinct(words), q)) / len(list_distinct(words)) AS c,
             CASE WHEN phrase THEN list_filter(range(0, least(b.s, len(q))), lambda x: q[x + 1:x + len(words)] = words) END AS places
      FROM b JOIN t ON b.s = t.s WHERE len(list_intersect(list_distinct(words), q)) >= o),
g AS (SELECT doc_id, sum(len(places)) FILTER (WHERE i < {base}) AS n, min(b * s + places[1]) FILTER (WHERE i < {base}) AS first_word, max(b * s + places[-1]) FILTER (WHERE i < {base}) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE i < {base}) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS score
      FROM m WHERE NOT phrase OR len(places) > 0 GROUP BY 1)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN g ON w.doc_id = g.doc_id"""


@register("op12_license_scan", _templates_sql())
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(_table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


@register("op13_collocations", r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
           FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM s, (VALUES (1), (2), (3), (4)) v(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 30),
x AS (SELECT *, unnest(range(1, size)) AS k FROM c),
y AS (SELECT x.lang, x.phrase, x.a, x.k, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * x.a // (l.f + r.f) AS BIGINT) AS score
      FROM x JOIN g l ON l.lang = x.lang AND l.phrase = array_to_string(w[:x.k], ' ') AND l.k = x.k
             JOIN g r ON r.lang = x.lang AND r.phrase = array_to_string(w[x.k + 1:], ' ') AND r.k = x.size - x.k),
z AS (SELECT lang, phrase, a, l, r, score FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT DISTINCT s.lang, s.phrase FROM c s JOIN (SELECT lang, size, a, w, unnest(range(2, size)) AS k FROM c) b ON b.lang = s.lang AND b.k = s.size AND b.a * 100 >= s.a * 80
             AND list_contains(list_transform(range(1, b.size - b.k + 2), lambda j: array_to_string(b.w[j:j + b.k - 1], ' ')), s.phrase)),
o AS (SELECT z.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z ANTI JOIN i USING (lang, phrase))
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
""")
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents").select("text", "lang")).withColumnRenamed("part", "lang")
