"""Query-text corpus, labels and retrieval queries.

Stand-ins: ``conversations`` user turns are prompts and assistant turns are
generated answers; ``documents`` are the questions ranked against the
``benchmark`` example corpus (documents quote benchmark passages, so the +10
containment rule fires); vectors come from ``embeddings`` by id (questions by
``doc_id``, examples by ``item_id``; a missing vector scores cosine 0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemark.functions import text as TX
from telemark.operators import joins as J
from telemark.operators import labels as LB
from telemark.operators import retrieve as RT
from telemark.operators.latest import earliest_by
from telemark.plans.registry import register
from telemark.sources.tables import Tables


def _user_turns(conversations: DataFrame) -> DataFrame:
    return J.spread(conversations.filter(F.col("role") == "user"))


def hybrid_topk_q(documents: DataFrame, benchmark: DataFrame, embeddings: DataFrame, k: int = 4) -> DataFrame:
    vec = embeddings.select(F.col("vec_id"), F.col("embedding"))
    q = documents.select("doc_id", "text").join(vec, documents.doc_id == vec.vec_id, "left").drop("vec_id")
    e = benchmark.join(vec, benchmark.item_id == vec.vec_id, "left").drop("vec_id")
    out = RT.hybrid_topk(q, e, q_id="doc_id", q_text="text", e_id="item_id", e_text="text",
                         q_vec="embedding", e_vec="embedding", k=k)
    return out.select("doc_id", "rank", "item_id", F.round("score", 6).alias("score"),
                      F.col("heuristic").cast("bigint").alias("heuristic"), F.round("cosine", 6).alias("cosine"))


def legacy_topk_q(conversations: DataFrame, benchmark: DataFrame, k: int = 4) -> DataFrame:
    """T-5 older heuristic without vectors: items for each different prompt."""
    prompts = _user_turns(conversations).groupBy(F.sha2("text", 256).alias("prompt")).agg(F.min("text").alias("text"))
    return RT.legacy_topk(prompts, benchmark, q_id="prompt", q_text="text", e_id="item_id", e_text="text", k=k)


def index_rows_q(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    vec = embeddings.select("vec_id", "embedding")
    docs = documents.join(vec, documents.doc_id == vec.vec_id, "left")
    return RT.index_rows(docs, "lang", "doc_id", "text", "source", "embedding")


def index_build_q(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """T-7 per-domain index header (domain = language)."""
    return RT.index_header(index_rows_q(documents, embeddings))


def dirty_domains_q(documents: DataFrame, embeddings: DataFrame, labels: DataFrame) -> DataFrame:
    """T-8 one domain for each language and source; the stored index is from
    before the documents over 20,000 characters and the source ``src3`` came."""
    documents = documents.withColumn("lang", F.concat_ws("/", "lang", "source"))
    stored_docs = documents.filter((F.col("n_chars") <= 20000) & (F.col("source") != "src3"))
    stored = RT.index_header(index_rows_q(stored_docs, embeddings))
    current = RT.index_header(index_rows_q(documents, embeddings))
    return RT.dirty_domains(stored, current)


def query_fingerprint_q(conversations: DataFrame) -> DataFrame:
    """T-12 fingerprints of prompts, grouped with counts."""
    return (_user_turns(conversations).groupBy(TX.fingerprint("text").alias("fingerprint"))
            .agg(F.count(F.lit(1)).alias("n")))


def domain_label_q(conversations: DataFrame) -> DataFrame:
    """T-9 domain of each prompt, substring (reference) and whole-token modes."""
    u = _user_turns(conversations)
    return u.select("conv_id", "turn", LB.domain_label("text").alias("domain"),
                    LB.domain_label("text", whole_token=True).alias("domain_token"))


def intent_label_q(conversations: DataFrame) -> DataFrame:
    """T-10, T-11, T-18 time window, metric intent, context notes, explanation flag."""
    u = _user_turns(conversations)
    mi = LB.metric_intent("text")
    return u.select("conv_id", "turn", LB.time_window("text").alias("time_window"),
                    mi["metric_mode"].alias("metric_mode"), mi["raw_metric_hint"].alias("raw_metric_hint"),
                    F.size(LB.context_notes("text")).alias("n_notes"),
                    TX.wants_explanation("text").alias("wants_explanation"))


def validity_label_q(conversations: DataFrame) -> DataFrame:
    """T-15, T-16, T-1 over generated answers."""
    a = conversations.filter(F.col("role") == "assistant")
    cleaned = TX.clean_response("text")
    return a.select("conv_id", "turn", TX.validity_label(cleaned).alias("label"),
                    F.length(TX.normalize_query(cleaned)).alias("normalized_len"))


def dedup_questions_q(conversations: DataFrame) -> DataFrame:
    """T-2 / W-5 first-seen dedup by lower-cased question (partial ``min_by``)."""
    # the group key is the SHA-256 of the lower-cased question, so the shuffle
    # moves 64-character digests instead of whole texts
    u = _user_turns(conversations).select(F.sha2(F.lower("text"), 256).alias("key"), "conv_id", "turn")
    return earliest_by(u, "key", ["conv_id", "turn"]).select("conv_id", "turn")


def time_audit_q(conversations: DataFrame) -> DataFrame:
    """T-19 query-log audit: texts without a time bound (which would get the
    default 24 h span) and the largest look-back."""
    t = conversations.select(LB.has_time_bound("text").alias("bounded"), LB.lookback_days("text").alias("days"))
    return t.agg(F.count_if("bounded").alias("n_bounded"), F.count_if(~F.col("bounded")).alias("n_unbounded"),
                 F.max("days").alias("max_lookback_days"))


def token_counts_q(documents: DataFrame) -> DataFrame:
    """F-14 / T-3 token-set size of every document."""
    return documents.select("doc_id", F.size(TX.tokens("text")).alias("n_tokens"))


# ---------------------------------------------------------------- oracle SQL pieces

_TOK = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda x: length(x) > 1))"


def _has(tok: str, w: str) -> str:
    return f"list_contains({tok}, '{w}')"


_HYBRID_SQL = f"""
WITH q AS (SELECT d.doc_id, coalesce(d.text, '') AS qtext, {_TOK.format('d.text')} AS qtok,
                  CAST(v.embedding AS DOUBLE[]) AS qvec
           FROM documents d LEFT JOIN embeddings v ON d.doc_id = v.vec_id),
e AS (SELECT b.item_id, coalesce(b.text, '') AS etext, {_TOK.format('b.text')} AS etok,
             CAST(v.embedding AS DOUBLE[]) AS evec
      FROM benchmark b LEFT JOIN embeddings v ON b.item_id = v.vec_id),
p AS (SELECT q.doc_id, e.item_id,
             CASE WHEN strpos(lower(qtext), lower(etext)) > 0 THEN 10 ELSE 0 END
             + len(list_intersect(qtok, etok))
             + CASE WHEN ({_has('etok', 'workload')} AND {_has('qtok', 'workload')})
                      OR ({_has('etok', 'latency')} AND {_has('qtok', 'latency')}) THEN 2 ELSE 0 END
             + CASE WHEN ({_has('etok', 'pod')} OR {_has('etok', 'pods')})
                     AND ({_has('qtok', 'pod')} OR {_has('qtok', 'pods')}) THEN 2 ELSE 0 END AS h,
             CASE WHEN qvec IS NULL OR evec IS NULL THEN 0.0
                  ELSE list_reduce(list_transform(list_zip(qvec, evec), lambda z: z[1] * z[2]), lambda a, b: a + b, 0.0)
             END AS cos
      FROM q, e),
s AS (SELECT *, 0.55 * CASE WHEN max(h) OVER (PARTITION BY doc_id) > 0
                            THEN h / max(h) OVER (PARTITION BY doc_id) ELSE 0.0 END + 0.45 * cos AS score
      FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id ASC) AS rank,
             count(*) FILTER (WHERE score > 0) OVER (PARTITION BY doc_id) AS npos
      FROM s)
SELECT doc_id, CAST(rank AS INTEGER) AS rank, item_id, round(score, 6) AS score, CAST(h AS BIGINT) AS heuristic,
       round(cos, 6) AS cosine
FROM r WHERE rank <= 4 AND (score > 0 OR npos = 0)
"""


@register("hybrid_topk", _HYBRID_SQL)
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return hybrid_topk_q(t.documents, t.benchmark, t.embeddings)


_ANY_TOK = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda x: x <> ''))"


@register("legacy_topk", f"""
WITH q AS (SELECT sha256(text) AS prompt, lower(min(text)) AS qlow, {_ANY_TOK.format('min(text)')} AS qtok
           FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY sha256(text)),
e AS (SELECT item_id, lower(coalesce(text, '')) AS elow, {_ANY_TOK.format('text')} AS etok FROM benchmark),
qt AS (SELECT prompt, unnest(qtok) AS a FROM q),
et AS (SELECT item_id, unnest(etok) AS b FROM e),
near AS (SELECT a, b FROM (SELECT DISTINCT a FROM qt), (SELECT DISTINCT b FROM et)
         WHERE abs(length(a) - length(b)) <= 2 AND levenshtein(a, b) <= 2),
close AS (SELECT DISTINCT prompt, item_id FROM qt JOIN near USING (a) JOIN et USING (b)),
p AS (SELECT q.prompt, e.item_id,
             CASE WHEN strpos(qlow, elow) > 0 OR strpos(elow, qlow) > 0 THEN 10 ELSE 0 END + len(list_intersect(qtok, etok))
             + CASE WHEN c.prompt IS NOT NULL THEN 1 ELSE 0 END
             + CASE WHEN ({_has('etok', 'workload')} AND {_has('qtok', 'workload')})
                      OR ({_has('etok', 'latency')} AND {_has('qtok', 'latency')}) THEN 2 ELSE 0 END
             + CASE WHEN ({_has('etok', 'pod')} OR {_has('etok', 'pods')})
                     AND ({_has('qtok', 'pod')} OR {_has('qtok', 'pods')}) THEN 2 ELSE 0 END AS h
      FROM q CROSS JOIN e LEFT JOIN close c ON c.prompt = q.prompt AND c.item_id = e.item_id),
r AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY h DESC, item_id) AS rank FROM p)
SELECT prompt, CAST(rank AS INTEGER) AS rank, item_id, CAST(h AS BIGINT) AS heuristic FROM r WHERE rank <= 4
""")
def legacy_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return legacy_topk_q(t.conversations, t.benchmark)


def _row_hash_sql(alias: str = "") -> str:
    return (f"CAST(('0x' || left(sha256(concat_ws('||', CAST({alias}doc_id AS VARCHAR), coalesce(trim({alias}text), ''), "
            f"coalesce(trim({alias}source), ''))), 15)) AS BIGINT)")


_HEADER_SQL = """SELECT lang AS domain, count(*) AS n_examples,
       CAST(coalesce(max(len(v.embedding)), 0) AS INTEGER) AS vector_dim,
       CAST(sum(CAST({rh} AS HUGEINT)) AS VARCHAR) AS examples_hash, 1 AS schema_version
FROM {src} d LEFT JOIN embeddings v ON d.doc_id = v.vec_id GROUP BY lang"""


@register("index_build", _HEADER_SQL.format(rh=_row_hash_sql("d."), src="documents"))
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return index_build_q(t.documents, t.embeddings)


@register("dirty_domains", f"""
WITH dom AS (SELECT * REPLACE (lang || '/' || source AS lang) FROM documents),
cur AS ({_HEADER_SQL.format(rh=_row_hash_sql("d."), src="dom")}),
sto AS ({_HEADER_SQL.format(rh=_row_hash_sql("d."),
                            src="(SELECT * FROM dom WHERE n_chars <= 20000 AND source <> 'src3')")}),
j AS (SELECT cur.domain,
             CASE WHEN sto.examples_hash IS NULL THEN 'missing'
                  WHEN sto.schema_version <> cur.schema_version THEN 'version'
                  WHEN sto.examples_hash <> cur.examples_hash OR sto.n_examples <> cur.n_examples THEN 'hash'
                  WHEN sto.vector_dim <> cur.vector_dim THEN 'shape' ELSE 'ok' END AS reason
      FROM cur LEFT JOIN sto ON cur.domain = sto.domain)
SELECT domain, reason <> 'ok' AS dirty, reason FROM j
""")
def dirty_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return dirty_domains_q(t.documents, t.embeddings, t.labels)


def _fp_sql(x: str) -> str:
    s = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    s = f"regexp_replace({s}, '(?im)^[ \\t\\x0B\\f\\r]*//[ \\t\\x0B\\f\\r]*meta[^\\n]*(\\n|$)', '', 'g')"
    s = f"replace({s}, chr(10), ' ')"
    s = f"regexp_replace(regexp_replace({s}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
    s = f"replace({s}, '''', '\"')"
    for kw in TX.FINGERPRINT_KEYWORDS:
        s = f"regexp_replace({s}, '(?i)\\b{kw.replace('-', chr(92) + '-')}\\b', '{kw}', 'g')"
    s = f"regexp_replace({s}, '(?i)\\s+desc\\b', '', 'g')"
    for op, rep in ((",", ","), ("\\|", "|"), ("=", "="), ("==", "=="), ("!=", "!="), ("<=", "<="),
                    (">=", ">="), ("<", "<"), (">", ">")):
        s = f"regexp_replace({s}, '\\s*{op}\\s*', '{rep}', 'g')"
    return s


@register("query_fingerprint", f"""
SELECT left(sha256({_fp_sql('text')}), 16) AS fingerprint, count(*) AS n
FROM conversations WHERE role = 'user' GROUP BY 1
""")
def query_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_fingerprint_q(Tables(spark, sf_dir).conversations)


def _or_contains(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _or_token(x: str, words) -> str:
    import re
    return "(" + " OR ".join(f"regexp_matches({x}, '(^|[^a-z0-9]){re.escape(w)}($|[^a-z0-9])')" for w in words) + ")"


def _domain_sql(x: str, whole: bool) -> str:
    hits = _or_token if whole else _or_contains
    strong = f"(regexp_matches({x}, '{LB.CONTAINER_TABLE_PATTERN}') OR (contains({x}, 'pod') AND contains({x}, 'pending')))"
    cont = f"({hits(x, LB.CONTAINER_KEYWORDS)} OR {strong})"
    app = f"({hits(x, LB.APP_KEYWORDS)} OR regexp_matches({x}, '{LB.APP_TABLE_PATTERN}'))"
    return (f"CASE WHEN {cont} AND NOT {app} THEN 'containers' WHEN {app} AND NOT {cont} THEN 'appinsights' "
            f"WHEN {cont} AND {app} AND {strong} THEN 'containers' ELSE 'appinsights' END")


@register("domain_label", f"""
SELECT conv_id, turn, {_domain_sql("lower(coalesce(text, ''))", False)} AS domain,
       {_domain_sql("lower(coalesce(text, ''))", True)} AS domain_token
FROM conversations WHERE role = 'user'
""")
def domain_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain_label_q(Tables(spark, sf_dir).conversations)


def _first_term_sql(x: str, terms) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, '{t}') THEN '{t}'" for t in terms) + " END"


_Q = "lower(coalesce(text, ''))"
_TP = LB.TIME_PATTERN


@register("intent_label", f"""
WITH b AS (
  SELECT conv_id, turn, {_Q} AS q,
         regexp_extract({_Q}, '{_TP}', 2) AS qty, regexp_extract({_Q}, '{_TP}', 3) AS unit,
         {_first_term_sql(_Q, LB.COUNT_TERMS)} AS c, {_first_term_sql(_Q, LB.RATE_TERMS)} AS r,
         {_first_term_sql(_Q, LB.DURATION_TERMS)} AS d, text
  FROM conversations WHERE role = 'user'),
m AS (SELECT *, CASE WHEN c IS NOT NULL THEN 'count' WHEN r IS NOT NULL THEN 'rate' WHEN d IS NOT NULL THEN 'duration'
                     ELSE 'unknown' END AS mode, coalesce(c, r, d, '') AS hint FROM b)
SELECT conv_id, turn,
       CASE WHEN qty <> '' THEN CAST(CASE WHEN starts_with(unit, 'week') THEN TRY_CAST(qty AS BIGINT) * 7
                                          ELSE TRY_CAST(qty AS BIGINT) END AS VARCHAR)
                                || CASE WHEN starts_with(unit, 'minute') THEN 'm' WHEN starts_with(unit, 'hour') THEN 'h' ELSE 'd' END
            WHEN contains(q, 'last hour') OR contains(q, 'past hour') THEN '1h'
            WHEN contains(q, 'last day') OR contains(q, 'past day') OR contains(q, 'today') THEN '1d'
            WHEN contains(q, 'last 30 minutes') OR contains(q, 'past 30 minutes') THEN '30m' ELSE '' END AS time_window,
       CASE WHEN contains(q, 'error count') THEN 'count'
            WHEN contains(q, 'error rate') AND mode <> 'count' THEN 'rate' ELSE mode END AS metric_mode,
       CASE WHEN contains(q, 'error count') THEN 'error count'
            WHEN contains(q, 'error rate') AND mode <> 'count' THEN 'error rate' ELSE hint END AS raw_metric_hint,
       CAST(len(list_distinct(list_filter([{', '.join(f"CASE WHEN contains(q, '{k}') THEN '{v.replace(chr(39), chr(39) * 2)}' END" for k, v in LB.CONTEXT_NOTES)}], lambda x: x IS NOT NULL))) AS INTEGER) AS n_notes,
       {_or_contains('q', TX.EXPLANATION_WORDS)} AS wants_explanation
FROM m
""")
def intent_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intent_label_q(Tables(spark, sf_dir).conversations)


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


_CLEAN = _strip_sql("regexp_replace(text, '```[a-zA-Z0-9]*\\n|```', '', 'g')")
_CLEAN = f"regexp_replace({_CLEAN}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
_CLEAN = _strip_sql(f"regexp_replace({_CLEAN}, '[ \\t\\x0B\\f\\r]+(\\n|$)', '\\1', 'g')")
_NORMQ = _strip_sql("regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '//[^\\n]*', '', 'g'), "
                    "'(?s)/\\*.*?\\*/', '', 'g'), '[\\r\\n]+', ' ', 'g'), '\\s+', ' ', 'g')")


@register("validity_label", f"""
WITH a AS (SELECT conv_id, turn, {_CLEAN} AS c FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn,
       CASE WHEN {_or_contains(_strip_sql('c'), TX.GENERATION_ERROR_MARKERS)} THEN 'generation_error'
            WHEN length({_strip_sql('c')}) < 5 THEN 'empty'
            WHEN starts_with({_strip_sql('c')}, '.') THEN 'leading_dot'
            WHEN {_or_contains('lower(' + _strip_sql('c') + ')', [p.replace("'", "''") for p in TX.ERROR_PHRASES])}
                 THEN 'error_response'
            ELSE 'valid' END AS label,
       CAST(length({_NORMQ}) AS INTEGER) AS normalized_len
FROM a
""")
def validity_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity_label_q(Tables(spark, sf_dir).conversations)


@register("dedup_questions", """
SELECT conv_id, turn FROM (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY lower(text) ORDER BY conv_id, turn) AS rn
  FROM conversations WHERE role = 'user') WHERE rn = 1
""")
def dedup_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_questions_q(Tables(spark, sf_dir).conversations)


@register("time_audit", f"""
WITH t AS (SELECT lower(coalesce(text, '')) AS q FROM conversations),
x AS (SELECT {_or_contains("q", LB.TIME_FILTER_MARKERS)} AS b,
             list_max(list_transform(regexp_extract_all(q, 'ago\\(\\s*(\\d+(?:\\.\\d+)?)\\s*(d|h|m|s)\\s*\\)', 0),
                 lambda s: TRY_CAST(regexp_extract(s, '(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE)
                      / CASE regexp_extract(s, '(\\d+(?:\\.\\d+)?)\\s*(d|h|m|s)', 2)
                          WHEN 'd' THEN 1.0 WHEN 'h' THEN 24.0 WHEN 'm' THEN 1440.0 ELSE 86400.0 END)) AS days
      FROM t)
SELECT count(*) FILTER (WHERE b) AS n_bounded, count(*) FILTER (WHERE NOT b) AS n_unbounded,
       max(days) AS max_lookback_days
FROM x
""")
def time_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_audit_q(Tables(spark, sf_dir).conversations)


@register("token_counts", f"""
SELECT doc_id, CAST(len({_TOK.format('text')}) AS INTEGER) AS n_tokens FROM documents
""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts_q(Tables(spark, sf_dir).documents)


def structure_similarity_q(conversations: DataFrame) -> DataFrame:
    """T-14 structural similarity of each prompt and the reply that follows it."""
    u = conversations.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("a"))
    r = conversations.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    j = u.join(r, ["conv_id", "turn"])
    f = TX.query_features("b")
    return j.select("conv_id", "turn", F.round(TX.structural_similarity("a", "b"), 6).alias("similarity"),
                    f["n_where"].alias("n_where"), F.size(f["aggregates"]).alias("n_aggregates"))


def _features_sql(x: str):
    s = f"coalesce({x}, '')"
    first = f"regexp_extract({s}, '^\\s*([A-Za-z_][A-Za-z0-9_]*)', 1)"
    joined = f"regexp_extract_all({s}, '(?i)\\b(?:join|union)\\b[^|(]*?\\(?\\s*([A-Za-z_][A-Za-z0-9_]*)', 1)"
    tables = (f"list_distinct(list_transform(list_filter(list_concat([{first}], {joined}), "
              f"lambda t: t <> '' AND lower(t) NOT IN ('kind', 'hint', 'withsource')), lambda t: lower(t)))")
    n_where = f"len(regexp_extract_all({s}, '(?i)\\|\\s*where\\b'))"
    alts = "|".join(sorted(TX.AGGREGATE_FUNCTIONS, key=len, reverse=True))
    aggs = f"list_distinct(list_transform(regexp_extract_all({s}, '(?i)\\b({alts})\\s*\\(', 1), lambda t: lower(t)))"
    return tables, n_where, aggs


def _jaccard_sql(a: str, b: str) -> str:
    u = f"len(list_distinct(list_concat({a}, {b})))"
    return f"(CASE WHEN {u} = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / {u} END)"


_TA, _WA, _AA = _features_sql("a")
_TB, _WB, _AB = _features_sql("b")


@register("structure_similarity", f"""
WITH u AS (SELECT conv_id, turn, text AS a FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn - 1 AS turn, text AS b FROM conversations WHERE role = 'assistant'),
j AS (SELECT u.conv_id, u.turn, a, b FROM u JOIN r ON u.conv_id = r.conv_id AND u.turn = r.turn),
f AS (SELECT conv_id, turn, {_TA} AS ta, {_WA} AS wa, {_AA} AS aa, {_TB} AS tb, {_WB} AS wb, {_AB} AS ab FROM j)
SELECT conv_id, turn,
       round(0.4 * {_jaccard_sql('ta', 'tb')}
             + 0.3 * (CASE WHEN greatest(wa, wb) = 0 THEN 1.0 ELSE 1.0 - abs(wa - wb) / greatest(wa, wb) END)
             + 0.3 * {_jaccard_sql('aa', 'ab')}, 6) AS similarity,
       CAST(wb AS INTEGER) AS n_where, CAST(len(ab) AS INTEGER) AS n_aggregates
FROM f
""")
def structure_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_similarity_q(Tables(spark, sf_dir).conversations)
