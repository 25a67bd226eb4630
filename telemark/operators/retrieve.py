"""Example retrieval: token overlap, heuristic + cosine hybrid ranking and the
example index (SURVEY 2.13: T-3..T-8).

Ranking is an inverted index with score bounds, one plan for all sizes:

* postings ``(token, example)`` are joined to the questions' tokens; a pair of
  question and example is made only where they share a token (or a containment
  key, below), and its heuristic is a partial aggregate over these rows;
* containment is looked for under one key an example, its rarest inner token,
  and tested on the texts of the pairs that meet there;
* these pairs get their exact score; any other example scores at most
  ``0.45 * |q| * |e|`` and takes part only if that reaches the k-th.  Pairs and
  vectors meet in blocks of bounded size, from which only a question's best
  ``k`` leave.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemark.functions.text import tokens

# Fixed values (T-5, T-6): heuristic weights and the hybrid mix.
CONTAIN_BONUS = 10
PAIR_BONUS = 2
HEURISTIC_WEIGHT = 0.55
COSINE_WEIGHT = 0.45
DEFAULT_K = 4
MAX_K = 12
NEAR = 2            # edits between near tokens, in the older heuristic

BLOCK = 1024        # questions, and examples, whose vectors meet in one task
SLICE = 64          # questions of a task whose scores are held at a time
EXAMPLE, QUESTION, PAIR = range(3)
GRAM = 3            # characters of the key of an example without inner tokens
POD = "#pod"        # posting of both forms, pod and pods; no token holds a '#'
_PAIR, _POD, _CONTAIN = 10 ** 9, 10 ** 12, 10 ** 15     # digits of the bonuses in a sum of at most 1e9 shared tokens


def clamp_k(k) -> int:
    """L-6 retrieval depth: default 4, clamped to 1..12."""
    try:
        k = int(k)
    except (TypeError, ValueError):
        k = DEFAULT_K
    return max(1, min(MAX_K, k))


def dot(a, b) -> Column:
    """F-17 / T-4 dot product in double (cosine of unit vectors); 0 when a side is missing."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    # one pass over positions 1..min(len): no intermediate product array
    n = F.least(F.size(a), F.size(b))
    s = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0),
                    lambda acc, i: acc + F.coalesce(F.element_at(a, i).cast("double")
                                                    * F.element_at(b, i).cast("double"), F.lit(0.0)))
    return F.when(a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(s)


def l2_normalize(v) -> Column:
    """F-17 unit vector (zero vector stays zero)."""
    v = F.col(v) if isinstance(v, str) else v
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def token_overlap(a_tokens, b_tokens) -> Column:
    """T-3 size of the token-set intersection."""
    return F.size(F.array_intersect(a_tokens, b_tokens))


def heuristic_score(q_text: Column, q_tok: Column, e_text: Column, e_tok: Column) -> Column:
    """T-5 heuristic: +10 when the question text contains the example text
    (tested on the original text, not on the unordered token set), + shared
    tokens, +2 when both mention workload or latency, +2 when both mention pods."""
    contain = F.when(F.instr(F.lower(q_text), F.lower(e_text)) > 0, CONTAIN_BONUS).otherwise(0)

    def has(tok, w):
        return F.array_contains(tok, F.lit(w))

    pair = F.when((has(e_tok, "workload") & has(q_tok, "workload")) | (has(e_tok, "latency") & has(q_tok, "latency")),
                  PAIR_BONUS).otherwise(0)
    pod = F.when((has(e_tok, "pod") | has(e_tok, "pods")) & (has(q_tok, "pod") | has(q_tok, "pods")),
                 PAIR_BONUS).otherwise(0)
    return contain + token_overlap(q_tok, e_tok) + pair + pod


def _inner_tokens(low: Column) -> Column:
    """Distinct tokens (length > 1) of a lower-cased text that touch neither
    its start nor its end.  If the text occurs inside another, each of these
    is a whole token there too."""
    parts = F.split(low, "[^a-z0-9]+")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    return F.array_distinct(F.filter(inner, lambda t: F.length(t) > 1))


def _grams(low: Column) -> Column:
    """Runs of up to ``GRAM`` characters, the empty one included."""
    def runs(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), lambda i: F.substr(low, i, F.lit(n)))

    return F.array_distinct(F.concat(F.array(F.lit("")), *map(runs, range(1, GRAM + 1))))


def _containment_keys(ex: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(eid, tok)`` of the examples with inner tokens, the rarest of them; and
    ``(eid, gram)`` of the others, of one or two tokens that may stand inside
    others: found by their first characters."""
    inner = ex.select("eid", "elow", _inner_tokens(F.col("elow")).alias("inner"))
    each = inner.select("eid", F.explode("inner").alias("tok"))
    often = each.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    keys = each.join(often, "tok").groupBy("eid").agg(F.min(F.struct("df", "tok")).alias("m")).select("eid", F.col("m.tok").alias("tok"))
    return keys, inner.filter(F.size("inner") == 0).select("eid", F.substr("elow", F.lit(1), F.lit(GRAM)).alias("gram"))


def _standing(met: DataFrame, short: DataFrame, q: DataFrame, ex: DataFrame) -> DataFrame:
    """``(qid, eid)`` of the pairs, met by a key or by a short example's first
    characters, in which the example's text stands in the question's."""
    any_short = short.select(F.count(F.lit(1))).scalar() > 0
    grams = q.select("qid", F.explode_outer(F.when(any_short, _grams(F.col("qlow"))).otherwise(F.array().cast("array<string>"))).alias("gram"))
    met = met.union(grams.join(short, "gram").select("qid", "eid")).distinct()
    # joins that ask nothing of a null key leave the plans below as they are elsewhere, so that their shuffles are used again
    example, asked = ex.select(F.col("eid").alias("eid_"), "elow"), q.select(F.col("qid").alias("qid_"), "qlow")
    texts = met.join(example, F.col("eid").eqNullSafe(F.col("eid_"))).join(asked, F.col("qid").eqNullSafe(F.col("qid_")))
    stands = F.when(F.col("qid").isNull() | F.col("eid").isNull(), False).otherwise(F.instr("qlow", F.col("elow")) > 0)
    return texts.filter(stands).select("qid", "eid")


def _contained(q: DataFrame, ex: DataFrame) -> DataFrame:
    """``(qid, eid)`` of the examples whose text stands in a question's."""
    keys, short = _containment_keys(ex)
    met = q.select("qid", F.explode_outer("qtok").alias("tok")).join(keys, "tok").select("qid", "eid")
    return _standing(met, short, q, ex)


def heuristic_pairs(q: DataFrame, ex: DataFrame) -> DataFrame:
    """T-5 ``(qid, eid, h)`` of all pairs whose heuristic is not 0."""
    pod = lambda tok: F.when(F.arrays_overlap(tok, F.array(F.lit("pod"), F.lit("pods"))), F.concat(tok, F.array(F.lit(POD)))).otherwise(tok)
    postings = ex.select("eid", F.explode(pod(F.col("etok"))).alias("tok"))
    # one number a row: shared tokens count 1, the bonuses and the key of containment stand in digits above
    kind = F.when(F.col("tok") == POD, _POD).when(F.col("tok").isin("workload", "latency"), _PAIR + 1).otherwise(1)
    keys, short = _containment_keys(ex)
    postings = postings.select("tok", "eid", kind.cast("long").alias("n")).union(keys.select("tok", "eid", F.lit(_CONTAIN).cast("long")))
    shared = q.select("qid", F.explode_outer(pod(F.col("qtok"))).alias("tok")).join(postings, "tok").select("qid", "eid", "n")
    shared = shared.groupBy("qid", "eid").agg(F.sum("n").cast("long").alias("n"))
    stands = _standing(shared.filter(F.col("n") >= _CONTAIN).select("qid", "eid"), short, q, ex).distinct().withColumn("stands", F.lit(CONTAIN_BONUS))
    n = F.coalesce(F.col("n"), F.lit(0))
    bonus = lambda unit: F.when(F.floor(n / unit) % 1000 > 0, PAIR_BONUS).otherwise(0)
    h = n % _PAIR + bonus(_PAIR) + bonus(_POD) + F.coalesce("stands", F.lit(0))
    return shared.join(stands, ["qid", "eid"], "full_outer").select("qid", "eid", h.cast("long").alias("h"))


def _best_of_block(k: int, id_type: pa.DataType, e_type: pa.DataType):
    """The best ``k`` of a block's examples for each question of a group."""
    schema = pa.schema([("qid", id_type), ("eid", e_type), ("score", pa.float64()), ("h", pa.int64()), ("cos", pa.float64())])

    def vectors(column: pa.ChunkedArray) -> np.ndarray:
        column = pc.fill_null(column.combine_chunks(), pa.scalar([], column.type))
        size = np.asarray(pc.list_value_length(column))
        flat = np.nan_to_num(np.asarray(pc.list_flatten(column)).astype(float))
        out = np.zeros((len(size), max(size, default=0)))
        out[np.arange(out.shape[1]) < size[:, None]] = flat
        return out

    def run(t: pa.Table) -> pa.Table:
        right, ask, pairs = (t.filter(pc.equal(t.column("kind"), x)) for x in (EXAMPLE, QUESTION, PAIR))
        right = right.take(pc.sort_indices(right.column("eid")))        # ties go to the lower id
        ids, names = right.column("eid").combine_chunks(), ask.column("qid").combine_chunks()
        if not len(ids) or not len(names):
            return schema.empty_table()
        q, e = vectors(ask.column("vec")), vectors(right.column("vec"))
        d = min(q.shape[1], e.shape[1])
        q, e = q[:, :d], e[:, :d]
        h, most = np.zeros((len(names), len(ids)), np.int64), np.ones(len(names))
        if pairs.num_rows:
            row, own = np.asarray(pc.index_in(pairs.column("qid"), value_set=names)), pairs.column("own").combine_chunks()
            most[row] = pairs.column("hmax").to_numpy()
            found = pc.list_flatten(own)
            h[np.repeat(row, np.asarray(pc.list_value_length(own))), np.asarray(pc.index_in(found.field("eid"), value_set=ids))] = np.asarray(found.field("h"))
        bound = COSINE_WEIGHT * (1 + 1e-9) * np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(e, axis=1)
        out = []
        for lo in range(0, len(names), SLICE):
            own = h[lo:lo + SLICE]
            cos, score = np.zeros(own.shape), np.full(own.shape, -np.inf)

            def cosines(at):        # of these pairs only
                cos[at] = np.einsum("pd,pd->p", q[lo:lo + SLICE][at[0]], e[at[1]])
                score[at] = HEURISTIC_WEIGHT * (own[at] / most[lo + at[0]]) + COSINE_WEIGHT * cos[at]

            cosines(np.nonzero(own))
            kept = min(k, own.shape[1])
            kth = np.partition(score, -kept, axis=1)[:, -kept]
            cosines(np.nonzero((own == 0) & (bound[lo:lo + SLICE] >= kth[:, None])))
            best = np.argsort(-score, axis=1, kind="stable")[:, :kept]
            i = np.repeat(np.arange(len(own)), kept)
            at = i, best.ravel()
            out.append((lo + i, at[1], score[at], own[at], cos[at]))
        i, j, score, own, cos = (np.concatenate(x) for x in zip(*out))
        return pa.Table.from_arrays([names.take(pa.array(i)), ids.take(pa.array(j)), pa.array(score), pa.array(own), pa.array(cos)], schema=schema)
    return run


def hybrid_topk(questions: DataFrame, examples: DataFrame, *, q_id: str, q_text: str, e_id: str, e_text: str,
                q_vec: str | None = None, e_vec: str | None = None, k: int = DEFAULT_K, block: int = BLOCK) -> DataFrame:
    """T-6 hybrid rank ``0.55 * h / max(h) + 0.45 * cosine`` per question.

    Keeps the positive scores among the top ``k``; when no score is positive
    the top ``k`` are kept anyway.  Ties resolve to the lower example id.  Ids
    are unique on either side.
    Output: ``q_id, rank, e_id, score, heuristic, cosine``.
    """
    k = clamp_k(k)
    vector = lambda c: F.transform(F.col(c), lambda x: x.cast("double")) if c else F.lit(None).cast("array<double>")
    ex = examples.select(F.col(e_id).alias("eid"), F.lower(F.coalesce(F.col(e_text), F.lit(""))).alias("elow"), tokens(e_text).alias("etok"), vector(e_vec).alias("vec"))
    q = questions.select(F.col(q_id).alias("qid"), F.lower(F.coalesce(F.col(q_text), F.lit(""))).alias("qlow"), vector(q_vec).alias("vec"))
    texts = q.select("qid", "qlow").repartition("qid").withColumn("qtok", tokens("qlow"))
    pairs = heuristic_pairs(texts, ex).withColumn("hmax", F.max("h").over(Window.partitionBy("qid")))

    # blocks of examples meet groups of questions
    count = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.lit(1)).cast("int")
    blocks, groups = ex.select(count).scalar(), q.select(count).scalar()
    of_block, of_group = F.pmod(F.xxhash64("eid"), blocks).cast("int"), F.pmod(F.xxhash64("qid"), groups).cast("int")
    # a question's pairs in a block travel as one list, no longer than the block
    pairs = pairs.groupBy("qid", of_block.alias("b")).agg(F.collect_list(F.struct("eid", "h")).alias("own"), F.max("hmax").alias("hmax"))
    kinds = {"qid": q.schema["qid"].dataType, "eid": ex.schema["eid"].dataType, "vec": "array<double>", "own": pairs.schema["own"].dataType, "hmax": "long"}
    row = lambda kind, *cols: [F.lit(kind).alias("kind"), *[F.col(c) if c in cols else F.lit(None).cast(t).alias(c) for c, t in kinds.items()]]
    met = (ex.select(F.explode(F.sequence(F.lit(0), groups - 1)).alias("g"), of_block.alias("b"), *row(EXAMPLE, "eid", "vec"))
           .union(q.select(of_group.alias("g"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("b"), *row(QUESTION, "qid", "vec")))
           .union(pairs.select(of_group.alias("g"), "b", *row(PAIR, "qid", "own", "hmax"))))
    from pyspark.sql.pandas.types import to_arrow_type
    schema = f"qid {kinds['qid'].simpleString()}, eid {kinds['eid'].simpleString()}, score double, h long, cos double"
    met = met.groupBy("g", "b").applyInArrow(_best_of_block(k, to_arrow_type(kinds["qid"]), to_arrow_type(kinds["eid"])), schema)

    w = Window.partitionBy("qid").orderBy(F.desc("score"), "eid")
    out = met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    out = out.withColumn("best", F.max("score").over(Window.partitionBy("qid"))).filter((F.col("score") > 0) | (F.col("best") <= 0))
    return out.select(F.col("qid").alias(q_id), "rank", F.col("eid").alias(e_id), "score", F.col("h").alias("heuristic"), F.col("cos").alias("cosine"))


# ------------------------------------------------------------------ T-7 / T-8 index

INDEX_SCHEMA_VERSION = 1


def _any_tokens(low: Column) -> Column:
    """Distinct tokens of a lower-cased text, those of one character too."""
    return F.array_distinct(F.filter(F.split(low, "[^a-z0-9]+"), lambda t: t != ""))


def near_tokens(left: DataFrame, right: DataFrame, most: int = NEAR) -> DataFrame:
    """``(tok, near)``: distinct tokens of ``left`` and ``right`` (column ``tok``)
    at most ``most`` edits apart.  A token of ``right`` is cut into ``most + 1``
    pieces, of which one must stand unchanged in any near token, moved by
    ``most`` places at most; tokens meet on these pieces, so the number of keys
    does not grow with a token's length, and the distance is then taken."""
    cut = lambda n, j: F.expr(f"({n}) * ({j}) div {most + 1}")
    own = right.select(F.col("tok").alias("near")).distinct().select("near", F.length("near").alias("n"))
    pieces = [F.struct(F.col("n"), F.lit(j).alias("j"), F.substr("near", cut("n", j) + 1, cut("n", j + 1) - cut("n", j)).alias("piece")) for j in range(most + 1)]
    own = own.select("near", F.explode(F.array(*pieces)).alias("key")).select("near", "key.*")
    other = left.select("tok").distinct().withColumn("n", F.explode(F.sequence(F.greatest(F.length("tok") - most, F.lit(1)), F.length("tok") + most)))
    other = other.select("tok", "n", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("j"))
    other = other.select("tok", "n", "j", cut("n", "j").cast("int").alias("lo"), cut("n", "j + 1").cast("int").alias("hi"))
    starts = F.sequence(F.greatest(F.col("lo") - most, F.lit(0)), F.col("lo") + most)
    pieces = F.array_distinct(F.transform(starts, lambda at: F.substr(F.col("tok"), at + 1, F.col("hi") - F.col("lo"))))
    other = other.select("tok", "n", "j", F.explode(pieces).alias("piece"))
    met = other.join(own, ["n", "j", "piece"]).select("tok", "near").distinct()
    return met.filter(F.levenshtein("tok", "near", most) >= 0)


def legacy_topk(questions: DataFrame, examples: DataFrame, *, q_id: str, q_text: str, e_id: str, e_text: str, k: int = DEFAULT_K) -> DataFrame:
    """T-5 in its older form, without vectors: ``(q_id, rank, e_id, heuristic)``,
    each question's ``k`` best examples, ties by ``e_id``.

    +10 where either text contains the other, + shared tokens, +1 where some
    token of the question is within two edits of one of the example, +2 for
    workload or latency in both, +2 for pod or pods in both.  Null texts are empty.

    Pairs are made where texts share a token, and a question's best ``k`` of
    them are kept beside those where one text contains the other, which are
    scored on the texts.  All others score 1 or 0, and only the least ids can be
    among the best ``k``: of the examples near each of a question's tokens, and
    of all, the first ``k`` are enough, since less than ``k`` others can stand
    before them.  So no more than a few rows a question and token are shuffled.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    q = questions.select(F.col(q_id).alias("qid"), low(q_text).alias("qlow")).withColumns({"qtok": tokens("qlow"), "qany": _any_tokens(F.col("qlow"))})
    ex = examples.select(F.col(e_id).alias("eid"), low(e_text).alias("elow")).withColumns({"etok": tokens("elow"), "eany": _any_tokens(F.col("elow"))})
    pods, pair = (F.array(*map(F.lit, x)) for x in (("pod", "pods"), ("workload", "latency")))
    marked = lambda tok: F.when(F.arrays_overlap(tok, pods), F.concat(tok, F.array(F.lit(POD)))).otherwise(tok)
    asked = q.select("qid", F.explode(marked(F.col("qany"))).alias("tok"))
    postings = ex.select("eid", F.explode(marked(F.col("eany"))).alias("tok"))
    # pod and pods are near each other, as equal tokens are
    score = lambda n, pod, two: (n + 1 + PAIR_BONUS * (pod + two)).cast("long")

    one = lambda cond: F.max(F.when(cond, 1).otherwise(0))
    shared = asked.join(postings, "tok").groupBy("qid", "eid").agg(
        score(F.count_if(F.col("tok") != POD), one(F.col("tok") == POD), one(F.col("tok").isin("workload", "latency"))).alias("h"))
    by_score = Window.partitionBy("qid").orderBy(F.desc("h"), "eid")
    shared = shared.withColumn("r", F.row_number().over(by_score)).filter(F.col("r") <= k).drop("r")

    turned = _contained(ex.select(F.col("eid").alias("qid"), F.col("elow").alias("qlow"), F.col("etok").alias("qtok")),
                        q.select(F.col("qid").alias("eid"), F.col("qlow").alias("elow")))
    inside = _contained(q, ex).union(turned.select(F.col("eid").alias("qid"), F.col("qid").alias("eid"))).distinct()
    both = F.array_intersect("qany", "eany")
    close = F.exists("qany", lambda a: F.exists("eany", lambda b: F.levenshtein(a, b, NEAR) >= 0))
    # a contained pair's own near token counts where it shares none
    inside = (inside.join(q.select("qid", "qany"), "qid").join(ex.select("eid", "eany"), "eid").groupBy("qid", "eid")
              .agg(F.sum(F.size(both)).alias("n"), one(F.arrays_overlap("qany", pods) & F.arrays_overlap("eany", pods)).alias("pod"),
                   one(F.arrays_overlap(both, pair)).alias("pair"), one(close).alias("close")))
    h = F.when((F.col("n") > 0) | (F.col("pod") > 0), score(F.col("n"), F.col("pod"), F.col("pair"))).otherwise(F.col("close"))
    inside = inside.select("qid", "eid", (h + CONTAIN_BONUS).alias("h"))

    first = lambda df: df.withColumn("r", F.dense_rank().over(Window.partitionBy("tok").orderBy("eid"))).filter(F.col("r") <= k).select("tok", "eid").distinct()
    words = asked.filter(F.col("tok") != POD)
    kept = first(postings.filter(F.col("tok") != POD))
    near = near_tokens(words, kept.select("tok")).join(kept.select(F.col("tok").alias("near"), "eid"), "near").select("tok", "eid")
    near = first(near).groupBy("tok").agg(F.collect_list(F.struct("eid")).alias("ids"))
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k)
    ones = words.join(near, "tok").groupBy("qid").agg(ids.alias("ids")).select("qid", F.explode("ids").alias("e")).select("qid", "e.eid", F.lit(1).cast("long").alias("h"))
    least = ex.select("eid").distinct().orderBy("eid").limit(k).agg(F.array_sort(F.collect_list("eid"))).scalar()
    none = q.select("qid", F.explode(least).alias("eid"), F.lit(0).cast("long").alias("h"))

    best = shared.union(inside).union(ones).union(none).groupBy("qid", "eid").agg(F.max("h").alias("h"))
    ranked = best.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return ranked.select(F.col("qid").alias(q_id), "rank", F.col("eid").alias(e_id), F.col("h").alias("heuristic"))


def row_hash(*cols) -> Column:
    """60-bit integer from the SHA-256 of the joined fields (order-aware via the id)."""
    joined = F.concat_ws("||", *[F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")) for c in cols])
    return F.conv(F.left(F.sha2(joined, 256), F.lit(15)), 16, 10).cast("bigint")


def index_rows(examples: DataFrame, domain: str, id_col: str, question: str, answer: str,
               vec: str | None = None) -> DataFrame:
    """T-7 index rows: id, question hash (16 hex), vector, plus a row hash used
    for the corpus hash."""
    v = F.col(vec) if vec else F.lit(None).cast("array<float>")
    return examples.select(
        F.col(domain).alias("domain"), F.col(id_col).alias("id"), F.col(question).alias("question"),
        F.col(answer).alias("answer"),
        F.left(F.sha2(F.coalesce(F.col(question), F.lit("")), 256), F.lit(16)).alias("question_hash"),
        v.alias("vector"),
        row_hash(F.col(id_col).cast("string"), F.trim(F.col(question)), F.trim(F.col(answer))).alias("_rh"))


def index_header(rows: DataFrame) -> DataFrame:
    """T-7 per-domain header: example count, vector size and a corpus hash.

    The corpus hash is the sum of per-row hashes that include the example id,
    so it changes when any example, its text, its position or its number of
    copies changes (equal rows do not cancel), and it
    is computed with a partial aggregate (no ordered concatenation of the
    whole corpus in one task).  ``reference_corpus_hash`` gives the
    sequential SHA-256 of the ordered ``q||k\\n`` stream for small corpora."""
    return rows.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_examples"),
        F.coalesce(F.max(F.size("vector")), F.lit(0)).cast("int").alias("vector_dim"),
        F.sum(F.col("_rh").cast("decimal(38,0)")).cast("string").alias("examples_hash"),
        F.lit(INDEX_SCHEMA_VERSION).alias("schema_version"))


def reference_corpus_hash(examples: DataFrame, domain: str, order_col: str, question: str, answer: str) -> DataFrame:
    """T-7 the reference's corpus hash: first 32 hex of SHA-256 over the
    examples in order, each ``trim(q) || '||' || trim(k) || '\\n'``.  This is a
    sequential hash, so each domain is one group; use it for curated example
    sets only (bounded), and ``index_header`` for corpora."""
    item = F.concat(F.trim(F.col(question)), F.lit("||"), F.trim(F.col(answer)), F.lit("\n"))
    return examples.withColumn("_item", item).groupBy(F.col(domain).alias("domain")).agg(
        F.left(F.sha2(F.expr(f"listagg(_item, '') WITHIN GROUP (ORDER BY {order_col})"), 256), F.lit(32))
        .alias("examples_hash"))


def dirty_domains(stored: DataFrame, current: DataFrame, force: bool = False) -> DataFrame:
    """T-8 which domains need a rebuild: forced, missing, schema version,
    corpus hash or vector shape changed.  Output: domain, dirty, reason."""
    s = stored.select("domain", *[F.col(c).alias("s_" + c) for c in stored.columns if c != "domain"])
    j = current.join(s, "domain", "left")
    reason = (F.when(F.lit(force), "force").when(F.col("s_examples_hash").isNull(), "missing")
               .when(F.col("s_schema_version") != F.col("schema_version"), "version")
               .when((F.col("s_examples_hash") != F.col("examples_hash")) | (F.col("s_n_examples") != F.col("n_examples")), "hash")
               .when(F.col("s_vector_dim") != F.col("vector_dim"), "shape").otherwise("ok"))
    return j.select("domain", (reason != "ok").alias("dirty"), reason.alias("reason"))
