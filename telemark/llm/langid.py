"""Language identification by hierarchical discrimination.

A text's letter bigrams and trigrams are hashed into a histogram.  Linear
support vector machines first tell language families apart, one against one,
by votes; then those of the chosen family's languages, again one against one.

The fit uses a bounded sample: about ``LANG_DOCS`` documents of a language,
drawn by a hash of the id.  Each pair of classes is trained in a task of
its own on the sampled histograms; only the weights reach the driver.

Defined results: null texts and texts without a letter are ``und`` with score
0; a null language is not learned from; with one language all texts with a
letter get it; with none all are ``und``; extra columns stay and input columns
named ``lang_pred`` or ``score`` give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemark.llm import common as C

DIM = 1 << 12
LANG_DOCS = 1000
UNKNOWN = "und"

#: The families of ISO 639-1 codes; a code not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tk tr tt ug uz",
    "indo-aryan": "bn gu hi mr ne pa sa si ur",
    "semitic": "am ar he mt",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], lang)


# bytes: letters of ASCII in lower case, everything beyond ASCII as it is, the rest as one blank
_FOLD = np.zeros(256, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def histogram(text: str) -> np.ndarray:
    """Square roots of hashed bigram and trigram counts, of length one."""
    b = _FOLD[np.frombuffer((" " + text + " ").encode("utf-8", "replace"), np.uint8)]
    # runs of blanks count once
    b = b[np.concatenate([[True], (b[1:] != 0) | (b[:-1] != 0)])].astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(263) + b[2:]
    h = np.zeros(DIM)
    for g, by in ((two, 2654435761), (three, 2246822519)):
        h += np.bincount((g * np.uint32(by)) >> np.uint32(20), minlength=DIM)
    h = np.sqrt(h)
    return (h / (np.sqrt((h * h).sum()) or 1.0)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 200) -> np.ndarray:
    """A linear SVM (squared hinge, accelerated gradient); the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]).astype(np.float64)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    step = 1 / (1 / c + 4)      # rows have length sqrt(2) at most
    w = v = np.zeros(x.shape[1])
    for k in range(1, rounds + 1):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (v / c / 10 - 2 * x.T @ (weight * y * slack))
        w, v = new, new + (k / (k + 3)) * (new - w)
    return w


class Model:
    """Weights by pair of classes, for families and for languages within one."""

    def __init__(self, langs: list[str], weights: dict[tuple[str, str, str], np.ndarray]):
        self.langs = langs
        self.families = sorted({family(x) for x in langs})
        self.pairs = sorted(weights)
        self.matrix = np.array([weights[p] for p in self.pairs], dtype=np.float32).reshape(-1, DIM + 1).T

    def _choose(self, level: str, names: list[str], margins: dict) -> tuple[np.ndarray, np.ndarray]:
        """Most votes, then the larger sum of margins; the weakest duel won gives the confidence."""
        n = len(next(iter(margins.values())))
        votes, sums, least = (np.full((n, len(names)), v) for v in (0.0, 0.0, np.inf))
        for (lev, a, b), m in margins.items():
            if lev == level and a in names and b in names:
                for k, s in ((names.index(a), m), (names.index(b), -m)):
                    votes[:, k] += s > 0
                    sums[:, k] += s
                    least[:, k] = np.minimum(least[:, k], s)
        pick = np.argmax(votes + 0.5 * np.tanh(sums / max(len(names), 1)) / len(names), axis=1)
        return pick, 1 / (1 + np.exp(-3 * least[np.arange(n), pick]))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if len(self.langs) == 1:
            return self.langs * len(x), np.ones(len(x))
        m = x @ self.matrix[:-1] + self.matrix[-1]
        margins = {p: m[:, i].astype(np.float64) for i, p in enumerate(self.pairs)}
        fam, sure = self._choose("family", self.families, margins) if len(self.families) > 1 else (np.zeros(len(x), int), np.ones(len(x)))
        out = [""] * len(x)
        score = sure.copy()
        for k, f in enumerate(self.families):
            own, at = [g for g in self.langs if family(g) == f], np.flatnonzero(fam == k)
            if len(own) > 1 and len(at):
                pick, s = self._choose("lang", own, {p: v[at] for p, v in margins.items()})
                score[at] *= s
            else:
                pick = np.zeros(len(at), int)
            for i, j in zip(at.tolist(), pick.tolist()):
                out[i] = own[j]
        return out, score


def _sampled(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        lang, text = b.column("lang").to_pylist(), b.column("text").to_pylist()
        keep = [i for i, t in enumerate(text) if has_letter(t)]
        yield pa.RecordBatch.from_arrays([pa.array([lang[i] for i in keep], pa.string()), pa.array([histogram(text[i]).tobytes() for i in keep], pa.binary())], names=["lang", "x"])


def _train(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["side", "x"])
    x = np.frombuffer(b"".join(pdf["x"]), np.float32).reshape(-1, DIM)
    w = train_svm(x, np.where(pdf["side"] == 0, 1.0, -1.0)).astype(np.float32)
    return pd.DataFrame({"level": pdf["level"].iloc[:1], "a": pdf["a"].iloc[:1], "b": pdf["b"].iloc[:1], "w": [w.tobytes()]})


def fit(docs: DataFrame, learn=None, id_col="doc_id", text_col="text", lang_col="lang", lang_docs: int = LANG_DOCS) -> Model:
    """Fit on the rows with a language for which ``learn`` (a condition) holds."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.filter(learn) if learn is not None else rows
    rows = rows.select(F.col(id_col).alias("id_"), F.col(lang_col).cast("string").alias("lang"))
    picked = C.bounded_sample(rows, "lang", lang_docs, C.uniform(10, F.col("id_")))
    picked = C.written(picked.distinct(), "langs")
    langs = sorted(r["lang"] for r in picked.select("lang").distinct().collect())
    if len(langs) < 2:
        return Model(langs, {})
    # about lang_docs rows a language
    few = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id_").select("lang", "text")
    x = C.written(few.mapInArrow(_sampled, "lang string, x binary"), "histograms")
    fams = sorted({family(g) for g in langs})
    duels = [("family", a, b, g, int(family(g) == b)) for i, a in enumerate(fams) for b in fams[i + 1:] for g in langs if family(g) in (a, b)]
    duels += [("lang", a, b, g, int(g == b)) for i, a in enumerate(langs) for b in langs[i + 1:] if family(a) == family(b) for g in (a, b)]
    spark = docs.sparkSession
    duel = spark.createDataFrame(duels, "level string, a string, b string, lang string, side int")
    got = x.join(F.broadcast(duel), "lang").groupBy("level", "a", "b").applyInPandas(_train, "level string, a string, b string, w binary").collect()
    return Model(langs, {(r["level"], r["a"], r["b"]): np.frombuffer(bytes(r["w"]), np.float32) for r in got})


def predict(docs: DataFrame, model: Model, text_col="text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    docs = C.add(docs, lang_pred=F.lit(UNKNOWN), score=F.lit(0.0))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])
    shared = docs.sparkSession.sparkContext.broadcast(model)       # DIM numbers for each pair of classes

    def run(batches: Iterator[pa.RecordBatch]):
        m = shared.value
        for b in batches:
            text = b.column(text_col).to_pylist()
            lang, score = [UNKNOWN] * len(text), np.zeros(len(text))
            keep = [i for i, t in enumerate(text) if m.langs and has_letter(t)]
            for lo in range(0, len(keep), 512):
                some = keep[lo:lo + 512]
                names, s = m.predict(np.array([histogram(text[i]) for i in some]))
                for i, name in zip(some, names):
                    lang[i] = name
                score[some] = s
            b = b.set_column(b.schema.get_field_index("lang_pred"), "lang_pred", pa.array(lang, pa.string()))
            yield b.set_column(b.schema.get_field_index("score"), "score", pa.array(score))

    return docs.mapInArrow(run, schema)
