"""Quality scores by compression.

Two zstandard dictionaries are built from windows of good and of bad labelled
texts, at each of the ``SCALES`` (window and dictionary size).  A text is cut into
windows and each is compressed with either dictionary; the normalised
differences of the summed sizes are the only features of a logistic
calibration, fitted on labelled texts that the dictionaries have not seen.

The fit uses a bounded sample: about ``DICT_DOCS`` and ``FIT_DOCS`` labelled
documents of each class (drawn by a hash of the id), with their whole texts.
Scores cover whole texts.

Defined results: a null text is scored like the empty one, which gets the
calibration's value for no evidence; labels that are null or other than 0 and
1 are left out; with labels of one class or none the score is the share of
class 1 (0.5 without labels); extra columns and repeated rows are kept as they
are, and an input column named ``score`` gives way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemark.llm import common as C

#: Bytes of a window and of its dictionaries.
SCALES = ((256, 1 << 16), (1024, 1 << 14), (4096, 1 << 16))
LEVEL = 3
DICT_DOCS = 2000
FIT_DOCS = 4000
FEATURES = 3 * len(SCALES)
THRESHOLD = 0.3


def windows(raw: bytes, size: int) -> list[bytes]:
    return [raw[i:i + size] for i in range(0, len(raw), size)]


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the samples' last bytes where they are too few
    to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Sizes:
    """Compressed sizes of a text with the good and the bad dictionary of each scale."""

    def __init__(self, dictionaries: list[tuple[bytes, bytes]]):
        import zstandard

        def one(raw):
            dict_data = zstandard.ZstdCompressionDict(raw) if raw else None
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=dict_data, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.by = [(size, one(good), one(bad)) for (size, _), (good, bad) in zip(SCALES, dictionaries)]

    def features(self, text: str | None) -> list[float]:
        """For each scale the difference over the text's size, over the larger
        compressed size, and drawn towards 0 for short texts."""
        raw = (text or "").encode("utf-8", "replace")
        out = []
        for size, *both in self.by:
            parts = windows(raw, size)
            good, bad = (sum(len(c.compress(w)) for w in parts) for c in both)
            d = bad - good
            out += [d / max(len(raw), 1), d / max(good, bad, 1), d / (len(raw) + 200)]
        return out


def expand(x: np.ndarray) -> np.ndarray:
    """The features, their squares and products, and a constant."""
    i, j = np.triu_indices(x.shape[1])
    return np.hstack([np.ones((len(x), 1)), x, x[:, i] * x[:, j]])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method on the weighted, ridged log-likelihood."""
    w, pen = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pen[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + pen * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(pen)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    return w


class Model:
    """What the executors need: the dictionaries and the calibration."""

    def __init__(self, dictionaries=((b"", b""),) * len(SCALES), mean=None, scale=None, weights=None, prior=0.5):
        self.dictionaries, self.mean, self.scale, self.weights, self.prior = dictionaries, mean, scale, weights, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        z = expand(np.clip((x - self.mean) / self.scale, -6, 6)) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _features(dictionaries):
    def run(batches: Iterator[pa.RecordBatch]):
        sizes = Sizes(dictionaries)
        for b in batches:
            x = [sizes.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])
    return run


def fit(docs: DataFrame, labels: DataFrame, learn=None, id_col="doc_id", text_col="text", label_col="quality", dict_docs: int = DICT_DOCS, fit_docs: int = FIT_DOCS) -> Model:
    """Fit on the labelled rows for which ``learn`` (a condition on ``labels``) holds."""
    C.small_batches(docs.sparkSession)
    lab = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    lab = lab.filter(learn) if learn is not None else lab
    lab = lab.select(F.col(id_col).alias("id_"), F.col(label_col).cast("int").alias("label"), F.xxhash64(F.lit(4), id_col).alias("h"))
    n = {r["label"]: r["n"] for r in lab.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Model(prior=(n.get(1, 0) / sum(n.values())) if n else 0.5)

    def sample(even: bool, most: int) -> DataFrame:
        side = lab.filter(F.pmod("h", F.lit(2)) == (0 if even else 1))
        picked = C.bounded_sample(side, "label", most, C.uniform(4, F.col("h")), {k: max(v / 2, 1) for k, v in n.items()})
        # about 2 * most rows of three numbers
        rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text"))
        return rows.join(F.broadcast(picked), "id_").select("label", "text", "h")

    # the whole texts of about 2 * dict_docs documents
    shown = sample(True, dict_docs).filter(F.length("text") > 0).collect()
    shown.sort(key=lambda r: (r["h"], r["text"]))
    raw = {k: [r["text"].encode("utf-8", "replace") for r in shown if r["label"] == k] for k in (0, 1)}
    dictionaries = [tuple(dictionary([w for t in raw[k] for w in windows(t, size)], most) for k in (1, 0)) for size, most in SCALES]
    rows = sample(False, fit_docs).mapInArrow(_features(dictionaries), "label int, x array<double>").collect()
    y = np.array([r["label"] for r in rows], dtype=float)
    if len(set(y.tolist())) < 2:
        return Model(prior=n[1] / (n[0] + n[1]))
    rows.sort(key=lambda r: (r["label"], r["x"]))
    y, x = np.array([r["label"] for r in rows], dtype=float), np.array([r["x"] for r in rows])
    # classes are sampled apart; weights bring back their shares
    share = n[1] / (n[0] + n[1])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    return Model(dictionaries, mean, scale, fit_logistic(expand(np.clip((x - mean) / scale, -6, 6)), y, weight), share)


def score(docs: DataFrame, model: Model, text_col="text") -> DataFrame:
    """``docs`` with ``score``, the likelihood of class 1."""
    C.small_batches(docs.sparkSession)
    docs = C.add(docs, score=F.lit(0.0))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])
    shared = docs.sparkSession.sparkContext.broadcast(model)       # six dictionaries of 288 KB in all and 55 numbers

    def run(batches: Iterator[pa.RecordBatch]):
        m = shared.value
        sizes = Sizes(m.dictionaries)
        for b in batches:
            x = np.array([sizes.features(t) for t in b.column(text_col).to_pylist()]).reshape(-1, FEATURES)
            yield b.set_column(b.schema.get_field_index("score"), "score", pa.array(m.score(x)))

    return docs.mapInArrow(run, schema)
