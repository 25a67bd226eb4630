"""What the tasks of the pipeline's stages hold outside the heap stays bounded."""

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpus_pipeline import STAGES
from telemark.llm import common as C
from telemark.llm import tokens
from tests.conftest import SF001

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_texts_reach_python_in_small_batches(spark, tmp_dir, monkeypatch):
    spark.conf.unset(LIMIT)

    def seen(*_):
        def run(batches):
            for i, b in enumerate(batches):
                row = {"part": 0, "seg": i, "at": b.num_rows, "n_tokens": b.nbytes, "doc_ids": [], "doc_tokens": [], "codes": b""}
                yield pa.RecordBatch.from_pylist([row], schema=tokens.SCHEMA)
        return run

    monkeypatch.setattr(tokens, "_segments", seen)
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 400).alias("text"))
    tokens.write(docs, f"file://{tmp_dir}/m", TOKENIZER)
    got = spark.read.parquet(f"file://{tmp_dir}/m/segments").agg(F.sum("at"), F.max("n_tokens")).first()
    assert got[0] == 12_000 and got[1] < 2 * C.BATCH_BYTES


@pytest.mark.parametrize("name", ["quality", "dedup", "decontaminate", "tokens"])
def test_stages_hand_over_small_batches(spark, name):
    spark.conf.unset(LIMIT)
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(5)
    dict(STAGES)[name](spark, docs, SF001)
    assert int(spark.conf.get(LIMIT).rstrip("b")) == C.BATCH_BYTES


def test_known_words_are_bounded():
    enc = tokens.WordEncoder(TOKENIZER)
    for i in range(0, 500, 10):
        texts = [" ".join(f"w{i + j}x{k}" for k in range(1000)) for j in range(10)]
        got = enc.encode(texts)
    assert len(enc.words) + len(enc.older) < 450_000
    assert got[-1] == enc.whole(texts[-1]).tobytes()


def _batch(n, words=20):
    return pa.RecordBatch.from_pydict({"id": list(range(n)), "text": [" ".join(f"w{i}x{k}" for k in range(words)) for i in range(n)]})


def test_the_pipeline_encodes_few_texts_at_once(monkeypatch):
    asked = []

    def token_rows(docs, **how):
        asked.append(how)

    monkeypatch.setattr("corpus_pipeline.token_rows", token_rows)
    dict(STAGES)["tokens"](None, None, SF001)
    assert asked[0]["at_once"] <= 256

    class Counting(tokens.WordEncoder):
        def encode(self, texts):
            seen.append(len(texts))
            return super().encode(texts)

    rows = {}
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    for at_once in (256, 1024):
        seen = []
        monkeypatch.setattr(tokens, "_ENCODERS", {TOKENIZER: Counting(TOKENIZER)})
        got = list(tokens._segments(TOKENIZER, 2, 1 << 12, at_once)(iter([_batch(600), _batch(0), _batch(1100)])))
        assert max(seen) <= at_once and sum(seen) == 1700
        rows[at_once] = [b.to_pylist() for b in got]
    assert rows[256] == rows[1024]


def test_words_go_when_tokens_are_read_back(monkeypatch):
    monkeypatch.setattr(tokens, "_ENCODERS", {})
    tokens.encoder(TOKENIZER).encode(["some words", "of a text"])
    # as in a worker: what a task runs comes pickled, and copies of the module's variables with it
    task = cloudpickle.loads(cloudpickle.dumps(tokens._documents(False)))
    assert list(task(iter([]))) == [] and not tokens._ENCODERS


def test_arrow_gives_back_what_a_task_leaves(monkeypatch):
    calls = []
    monkeypatch.setattr(pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: calls.append(1)})())
    got = list(C.sliced(iter([_batch(5), _batch(0), _batch(3)]), 2))
    assert [b.num_rows for b in got] == [2, 2, 1, 2, 1] and calls == [1]
