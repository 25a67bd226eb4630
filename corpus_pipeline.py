"""The training-data pipeline over ``documents``: five stages, each one of the
operators of ``telemark.llm``.

``quality``       documents that the compression classifier rejects go; it
                  learns from ``labels``
``dedup``         of each component of the n-gram Jaccard join (five words,
                  0.8) the first document by id and text stays
``decontaminate`` documents that hold benchmark items go
``mix``           documents are repeated towards their source's target
``tokens``        the mix is written as token ids and read back

The first four return the columns of documents.  Null ids and texts pass the
filters like other rows: a null text is an empty document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemark.llm import common as C
from telemark.llm import jaccard, mixing, quality, tiling
from telemark.llm.queries import token_rows


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).filter(F.col("score") >= quality.THRESHOLD).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tiling.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_items=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # few texts at once: its workers stand beside a heap that the stages before have filled
    return token_rows(docs, at_once=256)


STAGES = [("quality", quality_filter), ("dedup", near_duplicates), ("decontaminate", decontaminate), ("mix", mix_sources), ("tokens", token_output)]

#: Scores and hash-seeded copies are beyond SQL; the tests hold each stage
#: against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = C.written(docs, name)
    return docs
