"""Corpus pipeline over ``documents``: quality, near duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its decisions take effect. All but the last
return the columns of ``documents``. Null and empty texts pass through every stage whose measure they do not fail; an empty table
gives empty results; further columns of ``documents`` are carried along unread, whatever their names. ``run`` writes what each stage keeps
as Parquet in the shared checkpoint folder and reads it back, so no stage is computed twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringledger.llm import common, decontaminate, jaccard_join, quality, sentencepiece_codec
from ringledger.session import ensure_checkpoint_dir


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose probability of the highest grade is low: junk and toxic texts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("grade", quality.grade())
    names = common.free_names(docs.columns, *quality.NAMES)
    rated = quality.rate_documents(docs, quality.train(docs, labels), names=names)
    return rated.where(F.col(names[2])).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8) stays: that with the smallest id."""
    return jaccard_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents of which more than half the words are hit go."""
    return decontaminate.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the bytes of the text that each stands for."""
    found = sentencepiece_codec.encode_documents(docs, sentencepiece_codec.default_model(), decode=False)
    return found.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality classifier", good), ("n-gram Jaccard join", distinct), ("benchmark decontamination", decontaminated), ("SentencePiece encoding", encoded)]
#: SQL cannot express the classifier and the encoding; the tests compare the stages with plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
