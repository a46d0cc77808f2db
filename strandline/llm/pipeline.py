"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents, and any other columns docs has, whatever their
names. A stage does with nulls, empty and very long texts, ties and repeated rows what its operator's module says; an
empty table goes through all of them as an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandline.llm.common import materialise, remove, written
from strandline.llm.mixing import mixed_documents
from strandline.llm.near_duplicates import keep_one
from strandline.llm.packing import pack
from strandline.llm.quality_classifier import keep_quality
from strandline.llm.quality_rules import keep_by_rules


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is within their language's limit."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose measures are within the thresholds of their language and source. Null texts go; null languages and
    sources are groups of their own."""
    return keep_by_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, repeated rows among them, the document with the smallest id; rows with a null id and
    texts without words stay."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them; a null source is a source, and rows are documents each."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in sequences of 1024 ids. A null text is packed as its end id alone."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

#: SQL can express neither the language model nor the tokenizer; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of ``sf_dir``. Once a stage's rows are written, what led
    to them is removed; the last stage's table stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), written(spark)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"), "zstd")
        remove(spark, [x for x in written(spark)[:-1] if x not in before])
    return docs
