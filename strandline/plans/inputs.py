"""The sets that the queries sketch, derived from the driver's tables by expressions that any SQL engine has."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.hashing import portable_shingles
from strandline.operators import sketch

NUM, SCALED_TOP = 100, 1 << 56


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its files make fewer partitions than there are; a large table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def words(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def shingled(df: DataFrame, by: list[str], text: str = "text", n: int = 3) -> DataFrame:
    """(by, hashes): for each row the portable hashes of its runs of ``n`` words."""
    plain = F.trim(F.regexp_replace(F.lower(F.col(text)), "[^a-z0-9]+", " "))
    return spread(df.select(*by, text)).select(*by, portable_shingles(plain, n).alias("hashes"))


def hashed(df: DataFrame, by: list[str], text: str = "text", n: int = 3) -> DataFrame:
    """(by, hk) of every shingle, under the portable hash."""
    return shingled(df, by, text, n).select(*by, F.explode("hashes").alias("hk"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, hk) of all documents."""
    return hashed(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), ["id"])


def _sketches(df: DataFrame, by: list[str], **options) -> DataFrame:
    return sketch.build_arrays(shingled(df, by), by, "hashes", **options)


def document_sketches(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return _sketches(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), ["id"], **({"num": NUM} | options))


def scaled_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_sketches(spark, sf_dir, num=0, max_hash=SCALED_TOP + (1 << 63))


def benchmark_sketches(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return _sketches(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "id"), ["id"], **({"num": NUM} | options))


def group_sketches(spark: SparkSession, sf_dir: str, num: int = 200) -> DataFrame:
    """(id, name, sketch) of each language and source, numbered by name."""
    docs = table(spark, sf_dir, "documents").withColumn("name", F.concat_ws("-", "lang", "source"))
    built = _sketches(docs, ["name"], num=num)
    places = F.row_number().over(Window.orderBy("name")) - 1  # of the different names, a row each
    numbered = docs.select("name").distinct().select("name", places.cast("long").alias("id"))
    return built.join(numbered, "name").select("id", "name", "sketch")


def group_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, id, name, sketch): the groups as leaves of a binary tree, at positions n - 1 to 2n - 2."""
    groups = group_sketches(spark, sf_dir).persist()
    n = groups.count()
    return groups.withColumn("pos", F.col("id") + (n - 1))


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq): 32 bases for each document, from its MD5."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.translate(F.md5("text"), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))


def rough_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq): 32 characters for each document: bases, lower case and N among them."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.translate(F.md5("text"), "0123456789abcdef", "ACGTACGTACGTacgN").alias("seq"))


def text_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq): the letters of each whole text, dealt to the four bases in turn; as long as the text, or shorter than a word."""
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    letters = F.lower(F.regexp_replace("text", "[^A-Za-z]", ""))
    return docs.select("id", F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC").alias("seq"))


def rough_text_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq): as ``text_dna``, in both cases and with an N for each digit."""
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    kept = F.regexp_replace("text", "[^A-Za-z0-9]", "")
    return docs.select("id", F.translate(F.lower(kept), "abcdefghijklmnopqrstuvwxyz0123456789", "ACGTACGTACGTACGTACGTacgtacNNNNNNNNNN").alias("seq"))


def scratch(spark: SparkSession) -> str:
    """A new folder for the files that a query writes and reads back: in ``spark.checkpoint.dir``, else in the session's
    checkpoint folder, else in its warehouse, all of which executors share."""
    before = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (before.get() if before.isDefined() else spark.conf.get("spark.sql.warehouse.dir"))
    return f"{base}/strandline-{uuid.uuid4().hex}"
