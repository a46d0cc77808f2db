"""Queries, collections and indexes on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.errors import SketchError
from strandline.operators.search import first_query
from strandline.operators.signature import select
from strandline.operators.sketch import md5sum
from strandline.sources.codecs import read_files
from strandline.sources.sbt import TreeFile
from strandline.sources.signatures import load_signatures, read_signatures


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def save_file(spark: SparkSession, base: str, name: str, content: bytes) -> str:
    """Write one file of a store, whatever file system it is in; returns its path."""
    fs, target = _file_system(spark, f"{base}/{name}")
    out = fs.create(target, True)
    out.write(bytearray(content))
    out.close()
    return f"{base}/{name}"


def files_of(spark: SparkSession, path: str, traverse: bool = False) -> list[str]:
    """The path itself, or with ``traverse`` all files below it if it is a folder; a folder without it is skipped. ``-``,
    the standard input, is itself."""
    if path == "-":
        return [path]
    fs, target = _file_system(spark, path)
    if not fs.getFileStatus(target).isDirectory():
        return [path]
    if not traverse:
        return []
    found, listing = [], fs.listFiles(target, True)
    while listing.hasNext():
        found.append(listing.next().getPath().toString())
    return sorted(found)


def load_query(spark: SparkSession, path: str, ksize: int = 0, moltype: str | None = "dna") -> DataFrame:
    """(id, sketch): the first signature of a selection, by name and MD5."""
    return first_query(load_signatures(spark, path, ksize, moltype)).select(F.col("name").alias("id"), "sketch")


def _collection(flat: DataFrame) -> DataFrame:
    return flat.select(md5sum(F.col("sketch")).alias("id"), "name", "filename", "sketch")


def load_database(spark: SparkSession, path: str, ksize: int = 0, moltype: str | None = None) -> DataFrame:
    """(id, name, filename, sketch) of a tree file's leaves, or of a signature file."""
    try:
        signatures = TreeFile(spark, path).leaf_signatures() if _is_tree(spark, path) else read_signatures(spark, path)
    except Exception as e:
        raise SketchError(f"cannot load {path}: {e}") from e
    return _collection(select(signatures, ksize, moltype))


def _is_tree(spark: SparkSession, path: str) -> bool:
    if path == "-":  # can be read once only
        return False
    start = read_files(spark, path).select(F.ltrim(F.col("content").cast("string")).alias("t")).select(F.substring("t", 1, 1)).first()
    return bool(start) and start[0] == "{"


def load_databases(spark: SparkSession, paths: list[str], ksize: int = 0, moltype: str | None = None, traverse: bool = False) -> dict[str, DataFrame]:
    """Each file's collection by its path. An error if there is none."""
    files = [f for p in paths for f in files_of(spark, p, traverse)]
    if not files:
        raise SketchError("no databases could be loaded")
    return {f: load_database(spark, f, ksize, moltype) for f in files}


def save_index(collection: DataFrame, path: str) -> None:
    """Sketches as Parquet, in folders by word size and molecule, which a selection reads alone."""
    parts = collection.withColumn("ksize", F.col("sketch.ksize")).withColumn("is_protein", F.col("sketch.is_protein"))
    parts.write.partitionBy("ksize", "is_protein").mode("append").parquet(path)


def load_index(spark: SparkSession, path: str, ksize: int = 0, moltype: str | None = None) -> DataFrame:
    """What ``save_index`` wrote, all or of one word size and molecule."""
    found = spark.read.parquet(path)
    if ksize:
        found = found.where(F.col("ksize") == ksize)
    if moltype is not None:
        wanted = {"dna": False, "protein": True}.get(moltype.lower())
        found = found.where(F.lit(False) if wanted is None else F.col("is_protein") == wanted)
    return found.drop("ksize", "is_protein")
