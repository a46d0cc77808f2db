"""Signature files: JSON arrays of signatures, compressed or not."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.hashing import encode_hash
from strandline.operators.signature import DEFAULTS, METADATA, select
from strandline.operators.sketch import SKETCH, build, exact_mins, md5sum
from strandline.sources.codecs import pack_lzma, read_files

_FILE_SKETCH = "struct<num:bigint,ksize:int,seed:decimal(20,0),max_hash:decimal(20,0),mins:array<decimal(20,0)>,md5sum:string,abundances:array<decimal(20,0)>,molecule:string>"
FILE = f"array<struct<`class`:string,email:string,hash_function:string,filename:string,name:string,license:string,version:double,signatures:array<{_FILE_SKETCH}>>>"


#: A file is read in one piece; writing begins another beyond so many signatures, or bytes where it counts them itself.
FILE_ROWS, FILE_BYTES = 2000, 8 << 20


def _from_file(s: Column) -> Column:
    """A file's sketch as ours: a threshold turns the number off; any molecule but ``protein`` is DNA."""
    num = F.when(s["max_hash"] != 0, F.lit(0).cast("bigint")).otherwise(s["num"])
    return F.struct(
        num.alias("num"), s["ksize"].alias("ksize"), (F.lower(s["molecule"]) == "protein").alias("is_protein"),
        s["seed"].alias("seed"), s["max_hash"].alias("max_hash"), F.transform(s["mins"], encode_hash).alias("mins"),
        s["abundances"].cast("array<bigint>").alias("abunds"),
    )


def _to_file(s: Column) -> Column:
    return F.struct(
        s["num"].alias("num"), s["ksize"].alias("ksize"), s["seed"].alias("seed"), s["max_hash"].alias("max_hash"), exact_mins(s).alias("mins"), md5sum(s).alias("md5sum"),
        s["abunds"].alias("abundances"), F.when(s["is_protein"], "protein").otherwise("DNA").alias("molecule"),
    )


def parse(df: DataFrame, json: str, verify_md5: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The signatures in a column of JSON texts, each an array: the columns of ``keep``, the metadata and ``signatures``.

    Unknown fields are ignored, left-out ones have their usual values. A text that is no such array fails the
    query. ``verify_md5`` fails it too where a sketch's stated sum is not its own."""
    broken = F.raise_error(F.concat(F.lit("SerdeError: not a signature file: "), F.substring(json, 1, 80)))
    parsed = df.select(*keep, F.explode(F.coalesce(F.from_json(json, FILE, {"mode": "PERMISSIVE"}), broken)).alias("s"))

    def sketch_of(x: Column) -> Column:
        ours = _from_file(x)
        if not verify_md5:
            return ours
        return F.when(md5sum(ours) == x["md5sum"], ours).otherwise(F.raise_error(F.lit("SerdeError: md5sum does not match")))

    usual = lambda c: F.coalesce(F.col(f"s.{c}"), F.lit(DEFAULTS[c])).alias(c)
    plain = lambda c: F.col(f"s.{c}").alias(c)
    return parsed.select(*keep, usual("class"), usual("email"), plain("hash_function"), plain("filename"), plain("name"), usual("license"), usual("version"), F.transform("s.signatures", sketch_of).cast(f"array<{SKETCH}>").alias("signatures"))


def read_signatures(spark: SparkSession, path: str | list[str], verify_md5: bool = False) -> DataFrame:
    """All signatures of files; whether a file is compressed is read from its first bytes. A file may hold several arrays,
    one after the other: in JSON nothing but a comma can stand between two arrays within another."""
    text = F.trim(F.regexp_replace(F.col("content").cast("string"), r"[\r\n\t]+", " "))
    arrays = F.split(text, r"(?<=\]) *(?=\[)")
    return parse(read_files(spark, path).select(F.explode(arrays).alias("json")), "json", verify_md5)


def load_signatures(spark: SparkSession, path: str | list[str], ksize: int = 0, moltype: str | None = None, scaled: int | None = None) -> DataFrame:
    """Read, flatten and select, a row for each sketch."""
    return select(read_signatures(spark, path), ksize, moltype, scaled)


def to_json(signatures: DataFrame) -> DataFrame:
    """(json) of each signature, an object; null names and counts are left out."""
    fields = [F.col(c) for c in METADATA] + [F.transform("signatures", _to_file).alias("signatures")]
    return signatures.select(F.to_json(F.struct(*fields)).alias("json"))


def to_json_array(signatures: DataFrame) -> DataFrame:
    """One row (json): the array of all signatures, for interchange as a single file."""
    return to_json(signatures).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("json")), ","), F.lit("]")).alias("json"))


def write_signatures(signatures: DataFrame, path: str, codec: str = "none") -> None:
    """JSON files in a folder, an array of one signature a line, in any of the formats that reading knows. Spark writes all
    but ``lzma``, of which each task writes its file itself, through pyarrow's file systems."""
    rows = to_json(signatures).select(F.concat(F.lit("["), "json", F.lit("]")).alias("value"))
    if path == "-":
        for r in rows.toLocalIterator():
            sys.stdout.write(r["value"] + "\n")
        return
    if codec in ("none", "gzip", "bzip2"):
        rows.write.option("maxRecordsPerFile", FILE_ROWS).option("compression", codec).option("lineSep", "\n").text(path)
        return

    def write(batches: Iterator[pa.RecordBatch]):
        system, folder = fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))
        held, size, count = [], 0, 0

        def put() -> pa.RecordBatch:
            name, unfinished = f"{folder}/part-{TaskContext.get().partitionId():05d}-{count:05d}.json.xz", f"{folder}/_{uuid.uuid4().hex}"
            system.create_dir(folder)
            with system.open_output_stream(unfinished) as out:
                out.write(pack_lzma(b"".join(held)))
            system.move(unfinished, name)  # a task that was tried again replaces its files
            return pa.RecordBatch.from_arrays([pa.array([name])], ["file"])

        for batch in batches:
            for x in batch.column(0):
                line = f"{x}\n".encode()
                if held and (size + len(line) > FILE_BYTES or len(held) == FILE_ROWS):
                    yield put()
                    held, size, count = [], 0, count + 1
                held.append(line)
                size += len(line)
        if held:
            yield put()

    rows.mapInArrow(write, "file string").count()


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_signatures`` wrote: each line is an array."""
    return parse(spark.read.text(path).withColumnRenamed("value", "json"), "json")


def matches_csv(found: DataFrame, path: str) -> None:
    """Search results as CSV: similarity, name, filename, md5."""
    found.select("similarity", "name", "filename", "md5").write.option("header", True).csv(path)


def from_counts(rows: DataFrame, by: list[str], ksize: int, hash_col: str = "hash", count: str = "count") -> DataFrame:
    """(by, sketch) of rows (hash, count) of another tool: num is the number of values, counts are kept.
    hash: exact decimals."""
    hks = rows.select(*by, encode_hash(F.col(hash_col)).alias("hk"), F.col(count).cast("bigint").alias("n_"))
    built = build(hks, by, max_hash=(1 << 64) - 1, ksize=ksize, track_abundance=True, count="n_")
    number = F.size("sketch.mins").cast("bigint")
    return built.withColumn("sketch", F.col("sketch").withField("num", number).withField("max_hash", F.lit("0").cast("decimal(20,0)")))
