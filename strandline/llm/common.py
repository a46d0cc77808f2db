"""Shared plumbing: scratch tables in the cluster's shared folder, Arrow batches by bytes, prefix sums."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table may be broadcast up to this many rows of a few machine words each; callers count first.
BROADCAST_ROWS = 250_000

#: Bytes of an Arrow batch between Spark and Python. Spark's own default, 64 MB, is held several times over by
#: each task on both sides.
BATCH_BYTES = 4 << 20

#: What ``materialise`` wrote, by application.
_written: dict[str, list[str]] = {}
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, else the one given to ``setCheckpointDir``. Where neither is set a
    local master, whose executors are this machine, gets a temporary folder, and a cluster a folder in its
    warehouse, which its executors share."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get()
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if spark.sparkContext.master.startswith("local"):
            _own_dirs[app] = tempfile.mkdtemp(prefix="strandline-")
        else:
            _own_dirs[app] = f"{spark.conf.get('spark.sql.warehouse.dir')}/strandline-{app}"
    return _own_dirs[app]


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session's Arrow batches were bounded to BATCH_BYTES, if they were larger."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    given = conf.get(key, "64m").lower()
    if not (given.rstrip("b").isdigit() and 0 < int(given.rstrip("b")) <= BATCH_BYTES):
        conf.set(key, str(BATCH_BYTES))
    return df


def trim(spark: SparkSession) -> None:
    """Give back to the system what the driver's JVM has freed outside its heap. The C library keeps such memory, thread by
    thread, and plans by the dozen, each compiled and dealt out, leave some hundred MB of it. JVMs other than HotSpot on
    Linux have no such command, and are left alone."""
    gateway, java = spark.sparkContext._gateway, spark._jvm.java
    kind, name, text, some, texts = (java.lang.Class.forName(x) for x in ("javax.management.MBeanServer", "javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"))
    types, values = gateway.new_array(java.lang.Class, 4), gateway.new_array(java.lang.Object, 4)
    command = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    for i, (of, value) in enumerate(((name, command), (text, "systemTrimNativeHeap"), (some, None), (texts, None))):
        types[i], values[i] = of, value
    with contextlib.suppress(Py4JJavaError):
        kind.getMethod("invoke", types).invoke(java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)


def materialise(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it again: lineage ends there, and a lost
    executor costs no more than the tasks it was running. ``zstd`` is for tables of texts: its writers hold memory
    outside the heap that many small files would add up."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.option("compression", codec).parquet(path)
    trim(spark)
    return spark.read.schema(schema).parquet(path)


def materialise_buckets(df: DataFrame, tag: str, column: str, buckets: int) -> DataFrame:
    """As ``materialise``, in buckets of ``column``: what is grouped or joined by that column later needs no shuffle of
    this table. It is a table of the session's catalog, of which ``remove`` drops the name too."""
    spark = df.sparkSession
    name = f"strandline_{tag}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(spark)}/{name}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.bucketBy(buckets, column).option("path", path).option("compression", "zstd").saveAsTable(name)
    trim(spark)
    return spark.table(name)


def written(spark: SparkSession) -> list[str]:
    """The scratch tables of this application that were not removed, oldest first."""
    return list(_written.get(spark.sparkContext.applicationId, []))


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables, through the file system that they are in. No DataFrame that reads one may be in use."""
    have = _written.get(spark.sparkContext.applicationId, [])
    for path in paths:
        name = path.rsplit("/", 1)[-1]
        if name.startswith("strandline_"):
            spark.sql(f"drop table if exists `{name}`")
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        have.remove(path)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that starts with ``stem`` and that ``df`` hasn't, letters' case aside."""
    taken = {c.lower() for c in df.columns}
    while any(c.startswith(stem) for c in taken):
        stem += "_"
    return stem


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows, found without counting past the bound."""
    return df.limit(rows + 1).count() <= rows


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``small`` if its counted size allows; else a shuffled join, which AQE can split."""
    return big.join(F.broadcast(small) if small_enough(small, rows) else small, on, how)


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows whose ``column`` holds about ``limit`` bytes (a row at least)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if not batch.num_rows or col.nbytes <= limit:
            if batch.num_rows:
                yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        start = used = 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and used + n > limit:
                yield batch.slice(start, i - start)
                start, used = i, 0
            used += n
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts as Python strings; null reads as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def with_bases(parts: DataFrame, totals: DataFrame, size: str, out: str) -> DataFrame:
    """Second pass of a two-pass prefix sum: add to each row of ``parts`` the total ``size`` of all
    partitions (``pid``) before its own. ``totals`` has a row for each partition, whatever the input."""
    from pyspark.sql import Window

    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("pid", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long").alias(out))
    return join_small(parts, bases, "pid")
