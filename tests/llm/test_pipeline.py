import os
import re
import shutil
import subprocess
import sys

import corpus_pipeline
from strandline.llm import queries
from strandline.llm.common import materialise
from strandline.llm.near_duplicates import near_duplicates

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.count())
        if i < 4:
            assert docs.columns == columns
        if i == 2:
            classes = near_duplicates(before).groupBy("class_id").count().count()
            assert counts[-1] == classes and near_duplicates(docs).where("n_links > 0").count() == 0
    assert counts[0] > counts[1] > counts[2] > counts[3] and counts[5] > 0
    assert queries.QUERIES["pipeline"](spark, sf).count() == counts[5]
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    kept = {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/0").collect()}
    assert len(good & kept) >= 0.98 * len(good)


def test_empty_and_awkward(spark, sf, awkward, tmp_path):
    for name, docs in (("empty", awkward.limit(0)), ("awkward", awkward)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}{i}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{i}")


def test_freed_memory_goes_back(spark):
    """What the driver's JVM has freed outside its heap, in holes between what it still holds, doesn't stay with it once a
    scratch table is written."""
    java = spark._jvm.java
    pid = java.lang.ProcessHandle.current().pid()

    def held():
        with open(f"/proc/{pid}/smaps_rollup") as f:
            return int(re.search(r"Pss_Anon:\s+(\d+)", f.read())[1]) / 1024

    materialise(spark.range(1), "small")  # so that the heap has grown before
    field = java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    memory = field.get(None)
    pieces = [memory.allocateMemory(1 << 16) for _ in range(3200)]
    for x in pieces:
        memory.setMemory(x, 1 << 16, 1)
    for x in pieces[:-1]:
        memory.freeMemory(x)
    kept = held()
    materialise(spark.range(1), "small")
    given_back = kept - held()
    memory.freeMemory(pieces[-1])
    assert given_back > 100


def test_the_rest_works_without_this_package(tmp_path):
    for part in ("strandline", "__spark_entry__.py"):
        source = os.path.join(REPO, part)
        shutil.copytree(source, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(x.startswith('op') for x in q) and set(e.oracle_sql()) <= set(q)"
    for leave_folder in (False, True):
        if leave_folder:  # such as one with nothing but caches in it
            (tmp_path / "strandline" / "llm" / "__pycache__").mkdir(parents=True)
        subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
