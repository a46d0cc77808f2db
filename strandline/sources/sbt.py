"""Tree files: a JSON object of nodes and leaves by position, and a store of the files that it names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources import oxli
from strandline.sources.codecs import read_files
from strandline.sources.signatures import parse as parse_signatures

_NODE = "struct<filename:string,name:string,metadata:map<string,bigint>>"
_LEAF = "struct<filename:string,name:string,metadata:string>"
FILE = f"struct<d:int,version:int,storage:struct<backend:string,args:map<string,string>>,factory:struct<`class`:string,args:array<bigint>>,nodes:map<string,{_NODE}>,leaves:map<string,{_LEAF}>>"
# What a new tree file states.
VERSION, BACKEND, FACTORY = 5, "FSStorage", ("GraphFactory", [1, 100000, 4])


class TreeFile:
    """A tree that was read: ``parameters`` (d, version, backend, base, factory), ``nodes`` and ``leaves`` by pos."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        parsed = read_files(spark, path).select(F.from_json(F.col("content").cast("string"), FILE).alias("t"))
        folder = path.rsplit("/", 1)[0] if "/" in path else "."
        self.parameters = parsed.select("t.d", "t.version", "t.storage.backend", F.concat(F.lit(folder + "/"), F.col("t.storage.args")["path"]).alias("base"), "t.factory")
        self.base = self.parameters.first()["base"]

        def rows(name: str) -> DataFrame:
            some = parsed.select(F.explode(f"t.{name}").alias("pos", "x"))
            return some.select(F.col("pos").cast("bigint").alias("pos"), "x.filename", "x.name", "x.metadata")

        self.nodes, self.leaves = rows("nodes"), rows("leaves")

    def leaf_signatures(self) -> DataFrame:
        """(pos, leaf_name, metadata columns, signatures) of the leaves: of each file the first signature."""
        files = read_files(self.spark, self.base).select(F.element_at(F.split("path", "/"), -1).alias("file_"), F.col("content").cast("string").alias("json"))
        first = files.select("file_", F.concat(F.lit("["), F.get_json_object("json", "$[0]"), F.lit("]")).alias("json"))
        wanted = self.leaves.select("pos", F.col("name").alias("leaf_name"), F.col("filename").alias("file_")).join(first, "file_")
        return parse_signatures(wanted, "json", keep=("pos", "leaf_name"))


    def node_filters(self) -> tuple[DataFrame, DataFrame]:
        """(node, tbl, bucket, bitmap) of the filters that the nodes' files hold, and (node, ksize, sizes): the word size and
        the tables' sizes of each. Files that the tree doesn't name are not read."""
        names = self.nodes.select("pos", F.col("filename").alias("file_"))
        wanted = [f"{self.base}/{r['file_']}" for r in names.collect()]  # names of inner nodes, which the tree file holds in a row
        if not wanted:
            raise ValueError(f"{self.path} names no nodes")
        read = oxli.read_filters(self.spark, wanted).withColumn("file_", F.element_at(F.split("path", "/"), -1)).join(names, "file_")
        sized = read.groupBy(F.col("pos").alias("node")).agg(F.first("ksize").alias("ksize"), F.array_sort(F.collect_list(F.struct("tbl", "size"))).alias("t"))
        return oxli.to_bitmaps(read, "pos"), sized.select("node", "ksize", F.col("t.size").alias("sizes"))


def load_file(spark: SparkSession, base: str, name: str) -> bytes:
    """The bytes of one file of a store."""
    return bytes(spark.read.format("binaryFile").load(f"{base}/{name}").select("content").first()["content"])


def to_json(nodes: DataFrame, leaves: DataFrame, d: int = 2, path: str = ".sbt") -> DataFrame:
    """One row (json): the tree file. nodes: pos, filename, name, metadata map; leaves: pos, filename, name, metadata."""
    def entries(df: DataFrame, kind: str, name: str) -> DataFrame:
        rows = df.select(F.col("pos").cast("string").alias("k"), F.struct("filename", "name", "metadata").cast(kind).alias("v"))
        return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", F.to_json("v").alias("j"))))).alias(name))

    def part(name: str):
        pairs = F.transform(F.map_entries(name), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"]))
        return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))

    both = entries(nodes, _NODE, "n").crossJoin(F.broadcast(entries(leaves, _LEAF, "l")))
    factory = f'{{"class":"{FACTORY[0]}","args":{FACTORY[1]}}}'.replace(" ", "")
    head = f'{{"d":{d},"version":{VERSION},"storage":{{"backend":"{BACKEND}","args":{{"path":"{path}"}}}},"factory":{factory},"nodes":'
    return both.select(F.concat(F.lit(head), part("n"), F.lit(',"leaves":'), part("l"), F.lit("}")).alias("json"))
