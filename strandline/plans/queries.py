"""One query for each operator, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import sequence
from strandline.functions.hashing import decode_hash, murmur64_column
from strandline.operators import bloom, compare, search, signature, sketch, tree
from strandline.plans import inputs
from strandline.sources import codecs, databases, oxli, sbt, signatures

QUERIES = {}
TABLES = (9973, 9967, 9949, 9941)


def query(f):
    QUERIES[f.__name__] = f
    return f


def _joined(column, name: str):
    return F.array_join(column.cast("array<string>"), ",").alias(name)


def _hash_text(hk) -> F.col:
    return decode_hash(hk).cast("string")


def pairs_of_neighbours(sketches: DataFrame) -> DataFrame:
    """(a, b, x, y): each sketch with that of the next id."""
    left = sketches.select(F.col("id").alias("a"), F.col("sketch").alias("x"))
    right = sketches.select(F.col("id").alias("b"), F.col("sketch").alias("y"))
    return left.join(right, F.col("b") == F.col("a") + 1)


# Scalar functions


@query
def murmur_words(spark: SparkSession, d: str) -> DataFrame:
    words = inputs.table(spark, d, "documents").select(F.explode(inputs.words(F.col("text"))).alias("word")).distinct()
    return words.where("length(word) <= 15").select("word", _hash_text(murmur64_column(F.col("word"))).alias("hash"))


@query
def murmur_long_words(spark: SparkSession, d: str) -> DataFrame:
    """The words that ``murmur_words``, whose SQL hashes 15 bytes at most, leaves out."""
    words = inputs.table(spark, d, "documents").select(F.explode(inputs.words(F.col("text"))).alias("word")).distinct()
    return words.where("length(word) > 15").select("word", _hash_text(murmur64_column(F.col("word"))).alias("hash"))


@query
def murmur_kmers_21(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.dna(spark, d).select("id", F.explode(sequence.sequence_hashes(F.col("seq"), 21)).alias("hk"))
    return rows.groupBy("id", "hk").agg(F.count(F.lit(1)).alias("n")).select("id", _hash_text(F.col("hk")).alias("hash"), "n")


@query
def kmers(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.rough_dna(spark, d).select("id", F.posexplode(sequence.kmers(F.col("seq"), 10)).alias("i", "kmer"))
    return rows.select("id", F.col("i").cast("long").alias("i"), "kmer")


@query
def kmers_canonical(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.dna(spark, d).select(F.explode(sequence.kmers(F.col("seq"), 8)).alias("kmer"))
    return rows.groupBy(sequence.canonical(F.col("kmer")).alias("kmer")).agg(F.count(F.lit(1)).alias("n"))


@query
def revcomp(spark: SparkSession, d: str) -> DataFrame:
    return inputs.rough_dna(spark, d).select("id", sequence.reverse_complement(F.col("seq")).alias("rc"))


@query
def uppercase(spark: SparkSession, d: str) -> DataFrame:
    return inputs.table(spark, d, "documents").select("doc_id", F.md5(sequence.ascii_upper(F.col("text"))).alias("upper_md5"))


@query
def dna_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.rough_dna(spark, d).select("id", F.explode(sequence.kmers(F.col("seq"), 10)).alias("kmer"))
    return rows.groupBy("id").agg(F.count_if(sequence.is_dna(F.col("kmer"))).alias("valid"), F.count_if(~sequence.is_dna(F.col("kmer"))).alias("invalid"))


@query
def translate_six_frame(spark: SparkSession, d: str) -> DataFrame:
    frames = inputs.rough_dna(spark, d).select("id", F.posexplode(sequence.six_frames(F.col("seq"))).alias("frame", "protein"))
    return frames.select("id", F.col("frame").cast("long").alias("frame"), "protein")


@query
def protein_words(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.rough_dna(spark, d).select("id", F.explode(sequence.sequence_hashes(F.col("seq"), 9, is_protein=True)).alias("hk"))
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("words"), F.countDistinct("hk").alias("distinct_words"))


@query
def forced_kmers(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.rough_dna(spark, d).select("id", F.size(sequence.sequence_hashes(F.col("seq"), 10, force=True)).cast("long").alias("n"))
    return rows


@query
def text_frames(spark: SparkSession, d: str) -> DataFrame:
    frames = inputs.rough_text_dna(spark, d).select("id", F.posexplode(sequence.six_frames(F.col("seq"))).alias("frame", "protein"))
    return frames.select("id", F.col("frame").cast("long").alias("frame"), F.length("protein").cast("long").alias("residues"), F.md5("protein").alias("protein_md5"))


@query
def text_kmers(spark: SparkSession, d: str) -> DataFrame:
    seq = F.col("seq")
    rows = inputs.rough_text_dna(spark, d).select("id", sequence.kmers(seq, 21).alias("k"), F.size(sequence.sequence_hashes(seq, 21, force=True)).cast("long").alias("valid"))
    return rows.select("id", F.size("k").cast("long").alias("windows"), "valid", F.md5(F.array_join("k", ",")).alias("kmers_md5"))


# Building sketches


@query
def text_sketch_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Whole sequences hashed, sketched and compared."""
    rows = inputs.text_dna(spark, d).select("id", sequence.sequence_hashes(F.col("seq"), 21, max_hk=(1 << 58) - (1 << 63)).alias("hashes"))
    return compare.scaled_jaccard_pairs(sketch.build_arrays(rows, ["id"], "hashes", num=0, max_hash=1 << 58, ksize=21), threshold=0.2)


@query
def sketch_bottom_n(spark: SparkSession, d: str) -> DataFrame:
    return sketch.exploded(inputs.document_sketches(spark, d)).select("id", "hk")


@query
def sketch_abundance(spark: SparkSession, d: str) -> DataFrame:
    return sketch.exploded(inputs.document_sketches(spark, d, track_abundance=True)).select("id", "hk", "abund")


@query
def sketch_scaled(spark: SparkSession, d: str) -> DataFrame:
    return sketch.exploded(inputs.scaled_sketches(spark, d)).select("id", "hk")


@query
def sketch_dna(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.dna(spark, d).select("id", F.explode(sequence.sequence_hashes(F.col("seq"), 21)).alias("hk"))
    return sketch.exploded(sketch.build(rows, ["id"], num=5, ksize=21)).select("id", _hash_text(F.col("hk")).alias("hash"))


@query
def downsample(spark: SparkSession, d: str) -> DataFrame:
    lower = sketch.downsample(F.col("sketch"), (1 << 63) + (1 << 55))
    return sketch.exploded(inputs.scaled_sketches(spark, d).withColumn("sketch", lower)).select("id", "hk")


@query
def add_many_with_abund(spark: SparkSession, d: str) -> DataFrame:
    lines = inputs.table(spark, d, "lineitem").join(inputs.table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.select(F.col("o_custkey").alias("id"), F.col("l_partkey").alias("hk"), F.col("l_quantity").cast("long").alias("q"))
    return sketch.exploded(sketch.build(rows, ["id"], num=20, track_abundance=True, count="q")).select("id", "hk", "abund")


@query
def merge_sketches(spark: SparkSession, d: str) -> DataFrame:
    docs = inputs.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    some = inputs.document_sketches(spark, d, track_abundance=True).join(docs, "id")
    return sketch.exploded(sketch.merge_all(some, ["lang"], num=inputs.NUM)).select("lang", "hk", "abund")


@query
def merge_neighbours(spark: SparkSession, d: str) -> DataFrame:
    merged = pairs_of_neighbours(inputs.document_sketches(spark, d, track_abundance=True)).withColumn("sketch", sketch.merge_pair(F.col("x"), F.col("y")))
    return sketch.exploded(merged.select("a", "sketch")).select("a", "hk", "abund")


@query
def add_from(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.hashed(inputs.table(spark, d, "documents"), ["lang"])
    target, other = (sketch.build(rows, ["lang"], num=n, track_abundance=True) for n in (40, 80))
    return sketch.exploded(sketch.add_from(target, other, ["lang"], num=60, track_abundance=True)).select("lang", "hk", "abund")


@query
def import_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.table(spark, d, "events").select("event_type", F.col("user_id").cast("decimal(20,0)").alias("hash"))
    counted = rows.groupBy("event_type", "hash").count()
    return sketch.exploded(signatures.from_counts(counted, ["event_type"], 21)).select("event_type", _hash_text(F.col("hk")).alias("hash"), "abund")


@query
def getters(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("sketch")
    some = inputs.document_sketches(spark, d, track_abundance=True)
    return some.select(
        "id", s["num"].alias("num"), s["ksize"].cast("long").alias("ksize"), s["is_protein"].alias("is_protein"), s["seed"].cast("long").alias("seed"), s["max_hash"].cast("long").alias("max_hash"),
        sketch.tracks_abundance(s).alias("tracks"), sketch.size(s).cast("long").alias("size"), sketch.min_at(s, 0).alias("first_min"), sketch.abund_at(s, 0).alias("first_abund"), F.coalesce(sketch.min_at(s, 99), F.lit(-1)).alias("last_min"),
    )


# Comparing


@query
def count_common_pairs(spark: SparkSession, d: str) -> DataFrame:
    return compare.common_pairs(inputs.scaled_sketches(spark, d))


@query
def jaccard_pairs_scaled(spark: SparkSession, d: str) -> DataFrame:
    return compare.scaled_jaccard_pairs(inputs.scaled_sketches(spark, d), threshold=0.05)


@query
def jaccard_pairs_bottom_n(spark: SparkSession, d: str) -> DataFrame:
    return compare.jaccard_pairs(inputs.document_sketches(spark, d), threshold=0.1)


@query
def intersection_neighbours(spark: SparkSession, d: str) -> DataFrame:
    both = pairs_of_neighbours(inputs.document_sketches(spark, d))
    i = compare.intersection(F.col("x"), F.col("y"))
    return both.select("a", F.size(i["common"]).cast("long").alias("common"), i["size"].alias("size"), compare.count_common(F.col("x"), F.col("y")).alias("shared"), compare.jaccard(F.col("x"), F.col("y")).alias("similarity"))


@query
def compatibility(spark: SparkSession, d: str) -> DataFrame:
    nations = inputs.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    k, empty = F.col("id"), F.array().cast("array<bigint>")
    made = sketch.cast_sketch(empty).withField("ksize", F.when(k % 2 == 0, 21).otherwise(31)).withField("is_protein", k % 3 == 0).withField("max_hash", (k % 5).cast("decimal(20,0)")).withField("seed", (k % 7).cast("decimal(20,0)"))
    both = pairs_of_neighbours(nations.withColumn("sketch", made).union(nations.select((k + 100).alias("id"), sketch.cast_sketch(empty).alias("sketch"))))
    return both.select("a", F.coalesce(compare.mismatch(F.col("x"), F.col("y")), F.lit("")).alias("mismatch"), sketch.equal(F.col("x"), F.col("y")).alias("equal"))


@query
def containment_benchmark(spark: SparkSession, d: str) -> DataFrame:
    top = {"num": 0, "max_hash": (1 << 64) - 1}
    return compare.containment_pairs(inputs.benchmark_sketches(spark, d, **top), inputs.document_sketches(spark, d, **top), 0.2)


# Searching


def _named_documents(spark: SparkSession, d: str) -> DataFrame:
    named = inputs.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.concat_ws("-", "lang", "source").alias("name"))
    return inputs.document_sketches(spark, d).join(named, "id")


def _top(spark: SparkSession, d: str, **options) -> DataFrame:
    docs = _named_documents(spark, d)
    return search.top(search.find(docs, inputs.benchmark_sketches(spark, d), 0.01), docs, **options)


@query
def search_topk(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d).select("query", "id", "similarity", "name", F.col("rank").cast("long").alias("rank"))


@query
def search_best_only(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, best_only=True).select("query", "id", "similarity")


@query
def search_report(spark: SparkSession, d: str) -> DataFrame:
    return search.report(_top(spark, d, n=0)).select("query", F.col("rank").cast("long").alias("rank"), "line")


@query
def search_containment(spark: SparkSession, d: str) -> DataFrame:
    return search.find(inputs.benchmark_sketches(spark, d), inputs.document_sketches(spark, d), 0.1, by_containment=True)


@query
def search_databases(spark: SparkSession, d: str) -> DataFrame:
    databases = {"benchmark": inputs.benchmark_sketches(spark, d), "documents": inputs.document_sketches(spark, d)}
    return search.find_in(databases, inputs.benchmark_sketches(spark, d), threshold=0.02).select("db", "query", "id", "similarity")


@query
def linear_vs_tree(spark: SparkSession, d: str) -> DataFrame:
    leaves = inputs.group_tree(spark, d).select("pos", "id", "sketch")
    linear, by_tree = search.find(leaves.select("id", "sketch"), leaves.select("id", "sketch"), 0.005), tree.tree_find(leaves, leaves.select("id", "sketch"), 0.005, TABLES)
    marked = linear.select("query", "id", F.lit(1).alias("l"), F.lit(0).alias("t")).union(by_tree.select("query", "id", F.lit(0).alias("l"), F.lit(1).alias("t")))
    return marked.groupBy("query", "id").agg(F.max("l").cast("long").alias("linear"), F.max("t").cast("long").alias("tree"))


@query
def leaf_overlap(spark: SparkSession, d: str) -> DataFrame:
    groups = inputs.group_sketches(spark, d)
    return tree.leaf_overlap(groups, groups.where("id = 0"))


# Bloom filters


def _filters(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.hashed(inputs.table(spark, d, "documents"), ["lang", "source"]).select(F.concat_ws("-", "lang", "source").alias("node"), "hk")
    return bloom.build(rows, TABLES)


@query
def bloom_build(spark: SparkSession, d: str) -> DataFrame:
    return _filters(spark, d).select("node", F.col("tbl").cast("long").alias("tbl"), F.col("bucket").alias("bucket"), F.bitmap_count("bitmap").alias("bits"))


@query
def bloom_union(spark: SparkSession, d: str) -> DataFrame:
    united = bloom.unite(_filters(spark, d).withColumn("lang", F.split("node", "-")[0]), ("lang",))
    return bloom.occupied(united, ("lang",))


@query
def bloom_occupied(spark: SparkSession, d: str) -> DataFrame:
    return bloom.occupied(_filters(spark, d))


@query
def bloom_unique(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.documents(spark, d).select(F.lit("all").alias("node"), F.struct("id", "hk").alias("pos"), "hk")
    return bloom.unique_hashes(rows, TABLES)


@query
def bloom_membership(spark: SparkSession, d: str) -> DataFrame:
    items = inputs.hashed(inputs.table(spark, d, "benchmark"), ["item_id"])
    return bloom.contains(_filters(spark, d), items, TABLES).groupBy("node").agg(F.count(F.lit(1)).alias("found"))


@query
def bloom_similarity(spark: SparkSession, d: str) -> DataFrame:
    filters = _filters(spark, d).persist()
    return bloom.similarity(filters, filters)


@query
def bloom_containment(spark: SparkSession, d: str) -> DataFrame:
    filters = _filters(spark, d).persist()
    return bloom.containment(filters, filters, TABLES)


@query
def oxli_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    filters = _filters(spark, d)
    files = oxli.to_files(filters, list(TABLES), 3)
    back = files.mapInPandas(_parse_files, "node string, tbl int, bin long")
    return back.groupBy("node", F.col("tbl").cast("long").alias("tbl")).agg(F.count(F.lit(1)).alias("bits"), F.sum("bin").alias("bin_sum"))


def _parse_files(frames):
    import pandas as pd

    for pdf in frames:
        for node, content in zip(pdf["node"], pdf["content"], strict=True):
            for i, b in enumerate(oxli.parse(bytes(content))["bins"]):
                yield pd.DataFrame({"node": node, "tbl": i, "bin": b})


# Signatures


def _signatures(spark: SparkSession, d: str) -> DataFrame:
    """Two sketches a document: the counted one, and its ten smallest hashes as protein words."""
    made = signature.new_signatures(inputs.document_sketches(spark, d, track_abundance=True).withColumn("id", F.col("id").cast("string")), "id")
    first = signature.first_sketch()
    few = first.withField("num", F.lit(10).cast("bigint")).withField("mins", F.slice(first["mins"], 1, 10)).withField("abunds", F.lit(None).cast("array<bigint>"))
    return made.withColumn("signatures", F.array_append("signatures", few.withField("is_protein", F.lit(True)).withField("ksize", F.lit(30))))


@query
def signature_md5(spark: SparkSession, d: str) -> DataFrame:
    return inputs.document_sketches(spark, d).select("id", sketch.md5sum(F.col("sketch")).alias("md5"))


@query
def select_signatures(spark: SparkSession, d: str) -> DataFrame:
    some = signature.select(_signatures(spark, d), 30, "Protein")
    return some.select("name", F.col("sketch_no").cast("long").alias("sketch_no"), sketch.size(F.col("sketch")).cast("long").alias("size"), "license", "version")


@query
def sig_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    text = signatures.to_json(_signatures(spark, d)).select(F.concat(F.lit("["), "json", F.lit("]")).alias("json"))
    back = signature.flatten(signatures.parse(text, "json", verify_md5=True))
    return back.select("name", F.col("sketch.ksize").cast("long").alias("ksize"), sketch.size(F.col("sketch")).cast("long").alias("size"), sketch.md5sum(F.col("sketch")).alias("md5"))


@query
def sig_files_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Signatures through files of every format, each written from what was read from the one before."""
    folder, some, out = inputs.scratch(spark), _signatures(spark, d), None
    for codec in ("none", "gzip", "bzip2", "lzma"):
        signatures.write_signatures(some, f"{folder}/{codec}", codec)
        some = signatures.read_signatures(spark, f"{folder}/{codec}", verify_md5=True)
        part = signature.flatten(some).select(F.lit(codec).alias("codec"), "name", F.col("sketch.ksize").cast("long").alias("ksize"), sketch.size(F.col("sketch")).cast("long").alias("size"), sketch.md5sum(F.col("sketch")).alias("md5"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def index_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """An index of sketches saved, and both of its parts loaded by what selects them."""
    folder = f"{inputs.scratch(spark)}/index"
    databases.save_index(signature.flatten(_signatures(spark, d)).select("name", "sketch"), folder)
    dna, protein = databases.load_index(spark, folder, 21, "DNA"), databases.load_index(spark, folder, 30, "protein")
    both = dna.withColumn("part", F.lit("dna")).unionByName(protein.withColumn("part", F.lit("protein")))
    return both.select("part", "name", F.col("sketch.ksize").cast("long").alias("ksize"), sketch.size(F.col("sketch")).cast("long").alias("size"), sketch.md5sum(F.col("sketch")).alias("md5"))


@query
def signature_json(spark: SparkSession, d: str) -> DataFrame:
    return signatures.to_json(_signatures(spark, d))


@query
def signature_equality(spark: SparkSession, d: str) -> DataFrame:
    s = _signatures(spark, d).select("name", F.struct("class", "email", "hash_function", "filename", "name", "signatures").alias("a"))
    changed = s.withColumn("b", F.col("a").withField("signatures", F.slice("a.signatures", 1, 1))).withColumn("c", F.col("a").withField("email", F.lit("x")))
    return changed.select("name", signature.equal_signatures("a", "b").alias("same_first"), signature.equal_signatures("a", "c").alias("same_email"))


@query
def signature_accessors(spark: SparkSession, d: str) -> DataFrame:
    s = _signatures(spark, d)
    return s.select(signature.get_name().alias("name"), signature.get_filename().alias("filename"), "license", sketch.size(signature.first_sketch()).cast("long").alias("first_size"), F.size(signature.push_sketch(sketch.new_sketch())).cast("long").alias("pushed"), F.size(signature.set_sketch(sketch.new_sketch())).cast("long").alias("set_to"))


@query
def codec_sniff(spark: SparkSession, d: str) -> DataFrame:
    docs = inputs.table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    packed = docs.withColumns({c: codecs.compress(F.col("raw"), c) for c in ("gzip", "bzip2", "lzma", "none")})
    rows = packed.select("doc_id", "raw", F.explode(F.array(*(F.struct(F.lit(c).alias("codec"), F.col(c).alias("packed")) for c in ("gzip", "bzip2", "lzma", "none")))).alias("c"))
    return rows.select("doc_id", "c.codec", codecs.sniff(F.col("c.packed")).alias("sniffed"), (codecs.decompress(F.col("c.packed")) == F.col("raw")).alias("same"))


# Trees


@query
def tree_children(spark: SparkSession, d: str) -> DataFrame:
    pos = inputs.table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("pos"))
    return pos.select("pos", F.coalesce(tree.parent(F.col("pos")), F.lit(-1)).alias("parent"), F.coalesce(tree.parent(F.col("pos"), 10), F.lit(-1)).alias("parent_10"), tree.child(F.col("pos"), 1).alias("right"), _joined(tree.children(F.col("pos"), 3), "children_3"))


@query
def tree_min_n_below(spark: SparkSession, d: str) -> DataFrame:
    return tree.min_n_below(inputs.group_tree(spark, d))


@query
def tree_node_filters(spark: SparkSession, d: str) -> DataFrame:
    return bloom.occupied(tree.node_filters(inputs.group_tree(spark, d), TABLES))


@query
def tree_file_filters(spark: SparkSession, d: str) -> DataFrame:
    """Node filters written as files next to a tree file that names them, and read back through it."""
    folder, leaves = inputs.scratch(spark), inputs.group_tree(spark, d)
    files = oxli.to_files(tree.node_filters(leaves, TABLES), list(TABLES), 21)
    named = [(r["node"], databases.save_file(spark, f"{folder}/.sbt", f"node{r['node']}", bytes(r["content"])).rsplit("/", 1)[-1]) for r in files.toLocalIterator()]
    none = F.lit(None).cast("map<string,bigint>").alias("metadata")
    nodes = spark.createDataFrame(named, "pos long, filename string").select("pos", "filename", F.col("filename").alias("name"), none)
    text = sbt.to_json(nodes, leaves.select("pos", F.col("name").alias("filename"), "name", F.col("name").alias("metadata"))).first()["json"]
    filters, sizes = sbt.TreeFile(spark, databases.save_file(spark, folder, "tree.sbt.json", text.encode())).node_filters()
    return bloom.occupied(filters).join(sizes, "node").select("node", "occupied", "ksize", _joined(F.col("sizes"), "sizes"))


@query
def scaffold_levels(spark: SparkSession, d: str) -> DataFrame:
    return tree.scaffold(inputs.group_sketches(spark, d))


# Streams


@query
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    from strandline.streaming.incremental import hash_stream

    source = inputs.table(spark, d, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/events.parquet*")
    folder = inputs.scratch(spark)
    counts = hash_stream(stream, ["event_type"], "props").writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint")
    running = counts.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/counts")).start()
    running.processAllAvailable()
    running.stop()
    return spark.read.parquet(f"{folder}/counts").groupBy("event_type").agg(F.count(F.lit(1)).alias("distinct_words"), F.sum("cnt").alias("words"))
