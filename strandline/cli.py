"""Command line: ``python -m strandline.cli search QUERY DATABASE...`` and ``scaffold TREE``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import search, tree
from strandline.operators.signature import new_signatures
from strandline.operators.sketch import downsample, max_hash_of
from strandline.sources import databases, signatures


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="strandline")
    commands = parser.add_subparsers(dest="command", required=True)
    s = commands.add_parser("search", help="the signatures of databases most alike to a query")
    s.add_argument("query")
    s.add_argument("databases", nargs="+")
    s.add_argument("-k", "--ksize", type=int, default=0)
    s.add_argument("--moltype", default="dna", help="dna or protein")
    s.add_argument("--threshold", type=float, default=search.DEFAULT_THRESHOLD)
    s.add_argument("-n", "--num-results", type=int, default=search.DEFAULT_TOP, help="0: all")
    s.add_argument("--best-only", action="store_true")
    s.add_argument("--containment", action="store_true")
    s.add_argument("--ignore-abundance", action="store_true", help="accepted; comparisons never use counts")
    s.add_argument("--traverse-directory", action="store_true")
    s.add_argument("--scaled", type=int, help="compare at the threshold that keeps one hash in so many")
    s.add_argument("-o", "--output", help="folder for the finds as CSV")
    s.add_argument("--save-matches", help="folder for the found signatures")
    s.add_argument("-q", "--quiet", action="store_true")
    c = commands.add_parser("scaffold", help="cluster the leaves of a tree file or signature file")
    c.add_argument("database")
    return parser.parse_args(args)


def run_search(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """(db, query, id, similarity, name, filename, md5, rank) of the finds, over all databases together."""
    query = databases.load_query(spark, a.query, a.ksize, a.moltype)
    found = databases.load_databases(spark, a.databases, a.ksize, a.moltype, a.traverse_directory)
    if a.scaled:
        lower = downsample(F.col("sketch"), max_hash_of(a.scaled))
        query, found = query.withColumn("sketch", lower), {k: v.withColumn("sketch", lower) for k, v in found.items()}
    together = None
    for name, one in found.items():
        part = one.withColumn("db", F.lit(name)).withColumn("key", F.concat("db", F.lit("|"), "id"))
        together = part if together is None else together.unionByName(part)
    keyed = together.drop("id").withColumnRenamed("key", "id")
    finds = search.find(keyed.select("id", "sketch"), query, a.threshold, a.containment)
    best = search.top(finds, keyed, a.num_results, a.best_only)
    return best.join(keyed.select("id", "db", "filename", "sketch"), "id")


def main(args: list[str] | None = None) -> int:
    a = arguments(args)
    spark = SparkSession.builder.appName("strandline").getOrCreate()
    if a.command == "scaffold":
        leaves = databases.load_database(spark, a.database).select(F.coalesce("name", "id").alias("id"), "sketch")
        tree.scaffold(leaves).orderBy("pos").show(1000, truncate=False)
        return 0
    best = run_search(spark, a)
    if a.output:
        signatures.matches_csv(best, a.output)
    if a.save_matches:
        signatures.write_signatures(new_signatures(best, "name", F.col("filename")), a.save_matches)
    lines = search.report(best).orderBy("query", "rank").collect()
    if not a.quiet:
        print(f"{len(lines)} matches:\nsimilarity   match\n----------   -----")
        print("\n".join(r["line"] for r in lines))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
