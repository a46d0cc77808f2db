"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document gets a few integer measures, counted over its whole text. For each language and source and each
measure the values go into a quantile sketch: the count of values in each of its bins. Bins are exact up to 32
and then 16 to a power of two, so a quantile is off by a sixteenth at most, a sketch has a few hundred bins at
most, and two sketches merge by adding counts; as that is a plain partial aggregation, a hot source is added
up in every task first. Languages and the whole corpus merge their groups' sketches.

A document fails the base rules if it has under ``least_words`` words or if most of its words stand in
repeated three-word windows. Sketches are of the others. Of these a document fails if a measure lies beyond its
group's thresholds, which come from the sketches alone: where the quartiles differ, the upper one plus ``spread``
times their distance; where they don't, as for repeats that most texts have none of, the value that at most ``tail``
in a thousand exceed. Words may be too short, too: that threshold is the mirror image. A group of n documents has the
mean of its own threshold, counted n times, and its language's, counted ``prior`` times; a language likewise
with the whole corpus. So each group judges by its own sketch as far as it has one. Thresholds are joined to the
measures: broadcast if counted and few, else by a shuffled join that AQE can split at a hot source.

Null texts have no words: all counts are 0, base_failed is true. Null languages and sources are groups of
their own. Repeated rows count as often as they occur. An empty table gives an empty result. Other columns
are not read by the query and pass through ``keep_by_rules`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import free_name, join_small, materialise

SPACES = r"[\x20\x09-\x0D]+"
#: measure: (numerator, denominator, scale)
MEASURES = {
    "symbol_share": ("n_symbols", "n_words", 1000),
    "dup_line_share": ("n_dup_lines", "n_lines", 1000),
    "repeat_share": ("n_repeat_words", "n_words", 1000),
    "word_length": ("word_chars", "n_words", 10),
}
#: The thresholds: the most that each measure may be, and the least that words' length may be.
LEAST = "least_word_length"
LIMITS = (*MEASURES, LEAST)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, name: str, least_words: int = 50) -> DataFrame:
    """``docs`` with a column ``name`` more: a struct of COUNTS, base_failed, and the MEASURES as whole numbers."""
    text, kept = F.coalesce(F.col("text").cast("string"), F.lit("")), [F.col(f"`{c}`") for c in docs.columns]
    at = F.col
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, " \t\n\x0b\x0c\r", "")) > 0)
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    docs = docs.select(*kept, F.struct(words.alias("words"), lines.alias("lines"), symbols.alias("symbols")).alias(name))
    w, n = at(f"{name}.words"), F.size(at(f"{name}.words"))
    windows = F.when(n >= 4, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    counts = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        at(f"{name}.symbols").cast("long").alias("n_symbols"),
        F.size(at(f"{name}.lines")).cast("long").alias("n_lines"),
        (F.size(at(f"{name}.lines")) - F.size(F.array_distinct(at(f"{name}.lines")))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    docs = docs.select(*kept, counts.alias(name))
    # Sorted with their places, equal windows are neighbours. Most texts repeat none and are not sorted.
    windows = at(f"{name}.windows")
    places = F.when(F.size(windows) > F.size(F.array_distinct(windows)), F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    docs = docs.select(*kept, at(name).dropFields("windows").withField("places", places).alias(name))
    places = at(f"{name}.places")
    hash_at = lambda i: F.get(places, i)["h"]
    again = F.filter(places, lambda p, i: p["h"].eqNullSafe(hash_at(i - 1)) | p["h"].eqNullSafe(hash_at(i + 1)))
    covered = F.flatten(F.transform(again, lambda p: F.array(p["i"], p["i"] + 1, p["i"] + 2)))
    docs = docs.select(*kept, at(name).dropFields("places").withField("n_repeat_words", F.size(F.array_distinct(covered)).cast("long")).alias(name))
    get = lambda field: at(f"{name}.{field}")
    base = (get("n_words") < least_words) | (100 * get("n_repeat_words") > 50 * get("n_words"))
    values = [F.when(get(d) > 0, F.floor(get(num) * scale / get(d))).otherwise(F.lit(0)).cast("long").alias(m) for m, (num, d, scale) in MEASURES.items()]
    return docs.select(*kept, F.struct(*(get(c).alias(c) for c in COUNTS), base.alias("base_failed"), *values).alias(name))


def sketches(values: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n): the sketch of each group and measure. values: lang, source and the MEASURES."""
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES)))
    shift = F.expr("greatest(length(bin(v)) - 5, 0)")
    long = values.select("lang", "source", rows.alias("r")).select("lang", "source", "r.measure", "r.v").withColumn("s", shift)
    return long.groupBy("lang", "source", "measure", F.expr("shiftleft(shiftright(v, s), s)").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(some: DataFrame, *by: str) -> DataFrame:
    return some.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))


def fences(some: DataFrame, *by: str, spread: int = 3, tail: int = 5) -> DataFrame:
    """(by, docs, LIMITS) from sketches over ``by`` alone; a sketch's bins are few and bounded."""
    run = Window.partitionBy(*by, "measure").orderBy("bin")
    whole = Window.partitionBy(*by, "measure")
    ranked = some.withColumn("cum", F.sum("n").over(run)).withColumn("all", F.sum("n").over(whole))
    first = lambda condition: F.min(F.when(condition, F.col("bin")))
    per_mille = F.col("cum") * 1000
    marks = ranked.groupBy(*by, "measure").agg(
        F.first("all").alias("all"), first(F.col("cum") * 4 >= F.col("all")).alias("q1"), first(F.col("cum") * 4 >= F.col("all") * 3).alias("q3"),
        first(per_mille >= F.col("all") * (1000 - tail)).alias("high"), first(per_mille > F.col("all") * tail).alias("low"),
    )
    top = lambda c: F.expr(f"{c} + shiftleft(1L, greatest(length(bin({c})) - 5, 0)) - 1")  # the greatest value of its bin
    apart = F.col("q3") > F.col("q1")
    most = F.when(apart, top("q3") + spread * (F.col("q3") - F.col("q1"))).otherwise(top("high"))
    least = F.when(apart, F.greatest(F.col("q1") - spread * (F.col("q3") - F.col("q1")), F.lit(0))).otherwise(F.col("low"))
    of = lambda m, limit: F.max(F.when(F.col("measure") == m, limit))
    return marks.groupBy(*by).agg(F.max("all").alias("docs"), *(of(m, most).alias(m) for m in MEASURES), of("word_length", least).alias(LEAST))


def group_fences(values: DataFrame, prior: int = 50, spread: int = 3, tail: int = 5) -> DataFrame:
    """(lang, source, LIMITS): each group's own thresholds drawn towards its language's, and those to all's."""
    own = materialise(sketches(values), "sketches")
    of_lang = merge_sketches(own, "lang")
    everything = fences(merge_sketches(of_lang), spread=spread, tail=tail).first()
    drawn = lambda m, above: F.floor((F.col("docs") * F.col(m) + prior * above) / (F.col("docs") + prior)).cast("long")
    of_all = lambda m: F.lit(everything[m] if everything else None).cast("long")
    by_lang = fences(of_lang, "lang", spread=spread, tail=tail).select(F.col("lang").alias("l"), *(drawn(m, of_all(m)).alias(f"l_{m}") for m in LIMITS))
    joined = fences(own, "lang", "source", spread=spread, tail=tail).join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left")
    return joined.select("lang", "source", *(drawn(m, F.col(f"l_{m}")).alias(m) for m in LIMITS))


def _judge(table: DataFrame, rules: str, out: str, prior: int, spread: int, tail: int) -> DataFrame:
    """``table`` with the boolean ``out``; ``rules`` names its struct of measures."""
    key = lambda c: F.col(c).cast("string")
    passing = table.where(~F.col(f"{rules}.base_failed"))
    values = passing.select(key("lang").alias("lang"), key("source").alias("source"), *(F.col(f"{rules}.{m}").alias(m) for m in MEASURES))
    limits = group_fences(values, prior, spread, tail).select(F.struct("lang", "source").alias(f"{out}_of"), F.struct(*LIMITS).alias(f"{out}_at"))
    limits = materialise(limits, "fences")
    near = key("lang").eqNullSafe(F.col(f"{out}_of.lang")) & key("source").eqNullSafe(F.col(f"{out}_of.source"))
    joined = join_small(table, limits, near, "left")
    within: Column = ~F.col(f"{rules}.base_failed") & (F.col(f"{rules}.word_length") >= F.col(f"{out}_at.{LEAST}"))
    for m in MEASURES:
        within = within & (F.col(f"{rules}.{m}") <= F.col(f"{out}_at.{m}"))
    return joined.select(*(F.col(f"`{c}`") for c in table.columns), F.coalesce(within, F.lit(False)).alias(out))


def apply_rules(docs: DataFrame, prior: int = 50, spread: int = 3, tail: int = 5, least_words: int = 50) -> DataFrame:
    """(doc_id, COUNTS, base_failed, MEASURES, kept). The measures, without the texts, are written once and read twice."""
    rules = measured(docs.select("doc_id", "lang", "source", "text"), "rules_", least_words)
    written = materialise(rules.select("doc_id", "lang", "source", "rules_"), "rules")
    return _judge(written, "rules_", "kept", prior, spread, tail).select("doc_id", "rules_.*", "kept")


def keep_by_rules(docs: DataFrame, prior: int = 50, spread: int = 3, tail: int = 5, least_words: int = 50) -> DataFrame:
    """The documents that pass, with their own columns. They are written once with their measures and read twice."""
    rules, kept = free_name(docs, "rules"), free_name(docs, "kept")
    written = materialise(measured(docs, rules, least_words), "rules", "zstd")
    return _judge(written, rules, kept, prior, spread, tail).where(F.col(kept)).drop(rules, kept)
