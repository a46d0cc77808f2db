"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The n-grams are of five whole code points (``language_model``): every script, letter case and digit is told apart,
and the tables grow with the text. Counts are taken from the whole text of every trusted document and stay sharded
by n-gram; the documents' n-grams get their probabilities by joins with those tables. A document's perplexity is
the exponential of the mean negative log probability of its characters. What is judged is its ``smoothed``
perplexity, that mean drawn towards its language's by ``prior`` characters, so that a short text isn't judged on a
few letters: a document is kept if it has characters and its smoothed perplexity is at most its ``limit``.

Trusted text is split by crc32 of the id: four fifths give counts, one fifth gives each language its own
limit, the ``quantile`` of its smoothed log perplexities plus ``slack`` of the distance between that and their median
(with a slack of 0 the quantile itself). Languages with fewer than ``least`` such documents take the limit of all.

Null and empty texts have no characters: perplexity null, rejected. Very long texts are scored whole, a slice of
about a megabyte at a time where they can be cut between texts; one text must fit in a task. A null language is a
language of its own. Repeated rows are scored alike, and a score equal to the limit is kept. A document of several
labels is trusted if all its quality labels are 1. With no trusted text at all nothing can be judged and every text
that has characters is kept. An empty table gives no rows. Other columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import language_model
from strandline.llm.common import bounded_batches, free_name, join_small, materialise, remove, written


def _judged(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, slack: float = 1.0, prior: float = 64.0, least: int = 50) -> tuple[DataFrame, DataFrame, str]:
    """``docs`` as written, with columns for the blocks and, the third value's name, for row numbers more; and
    (row, doc_id, perplexity, n, smoothed, limit, kept) of each row."""
    spark = bounded_batches(docs).sparkSession
    trusted = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("least")).where("least = 1").select("doc_id")
    known = join_small(docs.select("doc_id", F.col("text").cast("string").alias("text")), trusted, "doc_id", "left_semi")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language_model.train(known.where(~held))
    block, row, text = (free_name(docs, x) for x in ("blockno", "rowno", "string"))
    texts = docs
    if dict(docs.dtypes)["text"] == "string":
        text = "text"
    else:
        texts = docs.withColumn(text, F.col("text").cast("string"))
    blocks, scores = language_model.score(model, texts, text, block, row, {"doc_id": "doc_id", "lang": "cast(lang as string)"})
    before = written(spark)
    scored = materialise(scores, "scored")
    held_out = join_small(scored.where(held & (F.col("n") > 0)).select("doc_id", "lang", "total", "n"), trusted, "doc_id", "left_semi")
    held_out = materialise(held_out.drop("doc_id"), "held-out")
    mean = (F.sum("total") / F.sum("n")).alias("mean")
    overall = held_out.agg(mean).first()["mean"] or 0.0
    means = held_out.groupBy("lang").agg(mean, F.count(F.lit(1)).alias("docs"))
    means = materialise(means.select(F.col("lang").alias("of"), F.when(F.col("docs") >= least, F.col("mean")).otherwise(overall).alias("mean")), "means")
    drawn = lambda m: (F.col("total") + prior * m) / (F.col("n") + prior)
    scores = join_small(held_out, means, F.col("lang").eqNullSafe(F.col("of"))).select("lang", "mean", drawn(F.col("mean")).alias("score"))
    q = lambda p: F.percentile_approx("score", F.lit(p), F.lit(10000))
    limit = (q(quantile) + slack * (q(quantile) - q(0.5))).alias("limit")
    all_limit = scores.agg(limit).first()["limit"]
    tops = scores.groupBy("lang").agg(F.first("mean").alias("mean"), limit, F.count(F.lit(1)).alias("docs"))
    tops = materialise(tops.select(F.col("lang").alias("of"), "mean", F.when(F.col("docs") >= least, F.col("limit")).otherwise(F.lit(all_limit)).alias("top")), "limits")
    joined = join_small(scored, tops, F.col("lang").eqNullSafe(F.col("of")), "left")
    n = F.col("n")
    top = F.coalesce("top", F.lit(float("inf") if all_limit is None else all_limit))
    score = F.when(n > 0, drawn(F.coalesce("mean", F.lit(overall))))
    verdicts = joined.select("row", "doc_id", F.when(n > 0, F.exp(F.col("total") / n)).alias("perplexity"), "n", F.exp(score).alias("smoothed"), F.exp(top).alias("limit"), F.coalesce(score <= top, F.lit(False)).alias("kept"))
    verdicts = materialise(verdicts, "verdicts")
    remove(spark, [x for x in written(spark)[:-1] if x not in before])
    return blocks, verdicts, row


def verdicts(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, perplexity, n, smoothed, limit, kept) of each row; no text is read twice for it but in its block."""
    return _judged(docs, labels, **options)[1].drop("row")


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` with a last column ``quality`` (or, if taken, ``quality_`` and so on) more: struct<perplexity
    double, n long, smoothed double, limit double, kept boolean>.

    docs has doc_id, text and lang; labels has doc_id and quality. See the module for the method."""
    blocks, found, row = _judged(docs, labels, **options)
    out = free_name(docs, "quality")
    verdict = found.select(F.col("row").alias(f"{row}_"), F.struct("perplexity", "n", "smoothed", "limit", "kept").alias(out))
    joined = join_small(blocks, verdict, F.col(row) == F.col(f"{row}_"))
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), out)


def keep_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier keeps, with their own columns."""
    blocks, found, row = _judged(docs, labels, **options)
    rejected = found.where("not kept").select(F.col("row").alias(row))
    return join_small(blocks, rejected, row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
