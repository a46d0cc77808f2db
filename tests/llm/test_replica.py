import hashlib

from pyspark.sql import functions as F

from strandline.llm import warc


def test_a_copy_is_hashed_from_its_own_bytes(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "x" * (i + 5)) for i in range(40)] + [(3, "u3", "other"), (None, None, None), (7, "u7", "x" * 12)], "page_id long, url string, html string")
    recs = warc.records(pages)
    first = warc.place(recs)
    copy = recs.withColumn("written", F.sha2("record", 256))
    assert warc.audit(first, warc.place_copy(first, copy)).count() == 0
    # Damage by page, whatever the hash: a last byte lost, and a record gone.
    hurt = copy.where("page_id is null or page_id <> 9").withColumn("record", F.when(F.col("page_id") == 5, F.expr("substring(record, 1, length(record) - 1)")).otherwise(F.col("record")))
    faults = {r["fault"]: r for r in warc.audit(first, warc.place_copy(first, hurt)).collect()}
    assert set(faults) == {"changed", "missing"}
    whole = bytes(recs.where("page_id = 5").first()["record"])
    assert faults["changed"]["digest"] == hashlib.sha256(whole).hexdigest() and faults["changed"]["found_digest"] == hashlib.sha256(whole[:-1]).hexdigest()
