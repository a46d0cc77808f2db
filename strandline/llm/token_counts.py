"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts stay in Arrow batches of bounded bytes, and each batch is cut again into runs of about a megabyte, so
that one very long text and a thousand short ones cost alike. Long texts are split at safe boundaries.
Null texts count as empty (0 bytes, 0 tokens); repeated rows are counted each by itself; other columns of
the input, whatever their names, are left out. There is no shuffle.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import bounded_batches, byte_slices, texts_of
from strandline.llm.encoders import encoder


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(``id_col``, n_bytes, n_tokens, over_limit) for each row of ``docs``; over_limit: n_tokens > ``limit``."""
    source = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {source.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long"

    def lengths(batches):
        enc = encoder(tokenizer_path, counts_only=True)
        for batch in byte_slices(batches, "text", 1 << 20):
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(enc.encode(texts_of(batch)), pa.int64())], ["id", "n_bytes", "n_tokens"])

    counted = source.mapInArrow(lengths, schema)
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
