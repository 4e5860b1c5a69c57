"""Token counts by heap-and-linked-list byte-pair merging, without identifiers.

Each distinct piece of a batch is merged once: its adjacent pairs wait in a heap by rank, a linked list joins the
symbols, and the count is the initial symbols minus the merges. The work is one map over the documents: no shuffle,
nothing kept but a bounded cache of counts in each worker.

Null and empty texts count 0. Repeated rows and identifiers are counted row by row; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.bpe import counter
from strandlake.llm.tables import map_texts, texts_of


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row's whole text."""

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        n = counter(tokenizer).count(texts_of(b["text"]))
        return pa.RecordBatch.from_arrays([b["id"], b["n_bytes"], pa.array(n), pa.array(np.greater(n, limit))], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text")
    )
    return map_texts(rows, count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
