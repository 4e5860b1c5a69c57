"""Substring deduplication by Rabin-Karp hashes of every window of words.

Each window of ``width`` consecutive words of a document has a 64-bit rolling hash; how often each occurs over the corpus is
counted by key ranges (``blocks``), pre-summed in each block of documents. The windows that occur twice or more, the same
document included, merge into maximal intervals of words, and these are removed. All windows are judged on the input.

Null and empty texts have no words and lose none. Texts with fewer words than a window lose none. Two different
windows with one 64-bit hash would count as equal: with a billion distinct windows the chance that there is any is 3 %.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from strandlake.llm.blocks import into_blocks, with_totals
from strandlake.llm.hashing import Words
from strandlake.llm.tables import bytes_of, loose

WIDTH = 35


def _covered(words: Words, first: np.ndarray, width: int) -> np.ndarray:
    """Which words the windows that begin at ``first`` cover."""
    step = np.zeros(len(words.starts) + 1, np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, first + width, -1)
    return np.cumsum(step[:-1]) > 0


def _keys(t: pa.Table, width: int) -> tuple[Words, np.ndarray, np.ndarray]:
    words = Words(bytes_of(t["text"]))
    return words, *words.windows(width)


def removals(
    docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, block_bytes: int | None = None, range_keys: int | None = None
) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, spans) of each row; spans: [start, end) word intervals removed.

    ``id_col`` may be a struct of whatever should go with a row. With ``texts`` also ``kept_text``: the text without the removed words and the white space behind each."""

    def keys_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.unique(_keys(t, width)[1], return_counts=True)
        return keys, counts

    def answer(t: pa.Table, keys: np.ndarray, totals: np.ndarray) -> pa.Table:
        words, hashes, first = _keys(t, width)
        repeated = np.zeros(len(hashes), bool)
        twice = keys[totals >= 2]
        if len(twice):
            at = np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)
            repeated = twice[at] == hashes
        gone = _covered(words, first[repeated], width)
        raw = words.buf.tobytes()
        n_removed, digest, spans, kept_text = [], [], [], []
        total = np.append(0, np.cumsum(gone))
        for i, (a, b) in enumerate(zip(words.at[:-1].tolist(), words.at[1:].tolist())):
            begin, end = int(words.text_at[i]), int(words.text_at[i + 1]) - 1
            n = int(total[b] - total[a])
            n_removed.append(n)
            if not n:
                digest.append(hashlib.sha256(b" ".join(raw[begin:end].split())).hexdigest())
                spans.append([])
                if texts:
                    kept_text.append(raw[begin:end].decode())
                continue
            edge = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
            pairs = edge.reshape(-1, 2)
            spans.append(pairs.tolist())
            kept, place = [], begin
            for s, e in pairs.tolist():
                kept.append(raw[place : words.starts[a + s]])
                place = int(words.starts[a + e]) if a + e < b else end
            kept.append(raw[place:end])
            kept_raw = b"".join(kept)
            digest.append(hashlib.sha256(b" ".join(kept_raw.split())).hexdigest())
            if texts:
                kept_text.append(kept_raw.decode())
        columns = {
            "id": t["id"],
            "n_words": pa.array(np.diff(words.at)),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept_sha256": pa.array(digest, pa.string()),
            "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))),
        }
        return pa.table(columns | ({"kept_text": pa.array(kept_text, pa.string())} if texts else {}))

    rows, size = into_blocks(docs, id_col, text_col, block_bytes)
    schema = StructType.fromDDL("n_words long, n_removed long, kept_sha256 string, spans array<array<long>>" + ", kept_text string" * texts)
    schema = StructType([StructField("id", loose(docs.schema[id_col].dataType)), *schema.fields])
    return with_totals(rows, size, keys_of, answer, schema, range_keys).withColumnRenamed("id", id_col)
