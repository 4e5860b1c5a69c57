"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the bytes cuts every text where the content says so, so copies share most of their chunks wherever they
differ. Texts are dealt by their smallest chunk hash, which brings texts with shared chunks into one task; AQE splits a
key that many texts share. There each distinct chunk is encoded once, as long as it stays among the latest few thousand, and its ids are reused. A chunk may end inside a
word: at each join the text from the last blank before it to the first blank after it is encoded anew and takes the place of the two chunks' own ids there. Blanks always
part pieces, so that is as far as the two encodings can differ: no wider repair is ever needed, and none is tried.

Null and empty texts have no ids. Repeated rows are encoded row by row, their chunks once.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.bpe import Encoder, Generations, encoder
from strandlake.llm.hashing import mix
from strandlake.llm.tables import bytes_of, map_texts

_GEAR = mix(np.arange(256, dtype=np.uint64)).astype(np.uint32)
MASK, LEAST, MOST = np.uint32(0x7FF << 12), 256, 16384  # a cut each 2048 bytes or so
_FIRST, _LAST = re.compile(rb"[ \n]"), re.compile(rb".*[ \n]", re.S)


def chunks(data: bytes) -> list[bytes]:
    """Content-defined chunks: a cut where a rolling hash of the last 32 bytes has zero bits, never inside a character."""
    if len(data) <= LEAST:
        return [data] if data else []
    b = np.frombuffer(data, np.uint8)
    h = _GEAR[b]
    for k in range(5):  # sums of 2, 4, 8, 16, 32 bytes, the older shifted further
        n = 1 << k
        h[n:] = h[n:] + (h[:-n] << np.uint32(n))
    cut = np.flatnonzero((h[:-1] & MASK == 0) & (b[1:] & 0xC0 != 0x80)) + 1
    out, start = [], 0
    for c in [*cut.tolist(), len(data)]:
        while c - start > MOST:
            end = start + MOST
            while end > start + 1 and data[end] & 0xC0 == 0x80:
                end -= 1
            out.append(data[start:end])
            start = end
        if c - start >= LEAST or c == len(data) and c > start:
            out.append(data[start:c])
            start = c
    return out


def _split(chunk: bytes) -> tuple[bytes, bytes, bytes] | None:
    """(before the first blank, between, behind the last blank); none without a blank."""
    a = _FIRST.search(chunk)
    if a is None:
        return None
    z = _LAST.match(chunk).end()
    return chunk[: a.start()], chunk[a.start() : z], chunk[z:]


class ChunkEncoder:
    """Encodes batches of texts; ids of chunks are kept, bounded, for later batches of the same worker."""

    def __init__(self, enc: Encoder, limit: int = 4000):
        self.enc, self.kept = enc, Generations(limit)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        cut = [chunks(t) for t in texts]
        known: dict[bytes, tuple] = {}
        new = []
        for c in dict.fromkeys(c for cs in cut for c in cs):
            if (v := self.kept.get(c)) is None:
                new.append(c)
            else:
                known[c] = v
        parts = [_split(c) for c in new]
        # a chunk's head, middle and tail are encoded together, each as a text of its own
        flat = [x.decode() for c, p in zip(new, parts) for x in (p or (c, b"", b""))]
        ids = self.enc.encode(flat)
        for i, (c, p) in enumerate(zip(new, parts)):
            known[c] = (p and (p[0], p[2]), *ids[3 * i : 3 * i + 3])
            self.kept.put(c, known[c])
        joins: dict[bytes, int] = {}
        plans = []
        for cs in cut:
            plan: list = []  # arrays of ids, and texts across joins
            open_: list = []  # parts of the text across the current join
            for c in cs:
                ends, head, middle, tail = known[c]
                if ends is None:
                    open_.append((c, head))
                    continue
                open_.append((ends[0], head))
                plan.append(self._join(open_, joins))
                plan.append(middle)
                open_ = [(ends[1], tail)]
            plan.append(self._join(open_, joins))
            plans.append(plan)
        again = self.enc.encode([j.decode() for j in joins])
        return [np.concatenate([again[x] if isinstance(x, int) else x for x in plan]) for plan in plans]

    @staticmethod
    def _join(open_: list, joins: dict[bytes, int]):
        """Ids of the text across a join: as they stand if at most one side has any, else encoded anew."""
        filled = [x for x in open_ if x[0]]
        if len(filled) < 2:
            return filled[0][1] if filled else np.empty(0, "<u4")
        return joins.setdefault(b"".join(x[0] for x in filled), len(joins))


_ENCODERS: dict[str, ChunkEncoder] = {}


def chunk_encoder(tokenizer: str) -> ChunkEncoder:
    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = ChunkEncoder(encoder(tokenizer))
    return _ENCODERS[tokenizer]


def dealt_by_chunks(rows: DataFrame) -> DataFrame:
    """Rows (id, text) with equal smallest chunk hashes side by side."""

    def smallest(b: pa.RecordBatch) -> pa.RecordBatch:
        key = [min((hashlib.blake2b(c, digest_size=7).digest() for c in chunks(t)), default=b"") for t in bytes_of(b["text"])]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array([int.from_bytes(k, "big") for k in key], pa.int64())], [*b.schema.names, "_key"])

    kind = rows.schema["id"].dataType.simpleString()
    return map_texts(rows, smallest, f"id {kind}, text string, _key long").hint("rebalance", "_key").drop("_key")


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, n_tokens, ids, decoded) of each row's whole text; with ``digest`` their SHA-256 instead of the last two."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(tokenizer)
        ids = chunk_encoder(tokenizer).encode(bytes_of(b["text"]))
        n = pa.array([len(x) for x in ids], pa.int64())
        if digest:
            out = [pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in ids])]
        else:
            out = [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([enc.decode(x).decode() for x in ids])]
        return pa.RecordBatch.from_arrays([b["id"], n, *out], ["id", "n_tokens", *names])

    names = ("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = dealt_by_chunks(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    types = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    return map_texts(rows, run, f"id {kind}, n_tokens long, {types}").withColumnRenamed("id", id_col)
