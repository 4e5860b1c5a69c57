"""Ranked lexical search of many items over a document table by presence masks.

Documents become blocks of a few megabytes of text, each an inverted index in a row: for each term its documents and how often they hold it.
Counts over the corpus (documents, terms, documents of a term) are sums over blocks. The items, with their terms' weights, are packed
into blocks of bounded size too, and every block of documents meets every block of items in a task. There, for an item, bitmaps of its
terms are turned into one mask of matched terms per document, and documents are grouped by mask. A mask's score is at most the sum of its
terms' weights times their largest impact in the block. Masks are scored from the highest bound down until the bound is below the
item's k-th best score of the task so far (equal ones are still scored: they may have smaller identifiers), so nothing is lost. A task sends its k best
documents per item; a window over these ranks them.

Only terms of items are kept in the index if there are at most ``most_terms`` of them; beyond that the index holds all terms. Item
blocks are broadcast if they are as few, else joined by a shuffle that deals them over all document blocks.

Terms are compared by 64-bit hashes. Null and term-less documents are not counted and match nothing; null and term-less items have no rows.
Rows repeated in the item table are items of their own; repeated documents are ranked one by one. A document without an identifier comes after all
others of its score. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.hashing import span_hashes
from strandlake.llm.tables import bytes_of, map_texts
from strandlake.session import materialize

_NO_ID = np.iinfo(np.int64).max
#: ASCII letters and digits, and every byte of other characters
_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK = "n_docs long, n_terms long, ids binary, sizes binary, terms binary, at binary, docs binary, counts binary"


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each term, ASCII letters lower-cased; the first term of each text, and their number)."""
    buf = _LOWER[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
    edge = np.diff(_IN_TERM[buf].view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text_at = np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1))
    return span_hashes(buf, starts, ends) if len(starts) else np.empty(0, np.uint64), np.searchsorted(starts, text_at)


def index_block(ids: np.ndarray, texts: list[bytes], only: np.ndarray | None) -> tuple:
    """One block's index as the columns of ``_BLOCK``; ``only``: ascending terms to keep."""
    hashes, at = terms_of(texts)
    sizes = np.diff(at)
    doc = np.repeat(np.arange(len(texts)), sizes)
    if only is not None:
        place = np.minimum(np.searchsorted(only, hashes), max(0, len(only) - 1))
        held = only[place] == hashes if len(only) else np.zeros(len(hashes), bool)
        code, terms, doc = place[held], only, doc[held]
    else:
        terms, code = np.unique(hashes, return_inverse=True)
    pair, counts = np.unique(code * len(texts) + doc, return_counts=True)
    term, doc = pair // len(texts), pair % len(texts)
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.empty(0, np.int64)
    return (
        int((sizes > 0).sum()), int(sizes.sum()), ids.tobytes(), sizes.astype("<i8").tobytes(), terms[term[first]].tobytes(),
        np.append(first, len(term)).astype("<i4").tobytes(), doc.astype("<i4").tobytes(), counts.astype("<i8").tobytes(),
    )


def index(docs: DataFrame, id_col: str, text_col: str, only: np.ndarray | None) -> DataFrame:
    """Blocks of documents as inverted indexes."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = b["id"].fill_null(_NO_ID).to_numpy()
        row = index_block(ids, bytes_of(b["text"]), only)
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if isinstance(x, int) else pa.binary()) for x in row], [f.split()[0] for f in _BLOCK.split(", ")])

    return map_texts(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, _BLOCK)


def document_counts(blocks: DataFrame) -> DataFrame:
    """(term, df) over all blocks: a row per block and term, then a sum."""

    def count(batches):
        for b in batches:
            for terms, at in zip(b["terms"].to_pylist(), b["at"].to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, "<i8")), pa.array(np.diff(np.frombuffer(at, "<i4")).astype("<i8"))], ["term", "df"])

    return blocks.select("terms", "at").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Item:
    __slots__ = ("number", "terms", "weights")

    def __init__(self, number: int, terms: np.ndarray, weights: np.ndarray):
        self.number, self.terms, self.weights = number, terms, weights


class Block:
    """A block's index with each posting's impact under the corpus's counts."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.ids, self.terms, self.at = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["terms"], "<u8"), np.frombuffer(row["at"], "<i4").astype(np.int64)
        self.docs, tf, n = np.frombuffer(row["docs"], "<i4"), np.frombuffer(row["counts"], "<i8"), np.frombuffer(row["sizes"], "<i8")
        m = 100 - 50 + 50 * n * n_docs // n_terms
        self.impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[self.docs])
        self.largest = np.maximum.reduceat(self.impact, self.at[:-1]) if len(self.terms) else np.empty(0, np.int64)

    def best(self, item: Item, k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The item's k best (scores, ids) of those given and the block's; and how many documents were scored."""
        place = np.minimum(np.searchsorted(self.terms, item.terms), max(0, len(self.terms) - 1))
        here = self.terms[place] == item.terms if len(self.terms) else np.zeros(len(place), bool)
        place, weight = place[here], item.weights[here]
        if not len(place) or len(scores) >= k and (weight * self.largest[place]).sum() < scores[k - 1]:
            return scores, ids, 0
        size = np.diff(self.at)[place]
        flat = np.repeat(self.at[place] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        term, doc = np.repeat(np.arange(len(place)), size), self.docs[flat]
        score = weight[term] * self.impact[flat]
        # a row of bits per document: the terms it holds
        bits = np.zeros((len(self.ids), len(place)), bool)
        bits[doc, term] = True
        packed = np.packbits(bits, axis=1)
        packed = np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))))
        masks, of = np.unique(packed.view(np.uint64).ravel() if packed.shape[1] == 8 else packed.view(np.dtype((np.void, packed.shape[1]))).ravel(), return_inverse=True)
        one = np.empty(len(masks), np.int64)  # a document of each mask
        one[of] = np.arange(len(of))
        bound = bits[one].astype(np.int64) @ (weight * self.largest[place])
        by = np.argsort(-bound, kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        rank = rank[of]  # of each document's mask
        members = np.cumsum(np.bincount(rank, minlength=len(by)))
        ordered, done, scored, want = bound[by], 0, 0, k
        open_ = len(ordered) if ordered[-1] > 0 else int((ordered > 0).sum())
        while done < open_:
            if len(scores) >= k and ordered[done] < scores[k - 1]:
                break
            stop = min(open_, max(done + 1, int(np.searchsorted(members, scored + want, side="left")) + 1))
            if len(scores) >= k:
                stop = max(done + 1, min(stop, int(np.searchsorted(-ordered, -scores[k - 1], side="right"))))
            some = np.flatnonzero((rank >= done) & (rank < stop))
            mine = np.isin(doc, some, kind="table") if len(some) < len(self.ids) else slice(None)
            # sums of integers below 2**53, exact in doubles
            total = np.bincount(doc[mine], score[mine], minlength=len(self.ids))[some].astype(np.int64)
            some, total = some[total > 0], total[total > 0]
            scores, ids = np.append(scores, total), np.append(ids, self.ids[some])
            top = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[top], ids[top]
            scored, done, want = int(members[stop - 1]), stop, 2 * want
        return scores, ids, scored


def _items(payload: bytes) -> list[Item]:
    numbers, terms, weights = np.frombuffer(payload, "<i8").reshape(3, -1)
    at = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))
    return [Item(int(numbers[a]), terms[a:b].view(np.uint64), weights[a:b]) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(numbers)])] if len(numbers) else []


def _pack_items(weighted: DataFrame, block_terms: int, n: int) -> tuple[DataFrame, int]:
    """(block, items) rows of about ``block_terms`` terms, and their number."""
    n_blocks = max(1, -(-n // block_terms))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("number", "ascending"), ("term", "ascending")])
        return pa.table({"block": t["block"][:1], "items": pa.array([np.stack([t[c].to_numpy() for c in ("number", "term", "weight")]).astype("<i8").tobytes()], pa.binary())})

    return weighted.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(n_blocks)).cast("int")).groupBy("block").applyInArrow(pack, "block int, items binary"), n_blocks


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_terms: int = 2_000_000, block_terms: int = 200_000
) -> DataFrame:
    """(item id, rank, document id, score) of the k best documents of each item with a score above 0; equal scores by identifier."""
    numbered = materialize(items.select(F.monotonically_increasing_id().alias("number"), F.col(item_col).alias("item"), F.col(item_text_col).alias("text")), "items")

    def split(b: pa.RecordBatch) -> pa.RecordBatch:
        hashes, at = terms_of(bytes_of(b["text"]))
        number = np.repeat(b["number"].to_numpy(), np.diff(at))
        both = pd.DataFrame({"number": number, "term": hashes.view(np.int64)}).drop_duplicates()
        return pa.RecordBatch.from_pandas(both, preserve_index=False)

    terms = materialize(map_texts(numbered.select("number", "text"), split, "number long, term long"), "terms")
    distinct, n_terms = terms.select("term").distinct(), terms.count()
    # at most most_terms numbers go through the driver
    only = np.sort(np.array([r.term for r in distinct.collect()], np.int64).view(np.uint64)) if n_terms <= most_terms else None
    blocks = materialize(index(docs, id_col, text_col, only), "index")
    counts = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
    in_all, length = counts["n"], counts["l"]
    weight = F.floor(1000 * F.ln((2.0 * in_all + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighted = terms.join(document_counts(blocks), "term").select("number", "term", weight.alias("weight")).where("weight > 0")
    packed, n_blocks = _pack_items(weighted, block_terms, n_terms)
    rows = blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    if n_terms <= most_terms:
        met = rows.join(F.broadcast(packed), "block")
    else:  # every item block goes to each of the places over which the document blocks are dealt
        salts = max(1, min(blocks.count(), 10_000))
        dealt = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = rows.withColumn("_salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int")).join(dealt.hint("shuffle_merge"), ["block", "_salt"])

    def score(batches):
        known: dict[int, list[Item]] = {}
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        empty = np.empty(0, np.int64)
        for b in batches:
            for row in b.to_pylist():
                if row["block"] not in known:
                    known[row["block"]] = _items(row["items"])
                block = Block(row, in_all, max(1, length))
                for item in known[row["block"]]:
                    scores, ids, _ = block.best(item, k, *best.get(item.number, (empty, empty)))
                    if len(ids):
                        best[item.number] = scores, ids
        at = list(best)
        for a in range(0, len(at), 1000):
            part = at[a : a + 1000]
            n = [len(best[i][1]) for i in part]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(part, np.int64), n)), pa.array(np.concatenate([best[i][1] for i in part])), pa.array(np.concatenate([best[i][0] for i in part]))], ["number", "doc", "score"]
            )

    found = met.mapInArrow(score, "number long, doc long, score long")
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), "doc")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    doc = F.when(F.col("doc") != int(_NO_ID), F.col("doc"))
    return ranked.join(numbered.select("number", "item"), "number").select(F.col("item").alias(item_col), "rank", doc.alias(id_col), "score")
