"""SentencePiece encoding that keeps original byte spans, and decoding.

A model's normaliser is a compiled character map: a double-array trie of prefixes and their replacements. At each place the
longest prefix in it is replaced, all else is copied, and every byte of the normalised text keeps the byte of the original
that it came from. The normalised text is cut where no piece of the vocabulary can reach across (before blanks, and beside bytes
that stand in no longer piece); each distinct segment of a batch is merged once, best pair first, and kept in a bounded cache
of the worker. Pieces then get their place in the normalised text from running sums of lengths, and the kept alignment
projects it to a byte span of the original. A character without a piece becomes its bytes: the last of them spans it, the
others are empty.

The work is one map over the documents; nothing is shuffled. Null and empty texts have the begin and end ids only. Repeated
rows are encoded row by row; other columns are not read. Very long texts are encoded in parts of a few megabytes.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.bpe import Generations
from strandlake.llm.hashing import ragged_take, span_hashes
from strandlake.llm.tables import map_texts, texts_of

SPACE = "▁"
# Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: texts longer than this are encoded in parts
PART_BYTES = 2_000_000
#: segments of up to so many characters are merged side by side
AT_ONCE = 48
codecs.register_error("byte_by_byte", lambda e: ("�" * (e.end - e.start), e.end))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
            yield key >> 3, data[at : at + size]
            at += size


def character_map(blob: bytes) -> dict[str, str]:
    """Prefix -> replacement of a compiled character map: all keys of its double-array trie, level by level."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units, strings = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size :]
    offset = (units >> 10) << ((units & 512) >> 6)
    label, leaf = units & 0x800000FF, (units >> 8 & 1).astype(bool)
    letters = np.arange(1, 256)
    nodes, keys, out = np.array([offset[0]]), [b""], {}
    while len(nodes):
        to = nodes[:, None] ^ letters
        ok = to < len(units)
        ok[ok] = label[to[ok]] == np.broadcast_to(letters, to.shape)[ok]
        row, col = np.nonzero(ok)
        at = to[row, col]
        keys = [keys[r] + bytes((int(letters[c]),)) for r, c in zip(row.tolist(), col.tolist())]
        nodes = at ^ offset[at]
        for k, n, is_leaf in zip(keys, nodes.tolist(), leaf[at].tolist()):
            if is_leaf:
                start = int(units[n]) & 0x7FFFFFFF
                out[k.decode()] = strings[start : strings.index(b"\0", start)].decode()
    return out


class Model:
    """Pieces and normaliser of a model file with byte fallback."""

    def __init__(self, data: bytes):
        parts: dict[int, list] = {1: [], 2: [], 3: []}
        for number, value in _fields(data):
            if number in parts:
                parts[number].append(dict(_fields(value)))
        trainer, norm = (parts[2] or [{}])[0], (parts[3] or [{}])[0]
        kinds = [p.get(3, NORMAL) for p in parts[1]]
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or USER in kinds or UNUSED in kinds:
            raise ValueError("only byte-pair models with byte fallback and a blank before words are supported, without own symbols")
        self.names = [p[1].decode() for p in parts[1]]
        self.unknown, self.begin, self.end = trainer.get(40, 0), trainer.get(41, 1), trainer.get(42, 2)
        self.prefix, self.squeeze = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        if not norm.get(5, 1):
            raise ValueError("only models that escape blanks are supported")
        self.rules = character_map(norm.get(2, b""))
        self.rank: dict[str, tuple[float, int]] = {}
        self.byte = [0] * 256
        surface = []
        for i, (p, kind, name) in enumerate(zip(parts[1], kinds, self.names)):
            if kind == NORMAL:
                self.rank[name] = (-struct.unpack("<f", p[2])[0] if 2 in p else 0.0, i)
                surface.append(name.replace(SPACE, " ").encode())
            elif kind == BYTE:
                self.byte[int(name[3:5], 16)] = i
                surface.append(bytes((int(name[3:5], 16),)))
            else:
                surface.append(" ⁇ ".encode() if kind == UNKNOWN else b"")
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_at = np.append(0, np.cumsum([len(x) for x in surface]))
        longer = [n for n in self.rank if len(n) > 1]
        inside = set("".join(longer))
        scores = sorted({r[0] for r in self.rank.values()})
        #: the pairs of pieces that make a piece
        self.pairs = self._pairs({x: k for k, x in enumerate(scores)})
        self.size = np.diff(self.surface_at)
        self.lead = np.zeros(len(self.names), np.int64)  # bytes of the character that a byte piece begins
        for b, i in enumerate(self.byte):
            self.size[i] = 0
            self.lead[i] = 1 if b < 0x80 else 2 if 0xC0 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if b >= 0xF0 else 0
        #: bytes that no longer piece holds stand alone
        self.alone = np.array([b < 128 and b != 32 and chr(b) not in inside for b in range(256)])
        #: no piece has a blank behind another character
        self.cuts = not any(SPACE in n.lstrip(SPACE) for n in longer)


    def _pairs(self, order: dict[float, int]) -> tuple[np.ndarray, ...]:
        """(keys of pairs, ascending, rank and piece that each makes; piece of each character). Equal scores are one rank."""
        found = {}
        letter = np.full(0x110000, -1, np.int32)
        for name, (score, i) in self.rank.items():
            if len(name) == 1:
                letter[ord(name)] = i
            for k in range(1, len(name)):
                if (a := self.rank.get(name[:k])) and (b := self.rank.get(name[k:])):
                    found[a[1] * len(self.names) + b[1]] = order[score], i
        keys = np.array(sorted(found), np.int64)
        made = np.array([*(found[k] for k in keys.tolist()), (len(order), -1)], np.int64)  # the last is no pair
        return keys, made[:, 0], made[:, 1], letter

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the normalised text that each piece spans: of the bytes of a character, the last spans it."""
        out = self.size[ids]
        lead = self.lead[ids]
        at = np.flatnonzero(lead)
        out[at + lead[at] - 1] = lead[at]
        return out


class Normaliser:
    """Longest-prefix replacement with the place that every byte came from. Blanks stand for the escaped blank."""

    def __init__(self, model: Model):
        self.model, self.rules = model, model.rules
        self.lengths: dict[str, list[int]] = {}
        for k in self.rules:
            self.lengths.setdefault(k[0], []).append(len(k))
        for v in self.lengths.values():
            v.sort(reverse=True)
        self.first = re.compile("[" + "".join(map(re.escape, sorted(self.lengths))) + "]") if self.rules else None

    def edits(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, replacement) of the longest prefixes in the map, from left to right."""
        out, at = [], 0
        while self.first and (m := self.first.search(text, at)):
            i = m.start()
            for n in self.lengths[text[i]]:
                if (new := self.rules.get(text[i : i + n])) is not None:
                    out.append((i, i + n, new))
                    at = i + n
                    break
            else:
                at = i + 1
        return out

    def apply(self, text: str) -> tuple[bytes, np.ndarray | None]:
        """(normalised text, byte of the original for each of its bytes and for its end); None: all bytes as they are, behind the blank put before."""
        if not text:
            return b"", np.zeros(1, np.int64)
        model = self.model
        edits = self.edits(text)
        if not edits and SPACE not in text and not model.squeeze and model.prefix:
            return b" " + text.encode(), None
        out, came, own = [], [], []  # pieces of the new text, where their bytes came from, and which are escaped blanks of the text itself
        done = place = 0
        for start, end, new in [*edits, (len(text), len(text), "")]:
            raw = text[done:start].encode()
            keep, mark = np.arange(place, place + len(raw)), np.zeros(len(raw), bool)
            place += len(raw)
            if SPACE in text[done:start]:
                for m in re.finditer(SPACE.encode(), raw):
                    mark[m.start()] = True
                heads = np.flatnonzero(mark)
                stay = np.ones(len(raw), bool)
                stay[heads + 1] = stay[heads + 2] = False
                raw, keep, mark = raw.replace(SPACE.encode(), b" "), keep[stay], mark[stay]
            fresh = new.replace(SPACE, " ").encode()
            out += [raw, fresh]
            came += [keep, np.full(len(fresh), place)]
            own += [mark, np.zeros(len(fresh), bool)]
            place += len(text[start:end].encode())
            done = end
        flat, at, close = np.frombuffer(b"".join(out), np.uint8), np.concatenate(came), place
        if model.squeeze:  # blanks at both ends go, and all but the first of several; an escaped blank of the text goes at the end only
            blank = (flat == 32) & ~np.concatenate(own)
            kept = np.flatnonzero(~(blank & np.append(True, blank[:-1])))
            if not len(kept):
                return b"", np.zeros(1, np.int64)
            head = at[kept[0]]
            while len(kept) and flat[kept[-1]] == 32:
                close, kept = int(at[kept[-1]]), kept[:-1]
            if not len(kept):
                return b"", np.array([close])
            flat, at = flat[kept], at[kept]
        if model.prefix:
            flat, at = np.append(np.uint8(32), flat), np.append(head if model.squeeze else 0, at)
        return flat.tobytes(), np.append(at, close)


class PieceEncoder:
    """Encodes batches of texts under one model."""

    def __init__(self, data: bytes, limit: int = 300_000):
        self.model = Model(data)
        self.norm, self.seen = Normaliser(self.model), Generations(limit)

    def merge(self, segment: bytes) -> bytes:
        """Ids of a segment: the pair of the best piece is joined first, of equals the leftmost."""
        rank = self.model.rank
        sym: list = list(segment.decode().replace(" ", SPACE))
        n = len(sym)
        heap = [(r[0], i, pair) for i in range(n - 1) if (r := rank.get(pair := sym[i] + sym[i + 1]))]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if sym[i] is None or j >= n or len(sym[i]) + len(sym[j]) != len(pair):
                continue  # a side was joined meanwhile
            sym[i], sym[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := rank.get(new := pair + sym[k]):
                    heapq.heappush(heap, (r[0], i, new))
            if (h := before[i]) >= 0 and (r := rank.get(new := sym[h] + pair)):
                heapq.heappush(heap, (r[0], h, new))
        ids: list[int] = []
        for s in sym:
            if s is not None:
                ids += [r[1]] if (r := rank.get(s)) else [self.model.byte[b] for b in s.encode()]
        return np.array(ids, "<u4").tobytes()

    def merge_all(self, segments: list[bytes]) -> list[bytes]:
        """``merge`` of each segment; short ones at once, one pair of every segment a round."""
        out: list = [None] * len(segments)
        texts = [s.decode() for s in segments]
        short = [i for i, t in enumerate(texts) if len(t) <= AT_ONCE]
        if short and len(self.model.pairs[0]):
            keys, ranks, piece, letter = self.model.pairs
            sym = letter[np.frombuffer("".join(texts[i] for i in short).replace(" ", SPACE).encode("utf-32-le"), "<u4")].astype(np.int64)
            n = np.array([len(texts[i]) for i in short])
            seg = np.repeat(np.arange(len(short)), n)
            odd = np.zeros(len(short), bool)
            odd[seg[sym < 0]] = True
            seg, sym = seg[~odd[seg]], sym[~odd[seg]]  # a character without a piece: the other way
            base, none = len(self.model.names), len(keys)

            def pair_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                key = a * base + b
                k = np.minimum(np.searchsorted(keys, key), none - 1)
                return np.where(keys[k] == key, k, none)

            pair = np.full(len(sym), none)  # that each symbol begins
            inner = np.flatnonzero(seg[1:] == seg[:-1])
            pair[inner] = pair_of(sym[inner], sym[inner + 1])
            while len(seg):
                first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
                best = ranks[pair]
                least = np.minimum.reduceat(best, first)
                if (done := least == ranks[none]).any():
                    gone = np.repeat(done, np.diff(np.append(first, len(seg))))
                    flat, of = sym[gone].astype("<u4"), seg[gone]
                    at = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of)).tolist()
                    raw = flat.tobytes()
                    for k, a, b in zip(of[at[:-1]].tolist(), at[:-1], at[1:]):
                        out[short[k]] = raw[4 * a : 4 * b]
                    sym, seg, pair, best, least = sym[~gone], seg[~gone], pair[~gone], best[~gone], least[~done]
                    if not len(seg):
                        break
                    first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
                hit = np.flatnonzero(best == np.repeat(least, np.diff(np.append(first, len(seg)))))
                hit = hit[np.append(True, seg[hit[1:]] != seg[hit[:-1]])]  # the leftmost of each segment
                sym[hit] = piece[pair[hit]]
                keep = np.ones(len(sym), bool)
                keep[hit + 1] = False
                sym, seg, pair = sym[keep], seg[keep], pair[keep]
                hit -= np.arange(len(hit))
                for left in (hit, hit[hit > 0] - 1):
                    pair[left] = none
                    left = left[left + 1 < len(seg)]
                    left = left[seg[left] == seg[left + 1]]
                    pair[left] = pair_of(sym[left], sym[left + 1])
        return [self.merge(s) if x is None else x for s, x in zip(segments, out)]

    def _parts(self, norm: bytes) -> list[bytes]:
        """Parts of bounded size that may be encoded each by itself."""
        out, start = [], 0
        while self.model.cuts and len(norm) - start > PART_BYTES and (m := re.compile(rb"[^ ] ").search(norm, start + PART_BYTES)):
            out.append(norm[start : m.start() + 1])
            start = m.start() + 1
        return [*out, norm[start:]]

    def _pieces(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, lengths, first piece of each part and the total) of normalised texts."""
        buf = np.frombuffer(b"".join(parts), np.uint8)
        at = np.append(0, np.cumsum([len(x) for x in parts]))
        if not len(buf):
            return np.empty(0, "<u4"), np.empty(0, np.int64), np.zeros(len(at), np.int64)
        first = np.zeros(len(buf) + 1, bool)
        first[at] = True
        alone = self.model.alone[buf]
        first[:-1] |= alone
        first[1:] |= alone
        if self.model.cuts:
            blank = buf == 32
            first[1:-1] |= blank[1:] & ~blank[:-1]
        cut = np.flatnonzero(first)
        starts, ends = cut[:-1], cut[1:]
        of, hashes = pd.factorize(span_hashes(buf, starts, ends))
        where = np.empty(len(hashes), np.int64)
        where[of[::-1]] = np.arange(len(of))[::-1]
        raw, names = buf.tobytes(), hashes.tolist()
        known = [self.seen.get(h) for h in names]
        new = [i for i, v in enumerate(known) if v is None]
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            for i, v in zip(part, self.merge_all([raw[starts[w] : ends[w]] for w in where[part].tolist()])):
                known[i] = v
                self.seen.put(names[i], v)
        n_at = np.append(0, np.cumsum(np.fromiter(map(len, known), np.int64, len(known)) // 4))
        ids, ends_of = ragged_take(np.frombuffer(b"".join(known), "<u4"), n_at, of)
        return ids, self.model.sizes(ids), ends_of[np.searchsorted(starts, at)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids without begin and end, span starts, span ends in bytes of the original) of each text (no null among them)."""
        normal = [self.norm.apply(t) for t in texts]
        parts = [self._parts(n) for n, _ in normal]
        flat = [p for ps in parts for p in ps]
        ids, sizes, at = self._pieces(flat)
        out, k = [], 0
        for (norm, came), ps in zip(normal, parts):
            a, b = at[k], at[k + len(ps)]
            k += len(ps)
            end = np.cumsum(sizes[a:b])
            start = end - sizes[a:b]
            if came is None:
                start, end = np.maximum(start - 1, 0), np.maximum(end - 1, 0)
            else:
                start, end = came[start], came[end]
            out.append((ids[a:b], start, end))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: control ids have none, the blank before the text goes, and a byte that is no part of a character is a replacement character."""
        model, out = self.model, []
        for part in np.split(ids, np.flatnonzero(model.surface_at[ids] == model.surface_at[ids + 1])):  # bytes do not join across a control id
            raw = ragged_take(model.surface, model.surface_at, part)[0].tobytes()
            if raw and not out and model.prefix and self._starts_blank(part):
                raw = raw.lstrip(b" ") if model.squeeze else raw[1:]
                out.append("")
            if raw:
                out.append(raw.decode(errors="byte_by_byte"))
        return "".join(out)

    def _starts_blank(self, ids: np.ndarray) -> bool:
        shown = next((i for i in ids.tolist() if self.model.surface_at[i] < self.model.surface_at[i + 1]), None)
        return shown is not None and self.model.names[shown].startswith(SPACE)


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    with open(path, "rb") as f:
        return PieceEncoder(f.read())


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, n_tokens, ids, starts, ends, decoded) of each row's whole text, begin and end ids with empty spans included; with ``digest``
    (id, n_tokens, ids_sha256, decoded_sha256, spans_crc32): SHA-256 of ids and decoded text, and the checksum of all starts, then ends, as
    little-endian 64-bit integers."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = piece_encoder(model)
        rows = []
        for ids, start, end in enc.encode(texts_of(b["text"])):
            ids = np.concatenate([[enc.model.begin], ids, [enc.model.end]]).astype("<u4")
            last = end[-1:] if len(end) else [0]
            start, end = np.concatenate([[0], start, last]).astype("<i8"), np.concatenate([[0], end, last]).astype("<i8")
            text = enc.decode(ids)
            if digest:
                rows.append((len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), zlib.crc32(end, zlib.crc32(start))))
            else:
                rows.append((len(ids), ids.astype(np.int32), start, end, text))
        return pa.RecordBatch.from_arrays([b["id"], *(pa.array(c, t) for c, t in zip(zip(*rows), types))], ["id", *names])

    if digest:
        names, types = ["n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"], [pa.int64(), pa.string(), pa.string(), pa.int64()]
        declared = "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"
    else:
        names, types = ["n_tokens", "ids", "starts", "ends", "decoded"], [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
        declared = "n_tokens long, ids array<int>, starts array<long>, ends array<long>, decoded string"
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_texts(rows, run, f"id {kind}, {declared}").withColumnRenamed("id", id_col)
