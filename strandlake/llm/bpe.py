"""Token counts and ids under the word-level BPE vocabulary, whole batches of texts at a time.

The vocabulary's normaliser (NFC, white space to one blank, lower case by code point) and its splitting
pattern never join text across white space, so a text's ids are the ids of its pieces, one after another.
Texts made of ASCII and Latin letters are split by vectorised byte classes; each distinct piece (by a 64-bit
hash) is tokenized once and kept in a bounded cache of the worker process. Any other text, and any that holds
a special string, goes through the tokenizer library's own normaliser and splitter.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from functools import lru_cache

import numpy as np
import pandas as pd

from strandlake.llm.hashing import mix, ragged_take, span_hashes

# The two special strings, matched in the raw text before normalisation.
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_SPECIAL_RE = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")
#: Anything but printable ASCII, ASCII white space and Latin letters whose lower case is one letter.
_UNPLAIN = re.compile("[^\\t-\\r -~À-ÖØ-öø-įı-ňŊ-ž]")

_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0, 9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[ord("a") : ord("z") + 1] = _LETTER
_CLASS[0x80:] = _LETTER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_SHORT = np.zeros(256, bool)
_SHORT[[ord(c) for c in "stmd"]] = True


@lru_cache(maxsize=4)
def library(path: str):
    """The tokenizer library's object for ``path``, one per worker process, without padding or truncation."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return tok


@lru_cache(maxsize=4)
def _word_splitter(path: str):
    """The library's splitter without its byte mapping."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    spec = json.loads(library(path).to_str())["pre_tokenizer"]["pretokenizers"][0]
    return Split(Regex(spec["pattern"]["Regex"]), behavior=spec["behavior"].lower(), invert=spec["invert"])


def is_plain(text: str) -> bool:
    return _UNPLAIN.search(text) is None and not ("<|" in text and _SPECIAL_RE.search(text))


def plain_pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, piece starts, piece ends, first piece of each text and the total) of plain texts."""
    buf = np.frombuffer(("\0".join(texts) + "\0").lower().encode(), np.uint8)
    kind = _CLASS[buf]
    first = np.empty(len(buf), bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first |= kind == _DIGIT
    # 's 't 'm 'd 're 've 'll: a lone apostrophe takes these letters from the word behind it
    quote = np.flatnonzero(buf[:-2] == 39)
    quote = quote[first[quote] & (kind[quote + 1] == _LETTER)]
    if len(quote):
        a, b = buf[quote + 1], buf[quote + 2]
        one, two = _SHORT[a], ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        first[quote[one | two] + 1] = False
        for cut in (quote[one] + 2, quote[two & ~one] + 3):
            first[cut[kind[cut] == _LETTER]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(buf))
    word = kind[starts] != _SPACE
    starts, ends = starts[word], ends[word]
    bounds = np.searchsorted(starts, np.append(-1, np.flatnonzero(buf == 0)))
    return buf, starts, ends, bounds


@lru_cache(maxsize=1)
def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [hidden.get(b, chr(b)) for b in range(256)]


class MergeTable:
    """Ranks of adjacent pairs, and the heap-and-linked-list merge over one piece."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.inner = [vocab[c] for c in byte_alphabet()]
        self.last = [vocab[c + suffix] for c in byte_alphabet()]
        self.pairs = {
            (vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])
        }

    def merges(self, raw: bytes) -> tuple[int, int]:
        """(initial symbols, merges done): pop the lowest-ranked adjacent pair until none is left."""
        n = len(raw)
        if n < 2:
            return n, 0
        inner, pairs = self.inner, self.pairs
        sym = [inner[b] for b in raw]
        sym[-1] = self.last[raw[-1]]
        heap = [(p[0], i, p[1]) for i in range(n - 1) if (p := pairs.get((sym[i], sym[i + 1])))]
        heapq.heapify(heap)
        after, before, done = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i]
            if sym[i] < 0 or j >= n or (p := pairs.get((sym[i], sym[j]))) is None or p[0] != rank:
                continue  # one side was merged meanwhile
            sym[i], sym[j] = new, -1
            after[i] = k = after[j]
            done += 1
            if k < n:
                before[k] = i
                if p := pairs.get((new, sym[k])):
                    heapq.heappush(heap, (p[0], i, p[1]))
            if (h := before[i]) >= 0 and (p := pairs.get((sym[h], new))):
                heapq.heappush(heap, (p[0], h, p[1]))
        return n, done


class Generations:
    """A bounded dictionary: entries not asked for since the last turnover are dropped at the next."""

    def __init__(self, limit: int):
        self.young: dict = {}
        self.old: dict = {}
        self.limit = limit

    def get(self, key):
        if (v := self.young.get(key)) is None and (v := self.old.get(key)) is not None:
            self.put(key, v)
        return v

    def put(self, key, value) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value


def _distinct(texts: list[str]):
    """Distinct pieces of plain texts: (bytes, starts, ends, hashes, piece -> distinct piece, bounds)."""
    buf, starts, ends, bounds = plain_pieces(texts)
    of, hashes = pd.factorize(span_hashes(buf, starts, ends))
    at = np.empty(len(hashes), np.int64)
    at[of[::-1]] = np.arange(len(of))[::-1]  # the first place of each
    return buf, starts[at], ends[at], hashes, of, bounds


class Counter:
    """Tokens of whole texts by merging alone; no identifiers are made."""

    def __init__(self, path: str, limit: int = 400_000):
        self.path, self.table, self.seen = path, MergeTable(path), Generations(limit)

    def plain(self, texts: list[str]) -> np.ndarray:
        buf, starts, ends, hashes, of, bounds = _distinct(texts)
        raw, n = buf.tobytes(), np.empty(len(hashes), np.int64)
        for i, (h, s, e) in enumerate(zip(hashes.tolist(), starts.tolist(), ends.tolist())):
            if (c := self.seen.get(h)) is None:
                symbols, merges = self.table.merges(raw[s:e])
                c = symbols - merges
                self.seen.put(h, c)
            n[i] = c
        total = np.append(0, np.cumsum(n[of]))
        return total[bounds[1:]] - total[bounds[:-1]]

    def other(self, text: str) -> int:
        tok, split, n = library(self.path), _word_splitter(self.path), 0
        for s in _SPECIAL_RE.split(text):
            if s in SPECIAL:
                n += 1
            elif s:
                for piece, _ in split.pre_tokenize_str(tok.normalizer.normalize_str(s)):
                    symbols, merges = self.table.merges(piece.encode())
                    n += symbols - merges
        return n

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text (no null among them)."""
        plain = np.fromiter(map(is_plain, texts), bool, len(texts))
        out = np.zeros(len(texts), np.int64)
        if plain.any():
            out[plain] = self.plain([t for t, p in zip(texts, plain) if p])
        for i in np.flatnonzero(~plain):
            out[i] = self.other(texts[i])
        return out


class Encoder:
    """Ids of whole texts, equal to the tokenizer library's without added special tokens."""

    def __init__(self, path: str, limit: int = 400_000):
        self.path, self.tok, self.seen = path, library(path), Generations(limit)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        names = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            names[i] = token.encode() + b" "
        self.names = np.frombuffer(b"".join(names), np.uint8)
        self.name_at = np.append(0, np.cumsum([len(x) for x in names]))

    def _learn(self, hashes: list[int], pieces: list[bytes]) -> None:
        """One library call for many new pieces: blanks keep them apart, word numbers tell them apart."""
        for k in range(0, len(pieces), 5000):
            part = pieces[k : k + 5000]
            e = self.tok.encode(b" ".join(part).decode(), add_special_tokens=False)
            word = np.array(e.word_ids)
            ids = np.array(e.ids, "<u4")
            at = np.searchsorted(word, np.arange(len(part) + 1))
            for h, a, b in zip(hashes[k : k + 5000], at[:-1].tolist(), at[1:].tolist()):
                self.seen.put(h, ids[a:b].tobytes())

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        buf, starts, ends, hashes, of, bounds = _distinct(texts)
        raw, keys, known = buf.tobytes(), hashes.tolist(), []
        for i in range(0, len(keys), 100_000):  # fewer than the cache holds
            part = [self.seen.get(h) for h in keys[i : i + 100_000]]
            new = [j for j, v in enumerate(part) if v is None]
            if new:
                where = [i + j for j in new]
                self._learn([keys[w] for w in where], [raw[starts[w] : ends[w]] for w in where])
                for j, w in zip(new, where):
                    part[j] = self.seen.get(keys[w])
            known += part
        flat = np.frombuffer(b"".join(known), "<u4")
        at = np.append(0, np.cumsum(np.fromiter(map(len, known), np.int64, len(known)) // 4))
        ids, ends_of = ragged_take(flat, at, of)
        return ids, ends_of[bounds]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text (no null among them) as little-endian 32-bit arrays."""
        plain = [i for i, t in enumerate(texts) if is_plain(t)]
        out: list = [None] * len(texts)
        if plain:
            ids, at = self.plain([texts[i] for i in plain])
            for k, i in enumerate(plain):
                out[i] = ids[at[k] : at[k + 1]]
        for i, v in enumerate(out):
            if v is None:
                out[i] = np.array(self.tok.encode(texts[i], add_special_tokens=False).ids, "<u4")
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The vocabulary names no decoder: its tokens joined by blanks, in UTF-8."""
        return ragged_take(self.names, self.name_at, ids)[0][:-1].tobytes()


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
