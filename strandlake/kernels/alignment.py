"""Global alignments of many pairs of sequences at once."""

from __future__ import annotations

import numpy as np

#: Places a sequence may have: equal places and pairs are counted in 20 bits each of a packed number, the score above them.
MOST = (1 << 20) - 1
_UNIT = 1 << 40


def _letters(x: str) -> np.ndarray:
    return np.frombuffer(x.encode("utf-32-le"), np.int32)


def _group(queries: list[np.ndarray], targets: list[np.ndarray], match: float, mismatch: float, open_: float, extend: float) -> np.ndarray:
    """``align_pairs`` of pairs whose queries have one length and whose targets have one length."""
    m, n, pairs = len(queries[0]), len(targets[0]), len(queries)
    q, t = np.stack(queries), np.stack(targets)
    pack = lambda x: int(round(x * _UNIT))
    step = np.arange(n + 1, dtype=np.int64) * pack(extend)
    none = -(1 << 61)
    both, gap_t, gap_q = (np.full((pairs, n + 1), none, np.int64) for _ in range(3))
    both[:, 0] = 0
    gap_q[:, 1:] = pack(open_) + step[:-1]
    hit, miss = pack(match) + (1 << 20) + 1, pack(mismatch) + 1
    for i in range(m):
        before = np.maximum(np.maximum(both, gap_t), gap_q)
        gap_t = np.maximum(before + pack(open_), gap_t + pack(extend))
        both = np.full((pairs, n + 1), none, np.int64)
        both[:, 1:] = before[:, :-1] + np.where(t == q[:, i : i + 1], hit, miss)
        # a gap in the query that ends at j began behind some k < j: the best of those is a running maximum
        reach = np.maximum.accumulate(np.maximum(both, gap_t) - step, axis=1)
        gap_q = np.full((pairs, n + 1), none, np.int64)
        gap_q[:, 1:] = reach[:, :-1] + step[:-1] + pack(open_)
    return np.maximum(np.maximum(both, gap_t), gap_q)[:, n]


def align_pairs(queries: list[str], targets: list[str], match: float, mismatch: float, open_: float, extend: float, cells: int = 100_000) -> np.ndarray:
    """(score, equal places, places without a gap) of the global alignment with affine gaps of each pair. Of equal scores the one with more equal places counts, then
    the one with more places without a gap.

    States: both letters, a gap in the target, a gap in the query. Cells hold score, equal places and pairs packed into one number, so the best is one maximum.
    Pairs of equal lengths go row by row together, some ``cells`` at a time."""
    if max(map(len, [*queries, *targets]), default=0) > MOST:
        raise ValueError(f"sequences of more than {MOST} letters cannot be aligned")
    known: dict[str, np.ndarray] = {}
    letters = [[known[x] if x in known else known.setdefault(x, _letters(x)) for x in xs] for xs in (queries, targets)]
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (a, b) in enumerate(zip(queries, targets)):
        groups.setdefault((len(a), len(b)), []).append(i)
    out = np.empty(len(queries), np.int64)
    for (_, n), rows in groups.items():
        size = max(1, cells // (n + 1))
        for k in range(0, len(rows), size):
            part = rows[k : k + size]
            out[part] = _group([letters[0][i] for i in part], [letters[1][i] for i in part], match, mismatch, open_, extend)
    low = out & (_UNIT - 1)
    return np.stack([(out - low) / _UNIT, low >> 20, low & MOST], 1)
