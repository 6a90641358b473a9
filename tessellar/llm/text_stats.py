"""Statistics of one text, shared by the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np

from .common import BLANKS

SYMBOLS = "#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123)])


def dup_lines(text: str) -> tuple[int, int]:
    """(lines with a word, those of them equal to an earlier line)."""
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines), len(lines) - len(set(lines))


def word_ids(words: list[bytes]) -> tuple[np.ndarray, int]:
    """Words as numbers in order of first use, and how many differ."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    return ids, len(seen)


def repeat_words(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a 3-word window found twice or more, its first place included."""
    n = len(ids)
    if n < 4 or distinct == n:
        return 0
    pairs = ids[:-1] * distinct + ids[1:]
    if distinct < 2_000_000:
        windows = pairs[:-1] * distinct + ids[2:]
    else:  # three numbers no longer fit 63 bits: number the pairs first
        _, pair = np.unique(pairs, return_inverse=True)
        windows = pair[:-1] * distinct + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def n_symbols(text: str) -> int:
    return sum(text.count(c) for c in SYMBOLS)


def word_chars(text: str) -> int:
    """Code points in words."""
    return len(text) - sum(text.count(c) for c in BLANKS)


def upper_share(data: bytes) -> float:
    """Share of A-Z among ASCII letters, which hold at least a fifth of the bytes; else 0."""
    letters = len(data) - len(data.translate(None, _LETTERS))
    return (len(data) - len(data.translate(None, _UPPER))) / letters if letters > len(data) / 5 else 0.0
