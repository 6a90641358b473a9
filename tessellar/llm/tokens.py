"""Byte-level BPE over the public vocabulary files.

Ids come from one pass of the same merges over the text; a text with a special string goes to the tokenizers library.
Prefix counts come from a dynamic program over the bytes of each distinct pre-token, whose steps a worker remembers
within bounds; a text's steps are those of its pre-tokens side by side, but for runs of blanks, which are one pre-token
for the prefixes that end in them. All of it is linear in the text.
"""

from __future__ import annotations

import json
from array import array
from itertools import accumulate
from operator import sub

import ahocorasick
import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Pre-tokens that a worker remembers in each of two generations, the bytes of their steps together, and the longest.
REMEMBERED, REMEMBERED_BYTES, LONGEST_KNOWN = 400_000, 24 << 20, 256
#: Pairs of tokens that a worker remembers.
PAIRS = 2_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 stands for itself, the rest for 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Remembered(dict):
    """Steps of pre-tokens, bounded in number and bytes: a full generation becomes the old one, and what is asked for
    again moves up. Steps of long pre-tokens are made anew each time."""

    def __init__(self, make):
        super().__init__()
        self.make, self.held, self.old = make, 0, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece) or self.make(piece)
        if len(piece) <= LONGEST_KNOWN:
            if len(self) >= REMEMBERED or self.held > REMEMBERED_BYTES:
                self.old, self.held = dict(self), 0
                self.clear()
            self.held += len(found)
            self[piece] = found
        return found


def after_blanks(steps: bytes, lead: int) -> bytes:
    """Steps of a stretch of text whose first blank has been counted, by ``lead``, as the last of a run."""
    own = np.frombuffer(steps, np.int16)
    rest = own[1:].copy()
    rest[0] += own[0] - lead
    return rest.tobytes()


class ByteBpe:
    """One vocabulary file. slow: the library itself; fast: the same merges for one chunk."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            raw = f.read()
        spec = json.loads(raw)
        self.slow = Tokenizer.from_str(raw)
        self.special = [t["content"] for t in spec["added_tokens"]]
        stand = byte_alphabet()
        added = set(self.special)
        self.ranks = {bytes(stand[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.blanks = regex.compile(r"\s{2,}")
        self._steps = Remembered(self.piece_steps)
        self._pairs: dict[int, bool] = {}
        self.size = 1 + max(self.ranks.values())
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.ending = ahocorasick.Automaton()  # tokens by the place where they end, bytes as Latin-1
        for t, i in self.ranks.items():
            self.ending.add_word(t.decode("latin-1"), (len(t), i))
        self.ending.make_automaton()

    # ids

    def ids(self, text: str) -> np.ndarray:
        """Exactly the library's ids, as uint32. Texts with special strings, and those with runs of blanks that are too
        long for the quick pattern, go to the library."""
        if not self.special_at.search(text):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    # prefix counts

    def _follows(self, pair: int) -> bool:
        """Do the merges leave two tokens (first * size + second) apart when they stand side by side?"""
        if len(self._pairs) > PAIRS:
            self._pairs.clear()
        a, b = divmod(pair, self.size)
        self._pairs[pair] = apart = self.fast._encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return apart

    def piece_counts(self, piece: bytes) -> array:
        """Tokens of every byte prefix of one pre-token. The encoding of a prefix of i bytes ends in the one token t
        that may follow the last token of the prefix of i - len(t) bytes; it has one token more than that prefix."""
        pairs, size = self._pairs, self.size
        last, count = array("i", [-1]), array("i", [0])
        done = 0
        for end, (n, t) in self.ending.iter(piece.decode("latin-1")):
            if end < done:
                continue
            before = end + 1 - n
            if before:
                pair = last[before] * size + t
                apart = pairs.get(pair)
                if apart is None:
                    apart = self._follows(pair)
                if not apart:
                    continue
            last.append(t)
            count.append(count[before] + 1)
            done = end + 1
        return count

    def piece_steps(self, piece: str) -> bytes:
        """Changes of the count over the code points of one pre-token, as int16."""
        if piece[0] == "'" and piece[1:2].isalpha():  # a contraction cut short is two pre-tokens
            counts = [sum(self.piece_counts(x.encode())[-1] for x in self.pattern.findall(piece[:k])) for k in range(len(piece) + 1)]
        else:
            counts = self.piece_counts(piece.encode())
            if not piece.isascii():
                counts = [0, *(counts[k] for k in accumulate(len(c.encode()) for c in piece))]
        return array("h", map(sub, counts[1:], counts)).tobytes()

    def plain_steps(self, text: str) -> bytes:
        """Steps over a text without special strings. Where no blanks stand side by side, a pre-token counts for itself at
        every prefix. A run of blanks is one pre-token while it is the end; what follows it then takes its last blank."""
        steps, pieces = self._steps.__getitem__, self.pattern.findall
        out: list[bytes] = []
        at, lead = 0, None
        for run in self.blanks.finditer(text):
            found = b"".join(map(steps, pieces(text, at, run.start())))
            out += [found if lead is None else after_blanks(found, lead), self.piece_steps(run[0])]
            if run.end() == len(text):
                return b"".join(out)
            at, lead = run.end() - 1, int(np.frombuffer(out[-1], np.int16)[-1])
        found = b"".join(map(steps, pieces(text, at)))
        return b"".join([*out, found if lead is None else after_blanks(found, lead)])

    def steps(self, text: str) -> bytes:
        """Changes of the exact token count over the code points of a text, as int16. A special string is ordinary text
        until its last character, which makes it one token."""
        out: list[bytes] = []
        at = 0
        for m in self.special_at.finditer(text):
            before = self.plain_steps(text[at : m.end() - 1])
            found = np.frombuffer(before, np.int16)
            out += [before, array("h", [1 - int(found[m.start() - at :].sum())]).tobytes()]
            at = m.end()
        return b"".join([*out, self.plain_steps(text[at:])])

    def prefix_counts(self, text: str) -> np.ndarray:
        """Exact tokens of every code-point prefix: n + 1 numbers for n code points, the first 0."""
        return np.concatenate([[0], np.cumsum(np.frombuffer(self.steps(text), np.int16), dtype=np.int64)])


_LOADED: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """Once in a worker's life for each file."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]
