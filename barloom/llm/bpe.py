"""Byte-pair encoding by prefix dynamic programming.

For each byte prefix of a piece there is one token that can be the last of its encoding: the one whose neighbour before
it, the last token of the shorter prefix, doesn't merge with it otherwise. The table of last tokens gives the encoding
backwards, lets text be appended without encoding the start again, and shows from where an edit matters.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import regex

#: The public split pattern of byte_bpe_50k.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: Bytes of words and their ids that one cache of a worker keeps before it starts anew, and of a word worth keeping at all.
CACHE, WORD = 48 << 20, 200


class Vocabulary:
    """Ranks of a tiktoken file, and which pairs of tokens may stand side by side."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self._pairs: dict[tuple[int, int], bool] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The definition: merge the pair of lowest rank, leftmost first, until no pair has a rank."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def stable(self, a: int, b: int) -> bool:
        """Whether the two tokens' bytes together are encoded as just these two."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) > 1_000_000:
                self._pairs.clear()
            known = self._pairs[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known


class Prefixes:
    """The last token of each byte prefix of one piece; ``add`` appends bytes, ``cut`` drops the end."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.v, self.data, self.last = vocabulary, bytearray(), []
        self.add(piece)

    def add(self, more: bytes) -> None:
        v, ranks, last = self.v, self.v.ranks, self.last
        start = len(self.data)
        self.data += more
        data = bytes(self.data)
        for end in range(start + 1, len(data) + 1):
            for begin in range(max(0, end - v.longest), end):
                token = ranks.get(data[begin:end])
                if token is None:
                    continue
                if begin == 0:
                    if end == 1 or v.merged(data[:end]) == [token]:
                        break
                elif v.stable(last[begin - 1], token):
                    break
            else:
                raise ValueError("a byte without a token")
            last.append(token)

    def cut(self, size: int) -> None:
        del self.data[size:], self.last[size:]

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.v.bytes_of[out[-1]])
        return out[::-1]


class Encoder:
    """Whole texts to ids. Words recur, so the ids of each are kept; a text is split only at spaces before non-space,
    where the pattern always has a boundary, and what is between is split by the pattern.
    """

    _kept: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder for each vocabulary and worker."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __init__(self, path: str, pattern: str = PATTERN):
        self.v = Vocabulary(path)
        self.split = regex.compile(pattern)
        self._space = regex.compile(r" (?=\S)")
        self._odd = regex.compile(r" (?=\s)")
        self.words = _Cache(self._word)
        self.pieces = _Cache(lambda p: np.array(Prefixes(self.v, p.encode("utf-8", "replace")).ids(), dtype=np.int32).tobytes())

    def _word(self, word: str) -> bytes:
        return b"".join([self.pieces[p] for p in self.split.findall(" " + word)])

    def packed(self, text: str | None) -> bytes:
        """The ids as 32-bit numbers in a row; nothing for null and empty texts."""
        if not text:
            return b""
        words = self._space.split(text) if self._odd.search(text) else text.split(" ")
        if not words[-1] and len(words) > 1:  # a last space is no boundary
            words[-2:] = [words[-2] + " "]
        first = b"".join([self.pieces[p] for p in self.split.findall(words[0])])
        cache = self.words
        return first + b"".join([cache[w] for w in words[1:]])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), dtype=np.int32).tolist()

    def append(self, text: str, ids: list[int], more: str) -> list[int]:
        """The ids of text + more, from those of text: only the pieces from the last sure boundary on are encoded."""
        keep = text.rstrip()
        at = max(keep.rfind(" "), 0)
        while at and not (at + 1 < len(text) and not text[at + 1].isspace()):
            at = max(keep.rfind(" ", 0, at), 0)
        tail = text[at:]
        kept = len(ids) - len(self.encode(tail))
        return ids[:kept] + self.encode(tail + more)

    def edit(self, text: str, ids: list[int], start: int, end: int, new: str) -> list[int]:
        """The ids of text[:start] + new + text[end:], encoding again only between the sure boundaries around the edit."""
        bounds = [m.start() for m in self._space.finditer(text)]
        a = max([b for b in bounds if b + 1 < start], default=0)
        b = min([b for b in bounds if b > end], default=len(text))
        before, after = len(self.encode(text[:a])), len(self.encode(text[b:]))
        return ids[:before] + self.encode(text[a:start] + new + text[end:b]) + ids[len(ids) - after :]


class _Cache(dict):
    def __init__(self, make):
        super().__init__()
        self.make, self.held = make, 0

    def __missing__(self, key):
        value = self.make(key)
        if len(key) > WORD:  # long runs without a space hardly recur
            return value
        if self.held > CACHE:
            self.clear()
            self.held = 0
        self.held += 200 + 2 * len(key) + len(value)  # with what the entry itself takes
        self[key] = value
        return value
