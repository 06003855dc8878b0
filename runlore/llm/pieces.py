"""Splitting texts into the pieces that byte-level BPE encodes one by one, and remembering the pieces' ids."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

#: Pieces that a worker remembers; beyond that it starts anew. Results don't depend on it.
MEMO = 800_000
#: The pattern that byte-level BPE splits by.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# For texts of these characters alone the standard library splits twice as fast, by the same rule as SPLIT.
_PLAIN = re.compile(r"[\t\n\r -~\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
_PLAIN_SPLIT = re.compile(r" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\sA-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff0-9]+|\s+(?!\S)|\s+")


class Pieces:
    """Encodes texts piece by piece: encode gives a piece's ids as bytes, and is asked once for a piece that is remembered."""

    def __init__(self, pattern: str, encode: Callable[[str], bytes], most: int = MEMO):
        self._most = most
        self._split, self._plain, self._encode = regex.compile(pattern).findall, pattern == SPLIT, encode
        self._known: dict[str, bytes] = {}

    def _new(self, piece: str) -> bytes:
        ids = self._encode(piece)
        if len(piece) <= 64:
            if len(self._known) >= self._most:
                self._known.clear()
            self._known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        known, new = self._known.get, self._new
        split = _PLAIN_SPLIT.findall if self._plain and _PLAIN.fullmatch(text) else self._split
        return b"".join([known(p) or new(p) for p in split(text)])
