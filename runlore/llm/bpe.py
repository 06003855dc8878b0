"""Byte-level BPE encoding and decoding by ranks (operator 9).

The merges of a piece are found without merging: bytes are mapped to Latin-1, one pass of an Aho-Corasick automaton
gives the longest token that starts at each byte, and the encoder goes from longest match to longest match. A token is
taken only if it may stand after the one before it, which is so when encoding the two joined would give just these two;
the answers are memoised. Where none fits, it falls back to shorter tokens and then one token back; an end that failed
once is never tried again, so the time is linear in the bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from runlore.llm.common import session_setup
from runlore.llm.pieces import Pieces

#: Pairs of tokens and pieces of text that a worker remembers; beyond that it starts anew. Results don't depend on it. A
#: worker keeps them while other operators run in it, so they are to stay within some 60 MB.
MEMO = 150_000

RESULT = "doc_id long, n_tokens long, ids binary, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars long"


def read_ranks(path: str) -> dict[bytes, int]:
    with fs.LocalFileSystem().open_input_stream(path) as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f.read().splitlines() if line.strip())}


class BytePairs:
    """Encodes pieces of text by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self._merge(token, rank)
                if len(parts) != 2:
                    continue  # no merge makes it: it only stands for a whole piece
                self.halves[rank] = (parts[0], parts[1])
                self.joined[parts[0], parts[1]] = rank
            else:
                self.halves[rank] = (rank, rank)
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.shorter = {r: self._shorter(self.bytes_of[r]) for r in self.halves}
        self._follows: dict[tuple[int, int], bool] = {}
        self.encode = Pieces(pattern, self.piece_ids, MEMO).encode

    def _merge(self, token: bytes, limit: int) -> list[int]:
        """The ids left of a token when merges of a rank under limit are done, lowest rank and leftmost first."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
            if best >= limit:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _shorter(self, token: bytes) -> int | None:
        for n in range(len(token) - 1, 0, -1):
            rank = self.ranks.get(token[:n])
            if rank in self.halves:
                return rank
        return None

    def follows(self, left: int, right: int) -> bool:
        """Whether encoding the two tokens' bytes joined gives these two. Undoes merges, the later first, and looks for
        one across the border that would have come before."""
        key = (left, right)
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) >= MEMO:
                self._follows.clear()
            known = self._follows[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        limit = len(self.ranks) + 1  # a merge across the border counts only below this rank
        while True:
            across = self.joined.get((left, right))
            if across is not None and across < limit:
                return False
            undo_left = self.halves[left][0] != left
            undo_right = self.halves[right][0] != right
            if not undo_left and not undo_right:
                return True
            # The merge that came last is undone first; of equal ranks the right one came last.
            if undo_left and (not undo_right or left > right):
                limit, left = left, self.halves[left][1]
            else:
                limit, right = right + 1, self.halves[right][0]

    def _encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [0] * n
        for end, (size, rank) in self.automaton.iter(piece.decode("latin-1")):
            start = end - size + 1
            longest[start] = rank  # ends come in ascending order, so the last is the longest
        out: list[int] = []
        open_at = bytearray(b"\x01") * (n + 1)
        at, token = 0, longest[0]
        size_of = self.bytes_of
        while at < n:
            last = out[-1] if out else None
            while True:
                end = at + len(size_of[token])
                if open_at[end] and (last is None or self.follows(last, token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    break
                less = self.shorter[token]
                if less is not None:
                    token = less
                    continue
                open_at[at] = 0
                token = out.pop()
                at -= len(size_of[token])
                less = self.shorter[token]
                while less is None:
                    open_at[at] = 0
                    token = out.pop()
                    at -= len(size_of[token])
                    less = self.shorter[token]
                token = less
                break
        return out

    def piece_ids(self, piece: str) -> bytes:
        """The ids of a piece as little-endian unsigned 32-bit integers."""
        return np.array(self._encode_piece(piece.encode()), dtype="<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> BytePairs:
    """One encoder for each Python worker and vocabulary."""
    return BytePairs(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, digests: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again; one row for each row of docs, in no given order.

    docs: doc_id, text and any other columns, which are ignored. digests: SHA-256 of ids and of the decoded bytes in
    place of these, and n_chars of the text. A null text counts as empty: no ids, decoded to the empty string. A null doc_id stays null; repeated
    rows each give a row; an empty table gives an empty one. No shuffle: each text is encoded where it is read.
    """
    session_setup(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = [own.encode(t or "") for t in texts]
            back = [own.decode(x) for x in ids]
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            if digests:
                rest = [pa.array([hashlib.sha256(x).hexdigest() for x in c], pa.string()) for c in (ids, back)]
                chars = pa.array([len(t or "") for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), counts, *rest, chars], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chars"])
            else:
                rest = [pa.array(ids, pa.binary()), pa.array([x.decode() for x in back], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0), counts, *rest], ["doc_id", "n_tokens", "ids", "decoded"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(run, DIGESTS if digests else RESULT)
