"""A compressed set of the places in a text where a token ends, that gives its k-th member without a list of all."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np

#: Places that share a container.
SPAN = 1 << 16
#: Up to so many places are an array of 16-bit integers; more are a bitmap of SPAN bits.
ARRAY = 4096
_BLANK = np.zeros(33, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


class ArrayContainer:
    """Ascending low halves of the places."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """A bit for every place, and the number of places before each word of 64."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(SPAN, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def select(self, k: int) -> int:
        w = int(np.searchsorted(self.before, k, "right")) - 1
        word = int(self.words[w])
        for _ in range(k - int(self.before[w])):
            word &= word - 1
        return 64 * w + (word & -word).bit_length() - 1


class RunContainer:
    """First places of runs of neighbours, and the number of places before each run."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        self.starts = starts.astype(np.uint16)
        self.before = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest of the three for these ascending places below SPAN."""
    breaks = np.flatnonzero(np.diff(low) != 1) + 1
    starts = np.concatenate([[0], breaks]).astype(np.int64)
    if 4 * len(starts) < min(2 * len(low), SPAN // 8):
        return RunContainer(low[starts], np.diff(np.concatenate([starts, [len(low)]])))
    return ArrayContainer(low) if len(low) <= ARRAY else BitmapContainer(low)


class BoundarySet:
    """The places behind the tokens of a text, in code points: a token is white space with the word behind it, or the
    white space that ends the text. Containers that hold none are left out; the k-th place is found by a binary search over
    the cumulative cardinalities and a selection in one container."""

    def __init__(self, text: str):
        self.numbers, self.containers, self.upto = [], [], []
        total = 0
        for at in range(0, len(text), SPAN):
            # One code point more, to see whether a word goes on behind the chunk.
            points = np.frombuffer(text[at : at + SPAN + 1].encode("utf-32-le", "surrogatepass"), "<u4")
            blank = (points < 33) & _BLANK[np.minimum(points, 32)]
            here = min(SPAN, len(text) - at)
            ends = np.ones(here, bool)
            ends[: len(points) - 1] = blank[1 : here + 1]
            ends &= ~blank[:here]
            if at + here == len(text):
                ends[-1] = True
            low = np.flatnonzero(ends)
            if len(low):
                total += len(low)
                self.numbers.append(at // SPAN)
                self.containers.append(container(low))
                self.upto.append(total)

    def __len__(self) -> int:
        return self.upto[-1] if self.upto else 0

    def offset(self, tokens: int) -> int:
        """Where the first so many tokens end."""
        if not tokens:
            return 0
        k = tokens - 1
        i = bisect_right(self.upto, k)
        return self.numbers[i] * SPAN + self.containers[i].select(k - (self.upto[i - 1] if i else 0)) + 1
