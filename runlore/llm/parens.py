"""A tree as balanced parentheses with range min-max blocks over their excess."""

from __future__ import annotations

import numpy as np

#: Parentheses in a block of the lowest level.
BLOCK = 64
_NONE = np.int32(1 << 30)


class BalancedParens:
    """bits: true opens a node, false closes it, in preorder; every node closes. Nodes are named by their rank in
    preorder."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(np.where(bits, 1, -1), dtype=np.int32)
        blocks = -(-len(bits) // BLOCK)
        padded = np.full(blocks * BLOCK, _NONE)
        padded[: len(bits)] = self.excess
        low, high = padded.reshape(-1, BLOCK).min(1), np.where(padded == _NONE, -_NONE, padded).reshape(-1, BLOCK).max(1)
        lows, highs, self.level_at = [], [], []
        at = 0
        while True:  # each level has the least and the greatest excess of two blocks of the one below
            if len(low) % 2:
                low, high = np.append(low, _NONE), np.append(high, -_NONE)
            self.level_at.append(at)
            lows.append(low)
            highs.append(high)
            at += len(low)
            if len(low) == 2:
                break
            low, high = low.reshape(-1, 2).min(1), high.reshape(-1, 2).max(1)
        self.low, self.high = np.concatenate(lows), np.concatenate(highs)
        self.level_at = np.array(self.level_at)
        #: Of every place the number of nodes opened up to it.
        self.opened = np.cumsum(bits, dtype=np.int64)

    def _scan(self, at: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first place from each at to the end of its block whose excess is the target; -1 if there is none."""
        out, rest = np.full(len(at), -1, np.int64), np.arange(len(at))
        at = at.copy()
        while len(rest):
            rest = rest[at[rest] < len(self.excess)]
            hit = self.excess[at[rest]] == target[rest]
            out[rest[hit]] = at[rest[hit]]
            rest = rest[~hit]
            at[rest] += 1
            rest = rest[at[rest] % BLOCK != 0]
        return out

    def _holds(self, level: np.ndarray, block: np.ndarray, target: np.ndarray) -> np.ndarray:
        i = self.level_at[level] + block
        return (self.low[i] <= target) & (target <= self.high[i])

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """Of each opening place the place that closes it."""
        target = self.excess[opens] - 1
        out = np.full(len(opens), -1, np.int64)
        inside = np.flatnonzero((opens + 1) % BLOCK != 0)
        out[inside] = self._scan(opens[inside] + 1, target[inside])
        far = np.flatnonzero(out < 0)
        goal, block, level = target[far], opens[far] // BLOCK + 1, np.zeros(len(far), np.int64)
        climb = np.arange(len(far))
        # Up, until a block holds the target. There is one, as every node closes.
        while len(climb):
            even = block[climb] % 2 == 0
            up = climb[even & (level[climb] + 1 < len(self.level_at))]
            climb = climb[~self._holds(level[climb], block[climb], goal[climb])]
            up = np.intersect1d(up, climb, assume_unique=True)
            block[up] >>= 1
            level[up] += 1
            stay = np.setdiff1d(climb, up, assume_unique=True)
            block[stay] += 1
        down = np.flatnonzero(level > 0)
        while len(down):
            level[down] -= 1
            block[down] *= 2
            block[down] += ~self._holds(level[down], block[down], goal[down])
            down = down[level[down] > 0]
        out[far] = self._scan(block * BLOCK, goal)
        return out

    def subtree_ends(self) -> np.ndarray:
        """Of every node the rank behind the last node of its subtree."""
        return self.opened[self.findclose(np.flatnonzero(self.bits))]

    def childless(self) -> np.ndarray:
        """Whether each node is a leaf pair, "()"."""
        opens = np.flatnonzero(self.bits)
        return ~self.bits[opens + 1]
