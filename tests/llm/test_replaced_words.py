"""Overlaps with replaced words: every position, and the masks' promise."""

from itertools import combinations, product

import numpy as np
import pytest

from runlore.llm import decontamination as dc


def promised(equal, enough):
    n = len(equal)
    return any(5 * sum(equal[a:b]) >= 4 * (b - a) and sum(equal[a:b]) >= enough for a in range(n) for b in range(a + 1, n + 1))


@pytest.mark.parametrize("n", range(5, 21))
def test_replaced_at_every_position(n):
    item = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    block = dc.Block([(7, item)], 13)
    found = 0
    for k in range(4):
        for out in combinations(range(n), k):
            words = item.copy()
            words[list(out)] = np.arange(9000, 9000 + k, dtype=np.uint64)
            hit = block.overlaps(words, np.array([0]), 13)[0]
            equal = [i not in out for i in range(n)]
            assert bool(hit) == promised(equal, min(13, -(-4 * n // 5))), out
            for _, a, b, same in hit:
                assert same == sum(equal[a:b]) and 5 * same >= 4 * (b - a)
            found += bool(hit)
    assert found > n


def test_masks_hit_every_window():
    for t in range(1, 14):
        longest, most = (4, 7) if t == 13 else (3, 4)
        for m in range(most + 1):
            for runs in product(range(longest + 1), repeat=m + 1):
                if sum(runs) < max(t, 4 * m):
                    continue
                window = "0".join("1" * r for r in runs)
                assert any(all(window[k + i] == "1" for i, c in enumerate(mask) if c == "1") for mask in dc.MASKS[t] for k in range(len(window) - len(mask) + 1)), (t, runs)
