"""Plain-Python mining of small baskets, by trying every combination."""

import math
from itertools import combinations


def least(n, ratio, mode):
    share = n * ratio
    return {"floor": max(1, math.floor(share)), "exact": share, "ceil": math.ceil(share)}[mode]


def mine(baskets, ratio, mode):
    """{items: (support, sum of log1p of the joint quantity, largest joint quantity)}."""
    found = {}
    for basket in baskets.values():
        items = sorted(basket)
        for k in range(1, len(items) + 1):
            for chosen in combinations(items, k):
                volume = min(basket[i] for i in chosen)
                n, logs, top = found.get(chosen, (0, 0.0, 0.0))
                found[chosen] = (n + 1, logs + math.log1p(volume), max(top, volume))
    minimum = least(len(baskets), ratio, mode)
    return {c: v for c, v in found.items() if v[0] >= minimum}


def candidate_counts(baskets, frequent):
    """[(level, candidates, frequent)] of the level-wise search."""
    levels = [(1, len({i for b in baskets.values() for i in b}), sum(len(c) == 1 for c in frequent))]
    k = 2
    while levels[-1][2]:
        before = {c for c in frequent if len(c) == k - 1}
        items = sorted({i for c in before for i in c})
        found = [c for c in combinations(items, k) if all(s in before for s in combinations(c, k - 1))]
        if not found:
            break
        levels.append((k, len(found), sum(len(c) == k for c in frequent)))
        k += 1
    return levels
