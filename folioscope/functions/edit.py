"""Weighted edit distances on short strings (Python side, for Arrow functions)."""

from __future__ import annotations

#: Pairs of characters that reading or typing mixes up; such a swap costs half.
CONFUSABLE = frozenset(
    frozenset(p)
    for p in (
        "0o", "1l", "1i", "il", "5s", "8b", "2z", "9g", "9q", "gq", "ce", "c(", "hb", "vy", "tf",
        "nm", "un", "zs", "sc", "kc", "bv", "ij", "ao", "uv", "6b", "ei", "rt", "mn",
    )
)


def weighted_damerau(a: str, b: str, limit: float = 1e9, cheap: float = 0.5, swap: float = 0.8, double: float = 0.6) -> float:
    """Edit distance with insert, delete, replace and neighbour swap.

    A confusable replacement costs `cheap`, a swap of neighbours `swap`, dropping or
    doubling a letter that stands twice `double`, everything else 1. Rows whose best
    value passes `limit` end the search early with a value above `limit`.
    """
    if a == b:
        return 0.0
    la, lb = len(a), len(b)
    if abs(la - lb) > limit / min(cheap, double):
        return limit + 1
    before: list[float] = []
    prev = [0.0] * (lb + 1)
    for j in range(1, lb + 1):
        prev[j] = prev[j - 1] + (double if j > 1 and b[j - 1] == b[j - 2] else 1.0)
    for i in range(1, la + 1):
        x = a[i - 1]
        drop = double if i > 1 and x == a[i - 2] else 1.0
        row = [prev[0] + drop] + [0.0] * lb
        for j in range(1, lb + 1):
            y = b[j - 1]
            if x == y:
                best = prev[j - 1]
            else:
                best = prev[j - 1] + (cheap if frozenset((x, y)) in CONFUSABLE else 1.0)
            add = double if j > 1 and y == b[j - 2] else 1.0
            best = min(best, prev[j] + drop, row[j - 1] + add)
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2] and x != y:
                best = min(best, before[j - 2] + swap)
            row[j] = best
        if min(row) > limit:
            return limit + 1
        before, prev = prev, row
    return prev[lb]
