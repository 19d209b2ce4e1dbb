"""Distribution functions for the few rows that tests return."""

from __future__ import annotations

import math


def normal_two_sided(z: float | None) -> float | None:
    return None if z is None or math.isnan(z) else math.erfc(abs(z) / math.sqrt(2))


def student_two_sided(t: float | None, df: int) -> float | None:
    """P(|T| >= |t|) by the continued fraction of the incomplete beta function."""
    if t is None or df <= 0 or math.isnan(t):
        return None
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + (b * math.log1p(-x) if x < 1 else 0.0)) if 0 < x < 1 else float(x >= 1)
    if not 0 < x < 1:
        return front

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
        h = d
        for m in range(1, 1000):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + k * d or 1e-300), 1 + k / c or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def signed_rank_two_sided(doubled: list[int], w: float) -> float:
    """P of a signed-rank sum as far out as w, either way, over all signs of the ranks (given twice over, as ties have halves).

    Counts of the sums by dynamic programming: adding a rank shifts a copy of what was there.
    """
    ways = [1]
    for rank in doubled:
        ways = [a + b for a, b in zip(ways + [0] * rank, [0] * rank + ways, strict=True)]
    low = round(2 * min(w, sum(doubled) / 2 - w))
    return min(1.0, 2 * sum(ways[: low + 1]) / 2 ** len(doubled))
