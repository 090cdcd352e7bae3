"""Intervals, exact tests, cost lines."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson score interval of k successes in n trials, within 0 and 1; (0, 0) for no trials."""
    share = k / n
    shrink, centre = 1 + z * z / n, share + z * z / (2 * n)
    half_width = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    low, high = (centre - half_width) / shrink, (centre + half_width) / shrink
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), low)), F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), high))


def log_factorial(n: Column) -> Column:
    """Logarithm of n!: looked up below 16, by Stirling's series above, right to twelve digits."""
    few = F.element_at(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)]), F.least(n.cast("int"), F.lit(15)) + 1)
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < 16, few).otherwise(series)


def fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Fisher's exact two-sided p of the table ((a, b), (c, d)): tables no likelier than the one seen, within 1e-12."""
    a, b, c, d = (x.cast("int") for x in (a, b, c, d))
    fixed = log_factorial(a + b) + log_factorial(c + d) + log_factorial(a + c) + log_factorial(b + d) - log_factorial(a + b + c + d)

    def likely(x: Column) -> Column:
        return F.exp(fixed - log_factorial(x) - log_factorial(a + b - x) - log_factorial(a + c - x) - log_factorial(d - a + x))

    all_x = F.sequence(F.greatest(F.lit(0), a - d), F.least(a + b, a + c))
    return F.least(F.lit(1.0), F.aggregate(F.transform(all_x, likely), F.lit(0.0), lambda s, p: s + F.when(p <= likely(a) + 1e-12, p).otherwise(0.0)))


def cost(at: Column, base: Column, slope: Column, cap: Column) -> Column:
    """A measured cost line that levels off: min(base + slope * at, cap)."""
    return F.least(base + slope * at, cap)


def largest_admissible(free: Column, margin: Column, base: Column, slope: Column, cap: Column) -> Column:
    """The largest size whose cost and margin fit what is free: without bound if the cap fits, 0 if not even the base does."""
    room = free - margin
    return F.when(room >= cap, float("inf")).when(room < base, 0.0).otherwise((room - base) / slope)


def admission(cost_: Column, free: Column, margin: Column, resident: Column) -> Column:
    """admitir, reciclar (fits once what is resident is given back) or rechazar. Unknown free amount: admitir."""
    return F.when(free.isNull() | (cost_ + margin <= free), "admitir").when(cost_ + margin <= free + resident, "reciclar").otherwise("rechazar")
