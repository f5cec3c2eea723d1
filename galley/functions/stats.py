"""Small numeric expressions over aggregated rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_gamma(x: Column) -> Column:
    """Stirling series, moved eight steps up so that small x is precise too."""
    z = x + 8
    series = (
        (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi)
        + 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5))
        - 1 / (1680 * F.pow(z, 7)) + 1 / (1188 * F.pow(z, 9))
    )
    for i in range(8):
        series = series - F.log(x + i)
    return series


def sign_test_p(wins: Column, n: Column) -> Column:
    """Two-sided sign test on counts, to double precision.

    Sums binomial terms downward from the observed tail. Terms more than ten
    standard deviations below it vanish in a double, so the sum has about
    20 * sqrt(n) terms at most, whatever the number of pairs.
    """
    size = n.cast("double")
    tail = F.least(wins, n - wins).cast("long")
    last = F.greatest(F.lit(0), (tail - 10 * F.sqrt(size) - 50).cast("long"))
    log_top = (
        log_gamma(size + 1) - log_gamma(tail.cast("double") + 1)
        - log_gamma(size - tail + 1) - size * math.log(2)
    )

    def step(acc: Column, i: Column) -> Column:
        # term(i) follows from term(i + 1)
        move = F.when(i == tail, F.lit(0.0)).otherwise(
            F.log((i + 1).cast("double")) - F.log((n - i).cast("double"))
        )
        logp = acc["logp"] + move
        return F.struct(logp.alias("logp"), (acc["total"] + F.exp(logp)).alias("total"))

    start = F.struct(log_top.alias("logp"), F.lit(0.0).alias("total"))
    two_sided = F.aggregate(
        F.sequence(tail, last, F.lit(-1).cast("long")), start, step, lambda acc: acc["total"] * 2
    )
    return F.when(n > 0, F.least(F.lit(1.0), two_sided))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays; NULL when one has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
            F.lit(0.0),
            lambda acc, v: acc + v,
        )

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)
