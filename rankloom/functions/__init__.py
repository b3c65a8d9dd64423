"""Column functions of link analysis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAMPING = 0.85
TOLERANCE = 2e-7


def base_score(leak: Column | float, n: Column | int, damping: float = DAMPING) -> Column:
    """What every vertex gets in a step: the leaked mass and the teleported rest, in equal parts."""
    leak = leak if isinstance(leak, Column) else F.lit(float(leak))
    n = n if isinstance(n, Column) else F.lit(n)
    return (leak + (1 - leak) * (1 - damping)) / n


def affine(value: Column, n: Column | int, damping: float = DAMPING) -> Column:
    """damping * value + (1 - damping) / n: a step without the leaked mass."""
    return F.lit(damping) * value + F.lit(1 - damping) / (n if isinstance(n, Column) else F.lit(n))


def bin_of(offset: Column, bins: int, width: Column) -> Column:
    """The bin of offset among bins that begin at floor(i * width / bins): not width_bucket, whose bins differ."""
    return F.floor(((offset + 1) * bins - 1) / width).cast("long")


def rank_text(rank: Column) -> Column:
    return F.format_string("%.12f", rank)
