"""Seeded draws that depend on the keys of a row only, never on partitioning or order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by a bar."""
    return F.md5(F.concat_ws("|", *[_text(p) for p in parts]))


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the first 32 bits of the digest."""
    head = F.conv(F.substring(digest(*parts), 1, 8), 16, 10)
    return head.cast("double") / F.lit(float(2**32))


def between(low: float | Column, high: float | Column, *parts) -> Column:
    return F.lit(low) + uniform(*parts) * (F.lit(high) - F.lit(low))


def whole_between(low: int | Column, high: int | Column, *parts) -> Column:
    """An integer in [low, high], both ends possible."""
    span = (F.lit(high) - F.lit(low) + 1).cast("double")
    return (F.lit(low) + F.floor(uniform(*parts) * span)).cast("int")


def normal(*parts) -> Column:
    """Standard normal by the Box-Muller rule; 1 - u keeps the logarithm finite."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(*parts, "radius")))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(*parts, "angle"))


def _text(part: Column | str | int) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))
