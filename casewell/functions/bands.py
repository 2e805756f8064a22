"""Ordered bands over a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import (  # noqa: F401
    BRANCH_BANDS, MATCH_BANDS, PRIORITY_BANDS, RESOLUTION_BANDS, URGENT_BELOW_HOURS,
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def band(x: Column | str, bands: tuple, strict: bool = False) -> Column:
    """First band whose lower edge is reached (strict: exceeded); null → the last label."""
    x, out = _col(x), None
    edges, rest = bands
    for edge, label in edges:
        hit = x > edge if strict else x >= edge
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(rest)


def urgency(hours: Column | str) -> Column:
    return F.when(_col(hours) < URGENT_BELOW_HOURS, "destructive").otherwise("warning")


def clamp_percent(x: Column | str) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), _col(x)))


def ordinal(n: Column | str) -> Column:
    """1 → "1st", 2 → "2nd", 3 → "3rd", then "th"."""
    n = _col(n)
    return F.concat(
        n.cast("string"),
        F.when(n == 1, "st").when(n == 2, "nd").when(n == 3, "rd").otherwise("th"),
    )
