"""Joins whose plan follows from a size that was looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of keys and numbers, under 64 bytes each, that every task may hold: 64 MB.
ROWS = 1 << 20


def light(kept: DataFrame, most: int = ROWS) -> DataFrame:
    """A written table of narrow rows, marked for a broadcast if it has at most ``most`` rows; a larger one is joined by a
    shuffle of both sides. The result of a join is the same either way."""
    return F.broadcast(kept) if kept.count() <= most else kept
