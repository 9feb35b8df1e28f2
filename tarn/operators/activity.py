"""The bounded activity log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 200


def recent(events: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The newest `capacity` events (0 counts as 1), oldest first: a top-k, then a sort of k rows."""
    newest = events.orderBy(*[F.desc(c) for c in order]).limit(max(1, capacity))
    return newest.orderBy(*order)


def format_time(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
