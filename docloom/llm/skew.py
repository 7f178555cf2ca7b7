"""Joins in which one key may hold most of the rows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def joined_with_classes(rows: DataFrame, classes: DataFrame, on: list[str], copies: str, least: int = 10_000) -> DataFrame:
    """``rows`` joined with the one row of ``classes`` for their key; a class may hold most of the rows.

    The classes with more than ``least`` copies and more than a ten-thousandth of all rows are 10,000 at most, so they go
    to every task and their rows stay where they are. All others are joined by a shuffle. ``classes`` should be a table,
    since it is read more than once.
    """
    total = classes.agg(F.sum(copies)).first()[0] or 0
    many = F.col(copies) > max(least, total // 10_000)
    hot = F.broadcast(classes.filter(many))
    cold = rows.join(F.broadcast(classes.filter(many).select(*on)), on, "left_anti").join(classes.filter(~many), on)
    return rows.join(hot, on).unionByName(cold)
