"""Interval joins by bins of time: an equality join and an exact filter after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(intervals: DataFrame, points: DataFrame, by: Sequence[str], lo: str, hi: str, t: str, width: int) -> DataFrame:
    """Intervals with the points of their key whose time lies from ``lo`` to ``hi``, both included.

    Time is cut into bins of ``width``; an interval stands in each bin that it touches, so a point
    meets the intervals near it and not all of its key, and a key is spread over its bins.  An
    interval much longer than ``width`` stands in many bins: take about the usual length.
    Intervals that end before they begin, and null keys and times, meet nothing.
    """
    spans = intervals.where(F.col(lo) <= F.col(hi)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    placed = points.withColumn("_bin", F.floor(F.col(t) / width))
    return spans.join(placed, [*by, "_bin"]).where(F.col(t).between(F.col(lo), F.col(hi))).drop("_bin")
