"""Scores of probabilities against outcomes, and quantiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.tables import materialise, running_sums


def squared_error(p: Column, y: Column) -> Column:
    return F.pow(p - y, F.lit(2.0))


def brier(p: Column, y: Column) -> Column:
    """Mean squared error; null for no rows."""
    return F.avg(squared_error(p, y))


def log_loss(p: Column, y: Column, eps: float = 1e-9) -> Column:
    c = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), p))
    return -F.avg(y * F.ln(c) + (1 - y) * F.ln(1 - c))


def nearest_center(p: Column, centers: Sequence[float]) -> Column:
    """The nearest bucket centre; of two as near the lower one."""
    candidates = F.array(*[F.struct(F.abs(p - F.lit(c)).alias("d"), F.lit(c).alias("c")) for c in centers])
    return F.array_min(candidates)["c"]


def reliability(points: DataFrame, by: Sequence[str], p: str, y: str, centers: Sequence[float]) -> DataFrame:
    """Per key and centre: mean price, realised rate and count; empty buckets are left out."""
    return points.groupBy(*by, nearest_center(F.col(p), centers).alias("center")).agg(F.avg(p).alias("mean_price"), F.avg(y).alias("realised"), F.count(F.lit(1)).alias("n"))


def expected_calibration_error(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum over buckets of n / N times the distance of price and rate."""
    gap = F.col("n") * F.abs(F.col("mean_price") - F.col("realised"))
    return curve.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def calibration_report(points: DataFrame, by: Sequence[str], p: str, y: str, centers: Sequence[float]) -> DataFrame:
    """Per key: n, brier, log_loss, ece and the curve, sorted by centre."""
    scores = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), brier(F.col(p), F.col(y)).alias("brier"), log_loss(F.col(p), F.col(y)).alias("log_loss"))
    curve = reliability(points, by, p, y, centers)
    summed = curve.groupBy(*by).agg(
        (F.sum(F.col("n") * F.abs(F.col("mean_price") - F.col("realised"))) / F.sum("n")).alias("ece"),
        F.array_sort(F.collect_list(F.struct("center", "mean_price", "realised", "n"))).alias("curve"),  # at most one entry for each centre
    )
    return scores.join(summed, list(by))


def compare(report: DataFrame, regime: str, venue: str, reference: str, target: str, margin: float) -> DataFrame:
    """Per regime whether the reference venue's error is at most the target's plus a margin; null if either is missing."""
    wide = report.groupBy(regime).pivot(venue, [reference, target]).agg(F.first("ece"))
    return wide.select(regime, F.col(reference).alias("ece_reference"), F.col(target).alias("ece_target"), (F.col(reference) <= F.col(target) + margin).alias("passed"))


def nearest_rank(values: Column, q: float) -> Column:
    """Quantile by nearest rank, position round-half-even(q * (n - 1)); ``values`` is a column to aggregate.

    The values of a group are sorted in one task: for groups that fit into one.  ``quantiles_by_count`` has no such limit.
    """
    ordered = F.array_sort(F.collect_list(values))
    return F.get(ordered, F.bround(F.lit(q) * (F.size(ordered) - 1)).cast("int"))


def quantiles_by_count(rows: DataFrame, by: Sequence[str], value: str, nearest: dict[str, float], middle: str | None = None) -> DataFrame:
    """Quantiles by nearest rank, and the interpolated median as ``middle``, for groups of any size.

    Ranks come from counts of distinct values: running sums over range partitions, so no task
    holds a group.  Keys that are null are a group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = materialise(running_sums(counts, [*by, value], {"_c": "_before"}, "quantile-counts"), "quantile-places")
    groups = placed.groupBy(*[F.col(k).alias(f"_{k}") for k in by]).agg(F.min("_before").alias("_first"), F.sum("_c").alias("_n"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by], F.lit(True))
    upto = F.col("_before") - F.col("_first") + F.col("_c")

    def at(place: Column) -> Column:
        return F.min(F.when(upto > place, F.col(value)))

    last = F.col("_n") - 1
    picks = [at(F.bround(F.lit(q) * last)).alias(name) for name, q in nearest.items()]
    if middle:
        picks.append(((at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2).alias(middle))
    return placed.join(groups, on).groupBy(*by).agg(*picks)


def nearest_rank_by_count(rows: DataFrame, by: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    return quantiles_by_count(rows, by, value, quantiles)


def depth_stats(quotes: DataFrame, by: Sequence[str], bid_usd: str, ask_usd: str) -> DataFrame:
    """Per key over rows with both sides: n, median (interpolated), p25 and p75 (nearest rank), least and most of the thinner side."""
    depth = quotes.where(F.col(bid_usd).isNotNull() & F.col(ask_usd).isNotNull()).withColumn("_depth", F.least(bid_usd, ask_usd))
    base = depth.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_depth").alias("min_usd"), F.max("_depth").alias("max_usd"))
    return base.join(quantiles_by_count(depth, by, "_depth", {"p25_usd": 0.25, "p75_usd": 0.75}, "median_usd"), list(by))


def signal_depth(quotes: DataFrame, venue: str) -> DataFrame:
    """Depth per regime at the moments a signal would fire: live quotes of one venue with both sides.  Stored bars have no book any more."""
    live = quotes.where((F.col("venue") == venue) & (F.col("source") == "live") & F.col("regime").isNotNull())
    return depth_stats(live, ["regime"], "bid_size_usd", "ask_size_usd")
