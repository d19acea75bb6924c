"""Event-block bootstrap: blocks are drawn with replacement and move together.

A draw is an integer hash of (seed, resample, place), so results do not depend on partitioning,
but for the last digit of sums.
For a mean every block is reduced to (sum, n) first and written once.  A key's blocks then travel as
arrays, and a task makes a range of resamples from them: draws are places in an array and never
rows.  Where a key has more blocks than a task holds, its chunks give partial sums of each
resample, which add up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.tables import materialise, numbered, partitions

MOST_BLOCKS = 1 << 20  # blocks that a task holds, as arrays of two numbers each
MOST_DRAWS = 1 << 27  # draws that a task makes
RANGES = 16  # tasks at least, for the resamples of a key's blocks
PLACES = 1 << 14  # places that are drawn for at a time
PART_VALUES = 1 << 20  # values that a task holds of a key
SLICE, WEIGHTS = 64, 1 << 22  # resamples whose weights it holds at a time, and weights

#: The prime 2^31 - 1 and multipliers of the draw's hash.  All products stay below 2^48.
PRIME, MULTIPLIERS, SHIFTS = 2_147_483_647, (48_271, 69_621, 16_807), (15, 13)


def mix(x):  # noqa: ANN001, ANN201
    """A hash of a number or an array of numbers, below 2^31."""
    x = (x & PRIME) + (x >> 31)  # the same modulo 2^31 - 1, as everywhere here; a division costs many times that
    for multiplier, shift in zip(MULTIPLIERS, (*SHIFTS, 31), strict=True):
        x = x * multiplier
        x = (x & PRIME) + (x >> 31)
        x = (x + (x + 1 >> 31)) & PRIME  # PRIME itself is 0
        if shift < 31:  # a value has no more bits
            x = x ^ x >> shift
    return x


def below(x: np.ndarray, n: int) -> np.ndarray:
    """``x % n`` of numbers below 2^31, for which the division of doubles is exact enough."""
    return x - (x / n).astype(np.int64) * n


def draw_of(seed: int, resample: int, place: int, n: int) -> int:
    """The index from 0 below n that a resample has at a place."""
    return mix(mix(resample + seed) ^ mix(place + 1)) % n


def chunks_of(table: DataFrame, summary: DataFrame, most: int = MOST_BLOCKS) -> DataFrame:
    """``_first``, ``n_blocks``, ``_from``, ``_sums``, ``_ns``: each key's blocks in their order, as arrays of at most ``most``; ``_from`` is the place of the first.

    ``table`` has ``_at``, ``_sum``, ``_n``, of which a key's are the numbers from ``_first`` on.
    """
    keys = [c for c in summary.columns if c in table.columns]
    of = summary.select("_first", "n_blocks", *[F.col(c).alias(f"_of_{c}") for c in keys])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys], F.lit(True))
    placed = table.join(of, same).withColumn("_i", F.col("_at") - F.col("_first"))
    blocks = F.array_sort(F.collect_list(F.struct("_i", "_sum", "_n")))
    grouped = placed.groupBy("_first", "n_blocks", F.floor(F.col("_i") / most).alias("_chunk")).agg(blocks.alias("_b"))
    return grouped.select("_first", "n_blocks", (F.col("_chunk") * most).alias("_from"), F.transform("_b", lambda b: F.coalesce(b["_sum"], F.lit(0.0)).cast("double")).alias("_sums"), F.transform("_b", lambda b: b["_n"]).alias("_ns"))


def resampled(chunks: DataFrame, resamples: int, seed: int) -> DataFrame:
    """``_first``, ``_r``, ``_stat``: the mean of each resample of each key.

    A task draws a range of resamples against one chunk and gives their sums; chunks of a key add up.
    """
    step = F.greatest(F.lit(1), F.least(F.lit(-(-resamples // RANGES)), F.floor(F.lit(MOST_DRAWS) / F.col("n_blocks")))).cast("int")
    work = chunks.withColumn("_step", step).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), F.col("_step"))))
    # By range, as a hash would give some tasks several ranges of resamples and others none.
    work = work.repartitionByRange(max(partitions(chunks.sparkSession), 4 * RANGES), "_first", "_from", "_r")

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                first, n, begin, step, r = (x.as_py() for x in (*row[:3], *row[5:]))
                sums, ns = (x.values.to_numpy(zero_copy_only=False) for x in row[3:5])
                count = min(step, resamples - r)
                totals, counts = np.zeros(count), np.zeros(count, dtype=np.int64)
                for at in range(0, n, PLACES):
                    places = mix(np.arange(at + 1, min(at + PLACES, n) + 1, dtype=np.int64))
                    for k in range(count):
                        drawn = below(mix(mix(r + k + seed) ^ places), n) - begin
                        if len(sums) < n:
                            drawn = drawn[(drawn >= 0) & (drawn < len(sums))]
                        totals[k] += sums[drawn].sum()
                        counts[k] += ns[drawn].sum()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(count, first)), pa.array(np.arange(r, r + count)), pa.array(totals), pa.array(counts)], names=["_first", "_r", "_sum", "_n"])

    parts = work.select("_first", "n_blocks", "_from", "_sums", "_ns", "_step", "_r").mapInArrow(draw, "_first bigint, _r bigint, _sum double, _n bigint")
    return parts.groupBy("_first", "_r").agg((F.sum("_sum") / F.sum("_n")).alias("_stat"))


def interval(stats: DataFrame, keys: Sequence[str], resamples: int, ci_level: float, *also: Column) -> DataFrame:
    """``ci_lo`` and ``ci_hi`` of each key from one ``_stat`` for each resample."""
    lo, hi = int((1 - ci_level) / 2 * resamples), int((1 + ci_level) / 2 * resamples) - 1
    ordered = F.array_sort(F.collect_list("_stat"))
    return stats.groupBy(*keys).agg(F.get(ordered, F.lit(lo)).alias("ci_lo"), F.get(ordered, F.lit(max(hi, 0))).alias("ci_hi"), *also)


def bootstrap_mean(rows: DataFrame, by: Sequence[str], block: str, value: str, resamples: int, seed: int, ci_level: float) -> DataFrame:
    """Per key: point, ci_lo, ci_hi, n_blocks and n of the mean.  Fewer than two blocks give no interval and no point.

    Blocks are numbered by range partitions and offsets, in their order.
    """
    keys = list(by)
    blocks = materialise(rows.groupBy(*keys, block).agg(F.sum(value).alias("_sum"), F.count(value).alias("_n")), "bootstrap-blocks")
    table = materialise(numbered(blocks, [], [*keys, block], "_at", "bootstrap-numbered"), "bootstrap-table")
    # A key's blocks are the numbers from its first on, so a place in a key is one long.
    summary = table.groupBy(*keys).agg((F.sum("_sum") / F.sum("_n")).alias("point"), F.count(F.lit(1)).alias("n_blocks"), F.sum("_n").alias("n"), F.min("_at").alias("_first"))
    stats = resampled(chunks_of(table, summary.where("n_blocks >= 2")), resamples, seed)
    point = F.when(F.col("n_blocks") >= 2, F.col("point")).alias("point")
    return summary.join(interval(stats, ["_first"], resamples, ci_level), "_first", "left").select(*keys, point, "ci_lo", "ci_hi", "n_blocks", "n")


class Mergeable(Protocol):
    """A statistic whose state is ``size`` numbers: of parts of the data, for many resamples at once (a row each)."""

    size: int

    def update(self, values: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """States of values that stand in each resample as often as ``weights`` (resamples by values) say."""

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """States of both parts together."""

    def finish(self, states: np.ndarray) -> np.ndarray:
        """The statistic of each state."""


class Linear(Mergeable, Protocol):
    """One whose state is a sum over values: a block then needs no more than its own sums."""

    def terms(self, value: Column) -> list[Column]:
        """What is summed, ``size`` columns."""


class Moments:
    """Number, sum and sum of squares; ``of`` makes the statistic of these three."""

    size = 3

    def __init__(self, of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]):
        self.of = of

    def terms(self, value: Column) -> list[Column]:
        return [F.lit(1.0), value, value * value]

    def update(self, values: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return weights @ np.stack([np.ones(len(values)), values, values * values], axis=1)

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a + b

    def finish(self, states: np.ndarray) -> np.ndarray:
        return self.of(*states.T)


def block_counts(seed: int, resamples: Iterable[int], n: int) -> Iterator[np.ndarray]:
    """How often each of a key's n blocks stands in each of the resamples."""
    parts = [(at, min(at + PLACES, n)) for at in range(0, n, PLACES)]
    hashed, drawn = mix(np.arange(1, n + 1, dtype=np.int64)), np.empty(n, dtype=np.int64)
    for resample in resamples:
        own = mix(resample + seed)
        for begin, end in parts:
            drawn[begin:end] = below(mix(own ^ hashed[begin:end]), n)
        yield np.bincount(drawn, minlength=n)


def placed_blocks(rows: DataFrame, keys: Sequence[str], block: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Values (not null) with ``_first`` (of their key), ``n_blocks`` and the place ``_i`` of their block; and a row for each key."""
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(block).alias("_block"), F.col(value).cast("double").alias("_v"))
    table = materialise(numbered(rows.select(*keys, "_block").distinct(), [], [*keys, "_block"], "_at", "bootstrap-numbered"), "bootstrap-table")
    summary = materialise(table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_blocks"), F.min("_at").alias("_first")), "bootstrap-keys")
    for other, on in ((table, [*keys, "_block"]), (summary, list(keys))):
        named = other.select(*[F.col(c).alias(f"_of_{c}") for c in on], *[c for c in other.columns if c not in on])
        rows = rows.join(named, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on], F.lit(True))).drop(*[f"_of_{c}" for c in on])
    return rows.select("_first", "n_blocks", (F.col("_at") - F.col("_first")).alias("_i"), "_v"), summary


def with_ranges(parts: DataFrame, resamples: int, cells: Column) -> DataFrame:
    """Parts with ``_r`` and ``_step``: ranges of resamples of which a task makes one, shorter where a resample costs more ``cells``."""
    step = F.greatest(F.lit(1), F.least(F.lit(-(-resamples // RANGES)), F.floor(F.lit(MOST_DRAWS) / F.greatest(cells, F.lit(1))))).cast("int")
    return parts.withColumn("_step", step).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), F.col("_step")))).repartition("_first", "_part", "_r")


def bootstrap_merged(rows: DataFrame, by: Sequence[str], block: str, value: str, statistic: Mergeable, resamples: int, seed: int, ci_level: float) -> DataFrame:
    """Per key: point, ci_lo, ci_hi and n_blocks of a mergeable statistic; nulls are left out, fewer than two blocks give no interval and no point.

    A key's values are cut into parts of at most ``PART_VALUES`` over which tasks are spread; the parts' states of
    each resample are merged in the order of the parts.  Of a ``Linear`` statistic only the blocks' sums are read.
    """
    if hasattr(statistic, "terms"):
        return bootstrap_linear(rows, by, block, value, statistic, resamples, seed, ci_level)
    placed, summary = placed_blocks(rows, by, block, value)
    ordered = numbered(placed, ["_first"], ["_i", "_v"], "_n", "bootstrap-values")
    cut = ordered.groupBy("_first", "n_blocks", F.floor(F.col("_n") / PART_VALUES).alias("_part")).agg(F.collect_list(F.struct("_i", "_v")).alias("_x"))
    parts = cut.where("n_blocks >= 2").select("_first", "n_blocks", "_part", F.col("_x._i").alias("_is"), F.col("_x._v").alias("_vs"))
    whole = parts.withColumn("_r", F.lit(-1)).withColumn("_step", F.lit(1))  # every block once: the point
    work = with_ranges(parts, resamples, F.greatest(F.col("n_blocks"), F.size("_vs") * 16)).unionByName(whole)

    def update(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                first, n, part, r, step = (row[k].as_py() for k in (0, 1, 2, 5, 6))
                blocks, values = (row[k].values.to_numpy(zero_copy_only=False) for k in (3, 4))
                some = max(1, min(SLICE, WEIGHTS // max(len(values), 1)))
                for at in range(r, min(r + step, resamples), some) if r >= 0 else (-1,):
                    count = min(some, r + step - at, resamples - at) if r >= 0 else 1
                    weights = np.stack([c[blocks] for c in block_counts(seed, range(at, at + count), n)] if r >= 0 else [np.ones(len(blocks))])
                    states = statistic.update(values, weights)
                    yield pa.RecordBatch.from_arrays([pa.array([first] * count), pa.array(range(at, at + count), pa.int64()), pa.array([part] * count), pa.array(states.tolist(), pa.list_(pa.float64()))], names=["_first", "_r", "_part", "_state"])

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for first, r, _, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.array([own])
                if (first, r) == key:
                    state = statistic.merge(state, own)
                    continue
                if key:
                    out.append((*key, float(statistic.finish(state)[0])))
                key, state = (first, r), own
            yield result(out)
        if key:
            yield result([(*key, float(statistic.finish(state)[0]))])

    states = work.select("_first", "n_blocks", "_part", "_is", "_vs", "_r", "_step").mapInArrow(update, "_first bigint, _r bigint, _part bigint, _state array<double>")
    stats = materialise(states.repartition("_first", "_r").sortWithinPartitions("_first", "_r", "_part").mapInArrow(merge, RESULT), "bootstrap-stats")
    points = stats.where("_r < 0").select("_first", F.col("_stat").alias("point"))
    ends = interval(stats.where("_r >= 0"), ["_first"], resamples, ci_level)
    return summary.join(points, "_first", "left").join(ends, "_first", "left").select(*by, "point", "ci_lo", "ci_hi", "n_blocks")


def bootstrap_linear(rows: DataFrame, by: Sequence[str], block: str, value: str, statistic: Linear, resamples: int, seed: int, ci_level: float) -> DataFrame:
    """``bootstrap_merged`` of a statistic of sums: each block becomes its sums, as in ``bootstrap_mean``, and a resample weighs these."""
    keys, sums = list(by), [f"_s{k}" for k in range(statistic.size)]
    terms = statistic.terms(F.col(value).cast("double"))
    blocks = materialise(rows.where(F.col(value).isNotNull()).groupBy(*keys, block).agg(*[F.sum(t).cast("double").alias(s) for s, t in zip(sums, terms, strict=True)]), "bootstrap-blocks")
    table = materialise(numbered(blocks, [], [*keys, block], "_at", "bootstrap-numbered"), "bootstrap-table")
    summary = materialise(table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_blocks"), F.min("_at").alias("_first"), *[F.sum(s).alias(s) for s in sums]), "bootstrap-keys")
    of = summary.where("n_blocks >= 2").select("_first", "n_blocks", *[F.col(c).alias(f"_of_{c}") for c in keys])
    placed = table.join(of, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys], F.lit(True))).withColumn("_i", F.col("_at") - F.col("_first"))
    cut = placed.groupBy("_first", "n_blocks", F.floor(F.col("_i") / MOST_BLOCKS).alias("_part")).agg(F.array_sort(F.collect_list(F.struct("_i", *sums))).alias("_x"))
    parts = cut.select("_first", "n_blocks", "_part", (F.col("_part") * MOST_BLOCKS).alias("_from"), *[F.col("_x")[s].alias(s) for s in sums])
    work = with_ranges(parts, resamples, F.col("n_blocks")).select("_first", "n_blocks", "_from", "_r", "_step", *sums)

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                first, n, begin, r, step = (x.as_py() for x in row[:5])
                states, every = np.stack([x.values.to_numpy(zero_copy_only=False) for x in row[5:]], axis=1), range(r, min(r + step, resamples))
                found = np.stack([c[begin : begin + len(states)] @ states for c in block_counts(seed, every, n)])
                yield pa.RecordBatch.from_arrays([pa.array([first] * len(every)), pa.array(every, pa.int64()), *map(pa.array, found.T.copy())], names=["_first", "_r", *sums])

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stat = statistic.finish(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]], axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.asarray(stat, dtype=np.float64))], names=["_first", "_r", "_stat"])

    states = work.mapInArrow(draw, ", ".join(["_first bigint, _r bigint", *[f"{s} double" for s in sums]])).groupBy("_first", "_r").agg(*[F.sum(s).alias(s) for s in sums])
    points = summary.where("n_blocks >= 2").select("_first", F.lit(-1).cast("bigint").alias("_r"), *sums).mapInArrow(finish, RESULT).select("_first", F.col("_stat").alias("point"))
    ends = interval(states.mapInArrow(finish, RESULT), ["_first"], resamples, ci_level)
    return summary.join(points, "_first", "left").join(ends, "_first", "left").select(*by, "point", "ci_lo", "ci_hi", "n_blocks")


RESULT = "_first bigint, _r bigint, _stat double"


def result(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate([pa.int64(), pa.int64(), pa.float64()])], names=["_first", "_r", "_stat"])


def bootstrap_quantile(rows: DataFrame, by: Sequence[str], block: str, value: str, q: float, resamples: int, seed: int, ci_level: float) -> DataFrame:
    """The same of the value at place ``floor(q * n)`` from 0 of a resample's n values in order: 0.5 is the (upper) median.

    By weighted ranks over sorted runs: a key's values are sorted once and cut into runs of ``PART_VALUES``.
    Each run gives its weight in every resample, running sums of these say in which run the place lies,
    and that run is searched.  No task holds more than a run, and none sorts a resample.  A key of
    one run is drawn for once, and not for weights and search.
    """
    placed, summary = placed_blocks(rows, by, block, value)
    ranked = materialise(numbered(placed, ["_first"], ["_v", "_i"], "_rank", "bootstrap-values"), "bootstrap-ranked")
    cut = ranked.groupBy("_first", "n_blocks", F.floor(F.col("_rank") / PART_VALUES).alias("_part")).agg(F.array_sort(F.collect_list(F.struct("_rank", "_i", "_v"))).alias("_x"))
    runs = materialise(cut.where("n_blocks >= 2").select("_first", "n_blocks", "_part", F.col("_x._i").alias("_is"), F.col("_x._v").alias("_vs")), "bootstrap-runs")

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                first, n, part, r, step = (row[k].as_py() for k in (0, 1, 2, 4, 5))
                blocks, every = row[3].values.to_numpy(zero_copy_only=False), range(r, min(r + step, resamples))
                weights = [int(c[blocks].sum()) for c in block_counts(seed, every, n)]
                yield pa.RecordBatch.from_arrays([pa.array([first] * len(every)), pa.array([part] * len(every)), pa.array(every, pa.int64()), pa.array(weights, pa.int64())], names=["_first", "_part", "_r", "_w"])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, blocks, values, asked in zip(*batch.columns, strict=True):
                n, of = n.as_py(), blocks.values.to_numpy(zero_copy_only=False)
                sorted_values = values.values.to_numpy(zero_copy_only=False)
                each = asked.as_py()
                counts = block_counts(seed, [x["_r"] for x in each], n)
                yield result([(first.as_py(), x["_r"], float(sorted_values[np.searchsorted(np.cumsum(c[of]), x["_rest"], side="right")])) for x, c in zip(each, counts, strict=True)])

    def at_once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                first, n, r, step = (row[k].as_py() for k in (0, 1, 4, 5))
                of, sorted_values = (row[k].values.to_numpy(zero_copy_only=False) for k in (2, 3))
                every, out = range(r, min(r + step, resamples)), []
                for k, c in zip(every, block_counts(seed, every, n), strict=True):
                    upto = np.cumsum(c[of])
                    out.append((first, k, float(sorted_values[np.searchsorted(upto, int(upto[-1] * q), side="right")])))
                yield result(out)

    every_run = runs
    several = materialise(runs.groupBy("_first").agg(F.count(F.lit(1)).alias("_runs")).where("_runs > 1").select("_first"), "bootstrap-several")
    whole = with_ranges(every_run.join(several, "_first", "left_anti"), resamples, F.col("n_blocks")).select("_first", "n_blocks", "_is", "_vs", "_r", "_step").mapInArrow(at_once, RESULT)
    runs = every_run.join(several, "_first", "left_semi")
    work = with_ranges(runs.select("_first", "n_blocks", "_part", "_is"), resamples, F.col("n_blocks"))
    weights = materialise(work.select("_first", "n_blocks", "_part", "_is", "_r", "_step").mapInArrow(weigh, "_first bigint, _part bigint, _r bigint, _w bigint"), "bootstrap-weights")
    each = Window.partitionBy("_first", "_r")
    before = F.coalesce(F.sum("_w").over(each.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = weights.withColumn("_before", before).withColumn("_at", F.floor(F.sum("_w").over(each) * q))
    met = at.where((F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_w")))
    asked = met.groupBy("_first", "_part").agg(F.collect_list(F.struct("_r", (F.col("_at") - F.col("_before")).alias("_rest"))).alias("_asked"))  # at most one for each resample
    stats = runs.join(asked, ["_first", "_part"]).select("_first", "n_blocks", "_is", "_vs", "_asked").mapInArrow(search, RESULT).unionByName(whole)
    sizes = ranked.groupBy("_first").agg(F.floor(F.count(F.lit(1)) * q).alias("_rank"))
    points = ranked.where("n_blocks >= 2").join(sizes, ["_first", "_rank"]).select("_first", F.col("_v").alias("point"))
    return summary.join(points, "_first", "left").join(interval(stats, ["_first"], resamples, ci_level), "_first", "left").select(*by, "point", "ci_lo", "ci_hi", "n_blocks")
