"""Confirmed divergences of two series, and which of them leads.

The rule is greedy: what an instant means depends on the runs before it, so it is a fold over
the sorted grid of one key, in the JVM.  With ``bucket`` no task holds a key: stretches of the
grid become maps of states (``operators.stretches``), the maps are applied in order, which
reads one row per stretch, and each stretch is then folded from the state that enters it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import asof, stretches
from tidemark.tables import materialise

LARGE = 1 << 16  # instants of a key that one task folds; only the time of larger keys is cut

STATE_IN = "struct<len: int, sign: int, t0: bigint, p0: double, k0: double, until: bigint>"
STATE = "struct<len: int, sign: int, t0: bigint, p0: double, k0: double, until: bigint, found: array<struct<t_start: bigint, p_start: double, k_start: double, gap: double>>>"


def _step(threshold: float, need: int, window: int):  # noqa: ANN202
    def step(acc: Column, x: Column) -> Column:
        gap = x["k"] - x["p"]
        sign = F.signum(gap).cast("int")
        counts = (F.abs(gap) >= threshold) & (sign != 0) & ((acc["len"] == 0) | (acc["sign"] == sign))
        first = acc["len"] == 0
        t0, p0, k0 = (F.when(first, x[a]).otherwise(acc[b]) for a, b in (("t", "t0"), ("p", "p0"), ("k", "k0")))
        emits = acc["len"] + 1 >= need
        found = F.concat(acc["found"], F.array(F.struct(t0.alias("t_start"), p0.alias("p_start"), k0.alias("k_start"), (k0 - p0).alias("gap"))))
        zero = F.lit(0)

        def state(length, s, t, p, k, until, out) -> Column:  # noqa: ANN001
            return F.struct(length.alias("len"), s.alias("sign"), t.alias("t0"), p.alias("p0"), k.alias("k0"), until.alias("until"), out.alias("found")).cast(STATE)

        reset = state(zero, zero, acc["t0"], acc["p0"], acc["k0"], acc["until"], acc["found"])
        more = state(acc["len"] + 1, sign, t0, p0, k0, acc["until"], acc["found"])
        emitted = state(zero, zero, t0, p0, k0, t0 + window, found)
        waits = (x["t"] <= acc["until"]) | x["p"].isNull() | x["k"].isNull()
        return F.when(waits, acc).when(counts & emits, emitted).when(counts, more).otherwise(reset)

    return step


def entering_states(grid: DataFrame, by: Sequence[str], t: str, p: str, k: str, threshold: float, need: int, window: int) -> DataFrame:
    """``by``, ``_cell`` and the state (``stretches.STATE``) with which the rule enters each cell of a key's grid; the grid has ``_cell``, and both sides are seen."""
    keys = [f"{c} {grid.schema[c].dataType.simpleString()}" for c in [*by, "_cell"]]
    n = len(keys)
    cells = grid.select(*by, "_cell", F.col(t).cast("bigint").alias("_t"), F.col(p).cast("double").alias("_p"), F.col(k).cast("double").alias("_k"))
    names = [*by, "_cell"]

    def table(rows: list[tuple], like: pa.Schema, kinds: Sequence[pa.DataType], columns: str) -> pa.RecordBatch:
        types = [*[like.field(i).type for i in range(n)], *kinds]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)], names=[*names, *[c.split()[0] for c in columns.split(", ")]])

    def seen(batches: Iterable[pa.RecordBatch], known: list[pa.Schema]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known[:] = [batch.schema]
            yield batch

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        like, out = [], []
        for key, columns in stretches.groups(seen(batches, like), n):
            out.append((*key, *stretches.rows_of(stretches.folded(*columns, threshold, need, window))))
            if len(out) >= 256:
                yield table(out, like[0], stretches.MAP_TYPES, stretches.MAP)
                out = []
        if out:
            yield table(out, like[0], stretches.MAP_TYPES, stretches.MAP)

    def compose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, stretches.State()
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[: n - 1] != key:
                    key, state = row[: n - 1], stretches.State()
                out.append((*row[:n], *stretches.fields(state)))
                state = stretches.applied(stretches.stretch_of(row[n:]), state, need, window)
            yield table(out, batch.schema, stretches.STATE_TYPES, stretches.STATE)

    maps = cells.repartition(*by, "_cell").sortWithinPartitions(*by, "_cell", "_t").mapInArrow(fold, ", ".join([*keys, stretches.MAP]))
    return maps.repartition(*by).sortWithinPartitions(*by, "_cell").mapInArrow(compose, ", ".join([*keys, stretches.STATE]))


def divergences(grid: DataFrame, by: Sequence[str], t: str, p: str, k: str, threshold: float, need: int, window: int, bucket: int | None = None) -> DataFrame:
    """Confirmed divergences of the grid: ``t_start``, ``p_start``, ``k_start``, ``gap`` for each key.

    ``need`` instants in a row with a gap of at least the threshold and one sign confirm the
    run; its first instant opens a window in which nothing counts.  An instant of the other
    sign ends a run and opens none.  Instants at which a side is unseen are passed over.
    ``bucket`` cuts a key's time into stretches; without it a key's grid must fit into one task.
    """
    zero = F.lit(0).cast("bigint")
    instant = F.struct(F.col(t).cast("bigint").alias("t"), F.col(p).cast("double").alias("p"), F.col(k).cast("double").alias("k"))
    grid, group = grid.where(F.col(p).isNotNull() & F.col(k).isNotNull()), list(by)
    begin = F.lit(None).cast(STATE_IN)
    rows = grid
    if bucket:
        group = [*by, "_cell"]
        rows = grid.withColumn("_cell", F.floor(F.col(t) / bucket))
        state = F.struct(F.col("_len").alias("len"), F.col("_sign").alias("sign"), F.col("_t").alias("t0"), F.col("_p").alias("p0"), F.col("_k").alias("k0"), F.col("_until").alias("until")).cast(STATE_IN)
        states = entering_states(rows, by, t, p, k, threshold, need, window).select(*group, F.lit(None).cast("struct<t: bigint, p: double, k: double>").alias("_x"), state.alias("_begin"))
        rows = rows.select(*group, instant.alias("_x"), begin.alias("_begin")).unionByName(states)
    else:
        rows = rows.select(*group, instant.alias("_x"), begin.alias("_begin"))
    cold = F.struct(F.lit(0).alias("len"), F.lit(0).alias("sign"), zero.alias("t0"), F.lit(0.0).alias("p0"), F.lit(0.0).alias("k0"), F.lit(stretches.LONG_AGO).alias("until")).cast(STATE_IN)
    series = rows.groupBy(*group).agg(F.array_sort(F.collect_list("_x")).alias("_s"), F.coalesce(F.max("_begin"), cold).alias("_begin"))
    start = F.struct(*[F.col(f"_begin.{c}").alias(c) for c in ("len", "sign", "t0", "p0", "k0", "until")], F.array().alias("found")).cast(STATE)
    return series.select(*by, F.inline(F.aggregate("_s", start, _step(threshold, need, window), lambda acc: acc["found"])))


def convergence(found: DataFrame, target: DataFrame, reference: DataFrame, by: Sequence[str], t: str, value: str, window: int, ties: Sequence[str] = (), bucket: int | None = None) -> DataFrame:
    """Adds ``lead``: sign of the gap times the movement of both series from the start to the window's end; 0 if a side is missing."""
    ends = found.withColumn("_end", F.col("t_start") + window)
    columns = [*by, t, value, *ties]
    if bucket:
        at = asof.asof_join(ends, target.select(*columns), by, "_end", t, "_p_", ties=ties, bucket=bucket)
        at = asof.asof_join(at, reference.select(*columns), by, "_end", t, "_k_", ties=ties, bucket=bucket)
    else:
        at = asof.asof_both(ends, {"_p_": target.select(*columns), "_k_": reference.select(*columns)}, by, "_end", t, ties)
    moved = F.col(f"_p_{value}") - F.col("p_start") + F.col(f"_k_{value}") - F.col("k_start")
    return at.select(*found.columns, F.coalesce(F.when(F.col("gap") > 0, moved).otherwise(-moved), F.lit(0.0)).alias("lead"))


def confirmed(p: DataFrame, k: DataFrame, by: Sequence[str], within: Sequence[str], t: str, value: str, threshold: float, need: int, window: int, bucket: int | None = None, lead: bool = True) -> DataFrame:
    """Divergences of two series of a key (``by``), each part of it (``within``, null: outside all) on its own, and with ``lead`` that of the whole series.

    A key is folded by one task as it is, as most keys have few instants and cutting these costs far
    more than it spares; with ``bucket`` the time of keys of more than ``LARGE`` instants is cut.
    """
    keys = [*by, *within]
    p, k = (x.select(*keys, t, value).where(F.col(t).isNotNull()) for x in (p, k))
    small, large = asof.by_size([p, k], by, LARGE) if bucket else ([p, k], None)
    parts = []
    for sides, cut in ((small, None), (large, bucket)):
        if sides is None:
            continue
        during = [x.where(" AND ".join(f"{c} IS NOT NULL" for c in within)) if within else x for x in sides]
        found = divergences(asof.grid(*during, keys, t, value, "p", "k", bucket=cut), keys, t, "p", "k", threshold, need, window, cut)
        if lead:
            if cut:  # read more than once
                found = materialise(found, "divergences")
            found = convergence(found, *[x.select(*by, t, value) for x in sides], by, t, value, window, bucket=cut)
        parts.append(found)
    return reduce(DataFrame.unionByName, parts)


def leader(ci_lo: Column, ci_hi: Column, reference: str, target: str) -> Column:
    """Who leads by the sign of the interval; null if it holds zero or is missing."""
    return F.when(ci_lo > 0, reference).when(ci_hi < 0, target)


def lagged_correlation(grid: DataFrame, by: Sequence[str], t: str, p: str, k: str, lags: Sequence[int]) -> DataFrame:
    """An extension: correlation of the changes of ``k`` with those of ``p`` so many instants later; null where one side's do not vary."""
    from pyspark.sql import Window

    def correlation(x: str, y: str) -> Column:
        """``F.corr`` fails under ANSI rules where a side has no variance."""
        a, b = (F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(c)) for c in (x, y))
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(a) * F.stddev_pop(b))

    w = Window.partitionBy(*by).orderBy(t)
    moves = grid.withColumn("_dp", F.col(p) - F.lag(p).over(w)).withColumn("_dk", F.col(k) - F.lag(k).over(w))
    shifted = moves.select(*by, F.col(t), "_dk", *[F.lead("_dp", n).over(w).alias(f"_p{n}") for n in lags])
    wide = shifted.groupBy(*by).agg(*[correlation("_dk", f"_p{n}").alias(f"_c{n}") for n in lags])
    return wide.select(*by, F.inline(F.array(*[F.struct(F.lit(n).alias("lag"), F.col(f"_c{n}").alias("corr")) for n in lags])))
