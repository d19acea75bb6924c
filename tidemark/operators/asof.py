"""As-of joins as one sort and a running last value; no join on an inequality.

Rows of both sides are put together, sorted by key and time, and each left row takes the last
right row before it.  The right row is carried as a struct, so a null inside it is a value of
that row and never a reason to look further back.

A key that holds a large share of the rows would be sorted in one task.  With ``bucket`` the
time is cut into buckets, each (key, bucket) is sorted on its own, and the last row of the
buckets before comes from a table of one row per (key, bucket).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.tables import materialise


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_t: str,
    right_t: str,
    prefix: str = "r_",
    forward: bool = False,
    strict: bool = False,
    tolerance: int | None = None,
    ties: Sequence[str] = (),
    bucket: int | None = None,
) -> DataFrame:
    """Left rows with the nearest right row at or before (``forward``: at or after) their time.

    Times are longs.  ``strict`` leaves out equal times.  Of right rows at one time the last
    by ``ties`` is taken, the first if ``forward``.  ``tolerance``: farther rows give null, one exactly as
    far is taken.  Keys that are null match each other.  Right columns but the keys come with ``prefix``.
    """
    sign = -1 if forward else 1
    carried = [c for c in right.columns if c not in by]
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(by)]
    key_names = [f"_k{i}" for i in range(len(by))]
    l = left.select(*keys, (F.col(left_t) * sign).alias("_t"), F.lit(0 if strict else 1).alias("_pri"), F.struct(*left.columns).alias("_l"))
    r = right.where(F.col(right_t).isNotNull()).select(
        *keys, (F.col(right_t) * sign).alias("_t"), F.lit(1 if strict else 0).alias("_pri"), F.struct(*[F.col(t) for t in ties] or [F.lit(0).alias("none")]).alias("_tie"), F.struct(*carried).alias("_r")
    )
    rows = l.unionByName(r, allowMissingColumns=True)
    order: list[Column] = [F.col("_t"), F.col("_pri"), F.col("_tie").desc() if forward else F.col("_tie")]
    group = key_names
    if bucket:
        group = [*key_names, "_b"]
        rows = rows.withColumn("_b", F.floor(F.col("_t") / bucket))
        if forward:
            pick = F.min_by("_r", F.when(F.col("_r").isNotNull(), F.struct((-F.col("_t")).alias("t"), "_tie")))
        else:
            pick = F.max_by("_r", F.when(F.col("_r").isNotNull(), F.struct("_t", "_tie")))
        last = rows.groupBy(*group).agg(pick.alias("_r"))
        before = Window.partitionBy(*key_names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        seeds = last.withColumn("_r", F.last("_r", ignorenulls=True).over(before)).where("_r IS NOT NULL").withColumn("_t", F.lit(None).cast("bigint")).withColumn("_pri", F.lit(-1))
        rows = rows.unionByName(seeds, allowMissingColumns=True)
    running = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("_r", F.last("_r", ignorenulls=True).over(running)).where("_l IS NOT NULL")
    if tolerance is not None:
        gap = (F.col(f"_r.{right_t}") - F.col(f"_l.{left_t}")) * (1 if forward else -1)
        found = found.withColumn("_r", F.when(gap <= tolerance, F.col("_r")))
    return found.select("_l.*", *[F.col(f"_r.{c}").alias(prefix + c) for c in carried])


def asof_both(left: DataFrame, sides: dict[str, DataFrame], by: Sequence[str], left_t: str, right_t: str, ties: Sequence[str] = ()) -> DataFrame:
    """``asof_join`` with several right sides (by prefix) in one sort: left rows with the last row of each at or before their time.  A task holds a key."""
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(by)]
    key_names = [f"_k{i}" for i in range(len(by))]
    rows = left.select(*keys, F.col(left_t).alias("_t"), F.lit(1).alias("_pri"), F.struct(*left.columns).alias("_l"))
    tie = F.struct(*[F.col(t) for t in ties] or [F.lit(0).alias("none")]).alias("_tie")
    carried = {prefix: [c for c in right.columns if c not in by] for prefix, right in sides.items()}
    for prefix, right in sides.items():
        own = right.where(F.col(right_t).isNotNull()).select(*keys, F.col(right_t).alias("_t"), F.lit(0).alias("_pri"), tie, F.struct(*carried[prefix]).alias(f"_r{prefix}"))
        rows = rows.unionByName(own, allowMissingColumns=True)
    running = Window.partitionBy(*key_names).orderBy("_t", "_pri", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumns({f"_r{prefix}": F.last(f"_r{prefix}", ignorenulls=True).over(running) for prefix in sides}).where("_l IS NOT NULL")
    return found.select("_l.*", *[F.col(f"_r{prefix}.{c}").alias(prefix + c) for prefix in sides for c in carried[prefix]])


def by_size(frames: Sequence[DataFrame], by: Sequence[str], most: int) -> tuple[list[DataFrame], list[DataFrame] | None]:
    """The frames' rows of keys with at most ``most`` rows in all of them, and those of larger keys; None if no key is larger.

    The larger keys are written; there are at most as many as ``most`` goes into the number of rows.
    """
    keys = reduce(DataFrame.unionAll, [f.select(*by) for f in frames])
    large = materialise(keys.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*[F.col(c).alias(f"_of_{c}") for c in by]), "large-keys")
    if large.isEmpty():
        return list(frames), None
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by])
    return [f.join(F.broadcast(large), on, "left_anti") for f in frames], [f.join(F.broadcast(large), on, "left_semi") for f in frames]


def grid(left: DataFrame, right: DataFrame, by: Sequence[str], t: str, value: str, left_name: str, right_name: str, ties: Sequence[str] = (), bucket: int | None = None) -> DataFrame:
    """All instants of both series of a key, each once, with the value that each side has then (null before its first).

    ``bucket`` cuts a key's time as in ``asof_join``, so that no task sorts a whole key.
    """
    tie = F.struct(*[F.col(c) for c in ties] or [F.lit(0).alias("none")]).alias("_tie")
    none = F.lit(None).cast("double")
    one = left.select(*by, t, tie, F.struct(F.col(value).alias("v")).alias("_a"))
    two = right.select(*by, t, tie, F.struct(F.col(value).alias("v")).alias("_b"))
    both = one.unionByName(two, allowMissingColumns=True)
    if not bucket:
        both = both.repartition(*by)  # a task holds a key anyway: one shuffle instead of one for the instants and one for the keys
    per_instant = both.groupBy(*by, t).agg(F.max_by("_a", F.when(F.col("_a").isNotNull(), F.col("_tie"))).alias("_a"), F.max_by("_b", F.when(F.col("_b").isNotNull(), F.col("_tie"))).alias("_b"))
    group = list(by)
    if bucket:
        group = [*by, "_cell"]
        per_instant = per_instant.where(F.col(t).isNotNull()).withColumn("_cell", F.floor(F.col(t) / bucket))
        last = per_instant.groupBy(*group).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(t))).alias(c) for c in ("_a", "_b")])
        before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # a row per key and bucket
        seeds = last.withColumns({c: F.last(c, ignorenulls=True).over(before) for c in ("_a", "_b")}).where("_a IS NOT NULL OR _b IS NOT NULL")
        per_instant = per_instant.unionByName(seeds, allowMissingColumns=True)  # a seed has no time and comes first
    running = Window.partitionBy(*group).orderBy(t).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = per_instant.withColumn("_a", F.last("_a", ignorenulls=True).over(running)).withColumn("_b", F.last("_b", ignorenulls=True).over(running))
    if bucket:
        held = held.where(F.col(t).isNotNull())
    return held.select(*by, t, F.coalesce(F.col("_a.v"), none).alias(left_name), F.coalesce(F.col("_b.v"), none).alias(right_name))


def history(rows: DataFrame, by: Sequence[str], t: str, until: Column, limit: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Rows strictly before a time; with ``limit`` the oldest so many of each key."""
    seen = rows.where(F.col(t) < until)
    if limit is None:
        return seen
    return seen.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(t, *ties))).where(F.col("_n") <= limit).drop("_n")


def latest(rows: DataFrame, by: Sequence[str], t: str, until: Column, ties: Sequence[str] = ()) -> DataFrame:
    """The last row of each key strictly before a time: a partial aggregate, no sort."""
    others = [c for c in rows.columns if c not in by]
    picked = rows.where(F.col(t) < until).groupBy(*by).agg(F.max_by(F.struct(*others), F.struct(t, *ties)).alias("_r"))
    return picked.select(*by, "_r.*")
