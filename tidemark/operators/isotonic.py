"""Recalibration: the increasing curve that is nearest to the outcomes, by pooling adjacent violators in parts.

Pooling in a part of the price axis never joins what the whole would keep apart, so each range
partition pools on its own and the blocks that remain are pooled once more per key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.tables import partitions

COLUMNS = ["lo", "hi", "n", "total"]


class Pool:
    """Blocks of rising mean, each (lo, hi, n, total); a block that does not rise above the one before it is merged with it."""

    def __init__(self) -> None:
        self.blocks: list[tuple[float, float, int, float]] = []

    def add(self, lo: float, hi: float, n: int, total: float) -> None:
        while self.blocks and self.blocks[-1][3] * n >= total * self.blocks[-1][2]:
            before = self.blocks.pop()
            lo, n, total = before[0], before[2] + n, before[3] + total
        self.blocks.append((lo, hi, n, total))


def _within_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by key and price; a key's blocks are given out when the next key begins."""
    key, pool = None, Pool()

    def blocks() -> pd.DataFrame:
        return pd.DataFrame(pool.blocks, columns=COLUMNS).assign(key=[key] * len(pool.blocks))[["key", *COLUMNS]]

    for batch in batches:
        for row in batch.itertuples(index=False):
            if row.key != key:
                if pool.blocks:
                    yield blocks()
                key, pool = row.key, Pool()
            pool.add(row.lo, row.hi, row.n, row.total)
    if pool.blocks:
        yield blocks()


def _across_partitions(rows: pd.DataFrame) -> pd.DataFrame:
    pool = Pool()
    for row in rows.sort_values("lo")[COLUMNS].itertuples(index=False):
        pool.add(*row)
    return pd.DataFrame(pool.blocks, columns=COLUMNS).assign(key=[rows["key"].iloc[0]] * len(pool.blocks))[["key", *COLUMNS]]


def recalibration_curve(points: DataFrame, by: Sequence[str], p: str, y: str, digits: int = 6) -> DataFrame:
    """An extension: per key the isotonic regression of ``y`` on ``p``, as blocks ``lo``, ``hi`` (prices), ``n`` and ``rate``.

    Prices are rounded to ``digits`` decimals, as the store has them: a key in [0, 1] has at most
    10^digits + 1 of them, which bounds its blocks, however many points there are.  Points are summed by
    price before the shuffle.  Equal rates are one block, so the result does not depend on partitions (outcomes
    that are whole numbers are added up exactly).  Rows whose price or outcome is null or NaN do not count; null keys are a key.
    """
    known = points.where(~(F.isnull(p) | F.isnan(F.col(p).cast("double")) | F.isnull(y) | F.isnan(F.col(y).cast("double"))))
    key, price = F.struct(*by) if by else F.struct(F.lit(0).alias("_all")), F.round(F.col(p).cast("double"), digits)
    summed = known.groupBy(key.alias("key"), price.alias("lo")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("total"))
    rows = summed.select("key", "lo", F.col("lo").alias("hi"), "n", "total")
    schema = StructType(rows.schema.fields)
    spread = rows.repartitionByRange(partitions(points.sparkSession), "key", "lo").sortWithinPartitions("key", "lo")
    blocks = spread.mapInPandas(_within_partition, schema).groupBy("key").applyInPandas(_across_partitions, schema)
    return blocks.select(*[F.col(f"key.{k}") for k in by], "lo", "hi", "n", (F.col("total") / F.col("n")).alias("rate"))
