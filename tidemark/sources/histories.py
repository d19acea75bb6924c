"""Candles and price histories of the maps that are priced, fetched from the venues by many tasks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans import series
from tidemark.sources.rest import VendorError
from tidemark.sources.venues import VenueK, VenueP

FOUND = "venue string, contract_id string, raw string, status int, reason string"
REFUSED, LEFT_OUT = "the venue refuses", "left out after a refusal"


def wanted(maps: DataFrame) -> DataFrame:
    """What to ask for: of venue K the window of each map, of venue P a token's whole history once.  ``maps`` as ``study.priced_maps`` gives them."""
    end = F.col("kickoff") + F.coalesce("length_s", F.lit(series.DEFAULT_LENGTH_S)) + series.TAIL_S
    k = maps.where("k_ticker IS NOT NULL").select(F.lit("K").alias("venue"), F.col("k_ticker").alias("contract_id"), (F.col("kickoff") - series.PREROLL_S).alias("lo"), end.alias("hi"))
    p = maps.where("p_token IS NOT NULL").select(F.lit("P").alias("venue"), F.col("p_token").alias("contract_id"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"))
    return k.unionByName(p).distinct()


def fetched(asked: DataFrame, k: VenueK, p: VenueP, tasks: int) -> DataFrame:
    """A row per request with its answer as JSON, or with the reason why there is none.

    The requests are dealt out to ``tasks`` tasks, which is how many ask at a time.  A failed request is a row; after a refusal
    (no answer, too many requests, an error of the server) a task leaves that venue alone and says so in a row for each request that it still
    had.  Write the result before using it: what reads it twice would ask twice.  The series of a ticker is its part before the first '-'.
    """

    def answer(row) -> list[dict]:  # noqa: ANN001
        if row.venue == "K":
            return k.candles(row.contract_id.split("-")[0], row.contract_id, int(row.lo), int(row.hi))
        return p.history(row.contract_id)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refused: set[str] = set()
        for row in (row for batch in batches for row in batch.itertuples(index=False)):
            raw, status, reason = None, None, LEFT_OUT
            if row.venue not in refused:
                try:
                    raw, reason = json.dumps(answer(row)), None
                except VendorError as error:
                    status, reason = error.status, REFUSED if error.refuses_all else f"no prices: {error}"
                    if error.refuses_all:
                        refused.add(row.venue)
            yield pd.DataFrame({"venue": [row.venue], "contract_id": [row.contract_id], "raw": pd.Series([raw], dtype=object), "status": pd.Series([status], dtype="Int32"), "reason": pd.Series([reason], dtype=object)})

    return asked.repartition(tasks).mapInPandas(ask, FOUND)


def prices(found: DataFrame) -> DataFrame:
    """Rows of the table of prices from the answers, one for each contract and time; items without a time, and tokens' items without a price, are left out.

    A candle that cannot be read or has no quote is a null price: a gap, not a reason to look back.
    """
    candle = found.where("venue = 'K'").select("venue", "contract_id", F.explode(F.from_json("raw", f"array<{series.CANDLE}>")).alias("c"))
    k = candle.select("venue", "contract_id", F.col("c.end_period_ts").alias("t"), series.candle_mid(F.col("c")).alias("price"))
    item = found.where("venue = 'P'").select("venue", "contract_id", F.explode(F.from_json("raw", "array<struct<t: bigint, p: double>>")).alias("c"))
    p = item.select("venue", "contract_id", "c.t", F.col("c.p").alias("price")).where("price IS NOT NULL")
    return k.unionByName(p).where("t IS NOT NULL").groupBy("venue", "contract_id", "t").agg(F.max("price").alias("price"))
