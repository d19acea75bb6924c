"""Prices of maps at their targets, and paired series of maps: from vendor candles and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import nested, text
from tidemark.operators.asof import asof_join
from tidemark.operators.interval import interval_join
from tidemark.params import IN_GAME, PRE_MATCH

PREROLL_S, TAIL_S, DEFAULT_LENGTH_S = 6 * 3600, 300, 2400
CANDLE = "struct<end_period_ts: bigint, yes_bid: struct<close_dollars: string>, yes_ask: struct<close_dollars: string>>"


def candle_mid(candle: Column) -> Column:
    """Half way between a candle's closing bid and ask; null if one cannot be read or neither is above zero."""
    bid, ask = (candle[c]["close_dollars"].try_cast("double") for c in ("yes_bid", "yes_ask"))
    return F.when((bid > 0) | (ask > 0), F.round((bid + ask) / 2, 6))


def candle_series(candles: DataFrame, by: list[str], candle: str = "candle") -> DataFrame:
    """``t``, ``price`` of every candle that can be read and has a quote."""
    rows = candles.select(*by, F.col(candle)["end_period_ts"].alias("t"), candle_mid(F.col(candle)).alias("price"))
    return rows.where("t IS NOT NULL AND price IS NOT NULL")


def candle_mid_at(targets: DataFrame, candles: DataFrame, by: list[str], at: str, candle: str = "candle") -> DataFrame:
    """Targets with the mid of the last candle at or before them: of that candle, never of an older one that is better."""
    rows = candles.select(*by, F.col(candle)["end_period_ts"].alias("t"), candle_mid(F.col(candle)).alias("price"))
    return asof_join(targets, rows, by, at, "t").drop("r_t").withColumnRenamed("r_price", "price")


def side_key(names: Column, team: Column) -> Column:
    """Index of the first name that means the team."""
    return nested.first_index(names, lambda x: F.coalesce(text.rule_match(x, team), F.lit(False)))


def targets(maps: DataFrame, checkpoint_s: int) -> DataFrame:
    """A row per map and regime: kickoff, and ``checkpoint_s`` later if the map lasted so long.  ``maps`` has ``kickoff`` and ``length_s``."""
    both = F.array(F.struct(F.lit(PRE_MATCH).alias("regime"), F.col("kickoff").alias("at")), F.struct(F.lit(IN_GAME).alias("regime"), (F.col("kickoff") + checkpoint_s).alias("at")))
    rows = maps.select("*", F.explode(both).alias("x")).select(*maps.columns, "x.*")
    return rows.where((F.col("regime") == PRE_MATCH) | (F.col("length_s") >= checkpoint_s))


def points_of(maps: DataFrame, k_prices: DataFrame, p_prices: DataFrame, checkpoint_s: int = 600) -> DataFrame:
    """Calibration points: ``match_id``, ``venue``, ``regime``, ``p``, ``y``; instants without a price give none.

    ``maps`` has ``match_id``, ``kickoff``, ``length_s``, ``team_a``, ``winner``, ``k_ticker`` and ``p_token`` (both
    of team_a, null where a venue does not have the map); prices have ``k_ticker`` or ``p_token``,
    ``t`` and ``price``, where a null price is a gap and not a reason to look back.
    """
    wanted, out = targets(maps, checkpoint_s), None
    outcome = (F.col("winner") == F.col("team_a")).cast("double")
    for venue, key, prices in (("K", "k_ticker", k_prices), ("P", "p_token", p_prices)):
        at = asof_join(wanted.where(F.col(key).isNotNull()), prices.select(key, "t", "price"), [key], "at", "t")
        rows = at.where("r_price IS NOT NULL").select("match_id", F.lit(venue).alias("venue"), "regime", F.col("r_price").alias("p"), outcome.alias("y"))
        out = rows if out is None else out.unionByName(rows)
    return out


def build_points(maps: DataFrame, k_candles: DataFrame, p_history: DataFrame, checkpoint_s: int = 600) -> DataFrame:
    """``points_of`` from raw candles (``k_ticker``, ``candle``) and histories (``p_token``, ``t``, ``price``)."""
    prices = k_candles.select("k_ticker", F.col("candle")["end_period_ts"].alias("t"), candle_mid(F.col("candle")).alias("price"))
    return points_of(maps, prices, p_history, checkpoint_s)


def map_series(maps: DataFrame, series: DataFrame, key: str, min_points: int = 2) -> DataFrame:
    """A venue's series of every map, from six hours before kickoff to five minutes after its end, with its regime.

    Maps with fewer than ``min_points`` are left out.  ``series`` has the key, ``t`` and ``price``.
    """
    end = F.col("kickoff") + F.coalesce("length_s", F.lit(DEFAULT_LENGTH_S))
    spans = maps.where(F.col(key).isNotNull()).withColumn("end", end).withColumn("_lo", F.col("kickoff") - PREROLL_S).withColumn("_hi", F.col("end") + TAIL_S)
    rows = interval_join(spans.select("match_id", "kickoff", "end", "_lo", "_hi", key), series.select(key, "t", "price"), [key], "_lo", "_hi", "t", PREROLL_S + DEFAULT_LENGTH_S + TAIL_S)
    enough = rows.groupBy("match_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_points).select("match_id")
    regime = F.when(F.col("t") < F.col("kickoff"), PRE_MATCH).when(F.col("t") < F.col("end") + 1, IN_GAME)
    return rows.join(enough, "match_id", "left_semi").select("match_id", "t", "price", regime.alias("regime"))
