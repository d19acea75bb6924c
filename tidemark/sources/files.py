"""Files: the neutral results, price histories, stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators.matching import exact_pairs

RESULTS = "gameid string, league string, date string, game string, position string, side string, teamname string, result string, gamelength string"


def results(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Team rows of results files with a header; ``file`` and ``seq`` (the place in the file) say where from.  A missing file is an error."""
    rows = spark.read.schema(RESULTS).option("header", True).option("enforceSchema", False).csv(paths)
    rows = rows.withColumn("file", F.col("_metadata.file_path")).withColumn("seq", F.monotonically_increasing_id())
    return rows.where(F.lower(F.coalesce("position", F.lit(""))) == "team")


def matches(team_rows: DataFrame) -> DataFrame:
    """One row per game of exactly two teams and one winner; games with a date that cannot be read are left out."""
    won = F.trim(F.col("result")) == "1"
    pairs = exact_pairs(team_rows, ["file", "gameid"], "seq", won, ["league", "date", "game", "teamname", "gamelength"])
    start = F.try_to_timestamp(F.col("a.date"), F.lit("yyyy-MM-dd HH:mm:ss"))
    out = pairs.select(
        F.col("gameid").alias("match_id"), text.league(F.col("a.league")).alias("league"), F.col("a.teamname").alias("team_a"), F.col("b.teamname").alias("team_b"), start.alias("start_ts"),
        F.lit(None).cast("int").alias("best_of"), F.lit("neutral_csv").alias("neutral_source"), F.when(F.col("winner_first"), F.col("a.teamname")).otherwise(F.col("b.teamname")).alias("result_winner"),
        F.col("a.game").alias("game"), F.col("a.gamelength").alias("gamelength"),
    )
    return out.where("start_ts IS NOT NULL").withColumn("result_ts", F.col("start_ts") + F.make_dt_interval(secs=F.coalesce(F.col("gamelength").try_cast("double"), F.lit(0.0)).cast("decimal(18,6)")))


def spine(found: DataFrame, leagues: tuple[str, ...], window_start: str) -> DataFrame:
    """Matches of the leagues (normalised codes) from the window's start on."""
    return found.where(F.col("league").isin(list(leagues)) & (F.col("start_ts") >= F.lit(window_start).cast("timestamp")))


def map_results(found: DataFrame) -> DataFrame:
    """Per map: the map's number (rows without one go) and the length in whole seconds (null if it cannot be read)."""
    numbered = found.withColumn("map_no", F.trim("game").try_cast("int")).where("map_no IS NOT NULL")
    return numbered.withColumn("length_s", F.col("gamelength").try_cast("double").try_cast("int")).drop("game", "gamelength")


def stored_maps(found: DataFrame) -> DataFrame:
    return found.select("match_id", "team_a", "team_b", "start_ts", "map_no", F.col("result_winner").alias("winner"), "length_s")


def price_range(spark: SparkSession, path: str, t: str, lo: int, hi: int) -> DataFrame:
    """Rows with ``lo <= t <= hi``; the bounds reach the file's statistics."""
    return spark.read.parquet(path).where(F.col(t).between(lo, hi))
