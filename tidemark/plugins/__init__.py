"""A sport is a plugin whose classifiers are Column expressions."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession

from tidemark.functions import text
from tidemark.params import SportParams
from tidemark.sources import files


class Sport(Protocol):
    key: str
    params: SportParams
    series: dict[str, str]
    tag: str

    def family(self, title: Column) -> Column: ...
    def is_prop(self, title: Column) -> Column: ...
    def is_first_tier(self, title: Column) -> Column: ...
    def matches(self, spark: SparkSession, paths: list[str]) -> DataFrame: ...
    def map_results(self, spark: SparkSession, paths: list[str]) -> DataFrame: ...


class Esports:
    """Matches of several maps between two teams."""

    key, tag = "lol", "league-of-legends"
    params = SportParams("lol")
    series: dict[str, str] = {"KXLOL": "series_winner", "KXLOLMAP": "map_winner"}

    def family(self, title: Column) -> Column:
        return text.family(title)

    def is_prop(self, title: Column) -> Column:
        return text.is_prop(title)

    def is_first_tier(self, title: Column) -> Column:
        return text.is_first_tier(title)

    def matches(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        found = files.matches(files.results(spark, paths))
        return files.spine(found, self.params.census.leagues, self.params.census.window_start)

    def map_results(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        return files.map_results(self.matches(spark, paths))


SPORTS: dict[str, Sport] = {"lol": Esports()}


def sport(key: str) -> Sport:
    if key not in SPORTS:
        raise KeyError(f"no sport {key}; there are {', '.join(sorted(SPORTS))}")
    return SPORTS[key]
