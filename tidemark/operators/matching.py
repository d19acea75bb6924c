"""Fuzzy and banded joins of fixtures: blocking by day, a pair predicate, a policy for the hit."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.functions import text
from tidemark.functions.text import letters
from tidemark.operators import nameindex
from tidemark.tables import materialise


@F.pandas_udf(DoubleType())
def spelling_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings; the order of the arguments matters."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def ruled_pairs(pairs: DataFrame, min_acronym: int = 1) -> DataFrame:
    """Pairs (``l``, ``r``) with ``same`` (null where no rule decides) and the ``forms`` of both, each derived once for each name.  Missing names are left out."""
    names = pairs.select(F.explode(F.array("l", "r")).alias("name")).where("name IS NOT NULL").distinct()
    known = names.select("name", text.forms(F.col("name")).alias("form"), letters(text.normal_name(F.col("name"))).alias("count"))
    for side, form in (("l", "_x"), ("r", "_y")):
        pairs = pairs.join(known.select(F.col("name").alias(side), F.col("form").alias(form), F.col("count").alias(f"{form}_count")), side)
    return pairs.withColumn("same", text.decided(F.col("_x"), F.col("_y"), min_acronym))


def could_be_alike(x: Column, y: Column, x_count: Column, y_count: Column, threshold: float) -> Column:
    """Whether two normal forms have enough letters in common for the ratio: it can't be above twice the common letters over all."""
    common = F.aggregate(F.zip_with(x_count, y_count, lambda p, q: F.least(p, q)), F.lit(0), lambda total, n: total + n)
    return common * 2 >= (F.length(x) + F.length(y)) * threshold


def same_of(pairs: DataFrame, threshold: float = 0.85, min_acronym: int = 1) -> DataFrame:
    """The pairs (``l``, ``r``, each once) that mean one team: by rules, and by spelling only where no rule decides and the letters leave it open."""
    ruled = ruled_pairs(materialise(pairs, "names-met"), min_acronym)
    x, y = F.col("_x.normal"), F.col("_y.normal")
    undecided = ruled.where(F.col("same").isNull() & could_be_alike(x, y, F.col("_x_count"), F.col("_y_count"), threshold))
    alike = undecided.withColumn("_ratio", spelling_ratio(x, y)).where(F.col("_ratio") >= threshold)
    return ruled.where("same").select("l", "r").unionByName(alike.select("l", "r"))


def name_matches(pairs: DataFrame, a: str, b: str, out: str = "same", threshold: float = 0.85, min_acronym: int = 1) -> DataFrame:
    """Adds ``out``: whether two name columns mean one team.  Each distinct pair is decided once; missing names match nothing."""
    same = same_of(pairs.select(F.col(a).alias("l"), F.col(b).alias("r")).distinct(), threshold, min_acronym)
    return with_same(pairs, a, b, out, same)


def with_same(pairs: DataFrame, a: str, b: str, out: str, same: DataFrame) -> DataFrame:
    known = same.select(F.col("l").alias("_l"), F.col("r").alias("_r"), F.lit(True).alias("_same"))
    joined = pairs.join(known, (F.col(a) == F.col("_l")) & (F.col(b) == F.col("_r")), "left")
    return joined.withColumn(out, F.coalesce("_same", F.lit(False))).drop("_l", "_r", "_same")


def pairs_of(rows: DataFrame, sides: Sequence[tuple[str, str]]) -> DataFrame:
    """The distinct pairs (``l``, ``r``) of the given pairs of columns; missing names are left out."""
    both = F.explode(F.array(*[F.struct(F.col(x).alias("l"), F.col(y).alias("r")) for x, y in sides])).alias("_x")
    return rows.select(both).select("_x.*").where("l IS NOT NULL AND r IS NOT NULL").distinct()


def same_pair(rows: DataFrame, one: Sequence[str], other: Sequence[str], out: str, same: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds ``out``: whether two pairs of name columns are one fixture in either order.  ``same`` picks those that mean one team from pairs (``l``, ``r``)."""
    sides = [(a, b) for a in one for b in other]
    known = same(pairs_of(rows, sides))
    for k, (a, b) in enumerate(sides):
        rows = with_same(rows, a, b, f"_s{k}", known)
    return rows.withColumn(out, (F.col("_s0") & F.col("_s3")) | (F.col("_s1") & F.col("_s2"))).drop("_s0", "_s1", "_s2", "_s3")


def banded_candidates(left: DataFrame, right: DataFrame, left_day: str, right_day: str, equal: Sequence[str] = (), days: int = 1, prefix: str = "r_") -> DataFrame:
    """Pairs whose days differ by at most ``days`` and whose ``equal`` columns agree, by an equality join on the day.

    ``dshift`` is the right day minus the left day.
    """
    shifts = F.sequence(F.lit(-days), F.lit(days))
    spread = left.withColumn("dshift", F.explode(shifts)).withColumn("_day", F.date_add(F.col(left_day), F.col("dshift")))
    renamed = right.select(*[F.col(c).alias(prefix + c) for c in right.columns])
    on = F.col("_day") == F.col(prefix + right_day)
    for c in equal:
        on &= F.col(c) == F.col(prefix + c)
    return spread.join(renamed, on).drop("_day")


def same_names(left: DataFrame, right: DataFrame, threshold: float = 0.85, min_acronym: int = 1) -> DataFrame:
    """``l``, ``r``: names of ``left`` and ``right`` (``_day``, ``name``) that are seen on one day and mean one team, by rules or spelling.

    Only names that share an entry of the index (``operators.nameindex``) on a day are looked at.
    """
    return same_of(nameindex.candidates(left, right, threshold), threshold, min_acronym)


def named(rows: DataFrame, day: str, names: Sequence[str], days: int = 0) -> DataFrame:
    """``_day``, ``name``: names of a table's rows on their days and ``days`` around them."""
    spread = rows.withColumn("_day", F.explode(F.transform(F.sequence(F.lit(-days), F.lit(days)), lambda x: F.date_add(F.col(day), x))))
    return spread.select("_day", F.explode(F.array(*names)).alias("name")).where("name IS NOT NULL")


def fuzzy_candidates(
    left: DataFrame, right: DataFrame, day: str, teams: Sequence[str], equal: Sequence[str] = (), days: int = 1, prefix: str = "r_", threshold: float = 0.85, min_acronym: int = 1, same: DataFrame | None = None
) -> DataFrame:
    """Pairs of fixtures within ``days`` days whose ``equal`` columns agree and whose two ``teams`` mean the same in either order.

    Names are decided once for each pair of names that meet on a day (``same``, if that has
    been done already); fixtures are then joined by equality on day, ``equal`` and both
    names, so pairs of fixtures that do not match are never made.  ``dshift`` is the right day
    minus the left day.  Fixtures that match in both orders come twice; missing names match
    nothing.
    """
    a, b = teams
    spread = left.withColumn("dshift", F.explode(F.sequence(F.lit(-days), F.lit(days)))).withColumn("_day", F.date_add(F.col(day), F.col("dshift")))
    renamed = right.select(*[F.col(c).alias(prefix + c) for c in right.columns])
    if same is None:
        same = same_names(named(left, day, teams, days), named(right, day, teams), threshold, min_acronym)
    for team, out in ((a, "_x"), (b, "_y")):
        spread = spread.join(same.select(F.col("l").alias(team), F.col("r").alias(out)), team)
    either = renamed.withColumn("_p", F.col(prefix + a)).withColumn("_q", F.col(prefix + b))
    either = either.unionByName(renamed.withColumn("_p", F.col(prefix + b)).withColumn("_q", F.col(prefix + a)))
    on = (F.col("_day") == F.col(prefix + day)) & (F.col("_x") == F.col("_p")) & (F.col("_y") == F.col("_q"))
    for c in equal:
        on &= F.col(c) == F.col(prefix + c)
    return spread.join(either, on).select(*left.columns, "dshift", *renamed.columns)


CLAIM_SIDES = {"aa": ("a_1", "a_2"), "bb": ("b_1", "b_2"), "ab": ("a_1", "b_2"), "ba": ("b_1", "a_2"), "ww": ("winner_1", "winner_2")}


def same_claim(pairs: DataFrame, threshold: float = 0.85, min_acronym: int = 1) -> DataFrame:
    """Adds ``same_claim`` to pairs of contracts (``a_1``, ``b_1``, ``map_1``, ``winner_1`` and ``_2``): one map of one fixture and, where both are settled, one winner."""
    same = same_of(pairs_of(pairs, list(CLAIM_SIDES.values())), threshold, min_acronym)
    numbered = pairs
    for name, (x, y) in CLAIM_SIDES.items():
        numbered = with_same(numbered, x, y, f"_{name}", same)
    fixture = (F.col("_aa") & F.col("_bb")) | (F.col("_ab") & F.col("_ba"))
    settled = F.col("winner_1").isNotNull() & F.col("winner_2").isNotNull()
    found = F.col("map_1").eqNullSafe(F.col("map_2")) & fixture & (~settled | F.col("_ww"))
    return numbered.withColumn("same_claim", found).drop(*[f"_{n}" for n in CLAIM_SIDES])


def first_name(rows: DataFrame, key: str, names: str, team: str, out: str, threshold: float = 0.85, min_acronym: int = 1) -> DataFrame:
    """Adds ``out``: the place of the first of ``names`` that means the team, by rules or spelling; null without one.  ``key`` identifies rows."""
    each = rows.select(key, team, F.posexplode(names).alias("_pos", "_name"))
    hit = name_matches(each, team, "_name", "_same", threshold, min_acronym).where("_same").groupBy(key).agg(F.min("_pos").alias(out))
    return rows.join(hit, key, "left")


def settled_once(rows: DataFrame, day: str, teams: Sequence[str], seq: str = "seq") -> DataFrame:
    """One row for each unordered pair of normalised names, day and ``map_no``: the first settled one, else the first.  ``slot`` is the first place."""
    pair = text.pair_key(text.normal_name(F.col(teams[0])), text.normal_name(F.col(teams[1])))
    found = prefer_settled(rows.withColumn("_pair", pair), ["_pair", day, "map_no"], "winner", seq)
    return found.select(*rows.columns, "slot")


def aligned_maps(neutral: DataFrame, first: DataFrame, second: DataFrame, same: DataFrame) -> DataFrame:
    """Played maps with the map that each venue has for it: ``first_*`` and ``second_*``, null where a venue has none.

    ``neutral`` has ``match_id``, ``day``, ``team_a``, ``team_b``, ``map_no``; the venues' rows come from
    ``settled_once``.  Of several hits the one on the earliest day, then the first listed, counts.
    ``same`` has the names that mean one team.
    """
    out = neutral
    for name, rows in (("first", first), ("second", second)):
        hits = fuzzy_candidates(neutral, rows, "day", ("team_a", "team_b"), ["map_no"], 1, f"{name}_", same=same)
        columns = [f"{name}_{c}" for c in rows.columns if c not in ("day", "map_no", "slot")]
        out = first_match(out, hits, ["match_id"], ["dshift", f"{name}_slot"], columns)
    return out


def fuzzy_void_breaks(venue: DataFrame, neutral: DataFrame, same: DataFrame) -> DataFrame:
    """Settled venue maps that were not played although another map of the fixture was, within a day.  ``seq`` identifies the venue's rows."""
    settled = venue.where("winner IS NOT NULL")
    played = fuzzy_candidates(settled, neutral, "day", ("team_a", "team_b"), ["map_no"], 1, "n_", same=same).select("seq").distinct()
    rest = settled.join(played, "seq", "left_anti")
    met = fuzzy_candidates(rest, neutral, "day", ("team_a", "team_b"), [], 1, "n_", same=same).select("seq").distinct()
    return rest.join(met, "seq", "left_semi")


def first_match(left: DataFrame, hits: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Every left row with the columns of its first hit by ``order``, null without one.  ``key`` identifies left rows."""
    picked = hits.groupBy(*key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_hit"))
    return left.join(picked, list(key), "left").select(*left.columns, *[F.col(f"_hit.{c}").alias(c) for c in columns])


def banded_first_match(left: DataFrame, right: DataFrame, day: str, equal: Sequence[str], days: int, prefix: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Every left row with ``columns`` (with ``prefix``) of the first right row within ``days`` days whose ``equal`` columns agree: the earliest day, then the least ``order``.

    Right rows are spread over the days around theirs and the first for each day is taken before the join, so no pairs of rows are made.
    """
    wanted = list(dict.fromkeys([order, *columns]))
    spread = right.withColumn("_shift", F.explode(F.sequence(F.lit(-days), F.lit(days)))).withColumn("_of_day", F.date_sub(F.col(day), F.col("_shift")))
    first = spread.groupBy(*[F.col(c).alias(f"_of_{c}") for c in equal], "_of_day").agg(F.min(F.struct("_shift", *wanted)).alias("_hit"))
    on = reduce(Column.__and__, [F.col(c) == F.col(f"_of_{c}") for c in equal], F.col(day) == F.col("_of_day"))
    return left.join(first, on, "left").select(*left.columns, *[F.col(f"_hit.{c}").alias(prefix + c) for c in columns])


def fuzzy_first_match(left: DataFrame, right: DataFrame, day: str, teams: Sequence[str], equal: Sequence[str], days: int, prefix: str, order: str, columns: Sequence[str], same: DataFrame | None = None) -> DataFrame:
    """Every left row with ``dshift``, ``order`` and ``columns`` (of ``right``, with ``prefix``) of its first hit among ``fuzzy_candidates``: the earliest day, then the least ``order``.

    Rows of one day, ``equal`` and names have the same hits, so of each such fixture of the right the first row only and each of
    the left once are joined: the work does not grow with the pairs of rows.
    """
    key = [day, *equal, *teams]
    wanted = list(dict.fromkeys([order, *columns]))
    first = right.groupBy(*key).agg(F.min_by(F.struct(*wanted), F.col(order)).alias("_r")).select(*key, "_r.*")
    fixtures = left.select(*key).distinct()
    hits = fuzzy_candidates(fixtures, first, day, teams, equal, days, prefix, same=same)
    picked = ["dshift", *[prefix + c for c in wanted]]
    best = hits.groupBy(*key).agg(F.min_by(F.struct(*picked), F.struct("dshift", prefix + order)).alias("_hit"))
    renamed = best.select("_hit", *[F.col(c).alias(f"_of_{c}") for c in key])
    on = [F.col(c) == F.col(f"_of_{c}") for c in key]
    return left.join(renamed, on, "left").select(*left.columns, *[F.col(f"_hit.{c}").alias(c) for c in picked])


def first_ruled_name(rows: DataFrame, names: str, team: str, out: str, min_acronym: int = 1) -> DataFrame:
    """Adds ``out``: the place of the first of ``names`` (an array) that means the team by the rules; null without one.

    Each distinct list with its team is looked at once, and each name's forms are derived once.
    """
    asked = materialise(rows.select(F.col(names).alias("_names"), F.col(team).alias("r")).distinct().withColumn("_id", F.monotonically_increasing_id()), "names-asked")
    each = asked.select("_id", "r", F.posexplode("_names").alias("_pos", "l"))
    pairs = materialise(each.select("l", "r").where("l IS NOT NULL AND r IS NOT NULL").distinct(), "names-met")
    same = ruled_pairs(pairs, min_acronym).where("same").select("l", "r")
    hit = each.join(same, ["l", "r"]).groupBy("_id").agg(F.min("_pos").alias(out))
    known = asked.join(hit, "_id").select(F.col("_names").alias("_of_names"), F.col("r").alias("_of_team"), out)
    return rows.join(known, (F.col(names) == F.col("_of_names")) & (F.col(team) == F.col("_of_team")), "left").drop("_of_names", "_of_team")


def prefer_settled(rows: DataFrame, key: Sequence[str], winner: str, seq: str) -> DataFrame:
    """One row per key: the first with a winner, else the first; ``slot`` is the key's first position."""
    others = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct(F.col(winner).isNull(), F.col(seq))).alias("_r"), F.min(seq).alias("slot"))
    return picked.select(*key, "_r.*", "slot")


def void_breaks(venue: DataFrame, neutral: DataFrame, with_map: Sequence[str], without_map: Sequence[str], winner: str) -> DataFrame:
    """Settled venue rows without a neutral row of the same map but with one of the same pair."""
    settled = venue.where(F.col(winner).isNotNull())
    return settled.join(neutral.select(*with_map).distinct(), list(with_map), "left_anti").join(neutral.select(*without_map).distinct(), list(without_map), "left_semi")


def present_everywhere(rows: DataFrame, key: Sequence[str], venue: str, venues: Sequence[str]) -> DataFrame:
    """Keys that every venue has (division)."""
    wanted = rows.where(F.col(venue).isin(list(venues)))
    return wanted.groupBy(*key).agg(F.count_distinct(venue).alias("_n")).where(F.col("_n") == len(venues)).select(*key)


def parity_counts(aligned: DataFrame, by: Sequence[str], neutral: str, first: str, second: str) -> DataFrame:
    """Counts and rates of agreement; 0 for no aligned rows in the venues' rates, null in the common rate."""
    n = F.count(F.lit(1))
    agree = (F.col(first) == F.col(second)) & (F.col(first) == F.col(neutral))
    with_first, with_second = F.col(first) == F.col(neutral), F.col(second) == F.col(neutral)
    counts = [n.alias("n_aligned"), F.count_if(agree).alias("n_agree"), F.count_if(with_first).alias("n_first"), F.count_if(with_second).alias("n_second")]
    counted = (aligned.groupBy(*by) if by else aligned.groupBy()).agg(*counts)
    has = F.col("n_aligned") > 0
    return counted.select(
        *by, "n_aligned", "n_agree", F.when(has, F.col("n_agree") / F.col("n_aligned")).alias("pass_rate"),
        F.when(has, F.col("n_first") / F.col("n_aligned")).otherwise(0.0).alias("first_rate"), F.when(has, F.col("n_second") / F.col("n_aligned")).otherwise(0.0).alias("second_rate"),
    )


def exact_pairs(rows: DataFrame, group: Sequence[str], seq: str, won: Column, columns: Sequence[str]) -> DataFrame:
    """Groups of exactly two rows with exactly one winner: ``a``, ``b`` (in order of ``seq``) and ``winner_first``."""
    sides = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), *columns, won.alias("won"))))
    # A group of more than two never becomes a list: the counts come first and leave it out.
    fit = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.count_if(won).alias("_w")).where("_n = 2 AND _w = 1").select(*group)
    folded = rows.join(fit, list(group), "left_semi").groupBy(*group).agg(sides.alias("_s"))
    return folded.select(*group, F.get("_s", F.lit(0)).alias("a"), F.get("_s", F.lit(1)).alias("b"), F.get("_s", F.lit(0))["won"].alias("winner_first"))


def series_first(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
