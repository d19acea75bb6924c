"""The five gates: each a plan that ends in one small frame, one row per regime or family."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import bootstrap, divergence, matching, scoring
from tidemark.params import Bootstrap, Calibration, Census, LeadLag, Parity
from tidemark.tables import materialise


def any_known(flag: Column) -> Column:
    """True if any is true, false if all known are false, null if none is known."""
    return F.bool_or(flag)


def coverage(spine: DataFrame, records: DataFrame, key: Sequence[str], day: str, venues: Sequence[str], families: Sequence[str], days: int = 1) -> DataFrame:
    """Series of the spine (one row per key and day) with ``covered`` and, per family, ``covered_<family>``.

    A series is covered if every venue has a record of the same key within ``days`` days.
    Many-to-one hits are allowed; hits are reduced to one row per series and venue at once.
    """
    # Both tables by key and day, records on the days around theirs too: one shuffle, and no pairs of a series and its records.
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in [*key, day]])
    near = records.where(known).withColumn(day, F.explode(F.transform(F.sequence(F.lit(-days), F.lit(days)), lambda x: F.date_add(F.col(day), x))))
    kinds = [(v, f) for f in (None, *families) for v in venues]
    seen = [(F.col("venue") == v) & (F.lit(True) if f is None else F.col("family") == f) for v, f in kinds]
    one, no = F.lit(1), F.lit(0)
    rows = spine.select(*key, day, one.alias("_series"), *[no.alias(f"_{i}") for i in range(len(kinds))])
    rows = rows.unionByName(near.select(*key, day, no.alias("_series"), *[F.when(x, one).otherwise(no).alias(f"_{i}") for i, x in enumerate(seen)]))
    found = rows.groupBy(*key, day).agg(F.max("_series").alias("_series"), *[F.max(f"_{i}").alias(f"_{i}") for i in range(len(kinds))]).where("_series = 1")
    has = lambda family: reduce(Column.__and__, [F.col(f"_{i}") == 1 for i, (_, f) in enumerate(kinds) if f == family])
    return found.select(*key, day, has(None).alias("covered"), *[(has(None) & has(f)).alias(f"covered_{f}") for f in families])


def fuzzy_coverage(spine: DataFrame, records: DataFrame, venues: Sequence[str], params: Census) -> DataFrame:
    """Series of the spine with ``covered`` and, per family, ``covered_<family>``, by fuzzy names within the day tolerance.

    ``spine`` has ``match_id``, ``team_a``, ``team_b``, ``day``; maps of one unordered pair on one day are one
    series, named by the first match.  ``records`` have ``venue``, ``family``, ``team_a``, ``team_b``, ``day``.
    """
    pair = text.pair_key(text.normal_name(F.col("team_a")), text.normal_name(F.col("team_b")))
    series = matching.series_first(spine.withColumn("_pair", pair), ["_pair", "day"], ["match_id"]).drop("_pair")
    hits = matching.fuzzy_candidates(series, records, "day", ("team_a", "team_b"), (), params.day_tolerance, "r_", params.match_threshold, params.min_acronym)
    flags = hits.groupBy("match_id").agg(
        F.count_distinct("r_venue").alias("_all"), *[F.count_distinct(F.when(F.col("r_family") == f, F.col("r_venue"))).alias(f"_{f}") for f in params.families]
    )
    joined = series.join(flags, "match_id", "left")
    has = lambda c: F.coalesce(F.col(c) == len(venues), F.lit(False))
    return joined.select("match_id", "team_a", "team_b", "day", has("_all").alias("covered"), *[(has("_all") & has(f"_{f}")).alias(f"covered_{f}") for f in params.families])


def census(covered: DataFrame, depth: DataFrame, existence: DataFrame, venues: Sequence[str], params: Census) -> DataFrame:
    """G0, one row per family: counts, ratio, whether both venues have it, and the verdicts on coverage and depth.

    ``depth`` has ``median_usd`` (per regime), ``existence`` the distinct ``venue``, ``family``.
    """
    totals = covered.agg(F.count(F.lit(1)).alias("n_series"), F.count_if("covered").alias("n_covered"), *[F.count_if(f"covered_{f}").alias(f"n_{f}") for f in params.families])
    depth_pass = depth.agg(any_known(F.col("median_usd") >= params.min_depth_usd).alias("depth_pass"))
    there = existence.groupBy("family").agg((F.count_distinct("venue") == len(venues)).alias("both_venues"))
    rows = totals.crossJoin(depth_pass).select(
        "n_series", "n_covered", "depth_pass", F.when(F.col("n_series") > 0, F.col("n_covered") / F.col("n_series")).otherwise(0.0).alias("coverage"), (F.col("n_covered") >= params.min_covered).alias("coverage_pass"),
        F.inline(F.array(*[F.struct(F.lit(f).alias("family"), F.col(f"n_{f}").alias("n_family")) for f in params.families])),
    )
    joined = rows.join(there, "family", "left").withColumn("both_venues", F.coalesce("both_venues", F.lit(False)))
    return joined.withColumn("go_on", F.col("both_venues") & (F.col("n_family") >= params.min_covered))


def known_names(tables: Sequence[DataFrame], threshold: float, min_acronym: int) -> DataFrame:
    """``l``, ``r``: names of teams and winners in any of the tables, seen within two days of each other, that mean one team; written."""
    columns = ["team_a", "team_b", "winner"]
    everyone = materialise(reduce(DataFrame.unionByName, [t.select("day", *columns) for t in tables]).distinct(), "names-seen")
    return materialise(matching.same_names(matching.named(everyone, "day", columns, 2), matching.named(everyone, "day", columns), threshold, min_acronym), "names-same")


def fuzzy_parity(neutral: DataFrame, first: DataFrame, second: DataFrame, threshold: float = 0.85, min_acronym: int = 1) -> tuple[DataFrame, DataFrame]:
    """Counts of agreement on played maps (one row, with ``n_void``), and the disagreements: ``kind``, ``venue``, teams, ``map_no``, winners.

    ``neutral`` has ``match_id``, ``day``, ``team_a``, ``team_b``, ``map_no``, ``winner``; the venues' rows the same and ``seq``.
    """
    first, second = (materialise(matching.settled_once(rows, "day", ("team_a", "team_b")), "parity-venue") for rows in (first, second))
    neutral = materialise(neutral, "parity-neutral")
    same = known_names([neutral, first, second], threshold, min_acronym)
    aligned = matching.aligned_maps(neutral.where("winner IS NOT NULL"), first, second, same).where("first_winner IS NOT NULL AND second_winner IS NOT NULL")
    for x, y, out in (("first_winner", "second_winner", "agree"), ("first_winner", "winner", "with_first"), ("second_winner", "winner", "with_second")):
        aligned = aligned.join(same.select(F.col("l").alias(x), F.col("r").alias(y), F.lit(True).alias(out)), [x, y], "left").fillna(False, out)
    aligned = materialise(aligned.select("match_id", "team_a", "team_b", "map_no", "winner", "first_winner", "second_winner", "agree", "with_first", "with_second"), "parity-aligned")
    none = F.lit(None).cast("string")
    lost = [aligned.where("NOT agree").select(F.lit("winner_mismatch").alias("kind"), none.alias("venue"), "team_a", "team_b", "map_no", "winner", "first_winner", "second_winner")]
    for venue, rows in (("K", first), ("P", second)):
        breaks = matching.fuzzy_void_breaks(rows, neutral, same)
        lost.append(breaks.select(F.lit("void_break").alias("kind"), F.lit(venue).alias("venue"), "team_a", "team_b", "map_no", none.alias("winner"), none.alias("first_winner"), none.alias("second_winner")))
    lost = materialise(lost[0].unionByName(lost[1]).unionByName(lost[2]), "parity-lost")
    n, has = F.count(F.lit(1)), F.col("n_aligned") > 0
    counts = aligned.agg(n.alias("n_aligned"), F.count_if("agree").alias("n_agree"), F.count_if("with_first").alias("n_first"), F.count_if("with_second").alias("n_second"))
    counts = counts.crossJoin(lost.agg(F.count_if(F.col("kind") == "void_break").alias("n_void")))  # single rows
    rate = lambda c: F.when(has, F.col(c) / F.col("n_aligned"))
    return counts.select("n_aligned", "n_agree", "n_void", F.coalesce(rate("n_agree"), F.lit(0.0)).alias("pass_rate"), rate("n_first").alias("first_rate"), rate("n_second").alias("second_rate")), lost


def parity(counts: DataFrame, n_void: Column, params: Parity) -> DataFrame:
    """G1: passes with a high enough rate and no void breaks; null with too few aligned maps."""
    enough = F.col("n_aligned") >= params.min_aligned
    return counts.withColumn("n_void", n_void).withColumn("passed", F.when(enough, (F.col("pass_rate") >= params.min_pass_rate) & (F.col("n_void") == 0)))


def calibration_with_interval(points: DataFrame, block: str, params: Calibration, boot: Bootstrap) -> DataFrame:
    """The calibration report of each venue and regime with the interval of its Brier score over whole blocks (matches)."""
    report = scoring.calibration_report(points, ["venue", "regime"], "p", "y", params.buckets)
    errors = points.withColumn("_e", scoring.squared_error(F.col("p"), F.col("y")))
    ends = bootstrap.bootstrap_mean(errors, ["venue", "regime"], block, "_e", boot.resamples, boot.seed, boot.ci_level)
    return report.join(ends.select("venue", "regime", F.col("ci_lo").alias("brier_lo"), F.col("ci_hi").alias("brier_hi"), "n_blocks"), ["venue", "regime"])


def calibration(points: DataFrame, params: Calibration, reference: str = "K", target: str = "P") -> DataFrame:
    """G2, one row per regime: errors of both venues and the verdict, null with too few points of either."""
    report = scoring.calibration_report(points, ["venue", "regime"], "p", "y", params.buckets)
    compared = scoring.compare(report, "regime", "venue", reference, target, params.pass_margin)
    least = report.groupBy("regime").agg(F.min("n").alias("least_n"), F.sum("n").alias("n_points"))
    return compared.join(least, "regime").withColumn("passed", F.when(F.col("least_n") >= params.min_points, F.col("passed")))


def lead_lag(p: DataFrame, k: DataFrame, by: Sequence[str], t: str, value: str, block: str, params: LeadLag, window: int, resamples: int, seed: int, ci_level: float, bucket: int | None = None, reference: str = "K", target: str = "P") -> DataFrame:
    """G3, one row per regime (a column of both series and of ``by``): divergences, signed lead with its interval, leader, verdict.

    ``bucket`` cuts the time of large keys, which else are one task's.  Each regime's grid starts cold; the lead is measured on the whole series.
    """
    leads = divergence.confirmed(p, k, by, ["regime"], t, value, params.threshold, params.confirmations, window, bucket)  # what lies outside all regimes shows the convergence only
    report = bootstrap.bootstrap_mean(leads, ["regime"], block, "lead", resamples, seed, ci_level)
    report = report.withColumn("leader", divergence.leader(F.col("ci_lo"), F.col("ci_hi"), reference, target))
    enough = F.col("n") >= params.min_divergences
    return report.withColumn("passed", F.when(enough, F.coalesce(F.col("leader") == reference, F.lit(False))))


def verdict(census_rows: DataFrame, parity_row: DataFrame, calibration_rows: DataFrame, lead_rows: DataFrame, live_corroborated: bool = False) -> DataFrame:
    """G4, one row per regime, each with the overall verdict."""
    depth = census_rows.agg(F.bool_or("depth_pass").alias("depth_pass"))
    same_claim = parity_row.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("parity_pass"))
    rows = calibration_rows.select("regime", F.col("passed").alias("calibration_pass")).join(lead_rows.select("regime", F.col("passed").alias("lead_pass"), "leader"), "regime", "full")
    rows = rows.crossJoin(depth).crossJoin(same_claim)  # single rows
    valid = F.coalesce(F.col("parity_pass") & F.col("calibration_pass") & F.col("lead_pass"), F.lit(False))
    rows = rows.withColumn("reference_valid", valid).withColumn("tradeable", F.col("reference_valid") & F.coalesce("depth_pass", F.lit(False)) & F.lit(live_corroborated))
    overall = rows.agg(F.bool_or("tradeable").alias("_go"), F.bool_or("reference_valid").alias("_valid"))
    named = F.when(F.col("_go"), "GO").when(F.col("_valid"), "CONDITIONAL").otherwise("KILL")
    blockers = F.filter(F.array(F.when(~F.coalesce("depth_pass", F.lit(False)), "depth"), F.when(~F.lit(live_corroborated), "no live corroboration")), lambda x: x.isNotNull())
    listed = F.when(F.col("_valid") & ~F.col("_go"), blockers).otherwise(F.array().cast("array<string>"))
    return rows.crossJoin(overall).withColumn("verdict", named).withColumn("blockers", listed).drop("_go", "_valid")
