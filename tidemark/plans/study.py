"""The gates over what is stored: each reads the store's tables and the sport's parameters and gives one artifact."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import clock
from tidemark.operators import matching, scoring
from tidemark.operators.store import Store
from tidemark.params import IN_GAME, PRE_MATCH, REFERENCE_VENUE, TARGET_VENUE, SportParams
from tidemark.plans import gates, series
from tidemark.tables import materialise

VENUES = (REFERENCE_VENUE, TARGET_VENUE)
SAMPLE = 25  # disagreements that an artifact shows


def by_day(rows: DataFrame, ts: str) -> DataFrame:
    return rows.withColumn("day", clock.day(F.col(ts)))


def listed(rows: DataFrame) -> list[dict]:
    """Rows of a small result."""
    return [r.asDict(recursive=True) for r in rows.collect()]


def neutral_maps(store: Store) -> DataFrame:
    return by_day(store.read("maps"), "start_ts")


def venue_maps(store: Store, venue: str) -> DataFrame:
    return by_day(store.read("map_results").where(F.col("venue") == venue), "ts")


def g0(store: Store, params: SportParams) -> dict:
    """Coverage of the neutral series by both venues, and the depth of the target's live books."""
    rules = params.census
    records = by_day(store.read("records"), "ts")
    covered = materialise(gates.fuzzy_coverage(by_day(store.read("matches"), "start_ts"), records, VENUES, rules), "census-series")
    depth = materialise(scoring.signal_depth(store.read("quotes"), TARGET_VENUE), "census-depth")
    there = records.select("venue", "family").distinct()
    rows = gates.census(covered, depth, there, VENUES, rules)
    sweeps = store.read("sweeps").withColumn("truncated", F.col("capped") & (F.col("oldest_ts") > F.lit(rules.window_start).cast("timestamp")))
    return {
        "rows": listed(rows), "depth": listed(depth), "existence": listed(there.orderBy("venue", "family")), "sweeps": listed(sweeps.select("venue", "n_records", "oldest_ts", "capped", "truncated")),
        "covered": [r["match_id"] for r in covered.where("covered").select("match_id").orderBy("match_id").collect()], "frozen_rules": asdict(rules),
        "caveats": ["A series is an unordered pair and a day; maps of one day are one.", "Depth is that of live books at the top, and of one moment for each contract and poll.", "A truncated sweep ended at the venue's limit inside the window: what is older is missing."],
    }


def g1(store: Store, params: SportParams) -> dict:
    """Whether both venues settle maps as the neutral source does."""
    rules = params.parity
    counts, lost = gates.fuzzy_parity(neutral_maps(store), venue_maps(store, REFERENCE_VENUE), venue_maps(store, TARGET_VENUE), params.census.match_threshold, params.census.min_acronym)
    rows = gates.parity(counts, F.col("n_void"), rules)
    store.record_discards(lost, "parity", F.col("kind"))
    sample = lost.orderBy("kind", "venue", "team_a", "team_b", "map_no").limit(SAMPLE)
    return {
        "rows": listed(rows), "disagreements": listed(sample), "frozen_rules": asdict(rules),
        "caveats": ["The neutral source says what was played and who won; agreement of the venues is what counts.", f"At most {SAMPLE} disagreements are shown; all are counted and in the discards."],
    }


def priced_maps(store: Store, params: SportParams) -> DataFrame:
    """Played maps that both venues have, with the contract of the first team at either: ``k_ticker``, ``p_token``; null where a venue's names do not say."""
    own = params.census.match_threshold, params.census.min_acronym
    k, p = (materialise(matching.settled_once(venue_maps(store, v), "day", ("team_a", "team_b")), "priced-venue") for v in VENUES)
    neutral = neutral_maps(store)
    both = matching.aligned_maps(neutral, k, p, gates.known_names([neutral, k, p], *own)).where("first_contract_id IS NOT NULL AND second_contract_id IS NOT NULL")
    for side, contract in (("first", "k_ticker"), ("second", "p_token")):
        both = matching.first_name(both, "match_id", f"{side}_names", "team_a", f"{side}_at", *own).withColumn(contract, F.get(f"{side}_contracts", F.col(f"{side}_at")))
    both = matching.name_matches(both, "team_a", "winner", "won", *own).withColumn("winner", F.when(F.col("won"), F.col("team_a")).otherwise(F.col("winner")))
    return materialise(both.select("match_id", F.unix_seconds("start_ts").alias("kickoff"), "length_s", "team_a", "winner", "k_ticker", "p_token"), "priced-maps")


def prices(store: Store, venue: str, key: str) -> DataFrame:
    return store.read("prices").where(F.col("venue") == venue).select(F.col("contract_id").alias(key), "t", "price")


def g2(store: Store, params: SportParams) -> dict:
    """Whether the reference's prices are as true as the target's."""
    rules, maps = params.calibration, priced_maps(store, params)
    points = materialise(series.points_of(maps, prices(store, "K", "k_ticker"), prices(store, "P", "p_token"), rules.checkpoint_s), "calibration-points")
    report = gates.calibration_with_interval(points, "match_id", rules, params.bootstrap)
    return {
        "rows": listed(gates.calibration(points, rules)), "venues": listed(report.drop("curve").orderBy("venue", "regime")), "curves": listed(report.select("venue", "regime", F.inline("curve")).orderBy("venue", "regime", "center")),
        "inputs": {"maps": maps.count(), "points": points.count()}, "frozen_rules": asdict(rules) | asdict(params.bootstrap),
        "caveats": ["One point for each map, venue and regime: the first team's price and whether it won.", "Prices are the middle of the book at the reference and the last price at the target, unadjusted."],
    }


def g3(store: Store, params: SportParams) -> dict:
    """Which venue's price moves first."""
    rules, maps = params.lead_lag, priced_maps(store, params).where("k_ticker IS NOT NULL AND p_token IS NOT NULL")
    k = series.map_series(maps, prices(store, "K", "k_ticker").where("price IS NOT NULL"), "k_ticker")
    p = series.map_series(maps, prices(store, "P", "p_token").where("price IS NOT NULL"), "p_token")
    k, p = (materialise(x.join(y.select("match_id").distinct(), "match_id", "left_semi"), "lead-series") for x, y in ((k, p), (p, k)))
    enough = lambda x: x.where("regime IS NOT NULL").groupBy("match_id", "regime").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select("match_id", "regime")
    both = enough(k).join(enough(p), ["match_id", "regime"]).withColumn("_in", F.lit(True))
    k, p = (x.join(both, ["match_id", "regime"], "left").withColumn("regime", F.when(F.col("_in"), F.col("regime"))).drop("_in") for x in (k, p))
    boot = params.bootstrap
    rows = gates.lead_lag(p, k, ["match_id"], "t", "price", "match_id", rules, rules.window_s, boot.resamples, boot.seed, boot.ci_level, rules.bucket_s)
    every = store.spark.createDataFrame([(PRE_MATCH,), (IN_GAME,)], "regime string").join(rows, "regime", "left").fillna({"n": 0, "n_blocks": 0})
    return {
        "rows": listed(every.orderBy("regime")), "inputs": {"maps": k.select("match_id").distinct().count()}, "frozen_rules": asdict(rules) | asdict(boot),
        "caveats": ["A lead above zero means that the target moved towards the reference.", "Series are taken as they were seen at each instant; nothing is filled in from later."],
    }


GATES: dict[str, Callable[[Store, SportParams], dict]] = {"G0": g0, "G1": g1, "G2": g2, "G3": g3}


def g4(store: Store, params: SportParams) -> dict | None:
    """The verdict from the last artifacts of the other gates; None if one is missing."""
    found = {g: store.latest_artifact(g) for g in GATES}
    if None in found.values():
        return None

    def frame(gate: str, columns: str) -> DataFrame:
        names = [c.split()[0] for c in columns.split(", ")]
        return store.spark.createDataFrame([tuple(r.get(c) for c in names) for r in found[gate]["rows"]], columns)

    verdict = gates.verdict(frame("G0", "family string, depth_pass boolean"), frame("G1", "passed boolean"), frame("G2", "regime string, passed boolean"), frame("G3", "regime string, passed boolean, leader string"))
    return {"rows": listed(verdict.orderBy("regime")), "inputs": {g: x["artifact_path"] for g, x in found.items()}, "frozen_rules": {"bounded_date": params.bounded_date}, "caveats": [f"judged again by {params.bounded_date}"]}
