"""Pinned behaviours of the point-in-time operators."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import asof, bootstrap, divergence, matching, scoring
from tidemark.params import Calibration


def quotes(spark, rows):
    return spark.createDataFrame(rows, "c string, t long, mid double, seq int")


def asked(spark, *at, c="k"):
    return spark.createDataFrame([(c, t) for t in at], "c string, at long")


def mids(df):
    return {r["at"]: r["r_mid"] for r in df.collect()}


def test_strict_never_reads_the_same_instant(spark):
    q = quotes(spark, [("k", 100, 0.60, 0), ("k", 105, 0.62, 1)])
    assert mids(asof.asof_join(asked(spark, 105, 100, 106), q, ["c"], "at", "t", strict=True)) == {105: 0.60, 100: None, 106: 0.62}
    assert mids(asof.asof_join(asked(spark, 105), q.where("c = 'none'"), ["c"], "at", "t")) == {105: None}


def test_inclusive_takes_the_boundary_and_a_null_value_is_no_gap(spark):
    q = quotes(spark, [("k", 100, 0.42, 0), ("k", 160, None, 1), ("k", 220, 0.92, 2)])
    assert mids(asof.asof_join(asked(spark, 100, 50, 200, 220), q, ["c"], "at", "t")) == {100: 0.42, 50: None, 200: None, 220: 0.92}


def test_forward_with_tolerance(spark):
    q = quotes(spark, [("k", 610, 0.5, 0)])
    assert mids(asof.asof_join(asked(spark, 0), q, ["c"], "at", "t", forward=True, tolerance=60)) == {0: None}
    assert mids(asof.asof_join(asked(spark, 0, 10, 611), q, ["c"], "at", "t", forward=True, tolerance=610)) == {0: 0.5, 10: 0.5, 611: None}


def test_ties_take_the_last_in_order_forward_the_first(spark):
    q = quotes(spark, [("k", 5, 0.1, 0), ("k", 5, 0.2, 1)])
    assert mids(asof.asof_join(asked(spark, 9), q, ["c"], "at", "t", ties=["seq"])) == {9: 0.2}
    assert mids(asof.asof_join(asked(spark, 1), q, ["c"], "at", "t", forward=True, ties=["seq"])) == {1: 0.1}


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("bucket", [None, 7, 1000])
def test_asof_equals_a_scan(spark, forward, strict, bucket):
    rng = random.Random(5)
    data = [(rng.choice("ab"), rng.randrange(200), rng.random(), i) for i in range(120)]
    q = quotes(spark, data).repartition(5)
    left = spark.createDataFrame([(c, t) for c in "abc" for t in range(-3, 205, 4)], "c string, at long")
    got = {(r.c, r.at): r.r_seq for r in asof.asof_join(left, q, ["c"], "at", "t", forward=forward, strict=strict, ties=["seq"], bucket=bucket).collect()}
    for (c, t), seq in got.items():
        if forward:
            fit = [(x[1], x[3]) for x in data if x[0] == c and (x[1] > t or x[1] == t and not strict)]
            want = min(fit)[1] if fit else None
        else:
            fit = [(x[1], x[3]) for x in data if x[0] == c and (x[1] < t or x[1] == t and not strict)]
            want = max(fit)[1] if fit else None
        assert seq == want


def test_history_reads_the_oldest(spark):
    q = quotes(spark, [("k", t, 0.0, t) for t in range(10)])
    assert sorted(r.t for r in asof.history(q, ["c"], "t", F.lit(8), 3).collect()) == [0, 1, 2]
    assert asof.latest(q, ["c"], "t", F.lit(8)).first().t == 7


def points(spark, prices, outcomes):
    return spark.createDataFrame([("K", "pre", f"m{i}", p, float(y)) for i, (p, y) in enumerate(zip(prices, outcomes, strict=True))], "venue string, regime string, block string, p double, y double")


def test_perfect_calibration(spark):
    rows = points(spark, [0.5] * 4, [1, 0, 1, 0])
    curve = scoring.reliability(rows, ["venue"], "p", "y", [0.5])
    assert curve.first().realised == 0.5
    assert scoring.expected_calibration_error(curve, ["venue"]).first().ece == 0.0
    report = scoring.calibration_report(rows, ["venue", "regime"], "p", "y", Calibration().buckets).first()
    assert (report.n, report.brier, len(report.curve)) == (4, 0.25, 1)


def test_nearest_center_ties_go_down_and_ends_clamp(spark):
    row = spark.range(1).select(*[scoring.nearest_center(F.lit(p), [0.25, 0.5, 0.75]).alias(f"c{i}") for i, p in enumerate((0.375, 0.0, 1.0))]).first()
    assert tuple(row) == (0.25, 0.25, 0.75)


def test_scores_of_nothing_are_null(spark):
    row = points(spark, [], []).agg(scoring.brier(F.col("p"), F.col("y")).alias("b"), scoring.log_loss(F.col("p"), F.col("y")).alias("l")).first()
    assert row.b is None and row.l is None


def test_nearest_rank_is_half_even(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3)] + [("b", 5.0), ("b", 6.0)], "g string, x double")
    by_count = {r.g: (r.q, r.m) for r in scoring.nearest_rank_by_count(rows, ["g"], "x", {"q": 0.25, "m": 0.5}).collect()}
    assert by_count == {"a": (1.0, 2.0), "b": (5.0, 5.0)}
    assert {r.g: r.m for r in rows.groupBy("g").agg(scoring.nearest_rank(F.col("x"), 0.5).alias("m")).collect()} == {"a": 2.0, "b": 5.0}


def test_bootstrap_moves_blocks_together_and_repeats(spark):
    rows = spark.createDataFrame([("r", b, v) for b, v in (("m1", 0.1), ("m1", 0.2), ("m2", 0.3), ("m3", 0.4), ("m3", 0.5))], "regime string, block string, v double")
    first, again = (bootstrap.bootstrap_mean(rows.repartition(n), ["regime"], "block", "v", 500, 1, 0.95).first() for n in (1, 4))
    assert tuple(first)[1:] == pytest.approx(tuple(again)[1:], rel=1e-12)  # the order of sums shows in the last digit
    assert first.n_blocks == 3 and first.ci_lo <= first.point <= first.ci_hi
    general = bootstrap.bootstrap_merged(rows, ["regime"], "block", "v", bootstrap.Moments(lambda n, total, squares: total / n), 500, 1, 0.95).first()
    assert (general.ci_lo, general.ci_hi) == (pytest.approx(first.ci_lo), pytest.approx(first.ci_hi))
    one = bootstrap.bootstrap_mean(rows.where("block = 'm1'"), ["regime"], "block", "v", 500, 1, 0.95).first()
    assert (one.point, one.ci_lo, one.ci_hi, one.n_blocks) == (None, None, None, 1)


def confirmed(grid, thr, need, window):
    """The rule by runs: each instant is a sign or nothing; take the earliest run of ``need`` equal signs that begins where none is under way."""
    seen = [(t, p, k) for t, p, k in grid if p is not None and k is not None]
    sign = ["" if abs(k - p) < thr or k == p else "+" if k > p else "-" for _, p, k in seen]
    out, at = [], 0
    while at < len(seen):
        length = next((n for n in range(need) if at + n >= len(sign) or sign[at + n] != sign[at]), need) if sign[at] else 0
        if length < need:
            at += length + 1  # the instant that ends a run opens none
            continue
        t, p, k = seen[at]
        out.append((t, round(k - p, 9)))
        at = next((i for i in range(at + need, len(seen)) if seen[i][0] > t + window), len(seen))
    return out


def test_divergences_equal_the_rule(spark):
    rng = random.Random(9)
    grids = {f"m{g}": [(t * 10, rng.choice([None, 0.5, 0.5, 0.52]), rng.choice([0.5, 0.58, 0.6, 0.61, 0.4])) for t in range(80)] for g in range(12)}
    rows = spark.createDataFrame([(g, *x) for g, xs in grids.items() for x in xs], "m string, t long, p double, k double")
    got = {g: [] for g in grids}
    for r in divergence.divergences(rows, ["m"], "t", "p", "k", 0.05, 3, 60).collect():
        got[r.m].append((r.t_start, round(r.gap, 9)))
    assert {g: sorted(x) for g, x in got.items()} == {g: confirmed(x, 0.05, 3, 60) for g, x in grids.items()}


def test_a_sign_flip_ends_a_run_and_opens_none(spark):
    grid = [(0, 0.5, 0.6), (1, 0.5, 0.6), (2, 0.5, 0.4), (3, 0.5, 0.4), (4, 0.5, 0.4), (5, 0.5, 0.4)]
    rows = spark.createDataFrame([("m", *x) for x in grid], "m string, t long, p double, k double")
    assert [r.t_start for r in divergence.divergences(rows, ["m"], "t", "p", "k", 0.05, 3, 100).collect()] == [3]


def series(spark, rows):
    return spark.createDataFrame([("m", t, p) for t, p in rows], "m string, t long, price double")


def test_lead_is_positive_when_the_target_follows(spark):
    k = series(spark, [(0, 0.50), (100, 0.70), (200, 0.70), (300, 0.70), (400, 0.70)])
    p = series(spark, [(0, 0.50), (100, 0.50), (200, 0.50), (300, 0.50), (400, 0.70)])
    found = divergence.divergences(asof.grid(p, k, ["m"], "t", "price", "p", "k"), ["m"], "t", "p", "k", 0.02, 3, 300)
    leads = divergence.convergence(found, p, k, ["m"], "t", "price", 300).collect()
    assert len(leads) == 1 and leads[0].lead == pytest.approx(0.2)
    flat = asof.grid(series(spark, [(t, 0.50) for t in range(0, 600, 60)]), series(spark, [(t, 0.51) for t in range(0, 600, 60)]), ["m"], "t", "price", "p", "k")
    assert divergence.divergences(flat, ["m"], "t", "p", "k", 0.02, 3, 300).count() == 0


def test_leader_by_the_sign_of_the_interval(spark):
    row = spark.range(1).select(*[divergence.leader(F.lit(lo), F.lit(hi), "K", "P").alias(n) for n, lo, hi in (("a", 0.1, 0.2), ("b", -0.2, -0.1), ("c", -0.1, 0.1))]).first()
    assert tuple(row) == ("K", "P", None)


def test_first_match_prefers_the_day_before(spark):
    left = spark.sql("SELECT 1 AS id, DATE '2025-01-10' AS day")
    right = spark.sql("SELECT * FROM VALUES (7, DATE '2025-01-10'), (9, DATE '2025-01-09'), (3, DATE '2025-01-12') AS t(seq, day)")
    hits = matching.banded_candidates(left, right, "day", "day")
    assert matching.first_match(left, hits, ["id"], ["dshift", "r_seq"], ["r_seq"]).first().r_seq == 9
    none = matching.first_match(left, hits.where("false"), ["id"], ["dshift", "r_seq"], ["r_seq"])
    assert none.first().r_seq is None


def test_dedup_prefers_a_settled_row_and_keeps_the_first_place(spark):
    rows = spark.createDataFrame([("k", None, 1), ("k", "x", 2), ("k", "y", 3), ("l", None, 4)], "key string, winner string, seq int")
    got = {r.key: (r.winner, r.seq, r.slot) for r in matching.prefer_settled(rows, ["key"], "winner", "seq").collect()}
    assert got == {"k": ("x", 2, 1), "l": (None, 4, 4)}


def test_parity_counts_and_void_breaks(spark):
    rows = spark.createDataFrame([("a", "a", "a")] * 40, "n string, k string, p string")
    r = matching.parity_counts(rows, [], "n", "k", "p").first()
    assert (r.n_aligned, r.n_agree, r.pass_rate, r.first_rate) == (40, 40, 1.0, 1.0)
    empty = matching.parity_counts(rows.where("false"), [], "n", "k", "p").first()
    assert (empty.n_aligned, empty.pass_rate, empty.first_rate) == (0, None, 0.0)
    venue = spark.createDataFrame([("t", 1, "a"), ("t", 2, "a"), ("u", 2, "a"), ("t", 3, None)], "pair string, map_no int, winner string")
    neutral = spark.createDataFrame([("t", 1)], "pair string, map_no int")
    voids = matching.void_breaks(venue, neutral, ["pair", "map_no"], ["pair"], "winner").collect()
    assert [(v.pair, v.map_no) for v in voids] == [("t", 2)]


def test_every_venue_must_have_it(spark):
    rows = spark.createDataFrame([("g1", "K"), ("g2", "K"), ("g1", "P"), ("g1", "P")], "game string, venue string")
    assert [r.game for r in matching.present_everywhere(rows, ["game"], "venue", ["K", "P"]).collect()] == ["g1"]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("JD Gaming", "JDG", True), ("Anyone's Legend", "AL", True), ("Hanwha Life Esports", "HLE", True), ("Gen.G", "Gen.G Esports", True), ("T1", "T1", True), ("T1", "Gen.G", False),
        ("Bilibili Gaming", "Top Esports", False), ("T1 Academy", "T1", False), ("", "T1", False), ("Dplus Kia", "DplusKia", True), ("fnatic", "fnattic", True),
    ],
)
def test_team_names(spark, a, b, same):
    pairs = spark.createDataFrame([(a, b)], "a string, b string")
    assert matching.name_matches(pairs, "a", "b").first().same is same


def test_only_undecided_names_reach_python(spark):
    pairs = spark.createDataFrame([("JD Gaming", "JDG"), ("abcdefgh", "abcdefgx"), (None, "x")], "a string, b string")
    assert [r.same for r in matching.name_matches(pairs, "a", "b").orderBy(F.col("a").asc_nulls_first()).collect()] == [False, True, True]


def _duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in ("part", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_fixture_match_takes_all_brands(spark, sf):
    from tidemark.queries import names

    got = [tuple(r) for r in names.fixture_match(spark, sf).collect()]
    brands = {r[0] for r in _duck(sf).sql("SELECT DISTINCT p_brand FROM part GROUP BY p_brand HAVING count(*) > 1").fetchall()}
    assert {r[0] for r in got} == brands and len(brands) > 2


def test_parity_gate_fails_below_95_percent(spark, sf, monkeypatch):
    from tidemark.queries import records

    rows = [("a", "a", "a") if i < 36 else ("a", "b", "a") for i in range(40)]  # 90 percent agree
    monkeypatch.setattr(records, "aligned_three_way", lambda *_: spark.createDataFrame(rows, "winner string, k_winner string, p_winner string"))
    monkeypatch.setattr(records, "voids", lambda *_: spark.createDataFrame([], "event_id long"))
    found = records.gate_g1(spark, sf).first()
    assert (found.n_aligned, found.n_agree, found.n_void, found.passed) == (40, 36, 0, False)


def test_the_draw_of_an_array_is_that_of_its_places():
    for n in (1, 7, 400):
        places = bootstrap.mix(np.arange(1, n + 1, dtype=np.int64))
        for r in range(5):
            assert (bootstrap.mix(bootstrap.mix(r + 20260709) ^ places) % n).tolist() == [bootstrap.draw_of(20260709, r, k, n) for k in range(n)]


def test_names_are_decided_as_pair_by_pair(spark):
    """Forms derived once and letters counted first: the same pairs as rules and ratio on all pairs."""
    rng = random.Random(6)
    words = ["Red", "Comet", "Blue", "Harbor", "Stone", "Team", "Esports", "Academy", "KT", "T1"]
    made = {" ".join(rng.sample(words, rng.randrange(1, 4))) for _ in range(40)}
    typos = {n[:i] + rng.choice("abx ") + n[i + 1 :] for n in made for i in [rng.randrange(len(n))]}
    names = sorted({*made, *typos, "", "'", "É", "Red’s"})
    pairs = spark.createDataFrame([(x, y) for x in names for y in names], "l string, r string")
    got = {tuple(r) for r in matching.same_of(pairs, 0.85).collect()}
    each = pairs.withColumn("rule", text.rule_match(F.col("l"), F.col("r"))).withColumn("nl", text.normal_name(F.col("l"))).withColumn("nr", text.normal_name(F.col("r"))).collect()
    by_ratio = {(r.l, r.r) for r in each if r.rule is None and SequenceMatcher(None, r.nl, r.nr).ratio() >= 0.85}
    assert got == by_ratio | {(r.l, r.r) for r in each if r.rule} and len(by_ratio) >= 10


def test_hopeless_spellings_never_reach_python(spark):
    pairs = spark.createDataFrame([("abcdef", "abcdeg"), ("abcdef", "uvwxyz"), ("abcdef", "abcdefghijklm qrstuv")], "l string, r string")
    ruled = matching.ruled_pairs(pairs, 2).where("same IS NULL")
    bound = matching.could_be_alike(F.col("_x.normal"), F.col("_y.normal"), F.col("_x_count"), F.col("_y_count"), 0.8)
    assert [(r.l, r.r) for r in ruled.where(bound).collect()] == [("abcdef", "abcdeg")]


def test_draws_are_even_and_resamples_unlike():
    n = 50
    draws = [[bootstrap.draw_of(20260709, r, k, n) for k in range(n)] for r in range(2000)]
    counts = [0] * n
    for i in (i for d in draws for i in d):
        counts[i] += 1
    expected = 2000
    assert sum((c - expected) ** 2 / expected for c in counts) < 90  # chi square of 49 degrees of freedom
    distinct = [len(set(d)) for d in draws]
    assert abs(sum(distinct) / 2000 / n - (1 - (1 - 1 / n) ** n)) < 0.01
    for shift in range(1, 5):  # no resample is another one moved on
        assert max(sum(x == y for x, y in zip(draws[i][shift:], draws[j], strict=False)) for i in range(60) for j in range(60) if i != j) < 12


def test_bootstrap_queries_have_10000_resamples(spark, sf, monkeypatch):
    from tidemark.params import Bootstrap
    from tidemark.queries import market, records

    assert Bootstrap().resamples == market.RESAMPLES == 10_000
    asked = []
    real = bootstrap.interval
    monkeypatch.setattr(bootstrap, "interval", lambda stats, keys, resamples, *rest: asked.append(resamples) or real(stats, keys, resamples, *rest))
    for query in (market.block_bootstrap_ci, market.bootstrap_median, market.lead_lag_report, records.gate_g3, records.verdict):
        query(spark, sf)
    assert asked == [10_000] * 5


def test_quantiles_of_any_group(spark):
    rng = random.Random(4)
    groups = {g: [rng.choice([1.0, 2.5, 7.0, rng.random() * 9]) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 7), (None, 40))}
    rows = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs] + [("d", None)], "g string, x double").repartition(7)
    got = {r.g: (r.q, r.m) for r in scoring.quantiles_by_count(rows, ["g"], "x", {"q": 0.25}, "m").collect()}
    want = {}
    for g, xs in groups.items():
        xs, n = sorted(xs), len(xs)
        want[g] = (xs[round(0.25 * (n - 1))], (xs[(n - 1) // 2] + xs[n // 2]) / 2)
    assert got == want


def fixtures(spark, rows):
    return spark.createDataFrame(rows, "seq long, team_a string, team_b string, day string, map_no int, winner string").withColumn("day", F.col("day").cast("date"))


def test_fuzzy_fixtures_match_in_either_order_within_a_day(spark):
    left = fixtures(spark, [(1, "Bilibili Gaming", "Hanwha Life Esports", "2026-07-12", 1, None), (2, "G2 Esports", "T1", "2026-07-08", 1, None), (3, "fnatic", "T1", "2026-07-08", 1, None), (4, None, "T1", "2026-07-08", 1, None)])
    right = fixtures(spark, [(10, "HLE", "Bilibili Gaming", "2026-07-13", 1, None), (11, "Bilibili Gaming", "HLE", "2026-07-14", 1, None), (12, "G2", "T1", "2026-07-08", 2, None), (13, "T1", "fnattic", "2026-07-07", 1, None), (14, "T1", "Gen.G", "2026-07-08", 1, None)])
    with_map = matching.fuzzy_candidates(left, right, "day", ("team_a", "team_b"), ["map_no"])
    assert sorted((r.seq, r.r_seq, r.dshift) for r in with_map.distinct().collect()) == [(1, 10, 1), (3, 13, -1)]  # 3: by spelling
    without = matching.fuzzy_candidates(left, right, "day", ("team_a", "team_b"))
    assert sorted({(r.seq, r.r_seq) for r in without.collect()}) == [(1, 10), (2, 12), (3, 13)]


def test_coverage_needs_both_venues_and_counts_a_series_once(spark):
    from tidemark.params import Census
    from tidemark.plans import gates

    spine = spark.sql("""SELECT id AS match_id, a AS team_a, b AS team_b, CAST(d AS DATE) AS day FROM VALUES
        ('g1', 'Bilibili Gaming', 'Hanwha Life Esports', '2026-07-12'), ('g2', 'G2 Esports', 'T1', '2026-07-08'), ('m1', 'T1', 'Gen.G', '2026-07-10'), ('m2', 'Gen.G', 'T1', '2026-07-10') AS t(id, a, b, d)""")
    records = spark.sql("""SELECT v AS venue, f AS family, a AS team_a, b AS team_b, CAST(d AS DATE) AS day FROM VALUES
        ('K', 'map_winner', 'Bilibili Gaming', 'Hanwha Life Esports', '2026-07-12'), ('K', 'map_winner', 'G2', 'T1', '2026-07-08'), ('P', 'map_winner', 'Bilibili Gaming', 'HLE', '2026-07-12'),
        ('K', 'map_winner', 'T1', 'Gen.G', '2026-07-10'), ('P', 'series_winner', 'T1', 'Gen.G', '2026-07-10') AS t(v, f, a, b, d)""")
    got = {r.match_id: (r.covered, r.covered_series_winner, r.covered_map_winner) for r in gates.fuzzy_coverage(spine, records, ("K", "P"), Census()).collect()}
    assert got == {"g1": (True, False, True), "g2": (False, False, False), "m1": (True, False, False)}


def test_one_claim(spark):
    columns = "a_1 string, b_1 string, map_1 int, winner_1 string, a_2 string, b_2 string, map_2 int, winner_2 string"
    base = ("Bilibili Gaming", "HLE", 1, "Bilibili Gaming", "Hanwha Life Esports", "Bilibili Gaming", 1, "Bilibili Gaming")
    rows = [base, (*base[:2], 2, *base[3:]), (*base[:7], "Hanwha Life Esports"), (*base[:7], None), (*base[:4], "T1", *base[5:])]
    got = matching.same_claim(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + columns)).orderBy("i").collect()
    assert [r.same_claim for r in got] == [True, False, False, True, False]


def maps_of(spark, numbers, winner="T1", teams=("T1", "Gen.G"), key="seq", first=0):
    rows = [(first + i, *teams, "2026-07-10", n, winner) for i, n in enumerate(numbers)]
    return fixtures(spark, rows).withColumnRenamed("seq", key)


def test_fuzzy_parity_counts_and_void_breaks(spark):
    from tidemark.params import Parity
    from tidemark.plans import gates

    neutral = maps_of(spark, range(1, 41), key="match_id")
    k, p = maps_of(spark, range(1, 41), teams=("Gen.G Esports", "T1")), maps_of(spark, range(1, 41), first=500)
    counts, lost = gates.fuzzy_parity(neutral, k, p)
    row = gates.parity(counts, F.col("n_void"), Parity()).first()
    assert (row.n_aligned, row.n_agree, row.n_void, row.pass_rate, row.passed) == (40, 40, 0, 1.0, True) and lost.count() == 0
    k = k.unionByName(maps_of(spark, [41], first=90))  # settled, never played
    p = p.where("map_no <> 7").unionByName(maps_of(spark, [7], winner="Gen.G", first=950))
    counts, lost = gates.fuzzy_parity(neutral, k, p)
    row = gates.parity(counts, F.col("n_void"), Parity()).first()
    assert (row.n_aligned, row.n_agree, row.n_void, row.passed) == (40, 39, 1, False)
    assert sorted((r.kind, r.venue, r.map_no) for r in lost.collect()) == [("void_break", "K", 41), ("winner_mismatch", None, 7)]


def test_the_first_of_the_names_is_found_by_rule_or_spelling(spark):
    rows = spark.createDataFrame([("a", ["T1", "Gen.G Esports"], "Gen.G"), ("b", ["fnattic", "fnatic"], "fnatic"), ("c", ["x"], "Gen.G"), ("d", None, "T1")], "id string, names array<string>, team string")
    got = {r.id: r["at"] for r in matching.first_name(rows, "id", "names", "team", "at").collect()}
    assert got == {"a": 1, "b": 0, "c": None, "d": None}


def test_orphans_are_lines_without_any_order(spark, sf, tmp_path):
    from tidemark.queries import records

    assert records.foreign_key_orphans(spark, sf).count() == 0  # no line of the tables lacks its order
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    orders.where("o_orderkey % 7 <> 0").write.parquet(f"{tmp_path}/orders.parquet")
    want = lines.where("l_orderkey % 7 = 0").groupBy("l_returnflag").agg(F.count(F.lit(1)), F.min("l_orderkey")).collect()
    assert want and sorted(map(tuple, records.foreign_key_orphans(spark, str(tmp_path)).collect())) == sorted(map(tuple, want))


def test_moves_without_variance_have_no_correlation(spark):
    flat, falls = [("flat", t, 0.5, 0.5 + 0.1 * (t % 2)) for t in range(9)], [("falls", t, 1.0 - t, float(t * t)) for t in range(9)]
    grid = spark.createDataFrame([*flat, *falls, ("two", 0, 0.1, 0.2), ("two", 1, 0.3, 0.1), ("even", 0, 0.5, 0.5)], "m string, t long, p double, k double")
    varied = grid.unionByName(spark.createDataFrame([("varied", t, float(t**3), float(t**2 % 5)) for t in range(9)], grid.schema))
    got = {(r.m, r.lag): r["corr"] for r in divergence.lagged_correlation(varied, ["m"], "t", "p", "k", [0, 1]).collect()}
    assert {m for (m, _), c in got.items() if c is not None} == {"varied"}
    dk, dp = (np.diff([f(t) for t in range(9)]) for f in (lambda t: float(t**2 % 5), lambda t: float(t**3)))
    assert got["varied", 0] == pytest.approx(np.corrcoef(dk, dp)[0, 1]) and got["varied", 1] == pytest.approx(np.corrcoef(dk[:-1], dp[1:])[0, 1])


def test_first_match_of_fixtures_joins_each_fixture_once(spark, monkeypatch):
    left = fixtures(spark, [(i, "T1", "Gen.G", "2026-07-10", 1, None) for i in range(200)] + [(900, "T1", None, "2026-07-10", 1, None), (901, "T1", "Gen.G", "2026-07-10", None, None)]).withColumnRenamed("seq", "match_id")
    right = fixtures(spark, [(i, "Gen.G Esports", "T1", f"2026-07-{9 + i % 4:02d}", 1, str(i)) for i in range(37, 240)])
    seen, real = [], matching.fuzzy_candidates
    monkeypatch.setattr(matching, "fuzzy_candidates", lambda a, b, *rest, **named: seen.append((a.count(), b.count())) or real(a, b, *rest, **named))
    got = {r.match_id: (r.dshift, r.p_seq, r.p_winner) for r in matching.fuzzy_first_match(left, right, "day", ("team_a", "team_b"), ["map_no"], 1, "p_", "seq", ["winner"]).collect()}
    assert got == {**{i: (-1, 40, "40") for i in range(200)}, 900: (None, None, None), 901: (None, None, None)}
    assert seen == [(3, 4)]


def test_first_ruled_name_equals_the_rules_row_by_row(spark, monkeypatch):
    from tidemark.plans import series

    rng = random.Random(6)
    some = ["T1", "Gen.G Esports", "Gen.G", "HLE", "Hanwha Life Esports", "Gen.G Academy", "", None, "Snow Leopards", "SNOWLEOPARDS", "x"]
    rows = [(i, None if i % 29 == 0 else [rng.choice(some) for _ in range(i % 4)], rng.choice(some)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, names array<string>, team string").repartition(3)
    want = sorted(map(tuple, df.select("id", series.side_key(F.col("names"), F.col("team"))).collect()))
    met, real = [], matching.ruled_pairs
    monkeypatch.setattr(matching, "ruled_pairs", lambda pairs, *rest: met.append(pairs.count()) or real(pairs, *rest))
    got = sorted(map(tuple, matching.first_ruled_name(df, "names", "team", "at").select("id", "at").collect()))
    assert got == want and len({a for _, a in got}) > 2 and met[0] <= 100
