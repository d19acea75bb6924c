"""Operators that cut a hot key into parts: the parts give what the whole gives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, bootstrap, divergence, interval, stretches


def rule(t, p, k, threshold, need, window, state):
    """The rule, instant by instant, from a state; what it confirms and the state after it."""
    length, sign, t0, p0, k0, until = stretches.fields(state)
    out = []
    for at, a, b in zip(t, p, k, strict=True):
        if at <= until:
            continue
        side = (b > a) - (b < a)
        if abs(b - a) >= threshold and side and length in (0, *([length] if side == sign else [])):
            if not length:
                t0, p0, k0 = at, a, b
            length, sign = length + 1, side
            if length >= need:
                out.append((t0, p0, k0))
                until, length = t0 + window, 0
        else:
            length = 0
    return out, (length, *((sign, t0, p0, k0) if length else (0, 0, 0.0, 0.0)), until)


def test_maps_of_stretches_applied_in_order_are_the_rule():
    rng = random.Random(1)
    for _ in range(3000):
        n, need, window, threshold = rng.randrange(1, 40), rng.randrange(1, 5), rng.choice([0, 1, 3, 10, 50]), rng.choice([0.0, 1, 2])
        t = np.array(sorted(rng.sample(range(100), n)))
        p, k = (np.array([float(rng.randrange(4)) for _ in t]) for _ in range(2))
        whole, found, state, width = rule(t.tolist(), p.tolist(), k.tolist(), threshold, need, window, stretches.State())[0], [], stretches.State(), rng.choice([1, 5, 13, 40])
        for begin in range(0, 100, width):
            own = (t >= begin) & (t < begin + width)
            if own.any():
                out, after = rule(t[own].tolist(), p[own].tolist(), k[own].tolist(), threshold, need, window, state)
                found += out
                through = stretches.stretch_of(stretches.rows_of(stretches.folded(t[own], p[own], k[own], threshold, need, window)))
                state = stretches.applied(through, state, need, window)
                known = stretches.fields(state)
                assert known[:5] == after[:5]
                assert known[0] or max(known[5], t[own][-1]) == max(after[5], t[own][-1])  # a window that is over does not matter
        assert found == whole


@pytest.fixture(scope="module")
def two_sides(spark):
    rng = random.Random(2)
    rows = [(key, side, t, round(0.5 + 0.1 * rng.randrange(-2, 3), 3)) for key, n in (("hot", 3000), ("b", 40), (None, 40), ("c", 1)) for side in "pk" for t in sorted(rng.sample(range(5000), n))]
    return spark.createDataFrame(rows, "m string, side string, t long, price double").repartition(5)


@pytest.mark.parametrize(("need", "window", "bucket"), [(3, 60, 200), (1, 0, 7), (2, 900, 100), (5, 30, 100_000)])
def test_bucketed_grid_and_divergences_equal_those_of_whole_keys(two_sides, need, window, bucket):
    p, k = (two_sides.where(F.col("side") == s) for s in "pk")
    whole, cut = (asof.grid(p, k, ["m"], "t", "price", "p", "k", bucket=b) for b in (None, bucket))
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))
    one, parts = (sorted(map(str, divergence.divergences(g, ["m"], "t", "p", "k", 0.1, need, window, b).collect())) for g, b in ((whole, None), (cut, bucket)))
    assert one == parts and len(one) >= 5


def test_no_task_holds_a_key(spark, two_sides):
    """Every stretch of the hot key is folded on its own; in order come only their maps."""
    p, k = (two_sides.where(F.col("side") == s) for s in "pk")
    cut = asof.grid(p, k, ["m"], "t", "price", "p", "k", bucket=200).where("p IS NOT NULL AND k IS NOT NULL").withColumn("_cell", F.floor(F.col("t") / 200))
    states = divergence.entering_states(cut, ["m"], "t", "p", "k", 0.1, 3, 60)
    assert states.where("m = 'hot'").count() == 25  # rows in order: one for each stretch, of thousands of instants
    assert cut.where("m = 'hot'").groupBy("_cell").count().agg(F.max("count")).first()[0] <= 200


def test_no_instants(spark, two_sides):
    none = two_sides.limit(0)
    empty = asof.grid(none, none, ["m"], "t", "price", "p", "k", bucket=100)
    assert empty.count() == 0 and divergence.divergences(empty, ["m"], "t", "p", "k", 0.1, 3, 60, 100).count() == 0


def test_interval_join_reads_what_is_near(spark):
    """Ten thousand maps on one token: a map meets the points of its bins and not all of the token."""
    maps = spark.range(10_000).select(F.col("id").alias("match_id"), F.lit("token").alias("key"), (F.col("id") * 100).alias("lo"), (F.col("id") * 100 + 70).alias("hi"))
    points = spark.range(100_000).select(F.lit("token").alias("key"), (F.col("id") * 10).alias("t"))
    found = interval.interval_join(maps, points, ["key"], "lo", "hi", "t", 100)
    assert found.count() == 10_000 * 8
    near = maps.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("lo") / 100), F.floor(F.col("hi") / 100)))).join(points.withColumn("_bin", F.floor(F.col("t") / 100)), ["key", "_bin"])
    assert near.count() <= 10_000 * 10  # of 10^9 pairs of one key


def test_interval_join_equals_brute_force(spark):
    rng = random.Random(3)
    spans = [(i, rng.choice("ab"), lo, lo + rng.randrange(-5, 60)) for i in range(80) for lo in [rng.randrange(-100, 100)]] + [(90, None, 0, 9), (91, "a", None, 9), (92, "a", -1000, 1000)]
    points = [(j, rng.choice("ab"), rng.randrange(-150, 150)) for j in range(120)] + [(200, None, 5), (201, "a", None)]
    left, right = spark.createDataFrame(spans, "i long, key string, lo long, hi long"), spark.createDataFrame(points, "j long, key string, t long")
    want = sorted((i, j) for i, a, lo, hi in spans for j, b, t in points if a and a == b and None not in (lo, hi, t) and lo <= t <= hi)
    for width in (1, 7, 1000):
        assert sorted((r.i, r.j) for r in interval.interval_join(left, right, ["key"], "lo", "hi", "t", width).collect()) == want


def test_bootstrap_in_chunks_equals_its_draws(spark, monkeypatch):
    """By brute force from the hash of each draw, whole and in chunks of blocks and resamples, null keys included."""
    rng = random.Random(4)
    rows = [(key, f"b{b:02}", rng.random()) for key, blocks in (("x", 23), (None, 9), ("one", 1)) for b in range(blocks) for _ in range(rng.randrange(1, 4))]
    want = {}
    for key in ("x", None, "one"):
        blocks = {}
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            blocks.setdefault(r[1], []).append(r[2])
        values, n = list(blocks.values()), len(blocks)
        drawn = [[x for at in range(n) for x in values[bootstrap.draw_of(7, r, at, n)]] for r in range(200)]
        stats = sorted(sum(x) / len(x) for x in drawn)
        want[key] = (stats[int(0.025 * 200)], stats[int(0.975 * 200) - 1]) if n > 1 else (None, None)
    df = spark.createDataFrame(rows, "k string, b string, v double").repartition(4)
    for blocks, draws in ((1 << 20, 1 << 27), (5, 1 << 27), (4, 60)):
        monkeypatch.setattr(bootstrap, "MOST_DRAWS", draws)
        monkeypatch.setattr(bootstrap, "chunks_of", lambda t, s, most=blocks: CHUNKS(t, s, most))
        got = {r.k: (r.ci_lo, r.ci_hi) for r in bootstrap.bootstrap_mean(df, ["k"], "b", "v", 200, 7, 0.95).collect()}
        assert {k: v and tuple(x and pytest.approx(x) for x in v) for k, v in want.items()} == got


def test_draws_are_no_rows(spark):
    df = spark.createDataFrame([("x", str(b), 1.0) for b in range(50)], "k string, b string, v double")
    plan = bootstrap.bootstrap_mean(df, ["k"], "b", "v", 10_000, 7, 0.95)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1  # ranges of resamples; a draw is no row


def resampled(rows, key, seed, resamples):
    """Values of each resample, by brute force from the hash of each draw."""
    blocks = {}
    for _, b, v in sorted((r for r in rows if r[0] == key and r[2] is not None), key=lambda r: r[1]):
        blocks.setdefault(b, []).append(v)
    values, n = list(blocks.values()), len(blocks)
    return n, [[x for at in range(n) for x in values[bootstrap.draw_of(seed, r, at, n)]] for r in range(resamples)], [x for v in values for x in v]


@pytest.mark.parametrize(("part", "draws"), [(1 << 16, 1 << 27), (3, 1 << 27), (2, 90)])
def test_statistics_over_parts_equal_those_of_whole_resamples(spark, monkeypatch, part, draws):
    """Medians by weighted ranks over runs, and a merged deviation, with ties, nulls and a null key."""
    rng = random.Random(5)
    rows = [(key, f"b{b:02}", rng.choice([0.0, 0.25, rng.random(), None])) for key, blocks in (("x", 19), (None, 8), ("one", 1)) for b in range(blocks) for _ in range(rng.randrange(1, 4))]
    rows += [("one", "b00", 0.5)]
    monkeypatch.setattr(bootstrap, "PART_VALUES", part)
    monkeypatch.setattr(bootstrap, "MOST_DRAWS", draws)
    df = spark.createDataFrame(rows, "k string, b string, v double").repartition(3)
    deviation = bootstrap.Moments(lambda n, s, q: np.sqrt(np.maximum(q / n - (s / n) ** 2, 0)))
    medians = {r.k: r for r in bootstrap.bootstrap_quantile(df, ["k"], "b", "v", 0.5, 120, 7, 0.9).collect()}
    deviations = {r.k: r for r in bootstrap.bootstrap_merged(df, ["k"], "b", "v", deviation, 120, 7, 0.9).collect()}
    assert set(medians) == set(deviations) == {"x", None, "one"}
    for found, of in ((medians, lambda xs: sorted(xs)[len(xs) // 2]), (deviations, lambda xs: float(np.std(xs)))):
        for key in ("x", None):
            n, drawn, own = resampled(rows, key, 7, 120)
            stats = sorted(map(of, drawn))
            assert (found[key].n_blocks, found[key].point, found[key].ci_lo, found[key].ci_hi) == (n, *map(pytest.approx, (of(own), stats[int((1 - 0.9) / 2 * 120)], stats[int((1 + 0.9) / 2 * 120) - 1])))
        assert tuple(found["one"])[1:] == (None, None, None, 1)


CHUNKS = bootstrap.chunks_of


def test_a_statistic_of_sums_reads_blocks_and_not_values(spark, monkeypatch):
    class Unsummed:
        """The moments without their terms: the way of any mergeable statistic."""

        size = 3

        def __init__(self, moments):
            self.update, self.merge, self.finish = moments.update, moments.merge, moments.finish

    rng = random.Random(9)
    rows = [(k, b, None if rng.random() < 0.1 else rng.random()) for k in ("x", None) for b in range(25) for _ in range(20)] + [("one", 1, 0.5), ("none", 1, None)]
    df = spark.createDataFrame(rows, "k string, b int, v double").repartition(3)
    deviation = bootstrap.Moments(lambda n, s, q: np.sqrt(np.maximum(q / n - (s / n) ** 2, 0)))
    general = bootstrap.bootstrap_merged(df, ["k"], "b", "v", Unsummed(deviation), 90, 7, 0.9).collect()
    monkeypatch.setattr(bootstrap, "placed_blocks", lambda *_: pytest.fail("values are read"))
    monkeypatch.setattr(bootstrap, "MOST_BLOCKS", 10)  # three chunks
    linear = bootstrap.bootstrap_merged(df, ["k"], "b", "v", deviation, 90, 7, 0.9).collect()
    assert {r.k: pytest.approx(r[1:]) for r in general} == {r.k: tuple(r)[1:] for r in linear} and len(linear) == 3


def test_a_key_of_one_run_is_drawn_for_once(spark, monkeypatch):
    df = spark.range(60).selectExpr("id % 2 AS k", "id % 30 AS b", "pmod(hash(id), 17) * 0.5 AS v")
    found, several = [], []
    for part in (1 << 20, 7):
        monkeypatch.setattr(bootstrap, "PART_VALUES", part)
        with monkeypatch.context() as m:
            real = bootstrap.materialise
            m.setattr(bootstrap, "materialise", lambda rows, label, real=real: several.append((label, real(rows, label))) or several[-1][1])
            found.append(sorted(map(tuple, bootstrap.bootstrap_quantile(df, ["k"], "b", "v", 0.5, 80, 3, 0.9).collect())))
    assert found[0] == found[1]
    assert [rows.count() for label, rows in several if label == "bootstrap-weights"] == [0, 2 * 80 * 5]


def test_only_large_keys_are_cut(two_sides, monkeypatch):
    """most keys have few instants, and a call for each of their stretches cost most of the time; the rows stay the same."""
    p, k = (two_sides.where(F.col("side") == s).withColumn("part", F.when(F.col("t") % 1000 < 900, F.floor(F.col("t") / 2500))) for s in "pk")
    found = lambda bucket: sorted(map(str, divergence.confirmed(p, k, ["m"], ["part"], "t", "price", 0.1, 3, 60, bucket).collect()))
    cut, real = [], divergence.entering_states
    monkeypatch.setattr(divergence, "entering_states", lambda grid, *rest: cut.extend(r[0] for r in grid.select("m").distinct().collect()) or real(grid, *rest))
    whole = found(None)
    assert found(200) == whole and cut == [] and len(whole) > 20  # no key has more than LARGE
    monkeypatch.setattr(divergence, "LARGE", 500)
    assert found(200) == whole and cut == ["hot"]
    monkeypatch.setattr(divergence, "LARGE", 10)
    assert found(200) == whole and set(cut[1:]) == {"hot", "b", None}


def test_no_pairs_of_a_series_and_its_records(spark, monkeypatch):
    """coverage and first matches of one busy key, by brute force, without the pairs of its rows."""
    from datetime import date, timedelta

    from tidemark.operators import matching
    from tidemark.plans import gates

    monkeypatch.setattr(matching, "banded_candidates", lambda *_: pytest.fail("pairs are made"))
    rng = random.Random(6)
    days = [date(2024, 1, 1) + timedelta(n) for n in range(12)]
    side = lambda n: [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([*days, None]), rng.randrange(3), rng.choice(["a", "b", None])) for i in range(n)]
    left, right = side(60), side(25)
    records = [(u, d, rng.choice("KP"), rng.choice("sm")) for _, u, d, *_ in side(14)]
    near = lambda d, e: d is not None and e is not None and abs((e - d).days) <= 1
    want = {}
    for i, u, d, m, _ in left:
        hits = [((e - d).days, j, w) for j, v, e, n, w in right if u is not None and u == v and m == n and near(d, e)]
        want[i] = min(hits, key=lambda x: x[:2])[1:] if hits else (None, None)
    frames = [spark.createDataFrame(x, "event_id long, user_id long, day date, map_no int, winner string").repartition(3) for x in (left, right)]
    got = matching.banded_first_match(*frames, "day", ["user_id", "map_no"], 1, "p_", "event_id", ["event_id", "winner"])
    assert {r.event_id: (r.p_event_id, r.p_winner) for r in got.collect()} == want and sum(x != (None, None) for x in want.values()) > 10
    seen = {(u, d): {(v, f) for w, e, v, f in records if u is not None and u == w and near(d, e)} for _, u, d, *_ in left}
    covers = lambda s, *fs: all(any(x == v and f in fs for x, f in s) for v in "KP")
    expected = sorted(map(str, ((u, d, covers(s, "s", "m"), covers(s, "s", "m") and covers(s, "s"), covers(s, "s", "m") and covers(s, "m")) for (u, d), s in seen.items())))
    found = gates.coverage(frames[0], spark.createDataFrame(records, "user_id long, day date, venue string, family string"), ["user_id"], "day", ["K", "P"], ["s", "m"])
    assert sorted(str(tuple(r)) for r in found.collect()) == expected and {True, False} == {r.covered for r in found.collect()}


def test_verdict_parses_the_events_once(spark, sf, monkeypatch):
    from tidemark.queries import market, records

    read, real = [], market.ticks
    for module in (market, records):
        monkeypatch.setattr(module, "ticks", lambda *a: read.append(a) or real(*a))
    assert records.verdict(spark, sf).count() == 2 and len(read) == 1
