"""As-of, scoring, bootstrap and divergence queries: ``events`` as a market store.

A user is a contract; clicks are the reference venue K, views the target venue P, purchases
are the instants that ask.  The price is value / (value + 50), the outcome is k >= 50 in the
JSON properties, the regime changes on 2024-01-16.  Times are microseconds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import asof, bootstrap, divergence, scoring
from tidemark.params import Bootstrap, Calibration
from tidemark.plans import gates, series

CENTERS = Calibration().buckets
HOUR = 3_600_000_000
DAY = 24 * HOUR
WINDOW, THRESHOLD, NEED = DAY, 0.1, 3
BUCKET = 5 * DAY  # of a user's grid that one task folds
RESAMPLES, SEED, CI = Bootstrap().resamples, Bootstrap().seed, Bootstrap().ci_level

TICKS = """ticks AS (
  SELECT event_id, user_id, event_type, epoch_us(ts) AS t, ts, value, value / (value + 50.0) AS price,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CASE event_type WHEN 'click' THEN 'K' WHEN 'view' THEN 'P' END AS venue,
         CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'pre_match' ELSE 'in_game' END AS regime
  FROM events
)"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.select(
        "event_id", "user_id", "event_type", F.unix_micros("ts").alias("t"), "ts", "value", (F.col("value") / (F.col("value") + 50.0)).alias("price"),
        F.get_json_object("props", "$.k").cast("int").alias("k"), F.when(F.col("event_type") == "click", "K").when(F.col("event_type") == "view", "P").alias("venue"),
        F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp"), "pre_match").otherwise("in_game").alias("regime"),
    )


def asked(rows: DataFrame) -> DataFrame:
    return rows.where("event_type = 'purchase'").select("event_id", "user_id", "t")


def of_venue(rows: DataFrame, venue: str) -> DataFrame:
    return rows.where(F.col("venue") == venue).select("user_id", "t", "price")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points_of(ticks(spark, sf_dir))


def points_of(rows: DataFrame) -> DataFrame:
    """One row per priced event of a venue: venue, regime, block, p, y."""
    return rows.where("venue IS NOT NULL").select("venue", "regime", "user_id", F.col("price").alias("p"), (F.col("k") >= 50).cast("double").alias("y"))


POINTS_CTE = "points AS (SELECT venue, regime, user_id, price AS p, CASE WHEN k >= 50 THEN 1.0 ELSE 0.0 END AS y FROM ticks WHERE venue IS NOT NULL)"
POINTS = f"{TICKS}, {POINTS_CTE}"
CENTER_LIST = "[" + ", ".join(f"{c!r}::DOUBLE" for c in CENTERS) + "]"
CURVE_CTE = f"""placed AS (
  SELECT *, list_min(list_transform({CENTER_LIST}, lambda c: {{'d': abs(p - c), 'c': c}})).c AS center FROM points
), curve AS (
  SELECT venue, regime, center, avg(p) AS mean_price, avg(y) AS realised, count(*) AS n FROM placed GROUP BY ALL
), ece AS (
  SELECT venue, regime, sum(n * abs(mean_price - realised)) / sum(n) AS ece, CAST(sum(n) AS BIGINT) AS n FROM curve GROUP BY ALL
)"""
CURVE = f"{POINTS}, {CURVE_CTE}"


def asof_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir)
    return asof.asof_join(asked(rows), of_venue(rows, "P"), ["user_id"], "t", "t").withColumnRenamed("r_t", "quote_t").withColumnRenamed("r_price", "quote_price")


def asof_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through time buckets, for keys that hold a large share of the rows."""
    rows = ticks(spark, sf_dir)
    return asof.asof_join(asked(rows), of_venue(rows, "P"), ["user_id"], "t", "t", bucket=3 * DAY).withColumnRenamed("r_t", "quote_t").withColumnRenamed("r_price", "quote_price")


def asof_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir)
    everything = rows.select("user_id", "t", "price")
    return asof.asof_join(asked(rows), everything, ["user_id"], "t", "t", strict=True).withColumnRenamed("r_t", "quote_t").withColumnRenamed("r_price", "quote_price")


def asof_forward_tol(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir)
    found = asof.asof_join(asked(rows), of_venue(rows, "P"), ["user_id"], "t", "t", forward=True, tolerance=6 * HOUR)
    return found.withColumnRenamed("r_t", "quote_t").withColumnRenamed("r_price", "quote_price")


def read_asof_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir)
    cut = F.unix_micros(F.lit("2024-01-20").cast("timestamp"))
    return asof.history(rows, ["user_id"], "t", cut, limit=5, ties=["event_id"]).select("event_id", "user_id", "t", "price")


def latest_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir).select("user_id", "event_id", "t", "price")
    return asof.latest(rows, ["user_id"], "t", F.unix_micros(F.lit("2024-01-20").cast("timestamp")), ["event_id"])


def grid_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir)
    return asof.grid(of_venue(rows, "P"), of_venue(rows, "K"), ["user_id"], "t", "price", "p", "k", bucket=BUCKET)


def snapshot_multi_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir)
    targets = F.explode(F.array(F.struct(F.lit("pre_match").alias("target"), F.col("t").alias("at")), F.struct(F.lit("in_game").alias("target"), (F.col("t") + 600_000_000).alias("at"))))
    wanted = asked(rows).select("event_id", "user_id", targets.alias("x")).select("event_id", "user_id", "x.*")
    per_venue = [asof.asof_join(wanted, of_venue(rows, v), ["user_id"], "at", "t").withColumn("venue", F.lit(v)) for v in ("K", "P")]
    return per_venue[0].unionByName(per_venue[1]).select("event_id", "user_id", "target", "venue", F.col("r_price").alias("price"))


def brier_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, y = F.col("p"), F.col("y")
    found = points(spark, sf_dir).groupBy("venue", "regime").agg(F.count(F.lit(1)).alias("n"), scoring.brier(p, y).alias("brier"), scoring.log_loss(p, y).alias("log_loss"))
    return found.select("venue", "regime", "n", F.round("brier", 9).alias("brier"), F.round("log_loss", 9).alias("log_loss"))


def reliability_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = scoring.reliability(points(spark, sf_dir), ["venue", "regime"], "p", "y", CENTERS)
    return curve.select("venue", "regime", "center", F.round("mean_price", 9).alias("mean_price"), F.round("realised", 9).alias("realised"), "n")


def ece_by_venue(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = scoring.reliability(points(spark, sf_dir), ["venue", "regime"], "p", "y", CENTERS)
    return scoring.expected_calibration_error(curve, ["venue", "regime"]).select("venue", "regime", F.round("ece", 9).alias("ece"), "n")


def calibration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = scoring.calibration_report(points(spark, sf_dir), ["venue", "regime"], "p", "y", CENTERS)
    return report.select("venue", "regime", "n", *[F.round(c, 9).alias(c) for c in ("brier", "log_loss", "ece")], F.size("curve").cast("bigint").alias("n_buckets"))


def compare_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = scoring.calibration_report(points(spark, sf_dir), ["venue", "regime"], "p", "y", CENTERS)
    found = scoring.compare(report, "regime", "venue", "K", "P", 0.0)
    return found.select("regime", F.round("ece_reference", 9).alias("ece_reference"), F.round("ece_target", 9).alias("ece_target"), "passed")


def block_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = points(spark, sf_dir).withColumn("e", scoring.squared_error(F.col("p"), F.col("y")))
    found = bootstrap.bootstrap_mean(errors, ["venue", "regime"], "user_id", "e", Bootstrap().resamples, SEED, CI)
    return found.select("venue", "regime", *[F.round(c, 9).alias(c) for c in ("point", "ci_lo", "ci_hi")], "n_blocks", "n")


def calibration_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of each venue and regime with the interval of its Brier score."""
    report = gates.calibration_with_interval(points(spark, sf_dir), "user_id", Calibration(), Bootstrap())
    return report.select("venue", "regime", "n", *[F.round(c, 9).alias(c) for c in ("brier", "ece", "brier_lo", "brier_hi")], "n_blocks")


def bootstrap_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median of the users' squared errors, by weighted ranks."""
    errors = points(spark, sf_dir).withColumn("e", scoring.squared_error(F.col("p"), F.col("y"))).groupBy("regime", "user_id").agg(F.sum("e").alias("e"))
    found = bootstrap.bootstrap_quantile(errors, ["regime"], "user_id", "e", 0.5, Bootstrap().resamples, SEED, CI)
    return found.select("regime", *[F.round(c, 9).alias(c) for c in ("point", "ci_lo", "ci_hi")], F.col("n_blocks").cast("int").alias("n_blocks"))


def bootstrap_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mergeable statistic: the standard deviation of the squared errors, by regime, users being blocks."""
    errors = points(spark, sf_dir).withColumn("e", scoring.squared_error(F.col("p"), F.col("y")))
    deviation = bootstrap.Moments(lambda n, s, q: np.sqrt(np.maximum(q / n - (s / n) ** 2, 0)))
    found = bootstrap.bootstrap_merged(errors, ["regime"], "user_id", "e", deviation, Bootstrap().resamples, SEED, CI)
    return found.select("regime", *[F.round(c, 7).alias(c) for c in ("point", "ci_lo", "ci_hi")], "n_blocks")


def found_divergences(spark: SparkSession, sf_dir: str, lead: bool) -> DataFrame:
    rows = ticks(spark, sf_dir)
    return divergence.confirmed(of_venue(rows, "P"), of_venue(rows, "K"), ["user_id"], [], "t", "price", THRESHOLD, NEED, WINDOW, BUCKET, lead)


def divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = found_divergences(spark, sf_dir, False)
    return found.select("user_id", "t_start", *[F.round(c, 9).alias(c) for c in ("p_start", "k_start", "gap")])


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_divergences(spark, sf_dir, True)


def convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads(spark, sf_dir).select("user_id", "t_start", F.round("lead", 9).alias("lead"))


def lead_lag_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lead_report(leads(spark, sf_dir).withColumn("regime", F.lit("all")), Bootstrap().resamples)


def lead_report(found: DataFrame, resamples: int) -> DataFrame:
    report = bootstrap.bootstrap_mean(found, ["regime"], "user_id", "lead", resamples, SEED, CI)
    rounded = report.select("regime", F.col("n").alias("n_divergences"), *[F.round(c, 9).alias(c) for c in ("point", "ci_lo", "ci_hi")], "n_blocks")
    return rounded.withColumn("leader", divergence.leader(F.col("ci_lo"), F.col("ci_hi"), "K", "P"))


def regime_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices around each user's first purchase: six hours before (half open), and from it to a day after (closed)."""
    rows = ticks(spark, sf_dir)
    kickoff = rows.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("t").alias("kickoff"))
    joined = rows.where("venue IS NOT NULL").join(kickoff, "user_id")
    before = (F.col("t") >= F.col("kickoff") - 6 * HOUR) & (F.col("t") < F.col("kickoff"))
    after = F.col("t").between(F.col("kickoff"), F.col("kickoff") + DAY)
    sliced = joined.withColumn("slice", F.when(before, "pre_match").when(after, "in_game")).where("slice IS NOT NULL")
    return sliced.groupBy("slice", "venue").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def lagged_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir)
    aligned = asof.grid(of_venue(rows, "P"), of_venue(rows, "K"), ["user_id"], "t", "price", "p", "k").where("p IS NOT NULL AND k IS NOT NULL")
    found = divergence.lagged_correlation(aligned, ["user_id"], "t", "p", "k", [0, 1, 2])
    return found.where("corr IS NOT NULL AND NOT isnan(corr)").groupBy("lag").agg(F.count(F.lit(1)).alias("users"), F.round(F.avg("corr"), 6).alias("mean_corr"))


ASOF_CTE = """asked AS (SELECT event_id, user_id, t FROM ticks WHERE event_type = 'purchase'),
p AS (SELECT user_id, regime, t, price FROM ticks WHERE venue = 'P'), kk AS (SELECT user_id, regime, t, price FROM ticks WHERE venue = 'K'), everything AS (SELECT user_id, t, price FROM ticks)"""
ASOF = f"{TICKS}, {ASOF_CTE}"
_CHOSEN = "a.event_id, a.user_id, a.t, q.t AS quote_t, q.price AS quote_price"
INCLUSIVE = f"WITH {ASOF} SELECT {_CHOSEN} FROM asked a ASOF LEFT JOIN p q ON a.user_id = q.user_id AND a.t >= q.t"



def _listed(keys: tuple[str, ...], of: str = "") -> str:
    return ", ".join(f"{of}.{k}" if of else k for k in keys)


def _equal(keys: tuple[str, ...], x: str, y: str) -> str:
    return " AND ".join(f"{x}.{k} = {y}.{k}" for k in keys)


def grid_cte(keys: tuple[str, ...] = ("user_id",)) -> str:
    """The instants of both series of a key."""
    ks = _listed(keys)
    return f"""instants AS (SELECT {ks}, t FROM p UNION SELECT {ks}, t FROM kk),
grid AS (
  SELECT {_listed(keys, 'i')}, i.t, a.price AS p, b.price AS k FROM instants i
  ASOF LEFT JOIN p a ON {_equal(keys, 'i', 'a')} AND i.t >= a.t ASOF LEFT JOIN kk b ON {_equal(keys, 'i', 'b')} AND i.t >= b.t
)"""


def found_cte(keys: tuple[str, ...] = ("user_id",)) -> str:
    """The divergences of each key's grid: a fold, row by row."""
    ks = _listed(keys)
    return f"""{grid_cte(keys)}, steps AS (
  SELECT *, row_number() OVER (PARTITION BY {ks} ORDER BY t) AS i FROM grid WHERE p IS NOT NULL AND k IS NOT NULL
), fold AS (
  SELECT {ks}, 0::BIGINT AS i, 0 AS len, 0 AS sgn, 0::BIGINT AS t0, 0.0::DOUBLE AS p0, 0.0::DOUBLE AS k0, (-1)::BIGINT AS cooldown, false AS emits
  FROM (SELECT DISTINCT {ks} FROM steps)
  UNION ALL
  SELECT {ks}, i, CASE WHEN waits THEN len WHEN ok AND len + 1 < {NEED} THEN len + 1 ELSE 0 END,
    CASE WHEN waits THEN sgn WHEN ok AND len + 1 < {NEED} THEN s ELSE 0 END,
    CASE WHEN NOT waits AND ok AND len = 0 THEN t ELSE t0 END, CASE WHEN NOT waits AND ok AND len = 0 THEN p ELSE p0 END, CASE WHEN NOT waits AND ok AND len = 0 THEN k ELSE k0 END,
    CASE WHEN NOT waits AND ok AND len + 1 >= {NEED} THEN t0 + {WINDOW} ELSE cooldown END, NOT waits AND ok AND len + 1 >= {NEED}
  FROM (
    SELECT {_listed(keys, 'f')}, s.i, f.len, f.sgn, f.t0, f.p0, f.k0, f.cooldown, s.t, s.p, s.k, s.t <= f.cooldown AS waits, sign(s.k - s.p)::INT AS s,
      abs(s.k - s.p) >= {THRESHOLD} AND sign(s.k - s.p) <> 0 AND (f.len = 0 OR f.sgn = sign(s.k - s.p)) AS ok
    FROM fold f JOIN steps s ON {_equal(keys, 's', 'f')} AND s.i = f.i + 1
  )
), found AS (SELECT {ks}, t0 AS t_start, p0 AS p_start, k0 AS k_start, k0 - p0 AS gap FROM fold WHERE emits)"""


def leads_cte(keys: tuple[str, ...] = ("user_id",)) -> str:
    """The lead of each divergence, by the whole series of its user."""
    return f"""{found_cte(keys)}, ends AS (SELECT *, t_start + {WINDOW} AS t_end FROM found), leads AS (
  SELECT {_listed(keys, 'e')}, e.t_start, e.gap,
    coalesce(CASE WHEN e.gap > 0 THEN 1 ELSE -1 END * (a.price - e.p_start + b.price - e.k_start), 0.0) AS lead
  FROM ends e ASOF LEFT JOIN p a ON e.user_id = a.user_id AND e.t_end >= a.t ASOF LEFT JOIN kk b ON e.user_id = b.user_id AND e.t_end >= b.t
)"""


GRID, AUTOMATON, LEADS = (f"{ASOF}, {cte}" for cte in (grid_cte(), found_cte(), leads_cte()))


def _mixed_sql(x: str) -> str:
    """The hash of a draw: the rule of ``operators.bootstrap.mix``."""
    for multiplier, shift in zip(bootstrap.MULTIPLIERS, bootstrap.SHIFTS, strict=False):
        x = f"list_transform([({x}) % {bootstrap.PRIME} * {multiplier} % {bootstrap.PRIME}], lambda v: xor(v, v >> {shift}))[1]"
    return f"(({x}) % {bootstrap.PRIME} * {bootstrap.MULTIPLIERS[-1]} % {bootstrap.PRIME})"


def _draws_sql(by: str, resamples: int) -> str:
    """CTEs of the draws: the hashes of resamples and places come first, each once."""
    return f"""b_r AS (SELECT r, {_mixed_sql(f'r + {SEED}')} AS hr FROM range({resamples}) a(r)),
b_k AS (SELECT k, {_mixed_sql('k + 1')} AS hk FROM range((SELECT coalesce(max(n_blocks), 0) FROM b_summary)::BIGINT) a(k)),
b_draws AS (SELECT {by}, r, {_mixed_sql('xor(hr, hk)')} % n_blocks AS i FROM b_summary, b_r, b_k WHERE n_blocks >= 2 AND k < n_blocks)"""


def _bootstrap(rows: str, by: str, value: str, resamples: int) -> str:
    """CTEs ``b_summary`` and ``b_ends`` of the block bootstrap of the mean of ``value`` in ``rows``."""
    lo, hi = int((1 - CI) / 2 * resamples), int((1 + CI) / 2 * resamples) - 1
    on = " AND ".join(f"x.{c} = y.{c}" for c in by.split(", "))
    xs = ", ".join(f"x.{c}" for c in by.split(", "))
    return f"""b_blocks AS (
  SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY user_id) - 1 AS i
  FROM (SELECT {by}, user_id, sum({value}) AS total, count({value}) AS cnt FROM {rows} GROUP BY {by}, user_id)
), b_summary AS (
  SELECT {by}, sum(total) / sum(cnt) AS point, count(*) AS n_blocks, CAST(sum(cnt) AS BIGINT) AS n FROM b_blocks GROUP BY {by}
), {_draws_sql(by, resamples)},
b_stats AS (
  SELECT {xs}, x.r, sum(y.total) / sum(y.cnt) AS stat FROM b_draws x JOIN b_blocks y ON {on} AND x.i = y.i GROUP BY {xs}, x.r
), b_ends AS (
  SELECT {by}, list_sort(list(stat))[{lo + 1}] AS ci_lo, list_sort(list(stat))[{hi + 1}] AS ci_hi FROM b_stats GROUP BY {by}
)"""


def _lead_report_sql(prelude: str, rows: str, resamples: int) -> str:
    return f"""WITH RECURSIVE {prelude}, {_bootstrap(rows, 'regime', 'lead', resamples)}
SELECT x.regime, x.n AS n_divergences, round(CASE WHEN n_blocks >= 2 THEN point END, 9) AS point, round(ci_lo, 9) AS ci_lo, round(ci_hi, 9) AS ci_hi, n_blocks,
  CASE WHEN round(ci_lo, 9) > 0 THEN 'K' WHEN round(ci_hi, 9) < 0 THEN 'P' END AS leader
FROM b_summary x LEFT JOIN b_ends y ON x.regime = y.regime"""


def candles(rows: DataFrame) -> DataFrame:
    """Clicks as raw candles: bid the value (unreadable where k % 5 = 0, zero on both sides where k % 7 = 0), ask k above it."""
    bid = F.when(F.col("k") % 5 == 0, "bad").when(F.col("k") % 7 == 0, "0").otherwise(F.col("value").cast("string"))
    ask = F.when(F.col("k") % 7 == 0, "0.0").otherwise((F.col("value") + F.col("k")).cast("string"))
    close = lambda c: F.struct(c.alias("close_dollars"))
    made = F.struct(F.col("t").alias("end_period_ts"), close(bid).alias("yes_bid"), close(ask).alias("yes_ask"))
    return rows.where("venue = 'K'").select("user_id", F.from_json(F.to_json(made), series.CANDLE).alias("candle"))


def candle_mid_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir)
    return series.candle_mid_at(asked(rows), candles(rows), ["user_id"], "t")


def candle_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.candle_series(candles(ticks(spark, sf_dir)), ["user_id"])


def maps(rows: DataFrame) -> DataFrame:
    """Purchases as maps of length k * 20 seconds, won by team a where k >= 50; times in seconds."""
    return rows.where("event_type = 'purchase'").select(
        F.col("event_id").alias("match_id"), F.floor(F.col("t") / 1_000_000).alias("kickoff"), (F.col("k") * 20).alias("length_s"), F.lit("a").alias("team_a"), F.when(F.col("k") >= 50, "a").otherwise("b").alias("winner"),
        F.col("user_id").alias("k_ticker"), F.when(F.col("k") % 4 != 0, F.col("user_id")).alias("p_token"),
    )


def build_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir)
    seconds = candles(rows.withColumn("t", F.floor(F.col("t") / 1_000_000))).withColumnRenamed("user_id", "k_ticker")
    history = of_venue(rows, "P").select(F.col("user_id").alias("p_token"), F.floor(F.col("t") / 1_000_000).alias("t"), "price")
    return series.build_points(maps(rows), seconds, history)


def map_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir)
    history = of_venue(rows, "P").select(F.col("user_id").alias("p_token"), F.floor(F.col("t") / 1_000_000).alias("t"), "price")
    return series.map_series(maps(rows), history, "p_token")


QUERIES = {
    f.__name__: f
    for f in (
        asof_inclusive, asof_bucketed, asof_strict, asof_forward_tol, read_asof_prefix, latest_before, grid_align, snapshot_multi_target, brier_logloss, reliability_curve, ece_by_venue,
        calibration_report, calibration_interval, compare_venues, block_bootstrap_ci, bootstrap_median, bootstrap_deviation, divergences, convergence, lead_lag_report, regime_slices, lagged_correlation, candle_mid_at, candle_series, build_points, map_series,
    )
}

SCORES = "count(*) AS n, avg((p - y) * (p - y)) AS brier, -avg(y * ln(least(1 - 1e-9, greatest(1e-9, p))) + (1 - y) * ln(1 - least(1 - 1e-9, greatest(1e-9, p)))) AS log_loss"
CANDLES = ASOF + """, candles AS (SELECT user_id, t, CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN NULL ELSE round((value + (value + k)) / 2, 6) END AS price FROM ticks WHERE venue = 'K')"""
MAPS = CANDLES + """, maps AS (
  SELECT event_id AS match_id, user_id, t // 1000000 AS kickoff, k * 20 AS length_s, CASE WHEN k >= 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, k % 4 <> 0 AS has_p FROM ticks WHERE event_type = 'purchase'
), wanted AS (SELECT *, 'pre_match' AS regime, kickoff AS at FROM maps UNION ALL SELECT *, 'in_game', kickoff + 600 FROM maps WHERE length_s >= 600),
ks AS (SELECT user_id, t // 1000000 AS t, price FROM candles), ps AS (SELECT user_id, t // 1000000 AS t, price FROM p)"""
SQL = {
    "candle_mid_at": f"WITH {CANDLES} SELECT a.event_id, a.user_id, a.t, q.price FROM asked a ASOF LEFT JOIN candles q ON a.user_id = q.user_id AND a.t >= q.t",
    "candle_series": f"WITH {CANDLES} SELECT user_id, t, price FROM candles WHERE price IS NOT NULL",
    "build_points": f"""WITH {MAPS} SELECT match_id, 'K' AS venue, regime, price AS p, y FROM wanted w ASOF JOIN ks q ON w.user_id = q.user_id AND w.at >= q.t WHERE price IS NOT NULL
UNION ALL SELECT match_id, 'P', regime, price, y FROM (SELECT * FROM wanted WHERE has_p) w ASOF JOIN ps q ON w.user_id = q.user_id AND w.at >= q.t WHERE price IS NOT NULL""",
    "map_series": f"""WITH {MAPS}, x AS (SELECT match_id, s.t, s.price, kickoff, kickoff + length_s AS e, count(*) OVER (PARTITION BY match_id) AS n FROM maps m JOIN ps s ON m.has_p AND s.user_id = m.user_id AND s.t BETWEEN kickoff - 21600 AND kickoff + length_s + 300)
SELECT match_id, t, price, CASE WHEN t < kickoff THEN 'pre_match' WHEN t < e + 1 THEN 'in_game' END AS regime FROM x WHERE n >= 2""",
    "asof_inclusive": INCLUSIVE,
    "asof_bucketed": INCLUSIVE,
    "asof_strict": f"WITH {ASOF} SELECT {_CHOSEN} FROM asked a ASOF LEFT JOIN everything q ON a.user_id = q.user_id AND a.t > q.t",
    "asof_forward_tol": f"""WITH {ASOF} SELECT a.event_id, a.user_id, a.t, CASE WHEN q.t - a.t <= {6 * HOUR} THEN q.t END AS quote_t, CASE WHEN q.t - a.t <= {6 * HOUR} THEN q.price END AS quote_price
FROM asked a ASOF LEFT JOIN p q ON a.user_id = q.user_id AND a.t <= q.t""",
    "read_asof_prefix": f"WITH {TICKS} SELECT event_id, user_id, t, price FROM ticks WHERE ts < TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) <= 5",
    "latest_before": f"WITH {TICKS} SELECT user_id, event_id, t, price FROM ticks WHERE ts < TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) = 1",
    "grid_align": f"WITH {GRID} SELECT user_id, t, p, k FROM grid",
    "snapshot_multi_target": f"""WITH {ASOF}, wanted AS (SELECT event_id, user_id, 'pre_match' AS target, t AS at FROM asked UNION ALL SELECT event_id, user_id, 'in_game', t + 600000000 FROM asked)
SELECT w.event_id, w.user_id, w.target, 'K' AS venue, q.price FROM wanted w ASOF LEFT JOIN kk q ON w.user_id = q.user_id AND w.at >= q.t
UNION ALL SELECT w.event_id, w.user_id, w.target, 'P', q.price FROM wanted w ASOF LEFT JOIN p q ON w.user_id = q.user_id AND w.at >= q.t""",
    "brier_logloss": f"WITH {POINTS}, s AS (SELECT venue, regime, {SCORES} FROM points GROUP BY ALL) SELECT venue, regime, n, round(brier, 9) AS brier, round(log_loss, 9) AS log_loss FROM s",
    "reliability_curve": f"WITH {CURVE} SELECT venue, regime, center, round(mean_price, 9) AS mean_price, round(realised, 9) AS realised, n FROM curve",
    "ece_by_venue": f"WITH {CURVE} SELECT venue, regime, round(ece, 9) AS ece, n FROM ece",
    "calibration_report": f"""WITH {CURVE}, s AS (SELECT venue, regime, {SCORES} FROM points GROUP BY ALL), b AS (SELECT venue, regime, count(*) AS n_buckets FROM curve GROUP BY ALL)
SELECT s.venue, s.regime, s.n, round(brier, 9) AS brier, round(log_loss, 9) AS log_loss, round(ece, 9) AS ece, n_buckets
FROM s JOIN ece e ON s.venue = e.venue AND s.regime = e.regime JOIN b ON s.venue = b.venue AND s.regime = b.regime""",
    "compare_venues": f"""WITH {CURVE} SELECT regime, round(max(ece) FILTER (venue = 'K'), 9) AS ece_reference, round(max(ece) FILTER (venue = 'P'), 9) AS ece_target,
  max(ece) FILTER (venue = 'K') <= max(ece) FILTER (venue = 'P') + 0.0 AS passed FROM ece GROUP BY regime""",
    "block_bootstrap_ci": f"""WITH {POINTS}, errors AS (SELECT *, (p - y) * (p - y) AS e FROM points), {_bootstrap('errors', 'venue, regime', 'e', RESAMPLES)}
SELECT x.venue, x.regime, round(CASE WHEN n_blocks >= 2 THEN point END, 9) AS point, round(ci_lo, 9) AS ci_lo, round(ci_hi, 9) AS ci_hi, n_blocks, n
FROM b_summary x LEFT JOIN b_ends y ON x.venue = y.venue AND x.regime = y.regime""",
    "calibration_interval": f"""WITH {CURVE}, s AS (SELECT venue, regime, {SCORES} FROM points GROUP BY ALL), errors AS (SELECT *, (p - y) * (p - y) AS e FROM points), {_bootstrap('errors', 'venue, regime', 'e', RESAMPLES)}
SELECT s.venue, s.regime, s.n, round(brier, 9) AS brier, round(ece, 9) AS ece, round(ci_lo, 9) AS brier_lo, round(ci_hi, 9) AS brier_hi, n_blocks
FROM s JOIN ece e ON s.venue = e.venue AND s.regime = e.regime JOIN b_summary x ON s.venue = x.venue AND s.regime = x.regime LEFT JOIN b_ends y ON s.venue = y.venue AND s.regime = y.regime""",
    "bootstrap_median": f"""WITH {POINTS}, b_blocks AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY user_id) - 1 AS i FROM (SELECT regime, user_id, sum((p - y) * (p - y)) AS e FROM points GROUP BY regime, user_id)),
b_summary AS (SELECT regime, count(*) AS n_blocks, list_sort(list(e))[count(*) // 2 + 1] AS point FROM b_blocks GROUP BY regime), {_draws_sql('regime', RESAMPLES)},
b_stats AS (SELECT x.regime, x.r, list_sort(list(y.e))[count(*) // 2 + 1] AS stat FROM b_draws x JOIN b_blocks y ON x.regime = y.regime AND x.i = y.i GROUP BY x.regime, x.r),
b_ends AS (SELECT regime, list_sort(list(stat))[{int((1 - CI) / 2 * RESAMPLES) + 1}] AS ci_lo, list_sort(list(stat))[{int((1 + CI) / 2 * RESAMPLES)}] AS ci_hi FROM b_stats GROUP BY regime)
SELECT x.regime, round(point, 9) AS point, round(ci_lo, 9) AS ci_lo, round(ci_hi, 9) AS ci_hi, n_blocks::INT AS n_blocks FROM b_summary x LEFT JOIN b_ends y ON x.regime = y.regime""",
    "bootstrap_deviation": f"""WITH {POINTS}, b_blocks AS (
  SELECT *, row_number() OVER (PARTITION BY regime ORDER BY user_id) - 1 AS i FROM (SELECT regime, user_id, count(*) AS m, sum(e) AS s, sum(e * e) AS q FROM (SELECT *, (p - y) * (p - y) AS e FROM points) GROUP BY regime, user_id)
), b_summary AS (SELECT regime, count(*) AS n_blocks, sqrt(greatest(sum(q) / sum(m) - (sum(s) / sum(m)) * (sum(s) / sum(m)), 0)) AS point FROM b_blocks GROUP BY regime), {_draws_sql('regime', RESAMPLES)},
b_stats AS (SELECT x.regime, x.r, sqrt(greatest(sum(q) / sum(m) - (sum(s) / sum(m)) * (sum(s) / sum(m)), 0)) AS stat FROM b_draws x JOIN b_blocks y ON x.regime = y.regime AND x.i = y.i GROUP BY x.regime, x.r),
b_ends AS (SELECT regime, list_sort(list(stat))[{int((1 - CI) / 2 * RESAMPLES) + 1}] AS ci_lo, list_sort(list(stat))[{int((1 + CI) / 2 * RESAMPLES)}] AS ci_hi FROM b_stats GROUP BY regime)
SELECT x.regime, round(point, 7) AS point, round(ci_lo, 7) AS ci_lo, round(ci_hi, 7) AS ci_hi, n_blocks FROM b_summary x LEFT JOIN b_ends y ON x.regime = y.regime""",
    "divergences": f"WITH RECURSIVE {AUTOMATON} SELECT user_id, t_start, round(p_start, 9) AS p_start, round(k_start, 9) AS k_start, round(gap, 9) AS gap FROM found",
    "convergence": f"WITH RECURSIVE {LEADS} SELECT user_id, t_start, round(lead, 9) AS lead FROM leads",
    "lead_lag_report": _lead_report_sql(LEADS + ", regimes AS (SELECT *, 'all' AS regime FROM leads)", "regimes", RESAMPLES),
    "regime_slices": f"""WITH {TICKS}, kickoff AS (SELECT user_id, min(t) AS kickoff FROM ticks WHERE event_type = 'purchase' GROUP BY user_id), sliced AS (
  SELECT t.user_id, t.venue, t.t, CASE WHEN t.t >= kickoff - {6 * HOUR} AND t.t < kickoff THEN 'pre_match' WHEN t.t BETWEEN kickoff AND kickoff + {DAY} THEN 'in_game' END AS slice
  FROM ticks t JOIN kickoff USING (user_id) WHERE venue IS NOT NULL
) SELECT slice, venue, count(*) AS n, count(DISTINCT user_id) AS users, min(t) AS first_t, max(t) AS last_t FROM sliced WHERE slice IS NOT NULL GROUP BY slice, venue""",
    "lagged_correlation": f"""WITH {GRID}, moves AS (SELECT user_id, t, p - lag(p) OVER w AS dp, k - lag(k) OVER w AS dk FROM grid WHERE p IS NOT NULL AND k IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY t)),
shifted AS (SELECT user_id, dk, dp AS p0, lead(dp, 1) OVER w AS p1, lead(dp, 2) OVER w AS p2 FROM moves WINDOW w AS (PARTITION BY user_id ORDER BY t)),
wide AS (SELECT user_id, corr(dk, p0) AS c0, corr(dk, p1) AS c1, corr(dk, p2) AS c2 FROM shifted GROUP BY user_id),
long AS (SELECT 0 AS lag, c0 AS c FROM wide UNION ALL SELECT 1, c1 FROM wide UNION ALL SELECT 2, c2 FROM wide)
SELECT lag, count(*) AS users, round(avg(c), 6) AS mean_corr FROM long WHERE c IS NOT NULL AND NOT isnan(c) GROUP BY lag""",
}
