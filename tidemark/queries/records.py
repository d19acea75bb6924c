"""Books, store, alignment and gate queries: ``lineitem`` as ladders, ``events`` as fixtures.

In an order, returned lines ('R') are asks and accepted ones ('A') bids; the price is
extended price over quantity, in whole cents.  For fixtures a user is a pair, k % 10 a map number, the day
that of the event; purchases are the neutral spine, clicks venue K, views venue P.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.functions import book, clock, text
from tidemark.operators import matching, scoring, store
from tidemark.params import Bootstrap, Calibration, Census, LeadLag, Parity
from tidemark.plans import gates
from tidemark.queries import market
from tidemark.queries.market import HOUR, TICKS, ticks
from tidemark.streaming.recorder import capped
from tidemark.tables import materialise, scratch

FAMILIES = ("series_winner", "map_winner")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def line_price() -> Column:
    """Cents cut off, so that no rounding of it can tie."""
    return F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100


def ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: ``bids`` and ``asks``, in the order of line, part, supplier and price."""
    rows = lines(spark, sf_dir).where("l_returnflag IN ('A', 'R')")
    level = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", line_price().alias("price"), F.col("l_quantity").alias("size"))

    def side(flag: str) -> Column:
        found = F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == flag, level)))
        return F.transform(found, lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size")))

    return rows.groupBy("l_orderkey").agg(side("A").alias("bids"), side("R").alias("asks"))


def best_of_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ladders(spark, sf_dir).withColumn("b", book.best_bid(F.col("bids"))).withColumn("a", book.best_ask(F.col("asks")))
    return rows.select("l_orderkey", F.round("b.price", 9).alias("bid"), F.col("b.size").alias("bid_size"), F.round("a.price", 9).alias("ask"), F.col("a.size").alias("ask_size"))


def ladder_notional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladders(spark, sf_dir).select("l_orderkey", book.notional(F.col("bids")).alias("full_bid_usd"), book.notional(F.col("asks")).alias("full_ask_usd"))


def book_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = book.snapshot(F.col("bids"), F.col("asks"), F.struct("bids", "asks"))
    return ladders(spark, sf_dir).select("l_orderkey", *columns).withColumn("best_bid", F.round("best_bid", 9)).withColumn("best_ask", F.round("best_ask", 9)).drop("raw_json")


def normalize_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = line_price()
    bid, ask = F.when(F.col("l_returnflag") != "N", price), F.when(F.col("l_linestatus") == "O", price * 2)
    rows = lines(spark, sf_dir).withColumn("bid", bid).withColumn("ask", ask)
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return rows.select(*key, book.mid(F.col("bid"), F.col("ask")).alias("mid"), book.usd(F.col("bid"), F.col("l_quantity")).alias("bid_usd"), book.usd(F.col("ask"), F.col("l_quantity")).alias("ask_usd"))


def depth_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("bid_usd", F.when(F.col("l_quantity") > 5, F.col("l_extendedprice"))).withColumn("ask_usd", F.col("l_quantity") * 1000.0)
    found = scoring.depth_stats(rows, ["l_returnflag", "l_linestatus"], "bid_usd", "ask_usd")
    return found.select("l_returnflag", "l_linestatus", "n", *[F.round(c, 6).alias(c) for c in ("median_usd", "p25_usd", "p75_usd", "min_usd", "max_usd")])


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures_of(ticks(spark, sf_dir))


def fixtures_of(rows: DataFrame) -> DataFrame:
    settled = F.when(F.col("k") % 9 == 0, None).when(F.col("k") >= 50, "a").otherwise("b")
    return rows.select(
        "event_id", "user_id", "event_type", "t", clock.day(F.col("ts")).alias("day"), (F.col("k") % 10).alias("map_no"), settled.alias("winner"),
        F.when(F.col("event_type") == "purchase", "N").otherwise(F.col("venue")).alias("side"), F.when(F.col("k") >= 50, "map_winner").otherwise("series_winner").alias("family"),
    )


FIXTURES_CTE = """fixtures AS (
  SELECT event_id, user_id, event_type, t, CAST(ts AS DATE) AS day, k % 10 AS map_no, CASE WHEN k % 9 = 0 THEN NULL WHEN k >= 50 THEN 'a' ELSE 'b' END AS winner,
    CASE WHEN event_type = 'purchase' THEN 'N' ELSE venue END AS side, CASE WHEN k >= 50 THEN 'map_winner' ELSE 'series_winner' END AS family FROM ticks
)"""
FIXTURES = f"{TICKS}, {FIXTURES_CTE}"


def of_side(rows: DataFrame, side: str, *columns: str) -> DataFrame:
    return rows.where(F.col("side") == side).select("event_id", "user_id", "day", "map_no", "winner", *columns)


def pair_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures(spark, sf_dir).withColumn("pair", F.array_join(text.pair_key((F.col("user_id") % 7).cast("string"), F.col("map_no").cast("string")), "|"))
    found = matching.prefer_settled(rows.select("pair", "day", "winner", "event_id"), ["pair", "day"], "winner", "event_id")
    return found.select("pair", "day", "winner", "event_id", "slot")


def series_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.series_first(fixtures(spark, sf_dir), ["user_id", "day"], ["t", "event_id"]).select("user_id", "day", "event_id", "map_no")


def _first_hits(left: DataFrame, right: DataFrame, prefix: str) -> DataFrame:
    return matching.banded_first_match(left, right, "day", ["user_id", "map_no"], 1, prefix, "event_id", ["event_id", "winner"])


def banded_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures(spark, sf_dir)
    return _first_hits(of_side(rows, "N"), of_side(rows, "P"), "p_").select("event_id", "p_event_id", "p_winner")


def aligned_three_way(rows: DataFrame) -> DataFrame:
    """Of fixtures the settled ones of the spine with those of both venues."""
    both = _first_hits(_first_hits(of_side(rows, "N"), of_side(rows, "K"), "k_"), of_side(rows, "P"), "p_")
    return both.where("winner IS NOT NULL AND k_winner IS NOT NULL AND p_winner IS NOT NULL")


def align_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_three_way(fixtures(spark, sf_dir)).select("event_id", "winner", "k_event_id", "k_winner", "p_event_id", "p_winner")


def parity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.parity_counts(aligned_three_way(fixtures(spark, sf_dir)), [], "winner", "k_winner", "p_winner")
    return found.select("n_aligned", "n_agree", *[F.round(c, 9).alias(c) for c in ("pass_rate", "first_rate", "second_rate")])


def voids(rows: DataFrame) -> DataFrame:
    return matching.void_breaks(of_side(rows, "P"), of_side(rows, "N"), ["user_id", "day", "map_no"], ["user_id", "day"], "winner")


def void_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voids(fixtures(spark, sf_dir)).select("event_id", "user_id", "day", "map_no", "winner")


def coverage_all_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures(spark, sf_dir).where("side IN ('K', 'P')")
    return matching.present_everywhere(rows, ["user_id", "day", "map_no"], "side", ["K", "P"])


def covered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    records = rows.where("side IN ('K', 'P')").select("user_id", "day", F.col("side").alias("venue"), "family")
    return gates.coverage(rows.where("side = 'N'"), records, ["user_id"], "day", ["K", "P"], FAMILIES), records


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covered(fixtures(spark, sf_dir))[0].select("user_id", "day", "covered", "covered_series_winner", "covered_map_winner")


def existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = covered(fixtures(spark, sf_dir))[1]
    return rows.groupBy("venue").agg(F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"))


def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of a user and an hour: the first half of the month is there, the second half comes in; the venue stays."""
    rows = ticks(spark, sf_dir).withColumn("slot", (F.col("t") / (24 * HOUR)).cast("bigint") % 15)
    columns = ["user_id", "slot", "event_type", "price", "event_id"]
    old = rows.where("regime = 'pre_match'").groupBy("user_id", "slot").agg(F.min_by(F.struct("event_type", "price", "event_id"), "event_id").alias("r")).select("user_id", "slot", "r.*")
    new = rows.where("regime = 'in_game'").select(*columns).withColumn("seq", F.col("event_id"))
    return store.last_wins(old, new, ["user_id", "slot"], keep=["event_type"], seq=["seq"])


def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir).select("user_id", "event_type", F.date_trunc("day", "ts").alias("day"), "event_id", "price", "regime")
    old, new = (rows.where(F.col("regime") == r).withColumn("slot", F.dayofmonth("day") % 15).drop("regime", "day") for r in ("pre_match", "in_game"))
    return store.first_wins(old, new, ["user_id", "event_type", "slot"], seq=["event_id"]).select("user_id", "event_type", "slot", "price")


def discard_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures(spark, sf_dir)
    reason = F.when(F.col("side").isNull(), "no venue").when(F.col("winner").isNull(), "no winner").otherwise("map too high")
    _, lost = store.discarded(rows, "G1", F.col("side").isNotNull() & F.col("winner").isNotNull() & (F.col("map_no") < 8), reason)
    return lost


def cap_and_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir).where("venue IS NOT NULL")
    kept, counts = capped(rows, "venue", ["t", "event_id"], 400)
    return kept.groupBy("venue").agg(F.max("event_id").alias("last_kept")).join(counts, "venue")


def group_exactly_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("seq", F.col("l_linenumber") * 1_000_000 + F.col("l_partkey"))
    won = F.col("l_returnflag") == "R"
    found = matching.exact_pairs(rows, ["l_orderkey"], "seq", won, ["l_suppkey"])
    return found.select("l_orderkey", F.col("a.seq").alias("a_seq"), F.col("b.seq").alias("b_seq"), "winner_first")


def foreign_key_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without an order, by return flag."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    found = schema.orphans(lines(spark, sf_dir), orders, "l_orderkey", "o_orderkey")
    return found.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first_order"))


def _g0(rows: DataFrame) -> DataFrame:
    series, records = covered(fixtures_of(rows))
    quotes = rows.where("venue = 'P'").withColumn("bid_usd", F.col("value") * F.col("k")).withColumn("ask_usd", F.when(F.col("k") > 10, F.col("value") * 40))
    depth = scoring.depth_stats(quotes, ["regime"], "bid_usd", "ask_usd")
    found = gates.census(series, depth, records.select("venue", "family").distinct(), ["K", "P"], Census())
    return found.withColumn("coverage", F.round("coverage", 9))


def gate_g0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _g0(ticks(spark, sf_dir))


def _g1(rows: DataFrame, params: Parity = Parity()) -> DataFrame:
    maps = fixtures_of(rows)
    counts = matching.parity_counts(aligned_three_way(maps), [], "winner", "k_winner", "p_winner")
    n_void = voids(maps).agg(F.count(F.lit(1)).alias("_void"))
    return gates.parity(counts.crossJoin(n_void), F.col("_void"), params).drop("_void")


def gate_g1(spark: SparkSession, sf_dir: str, params: Parity = Parity()) -> DataFrame:
    return _g1(ticks(spark, sf_dir), params).select("n_aligned", "n_agree", F.round("pass_rate", 9).alias("pass_rate"), "n_void", "passed")


def _g2(rows: DataFrame) -> DataFrame:
    return gates.calibration(market.points_of(rows), Calibration())


def gate_g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _g2(ticks(spark, sf_dir)).select("regime", F.round("ece_reference", 9).alias("ece_reference"), F.round("ece_target", 9).alias("ece_target"), "least_n", "n_points", "passed")


def _g3(rows: DataFrame, params: Bootstrap = Bootstrap()) -> DataFrame:
    p, k = (rows.where(F.col("venue") == v).select("user_id", "regime", "t", "price") for v in ("P", "K"))
    return gates.lead_lag(p, k, ["user_id"], "t", "price", "user_id", LeadLag(threshold=0.1, confirmations=3), 24 * HOUR, params.resamples, params.seed, params.ci_level, market.BUCKET)


def gate_g3(spark: SparkSession, sf_dir: str, params: Bootstrap = Bootstrap()) -> DataFrame:
    return _g3(ticks(spark, sf_dir), params).select("regime", F.col("n").alias("n_divergences"), *[F.round(c, 9).alias(c) for c in ("point", "ci_lo", "ci_hi")], "n_blocks", "leader", "passed")


def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events are parsed and each gate is judged once; both are written, as the verdict and several gates read them more than once."""
    with scratch() as keep:
        rows = materialise(ticks(spark, sf_dir).where("event_type = 'purchase' OR venue IS NOT NULL"), "verdict-ticks")
        found = gates.verdict(*[materialise(gate(rows), f"verdict-{gate.__name__}") for gate in (_g0, _g1, _g2, _g3)])
        return keep(materialise(found.withColumn("blockers", F.array_join("blockers", ",")), "verdict"))


QUERIES = {
    f.__name__: f
    for f in (
        best_of_ladder, ladder_notional, book_snapshot, normalize_quote, depth_stats, pair_key_dedup, series_collapse, banded_first_match, align_three_way, parity_counts, void_breaks, coverage_all_venues,
        coverage_report, existence, upsert_last_wins, insert_if_absent, discard_reasons, cap_and_drop, group_exactly_two, foreign_key_orphans, gate_g0, gate_g1, gate_g2, gate_g3, verdict,
    )
}

LADDER = """levels AS (
  SELECT l_orderkey, l_returnflag AS side, floor(l_extendedprice / l_quantity * 100) / 100 AS price, l_quantity AS size,
    row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS pos
  FROM lineitem WHERE l_returnflag IN ('A', 'R')
), books AS (
  SELECT l_orderkey, first(price ORDER BY price DESC, pos) FILTER (side = 'A') AS bid, first(size ORDER BY price DESC, pos) FILTER (side = 'A') AS bid_size,
    first(price ORDER BY price, pos) FILTER (side = 'R') AS ask, first(size ORDER BY price, pos) FILTER (side = 'R') AS ask_size,
    round(sum(price * size) FILTER (side = 'A'), 2) AS full_bid_usd, round(sum(price * size) FILTER (side = 'R'), 2) AS full_ask_usd, count(*)::INT AS n_levels
  FROM levels GROUP BY l_orderkey
)"""

HIT = """(SELECT min(struct_pack(s := date_diff('day', n.day, x.day), e := x.event_id, w := x.winner)) FROM fixtures x
  WHERE x.side = '{side}' AND x.user_id = n.user_id AND x.map_no = n.map_no AND abs(date_diff('day', n.day, x.day)) <= 1)"""
THREE_CTE = f"""hits AS (SELECT n.event_id, n.winner, {HIT.format(side='K')} AS kh, {HIT.format(side='P')} AS ph FROM fixtures n WHERE n.side = 'N'),
aligned AS (SELECT event_id, winner, kh.e AS k_event_id, kh.w AS k_winner, ph.e AS p_event_id, ph.w AS p_winner FROM hits WHERE winner IS NOT NULL AND kh.w IS NOT NULL AND ph.w IS NOT NULL)"""
THREE = f"{FIXTURES}, {THREE_CTE}"
COUNTS = """count(*) AS n_aligned, count(*) FILTER (k_winner = p_winner AND k_winner = winner) AS n_agree,
  CASE WHEN count(*) > 0 THEN round(count(*) FILTER (k_winner = p_winner AND k_winner = winner) / count(*), 9) END AS pass_rate"""
VOIDS = """voids AS (SELECT event_id, user_id, day, map_no, winner FROM fixtures p WHERE side = 'P' AND winner IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM fixtures n WHERE n.side = 'N' AND n.user_id = p.user_id AND n.day = p.day AND n.map_no = p.map_no)
  AND EXISTS (SELECT 1 FROM fixtures n WHERE n.side = 'N' AND n.user_id = p.user_id AND n.day = p.day))"""
COVERED_CTE = """series AS (SELECT DISTINCT user_id, day FROM fixtures WHERE side = 'N'),
flags AS (
  SELECT s.user_id, s.day, count(DISTINCT r.side) AS n_all, count(DISTINCT r.side) FILTER (r.family = 'series_winner') AS n_s, count(DISTINCT r.side) FILTER (r.family = 'map_winner') AS n_m
  FROM series s LEFT JOIN fixtures r ON r.side IN ('K', 'P') AND r.user_id = s.user_id AND abs(date_diff('day', s.day, r.day)) <= 1 GROUP BY s.user_id, s.day
), covered AS (SELECT user_id, day, n_all = 2 AS covered, n_all = 2 AND n_s = 2 AS covered_series_winner, n_all = 2 AND n_m = 2 AS covered_map_winner FROM flags)"""
COVERED = f"{FIXTURES}, {COVERED_CTE}"
G0_CTE = """medians AS (
  SELECT regime, median(least(value * k, value * 40)) AS m FROM ticks WHERE venue = 'P' AND k > 10 GROUP BY regime
), there AS (SELECT family, count(DISTINCT side) = 2 AS both_venues FROM fixtures WHERE side IN ('K', 'P') GROUP BY family),
totals AS (SELECT count(*) AS n_series, count(*) FILTER (covered) AS n_covered, count(*) FILTER (covered_series_winner) AS n_s, count(*) FILTER (covered_map_winner) AS n_m FROM covered),
g0 AS (
  SELECT f.family, n_series, n_covered, (SELECT bool_or(m >= 250) FROM medians) AS depth_pass, round(CASE WHEN n_series > 0 THEN n_covered / n_series ELSE 0 END, 9) AS coverage, n_covered >= 60 AS coverage_pass,
    CASE f.family WHEN 'map_winner' THEN n_m ELSE n_s END AS n_family, coalesce(both_venues, false) AS both_venues
  FROM totals, (VALUES ('series_winner'), ('map_winner')) f(family) LEFT JOIN there t ON t.family = f.family
)"""
G0 = f"{COVERED}, {G0_CTE}"
G1 = "g1 AS (SELECT *, CASE WHEN n_aligned >= 30 THEN pass_rate >= 0.95 AND n_void = 0 END AS passed FROM (SELECT " + COUNTS + ", (SELECT count(*) FROM voids) AS n_void FROM aligned))"
G2 = """g2 AS (
  SELECT regime, round(max(ece) FILTER (venue = 'K'), 9) AS ece_reference, round(max(ece) FILTER (venue = 'P'), 9) AS ece_target, min(n) AS least_n, CAST(sum(n) AS BIGINT) AS n_points,
    CASE WHEN min(n) >= 50 THEN max(ece) FILTER (venue = 'K') <= max(ece) FILTER (venue = 'P') END AS passed FROM ece GROUP BY regime
)"""


G3_CTE = f"""{market.leads_cte(('user_id', 'regime'))}, {market._bootstrap('leads', 'regime', 'lead', market.RESAMPLES)}, g3 AS (
  SELECT x.regime, x.n AS n_divergences, CASE WHEN n_blocks >= 2 THEN point END AS point, ci_lo, ci_hi, n_blocks, CASE WHEN ci_lo > 0 THEN 'K' WHEN ci_hi < 0 THEN 'P' END AS leader,
    CASE WHEN x.n >= 30 THEN coalesce(ci_lo > 0, false) END AS passed
  FROM b_summary x LEFT JOIN b_ends y ON x.regime = y.regime
)"""
G3 = f"{market.ASOF}, {G3_CTE}"

SQL = {
    "best_of_ladder": f"WITH {LADDER} SELECT l_orderkey, round(bid, 9) AS bid, bid_size, round(ask, 9) AS ask, ask_size FROM books",
    "ladder_notional": f"WITH {LADDER} SELECT l_orderkey, full_bid_usd, full_ask_usd FROM books",
    "book_snapshot": f"""WITH {LADDER} SELECT l_orderkey, round(bid, 9) AS best_bid, round(ask, 9) AS best_ask, round((bid + ask) / 2, 6) AS mid,
  CASE WHEN bid IS NOT NULL AND ask IS NOT NULL AND bid_size <> 0 THEN round(bid * bid_size, 2) END AS top_bid_usd, CASE WHEN bid IS NOT NULL AND ask IS NOT NULL AND ask_size <> 0 THEN round(ask * ask_size, 2) END AS top_ask_usd,
  full_bid_usd, full_ask_usd, n_levels, (bid IS NOT NULL AND ask IS NOT NULL)::INT AS book_ok FROM books""",
    "normalize_quote": """WITH q AS (SELECT *, CASE WHEN l_returnflag <> 'N' THEN floor(l_extendedprice / l_quantity * 100) / 100 END AS bid, CASE WHEN l_linestatus = 'O' THEN floor(l_extendedprice / l_quantity * 100) / 100 * 2 END AS ask FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((bid + ask) / 2, 6) AS mid, round(bid * l_quantity, 2) AS bid_usd, round(ask * l_quantity, 2) AS ask_usd FROM q""",
    "depth_stats": """WITH d AS (SELECT l_returnflag, l_linestatus, least(l_extendedprice, l_quantity * 1000.0) AS depth FROM lineitem WHERE l_quantity > 5),
l AS (SELECT l_returnflag, l_linestatus, count(*) AS n, median(depth) AS m, list_sort(list(depth)) AS s FROM d GROUP BY ALL)
SELECT l_returnflag, l_linestatus, n, round(m, 6) AS median_usd, round(s[CAST(round_even(0.25 * (n - 1), 0) AS INT) + 1], 6) AS p25_usd, round(s[CAST(round_even(0.75 * (n - 1), 0) AS INT) + 1], 6) AS p75_usd,
  round(s[1], 6) AS min_usd, round(s[n], 6) AS max_usd FROM l""",
    "pair_key_dedup": f"""WITH {FIXTURES}, x AS (SELECT *, CASE WHEN (user_id % 7)::VARCHAR = map_no::VARCHAR THEN map_no::VARCHAR ELSE least((user_id % 7)::VARCHAR, map_no::VARCHAR) || '|' || greatest((user_id % 7)::VARCHAR, map_no::VARCHAR) END AS pair FROM fixtures)
SELECT pair, day, winner, event_id, min(event_id) OVER (PARTITION BY pair, day) AS slot FROM x QUALIFY row_number() OVER (PARTITION BY pair, day ORDER BY winner IS NULL, event_id) = 1""",
    "series_collapse": f"WITH {FIXTURES} SELECT user_id, day, event_id, map_no FROM fixtures QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY t, event_id) = 1",
    "banded_first_match": f"WITH {THREE} SELECT event_id, ph.e AS p_event_id, ph.w AS p_winner FROM hits",
    "align_three_way": f"WITH {THREE} SELECT * FROM aligned",
    "parity_counts": f"""WITH {THREE} SELECT {COUNTS}, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (k_winner = winner) / count(*), 9) ELSE 0 END AS first_rate,
  CASE WHEN count(*) > 0 THEN round(count(*) FILTER (p_winner = winner) / count(*), 9) ELSE 0 END AS second_rate FROM aligned""",
    "void_breaks": f"WITH {FIXTURES}, {VOIDS} SELECT * FROM voids",
    "coverage_all_venues": f"WITH {FIXTURES} SELECT user_id, day, map_no FROM fixtures WHERE side = 'K' INTERSECT SELECT user_id, day, map_no FROM fixtures WHERE side = 'P'",
    "coverage_report": f"WITH {COVERED} SELECT * FROM covered",
    "existence": f"WITH {FIXTURES} SELECT side AS venue, array_to_string(list_sort(list(DISTINCT family)), ',') AS families FROM fixtures WHERE side IN ('K', 'P') GROUP BY side",
    "upsert_last_wins": f"""WITH {TICKS}, x AS (SELECT *, t // {24 * HOUR} % 15 AS slot FROM ticks),
o AS (SELECT user_id, slot, event_type, price, event_id FROM x WHERE regime = 'pre_match' QUALIFY row_number() OVER (PARTITION BY user_id, slot ORDER BY event_id) = 1),
n AS (SELECT user_id, slot, price, event_id, first(event_type) OVER (PARTITION BY user_id, slot ORDER BY event_id) AS venue FROM x WHERE regime = 'in_game' QUALIFY row_number() OVER (PARTITION BY user_id, slot ORDER BY event_id DESC) = 1)
SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.slot, n.slot) AS slot, coalesce(o.event_type, n.venue) AS event_type, coalesce(n.price, o.price) AS price, coalesce(n.event_id, o.event_id) AS event_id
FROM o FULL JOIN n ON o.user_id = n.user_id AND o.slot = n.slot""",
    "insert_if_absent": f"""WITH {TICKS}, x AS (SELECT *, (dayofmonth(ts) % 15)::INT AS slot FROM ticks)
SELECT user_id, event_type, slot, price FROM x n WHERE regime = 'in_game' AND NOT EXISTS (SELECT 1 FROM x o WHERE o.regime = 'pre_match' AND o.user_id = n.user_id AND o.event_type = n.event_type AND o.slot = n.slot)
QUALIFY row_number() OVER (PARTITION BY user_id, event_type, slot ORDER BY event_id) = 1""",
    "discard_reasons": f"""WITH {FIXTURES} SELECT 'G1' AS stage, CASE WHEN side IS NULL THEN 'no venue' WHEN winner IS NULL THEN 'no winner' ELSE 'map too high' END AS reason, count(*) AS n
FROM fixtures WHERE NOT coalesce(side IS NOT NULL AND winner IS NOT NULL AND map_no < 8, false) GROUP BY ALL""",
    "cap_and_drop": f"""WITH {TICKS}, x AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY t, event_id) AS n FROM ticks WHERE venue IS NOT NULL)
SELECT venue, max(event_id) FILTER (n <= 400) AS last_kept, least(count(*), 400) AS n_kept, greatest(count(*) - 400, 0) AS n_dropped FROM x GROUP BY venue""",
    "group_exactly_two": """WITH x AS (SELECT l_orderkey, l_linenumber::BIGINT * 1000000 + l_partkey AS seq, l_suppkey, l_returnflag = 'R' AS won FROM lineitem),
g AS (SELECT l_orderkey, list(struct_pack(seq := seq, s := l_suppkey, won := won) ORDER BY seq, l_suppkey, won) AS s FROM x GROUP BY l_orderkey HAVING count(*) = 2 AND count(*) FILTER (won) = 1)
SELECT l_orderkey, s[1].seq AS a_seq, s[2].seq AS b_seq, s[1].won AS winner_first FROM g""",
    "foreign_key_orphans": """SELECT l_returnflag, count(*) AS n, min(l_orderkey) AS first_order FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey) GROUP BY l_returnflag""",
    "gate_g0": f"WITH {G0} SELECT *, both_venues AND n_family >= 60 AS go_on FROM g0",
    "gate_g1": f"WITH {THREE}, {VOIDS}, {G1} SELECT n_aligned, n_agree, pass_rate, n_void, passed FROM g1",
    "gate_g2": f"WITH {market.CURVE}, {G2} SELECT * FROM g2",
    "gate_g3": f"WITH RECURSIVE {G3} SELECT regime, n_divergences, round(point, 9) AS point, round(ci_lo, 9) AS ci_lo, round(ci_hi, 9) AS ci_hi, n_blocks, leader, passed FROM g3",
    "verdict": f"""WITH RECURSIVE {G3}, {market.POINTS_CTE}, {market.CURVE_CTE}, {G2}, {FIXTURES_CTE}, {COVERED_CTE}, {G0_CTE}, {THREE_CTE}, {VOIDS}, {G1},
rows AS (
  SELECT coalesce(a.regime, b.regime) AS regime, a.passed AS calibration_pass, b.passed AS lead_pass, b.leader, (SELECT bool_or(depth_pass) FROM g0) AS depth_pass, (SELECT coalesce(bool_and(passed), false) FROM g1) AS parity_pass
  FROM g2 a FULL JOIN g3 b ON a.regime = b.regime
), flagged AS (SELECT *, coalesce(parity_pass AND calibration_pass AND lead_pass, false) AS reference_valid FROM rows), corroborated AS (SELECT false AS live),
judged AS (SELECT flagged.*, reference_valid AND coalesce(depth_pass, false) AND live AS tradeable FROM flagged, corroborated)
SELECT *, CASE WHEN (SELECT bool_or(tradeable) FROM judged) THEN 'GO' WHEN (SELECT bool_or(reference_valid) FROM judged) THEN 'CONDITIONAL' ELSE 'KILL' END AS verdict,
  CASE WHEN (SELECT bool_or(reference_valid) AND NOT bool_or(tradeable) FROM judged) THEN CASE WHEN coalesce(depth_pass, false) THEN 'no live corroboration' ELSE 'depth,no live corroboration' END ELSE '' END AS blockers FROM judged""",
}
