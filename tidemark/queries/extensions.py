"""Beyond the gates: recalibration, the Granger corroborator, price impact, payloads that fan out, counts of a stream's batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import book
from tidemark.operators import asof, granger, isotonic
from tidemark.queries import market, names, records
from tidemark.sources import payloads
from tidemark.streaming import metrics, recorder
from tidemark.tables import folder

ORDERS = (10, 40, 200)  # contracts of an order that walks a ladder
LEVEL = "price double, size double"


def recalibration_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per venue and regime the rising curve of realised rates over prices in tenths of a cent."""
    cut = market.points(spark, sf_dir).withColumn("p", F.floor(F.col("p") * 1000) / 1000)
    curve = isotonic.recalibration_curve(cut, ["venue", "regime"], "p", "y")
    return curve.select("venue", "regime", "lo", "hi", "n", F.round("rate", 9).alias("rate"))


def granger_corroborator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user whether one venue's last move helps to foretell the other's next one."""
    rows = market.ticks(spark, sf_dir)
    aligned = asof.grid(market.of_venue(rows, "P"), market.of_venue(rows, "K"), ["user_id"], "t", "price", "p", "k", bucket=market.BUCKET)
    found = granger.granger(aligned, ["user_id"], "t", "p", "k", 1)
    return found.select("user_id", "n", *[F.round(c, 5).alias(c) for c in ("f_p_leads", "gain_p_leads", "f_k_leads", "gain_k_leads")])


def price_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What buying and selling three sizes does to each order's ladders."""
    sides = F.array(*[F.struct(F.lit(name).alias("side"), book.walked(F.col(ladder), buy).alias("steps")) for name, ladder, buy in (("buy", "asks", True), ("sell", "bids", False))])
    books = records.ladders(spark, sf_dir).select("l_orderkey", F.explode(sides).alias("x")).select("l_orderkey", "x.side", "x.steps")
    asked = books.select("l_orderkey", "side", F.explode(F.array(*[F.struct(F.lit(q).alias("size"), book.impact(F.col("steps"), F.lit(q)).alias("i")) for q in ORDERS])).alias("x"))
    kept = asked.where("x.i IS NOT NULL").select("l_orderkey", "side", "x.size", "x.i.*")
    return kept.select("l_orderkey", "side", "size", "filled", *[F.round(c, 9).alias(c) for c in ("mean_price", "last_price", "slippage")], "n_levels")


def payload_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's ladders as one JSON payload, turned into a row per level by a lateral join."""
    sent = records.ladders(spark, sf_dir).select("l_orderkey", F.to_json(F.struct(F.struct("bids", "asks").alias("book"))).alias("payload"))
    per_side = [payloads.fanned_out(sent, "payload", f"book.{side}", LEVEL).withColumn("side", F.lit(side)) for side in ("bids", "asks")]
    return per_side[0].unionByName(per_side[1]).select("l_orderkey", "side", "item", F.round("price", 9).alias("price"), "size")


def stream_batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events delivered three times as a stream of three batches that stores each once: what each batch admitted, stored and left out.

    Rows are late by the watermark of the batch before, so the second delivery is known and the third late, but for its last hour.
    """
    thrice, counts = folder(spark, "counted"), folder(spark, "counts")
    rows = spark.read.schema(names.STREAM_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    for _ in range(3):
        rows.write.mode("append").parquet(thrice)
    files = len(spark.read.schema(names.STREAM_SCHEMA).parquet(thrice).inputFiles()) // 3
    stream = spark.readStream.schema(names.STREAM_SCHEMA).option("maxFilesPerTrigger", max(files, 1)).parquet(thrice).withColumn("ts", F.col("ts").cast("timestamp"))
    once = metrics.counted(stream, lambda x: recorder.deduplicated(x, "ts", "1 hour", ["event_id"]))
    listener = metrics.BatchCounts(spark, counts)
    spark.streams.addListener(listener)
    try:
        names.drained(once, spark, "counted-out", listener.finished)
    finally:
        spark.streams.removeListener(listener)
    found = metrics.read(spark, counts).where("admitted > 0")
    return found.select("batch", "admitted", "stored", "late", "duplicates")


QUERIES = {f.__name__: f for f in (recalibration_curve, granger_corroborator, price_impact, payload_levels, stream_batch_counts)}


def _direction(y: str, own: str, other: str, name: str) -> str:
    """Regression with one own and one other lag, from centred sums."""
    s = lambda a, b: f"(sum({a} * {b}) - sum({a}) * sum({b}) / count(*))"
    flat = " OR ".join(f"{s(c, c)} <= {granger.FLAT} * sum({c} * {c})" for c in (own, other, y))
    return f"""CASE WHEN count(*) < 4 OR {flat} OR 1 - abs({s(own, other)} / sqrt({s(own, own)} * {s(other, other)})) < {granger.ALIKE} THEN NULL ELSE
  {s(y, y)} - {s(own, y)} * {s(own, y)} / {s(own, own)} END AS short_{name},
  {s(y, y)} AS total_{name}, {s(y, y)} - ({s(own, y)} * {s(own, y)} * {s(other, other)} - 2 * {s(own, other)} * {s(own, y)} * {s(other, y)} + {s(other, y)} * {s(other, y)} * {s(own, own)})
    / ({s(own, own)} * {s(other, other)} - {s(own, other)} * {s(own, other)}) AS full_{name}"""


def _tested(name: str) -> str:
    there = f"short_{name} IS NOT NULL AND full_{name} > {granger.FLAT} * total_{name}"
    return f"CASE WHEN {there} THEN round((short_{name} - full_{name}) / (full_{name} / (n - 3)), 5) END AS f_{name}_leads, CASE WHEN {there} THEN round(1 - full_{name} / short_{name}, 5) END AS gain_{name}_leads"


SQL = {
    "recalibration_curve": f"""WITH {market.POINTS}, c AS (SELECT venue, regime, floor(p * 1000) / 1000 AS x, count(*) AS n, sum(y) AS s FROM points GROUP BY ALL),
o AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(s) OVER w AS cs FROM c WINDOW w AS (PARTITION BY venue, regime ORDER BY x)),
means AS (SELECT a.venue, a.regime, a.i AS j, b.i AS i, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS m FROM o a JOIN o b ON a.venue = b.venue AND a.regime = b.regime AND b.i >= a.i),
least_on AS (SELECT venue, regime, i, min(m) OVER (PARTITION BY venue, regime, j ORDER BY i DESC) AS m FROM means),
fit AS (SELECT venue, regime, i, max(m) AS rate FROM least_on GROUP BY venue, regime, i)
SELECT venue, regime, min(x) AS lo, max(x) AS hi, CAST(sum(n) AS BIGINT) AS n, round(rate, 9) AS rate FROM fit JOIN o USING (venue, regime, i) GROUP BY venue, regime, rate""",
    "granger_corroborator": f"""WITH {market.GRID}, moves AS (SELECT user_id, t, p - lag(p) OVER w AS dp, k - lag(k) OVER w AS dk FROM grid WHERE p IS NOT NULL AND k IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY t)),
lagged AS (SELECT user_id, dp, dk, lag(dp) OVER w AS p1, lag(dk) OVER w AS k1 FROM moves WINDOW w AS (PARTITION BY user_id ORDER BY t)),
sums AS (SELECT user_id, count(*) AS n, {_direction('dk', 'k1', 'p1', 'p')}, {_direction('dp', 'p1', 'k1', 'k')} FROM lagged WHERE p1 IS NOT NULL GROUP BY user_id)
SELECT user_id, n, {_tested('p')}, {_tested('k')} FROM sums""",
    "price_impact": f"""WITH {records.LADDER}, taken AS (
  SELECT l_orderkey, 'buy' AS side, price, size, row_number() OVER w AS place, sum(size) OVER w - size AS before, sum(price * size) OVER w - price * size AS paid, count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM levels WHERE side = 'R' AND size > 0 WINDOW w AS (PARTITION BY l_orderkey ORDER BY price, size, pos ROWS UNBOUNDED PRECEDING)
  UNION ALL
  SELECT l_orderkey, 'sell', price, size, row_number() OVER w, sum(size) OVER w - size, sum(price * size) OVER w - price * size, count(*) OVER (PARTITION BY l_orderkey)
  FROM levels WHERE side = 'A' AND size > 0 WINDOW w AS (PARTITION BY l_orderkey ORDER BY price DESC, size, pos ROWS UNBOUNDED PRECEDING)
), ends AS (
  SELECT t.*, q.size AS wanted, first_value(price) OVER (PARTITION BY l_orderkey, side, q.size ORDER BY place) AS best FROM taken t, (VALUES {', '.join(f'({q})' for q in ORDERS)}) q(size)
), met AS (SELECT *, least(wanted::DOUBLE, before + size) AS filled FROM ends WHERE before < wanted AND (before + size >= wanted OR place = n)),
priced AS (SELECT *, (paid + (filled - before) * price) / filled AS mean FROM met)
SELECT l_orderkey, side, wanted AS size, filled, round(mean, 9) AS mean_price, round(price, 9) AS last_price, round(abs(mean - best), 9) AS slippage, place::INT AS n_levels FROM priced""",
    "payload_levels": f"WITH {records.LADDER} SELECT l_orderkey, CASE side WHEN 'A' THEN 'bids' ELSE 'asks' END AS side, (pos - 1)::INT AS item, round(price, 9) AS price, size::DOUBLE AS size FROM levels",
    "stream_batch_counts": """WITH mark AS (SELECT (epoch_ms(max(ts)) - 3600000) * 1000 AS w, count(*) AS n FROM events), gone AS (SELECT count(*) AS late FROM events, mark WHERE epoch_us(ts) <= w)
SELECT 0::BIGINT AS batch, n AS admitted, n AS stored, 0::BIGINT AS late, 0::BIGINT AS duplicates FROM mark UNION ALL SELECT 1, n, 0, 0, n FROM mark UNION ALL SELECT 2, n, 0, late, n - late FROM mark, gone""",
}
