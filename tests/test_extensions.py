"""Recalibration, the Granger test, price impact, payload rows and batch counts against plain versions."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidemark.functions import book
from tidemark.operators import granger, isotonic
from tidemark.sources import payloads
from tidemark.streaming import metrics


def min_max(points):
    """The isotonic regression by its formula: the largest over beginnings of the smallest mean over ends."""
    xs = sorted({x for x, _ in points})
    n, s = (np.array([sum(f(y) for x, y in points if x == at) for at in xs], float) for f in (lambda y: 1, float))
    mean = lambda a, b: s[a : b + 1].sum() / n[a : b + 1].sum()
    return {x: max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i, x in enumerate(xs)}


@pytest.mark.parametrize("seed", range(3))
def test_recalibration_curve_equals_its_formula(spark, seed):
    rng = random.Random(seed)
    data = [(key, round(rng.random(), 2), float(rng.random() < 0.5)) for key, n in (("hot", 400), ("b", 30), (None, 20), ("one", 1)) for _ in range(n)]
    odd = [("hot", None, 1.0), ("hot", 0.5, None), ("hot", float("nan"), 1.0), ("b", 0.2, float("nan"))]
    points = spark.createDataFrame(data + odd, "key string, p double, y double").repartition(7)
    curve = isotonic.recalibration_curve(points, ["key"], "p", "y").collect()
    for key in ("hot", "b", None, "one"):
        want = min_max([(p, y) for k, p, y in data if k == key])
        blocks = sorted((r.lo, r.hi, r.n, r.rate) for r in curve if r.key == key)
        assert sum(b[2] for b in blocks) == sum(k == key for k, _, _ in data)
        assert all(a[1] < b[0] and a[3] < b[3] for a, b in zip(blocks, blocks[1:], strict=False))
        for x, rate in want.items():
            (found,) = [b[3] for b in blocks if b[0] <= x <= b[1]]
            assert found == pytest.approx(rate)


def test_recalibration_curve_of_falling_rates_is_one_block_and_of_nothing_empty(spark):
    falling = spark.range(1000).select((F.col("id") / 1000).alias("p"), (F.col("id") < 300).cast("int").alias("y")).repartition(5)
    (row,) = isotonic.recalibration_curve(falling, [], "p", "y").collect()
    assert (row.lo, row.hi, row.n, row.rate) == (0.0, 0.999, 1000, 0.3)
    assert isotonic.recalibration_curve(falling.where("p < 0"), [], "p", "y").count() == 0


def plain_f(y, own, other, lags):
    """By numpy's least squares over the moves themselves."""
    rows = range(lags, len(y))
    short = np.array([[1, *[own[i - j] for j in range(1, lags + 1)]] for i in rows])
    full = np.array([[1, *[own[i - j] for j in range(1, lags + 1)], *[other[i - j] for j in range(1, lags + 1)]] for i in rows])
    target = np.array([y[i] for i in rows])
    left = [float(((target - x @ np.linalg.lstsq(x, target, rcond=None)[0]) ** 2).sum()) for x in (short, full)]
    free = len(target) - 1 - 2 * lags
    return (left[0] - left[1]) / lags / (left[1] / free), 1 - left[1] / left[0]


@pytest.mark.parametrize(("lags", "size"), [(1, 3), (1, 100_000), (2, 7), (3, 50)])
def test_granger_equals_least_squares_however_a_key_is_cut(spark, lags, size):
    rng = np.random.default_rng(lags)
    series = {}
    for key, n in (("a", 200), ("b", 12 + 2 * lags), (None, 60)):
        p = np.cumsum(rng.normal(size=n))
        k = np.concatenate([[0, 0], p[:-2]]) + rng.normal(size=n) * 0.3
        series[key] = (p, k)
    rows = [(key, t * 3, float(p), float(k)) for key, (ps, ks) in series.items() for t, (p, k) in enumerate(zip(ps, ks, strict=True))]
    rows += [("flat", t, 0.5, float(t % 3)) for t in range(30)] + [("same", t, float(t * t % 7), float(t * t % 7)) for t in range(30)] + [("short", t, float(t % 2), float(t % 3)) for t in range(4)]
    rows += [("a", None, 1.0, 1.0), ("a", 1, None, 1.0), ("a", 1, 1.0, None)]
    aligned = spark.createDataFrame(rows, "key string, t long, p double, k double").repartition(5)
    found = {r.key: r for r in granger.granger(aligned, ["key"], "t", "p", "k", lags, size).collect()}
    assert None not in found  # a null key is no key
    for key in ("a", "b"):
        dp, dk = (np.diff(x) for x in series[key])
        assert found[key].n == len(dp) - lags
        assert (found[key].f_p_leads, found[key].gain_p_leads) == pytest.approx(plain_f(dk, dk, dp, lags))
        assert (found[key].f_k_leads, found[key].gain_k_leads) == pytest.approx(plain_f(dp, dp, dk, lags))
    assert found["a"].f_p_leads > found["a"].f_k_leads
    assert all(found[x].f_p_leads is None and found[x].f_k_leads is None for x in ("flat", "same"))
    assert "short" not in found or found["short"].f_p_leads is None


def test_granger_refuses_chunks_that_hold_no_past(spark):
    with pytest.raises(ValueError, match="size"):
        granger.granger(spark.createDataFrame([], "key string, t long, p double, k double"), ["key"], "t", "p", "k", 3, 4)
    assert granger.granger(spark.createDataFrame([], "key string, t long, p double, k double"), ["key"], "t", "p", "k").count() == 0


def test_price_impact_walks_the_ladder(spark):
    rng = random.Random(5)
    ladders = [[(round(rng.random(), 2), float(rng.randrange(0, 9))) for _ in range(rng.randrange(8))] for _ in range(60)] + [[(None, 3.0), (0.4, None), (0.5, 2.0)], [], None]
    rows = [(i, ladder) for i, ladder in enumerate(ladders)]
    df = spark.createDataFrame(rows, "id int, ladder array<struct<price:double,size:double>>")
    for buy in (True, False):
        for size in (1, 5.5, 40, 0, -1):
            got = {r.id: r.i for r in df.select("id", book.impact(book.walked(F.col("ladder"), buy), F.lit(size)).alias("i")).collect()}
            for i, ladder in rows:
                levels = sorted(((p, s) for p, s in ladder or () if p is not None and s), key=lambda x: (x[0] if buy else -x[0], x[1]))
                if not levels or size <= 0:
                    assert got[i] is None
                    continue
                left, paid, n = size, 0.0, 0
                for p, s in levels:
                    if left <= 0:
                        break
                    paid, left, n, last = paid + p * min(s, left), left - min(s, left), n + 1, p
                mean = paid / (size - max(left, 0))
                assert tuple(got[i]) == pytest.approx((size - max(left, 0), mean, last, abs(mean - levels[0][0]), n))


PAYLOADS = [
    ('{"book": {"asks": [{"price": "0.5", "size": 3, "more": 1}, ["0.25", 7], {"size": true}, 0.75, null]}}', [(0, 0.5, 3), (1, 0.25, 7), (2, None, None), (3, 0.75, None), (4, None, None)]),
    ('{"book": {"asks": []}}', []), ('{"book": {"asks": 3}}', []), ('{"book": [1]}', []), ("no json", []), ("", []), (None, []), ("[" * 100_000, []),
]


def test_payload_rows_are_those_of_the_list_at_the_path(spark):
    rows = spark.createDataFrame(list(enumerate(p for p, _ in PAYLOADS)), "id int, payload string")
    found = payloads.fanned_out(rows, "payload", "book.asks", "price double, size bigint")
    assert [f.name for f in found.schema] == ["id", "payload", "item", "price", "size"]
    assert sorted((r.id, r["item"], r.price, r["size"]) for r in found.where("item < 2").collect()) == [(0, 0, 0.5, 3), (0, 1, 0.25, 7)]
    assert [(r["item"], r.price, r["size"]) for r in sorted(found.collect(), key=lambda r: r["item"])] == PAYLOADS[0][1]
    kept = payloads.fanned_out(rows, "payload", "book.asks", "price double, size bigint", outer=True)
    assert kept.groupBy("id").count().count() == len(PAYLOADS)


def test_payload_rows_in_sql_take_their_schema_from_the_call(spark):
    payloads.registered(spark)
    spark.createDataFrame([(json.dumps([{"a": 1, "b": {"c": 2}}, {"a": 2**70, "b": False}]),)], "payload string").createOrReplaceTempView("sent")
    found = spark.sql("SELECT item, a, b FROM sent, LATERAL payload_rows(payload, '', 'a bigint, b string')")
    assert sorted(map(tuple, found.collect())) == [(0, 1, '{"c": 2}'), (1, None, "false")]
    with pytest.raises(Exception, match="not a name and one of"):
        spark.sql("SELECT * FROM sent, LATERAL payload_rows(payload, '', 'a decimal')")


@pytest.mark.parametrize(("value", "kind", "want"), [("1e400", "double", math.inf), ("7", "bigint", 7), ("7.5", "bigint", None), (True, "double", None), (1, "boolean", None), (False, "boolean", False), (None, "string", None)])
def test_values_are_read_as_the_wanted_kind(value, kind, want):
    assert payloads.read_as(value, kind) == want


def test_batch_counts_are_those_of_the_rows(spark, tmp_path):
    """Three batches: new rows, the same again within the watermark, and one that is late beside one that is new."""
    schema = StructType([StructField("id", StringType()), StructField("at", DoubleType())])
    for number, rows in enumerate([[("a", 10_000.0), ("b", 9_900.0)], [("a", 10_000.0), ("c", 10_001.0)], [("d", 100.0), ("e", 10_002.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(number)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")).withColumn("ts", F.timestamp_seconds("at"))
    once = metrics.counted(stream, lambda x: x.withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["id"]))
    listener = metrics.BatchCounts(spark, str(tmp_path / "counts"))
    spark.streams.addListener(listener)
    try:
        listener.finished(once.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "point")).trigger(availableNow=True).start())
    finally:
        spark.streams.removeListener(listener)
    found = metrics.read(spark, str(tmp_path / "counts")).where("admitted > 0").orderBy("batch").collect()
    assert [(r.admitted, r.stored, r.late, r.duplicates) for r in found] == [(2, 2, 0, 0), (2, 1, 0, 1), (2, 1, 1, 0)]
