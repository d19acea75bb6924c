"""Scalar functions, books, store, sources, gates and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.functions import book, clock, nested, text
from tidemark.operators.store import Store, discarded, first_wins, last_wins
from tidemark.sources import files, sweeps
from tidemark.sources.rest import RestSource, VendorError, cursor_pages, offset_pages
from tidemark.streaming.live import live_divergences
from tidemark.streaming.recorder import Breaker, Catalog, capped, minute_bars, record


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize(
    ("title", "family"),
    [
        ("Penta kill in game 1?", None), ("T1 to win the series", "series_winner"), ("Winner of Map 2", "map_winner"), ("Game 1 Winner", "map_winner"), ("A vs B (BO5) - Match Result", "series_winner"),
        ("Game 1: Both Teams Slay Baron", None), ("Games Total O/U 2.5", None), ("MVP of the series", None), ("nothing", None),
    ],
)
def test_families(spark, title, family):
    assert one(spark, f=text.family(F.lit(title))).f == family


@pytest.mark.parametrize(("title", "tier"), [("LCK Summer", True), ("LCK Challengers", False), ("Prime League 1st Division", False), ("lck", False), ("mid-season invitational", True), ("XLCK", False)])
def test_first_tier(spark, title, tier):
    assert one(spark, t=text.is_first_tier(F.lit(title))).t is tier


def test_titles_slugs_and_numbers(spark):
    r = one(
        spark, a=text.title_pair(F.lit("LCK: Gen-G vs. T1 (BO5) - Final")), b=text.title_pair(F.lit("no pair")), s=clock.slug_day(F.lit("lol-2025-02-03-x")), bad=clock.slug_day(F.lit("lol-2025-13-03"), F.lit("2025-01-01T00:00:00Z")),
        m=text.map_number(F.lit("KX-3")), n=text.map_number(F.lit("KX-a")),
    )
    assert (r.a.a, r.a.b, r.b, r.m, r.n) == ("Gen-G", "T1", None, 3, None)
    assert (r.s, r.bad) == (dt.datetime(2025, 2, 3), dt.datetime(2025, 1, 1))


def test_fixed_width_text(spark):
    r = one(spark, a=clock.to_text(F.lit("2025-01-01 09:00:00.005999").cast("timestamp")), b=clock.to_text(F.lit("2025-01-01 10:00:00").cast("timestamp")), c=clock.from_text(F.lit("bad")))
    assert (r.a, r.b, r.c) == ("2025-01-01T09:00:00.005Z", "2025-01-01T10:00:00.000Z", None)
    assert r.a < r.b and len(r.a) == len(r.b)


def ladder(*levels):
    return F.array(*[F.struct(F.lit(float(p)).alias("price"), F.lit(float(s)).alias("size")) for p, s in levels]) if levels else F.array().cast("array<struct<price: double, size: double>>")


def test_books(spark):
    full = spark.range(1).select(*book.snapshot(ladder((0.40, 100), (0.55, 200)), ladder((0.70, 50), (0.60, 80)), F.struct(F.lit(1).alias("x")))).first()
    assert (full.best_bid, full.best_ask, full.mid, full.top_bid_usd, full.top_ask_usd, full.full_bid_usd, full.full_ask_usd, full.n_levels, full.book_ok) == (0.55, 0.60, 0.575, 110.0, 48.0, 150.0, 83.0, 4, 1)
    half = spark.range(1).select(*book.snapshot(ladder((0.4, 100)), ladder(), F.struct(F.lit(1).alias("x")))).first()
    assert (half.best_ask, half.mid, half.top_bid_usd, half.full_bid_usd, half.full_ask_usd, half.book_ok) == (None, None, None, 40.0, None, 0)
    r = one(spark, ok=book.parsed_levels(F.array(F.array(F.lit("0.5"), F.lit("2")))), bad=book.parsed_levels(F.array(F.array(F.lit("x"), F.lit("2")))), tie=book.best_bid(ladder((0.5, 1), (0.5, 2)))["size"])
    assert (r.ok[0].price, r.bad, r.tie) == (0.5, None, 1.0)


def test_settled_names_and_json_lists(spark):
    names = F.array(F.lit("a"), F.lit("b"))
    r = one(
        spark, w=nested.settled_name(names, F.array(F.lit("0"), F.lit("1"))), bad=nested.settled_name(names, F.array(F.lit("x"), F.lit("0.5"))), short=nested.settled_name(names, F.array(F.lit("1"))),
        l=nested.json_list(F.lit('["x","y"]')), n=nested.json_list(F.lit("x")), s=nested.json_list_or_self(F.lit("x")), i=nested.first_index(names, lambda x: x == "b"),
    )
    assert (r.w, r.bad, r.short, r.l, r.n, r.s, r.i) == ("b", None, None, ["x", "y"], [], ["x"], 1)


def test_naive_times_are_refused(spark):
    rows = spark.sql("SELECT 'c' AS contract_id, 'K' AS venue, TIMESTAMP_NTZ '2025-01-01 00:00:00' AS ts, 'hist' AS source")
    with pytest.raises(ValueError, match="time zone"):
        schema.conform(rows, "quotes")
    good = schema.conform(rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("extra", F.lit(1)), "quotes")
    assert good.columns == [f.name for f in schema.TABLES["quotes"].fields] and schema.faults(good, "quotes").count() == 0


def quote(spark, ts, mid, venue="K", source="live"):
    return spark.sql(f"SELECT 'k' AS contract_id, '{venue}' AS venue, TIMESTAMP '{ts}' AS ts, '{source}' AS source, {mid}D AS mid")


def test_upserts_are_idempotent_and_keep_the_venue(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for mid, venue in ((0.5, "K"), (0.5, "K"), (0.7, "P")):
        store.upsert("quotes", quote(spark, "2025-01-01 00:00:00", mid, venue))
    rows = store.read("quotes").collect()
    assert [(r.mid, r.venue) for r in rows] == [(0.7, "K")]
    contract = spark.sql("SELECT 'c' AS contract_id, 'K' AS venue, true AS parity_ok")
    store.upsert("contracts", contract)
    store.upsert("contracts", contract.withColumn("parity_ok", F.lit(None).cast("boolean")))
    assert store.read("contracts").first().parity_ok is True


def test_snapshots_first_write_wins(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for mid, cursor in ((0.5, "c1"), (0.9, "c2")):
        store.append_absent("book_snapshots", quote(spark, "2025-01-01 00:00:00", mid))
        store.set_cursor("books", cursor)
    assert [r.mid for r in store.read("book_snapshots").collect()] == [0.5]
    assert store.cursor("books") == "c2" and store.cursor("none") is None


def test_merges_of_one_batch(spark):
    old = spark.createDataFrame([(1, "a", 1.0)], "k int, venue string, v double")
    new = spark.createDataFrame([(1, "b", 2.0, 1), (1, "c", None, 2), (2, "d", 4.0, 1)], "k int, venue string, v double, seq int")
    assert sorted(map(tuple, last_wins(old, new, ["k"], ["venue"], ["seq"]).collect())) == [(1, "a", None), (2, "d", 4.0)]
    assert [tuple(r) for r in first_wins(old, new, ["k"], ["seq"]).collect()] == [(2, "d", 4.0)]
    kept, lost = discarded(new, "s", F.col("v") > 3, F.lit("low"))
    assert kept.count() == 1 and tuple(lost.first()) == ("s", "low", 2)


def test_artifacts(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.latest_artifact("G0") is None
    for run_id, x in (("20250101T000000Z", 1), ("20250102T000000Z", 2)):
        store.write_artifact("G0", {"x": x}, run_id)
    assert store.latest_artifact("G0")["x"] == 2


def test_results_files(spark, tmp_path):
    head = "gameid,league,date,game,position,side,teamname,result,gamelength\n"
    rows = ["g1,WLDs,2025-03-01 10:00:00,1,team,Blue,T1,1,1800.7", "g1,WLDs,2025-03-01 10:00:00,1,team,Red,Gen.G,0,1800.7", "g1,WLDs,2025-03-01 10:00:00,1,top,Blue,T1,1,", "g2,LCK,bad date,1,team,Blue,A,1,", "g2,LCK,bad date,1,team,Red,B,0,", "g3,LCK,2025-03-01 10:00:00,x,team,Blue,A,1,", "g3,LCK,2025-03-01 10:00:00,x,team,Red,B,1,"]
    (tmp_path / "a.csv").write_text(head + "\n".join(rows))
    found = files.matches(files.results(spark, f"{tmp_path}/*.csv"))
    got = files.map_results(files.spine(found, ("Worlds", "LCK"), "2025-01-01T00:00:00Z")).collect()
    assert [(r.match_id, r.league, r.team_a, r.result_winner, r.map_no, r.length_s) for r in got] == [("g1", "Worlds", "T1", "T1", 1, 1800)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.results(spark, f"{tmp_path}/none.csv").count()


def pages(folder, *contents):
    for i, c in enumerate(contents):
        (folder / f"{i:03}.json").write_text(json.dumps(c))


def test_rest_source_replays_pages(spark, tmp_path):
    spark.dataSource.register(RestSource)
    pages(tmp_path, {"items": [{"a": 1, "status": "open"}, {"a": 2, "status": "closed"}]}, {"items": [{"a": 3, "status": "open"}]})
    rows = spark.read.format("rest").option("path", str(tmp_path)).load()
    assert [r.seq for r in rows.where("status = 'open'").orderBy("seq").collect()] == [0, 2]
    (tmp_path / "001.json").write_text(json.dumps({"error": 503}))
    with pytest.raises(Exception, match="503"):
        rows.count()


def test_rest_source_scans_series_in_tasks_of_their_own(spark, tmp_path):
    def event(close):
        return {"markets": [{"close_time": close, "open_time": "2020-01-01T00:00:00Z"}, {}]}

    spark.dataSource.register(RestSource)
    for name in ("ONE", "TWO"):
        (tmp_path / name).mkdir()
    pages(tmp_path / "ONE", {"items": [event("2025-03-01T00:00:00Z")]}, {"items": [event("2024-12-31T23:00:00Z"), event("2025-02-01T00:00:00Z")]}, {"items": [event("2024-11-01T00:00:00Z")]})
    pages(tmp_path / "TWO", {"items": [event("2025-03-01T00:00:00Z")]}, {"items": [event(None)]}, {"items": [{"markets": []}, {}]})
    rows = spark.read.format("rest").options(path=str(tmp_path), series="ONE, TWO", stop_before="2025-01-01").load()
    assert rows.rdd.getNumPartitions() == 2
    found = rows.orderBy("seq").collect()
    # the page that reaches back is given whole, later ones aren't read; an event with no closing time is dated by its opening
    assert [r.series_ticker for r in found] == ["ONE"] * 3 + ["TWO"] * 2 and len({r.seq for r in found}) == 5
    assert {r.series_ticker for r in rows.where("series_ticker = 'TWO'").collect()} == {"TWO"}
    whole = spark.read.format("rest").options(path=str(tmp_path), series="ONE,TWO").load()
    assert whole.count() == 8


def test_paging_rules():
    def fetch(params):
        at = params["offset"] // 2
        if at == 2:
            raise VendorError(422, "too far")
        return {"items": [{"startDate": f"2025-01-0{9 - at}"}] * 2}

    ended = []
    assert len(list(offset_pages(fetch, {}, 2, capped=lambda: ended.append(1)))) == 2 and ended == [1]
    assert len(list(offset_pages(fetch, {}, 2, stop_before="2025-01-09T"))) == 1
    cursors = {None: {"items": [1], "cursor": "x"}, "x": {"items": None}}
    assert list(cursor_pages(lambda p: cursors[p["cursor"]], {})) == [[1], []]
    assert [VendorError(s, "").refuses_all for s in (0, 404, 429, 500)] == [True, False, True, True]


def test_sweeps_of_venue_p(spark):
    event = {"title": "LCK: A vs B (BO3)", "slug": "lol-a-b-2025-03-01", "markets": [{"question": "Game 1 Winner", "conditionId": "c1", "outcomes": '["A", "B"]', "outcomePrices": '["0", "1"]', "clobTokenIds": '["t1", "t2"]'}, {"question": "first blood", "conditionId": "c2"}]}
    rows = spark.createDataFrame([(0, json.dumps(event)), (1, '{"title": "x"}')], "seq int, item string")
    markets = sweeps.p_markets(sweeps.parsed(rows, sweeps.P_EVENT), ("map_winner", "series_winner"), "2025-01-01T00:00:00Z")
    got = sweeps.p_map_results(markets).collect()
    assert [(r.teams, r.map_no, r.winner, r.tokens) for r in got] == [(["A", "B"], 1, "B", ["t1", "t2"])]


def test_breaker_and_catalog():
    b = Breaker(cooldown_s=100)
    b.failed("K", VendorError(404, "gone"), 0)
    assert b.open_for("K", 1) and b.gaps == {"K": 1}
    b.failed("K", VendorError(429, "slow"), 0)
    assert not b.open_for("K", 99) and b.open_for("K", 100) and b.open_for("P", 1)
    loads = []
    c = Catalog(lambda: loads.append(1) or len(loads), ttl_s=300)
    assert [c.get(t) for t in (0, 299, 300)] == [1, 1, 2]


def test_cap_counts_what_it_drops(spark):
    rows = spark.range(10).selectExpr("IF(id < 7, 'K', 'P') AS venue", "id")
    kept, counts = capped(rows, "venue", ["id"], 5)
    assert {r.venue: (r.n_kept, r.n_dropped) for r in counts.collect()} == {"K": (5, 2), "P": (3, 0)} and kept.count() == 8


def test_recorder_stores_each_snapshot_once(spark, tmp_path):
    spark.dataSource.register(RestSource)
    folder = tmp_path / "pages"
    folder.mkdir()
    snap = {"contract_id": "c", "venue": "P", "ts": "2025-01-01T00:00:00Z"}
    pages(folder, {"items": [snap, snap]}, {"items": [snap, snap | {"contract_id": "d"}]})
    from tidemark.cli import run_recorder

    store = Store(spark, str(tmp_path / "store"))
    assert run_recorder(store, str(folder), once=True) == 0
    assert sorted(r.contract_id for r in store.read("book_snapshots").collect()) == ["c", "d"]
    run_recorder(store, str(folder), once=True)  # a restart stores nothing twice
    assert store.read("book_snapshots").count() == 2


def test_live_divergences_equal_the_batch_rule(spark, tmp_path):
    from tidemark.operators import asof, divergence

    ticks = [("m", t, side, price) for t, side, price in [(0, "k", 0.5), (0, "p", 0.5), (100, "k", 0.7), (150, "p", 0.5), (200, "k", 0.7), (250, "k", 0.71), (300, "k", 0.4), (700, "k", 0.9), (710, "k", 0.9), (720, "p", 0.5)]]
    path = str(tmp_path / "ticks")
    spark.createDataFrame(ticks, "key string, t long, side string, price double").coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    out = []
    stream = live_divergences(spark.readStream.schema(rows.schema).parquet(path), 0.1, 3, 300)
    stream.writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    grid = asof.grid(rows.where("side = 'p'"), rows.where("side = 'k'"), ["key"], "t", "price", "p", "k")
    want = divergence.divergences(grid, ["key"], "t", "p", "k", 0.1, 3, 300).collect()
    assert sorted((r.t_start, r.gap) for r in out) == sorted((r.t_start, r.gap) for r in want) != []


def test_minute_bars(spark, tmp_path):
    path = str(tmp_path / "q")
    spark.sql("SELECT 'c' AS c, TIMESTAMP '2025-01-01 00:00:05' + make_interval(0,0,0,0,0,0,x) AS ts, x * 1.0D AS v FROM VALUES (0), (20), (60) AS t(x)").coalesce(1).write.parquet(path)
    out = []
    bars = minute_bars(spark.readStream.schema("c string, ts timestamp, v double").parquet(path), "ts", ["c"], "v")
    bars.writeStream.outputMode("complete").foreachBatch(lambda df, n: out.append(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.open, r.close, r.n) for r in out[0]) == [(0.0, 20.0, 2), (60.0, 60.0, 1)]
    assert record is not None


def test_a_page_of_1000_is_stored_whole(spark, tmp_path):
    from tidemark.cli import run_recorder

    folder = tmp_path / "pages"
    folder.mkdir()
    pages(folder, {"items": [{"contract_id": f"c{i}", "venue": "P", "ts": "2025-01-01T00:00:00Z", "regime": "pre_match"} for i in range(1000)]}, {"items": [{"venue": "P"}]})
    store = Store(spark, str(tmp_path / "store"))
    assert run_recorder(store, str(folder), once=True) == 0
    rows = store.read("book_snapshots")
    assert rows.count() == 1000 and {r.regime for r in rows.select("regime").distinct().collect()} == {"pre_match"}
    assert store.cursor("books") is not None


def test_a_write_that_is_cut_off_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.upsert("quotes", quote(spark, "2025-01-01 00:00:00", 0.5))

    class Crash(Exception):
        pass

    def crash(*_):
        raise Crash

    for step in ("_write", "_commit"):  # before anything is written, and with all folders in place
        with monkeypatch.context() as m:
            m.setattr(Store, step, crash)
            with pytest.raises(Crash):
                store.upsert("quotes", quote(spark, "2025-01-01 00:00:00", 0.9))
        assert [r.mid for r in Store(spark, str(tmp_path)).read("quotes").collect()] == [0.5]
    store.upsert("quotes", quote(spark, "2025-01-01 00:00:00", 0.7))
    assert [r.mid for r in store.read("quotes").collect()] == [0.7]


def test_only_the_days_of_a_write_are_replaced(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for day in ("2025-01-01", "2025-01-02"):
        store.upsert("quotes", quote(spark, f"{day} 00:00:00", 0.5))
    before = store._state()[1]["quotes"]
    store.upsert("quotes", quote(spark, "2025-01-02 00:00:00", 0.6))
    after = store._state()[1]["quotes"]
    assert after["2025-01-01"] == before["2025-01-01"] and after["2025-01-02"] != before["2025-01-02"]
    assert sorted(r.mid for r in store.read("quotes").collect()) == [0.5, 0.6] and [r.mid for r in store.read("quotes", ["2025-01-02"]).collect()] == [0.6]
    kept = store.read("quotes").count()
    store.vacuum(keep=1)
    assert len(store.versions()) == 1 and store.read("quotes").count() == kept
    folders = {f for fs in after.values() for f in fs}
    assert {str(p.relative_to(tmp_path)) for p in (tmp_path / "quotes").glob("*/_day=*")} == folders


def test_many_small_batches_of_a_day_become_one_folder(spark, tmp_path, monkeypatch):
    from tidemark.operators import store as module

    monkeypatch.setattr(module, "MOST_FOLDERS", 2)
    store = Store(spark, str(tmp_path))
    for i in range(4):
        store.append_absent("book_snapshots", quote(spark, f"2025-01-01 00:00:0{i}", 0.5), ("s", str(i)))
    assert len(store._state()[1]["book_snapshots"]["2025-01-01"]) <= 2 and store.read("book_snapshots").count() == 4 and store.cursor("s") == "3"


def test_rules_of_the_tables_hold_at_a_write(spark, tmp_path):
    from tidemark.operators.store import Conflict

    store = Store(spark, str(tmp_path), strict=True)
    with pytest.raises(ValueError, match="1 whose contract_id is not in contracts"):
        store.upsert("quotes", quote(spark, "2025-01-01 00:00:00", 0.5))
    with pytest.raises(ValueError, match="1 without venue"):
        store.upsert("contracts", spark.sql("SELECT 'k' AS contract_id"))
    store.upsert("contracts", spark.sql("SELECT 'k' AS contract_id, 'K' AS venue"))
    store.upsert("quotes", quote(spark, "2025-01-01 00:00:00", 0.5))
    base = store._state()[1]
    store.upsert("quotes", quote(spark, "2025-01-01 00:00:01", 0.5))
    with pytest.raises(Conflict):
        store._commit(base, {"quotes": {}})
    store._commit(base, {"sweeps": {}})  # another table: both writes hold
    assert store.read("quotes").count() == 2


class FakeK:
    def __init__(self, fails=None):
        self.fails = fails

    def events(self, series, status=None):
        market = {"yes_bid_dollars": "0.6", "yes_ask_dollars": "0.64", "yes_bid_size_fp": "100", "yes_ask_size_fp": "100"}
        return iter([{"markets": [{"ticker": f"{series}-{i}", "status": s} | market for i, s in enumerate(("active", "active", "closed"))]}])

    def book(self, token):
        if self.fails:
            raise VendorError(self.fails, "no")
        return {"orderbook_fp": {"yes": [["0.5", "10"]], "no": []}}


class FakeP(FakeK):
    def events(self, tag, closed=None, stop_before=None):
        one = {"question": "Game 1 Winner", "conditionId": "0xabc", "clobTokenIds": '["tok1", "tok2"]'}
        return iter([{"title": "LoL: Gen.G vs T1 (BO3) - LCK Round 3", "slug": "lol-geng-t1-2026-07-23", "markets": [one, one | {"conditionId": "prop", "question": "first blood"}]}, {"title": "LoL: A vs B - LCK Challengers", "slug": "", "markets": [one | {"conditionId": "low"}]}])

    def book(self, token):
        super().book(token)
        return {"bids": [{"price": "0.5", "size": "100"}], "asks": [{"price": "0.6", "size": "100"}]}


def poller(spark, root, k, p, **params):
    from tidemark import plugins
    from tidemark.params import Recorder
    from tidemark.streaming.recorder import Poller

    now = dt.datetime(2026, 7, 24, tzinfo=dt.timezone.utc).timestamp()
    return Poller(Store(spark, str(root)), plugins.sport("lol"), k, p, Recorder(**params), clock=lambda: now, sleep=lambda s: None)


def test_a_cycle_stores_both_venues(spark, tmp_path):
    own = poller(spark, tmp_path, FakeK(), FakeP())
    assert own.poll() == {"K": {"stored": 4, "over_cap": 0, "skipped": 0, "gaps": 0}, "P": {"stored": 1, "over_cap": 0, "skipped": 0, "gaps": 0}}
    rows = {r.contract_id: r for r in own.store.read("book_snapshots").collect()}
    assert {c: (r.venue, r.regime, r.mid, r.source) for c, r in rows.items() if c in ("0xabc", "KXLOL-0")} == {"0xabc": ("P", "in_game", 0.55, "live"), "KXLOL-0": ("K", None, 0.62, "live")}
    assert json.loads(rows["0xabc"].raw_json)["bids"][0]["price"] == "0.5" and rows["0xabc"].fetch_latency_ms >= 0 and rows["KXLOL-0"].full_bid_usd == 5.0
    assert own.store.cursor("polled-books").startswith("2026-07-24")


def test_a_refusal_blocks_its_venue_and_a_missing_book_does_not(spark, tmp_path):
    own = poller(spark, tmp_path / "a", FakeK(), FakeP(429))
    assert own.poll()["P"]["stored"] == 0 and own.store.read("book_snapshots").where("venue = 'K'").count() == 4
    assert not own.breaker.open_for("P", own.clock()) and own.breaker.open_for("K", own.clock())
    assert [r.status for r in own.store.read("spend_log").collect()] == [429]
    assert own.poll()["P"]["skipped"] == 1  # while the venue is left alone
    assert [r.reason for r in own.store.read("discards").collect()] == ["P: 1 left out after a refusal"] * 2
    gap = poller(spark, tmp_path / "b", FakeK(), FakeP(404))
    assert gap.poll()["P"] == {"stored": 0, "over_cap": 0, "skipped": 0, "gaps": 1} and gap.breaker.open_for("P", gap.clock())
    assert [(r.contract_id, r.reason) for r in gap.store.read("discards").collect()] == [("0xabc", "P: no book")]


def test_the_cap_limits_what_is_asked_for_and_is_counted(spark, tmp_path):
    own = poller(spark, tmp_path, FakeK(), FakeP(), cap_per_venue=3)
    assert own.poll()["K"] == {"stored": 3, "over_cap": 1, "skipped": 0, "gaps": 0}
    assert [r.reason for r in own.store.read("discards").collect()] == ["K: 1 over the cap of 3"]


def test_a_failing_cycle_does_not_end_the_recorder(spark, tmp_path, monkeypatch):
    own, calls = poller(spark, tmp_path, FakeK(), FakeP()), []

    def poll():
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("bad cycle")
        return {}

    monkeypatch.setattr(own, "poll", poll)
    assert own.run(max_cycles=3) == 1 and len(calls) == 3


def test_venues_ask_as_their_interfaces_want():
    from tidemark.sources.venues import VenueK, VenueP

    asked = []

    def get(path, params):
        asked.append((path, params))
        if path == "events" and "series_ticker" in params:
            return {"events": [{"event_ticker": "e"}], "cursor": None if params["cursor"] else "next"}
        if path == "events":
            if params["offset"] >= 200:
                raise VendorError(422, "too far")
            return [{"startDate": "2025-05-01"}] * 100
        return {"history": [{"t": 1, "p": 0.5}], "candlesticks": [{"end_period_ts": 1}]}

    k, p = VenueK(get), VenueP(get, get)
    assert [e["series_ticker"] for e in k.events("S", "open")] == ["S", "S"] and asked[0][1]["limit"] == 200 and asked[0][1]["status"] == "open"
    assert len(list(p.events("tag", closed=True))) == 200 and p.capped
    assert len(list(p.events("tag", stop_before="2025-06-01"))) == 100 and not p.capped
    assert k.candles("S", "T", 0, 9) and p.history("tok") and asked[-1] == ("prices-history", {"market": "tok", "interval": "max", "fidelity": 1})


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def test_gates_over_the_store(spark, tmp_path, capsys):
    """Two maps of one series, ingested from files; every gate against values worked out by hand."""
    from tidemark import cli, plugins

    sport, store = plugins.sport("lol"), Store(spark, str(tmp_path / "store"))
    assert cli.run_gate(store, "G4", sport) == 2
    head = "gameid,league,date,game,position,side,teamname,result,gamelength\n"
    games = [("g1", "10:00:00", 1, 1, 0), ("g2", "11:00:00", 2, 0, 1)]
    (tmp_path / "r.csv").write_text(head + "".join(f"{g},LCK,2025-03-01 {t},{n},team,Blue,T1,{a},1800\n{g},LCK,2025-03-01 {t},{n},team,Red,Gen.G,{b},1800\n" for g, t, n, a, b in games))
    for name in ("k", "p", "live"):
        (tmp_path / name).mkdir()

    def k_event(n, won):
        market = {"close_time": "2025-03-01T12:00:00Z", "status": "settled"}
        return {"event_ticker": f"E-{n}", "title": f"Map {n} winner", "markets": [market | {"ticker": f"E-{n}-G", "yes_sub_title": "Gen.G Esports", "result": "yes" if won == "Gen.G" else "no"}, market | {"ticker": f"E-{n}-T", "yes_sub_title": "T1", "result": "yes" if won == "T1" else "no"}]}

    def p_market(n, prices):
        return {"question": f"Game {n} Winner", "conditionId": f"c{n}", "outcomes": '["T1", "Gen.G"]', "outcomePrices": prices, "clobTokenIds": f'["t{n}", "g{n}"]'}

    event = {"title": "LoL: T1 vs Gen.G (BO3) - LCK", "slug": "lol-2025-03-01", "startDate": "2025-02-27"}
    pages(tmp_path / "k", {"items": [k_event(1, "T1"), k_event(2, "Gen.G")]})
    pages(tmp_path / "p", {"items": [event | {"markets": [p_market(1, '["1", "0"]'), p_market(2, '["1", "0"]')]}]})  # the second is settled wrongly
    pages(tmp_path / "live", {"items": [event | {"slug": "lol-2035-03-01", "markets": [p_market(1, "[]")]}]})
    start = int(dt.datetime(2025, 3, 1, 10, tzinfo=dt.timezone.utc).timestamp())
    k_candles = [{"ticker": f"E-{n}-T", "candle": candle(start + (n - 1) * 3600 + t, bid, bid)} for n in (1, 2) for t, bid in ((-60, "0.60"), (590, "0.70"))]
    p_history = [{"token": f"t{n}", "t": start + (n - 1) * 3600 + t, "p": x} for n in (1, 2) for t, x in ((-30, 0.5), (600, 0.8))]
    books = [{"token": "t1", "bids": [{"price": "0.5", "size": "1000"}], "asks": [{"price": "0.6", "size": "500"}]}]
    for _ in range(2):  # again changes nothing
        cli.run_ingest(store, sport, str(tmp_path / "r.csv"), str(tmp_path / "k"), str(tmp_path / "p"), lines(tmp_path / "c.json", k_candles), lines(tmp_path / "h.json", p_history), str(tmp_path / "live"), lines(tmp_path / "b.json", books))
    assert {t: store.read(t).count() for t in ("matches", "maps", "records", "map_results", "prices", "sweeps")} == {"matches": 2, "maps": 2, "records": 4, "map_results": 4, "prices": 8, "sweeps": 2}
    for gate in ("G0", "G1", "G2", "G3", "G4"):
        assert cli.run_gate(store, gate, sport) == 0
    found = {g: store.latest_artifact(g) for g in ("G0", "G1", "G2", "G3", "G4")}
    rows = {r["family"]: r for r in found["G0"]["rows"]}
    assert (rows["map_winner"]["n_series"], rows["map_winner"]["n_covered"], rows["map_winner"]["n_family"], rows["map_winner"]["both_venues"], rows["series_winner"]["both_venues"]) == (1, 1, 1, True, False)
    assert found["G0"]["covered"] == ["g1"] and found["G0"]["depth"][0]["median_usd"] == 300.0 and rows["map_winner"]["depth_pass"] is True
    g1 = found["G1"]["rows"][0]
    assert (g1["n_aligned"], g1["n_agree"], g1["n_void"], g1["first_rate"], g1["second_rate"], g1["passed"]) == (2, 1, 0, 1.0, 0.5, None)
    assert [(d["kind"], d["map_no"]) for d in found["G1"]["disagreements"]] == [("winner_mismatch", 2)] and store.read("discards").where("stage = 'parity'").count() == 1
    venues = {(r["venue"], r["regime"]): r for r in found["G2"]["venues"]}
    assert found["G2"]["inputs"] == {"maps": 2, "points": 8}
    assert venues["K", "pre_match"]["brier"] == pytest.approx((0.4**2 + 0.6**2) / 2) and venues["P", "in_game"]["brier"] == pytest.approx((0.2**2 + 0.8**2) / 2)
    assert (venues["K", "in_game"]["brier_lo"], venues["K", "in_game"]["brier_hi"]) == (pytest.approx(0.09), pytest.approx(0.49))
    assert [r["passed"] for r in found["G2"]["rows"]] == [None, None]
    assert [(r["regime"], r["n"], r["passed"]) for r in found["G3"]["rows"]] == [("in_game", 0, None), ("pre_match", 0, None)]
    assert {r["verdict"] for r in found["G4"]["rows"]} == {"KILL"} and found["G4"]["frozen_rules"]["bounded_date"] == sport.params.bounded_date
    out = capsys.readouterr().out
    assert "VERDICT: KILL" in out and "G2: calibration" in out and "winner_mismatch" in out
    with pytest.raises(KeyError):
        plugins.sport("chess")


def test_pages_that_the_venue_cuts_off_are_told(spark, tmp_path):
    from tidemark import cli, plugins

    (tmp_path / "p").mkdir()
    event = {"title": "LoL: A vs B (BO3) - LCK", "slug": "lol-2025-04-01", "startDate": "2025-03-20", "markets": [{"question": "Game 1 Winner", "conditionId": "c1"}]}
    pages(tmp_path / "p", {"items": [event] * 100}, {"error": 422})
    store = Store(spark, str(tmp_path / "store"))
    cli.run_ingest(store, plugins.sport("lol"), p_pages=str(tmp_path / "p"))
    cli.run_gate(store, "G0", plugins.sport("lol"))
    sweep = store.latest_artifact("G0")["sweeps"]
    assert [(r["venue"], r["capped"], r["truncated"], r["n_records"]) for r in sweep] == [("P", True, True, 100)]


def test_tables_as_text():
    from tidemark.plans import report

    assert report.table([{"a": 1.0, "bb": None}, {"a": True, "bb": [1, "x"]}]) == ["a       bb", "1.0000  -", "yes     1, x"]
    assert report.table([]) == ["(no rows)"]


def candle(t, bid, ask):
    return {"end_period_ts": t, "yes_bid": {"close_dollars": bid}, "yes_ask": {"close_dollars": ask}}


def test_candles_points_and_series(spark):
    from tidemark.plans import series

    rows = [("x", json.dumps(candle(*c))) for c in ((100, ".40", ".44"), (160, ".50", ".54"), (220, "bad", ".94"), (280, "0", "0"))]
    candles = spark.createDataFrame(rows, "k_ticker string, raw string").withColumn("candle", F.from_json("raw", series.CANDLE))
    at = spark.createDataFrame([("x", t) for t in (50, 100, 200, 230, 300)], "k_ticker string, at long")
    assert {r["at"]: r.price for r in series.candle_mid_at(at, candles, ["k_ticker"], "at").collect()} == {50: None, 100: 0.42, 200: 0.52, 230: None, 300: None}
    assert sorted((r.t, r.price) for r in series.candle_series(candles, ["k_ticker"]).collect()) == [(100, 0.42), (160, 0.52)]
    maps = spark.createDataFrame([("m1", 150, 700, "A", "A", "x", "tok"), ("m2", 150, 30, "A", "B", None, "tok")], "match_id string, kickoff long, length_s int, team_a string, winner string, k_ticker string, p_token string")
    history = spark.createDataFrame([("tok", 90, 0.3), ("tok", 155, 0.6)], "p_token string, t long, price double")
    got = sorted((r.match_id, r.venue, r.regime, r.p, r.y) for r in series.build_points(maps, candles, history).collect())
    assert got == [("m1", "K", "pre_match", 0.42, 1.0), ("m1", "P", "in_game", 0.6, 1.0), ("m1", "P", "pre_match", 0.3, 1.0), ("m2", "P", "pre_match", 0.3, 0.0)]
    sliced = series.map_series(maps, history, "p_token")
    assert sorted((r.match_id, r.t, r.regime) for r in sliced.collect()) == [("m1", 90, "pre_match"), ("m1", 155, "in_game"), ("m2", 90, "pre_match"), ("m2", 155, "in_game")]
    r = one(spark, i=series.side_key(F.array(F.lit("T1"), F.lit("Gen.G Esports")), F.lit("Gen.G")))
    assert r.i == 1


def test_market_snapshots_with_raw_ladders(spark):
    kind = "struct<yes_bid_dollars: string, yes_ask_dollars: string, yes_bid_size_fp: string, yes_ask_size_fp: string>"
    market = F.from_json(F.lit('{"yes_bid_dollars": ".60", "yes_ask_dollars": ".64", "yes_bid_size_fp": "1000", "yes_ask_size_fp": "500"}'), kind)
    levels = lambda x: F.from_json(F.lit(x), "array<array<string>>")
    r = spark.range(1).select(*book.market_snapshot(market, levels('[["0.5", "10"]]'), levels("[]"), market)).first()
    assert (r.mid, r.top_bid_usd, r.top_ask_usd, r.full_bid_usd, r.full_ask_usd, r.n_levels, r.book_ok) == (0.62, 600.0, 320.0, 5.0, None, 1, 1)
    bad = spark.range(1).select(*book.market_snapshot(market, levels('[["x", "10"]]'), levels("[]"), market)).first()
    assert (bad.full_bid_usd, bad.n_levels) == (None, None)


def test_live_depth_sweep(spark):
    event = {"title": "LCK: A vs B (BO3)", "slug": "lol-a-b-2025-03-01", "markets": [{"question": "Game 1 Winner", "conditionId": "c1", "clobTokenIds": '["t1"]'}, {"question": "Game 2 Winner", "conditionId": "c2", "clobTokenIds": '["t2"]'}]}
    rows = sweeps.parsed(spark.createDataFrame([(0, json.dumps(event))], "seq int, item string"), sweeps.P_EVENT)
    books = spark.range(1).select(F.lit("t1").alias("token"), ladder((0.40, 100), (0.55, 200)).alias("bids"), ladder().alias("asks"))
    got = sweeps.live_quotes(rows, books, ("map_winner",), F.lit("2025-02-01").cast("timestamp")).collect()
    assert [(r.contract_id, r.regime, r.bid, r.mid, r.bid_size_usd, r.ask_size_usd) for r in got] == [("c1", "pre_match", 0.55, None, 110.0, None)]


def test_ingest_from_the_command_line(spark, tmp_path):
    from tidemark import cli, plugins

    for name in ("k", "p"):
        (tmp_path / name).mkdir()
    market = {"yes_sub_title": "T1", "close_time": "2025-03-01T10:00:00Z"}
    pages(tmp_path / "k", {"items": [{"event_ticker": "E-1", "title": "T1 vs Gen.G: Map 1 winner", "markets": [market | {"ticker": "a"}, market | {"ticker": "b", "yes_sub_title": "Gen.G"}]}]})
    pages(tmp_path / "p", {"items": [{"title": "LCK: A vs B (BO3)", "slug": "lol-2025-03-01", "markets": [{"question": "Game 1 Winner", "conditionId": "c1"}, {"question": "first blood", "conditionId": "c2"}]}]})
    (tmp_path / "r.csv").write_text("gameid,league,date,game,position,side,teamname,result,gamelength\ng1,LCK,2025-03-01 10:00:00,1,team,Blue,T1,1,1800\ng1,LCK,2025-03-01 10:00:00,1,team,Red,Gen.G,0,1800\n")
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        assert cli.run_ingest(store, plugins.sport("lol"), str(tmp_path / "r.csv"), str(tmp_path / "k"), str(tmp_path / "p")) == 0
    assert sorted(r.contract_id for r in store.read("contracts").collect()) == ["a", "b", "c1"]
    assert [(r.match_id, r.result_ts) for r in store.read("matches").collect()] == [("g1", dt.datetime(2025, 3, 1, 10, 30))]
    assert {r.contract_id for r in store.read("discards").collect()} == {"c2"}
    store.log_spend("K", "/events", 200)
    assert store.read("spend_log").first().status == 200


def test_scratch_tables_go_and_kept_ones_stay(spark):
    from tidemark.tables import materialise, scratch

    with scratch() as keep:
        gone = materialise(spark.range(3), "t")
        kept = keep(materialise(gone.selectExpr("id + 1 AS id"), "t"))
    assert sorted(r.id for r in kept.collect()) == [1, 2, 3]
    with pytest.raises(Exception, match="(?i)not.*exist|PATH_NOT_FOUND"):
        spark.read.parquet(gone._tm_path).count()
