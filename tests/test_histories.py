"""Prices fetched by tasks, over a transport that is replaced."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.store import Store
from tidemark.sources import histories
from tidemark.sources.venues import VenueK, VenueP

MAPS = "match_id string, kickoff long, length_s int, team_a string, winner string, k_ticker string, p_token string"


def answering(down=()):
    """Candles at the end of the window asked for and a minute before; tokens by name.  Nested, so that tasks get it by value."""

    def candle(t, bid, ask):
        return {"end_period_ts": t, "yes_bid": {"close_dollars": bid}, "yes_ask": {"close_dollars": ask}}

    def get(path, params):
        from tidemark.sources.rest import VendorError

        name = path.split("/")[3] if path.startswith("series/") else params["market"]
        if name in down:
            raise VendorError(503, "down")
        if name == "gone":
            raise VendorError(404, "no such token")
        if path.startswith("series/"):
            assert path == f"series/{name[0]}/markets/{name}/candlesticks" and params["period_interval"] == 1
            return {"candlesticks": [candle(params["end_ts"] - 60, "0.4", "0.6"), candle(params["end_ts"], "0", "bad"), {"end_period_ts": None}]}
        return {"history": [{"t": 7, "p": 0.25}, {"t": 8, "p": None}, {"p": 0.5}]} if name == "tok" else {}

    return get


@pytest.fixture
def maps(spark):
    rows = [("m1", 100_000, 1800, "A", "A", "S-1", "tok"), ("m2", 200_000, None, "A", "B", "S-1", "gone"), ("m3", 1, 1, "A", "A", None, "tok"), ("m4", 1, 1, "A", "A", "T-2", None), ("m5", 1, 1, "A", "A", None, "empty")]
    return spark.createDataFrame(rows, MAPS)


def test_each_window_and_each_token_is_asked_for_once(maps):
    got = sorted(tuple(r) for r in histories.wanted(maps).collect() if r.venue == "K")
    assert got == [("K", "S-1", 78_400, 102_100), ("K", "S-1", 178_400, 202_700), ("K", "T-2", -21_599, 302)]
    assert sorted(r.contract_id for r in histories.wanted(maps).where("venue = 'P'").collect()) == ["empty", "gone", "tok"]


def test_prices_are_stored_and_failures_told(spark, maps, tmp_path, monkeypatch):
    from tidemark import cli, plugins

    monkeypatch.setattr(cli.study, "priced_maps", lambda store, params: maps)
    store, get = Store(spark, str(tmp_path / "store")), answering()
    for _ in range(2):  # again changes no price
        assert cli.run_prices(store, plugins.sport("lol"), VenueK(get), VenueP(get, get), 2) == 0
    rows = {(r.venue, r.contract_id, r.t): r.price for r in store.read("prices").collect()}
    assert rows == {
        ("K", "S-1", 102_040): 0.5, ("K", "S-1", 102_100): None, ("K", "S-1", 202_640): 0.5, ("K", "S-1", 202_700): None, ("K", "T-2", 242): 0.5, ("K", "T-2", 302): None, ("P", "tok", 7): 0.25,
    }
    lost = store.read("discards").where("stage = 'prices'")
    assert {(r.contract_id, r.reason) for r in lost.collect()} == {("gone", "no prices: 404: no such token")}


def test_after_a_refusal_the_venue_is_left_alone_and_the_rest_is_told(spark, maps, tmp_path, monkeypatch):
    from tidemark import cli, plugins

    monkeypatch.setattr(cli.study, "priced_maps", lambda store, params: maps)
    store, get = Store(spark, str(tmp_path / "store")), answering(("S-1", "T-2"))
    assert cli.run_prices(store, plugins.sport("lol"), VenueK(get), VenueP(get, get), 1) == 1
    assert [r.venue for r in store.read("prices").collect()] == ["P"]
    told = store.read("discards").where("stage = 'prices'").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.reason: r.n for r in told} == {histories.REFUSED: 1, histories.LEFT_OUT: 2, "no prices: 404: no such token": 1}
    assert [(r.venue, r.endpoint, r.status) for r in store.read("spend_log").collect()] == [("K", "prices", 503)]


def test_no_maps_no_requests(spark, maps):
    none = histories.fetched(histories.wanted(maps.where("false")), VenueK(answering()), VenueP(answering(), answering()), 3)
    assert histories.prices(none).count() == 0
