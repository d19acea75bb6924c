"""Command line: ingest files and pages into a store, fetch the prices of its maps, run the gates on it, record books.

    python -m tidemark.cli ingest --results 'FILES*.csv' --k-pages DIR --p-pages DIR --k-candles FILE --p-history FILE --store DIR
    python -m tidemark.cli prices --k-url URL --p-books-url URL --store DIR
    python -m tidemark.cli gate G2 --store DIR
    python -m tidemark.cli record --pages DIR --store DIR --once
    python -m tidemark.cli record --k-url URL --p-events-url URL --p-books-url URL --store DIR --cycles 3
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import plugins, schema
from tidemark.operators.store import Store
from tidemark.plans import report, series, study
from tidemark.session import reachable, session
from tidemark.sources.venues import VenueK, VenueP, http_get
from tidemark.tables import materialise, scratch


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark")
    sub = top.add_subparsers(dest="command", required=True)
    gate = sub.add_parser("gate")
    gate.add_argument("gate", choices=["G0", "G1", "G2", "G3", "G4"])
    ingest = sub.add_parser("ingest")
    ingest.add_argument("--results", help="glob of neutral results files")
    ingest.add_argument("--k-pages", help="folder of stored event pages of venue K")
    ingest.add_argument("--p-pages", help="folder of stored event pages of venue P, paged by offset")
    ingest.add_argument("--k-candles", help="JSON lines: ticker and a candle")
    ingest.add_argument("--p-history", help="JSON lines: token, t and p")
    ingest.add_argument("--p-live", help="folder of stored pages of open events of venue P")
    ingest.add_argument("--p-books", help="JSON lines: token, bids and asks of their books")
    rec = sub.add_parser("record")
    rec.add_argument("--pages", help="folder of stored snapshots to replay as a stream")
    rec.add_argument("--once", action="store_true", help="what is there and no more, or one cycle")
    rec.add_argument("--cycles", type=int, help="so many cycles; without it and --once no end")
    for name in ("k-url", "p-events-url", "p-books-url"):
        rec.add_argument(f"--{name}", help="base of the venue's interface, for polling")
    fetch = sub.add_parser("prices")
    fetch.add_argument("--k-url", required=True, help="base of venue K's interface, for candles")
    fetch.add_argument("--p-books-url", required=True, help="base of venue P's interface of books and histories")
    fetch.add_argument("--tasks", type=int, default=4, help="so many ask at a time")
    for command in (gate, ingest, fetch, rec):
        command.add_argument("--sport", default="lol", choices=sorted(plugins.SPORTS))
        command.add_argument("--store", required=True)
    return top


def run_gate(store: Store, gate: str, sport: plugins.Sport) -> int:
    run_id = time.strftime("%Y%m%dT%H%M%SZ", time.gmtime())
    found = study.g4(store, sport.params) if gate == "G4" else study.GATES[gate](store, sport.params)
    if found is None:
        missing = [g for g in study.GATES if store.latest_artifact(g) is None]
        print(f"no artifact of {', '.join(missing)}: run these gates first")
        return 2
    payload = store.write_artifact(gate, {"gate": gate, "sport": sport.key} | found, run_id)
    print(report.render(payload))
    print(f"artifact: {payload['artifact_path']}")
    return 0


def run_ingest(store: Store, sport: plugins.Sport, results: str | None = None, k_pages: str | None = None, p_pages: str | None = None, k_candles: str | None = None, p_history: str | None = None, p_live: str | None = None, p_books: str | None = None) -> int:
    """Files and pages into the store; what a sweep leaves out is counted in the discards."""
    from tidemark.sources import files, sweeps
    from tidemark.sources.rest import RestSource

    spark, census = store.spark, sport.params.census
    spark.dataSource.register(RestSource)

    def events(folder: str, kind: str, **options: str) -> tuple[DataFrame, DataFrame]:
        items = materialise(spark.read.format("rest").options(path=folder, **options).load(), "ingest-items")
        return items, sweeps.parsed(items, kind)

    def swept(venue: str, items: DataFrame, records: DataFrame) -> None:
        capped = items.agg(F.coalesce(F.bool_or("capped"), F.lit(False)).alias("capped"))
        row = records.agg(F.count(F.lit(1)).alias("n_records"), F.min("ts").alias("oldest_ts")).crossJoin(capped)  # single rows
        store.upsert("sweeps", row.withColumn("venue", F.lit(venue)).withColumn("ts", F.current_timestamp()))

    if results:
        store.upsert("matches", sport.matches(spark, results))
        store.upsert("maps", files.stored_maps(sport.map_results(spark, results)))
    if k_pages:
        items, parsed = events(k_pages, sweeps.K_EVENT)
        records = sweeps.k_records(parsed, sport.family(F.col("e.title")), census.window_start)
        store.upsert("contracts", sweeps.k_contracts(records))
        store.upsert("records", sweeps.stored_records(records, "K"))
        store.upsert("map_results", sweeps.stored_k_maps(sweeps.k_map_results(parsed), census.window_start))
        swept("K", items, records)
    if p_pages:
        items, parsed = events(p_pages, sweeps.P_EVENT, paging="offset", stop_before=census.window_start)
        markets = sweeps.p_markets(parsed, census.families, census.window_start)
        store.upsert("contracts", markets.withColumn("venue", F.lit("P")).withColumn("outcome_side", F.concat_ws(" vs ", "teams")))
        store.upsert("records", sweeps.stored_records(markets, "P"))
        store.upsert("map_results", sweeps.stored_p_maps(sweeps.p_map_results(markets)))
        swept("P", items, markets)
        lost = sweeps.flat_markets(parsed).select(F.col("m.conditionId").alias("contract_id")).where("contract_id IS NOT NULL").join(markets, "contract_id", "left_anti")
        store.record_discards(lost, "sweep", F.lit("no family, pair or date in the window"))
    if k_candles:
        rows = spark.read.schema(f"ticker string, candle {series.CANDLE}").json(k_candles).where("ticker IS NOT NULL AND candle.end_period_ts IS NOT NULL")
        store.upsert("prices", rows.select(F.lit("K").alias("venue"), F.col("ticker").alias("contract_id"), F.col("candle.end_period_ts").alias("t"), series.candle_mid(F.col("candle")).alias("price")))
    if p_history:
        rows = spark.read.schema("token string, t long, p double").json(p_history).where("token IS NOT NULL AND t IS NOT NULL")
        store.upsert("prices", rows.select(F.lit("P").alias("venue"), F.col("token").alias("contract_id"), "t", F.col("p").alias("price")))
    if p_live and p_books:
        _, parsed = events(p_live, sweeps.P_EVENT, paging="offset")
        books = spark.read.schema(f"token string, bids {sweeps.LEVELS}, asks {sweeps.LEVELS}").json(p_books)
        books = books.select("token", sweeps.ladder(F.col("bids")).alias("bids"), sweeps.ladder(F.col("asks")).alias("asks"))
        quotes = materialise(sweeps.live_quotes(parsed, books, census.families, F.current_timestamp()), "ingest-quotes")
        store.upsert("contracts", quotes)
        store.upsert("quotes", quotes)
    return 0


def run_prices(store: Store, sport: plugins.Sport, k: VenueK, p: VenueP, tasks: int = 4) -> int:
    """Candles and histories of the maps that both venues have, into the store; 1 if a venue refused.  What was not found is in the discards."""
    from tidemark.sources import histories

    with scratch():
        found = materialise(histories.fetched(histories.wanted(study.priced_maps(store, sport.params)), k, p, tasks), "histories")
        store.upsert("prices", histories.prices(found))
        store.record_discards(found.where("reason IS NOT NULL"), "prices", F.col("reason"))
        refusals = found.where(F.col("reason") == histories.REFUSED).groupBy("venue").agg(F.first("status").alias("status"), F.count(F.lit(1)).alias("n")).collect()  # a row for each venue
        for r in refusals:
            store.log_spend(r["venue"], "prices", r["status"], note=f"{r['n']} refusals")
    return 1 if refusals else 0


def run_recorder(store: Store, pages: str, once: bool) -> int:
    """Replay stored snapshots as a stream."""
    from tidemark.functions import book
    from tidemark.sources import sweeps
    from tidemark.sources.rest import RestSource
    from tidemark.streaming.recorder import record

    store.spark.dataSource.register(RestSource)
    raw = f"struct<contract_id: string, venue: string, ts: string, regime: string, bids: {sweeps.LEVELS}, asks: {sweeps.LEVELS}>"
    items = store.spark.readStream.format("rest").option("path", pages).load().withColumn("b", F.from_json("item", raw))
    rows = items.withColumn("bids", sweeps.ladder(F.col("b.bids"))).withColumn("asks", sweeps.ladder(F.col("b.asks")))
    columns = book.snapshot(F.col("bids"), F.col("asks"), F.struct("bids", "asks"))
    rows = rows.select("b.contract_id", "b.venue", F.try_to_timestamp("b.ts").alias("ts"), F.lit("live").alias("source"), "b.regime", F.col("latency_ms").alias("fetch_latency_ms"), *columns)
    rows = rows.where("contract_id IS NOT NULL AND venue IS NOT NULL AND ts IS NOT NULL")  # no key, no snapshot
    query = record(schema.conform(rows, "book_snapshots"), store, "books", f"{store.root}/_checkpoint", once=once)
    query.awaitTermination()
    return 0


def run_poller(store: Store, sport: plugins.Sport, k_url: str, p_events_url: str, p_books_url: str, cycles: int | None) -> int:
    from tidemark.streaming.recorder import Poller

    poller = Poller(store, sport, VenueK(http_get(k_url)), VenueP(http_get(p_events_url), http_get(p_books_url)), sport.params.recorder)
    return 1 if poller.run(cycles) else 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    store, sport = Store(session(), args.store, strict=args.command == "ingest"), plugins.sport(args.sport)
    reachable(store.spark)
    if args.command == "gate":
        return run_gate(store, args.gate, sport)
    if args.command == "ingest":
        return run_ingest(store, sport, args.results, args.k_pages, args.p_pages, args.k_candles, args.p_history, args.p_live, args.p_books)
    if args.command == "prices":
        return run_prices(store, sport, VenueK(http_get(args.k_url)), VenueP(http_get(args.p_books_url), http_get(args.p_books_url)), args.tasks)
    if args.pages:
        return run_recorder(store, args.pages, args.once)
    return run_poller(store, sport, args.k_url, args.p_events_url, args.p_books_url, 1 if args.once else args.cycles)


if __name__ == "__main__":
    raise SystemExit(main())
