"""The recorder: snapshots of books, polled in cycles or from a stream, restartable at any point.

Delivery is at least once; a snapshot is stored once, by its key.  The data and the cursor
are one commit, so a batch that is cut off is done again and changes nothing twice.  What has
been fetched is stored, all of it: the cap holds for what a cycle asks for, and what it
leaves out is counted in the discards.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from itertools import chain, count

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.store import Store
from tidemark.params import Recorder
from tidemark.sources import sweeps
from tidemark.sources.rest import VendorError
from tidemark.sources.venues import VenueK, VenueP


@dataclass
class Breaker:
    """Blocks a venue for a while after a refusal; other failures are gaps of one item."""

    cooldown_s: int = 3600
    until: dict[str, float] = field(default_factory=dict)
    gaps: dict[str, int] = field(default_factory=dict)

    def open_for(self, venue: str, now: float) -> bool:
        return now >= self.until.get(venue, 0.0)

    def failed(self, venue: str, error: VendorError, now: float) -> None:
        if error.refuses_all:
            self.until[venue] = now + self.cooldown_s
        else:
            self.gaps[venue] = self.gaps.get(venue, 0) + 1


@dataclass
class Catalog:
    """What ``load`` gave last, loaded anew after ``ttl_s`` seconds."""

    load: object
    ttl_s: int = 300
    held: object = None
    at: float = float("-inf")

    def get(self, now: float):  # noqa: ANN201
        if now - self.at >= self.ttl_s:
            self.held, self.at = self.load(), now
        return self.held


def capped(rows: DataFrame, venue: str, order: list[str], cap: int) -> tuple[DataFrame, DataFrame]:
    """At most ``cap`` rows of each venue, and ``n_kept``, ``n_dropped`` of every venue."""
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(venue).orderBy(*order)))
    counts = rows.groupBy(venue).agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("n_kept"), F.greatest(F.count(F.lit(1)) - cap, F.lit(0)).alias("n_dropped"))
    return numbered.where(F.col("_n") <= cap).drop("_n"), counts


POLLED = "venue string, contract_id string, ts timestamp, fetch_latency_ms int, kickoff timestamp, market string, raw string"
STREAM = "polled-books"
log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Outcome:
    """What became of one market of a cycle, or of ``n`` of them (null if nobody can tell how many)."""

    venue: str
    kind: str  # stored, gap, over_cap, skipped, or refused: that the venue wants to be left alone
    n: int | None = 1
    contract_id: str | None = None
    row: tuple | None = None  # of ``POLLED``
    error: VendorError | None = None
    endpoint: str = "book"

    def reason(self, cap: int) -> str:
        said = {"gap": "no book", "over_cap": f"{self.n} over the cap of {cap}", "skipped": f"{'all' if self.n is None else self.n} left out after a refusal"}
        return f"{self.venue}: {said[self.kind]}"


class Poller:
    """Asks the venues for the books of their open markets, cycle by cycle.

    A venue's cycle is a series of outcomes, one for each market that it lists: stored, a gap, over the cap
    or skipped, so that nothing is left uncounted.  The list of a venue's open events passes
    through the driver, as its interface gives it; of the markets found in it the driver
    holds as many as the cap admits.
    """

    def __init__(self, store: Store, sport, k: VenueK, p: VenueP, params: Recorder = Recorder(), clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):  # noqa: ANN001, B008
        self.store, self.sport, self.params, self.clock, self.sleep = store, sport, params, clock, sleep
        self.venues = {"K": k, "P": p}
        self.breaker = Breaker(params.cooldown_s)
        self.catalogs = {v: Catalog(lambda v=v: self.listed(v), params.catalog_ttl_s) for v in self.venues}

    def listed(self, venue: str) -> tuple[list[Row], int]:
        """The open markets that a cycle may ask for, in the order of the venue's events, and how many more there are."""
        own = self.venues[venue]
        events = chain.from_iterable(own.events(s, "open") for s in self.sport.series) if venue == "K" else own.events(self.sport.tag, closed=False)
        items = self.store.spark.createDataFrame([(i, json.dumps(e)) for i, e in enumerate(events)], "seq long, item string")
        found = sweeps.open_k(sweeps.parsed(items, sweeps.K_EVENT)) if venue == "K" else sweeps.open_p(sweeps.parsed(items, sweeps.P_EVENT), self.sport)
        within = found.select(*sweeps.OPEN).limit(self.params.cap_per_venue).collect()
        return within, found.count() - len(within)

    def asked(self, venue: str, market: Row) -> Outcome:
        """The book of one market."""
        started = time.perf_counter()
        try:
            raw = self.venues[venue].book(market["token"])
        except VendorError as error:
            return Outcome(venue, "refused" if error.refuses_all else "gap", 1, market["contract_id"], error=error)
        latency_ms = int(1000 * (time.perf_counter() - started))
        row = (venue, market["contract_id"], datetime.fromtimestamp(self.clock(), timezone.utc), latency_ms, market["kickoff"], market["market"], json.dumps(raw, separators=(",", ":")))
        return Outcome(venue, "stored", 1, market["contract_id"], row)

    def outcomes(self, venue: str) -> Iterator[Outcome]:
        """What becomes of the venue's markets in one cycle; a refusal ends it, and all that was not asked for is skipped."""
        held = self.catalogs[venue].held
        if not self.breaker.open_for(venue, self.clock()):
            yield Outcome(venue, "skipped", held and len(held[0]) + held[1])
            return
        try:
            markets, over = self.catalogs[venue].get(self.clock())
        except VendorError as error:
            yield Outcome(venue, "refused", error=error, endpoint="events")
            yield Outcome(venue, "skipped", held and len(held[0]) + held[1])
            return
        if over:
            yield Outcome(venue, "over_cap", over)
        for at, market in enumerate(markets):
            found = self.asked(venue, market)
            yield found
            if found.kind == "refused":
                yield Outcome(venue, "skipped", len(markets) - at)
                return

    def poll(self) -> dict[str, dict[str, int]]:
        """One cycle, stored; per venue the number of ``stored``, ``over_cap`` and ``skipped`` markets and of ``gaps``."""
        found, spark = [], self.store.spark
        for outcome in chain.from_iterable(map(self.outcomes, self.venues)):
            found.append(outcome)
            if outcome.error:
                self.breaker.failed(outcome.venue, outcome.error, self.clock())
            if outcome.kind == "refused":
                log.error("%s refuses: %s", outcome.venue, outcome.error)
                self.store.log_spend(outcome.venue, outcome.endpoint, outcome.error.status, note=str(outcome.error))
        at = datetime.fromtimestamp(self.clock(), timezone.utc)
        rows = spark.createDataFrame([o.row for o in found if o.kind == "stored"], POLLED)
        self.store.append_absent("book_snapshots", sweeps.snapshots(rows), (STREAM, at.isoformat()))
        if lost := [("recorder", o.contract_id, o.reason(self.params.cap_per_venue)) for o in found if o.kind in ("gap", "over_cap", "skipped")]:
            self.store.append("discards", spark.createDataFrame(lost, "stage string, contract_id string, reason string").withColumn("ts", F.lit(at)))
        total = lambda venue, kind: sum(o.n or 0 for o in found if (o.venue, o.kind) == (venue, kind))
        return {v: {"stored": total(v, "stored"), "over_cap": total(v, "over_cap"), "skipped": total(v, "skipped"), "gaps": total(v, "gap")} for v in self.venues}

    def attempted(self, number: int) -> bool:
        """Cycle ``number``, after the wait between cycles; whether it ended well.  What went wrong is in the log."""
        if number:
            self.sleep(self.params.poll_seconds)
        try:
            counts = self.poll()
        except Exception:  # noqa: BLE001
            log.exception("cycle %s", number)
            return False
        log.info("cycle %s: %s", number, counts)
        return True

    def run(self, max_cycles: int | None = None) -> int:
        """So many cycles, or cycles without end; returns how many of them failed."""
        return sum(not self.attempted(n) for n in (count() if max_cycles is None else range(max_cycles)))


def record(snapshots: DataFrame, store: Store, stream: str, checkpoint: str, params: Recorder = Recorder(), once: bool = True) -> StreamingQuery:  # noqa: B008
    """Store a stream of snapshots: a batch's new keys and the cursor are one commit.

    A batch is stored whole.  How much a batch admits is the source's matter (``pages_per_batch``);
    what it does not admit waits for the next one.
    """

    def batch(rows: DataFrame, number: int) -> None:
        store.append_absent("book_snapshots", rows, (stream, str(number)))

    writer = snapshots.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{params.poll_seconds} seconds")
    return writer.start()


def deduplicated(snapshots: DataFrame, event_time: str, delay: str, key: list[str]) -> DataFrame:
    """Each key once within the watermark."""
    return snapshots.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(key)


def minute_bars(quotes: DataFrame, event_time: str, key: list[str], value: str, delay: str = "5 minutes") -> DataFrame:
    """An extension: first, last, low and high of every minute; rows later than the watermark are left out."""
    window = F.window(event_time, "1 minute")
    bars = quotes.withWatermark(event_time, delay).groupBy(window, *key)
    return bars.agg(F.min_by(value, event_time).alias("open"), F.max_by(value, event_time).alias("close"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n"))
