"""REST pages as a Python data source, with a transport that can be replaced.

``spark.read.format("rest").option("transport", "replay").option("path", folder)`` replays pages
that were stored as ``NNN.json`` files; ``http`` fetches them.  One row per item with the raw
JSON, so that parsing is done by Spark's own functions.
"""

from __future__ import annotations

import itertools
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, SimpleDataSourceStreamReader

Fetch = Callable[[dict], dict]
SCHEMA = "page int, seq int, item string, status string, start_date string, series_ticker string, fetched_ms bigint, latency_ms int, capped boolean"


class VendorError(RuntimeError):
    """A fetch that failed: never an empty relation.  ``refuses_all`` if it speaks of the vendor and not of the item: no answer, too many requests, an error of the server."""

    def __init__(self, status: int, message: str):
        super().__init__(f"{status}: {message}")
        self.status, self.refuses_all = status, status in (0, 429) or status // 100 == 5


def http_fetch(url: str, timeout_s: int = 30) -> Fetch:
    def fetch(params: dict) -> dict:
        query = urllib.parse.urlencode({k: v for k, v in params.items() if v is not None})
        try:
            with urllib.request.urlopen(f"{url}?{query}", timeout=timeout_s) as answer:  # noqa: S310
                return json.load(answer)
        except urllib.error.HTTPError as e:
            raise VendorError(e.code, str(e.reason)) from e
        except (urllib.error.URLError, TimeoutError) as e:
            raise VendorError(0, str(e)) from e

    return fetch


def replay_fetch(folder: str) -> Fetch:
    """Pages from stored files in the order of their names; a file {"error": status} fails so."""
    pages = sorted(Path(folder).glob("*.json"))

    def fetch(params: dict) -> dict:
        at = int(params.get("cursor") or 0) if params.get("offset") is None else int(params["offset"]) // int(params.get("limit") or 100)
        if at >= len(pages):
            return {"items": []}
        page = json.loads(pages[at].read_text())
        if isinstance(page, list):
            page = {"items": page}
        if "error" in page:
            raise VendorError(int(page["error"]), pages[at].name)
        if at + 1 < len(pages) and "cursor" not in page:
            page = page | {"cursor": str(at + 1)}
        return page

    return fetch


def settles_before(event: dict, day: str) -> bool:
    """Whether an event of two markets or more closed (else opened) before ``day``, by its first market; false if that can't be read."""
    markets = event.get("markets") or []
    times = [str(markets[0].get(k) or "") for k in ("close_time", "open_time")] if len(markets) > 1 else []
    known = [t for t in times if t[:4].isdigit()]
    return bool(known) and known[0] < day


def cursor_pages(fetch: Fetch, params: dict, items: str = "items", stop_before: str | None = None) -> Iterator[list[dict]]:
    """Pages until no cursor is left, or up to the first, which is given whole, with an event from before ``stop_before``."""
    cursor = None
    while True:
        page = fetch(params | {"cursor": cursor})
        found = page.get(items) or []
        yield found
        cursor = page.get("cursor")
        if not cursor or stop_before and any(settles_before(event, stop_before) for event in found):
            return


def offset_pages(fetch: Fetch, params: dict, limit: int = 100, stop_before: str | None = None, capped: Callable[[], None] = lambda: None, items: str = "items") -> Iterator[list[dict]]:
    """Pages newest first until one is short, empty or reaches back before ``stop_before``; a 422 ends them and is reported by ``capped``."""
    for number in itertools.count():
        try:
            page = fetch(params | {"offset": number * limit, "limit": limit}).get(items) or []
        except VendorError as e:
            if e.status != 422:
                raise
            return capped()
        yield page
        dates = sorted(str(x["startDate"]) for x in page if x.get("startDate"))
        all_dated = len(dates) == len(page)
        if len(page) < limit or stop_before and all_dated and dates[0] < stop_before:
            return None


def row_of(page: int, seq: int, item: dict, series: str | None, fetched: float, began: float) -> tuple:
    raw = json.dumps(item, separators=(",", ":"))
    return page, seq, raw, item.get("status"), item.get("startDate"), item.get("series_ticker") or series, int(fetched * 1000), int((fetched - began) * 1000), False


SPAN = 10_000_000  # numbers of one partition's items


class Scan(InputPartition):
    """One series or tag: a task follows its cursor to its end."""

    def __init__(self, number: int, series: str | None):
        super().__init__(number)
        self.series = series


class RestReader(DataSourceReader):
    """With the option ``series`` (names, comma-separated) each is a partition of its own: a folder of that name below ``path``, or the parameter ``each`` of a request. ``seq`` grows in the order of the list."""

    def __init__(self, options: dict):
        self.options, self.params = options, {}

    def pushFilters(self, filters: list[Filter]):  # noqa: ANN201, N802
        """Equality on ``status`` or ``series_ticker`` and a bound on ``start_date`` go to the server; all stay as filters too."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("status",), ("series_ticker",)):
                self.params[f.attribute[0]] = f.value
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("start_date",):
                self.params["stop_before"] = f.value
            yield f

    def partitions(self) -> list[InputPartition]:
        listed = [x.strip() for x in self.options.get("series", "").split(",") if x.strip()]
        if len(listed) * SPAN > 2**31:
            raise ValueError("at most 214 series in one scan")
        wanted, key = self.params.get("series_ticker"), self.options.get("each", "series_ticker")
        scans = [Scan(i, x) for i, x in enumerate(listed) if key != "series_ticker" or wanted in (None, x)]
        return scans if listed else [Scan(0, None)]  # each page names the next one

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o = self.options
        params = {k[6:]: v for k, v in o.items() if k.startswith("param.")} | {k: v for k, v in self.params.items() if k != "stop_before"}
        path = o.get("path")
        if partition.series is not None:
            path, params = f"{path}/{partition.series}", params | {o.get("each", "series_ticker"): partition.series}
        fetch = replay_fetch(path) if o.get("transport", "replay") == "replay" else http_fetch(o["url"], int(o.get("timeout_s", 30)))
        if "limit" in o:
            params["limit"] = int(o["limit"])
        ended: list[bool] = []
        if o.get("paging", "cursor") == "cursor":
            pages = cursor_pages(fetch, params, o.get("items", "items"), o.get("stop_before"))
        else:
            pages = offset_pages(fetch, params, int(o.get("limit", 100)), self.params.get("stop_before") or o.get("stop_before"), lambda: ended.append(True), o.get("items", "items"))
        seq, began, number = partition.value * SPAN, time.time(), -1
        for number, page in enumerate(pages):
            now = time.time()
            for item in page:
                yield row_of(number, seq, item, params.get("series_ticker"), now, began)
                seq += 1
            began = time.time()
        if ended:  # a row of its own without an item says that the pages were cut off
            yield number + 1, seq, None, None, None, None, int(time.time() * 1000), 0, True


class ReplayStream(SimpleDataSourceStreamReader):
    """Stored pages; the offset is the number of pages read.  A micro-batch admits what is there, at most ``pages_per_batch``: the rest waits for the next."""

    def __init__(self, options: dict):
        self.folder, self.most = options["path"], int(options.get("pages_per_batch", 1000))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": 0}

    def _page(self, at: int) -> list[tuple]:
        pages = sorted(Path(self.folder).glob("*.json"))
        if at >= len(pages):
            return []
        began = time.time()
        page = json.loads(pages[at].read_text())
        items, now = page if isinstance(page, list) else page.get("items") or [], time.time()
        return [row_of(at, i, x, None, now, began) for i, x in enumerate(items)]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {"page": min(len(list(Path(self.folder).glob("*.json"))), start["page"] + self.most)}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([row for at in range(start["page"], end["page"]) for row in self._page(at)])


class RestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rest"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RestReader:  # noqa: ANN001
        return RestReader(dict(self.options))

    def simpleStreamReader(self, schema) -> ReplayStream:  # noqa: ANN001, N802
        return ReplayStream(dict(self.options))
