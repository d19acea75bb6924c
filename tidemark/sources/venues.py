"""The venues' interfaces, over a transport that can be replaced: ``get(path, params)`` returns decoded JSON."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from tidemark.sources.rest import cursor_pages, http_fetch, offset_pages

Get = Callable[[str, dict], object]


def http_get(base: str, timeout_s: int = 30) -> Get:
    def get(path: str, params: dict) -> object:
        return http_fetch(f"{base.rstrip('/')}/{path}", timeout_s)(params)

    return get


class VenueK:
    """Events with nested markets by series, books and candles by ticker; one base."""

    name = "K"

    def __init__(self, get: Get):
        self.get = get

    def events(self, series: str, status: str | None = None) -> Iterator[dict]:
        params = {"series_ticker": series, "with_nested_markets": "true", "status": status, "limit": 200}
        for page in cursor_pages(lambda p: self.get("events", p), params, "events"):
            yield from ({**event, "series_ticker": event.get("series_ticker") or series} for event in page)

    def book(self, ticker: str) -> dict:
        return self.get(f"markets/{ticker}/orderbook", {})

    def candles(self, series: str, ticker: str, start: int, end: int, minutes: int = 1) -> list[dict]:
        found = self.get(f"series/{series}/markets/{ticker}/candlesticks", {"start_ts": start, "end_ts": end, "period_interval": minutes})
        return found.get("candlesticks") or []


class VenueP:
    """Events by tag from one base, books and price histories by token from another."""

    name = "P"

    def __init__(self, get_events: Get, get_books: Get):
        self.get_events, self.get_books, self.capped = get_events, get_books, False

    def events(self, tag: str, closed: bool | None = None, stop_before: str | None = None) -> Iterator[dict]:
        """Events newest first; ``capped`` says afterwards whether the venue refused pages further back."""
        self.capped = False

        def refused() -> None:
            self.capped = True

        def fetch(params: dict) -> dict:
            page = self.get_events("events", params)
            return {"items": page} if isinstance(page, list) else page

        params = {"tag_slug": tag, "closed": None if closed is None else str(closed).lower(), "order": "startDate", "ascending": "false"}
        for page in offset_pages(fetch, params, 100, stop_before, refused):
            yield from page

    def book(self, token: str) -> dict:
        return self.get_books("book", {"token_id": token})

    def history(self, token: str, minutes: int = 1) -> list[dict]:
        return self.get_books("prices-history", {"market": token, "interval": "max", "fidelity": minutes}).get("history") or []
