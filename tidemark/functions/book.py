"""Order books: ladders are arrays of struct<price, size> in any order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mid(bid: Column, ask: Column) -> Column:
    """Half way, null unless both sides are there."""
    return F.round((bid + ask) / 2, 6)


def usd(price: Column, size: Column) -> Column:
    return F.round(price * size, 2)


def best_bid(ladder: Column) -> Column:
    """The level with the highest price (of ties the first); null for an empty ladder."""
    return _first_of(ladder, lambda p: p)


def best_ask(ladder: Column) -> Column:
    return _first_of(ladder, lambda p: -p)


def _first_of(ladder: Column, rank) -> Column:  # noqa: ANN001
    ranked = F.transform(ladder, lambda level, i: F.struct(rank(level["price"]).alias("rank"), (-i).alias("at"), level["price"].alias("price"), level["size"].alias("size")))
    return F.array_max(ranked)


def notional(ladder: Column) -> Column:
    """Sum of price times size; null for an empty ladder and if a level cannot be read."""
    total = F.aggregate(ladder, F.lit(0.0), lambda acc, level: acc + level["price"] * level["size"])
    return F.when(F.size(ladder) > 0, F.round(total, 2))


def parsed_levels(levels: Column) -> Column:
    """array<array<string>> of [price, size] as a ladder; null if any part is not a number."""
    read = F.transform(levels, lambda x: F.struct(F.get(x, F.lit(0)).try_cast("double").alias("price"), F.get(x, F.lit(1)).try_cast("double").alias("size")))
    return F.when(~F.exists(read, lambda x: x["price"].isNull() | x["size"].isNull()), read)


def snapshot(bids: Column, asks: Column, raw: Column) -> list[Column]:
    """Columns of a stored snapshot from the two ladders."""
    bid, ask = best_bid(bids), best_ask(asks)
    both = bid.isNotNull() & ask.isNotNull()
    return [
        bid["price"].alias("best_bid"),
        ask["price"].alias("best_ask"),
        mid(bid["price"], ask["price"]).alias("mid"),
        F.when(both & (bid["size"] != 0), usd(bid["price"], bid["size"])).alias("top_bid_usd"),
        F.when(both & (ask["size"] != 0), usd(ask["price"], ask["size"])).alias("top_ask_usd"),
        notional(bids).alias("full_bid_usd"),
        notional(asks).alias("full_ask_usd"),
        (F.size(bids) + F.size(asks)).alias("n_levels"),
        both.cast("int").alias("book_ok"),
        F.to_json(raw).alias("raw_json"),
    ]


def market_snapshot(market: Column, yes: Column, no: Column, raw: Column) -> list[Column]:
    """Columns of a stored snapshot from a market's top-of-book fields and its raw ladders, arrays of [price, size].

    The top comes from the fields; a ladder that cannot be read leaves its sums null.
    """
    bid, ask, bid_size, ask_size = (market[c].try_cast("double") for c in ("yes_bid_dollars", "yes_ask_dollars", "yes_bid_size_fp", "yes_ask_size_fp"))
    both = bid.isNotNull() & ask.isNotNull()
    bids, asks = (parsed_levels(F.coalesce(x, F.array().cast("array<array<string>>"))) for x in (yes, no))
    levels = F.size(bids) + F.size(asks)
    readable = bids.isNotNull() & asks.isNotNull() & (levels > 0)
    return [
        bid.alias("best_bid"), ask.alias("best_ask"), mid(bid, ask).alias("mid"),
        F.when(both & (bid_size != 0), usd(bid, bid_size)).alias("top_bid_usd"), F.when(both & (ask_size != 0), usd(ask, ask_size)).alias("top_ask_usd"),
        F.when(readable, notional(bids)).alias("full_bid_usd"), F.when(readable, notional(asks)).alias("full_ask_usd"), F.when(readable, levels).alias("n_levels"), both.cast("int").alias("book_ok"),
        F.to_json(raw).alias("raw_json"),
    ]


def walked(ladder: Column, buy: bool) -> Column:
    """The levels in the order in which an order takes them (asks from the lowest price, bids from the highest), each with the size
    and money of the levels before it: array<struct<price, size, before, paid>>.

    Levels without a price or a positive size are left out.
    """
    usable = F.filter(ladder, lambda x: x["price"].isNotNull() & (x["size"] > 0))
    rank = (lambda p: p) if buy else (lambda p: -p)
    levels = F.array_sort(F.transform(usable, lambda x: F.struct(rank(x["price"]).cast("double").alias("rank"), x["price"].cast("double").alias("price"), x["size"].cast("double").alias("size"))))
    start = F.struct(F.lit(0.0).alias("before"), F.lit(0.0).alias("paid"), F.array().cast("array<struct<price:double,size:double,before:double,paid:double>>").alias("steps"))
    run = F.aggregate(
        levels,
        start,
        lambda acc, x: F.struct(
            (acc["before"] + x["size"]).alias("before"),
            (acc["paid"] + x["price"] * x["size"]).alias("paid"),
            F.concat(acc["steps"], F.array(F.struct(x["price"].alias("price"), x["size"].alias("size"), acc["before"].alias("before"), acc["paid"].alias("paid")))).alias("steps"),
        ),
    )
    return run["steps"]


def impact(steps: Column, order: Column) -> Column:
    """What an order of the given size does to a ladder ``walked`` before: struct<filled, mean_price, last_price, slippage, n_levels>.

    The level at which it ends is the first whose size makes the sum large enough, or the last one where the ladder ends before the order:
    then ``filled`` is less than the order.  ``slippage`` is the mean price's distance from the first level's.  Null for an empty ladder
    and an order that is null or not positive.
    """
    reached = F.filter(steps, lambda x: x["before"] < order)
    last = F.element_at(reached, -1)
    filled = F.least(order.cast("double"), last["before"] + last["size"])
    mean = (last["paid"] + (filled - last["before"]) * last["price"]) / filled
    found = F.struct(
        filled.alias("filled"), mean.alias("mean_price"), last["price"].alias("last_price"), F.abs(mean - F.get(steps, F.lit(0))["price"]).alias("slippage"), F.size(reached).alias("n_levels")
    )
    return F.when((order > 0) & (F.size(steps) > 0), found)
