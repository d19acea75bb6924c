"""Sweeps: nested vendor events into records, contracts and settled maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import clock, nested, text

K_EVENT = "struct<event_ticker: string, title: string, markets: array<struct<ticker: string, status: string, yes_sub_title: string, open_time: string, close_time: string, result: string, yes_bid_dollars: string, yes_ask_dollars: string, yes_bid_size_fp: string, yes_ask_size_fp: string, last_price_dollars: string>>>"
P_EVENT = "struct<title: string, slug: string, startDate: string, endDate: string, markets: array<struct<question: string, conditionId: string, clobTokenIds: string, outcomes: string, outcomePrices: string>>>"


def parsed(items: DataFrame, kind: str) -> DataFrame:
    """Raw items as ``e``; without markets an empty array.  A row without an item only says that pages were cut off."""
    rows = items.where("item IS NOT NULL").withColumn("e", F.from_json("item", kind))
    return rows.withColumn("e", F.col("e").withField("markets", F.coalesce("e.markets", F.from_json(F.lit("[]"), kind[kind.index("markets: ") + 9 : -1]))))


def flat_markets(events: DataFrame) -> DataFrame:
    """One row per market of each event."""
    return events.select("seq", F.col("e.title").alias("title"), F.posexplode("e.markets").alias("pos", "m"))


def first_time(*texts: Column) -> Column:
    """The first time that can be read."""
    return F.coalesce(*[clock.from_text(x) for x in texts])


def k_records(events: DataFrame, family: Column, window_start: str) -> DataFrame:
    """Settled events of two or more markets from the window's start on: teams, ts, family, contract."""
    two = events.where(F.size("e.markets") >= 2)
    first, second = F.get("e.markets", F.lit(0)), F.get("e.markets", F.lit(1))
    rows = two.select(
        "seq", F.array(first["yes_sub_title"], second["yes_sub_title"]).alias("teams"), first_time(first["close_time"], first["open_time"]).alias("ts"), family.alias("family"), first["ticker"].alias("contract_id"), "e"
    )
    named = (F.coalesce(F.get("teams", F.lit(0)), F.lit("")) != "") & (F.coalesce(F.get("teams", F.lit(1)), F.lit("")) != "")
    return rows.where(named & (F.col("ts") >= F.lit(window_start).cast("timestamp")))


def k_contracts(records: DataFrame) -> DataFrame:
    """One contract per market of the records' events."""
    return records.select(F.explode("e.markets").alias("m"), "family", F.col("e.title").alias("title")).select(
        F.col("m.ticker").alias("contract_id"), F.lit("K").alias("venue"), F.lit(None).cast("string").alias("match_id"), "family", F.col("m.yes_sub_title").alias("outcome_side"), F.concat_ws(" — ", "title", "m.yes_sub_title").alias("question_text")
    )


def k_map_results(events: DataFrame) -> DataFrame:
    """Per map: teams, ts, map_no from the ticker, the team whose market settled yes, and the tickers in the order of the teams."""
    won = F.get(F.filter("e.markets", lambda m: F.trim(m["result"]) == "yes"), F.lit(0))["yes_sub_title"]
    names = F.transform("e.markets", lambda m: m["yes_sub_title"])
    rows = events.where(F.size("e.markets") >= 2).select(
        "seq", F.col("e.event_ticker").alias("contract_id"), names.alias("teams"), first_time(F.get("e.markets", F.lit(0))["close_time"], F.get("e.markets", F.lit(0))["open_time"]).alias("ts"),
        text.map_number(F.col("e.event_ticker")).alias("map_no"), won.alias("winner"), F.transform("e.markets", lambda m: m["ticker"]).alias("tickers"),
    )
    return rows.where("map_no IS NOT NULL AND ts IS NOT NULL")


def p_markets(events: DataFrame, families: tuple[str, ...], window_start: str) -> DataFrame:
    """Closed markets whose title names a pair and whose question is of a family: teams, ts, contract, outcomes."""
    rows = events.select(
        "seq", text.title_pair(F.col("e.title")).alias("pair"), clock.slug_day(F.col("e.slug"), F.col("e.endDate"), F.col("e.startDate")).alias("ts"), F.col("e.title").alias("title"), F.posexplode("e.markets").alias("pos", "m")
    )
    rows = rows.withColumn("family", text.family(F.concat_ws(" — ", "title", "m.question")))
    fit = F.col("pair").isNotNull() & (F.col("ts") >= F.lit(window_start).cast("timestamp")) & F.col("family").isin(list(families)) & (F.coalesce("m.conditionId", F.lit("")) != "")
    return rows.where(fit).select(
        "seq", "pos", F.array("pair.a", "pair.b").alias("teams"), "ts", "family", F.col("m.conditionId").alias("contract_id"), F.concat(F.col("title"), F.lit(" — "), F.col("m.question")).alias("question_text"),
        nested.json_list(F.col("m.outcomes")).alias("outcomes"), nested.json_list(F.col("m.outcomePrices")).alias("outcome_prices"), nested.json_list_or_self(F.col("m.clobTokenIds")).alias("tokens"),
    )


def p_map_results(markets: DataFrame) -> DataFrame:
    """Per map: map_no from the question (game or map), the winner whose price settled at 1."""
    number = F.regexp_extract("question_text", r"(?i)\b(?:game|map) ([0-9]+)", 1).try_cast("int")
    rows = markets.where("family = 'map_winner'").select("seq", "pos", "contract_id", "outcomes", "teams", "ts", number.alias("map_no"), nested.settled_name(F.col("outcomes"), F.col("outcome_prices")).alias("winner"), "tokens")
    return rows.where("map_no IS NOT NULL")


def quote_of_k(m: Column) -> list[Column]:
    """Bid, ask, mid, last and the USD at the top of a market's book; missing sides stay null."""
    from tidemark.functions import book

    bid, ask, bid_size, ask_size = (m[c].try_cast("double") for c in ("yes_bid_dollars", "yes_ask_dollars", "yes_bid_size_fp", "yes_ask_size_fp"))
    return [
        bid.alias("bid"), ask.alias("ask"), book.mid(bid, ask).alias("mid"), m["last_price_dollars"].try_cast("double").alias("last"),
        book.usd(bid, bid_size).alias("bid_size_usd"), book.usd(ask, ask_size).alias("ask_size_usd"),
    ]


def live_quotes(events: DataFrame, books: DataFrame, families: tuple[str, ...], now: Column) -> DataFrame:
    """Quotes of open markets from the book of their first token; markets without a book are left out.

    ``books`` has ``token``, ``bids`` and ``asks`` (ladders).  Before a start in the future or an
    unknown one the regime is the one before the match.
    """
    from tidemark.functions import book
    from tidemark.params import IN_GAME, PRE_MATCH

    rows = events.select(
        text.title_pair(F.col("e.title")).alias("pair"), clock.slug_day(F.col("e.slug"), F.col("e.endDate"), F.col("e.startDate")).alias("start"), F.col("e.title").alias("title"), F.explode("e.markets").alias("m")
    )
    rows = rows.withColumn("question_text", F.concat_ws(" — ", "title", "m.question")).withColumn("family", text.family(F.col("question_text")))
    fit = F.col("pair").isNotNull() & F.col("family").isin(list(families)) & (F.coalesce("m.conditionId", F.lit("")) != "")
    rows = rows.where(fit).withColumn("token", F.get(nested.json_list(F.col("m.clobTokenIds")), F.lit(0))).join(books, "token")
    bid, ask = book.best_bid(F.col("bids")), book.best_ask(F.col("asks"))
    return rows.select(
        F.col("m.conditionId").alias("contract_id"), F.lit("P").alias("venue"), now.alias("ts"), F.lit("live").alias("source"), F.when(F.col("start").isNull() | (F.col("start") > now), PRE_MATCH).otherwise(IN_GAME).alias("regime"),
        bid["price"].alias("bid"), ask["price"].alias("ask"), book.mid(bid["price"], ask["price"]).alias("mid"), book.usd(bid["price"], bid["size"]).alias("bid_size_usd"), book.usd(ask["price"], ask["size"]).alias("ask_size_usd"),
        "family", "question_text", F.concat_ws(" vs ", "pair.a", "pair.b").alias("outcome_side"),
    )


# -- rows of the store -------------------------------------------------------------------------
def _two(teams: str = "teams") -> list[Column]:
    return [F.get(teams, F.lit(0)).alias("team_a"), F.get(teams, F.lit(1)).alias("team_b")]


def stored_records(records: DataFrame, venue: str) -> DataFrame:
    return records.select(F.lit(venue).alias("venue"), "contract_id", "family", *_two(), "ts")


def stored_k_maps(found: DataFrame, window_start: str) -> DataFrame:
    """Settled maps of venue K with two named teams, from the window's start on."""
    rows = found.where((F.size("teams") >= 2) & (F.coalesce(F.get("teams", F.lit(0)), F.lit("")) != "") & (F.coalesce(F.get("teams", F.lit(1)), F.lit("")) != "") & (F.col("ts") >= F.lit(window_start).cast("timestamp")))
    return rows.select(F.lit("K").alias("venue"), "contract_id", "seq", *_two(), "ts", "map_no", "winner", F.col("teams").alias("names"), F.col("tickers").alias("contracts"))


def stored_p_maps(found: DataFrame) -> DataFrame:
    return found.select(F.lit("P").alias("venue"), "contract_id", (F.col("seq").cast("long") * 1000 + F.col("pos")).alias("seq"), *_two(), "ts", "map_no", "winner", F.col("outcomes").alias("names"), F.col("tokens").alias("contracts"))


# -- discovery and books of open markets ----------------------------------------------------------
OPEN = ("venue", "contract_id", "token", "kickoff", "market")


def open_k(events: DataFrame) -> DataFrame:
    """Active markets of venue K's open events; their kickoff is not known to the venue."""
    rows = flat_markets(events).where(F.col("m.status") == "active")
    return rows.select(F.lit("K").alias("venue"), F.col("m.ticker").alias("contract_id"), F.col("m.ticker").alias("token"), F.lit(None).cast("timestamp").alias("kickoff"), F.to_json("m").alias("market"))


def open_p(events: DataFrame, sport) -> DataFrame:  # noqa: ANN001
    """Open markets of venue P whose event names a fixture of a first-tier league and that are of a family."""
    rows = events.select(text.title_pair(F.col("e.title")).alias("pair"), clock.slug_day(F.col("e.slug"), F.col("e.endDate"), F.col("e.startDate")).alias("kickoff"), F.col("e.title").alias("title"), F.explode("e.markets").alias("m"))
    about = F.concat_ws(" — ", "title", "m.question")
    fit = F.col("pair").isNotNull() & F.coalesce(sport.is_first_tier(F.col("title")), F.lit(False)) & sport.family(about).isin(list(sport.params.census.families))
    token = F.get(nested.json_list(F.col("m.clobTokenIds")), F.lit(0))
    rows = rows.where(fit & (F.coalesce("m.conditionId", F.lit("")) != "") & token.isNotNull())
    return rows.select(F.lit("P").alias("venue"), F.col("m.conditionId").alias("contract_id"), token.alias("token"), "kickoff", F.to_json("m").alias("market"))


K_MARKET = "struct<yes_bid_dollars: string, yes_ask_dollars: string, yes_bid_size_fp: string, yes_ask_size_fp: string>"
K_BOOK = "struct<orderbook_fp: struct<yes: array<array<string>>, no: array<array<string>>>>"
LEVELS = "array<struct<price: string, size: string>>"


def ladder(levels: Column) -> Column:
    """Levels of strings as a ladder; a level that cannot be read is left out, no levels give an empty ladder."""
    read = F.transform(F.coalesce(levels, F.array().cast(LEVELS)), lambda x: F.struct(x["price"].try_cast("double").alias("price"), x["size"].try_cast("double").alias("size")))
    return F.filter(read, lambda x: x["price"].isNotNull() & x["size"].isNotNull())


def snapshots(polled: DataFrame) -> DataFrame:
    """Stored snapshots from polled books: ``venue``, ``contract_id``, ``ts``, ``fetch_latency_ms``, ``kickoff``, ``market`` and ``raw`` (JSON)."""
    from tidemark.functions import book

    regime = F.when(F.col("ts") < F.col("kickoff"), "pre_match").when(F.col("kickoff").isNotNull(), "in_game")
    base = ["contract_id", "venue", "ts", F.lit("live").alias("source"), regime.alias("regime"), "fetch_latency_ms"]
    p = polled.where("venue = 'P'").withColumn("b", F.from_json("raw", f"struct<bids: {LEVELS}, asks: {LEVELS}>"))
    p = p.withColumn("bids", ladder(F.col("b.bids"))).withColumn("asks", ladder(F.col("b.asks")))
    k = polled.where("venue = 'K'").withColumn("m", F.from_json("market", K_MARKET)).withColumn("b", F.from_json("raw", K_BOOK))
    found = k.select(*base, *book.market_snapshot(F.col("m"), F.col("b.orderbook_fp.yes"), F.col("b.orderbook_fp.no"), F.struct("raw")), F.col("raw").alias("_raw"))
    found = found.unionByName(p.select(*base, *book.snapshot(F.col("bids"), F.col("asks"), F.struct("raw")), F.col("raw").alias("_raw")))
    return found.withColumn("raw_json", F.col("_raw")).drop("_raw")
