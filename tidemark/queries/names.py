"""Text, time, JSON and payload queries: part names as team names, events as settled fixtures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import clock, nested, text
from tidemark.operators import matching
from tidemark.params import Census, Parity
from tidemark.plans import gates
from tidemark.queries import market
from tidemark.queries.market import TICKS, ticks
from tidemark.sources import sweeps
from tidemark.streaming import live, recorder
from tidemark.tables import folder

ENDINGS = ("", " Esports", " Academy", "'s Gaming", " Club")
TITLES = (
    "Game 1 Winner", "Total Kills O/U 2.5", "to win the series", "Map 2 winner", "MVP of the match", "LCK Challengers match winner", "(BO5) - Match Result", "LCK Summer", "Mid-Season invitational best of 3", "pentakill",
    "lck spring", "Prime League 1st Division", "Game 3: first blood", "Worlds wins game 4",
)


def _listed(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with one of five endings."""
    endings = F.array(*[F.lit(e) for e in ENDINGS])
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.select("p_partkey", "p_brand", F.concat("p_name", F.element_at(endings, (F.col("p_partkey") % len(ENDINGS) + 1).cast("int"))).alias("name"))


TEAMS = f"teams AS (SELECT p_partkey, p_brand, p_name || {_listed(ENDINGS)}[p_partkey % {len(ENDINGS)} + 1] AS name FROM part)"


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array(*[F.lit(t) for t in TITLES])
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    title = F.concat("p_brand", F.lit(" "), F.element_at(found, (F.col("p_partkey") % len(TITLES) + 1).cast("int")), F.lit(" "), "p_name")
    return rows.select("p_partkey", "p_brand", "p_name", "p_size", title.alias("title"))


TITLED = f"titled AS (SELECT p_partkey, p_brand, p_name, p_size, p_brand || ' ' || {_listed(TITLES)}[p_partkey % {len(TITLES)} + 1] || ' ' || p_name AS title FROM part)"


def normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return teams(spark, sf_dir).select(
        "p_partkey", text.normal_name(name).alias("normal"), text.acronym(name).alias("acronym"), text.compact(name).alias("compact"), text.has_second_squad(name).alias("second"),
        F.array_join(text.pair_key(text.normal_name(name), text.normal_name(F.col("p_brand"))), "|").alias("pair"),
    )


def classify_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.col("title")
    return titles(spark, sf_dir).select("p_partkey", text.is_prop(title).alias("prop"), text.family(title).alias("family"), text.is_first_tier(title).alias("first_tier"))


def league_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*[F.lit(x) for x in ("WLDs", " LTA N ", "LCK", "LTA S", "other")])
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("code", F.element_at(codes, (F.col("p_partkey") % 5 + 1).cast("int")))
    return rows.groupBy(text.league(F.col("code")).alias("league")).agg(F.count(F.lit(1)).alias("n"))


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names of one brand, each pair once: a brand's names are at most 64 times the endings."""
    names = teams(spark, sf_dir).select("p_brand", "name").distinct()
    other = names.select(F.col("p_brand").alias("brand_b"), F.col("name").alias("b"))
    return names.join(other, (F.col("p_brand") == F.col("brand_b")) & (F.col("name") < F.col("b"))).select("p_brand", F.col("name").alias("a"), "b")


def fuzzy_rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = name_pairs(spark, sf_dir)
    ruled = matching.ruled_pairs(pairs.select(F.col("a").alias("l"), F.col("b").alias("r")).distinct()).select(F.col("l").alias("a"), F.col("r").alias("b"), "same")
    return pairs.join(ruled, ["a", "b"]).select("p_brand", "a", "b", "same")


def fuzzy_ratio_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.name_matches(name_pairs(spark, sf_dir), "a", "b").where("same")


def fixture_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered pairs: (a, b) against (b of one, a of the other) by rules."""
    rows = name_pairs(spark, sf_dir).withColumn("c", F.concat("b", F.lit(" Team"))).withColumn("d", F.upper("a"))
    found = matching.same_pair(rows, ("a", "b"), ("c", "d"), "same", lambda met: matching.ruled_pairs(met).where("same").select("l", "r"))
    return found.select("p_brand", "a", "b", "same")


def first_side_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side of a market that means a team: of a part's words, its brand and its name, one of them in capitals as the team."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("names", F.concat(F.array("p_brand"), F.split("p_name", " "), F.array("p_name")))
    team = F.concat(F.upper(F.get("names", (F.col("p_size") % 4).cast("int"))), F.lit(" Esports"))
    found = matching.first_ruled_name(rows.withColumn("team", team), "names", "team", "at")
    tokens = F.array("p_type", F.col("p_size").cast("string"), F.lit("third"))
    return found.select(F.col("p_partkey"), F.col("at").cast("bigint").alias("side"), F.get(tokens, F.col("at")).alias("token"))


def parse_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    between = F.when(F.col("p_size") % 3 == 0, " vs. ").when(F.col("p_size") % 3 == 1, " vs ").otherwise(" and ")
    title = F.concat(F.lit("LCK: "), "p_name", between, F.lit("Semi-Pro "), "p_brand", F.when(F.col("p_size") % 2 == 0, " (BO5) - Final").otherwise(" - Final"))
    pair = text.title_pair(title)
    slug = F.concat(F.lit("lol-"), "p_name", F.lit("-2024-"), F.lpad((F.col("p_size") % 15).cast("string"), 2, "0"), F.lit("-17-map-"), F.col("p_size").cast("string"))
    return rows.select(
        "p_partkey", pair["a"].alias("a"), pair["b"].alias("b"), clock.to_text(clock.slug_day(slug, F.lit(None).cast("string"), F.lit("2024-02-03T04:05:06Z"))).alias("slug_day"),
        text.after_last_dash(slug).alias("suffix"), text.map_number(slug).alias("map_no"), text.map_number(F.col("p_name")).alias("no_map"),
    )


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("p", F.from_json("props", "k int"))
    listed = F.concat(F.lit("["), F.col("p.k").cast("string"), F.lit(", 7]"))
    return rows.groupBy("event_type").agg(
        F.sum("p.k").alias("sum_k"), F.max(F.size(nested.json_list(listed))).cast("bigint").alias("listed"), F.max(F.size(nested.json_list(F.col("event_type")))).cast("bigint").alias("bad"),
        F.max(nested.json_list_or_self(F.col("event_type"))[0]).alias("itself"), F.min(F.sha2("props", 256)).alias("least_sha"),
    )


def winner_from_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir)
    first = F.when(F.col("k") % 3 == 0, "1").when(F.col("k") % 3 == 1, "0.0").otherwise("bad")
    prices = F.when(F.col("k") % 7 == 0, F.array(first)).otherwise(F.array(first, F.when(F.col("k") % 2 == 0, "1.0").otherwise("0.5")))
    return rows.select("event_id", nested.settled_name(F.array(F.lit("a"), F.lit("b")), prices).alias("winner"))


def explode_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as raw events with a market for each turn, flattened by the sweep."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    markets = F.transform(turns, lambda x: F.struct(x["role"].alias("question"), x["turn"].cast("string").alias("conditionId")))
    events = rows.groupBy("conv_id").agg(F.to_json(F.struct(F.lit("x: a vs b").alias("title"), markets.alias("markets"))).alias("item"))
    flat = sweeps.flat_markets(sweeps.parsed(events.withColumnRenamed("conv_id", "seq"), sweeps.P_EVENT))
    return flat.select(F.col("seq").alias("conv_id"), "pos", F.col("m.question").alias("role"))


def ts_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir)
    fixed = clock.to_text(F.col("ts"))
    return rows.select(
        "event_id", fixed.alias("fixed"), (F.unix_micros(clock.from_text(fixed)) == F.floor(F.col("t") / 1000) * 1000).alias("whole_ms"), clock.day(F.col("ts")).alias("day"),
        F.unix_seconds("ts").alias("epoch_s"), clock.regime(F.lit("2024-01-16").cast("timestamp"), F.col("ts")).alias("regime"), clock.from_text(F.lit("")).isNull().alias("empty_is_null"),
    )


def settled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw items of venue K, one per day and user with two or more events: the ticker ends in the user, the market's result is its outcome."""
    rows = ticks(spark, sf_dir).withColumn("day", clock.day(F.col("ts")))
    market = F.struct(F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("ticker"), F.lit("settled").alias("status"), F.col("event_type").alias("yes_sub_title"), clock.to_text(F.col("ts")).alias("close_time"), F.when(F.col("k") >= 50, " yes").otherwise("no").alias("result"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("t").alias("by"), F.col("event_id").alias("id"), market.alias("m"))))
    grouped = rows.groupBy("day", "user_id").agg(F.transform(ordered, lambda x: x["m"]).alias("markets"))
    ticker = F.concat_ws("-", F.lit("KX"), F.col("day").cast("string"), F.col("user_id").cast("string"))
    return grouped.select((F.unix_date("day") * 10_000 + F.col("user_id")).alias("seq"), F.to_json(F.struct(ticker.alias("event_ticker"), F.lit("x: a vs b").alias("title"), "markets")).alias("item"))


def sweep_map_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sweeps.k_map_results(sweeps.parsed(settled_events(spark, sf_dir), sweeps.K_EVENT).withColumn("e", _distinct_names()))
    return found.select("seq", F.array_join("teams", ",").alias("teams"), clock.to_text(F.col("ts")).alias("ts"), "map_no", "winner", F.get("tickers", F.lit(0)).alias("first_ticker"))


def _distinct_names():  # noqa: ANN202
    """Names are made distinct by their place, as teams of one event are."""
    return F.col("e").withField("markets", F.transform("e.markets", lambda m, i: m.withField("yes_sub_title", F.concat(m["yes_sub_title"], i.cast("string")))))


def sweep_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = sweeps.parsed(settled_events(spark, sf_dir), sweeps.K_EVENT)
    found = sweeps.k_records(events, F.lit("map_winner"), "2024-01-10T00:00:00.000Z")
    contracts = sweeps.k_contracts(found).agg(F.count(F.lit(1)).alias("n_contracts"), F.min("contract_id").alias("first_contract"))
    return found.agg(F.count(F.lit(1)).alias("n_records"), F.min(clock.to_text(F.col("ts"))).alias("oldest")).crossJoin(contracts)


STREAM_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def drained(stream: DataFrame, spark: SparkSession, label: str, wait: Callable[[StreamingQuery], None] = StreamingQuery.awaitTermination) -> DataFrame:
    """All that a stream gives until what is there now is read: its batches, written."""
    conf, root = "spark.sql.streaming.stateStore.providerClass", folder(spark, label)
    before = spark.conf.get(conf, None)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:

        def batch(found: DataFrame, number: int) -> None:
            found.write.mode("overwrite").parquet(f"{root}/batches/number={number}")

        spark.createDataFrame([], stream.schema).write.parquet(f"{root}/batches/number=-1")  # for a stream without a batch
        wait(stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    finally:
        if before is not None:
            spark.conf.set(conf, before)
    return spark.read.schema(stream.schema).parquet(f"{root}/batches")


def stream_dedup_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a file stream, every one delivered again by a later batch, stored once; the stored rows per type."""
    twice = folder(spark, "twice")
    rows = spark.read.schema(STREAM_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    for delivery in ("first", "second"):
        rows.write.parquet(f"{twice}/{delivery}")
    files = len(spark.read.schema(STREAM_SCHEMA).parquet(f"{twice}/first").inputFiles())
    stream = spark.readStream.schema(STREAM_SCHEMA).option("maxFilesPerTrigger", max(files, 1)).parquet(f"{twice}/*").withColumn("ts", F.col("ts").cast("timestamp"))
    stored = drained(recorder.deduplicated(stream, "ts", "1 hour", ["event_id"]), spark, "ingest")
    return stored.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def stream_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live rule over events as a stream; the rows of the batch rule."""
    rows = spark.readStream.schema(STREAM_SCHEMA).parquet(f"{sf_dir}/events*.parquet").where("event_type IN ('click', 'view')")
    sides = rows.select(
        F.col("user_id").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.when(F.col("event_type") == "click", "k").otherwise("p").alias("side"), (F.col("value") / (F.col("value") + 50.0)).alias("price")
    )
    out = drained(live.live_divergences(sides, market.THRESHOLD, market.NEED, market.WINDOW), spark, "live")
    return out.select(F.col("key").cast("bigint").alias("user_id"), "t_start", *[F.round(c, 9).alias(c) for c in ("p_start", "k_start", "gap")])


LATE = market.DAY  # by so much ticks come late at most


def stream_late_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of several batches in which ticks come up to a day late and out of order; the rows of the batch rule."""
    rows = spark.read.schema(STREAM_SCHEMA).parquet(f"{sf_dir}/events.parquet").where("event_type IN ('click', 'view')")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    sides = rows.select(F.col("user_id").cast("string").alias("key"), micros.alias("t"), F.when(F.col("event_type") == "click", "k").otherwise("p").alias("side"), (F.col("value") / (F.col("value") + 50.0)).alias("price"), "event_id")
    late = sides.withColumn("batch", F.floor((F.col("t") + F.pmod(F.xxhash64("event_id"), F.lit(LATE))) / (8 * LATE))).drop("event_id")
    sent, files = folder(spark, "late"), max(len(rows.inputFiles()), 1)
    first, last, end = late.agg(F.min("batch"), F.max("batch"), F.max("t")).first()
    for number in range(first or 0, (last or -1) + 1):  # a few deliveries, one after another
        late.where(F.col("batch") == number).drop("batch").repartition(files).write.mode("append").parquet(sent)
    closing = spark.range(1).select(F.lit("").alias("key"), F.lit((end or 0) + 400 * market.DAY).alias("t"), F.lit("p").alias("side"), F.lit(0.0).alias("price"))
    closing.write.mode("append").parquet(sent)  # a tick far ahead moves the watermark over all others
    stream = spark.readStream.schema("key string, t bigint, side string, price double").option("maxFilesPerTrigger", files).parquet(sent)
    out = drained(live.event_time_divergences(stream, market.THRESHOLD, market.NEED, market.WINDOW, f"{LATE // 1_000_000} seconds", 90 * market.DAY), spark, "late-out")
    return out.select(F.col("key").cast("bigint").alias("user_id"), "t_start", *[F.round(c, 9).alias(c) for c in ("p_start", "k_start", "gap")])


# -- fixtures under perturbed names -------------------------------------------------------------
#: Invented teams; two share their initials.
ROSTER = (
    "Red Comet", "Blue Harbor", "Stone Giants", "Quiet Storm", "Iron Falcons", "Paper Tigers", "Silver Lake", "Night Owls", "Lucky Sevens", "Desert Wind", "Snow Leopards", "Velvet Kings", "Amber Wolves", "Copper Crown", "Jade Serpents",
    "Golden Mile",
)


def named_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as fixtures of two teams of the roster, named in the manner of their side: purchases are the neutral spine, clicks venue K, views venue P."""
    rows = ticks(spark, sf_dir)
    roster = F.array(*[F.lit(x) for x in ROSTER])
    side = F.when(F.col("event_type") == "purchase", "N").otherwise(F.col("venue"))
    first = (F.col("user_id") % 16).cast("int")
    second = ((F.col("user_id") % 16 + 1 + F.col("user_id") % 7) % 16).cast("int")
    rows = rows.withColumn("side", side).where("side IS NOT NULL").withColumn("_a", F.get(roster, first)).withColumn("_b", F.get(roster, second))

    def written(c: str):  # noqa: ANN202
        for_k = F.when(F.col("k") % 3 == 0, F.concat(c, F.lit(" Esports"))).when(F.col("k") % 3 == 1, F.upper(c)).otherwise(F.col(c))
        for_p = F.when(F.col("k") % 5 == 0, F.concat(F.lit("Team "), c)).otherwise(F.replace(c, F.lit(" "), F.lit("")))
        return F.when(F.col("side") == "K", for_k).when(F.col("side") == "P", for_p).otherwise(F.col(c))

    swapped = (F.col("side") == "P") & (F.col("k") % 2 == 0)
    rows = rows.withColumn("a", written("_a")).withColumn("b", written("_b"))
    rows = rows.withColumn("team_a", F.when(swapped, F.col("b")).otherwise(F.col("a"))).withColumn("team_b", F.when(swapped, F.col("a")).otherwise(F.col("b")))
    winner = F.when(F.col("k") % 9 == 0, None).when(F.col("k") >= 50, F.col("a")).otherwise(F.col("b"))
    return rows.select("event_id", "side", "user_id", "team_a", "team_b", clock.day(F.col("ts")).alias("day"), (F.col("k") % 5).alias("map_no"), winner.alias("winner"), F.when(F.col("k") >= 50, "map_winner").otherwise("series_winner").alias("family"))


def _of_side(rows: DataFrame, side: str, key: str) -> DataFrame:
    return rows.where(F.col("side") == side).withColumnRenamed("event_id", key)


def banded_fuzzy_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = named_fixtures(spark, sf_dir)
    left = _of_side(rows, "N", "match_id")
    found = matching.fuzzy_first_match(left, _of_side(rows, "P", "seq"), "day", ("team_a", "team_b"), ["map_no"], 1, "p_", "seq", ["seq", "winner"])
    return found.select("match_id", "dshift", "p_seq", "p_winner")


def coverage_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = named_fixtures(spark, sf_dir)
    records = rows.where("side <> 'N'").withColumnRenamed("side", "venue")
    found = gates.fuzzy_coverage(_of_side(rows, "N", "match_id"), records, ("K", "P"), Census())
    return found.select("match_id", "covered", "covered_series_winner", "covered_map_winner")


def same_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts of both venues on one day, of users that are near each other."""
    rows = named_fixtures(spark, sf_dir).withColumn("near", F.floor(F.col("user_id") / 2))
    sides = {n: rows.where(F.col("side") == v).select("day", "near", F.col("event_id").alias(f"id_{n}"), F.col("team_a").alias(f"a_{n}"), F.col("team_b").alias(f"b_{n}"), F.col("map_no").alias(f"map_{n}"), F.col("winner").alias(f"winner_{n}")) for n, v in ((1, "P"), (2, "K"))}
    return matching.same_claim(sides[1].join(sides[2], ["day", "near"])).select("id_1", "id_2", "same_claim")


def parity_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = named_fixtures(spark, sf_dir)
    counts, _ = gates.fuzzy_parity(_of_side(rows, "N", "match_id"), _of_side(rows, "K", "seq"), _of_side(rows, "P", "seq"))
    found = gates.parity(counts, F.col("n_void"), Parity())
    return found.select("n_aligned", "n_agree", "n_void", *[F.round(c, 9).alias(c) for c in ("pass_rate", "first_rate", "second_rate")], "passed")


QUERIES = {
    f.__name__: f
    for f in (
        normalize_name, classify_family, league_remap, fuzzy_rule_match, fuzzy_ratio_match, fixture_match, first_side_lookup, parse_title, json_props, winner_from_arrays, explode_markets, ts_roundtrip,
        sweep_map_results, sweep_records, stream_dedup_ingest, stream_divergence, stream_late_divergence, banded_fuzzy_first_match, coverage_fuzzy, same_claim, parity_fuzzy,
    )
}

_ORG = r"\b(" + "|".join(text.ORG_WORDS) + r")\b"
_SECOND = r"(?i)\b(" + "|".join(text.SECOND_SQUAD) + r")\b"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _deapos(x: str) -> str:
    return f"replace(replace(lower({x}), '''', ''), '’', '')"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, ' +', ' ', 'g'))"


def _normal(x: str) -> str:
    return _squeeze(f"regexp_replace(regexp_replace({_deapos(x)}, {_q(_ORG)}, ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g')")


def _acronym(x: str) -> str:
    return f"array_to_string(list_transform(string_split({_squeeze(f'regexp_replace({_deapos(x)}, {_q(text.NOT_ALNUM)}, {_q(chr(32))}, {_q(chr(103))})')}, ' '), lambda w: substr(w, 1, 1)), '')"


def _compact(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def _second(x: str) -> str:
    return f"regexp_matches({x}, {_q(_SECOND)})"


def _parts(x: str, s: str) -> str:
    return f"{_normal(x)} AS n{s}, {_acronym(x)} AS a{s}, {_compact(x)} AS c{s}, {_second(x)} AS s{s}"


_RULE = """CASE WHEN s1 <> s2 THEN false WHEN n1 = '' OR n2 = '' THEN false WHEN n1 = n2 THEN true
  WHEN a1 <> '' AND (a1 = replace(n2, ' ', '') OR a1 = c2 OR a1 = a2) OR a2 <> '' AND (a2 = replace(n1, ' ', '') OR a2 = c1) THEN true
  WHEN least(length(c1), length(c2)) >= 3 AND CASE WHEN length(c1) <= length(c2) THEN starts_with(c2, c1) ELSE starts_with(c1, c2) END THEN true
  WHEN least(length(n1), length(n2)) >= 4 AND (contains(n2, n1) OR contains(n1, n2)) THEN true END"""
_PAIRS = f"{TEAMS}, names AS (SELECT DISTINCT p_brand, name FROM teams), pairs AS (SELECT x.p_brand, x.name AS a, y.name AS b FROM names x JOIN names y ON x.p_brand = y.p_brand AND x.name < y.name)"


def _family_sql() -> str:
    from functools import reduce

    cleaned = reduce(lambda t, x: f"regexp_replace({t}, {_q('(?i)' + text.literal(x))}, ' ', 'g')", text.LOOKALIKES, "title")
    codes, names = _q(r"\b(" + "|".join(text.LEAGUE_CODES) + r")\b"), _q("(?i)" + text.any_of(tuple(map(text.literal, text.LEAGUE_NAMES))))
    prop = f"regexp_matches(title, {_q('(?i)' + text.any_of(text.PROPS))})"
    return f"""WITH {TITLED}, c AS (SELECT *, {prop} AS prop, {cleaned} AS cleaned FROM titled)
SELECT p_partkey, prop, CASE WHEN prop THEN NULL WHEN regexp_matches(title, {_q('(?i)' + text.MAP_NUMBER)}) AND regexp_matches(title, {_q('(?i)' + text.WINNER)}) THEN 'map_winner'
  WHEN regexp_matches(title, {_q('(?i)' + text.any_of(text.SERIES))}) THEN 'series_winner' END AS family, regexp_matches(cleaned, {codes}) OR regexp_matches(cleaned, {names}) AS first_tier FROM c"""


def _fixture_sql() -> str:
    """Forms of each name once, each pair of names once."""
    sides = {"ac": ("a", "c"), "ad": ("a", "d"), "bc": ("b", "c"), "bd": ("b", "d")}
    met = " UNION ".join(f"SELECT {x} AS l, {y} AS r FROM four" for x, y in sides.values())
    looked_up = " ".join(f"LEFT JOIN same {k} ON {k}.l = f.{x} AND {k}.r = f.{y}" for k, (x, y) in sides.items())
    known = {k: f"{k}.l IS NOT NULL" for k in sides}
    return f"""WITH {_PAIRS}, four AS MATERIALIZED (SELECT *, b || ' Team' AS c, upper(a) AS d FROM pairs),
forms AS MATERIALIZED (SELECT name, {_parts('name', '')} FROM (SELECT DISTINCT unnest([a, b, c, d]) AS name FROM four)), met AS ({met}),
ruled AS (SELECT l, r, x.n AS n1, x.a AS a1, x.c AS c1, x.s AS s1, y.n AS n2, y.a AS a2, y.c AS c2, y.s AS s2 FROM met JOIN forms x ON x.name = l JOIN forms y ON y.name = r),
same AS MATERIALIZED (SELECT l, r FROM ruled WHERE {_RULE})
SELECT p_brand, f.a, f.b, ({known['ac']} AND {known['bd']}) OR ({known['ad']} AND {known['bc']}) AS same FROM four f {looked_up}"""


_GROUPED = TICKS + """, turns AS (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY CAST(ts AS DATE), user_id) AS n FROM ticks),
text AS (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS fixed, date_diff('day', DATE '1970-01-01', day) * 10000 + user_id AS seq FROM turns WHERE n >= 2)"""


def _written(c: str) -> str:
    return f"""CASE side WHEN 'K' THEN CASE k % 3 WHEN 0 THEN {c} || ' Esports' WHEN 1 THEN upper({c}) ELSE {c} END
  WHEN 'P' THEN CASE WHEN k % 5 = 0 THEN 'Team ' || {c} ELSE replace({c}, ' ', '') END ELSE {c} END"""


NAMED = f"""WITH {TICKS}, sided AS (
  SELECT event_id, user_id, k, ts, CASE WHEN event_type = 'purchase' THEN 'N' ELSE venue END AS side, {_listed(ROSTER)}[user_id % 16 + 1] AS x, {_listed(ROSTER)}[(user_id % 16 + 1 + user_id % 7) % 16 + 1] AS y FROM ticks
), written AS (SELECT *, {_written('x')} AS a, {_written('y')} AS b FROM sided WHERE side IS NOT NULL), fx AS (
  SELECT event_id, side, user_id, CASE WHEN side = 'P' AND k % 2 = 0 THEN b ELSE a END AS team_a, CASE WHEN side = 'P' AND k % 2 = 0 THEN a ELSE b END AS team_b, CAST(ts AS DATE) AS day, k % 5 AS map_no,
    CASE WHEN k % 9 = 0 THEN NULL WHEN k >= 50 THEN a ELSE b END AS winner, CASE WHEN k >= 50 THEN 'map_winner' ELSE 'series_winner' END AS family FROM written
), nm AS (SELECT DISTINCT unnest([team_a, team_b]) AS name FROM fx),
same AS (SELECT l || '|' || r AS pair FROM (SELECT x.name AS l, y.name AS r, {_parts('x.name', '1')}, {_parts('y.name', '2')} FROM nm x, nm y) WHERE {_RULE})"""


def _means(x: str, y: str) -> str:
    return f"({x} || '|' || {y}) IN (SELECT pair FROM same)"


def _fixture(x: str, y: str) -> str:
    straight = f"{_means(f'{x}.team_a', f'{y}.team_a')} AND {_means(f'{x}.team_b', f'{y}.team_b')}"
    return f"(({straight}) OR ({_means(f'{x}.team_a', f'{y}.team_b')} AND {_means(f'{x}.team_b', f'{y}.team_a')}))"


_NEAR = "abs(date_diff('day', {x}.day, {y}.day)) <= 1"
_PAIR = f"list_sort(list_distinct([{_normal('team_a')}, {_normal('team_b')}]))"
PARITY_FUZZY = f"""{NAMED}, once AS (
  SELECT *, min(event_id) OVER same_map AS slot FROM (SELECT *, {_PAIR} AS pair FROM fx WHERE side <> 'N') WINDOW same_map AS (PARTITION BY side, pair, day, map_no)
  QUALIFY row_number() OVER (PARTITION BY side, pair, day, map_no ORDER BY winner IS NULL, event_id) = 1
), hit AS (
  SELECT n.event_id, n.winner, v.side, arg_min(v.winner, {{'s': date_diff('day', n.day, v.day), 'o': v.slot}}) AS found, arg_min(coalesce(v.winner, ''), {{'s': date_diff('day', n.day, v.day), 'o': v.slot}}) AS first_found
  FROM fx n JOIN once v ON n.side = 'N' AND n.winner IS NOT NULL AND n.map_no = v.map_no AND {_NEAR.format(x='n', y='v')} AND {_fixture('n', 'v')} GROUP BY ALL
), aligned AS (SELECT x.winner, x.first_found AS kw, y.first_found AS pw FROM hit x JOIN hit y ON x.event_id = y.event_id AND x.side = 'K' AND y.side = 'P' WHERE x.first_found <> '' AND y.first_found <> ''),
voids AS (
  SELECT * FROM once v WHERE winner IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fx n WHERE n.side = 'N' AND n.map_no = v.map_no AND {_NEAR.format(x='n', y='v')} AND {_fixture('v', 'n')})
    AND EXISTS (SELECT 1 FROM fx n WHERE n.side = 'N' AND {_NEAR.format(x='n', y='v')} AND {_fixture('v', 'n')})
), counted AS (SELECT count(*) AS n_aligned, count(*) FILTER ({_means('kw', 'pw')}) AS n_agree, count(*) FILTER ({_means('kw', 'winner')}) AS n_k, count(*) FILTER ({_means('pw', 'winner')}) AS n_p, (SELECT count(*) FROM voids) AS n_void FROM aligned)
SELECT n_aligned, n_agree, n_void, coalesce(round(n_agree / nullif(n_aligned, 0), 9), 0) AS pass_rate, round(n_k / nullif(n_aligned, 0), 9) AS first_rate, round(n_p / nullif(n_aligned, 0), 9) AS second_rate,
  CASE WHEN n_aligned >= 30 THEN n_agree / n_aligned >= 0.95 AND n_void = 0 END AS passed FROM counted"""

SQL = {
    "normalize_name": f"""WITH {TEAMS}, x AS (SELECT p_partkey, {_parts('name', '1')}, {_normal('p_brand')} AS nb FROM teams)
SELECT p_partkey, n1 AS normal, a1 AS acronym, c1 AS compact, s1 AS second, CASE WHEN n1 = nb THEN n1 ELSE least(n1, nb) || '|' || greatest(n1, nb) END AS pair FROM x""",
    "classify_family": _family_sql(),
    "league_remap": """WITH c AS (SELECT trim(['WLDs', ' LTA N ', 'LCK', 'LTA S', 'other'][p_partkey % 5 + 1]) AS code FROM part)
SELECT CASE code WHEN 'WLDs' THEN 'Worlds' WHEN 'LTA N' THEN 'LTA' WHEN 'LTA S' THEN 'LTA' ELSE code END AS league, count(*) AS n FROM c GROUP BY 1""",
    "fuzzy_rule_match": f"WITH {_PAIRS}, x AS (SELECT *, {_parts('a', '1')}, {_parts('b', '2')} FROM pairs) SELECT p_brand, a, b, {_RULE} AS same FROM x",
    "fixture_match": _fixture_sql(),
    "first_side_lookup": f"""WITH x AS (SELECT p_partkey, list_concat([p_brand], string_split(p_name, ' '), [p_name]) AS names, [p_type, p_size::VARCHAR, 'third'] AS tokens, p_size FROM part),
each AS (SELECT p_partkey, unnest(names) AS name, unnest(range(len(names))) AS pos, upper(names[p_size % 4 + 1]) || ' Esports' AS team FROM x),
ruled AS (SELECT p_partkey, pos, {_RULE} AS same FROM (SELECT p_partkey, pos, {_parts('name', '1')}, {_parts('team', '2')} FROM each)),
hit AS (SELECT p_partkey, min(pos) AS side FROM ruled WHERE same GROUP BY p_partkey)
SELECT x.p_partkey, CAST(side AS BIGINT) AS side, tokens[side + 1] AS token FROM x LEFT JOIN hit ON x.p_partkey = hit.p_partkey""",
    "parse_title": r"""WITH x AS (SELECT p_partkey, p_name, 'LCK: ' || p_name || CASE p_size % 3 WHEN 0 THEN ' vs. ' WHEN 1 THEN ' vs ' ELSE ' and ' END || 'Semi-Pro ' || p_brand || CASE p_size % 2 WHEN 0 THEN ' (BO5) - Final' ELSE ' - Final' END AS title,
  'lol-' || p_name || '-2024-' || lpad((p_size % 15)::VARCHAR, 2, '0') || '-17-map-' || p_size AS slug FROM part),
y AS (SELECT *, regexp_replace(title, '( - |\().*$', '') AS cut FROM x),
z AS (SELECT *, nullif(trim(regexp_extract(cut, '^[^:]+:\s*(.+?)\s+vs\.?\s+(.+)', 1)), '') AS a0, nullif(trim(regexp_extract(cut, '^[^:]+:\s*(.+?)\s+vs\.?\s+(.+)', 2)), '') AS b0 FROM y)
SELECT p_partkey, CASE WHEN b0 IS NOT NULL THEN a0 END AS a, CASE WHEN a0 IS NOT NULL THEN b0 END AS b,
  strftime(coalesce(try_strptime(nullif(regexp_extract(slug, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), ''), '%Y-%m-%d'), TIMESTAMP '2024-02-03 04:05:06'), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS slug_day,
  string_split(slug, '-')[-1] AS suffix, string_split(slug, '-')[-1]::INT AS map_no, CASE WHEN regexp_matches(string_split(p_name, '-')[-1], '^[0-9]+$') THEN try_cast(string_split(p_name, '-')[-1] AS INT) END AS no_map FROM z""",
    "json_props": """SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS INTEGER))::BIGINT AS sum_k, max(json_array_length('[' || json_extract_string(props, '$.k') || ', 7]'))::BIGINT AS listed,
  max(CASE WHEN json_valid(event_type) THEN json_array_length(event_type) ELSE 0 END)::BIGINT AS bad, max(CASE WHEN json_valid(event_type) THEN json_extract_string(event_type, '$[0]') ELSE event_type END) AS itself, min(sha256(props)) AS least_sha FROM events GROUP BY event_type""",
    "winner_from_arrays": f"WITH {TICKS} SELECT event_id, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 3 = 0 THEN 'a' WHEN k % 2 = 0 THEN 'b' END AS winner FROM ticks",
    "explode_markets": """SELECT conv_id, (row_number() OVER w - 1)::INT AS pos, role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)""",
    "ts_roundtrip": f"""WITH {TICKS} SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS fixed, epoch_us(strptime(strftime(ts, '%Y-%m-%dT%H:%M:%S.%g'), '%Y-%m-%dT%H:%M:%S.%g')) = t // 1000 * 1000 AS whole_ms,
  CAST(ts AS DATE) AS day, t // 1000000 AS epoch_s, regime, try_strptime('', '%Y-%m-%dT%H:%M:%S.%g') IS NULL AS empty_is_null FROM ticks""",
    "sweep_map_results": f"""WITH {_GROUPED} SELECT seq, string_agg(event_type || i, ',' ORDER BY i) AS teams, first(fixed ORDER BY i) AS ts, user_id::INT AS map_no, first(event_type || i ORDER BY i) FILTER (k >= 50) AS winner, 'T' || first(event_id ORDER BY i) AS first_ticker
FROM text GROUP BY seq, user_id""",
    "sweep_records": f"""WITH {_GROUPED}, r AS (SELECT seq, first(ts ORDER BY i) AS ts, first(fixed ORDER BY i) AS fixed, count(*) AS n, min('T' || event_id) AS c FROM text GROUP BY seq)
SELECT count(*) AS n_records, min(fixed) AS oldest, sum(n)::BIGINT AS n_contracts, min(c) AS first_contract FROM r WHERE ts >= TIMESTAMP '2024-01-10'""",
    "banded_fuzzy_first_match": f"""{NAMED}, hit AS (
  SELECT n.event_id, min(struct_pack(s := date_diff('day', n.day, p.day), e := p.event_id, w := p.winner)) AS h
  FROM fx n JOIN fx p ON n.side = 'N' AND p.side = 'P' AND n.map_no = p.map_no AND {_NEAR.format(x='n', y='p')} AND {_fixture('n', 'p')} GROUP BY n.event_id
) SELECT n.event_id AS match_id, h.s::INT AS dshift, h.e AS p_seq, h.w AS p_winner FROM fx n LEFT JOIN hit ON n.event_id = hit.event_id WHERE n.side = 'N'""",
    "coverage_fuzzy": f"""{NAMED}, series AS (
  SELECT * FROM (SELECT *, {_PAIR} AS pair FROM fx WHERE side = 'N') QUALIFY row_number() OVER (PARTITION BY pair, day ORDER BY event_id) = 1
), flags AS (
  SELECT s.event_id, count(DISTINCT r.side) AS n_all, count(DISTINCT r.side) FILTER (r.family = 'series_winner') AS n_s, count(DISTINCT r.side) FILTER (r.family = 'map_winner') AS n_m
  FROM series s JOIN fx r ON r.side <> 'N' AND {_NEAR.format(x='s', y='r')} AND {_fixture('s', 'r')} GROUP BY s.event_id
) SELECT s.event_id AS match_id, coalesce(n_all = 2, false) AS covered, coalesce(n_all = 2 AND n_s = 2, false) AS covered_series_winner, coalesce(n_all = 2 AND n_m = 2, false) AS covered_map_winner
FROM series s LEFT JOIN flags f ON s.event_id = f.event_id""",
    "same_claim": f"""{NAMED} SELECT x.event_id AS id_1, y.event_id AS id_2,
  x.map_no = y.map_no AND {_fixture('x', 'y')} AND (x.winner IS NULL OR y.winner IS NULL OR {_means('x.winner', 'y.winner')}) AS same_claim
FROM fx x JOIN fx y ON x.side = 'P' AND y.side = 'K' AND x.day = y.day AND x.user_id // 2 = y.user_id // 2""",
    "parity_fuzzy": PARITY_FUZZY,
    "stream_divergence": market.SQL["divergences"],
    "stream_late_divergence": market.SQL["divergences"],
    "stream_dedup_ingest": "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type",
}
