"""Schemas of the stored tables, and checks that a write must pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType, TimestampType

KINDS = {"string": StringType(), "int": IntegerType(), "double": DoubleType(), "boolean": BooleanType(), "timestamp": TimestampType(), "long": LongType(), "strings": ArrayType(StringType())}

TABLES: dict[str, StructType] = {
    name: StructType([StructField(column, KINDS[kind]) for column, kind in (part.split() for part in columns.split(","))])
    for name, columns in {
        "matches": "match_id string, league string, team_a string, team_b string, start_ts timestamp, best_of int, neutral_source string, result_winner string, result_ts timestamp",
        "contracts": "contract_id string, venue string, match_id string, family string, outcome_side string, question_text string, parity_ok boolean",
        "quotes": "contract_id string, venue string, ts timestamp, source string, regime string, bid double, ask double, mid double, last double, bid_size_usd double, ask_size_usd double",
        "book_snapshots": "contract_id string, venue string, ts timestamp, source string, regime string, fetch_latency_ms int, best_bid double, best_ask double, mid double, top_bid_usd double, top_ask_usd double, full_bid_usd double, full_ask_usd double, n_levels int, book_ok int, raw_json string",
        "cursors": "stream string, cursor_value string, updated_ts timestamp",
        "discards": "stage string, contract_id string, match_id string, ts timestamp, reason string",
        "spend_log": "venue string, ts timestamp, endpoint string, status int, remaining_quota string, note string",
        "maps": "match_id string, team_a string, team_b string, start_ts timestamp, map_no int, winner string, length_s int",
        "records": "venue string, contract_id string, family string, team_a string, team_b string, ts timestamp",
        "map_results": "venue string, contract_id string, seq long, team_a string, team_b string, ts timestamp, map_no int, winner string, names strings, contracts strings",
        "prices": "venue string, contract_id string, t long, price double",
        "sweeps": "venue string, n_records long, oldest_ts timestamp, capped boolean, ts timestamp",
        "run_artifacts": "run_id string, gate string, created_ts timestamp, path string, table_hash string",
    }.items()
}

KEYS: dict[str, tuple[str, ...]] = {
    "matches": ("match_id",),
    "contracts": ("contract_id",),
    "quotes": ("contract_id", "ts", "source"),
    "book_snapshots": ("contract_id", "ts", "source"),
    "cursors": ("stream",),
    "maps": ("match_id",),
    "records": ("venue", "contract_id"),
    "map_results": ("venue", "contract_id"),
    "prices": ("venue", "contract_id", "t"),
    "sweeps": ("venue",),
    "run_artifacts": ("run_id", "gate"),
}

REQUIRED: dict[str, tuple[str, ...]] = {
    "matches": ("match_id", "league", "team_a", "team_b", "start_ts", "neutral_source"),
    "contracts": ("contract_id", "venue"),
    "quotes": ("contract_id", "venue", "ts", "source"),
    "book_snapshots": ("contract_id", "venue", "ts", "source"),
    "maps": ("match_id", "team_a", "team_b", "start_ts", "map_no"),
    "records": ("venue", "contract_id", "ts"),
    "map_results": ("venue", "contract_id", "map_no", "ts"),
    "prices": ("venue", "contract_id", "t"),
}

REFERENCES: dict[str, tuple[str, str, str]] = {"quotes": ("contract_id", "contracts", "contract_id"), "contracts": ("match_id", "matches", "match_id")}


def conform(rows: DataFrame, table: str) -> DataFrame:
    """The declared columns of a table, in order: missing ones null, others left out.

    Raises ValueError for a timestamp without a time zone: a naive time has no place on a shared clock.
    """
    kinds = dict(zip(rows.columns, (f.dataType for f in rows.schema.fields), strict=True))
    naive = [f.name for f in TABLES[table].fields if isinstance(kinds.get(f.name), TimestampNTZType)]
    if naive:
        raise ValueError(f"{table}: {', '.join(naive)} without a time zone")
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table].fields])


def faults(rows: DataFrame, table: str) -> DataFrame:
    """``column``, ``n``: required columns that hold nulls."""
    required: Sequence[str] = REQUIRED.get(table, ())
    counts = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in required]))).where("n > 0")


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose key is set but has no parent."""
    return rows.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def create(spark: SparkSession, database: str | None = None) -> None:
    """Create the tables that are not there yet."""
    for name, schema in TABLES.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database + '.' if database else ''}{name} ({columns}) USING parquet")
