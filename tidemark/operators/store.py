"""The stored tables: idempotent, atomic writes without a table format.

What the store holds is said by its last commit: a small file that lists, for every table
and day, the folders with its rows.  A write puts new folders beside the old ones and then
creates the next commit by one rename, for several tables at once where they belong
together (snapshots and their cursor).  Whatever is cut off before that rename is not part of
the store, and a reader sees the state before or after a write and nothing else.

Quotes, snapshots and prices are kept by day: a write reads and replaces the days that its rows
touch and no others.  The other tables are small and replaced as a whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema


def last_wins(existing: DataFrame, new: DataFrame, key: Sequence[str], keep: Sequence[str] = (), seq: Sequence[str] = (), keep_if_null: Sequence[str] = ()) -> DataFrame:
    """Existing and new rows, one per key: the last new one, else the existing one.

    ``keep`` columns hold the value of the first row of a key, ``keep_if_null`` columns their
    last value that is not null.  ``seq`` orders new rows and is not part of the result.
    """
    columns = [c for c in existing.columns if c not in key]
    zero = [F.lit(None).cast(new.schema[c].dataType).alias(c) for c in seq]
    old = existing.select(*existing.columns, *zero).withColumn("_new", F.lit(0))
    rows = old.unionByName(new.select(*existing.columns, *seq).withColumn("_new", F.lit(1)))
    order = F.struct("_new", *seq)

    def picked(c: str) -> Column:
        if c in keep:
            return F.min_by(F.struct(c), order)[c].alias(c)
        if c in keep_if_null:
            return F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
        return F.max_by(F.struct(c), order)[c].alias(c)

    return rows.groupBy(*key).agg(*[picked(c) for c in columns]).select(*existing.columns)


def first_wins(existing: DataFrame, new: DataFrame, key: Sequence[str], seq: Sequence[str] = ()) -> DataFrame:
    """The new rows whose key is not there yet; of several the first by ``seq``."""
    others = [c for c in new.columns if c not in key and c not in seq]
    one = new.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct(*(seq or others))).alias("_r")).select(*key, "_r.*")
    return one.join(existing.select(*key), list(key), "left_anti").select(*[c for c in new.columns if c not in seq])


def discarded(rows: DataFrame, stage: str, keep: Column, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass a filter, and ``stage``, ``reason``, ``n`` of the rest.  A null condition does not pass."""
    passes = F.coalesce(keep, F.lit(False))
    lost = rows.where(~passes).groupBy(F.lit(stage).alias("stage"), reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return rows.where(passes), lost


Parts = dict[str, list[str]]  # of a table: its days (or "all") and the folders that hold each

BY_DAY = {"quotes": "ts", "book_snapshots": "ts", "prices": "t"}  # a time, or a number of seconds
LOGS = ("discards", "spend_log")  # rows are only ever added
MOST_FOLDERS = 16  # of a day; more are written anew as one


class Conflict(RuntimeError):
    """Another writer has changed a table since it was read."""


class Store:
    """The tables of one sport under a folder that Spark can write."""

    def __init__(self, spark: SparkSession, root: str, strict: bool = False):
        """``strict``: a write whose rows refer to missing parents is refused."""
        self.spark, self.root, self.strict = spark, root.rstrip("/"), strict

    # -- commits ---------------------------------------------------------------------------
    def _path(self, path: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):  # noqa: ANN202
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The numbers of the commits that are there."""
        fs, log = self._fs(), self._path(f"{self.root}/_commits")
        names = [f.getPath().getName() for f in fs.listStatus(log)] if fs.exists(log) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def _state(self) -> tuple[int, dict[str, Parts]]:
        """The last commit and what it lists; (0, {}) for a new store."""
        found = self.versions()
        if not found:
            return 0, {}
        stream = self._fs().open(self._path(f"{self.root}/_commits/{found[-1]:012}.json"))
        try:
            return found[-1], json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, base: dict[str, Parts], changed: dict[str, Parts]) -> None:
        """Make ``changed`` the state of its tables; other tables stay as another writer may have left them."""
        fs, log = self._fs(), f"{self.root}/_commits"
        while True:
            version, now = self._state()
            if any(now.get(t) != base.get(t) for t in changed):
                raise Conflict(f"{', '.join(changed)}: another writer was faster")
            staged, final = self._path(f"{log}/_{uuid.uuid4().hex}"), self._path(f"{log}/{version + 1:012}.json")
            out = fs.create(staged, True)
            out.write(bytearray(json.dumps(now | changed, sort_keys=True).encode()))
            out.close()
            if not fs.exists(final) and fs.rename(staged, final):
                return
            fs.delete(staged, False)

    def vacuum(self, keep: int = 10) -> None:
        """Delete all commits but the last ``keep`` and the folders that none of these lists.  No write may be under way."""
        fs, old = self._fs(), self.versions()[:-keep]
        for version in old:
            fs.delete(self._path(f"{self.root}/_commits/{version:012}.json"), False)
        listed = set()
        for version in self.versions():
            stream = fs.open(self._path(f"{self.root}/_commits/{version:012}.json"))
            state = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            listed |= {folder.split("/")[1] for parts in state.values() for folders in parts.values() for folder in folders}
        for table in TABLES_OF_STORE:
            at = self._path(f"{self.root}/{table}")
            for found in fs.listStatus(at) if fs.exists(at) else []:
                if found.getPath().getName() not in listed:
                    fs.delete(found.getPath(), True)

    # -- reading and writing ------------------------------------------------------------------
    def _read(self, table: str, parts: Parts, days: Sequence[str] | None = None) -> DataFrame:
        folders = [f"{self.root}/{f}" for day, fs in parts.items() if days is None or day in days for f in fs]
        if not folders:
            return self.spark.createDataFrame([], schema.TABLES[table])
        return self.spark.read.schema(schema.TABLES[table]).parquet(*folders)

    def read(self, table: str, days: Sequence[str] | None = None) -> DataFrame:
        """The table, or the given days (ISO) of it; empty if nothing has been written."""
        return self._read(table, self._state()[1].get(table, {}), days)

    def _write(self, table: str, rows: DataFrame) -> Parts:
        """Rows in a new folder, which no commit lists yet."""
        at = f"{table}/{uuid.uuid4().hex}"
        if table not in BY_DAY:
            rows.write.parquet(f"{self.root}/{at}")
            return {"all": [at]}
        at_time = F.col(BY_DAY[table])
        day = F.coalesce(F.date_format(at_time if dict(rows.dtypes)[BY_DAY[table]] == "timestamp" else F.timestamp_seconds(at_time), "yyyy-MM-dd"), F.lit("none"))
        rows.withColumn("_day", day).write.partitionBy("_day").parquet(f"{self.root}/{at}")
        names = [f.getPath().getName() for f in self._fs().listStatus(self._path(f"{self.root}/{at}")) if f.isDirectory()]
        return {n.removeprefix("_day="): [f"{at}/{n}"] for n in sorted(names) if n.startswith("_day=")}

    def _checked(self, table: str, rows: DataFrame) -> Parts:
        """New rows in a folder of their own, where the table's rules hold; ValueError if they don't."""
        new = self._write(table, schema.conform(rows, table))
        staged = self._read(table, new)
        faults = [f"{r['n']} without {r['column']}" for r in schema.faults(staged, table).collect()] if schema.REQUIRED.get(table) else []
        if self.strict and table in schema.REFERENCES:
            key, parents, parent_key = schema.REFERENCES[table]
            if lost := schema.orphans(staged, self.read(parents), key, parent_key).count():
                faults.append(f"{lost} whose {key} is not in {parents}")
        if faults:
            raise ValueError(f"{table}: {', '.join(faults)}")
        return new

    def _upserted(self, table: str, rows: DataFrame, parts: Parts) -> Parts:
        new = self._checked(table, rows)
        kept = ("venue",) if table in ("quotes", "contracts") else ()
        merged = last_wins(self._read(table, parts, list(new)), self._read(table, new), schema.KEYS[table], kept, keep_if_null=("parity_ok",) if table == "contracts" else ())
        return parts | self._write(table, merged)

    def _added(self, table: str, rows: DataFrame, parts: Parts, once: bool) -> Parts:
        new = self._checked(table, rows)
        if once:
            new = self._write(table, first_wins(self._read(table, parts, list(new)), self._read(table, new), schema.KEYS[table]))
        out = parts | {day: [*parts.get(day, []), *folders] for day, folders in new.items()}
        for day in [d for d in new if len(out[d]) > MOST_FOLDERS]:
            out |= self._write(table, self._read(table, out, [day]))
        return out

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Last write wins, but a contract or quote keeps its venue, and a null parity flag leaves the one that is there."""
        base = self._state()[1]
        self._commit(base, {table: self._upserted(table, rows, base.get(table, {}))})

    def append_absent(self, table: str, rows: DataFrame, cursor: tuple[str, str] | None = None) -> None:
        """First write wins; what is there stays untouched.  ``cursor`` (stream, value) moves in the same commit."""
        base = self._state()[1]
        changed = {table: self._added(table, rows, base.get(table, {}), True)}
        if cursor:
            changed["cursors"] = self._upserted("cursors", self._cursor_row(*cursor), base.get("cursors", {}))
        self._commit(base, changed)

    def append(self, table: str, rows: DataFrame) -> None:
        base = self._state()[1]
        self._commit(base, {table: self._added(table, rows, base.get(table, {}), False)})

    def _cursor_row(self, stream: str, value: str) -> DataFrame:
        return self.spark.range(1).select(F.lit(stream).alias("stream"), F.lit(value).alias("cursor_value"), F.current_timestamp().alias("updated_ts"))

    def set_cursor(self, stream: str, value: str) -> None:
        self.upsert("cursors", self._cursor_row(stream, value))

    def cursor(self, stream: str) -> str | None:
        row = self.read("cursors").where(F.col("stream") == stream).first()
        return row["cursor_value"] if row else None

    def log_spend(self, venue: str, endpoint: str, status: int, remaining_quota: str | None = None, note: str | None = None) -> None:
        row = self.spark.createDataFrame([(venue, endpoint, status, remaining_quota, note)], "venue string, endpoint string, status int, remaining_quota string, note string")
        self.append("spend_log", row.withColumn("ts", F.current_timestamp()))

    def record_discards(self, rows: DataFrame, stage: str, reason: Column) -> None:
        """Every row that a stage leaves out, with its keys where it has them."""
        self.append("discards", rows.withColumn("stage", F.lit(stage)).withColumn("reason", reason).withColumn("ts", F.current_timestamp()))

    def write_artifact(self, gate: str, payload: dict, run_id: str) -> dict:
        """Store a gate's result as JSON with sorted keys; returns it with its path.  The hash is of the payload without the path."""
        text = json.dumps(payload, sort_keys=True, default=str)
        path = f"{self.root}/artifacts/{gate}_{run_id}"
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
        row = self.spark.createDataFrame([(run_id, gate, path, sha256(text.encode()).hexdigest())], "run_id string, gate string, path string, table_hash string")
        self.upsert("run_artifacts", row.withColumn("created_ts", F.current_timestamp()))
        return payload | {"artifact_path": path}

    def latest_artifact(self, gate: str) -> dict | None:
        """The gate's artifact with the greatest run id; null if there is none."""
        row = self.read("run_artifacts").where(F.col("gate") == gate).agg(F.max_by("path", "run_id").alias("path")).first()
        if row is None or row["path"] is None:
            return None
        lines = self.spark.read.text(row["path"]).first()["value"]
        return json.loads(lines) | {"artifact_path": row["path"]}


TABLES_OF_STORE = tuple(schema.TABLES)
