"""Payloads that fan out: a table function that turns one into rows of a wanted schema."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

KINDS: dict[str, tuple[DataType, object]] = {
    "double": (DoubleType(), float), "bigint": (LongType(), int), "boolean": (BooleanType(), bool), "string": (StringType(), lambda x: x if isinstance(x, str) else json.dumps(x)),
}


def wanted(columns: str) -> list[tuple[str, str]]:
    """Names and kinds of 'price double, size double'."""
    pairs = [tuple(x.split()) for x in columns.split(",")]
    if bad := [x for x in pairs if len(x) != 2 or x[1] not in KINDS]:
        raise ValueError(f"not a name and one of {', '.join(KINDS)}: {bad}")
    return pairs


def read_as(value: object, kind: str) -> object:
    """The value as that kind, null if it cannot be read so."""
    if value is None or (kind != "string" and isinstance(value, bool) != (kind == "boolean")):
        return None
    try:
        found = KINDS[kind][1](value)
    except (TypeError, ValueError, OverflowError):
        return None
    return None if kind == "bigint" and not -(2**63) <= found < 2**63 else found


def listed(payload: str, path: str) -> list:
    """The items of the list at ``path``, none if there is no such list."""
    try:
        found = json.loads(payload)
    except (TypeError, ValueError, RecursionError):
        return []
    for part in filter(None, (path or "").split(".")):
        found = found.get(part) if isinstance(found, dict) else None
    return found if isinstance(found, list) else []


class PayloadRows:
    """``payload_rows(payload, path, columns[, outer])``: a row for each item of the list at ``path`` ('a.b') of a JSON payload.

    The columns are those that the call asks for, after ``item``, its place from 0.  An item that is an object gives its fields by name, one that is a list
    by their order, any other its value as the first column; what is absent or of another kind is null.  A payload that is null, no JSON, or has
    no list there gives no rows, with ``outer`` one row of nulls, as does an empty list.
    """

    @staticmethod
    def analyze(payload: AnalyzeArgument, path: AnalyzeArgument, columns: AnalyzeArgument, outer: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(columns.value, str):
            raise ValueError("columns must be a constant such as 'price double, size double'")
        fields = [StructField(name, KINDS[kind][0]) for name, kind in wanted(columns.value)]
        return AnalyzeResult(StructType([StructField("item", IntegerType()), *fields]))

    def eval(self, payload: str, path: str, columns: str, outer: bool = False) -> Iterator[tuple]:
        pairs, items = wanted(columns), listed(payload, path)
        for at, item in enumerate(items):
            if isinstance(item, dict):
                values = [item.get(name) for name, _ in pairs]
            else:
                given = item if isinstance(item, list) else [item]
                values = [given[i] if i < len(given) else None for i in range(len(pairs))]
            yield (at, *[read_as(v, kind) for v, (_, kind) in zip(values, pairs, strict=True)])
        if outer and not items:
            yield (None,) * (len(pairs) + 1)


def fanned_out(rows: DataFrame, payload: str, path: str, columns: str, outer: bool = False) -> DataFrame:
    """``rows`` with the items of their payloads by a lateral join; with ``outer`` rows without items stay, with nulls."""
    return rows.lateralJoin(F.udtf(PayloadRows)(F.col(payload).outer(), F.lit(path), F.lit(columns), F.lit(outer)))


def registered(spark) -> None:  # noqa: ANN001
    """Make ``payload_rows`` known to SQL: ``FROM t, LATERAL payload_rows(t.payload, 'asks', 'price double, size double')``."""
    spark.udtf.register("payload_rows", F.udtf(PayloadRows))
