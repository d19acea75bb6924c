"""JSON and parallel arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_list(text: Column) -> Column:
    """JSON text as an array of strings; [] if it is none."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def json_list_or_self(text: Column) -> Column:
    """JSON text as an array of strings; [text] if it is none."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array(text))


def settled_name(names: Column, prices: Column) -> Column:
    """The first name whose price is 1; null if the arrays differ in length or none is."""
    zipped = F.filter(F.arrays_zip(names.alias("n"), prices.alias("p")), lambda z: F.abs(z["p"].try_cast("double") - 1.0) < 1e-9)
    return F.when(F.size(names) == F.size(prices), F.get(zipped, F.lit(0))["n"])


def first_index(names: Column, test) -> Column:  # noqa: ANN001
    """Index of the first name that passes; null if none does."""
    hits = F.filter(F.transform(names, lambda x, i: F.struct(i.alias("i"), test(x).alias("hit"))), lambda s: s["hit"])
    return F.get(hits, F.lit(0))["i"]
