"""Connected components by repeated contraction, without collecting anything to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialise


def components(edges: DataFrame, label: str) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (columns ``u``, ``v``; self-links and repeats allowed).

    ``root`` is some node of the component, the same for all its nodes.  In each round every
    node points to the neighbour (or itself) that comes first in a hashed order, and the
    edges are rewritten between the targets; a hashed order keeps chains from shrinking one
    node at a time.  A node of huge degree costs a partial aggregate and a join whose skewed
    partitions Spark splits.  No edges give no rows.
    """
    edges = materialise(edges.select("u", "v").where("u <> v").distinct(), f"{label}-edges")
    layers = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v").alias("h"), F.col("v"))).alias("best"))
        own = F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("v"))
        parents = materialise(first.select("u", F.least(own, F.col("best"))["v"].alias("p")), f"{label}-parents")
        layers.append(parents)
        ends = edges.join(parents.select("u", F.col("p").alias("pu")), "u").join(parents.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
        rest = materialise(ends.where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), f"{label}-edges")
        discard(edges)
        edges = rest
    if not layers:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = layers[0].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for layer in layers[1:]:
        onward = layer.select(F.col("u").alias("root"), "p")
        found = found.join(onward, "root", "left").select("node", F.coalesce("p", "root").alias("root"))
    return found
