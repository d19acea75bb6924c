"""Mixing sources to target weights by pivotal dependent rounding.  DataFrame functions only.

Every row of a source has the same rate, target / size of the source; the whole part of the
rate is its number of copies for certain and the fraction is the probability of one more.
Two rows with fractions meet and words (probability times size) move from one to the other,
at random in the direction and by as much as makes one of the two integral; in the mean no
fraction changes and the expected words of a source never change at all.  The row that is
still fractional meets the next one.

Rows meet in a reduction tree: blocks of about ``FAN_IN`` rows of one source, drawn by a hash,
are folded from the largest row to the smallest, each leaving one fractional row, a small one
as a rule; these form the next level, until one row is left for a source.  That one is drawn by
its fraction, so every row is taken with its own probability, and the words taken from a
source differ from its target by less than that one row.  All draws are hashes of row keys:
reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, numbered, partitions, running_sums

FAN_IN = 64
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
UNIT = ("doc_id", "h", "rows", "size", "source_no", "whole", "p")


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """``source``, ``source_no``, ``source_size`` and ``target``; ``sizes`` has ``source``, ``source_size``.

    Sources in code point order, null last, take the weights in turn.  Together the targets
    are ``share`` times all sizes; none is above ``most`` times its source, and what is over is
    shared among the rest by weight.  So the targets are min(cap, x * weight) for one x; the
    capped sources come first in the order of cap / weight.
    """
    ordered = sizes.withColumn("none", F.col("source").isNull()).withColumn("at", F.coalesce("source", F.lit("")))
    base = numbered(ordered, [], ["none", "at"], "source_no", "mixing-sources").withColumn("source_no", F.col("source_no").cast("int"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    base = base.withColumn("weight", F.element_at(cycle, F.col("source_no") % len(weights) + 1)).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    base = materialise(base.select("source", "source_no", "source_size", "weight", "cap", (F.col("cap") / F.col("weight")).alias("ratio")), "mixing-caps")
    everything = base.agg(F.sum("source_size").alias("all_sizes"), F.sum("weight").alias("all_weights"))  # one row
    sums = running_sums(base, ["ratio", "source_no"], {"cap": "cap_before", "weight": "weight_before"}, "mixing-ratios").crossJoin(everything)
    # The x that fits if all sources before this one are capped and it and all after it are not.
    level = (F.lit(float(share)) * F.col("all_sizes") - F.col("cap_before")) / (F.col("all_weights") - F.col("weight_before"))
    first_open = sums.withColumn("level", level).where("ratio >= level").agg(F.min(F.struct("ratio", "source_no", "level")).alias("open"))  # one row
    return base.crossJoin(first_open).select("source", "source_no", "source_size", F.least("cap", F.coalesce(F.col("open.level") * F.col("weight"), F.col("cap"))).alias("target"))


def bind(value: Column, body) -> Column:  # noqa: ANN001
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _meet(acc: Column, x: Column) -> Column:
    """One step of a block's fold: the fractional row so far meets the next row."""
    a = acc["carry"]
    wa, wb = (u["size"] * u["rows"] for u in (a, x))
    up, down = F.least(wa * (1.0 - a["p"]), wb * x["p"]), F.least(wa * a["p"], wb * (1.0 - x["p"]))
    draw = F.pmod(F.xxhash64(a["doc_id"], a["h"], x["doc_id"], x["h"]), F.lit(1 << 53)) / F.lit(float(1 << 53))
    start = F.struct(up.alias("up"), down.alias("down"), draw.alias("draw"))

    def moved(s: Column) -> Column:
        rises = F.when(s["up"] + s["down"] > 0, s["draw"] * (s["up"] + s["down"]) < s["down"]).otherwise(a["p"] >= 0.5)
        return bind(F.struct(rises.alias("rises"), F.when(rises, s["up"]).otherwise(-s["down"]).alias("by")), settled)

    def settled(t: Column) -> Column:
        """Which of the two has become integral, and the other's new fraction."""
        a_done = F.when(t["rises"], wa * (1.0 - a["p"]) <= wb * x["p"]).otherwise(wa * a["p"] <= wb * (1.0 - x["p"]))
        more = F.when(a_done == t["rises"], 1).otherwise(0)  # a rose to 1 or fell to 0, or x did the opposite
        return bind(F.struct(a_done.alias("a_done"), more.alias("more"), t["by"].alias("by")), result)

    def result(s: Column) -> Column:
        gone = F.when(s["a_done"], _decided(a, s["more"])).otherwise(_decided(x, s["more"]))
        p = F.when(s["a_done"], x["p"] - s["by"] / wb).otherwise(a["p"] + s["by"] / wa)
        stays = F.when(s["a_done"], x).otherwise(a)
        carry = stays.withField("p", F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))
        return F.struct(F.concat(acc["done"], F.array(gone)).alias("done"), carry.alias("carry"))

    return F.when(a.isNull(), F.struct(acc["done"].alias("done"), x.alias("carry"))).otherwise(bind(start, moved))


def _decided(u: Column, more: Column) -> Column:
    return F.struct(u["doc_id"].alias("doc_id"), u["h"].alias("h"), u["rows"].alias("rows"), u["size"].alias("size"), u["source_no"].alias("source_no"), (u["whole"] + more).cast("int").alias("copies"))


def rounded(units: DataFrame) -> DataFrame:
    """Decided rows ``doc_id``, ``h``, ``rows``, ``size``, ``source_no``, ``copies`` from units with fractions."""
    spark = units.sparkSession
    unit_type = units.select(F.struct(*UNIT).alias("u")).schema["u"].dataType.simpleString()
    done_type = units.select(_decided(F.struct(*UNIT), F.lit(0)).alias("d")).schema["d"].dataType.simpleString()
    out, level, most = [], 0, 2
    while most > 1:
        counts = units.groupBy("source_no").agg(F.ceil(F.count(F.lit(1)) / FAN_IN).cast("bigint").alias("blocks"))
        most = counts.agg(F.max("blocks")).first()[0]
        if most is None:
            return spark.createDataFrame([], units.select(_decided(F.struct(*UNIT), F.lit(0)).alias("d")).select("d.*").schema)
        block = F.pmod(F.xxhash64("doc_id", "h", F.lit(level)), F.col("blocks"))
        largest_first = F.sort_array(F.collect_list(F.struct(F.col("size").alias("by"), F.struct(*UNIT).alias("u"))), asc=False)
        # Dealt out by number: by their few bytes, adaptive execution would fold all blocks in one task.
        dealt = units.join(counts, "source_no").withColumn("block", block).repartition(partitions(spark), "source_no", "block")
        blocks = dealt.groupBy("source_no", "block").agg(F.transform(largest_first, lambda s: s["u"]).alias("us"))
        start = F.struct(F.expr(f"cast(array() as array<{done_type}>)").alias("done"), F.expr(f"cast(null as {unit_type})").alias("carry"))
        folded = materialise(blocks.select(F.aggregate("us", start, _meet).alias("f")).select("f.*"), "mixing-level")
        out.append(folded.select(F.inline("done")))
        units = folded.select("carry.*")
        level += 1
    last = F.pmod(F.xxhash64("doc_id", "h", F.lit("last")), F.lit(1 << 53)) / F.lit(float(1 << 53)) < F.col("p")
    out.append(units.select(_decided(F.struct(*UNIT), F.when(last, 1).otherwise(0)).alias("d")).select("d.*"))
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Copies of every row, and the targets.

    The first frame has ``doc_id``, ``h`` (hash of the text), ``rows`` (how many rows have both
    and the same source; each has that many copies), ``size``, ``source_no`` and ``copies``, 0 to 2.  Rows without
    words have the whole part of the rate.  Null texts have size 0, null sources are one source,
    an empty table gives empty frames.
    """
    text = F.col(text_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(source_col).alias("source"), word_count(text).alias("size"))
    rows = materialise(slim.groupBy("doc_id", "h", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "mixing-rows")
    wanted = materialise(targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))), "mixing-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = rows.join(wanted.withColumn("rate", rate).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    units = joined.withColumn("whole", F.floor("rate").cast("int")).withColumn("p", F.col("rate") - F.floor("rate"))
    units = materialise(units.select(*UNIT), "mixing-units")
    certain = (F.col("p") <= 0) | (F.col("size") == 0)
    sure = units.where(certain).select("doc_id", "h", "rows", "size", "source_no", F.col("whole").alias("copies"))
    return sure.unionByName(rounded(units.where(~certain))), wanted


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    found, wanted = copies(docs, id_col, text_col, source_col)
    taken = found.where("copies > 0").join(wanted.select("source_no", F.col("source").alias("_tm_source")), "source_no")
    taken = taken.select(F.col("doc_id").alias("_tm_id"), F.col("h").alias("_tm_h"), "_tm_source", F.col("copies").alias("_tm_copies"))
    same = F.col(id_col).eqNullSafe(F.col("_tm_id")) & (F.xxhash64(F.col(text_col)) == F.col("_tm_h")) & F.col(source_col).eqNullSafe(F.col("_tm_source"))
    return docs.join(taken, same).withColumn("_tm_copy", F.explode(F.sequence(F.lit(1), F.col("_tm_copies")))).select(*docs.columns)
