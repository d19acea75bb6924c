"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of bytes.  The distinct blocks are sorted and
numbered: equal blocks get one integer name.  Then neighbouring names are paired, distinct
pairs are sorted and numbered, and so on until one name is left.  Texts with the same number
of blocks and the same last name are equal and no others are.

Blocks travel once, with their digest, in an aggregate that proves that no two different
blocks have one digest; everything after that works on digests and integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, partitions

BLOCK_BYTES = 1024
SHA256 = "unhex(sha2({block}, 256))"


def named(keys: DataFrame, label: str) -> DataFrame:
    """Distinct rows of ``keys`` with an integer ``name`` each, in their sorted order."""
    spread = keys.distinct().repartitionByRange(partitions(keys.sparkSession), *keys.columns).sortWithinPartitions(*keys.columns)
    return materialise(spread.withColumn("name", F.monotonically_increasing_id()), label)


def _blocks(block_bytes: int, of_block: str) -> str:
    at = f"substring(raw, i * {block_bytes} + 1, {block_bytes})"
    return f"transform(sequence(0, greatest(cast(ceil(length(raw) / {block_bytes}) as int), 1) - 1), i -> {of_block.format(block=at)})"


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, digest: str = SHA256) -> DataFrame:
    """``doc_id``, ``rid`` (a number for each row), ``text_sha256``, ``n_blocks`` and ``name``.

    Two rows have equal texts exactly if they agree in ``n_blocks`` and ``name``.  Null counts
    as the empty text, which is one empty block.  Raises ValueError if two different blocks
    have one digest.
    """
    raw = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("raw"))
    rows = materialise(
        raw.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2("raw", 256).alias("text_sha256"), F.expr(_blocks(block_bytes, digest)).alias("digests")).withColumn("n_blocks", F.size("digests")),
        "naming-rows",
    )
    contents = raw.select(F.explode(F.expr(_blocks(block_bytes, "{block}"))).alias("block")).select(F.expr(digest.format(block="block")).alias("digest"), "block").distinct()
    blocks = materialise(contents.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")), "naming-blocks")
    if not blocks.where("texts > 1").isEmpty():
        raise ValueError("two different blocks have one digest; give a longer digest")

    names = named(blocks.select("digest"), "naming-0")
    level = rows.select("rid", "n_blocks", F.posexplode("digests").alias("pos", "digest")).join(names, "digest").select("rid", "n_blocks", "pos", "name")
    most = rows.agg(F.max("n_blocks")).first()[0] or 1
    done, span = [], 1
    while span < most:
        level = materialise(level, "naming-level")
        done.append(level.where(F.col("n_blocks") <= span))
        paired = (
            level.where(F.col("n_blocks") > span)
            .groupBy("rid", "n_blocks", F.expr("pos div 2").cast("int").alias("pos"))
            .agg(F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("a"), F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(-1)).alias("b"))
        )
        pairs = materialise(paired, "naming-paired")
        level = pairs.join(named(pairs.select("a", "b"), "naming-pairs"), ["a", "b"]).select("rid", "n_blocks", "pos", "name")
        span *= 2
    for part in done:
        level = level.unionByName(part)
    return rows.select("rid", "doc_id", "text_sha256").join(level.select("rid", "n_blocks", "name"), "rid")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the row with the largest id stays; of rows that repeat both id and text,
    one of them.  A null id comes last.
    """
    named_rows = materialise(identities(docs, id_col, text_col, block_bytes), "naming-identities")
    # Written, so that the join below has exchanges of its own, which Spark splits where a group is large.
    best = materialise(named_rows.groupBy("n_blocks", "name").agg(F.max(F.struct("doc_id", "rid")).alias("best"), F.count(F.lit(1)).alias("group_size")), "naming-best")
    return named_rows.join(best, ["n_blocks", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when of equal texts only the one with the largest id is kept."""
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_tm_id"), F.col("text_sha256").alias("_tm_sha"))
    digest = F.sha2(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")), 256)
    rows = docs.withColumn("_tm_digest", digest)
    matched = rows.join(kept, rows[id_col].eqNullSafe(F.col("_tm_id")) & (F.col("_tm_digest") == F.col("_tm_sha")))
    again = Window.partitionBy("_tm_id", "_tm_sha").orderBy("_tm_sha")
    return matched.withColumn("_tm_n", F.row_number().over(again)).where("_tm_n = 1").select(*docs.columns)
