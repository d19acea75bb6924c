"""Quality classification by importance resampling over hashed n-grams.

Two generative models, each a distribution over hashed word n-grams (one and two words): one
of the raw texts, one of the target texts.  The target model is the raw one times the ratio of
counted to expected occurrences in the target texts, both with ``PRIOR`` more, so that a
bucket that target rows have hardly shown says little.  A text's log weight is the log of the
importance ratio, its probability under the target model over that under the raw one.
Sampling is Gumbel top-k: the k rows with the largest log weight plus Gumbel noise are a
sample without replacement in proportion to the weights.

Counts cover all rows: they are summed per partition and then per hash bucket.  The tables on
the driver have ``BUCKETS`` entries whatever the size of the input.  At most ``LABELS`` labelled
rows are used, those with the smallest hash of the id; they are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, numbered

BUCKETS = 1 << 16
SLICE = 1 << 18
LABELS = 50_000
PRIOR = 20
BINS = 4096  # of the histogram in which the threshold is sought
GATHER = 1 << 22  # n-grams that are counted or looked up at a time


def ngram_buckets(text: bytes | None, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Hash buckets of a text's words and word pairs, A-Z lower-cased, a slice of the words at a time."""
    words = (text or b"").lower().split()
    for at in range(0, len(words), SLICE):
        h = np.fromiter(map(crc32, words[at : at + SLICE + 1]), dtype=np.uint64)
        own = h[: min(SLICE, len(words) - at)]
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        spread = (own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        yield np.concatenate([spread % np.uint64(buckets), (pair >> np.uint64(20)) % np.uint64(buckets)]).astype(np.int64)


def label_sample(labels: DataFrame, most: int = LABELS) -> DataFrame:
    """At most ``most`` rows ``doc_id``, ``target``, ``fit``, written once: one for each id, the ids drawn by a hash.  Nulls are left out.

    Three of four are for fitting; the rest find the threshold, as a text's own n-grams in the
    target model would flatter it.
    """
    known = labels.where("doc_id IS NOT NULL AND target IS NOT NULL").groupBy("doc_id").agg(F.max("target").alias("target"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return F.broadcast(materialise(drawn.withColumn("fit", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) > 0), "quality-labels"))


def gathered(texts: Iterable[bytes | None], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash buckets of several texts' n-grams and the number of the text of each, about ``GATHER`` at a time."""
    found, number, size = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], 0
    for i, text in enumerate(texts):
        for part in ngram_buckets(text, buckets):
            found.append(part)
            number.append(np.full(len(part), i))
            size += len(part)
            if size >= GATHER:
                yield np.concatenate(found), np.concatenate(number)
                found, number, size = found[:1], number[:1], 0
    yield np.concatenate(found), np.concatenate(number)


def bucket_counts(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts of the target and of all rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).join(labels.where("fit").select("doc_id", "target"), "doc_id", "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * buckets, dtype=np.int64)  # target, other
        for batch in batches:
            other = np.array([not x for x in batch.column(1).to_pylist()], dtype=np.int64) * buckets
            for found, number in gathered((x.as_py() for x in batch.column(0)), buckets):
                counts += np.bincount(found + other[number], minlength=2 * buckets)
        kind, bucket = np.nonzero(counts.reshape(2, buckets))
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[counts > 0])], names=["kind", "bucket", "n"])

    summed = rows.select("text", "target").mapInArrow(run, "kind int, bucket int, n bigint").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
    table = np.zeros((2, buckets), dtype=np.int64)
    for kind, bucket, n in summed.collect():  # at most 2 * buckets rows
        table[kind, bucket] = n
    return table[0], table.sum(axis=0)


def log_ratio(good: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Per bucket the log of its probability under the target model over that under the raw one; zeros without target n-grams."""
    if not good.any():
        return np.zeros(len(good))
    share = raw / raw.sum()
    ratio = (good + PRIOR) / (good.sum() * share + PRIOR)
    return np.log(ratio) - np.log((share * ratio).sum())  # the target model sums to one


def log_weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``doc_id``, ``n_ngrams`` and ``log_weight`` (0 for a text without words, null and empty ones included).

    ``labels`` comes from ``label_sample``.  Without target rows all weights are 0.
    """
    ratio = log_ratio(*bucket_counts(docs, id_col, text_col, labels, buckets))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows)
            for found, number in gathered((x.as_py() for x in batch.column(1)), buckets):
                n += np.bincount(number, minlength=batch.num_rows)
                total += np.bincount(number, weights=shared.value[found], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total)], names=["doc_id", "n_ngrams", "log_weight"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_ngrams bigint, log_weight double")


def threshold(scored: DataFrame, labels: DataFrame, target_cost: int = 4, resolution: float = 0.125) -> float:
    """The log weight that parts the labelled rows not fitted to at the least cost; of several the lowest.

    A target row below it costs ``target_cost`` times as much as another row above it: what is
    lost here is lost for good.  It is sought between the least and the largest weight of
    these rows, in ``BINS`` steps, and again around the best of them until a step is fine enough.
    Minus infinity if there are no such rows or if none of them is to go.
    """
    held = materialise(scored.join(labels.where("NOT fit"), "doc_id").select("target", "log_weight"), "quality-held-out")  # at most the label sample, times repeated ids
    low, high = held.agg(F.min("log_weight"), F.max("log_weight")).first()
    if low is None:
        return float("-inf")
    while True:
        step = max((high - low) / BINS, resolution / 2)
        place = F.least(F.greatest(F.floor((F.col("log_weight") - low) / step) + 1, F.lit(0)), F.lit(BINS + 1)).cast("int")
        counts = np.zeros((2, BINS + 2), dtype=np.int64)  # of others and targets: below all steps, in each, above
        for target, at, n in held.groupBy("target", place.alias("at")).agg(F.count(F.lit(1))).collect():  # at most 2 * (BINS + 2) rows
            counts[int(target), at] = n
        below = np.c_[np.zeros(2, dtype=np.int64), counts.cumsum(axis=1)]  # of nothing, of what is below the first step, ...
        errors = target_cost * below[1] + counts[0].sum() - below[0]
        best = int(errors.argmin())
        if best == 0:
            return float("-inf")
        if step <= resolution:
            return low + (best - 1) * step
        low, high = low + (best - 2) * step, low + best * step


def resample(scored: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Adds ``key`` and ``selected``: Gumbel top-k of the rows in proportion to their weights.

    The noise is a hash of the id, so reruns agree; rows that repeat an id (or have none) get
    the same noise, and of rows that tie those written first are taken.
    """
    draw = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = scored.withColumn("key", F.col("log_weight") - F.log(-F.log(draw))).withColumn("below", -F.col("key"))
    ranked = numbered(materialise(keyed, "quality-keys"), [], ["below", "doc_id"], "rank", "quality-ranks")
    return ranked.withColumn("selected", F.col("rank") < k).drop("below", "rank")


def classify(docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_ngrams``, ``log_weight``, ``key`` and ``selected`` of every row.

    ``labels`` has ``doc_id`` and ``target``.  ``k`` rows are sampled; by default as many as have
    a log weight above the threshold that parts the labelled rows best.  Null and empty texts
    have log weight 0; without labels, and with k of at least the rows, all rows are selected;
    no rows give none.  Rows that repeat are rows of their own.
    """
    sample = label_sample(labels)
    scored = materialise(log_weights(docs, sample, id_col, text_col), "quality-scores")
    if k is None:
        k = scored.where(F.col("log_weight") >= threshold(scored, sample)).count()
    return resample(scored, k)


def keep_selected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are selected; of rows that share an id all, if one is."""
    selected = classify(docs, labels, id_col=id_col, text_col=text_col).where("selected").select(F.col("doc_id").alias("_tm_id")).distinct()
    return docs.join(selected, F.col(id_col).eqNullSafe(F.col("_tm_id")), "left_semi")
