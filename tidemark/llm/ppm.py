"""Language-model scoring by prediction by partial matching over bytes.

The trie of byte contexts up to ``ORDER`` bytes is held as tables: counts of grams (a context
and the byte after it) for each order.  A byte that has not followed a context is predicted
by the next shorter one after an escape (method C: as many escapes as different bytes have
followed).  With symbol exclusion, what has followed the longer context is left out of the
shorter one's counts.  As every byte that has followed a context has also followed its
suffix, the excluded bytes of an order are those of the next longer context alone, and each
gram's probability follows from its own row and that of its suffix: order by order, as joins.

The model is trained beforehand and fixed while texts are scored.  A text's contexts start
with a byte that UTF-8 does not use and it ends with another, which is predicted too.

Nothing that grows with the corpus is broadcast or collected.  Texts are written once in
chunks of about ``CHUNK_BYTES``; each chunk receives the entries of its own grams and words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, partitions, scratch

ORDER = 4
CHUNK_BYTES = 32_000_000
SLICE_BYTES = 4_000_000  # grams that are counted at a time
LOOKUP_BYTES = 400_000  # grams that are looked up at a time
START, END = b"\xfe", b"\xff"
END_TOKEN = b"\n"  # no word holds it


def tokens(text: bytes | None) -> list[bytes]:
    """Words, A-Z lower-cased, and one end."""
    return [*(text or b"").lower().split(), END_TOKEN]


def grams(text: bytes | None, order: int) -> np.ndarray:
    """For each byte of the text and the end: the ``order`` bytes before it and itself as one integer."""
    raw = np.frombuffer(START * order + (text or b"") + END, dtype=np.uint8).astype(np.int64)
    n = len(raw) - order
    code = raw[:n].copy()
    for k in range(1, order + 1):
        code = code << 8 | raw[k : k + n]
    return code


def gram_sums(texts: Iterable[bytes | None], order: int, keys: np.ndarray, values: np.ndarray) -> list[float]:
    """For each text the sum of the values of its grams; ``keys`` (sorted) has them all.

    Codes of many texts are sorted together with the number of their text beside them, so each
    distinct gram of a slice is looked up once.
    """
    bits = max(0, 62 - 8 * (order + 1))
    out: list[float] = []
    held: list[np.ndarray] = []

    def summed() -> list[float]:
        if len(held) == 1:  # a long text, or no room for a number
            return [float(values[np.searchsorted(keys, held[0])].sum())]
        number = np.repeat(np.arange(len(held)), [len(x) for x in held])
        both = np.sort(np.concatenate(held) << bits | number)
        code = both >> bits
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        each = np.repeat(values[np.searchsorted(keys, code[starts])], np.diff(np.r_[starts, len(code)]))
        return np.bincount(both & ((1 << bits) - 1), weights=each, minlength=len(held)).tolist()

    size = 0
    for text in texts:
        own = grams(text, order)
        if held and (size + len(own) > LOOKUP_BYTES or len(held) >= 1 << bits):
            out += summed()
            held, size = [], 0
        held.append(own)
        size += len(own)
    return out + summed() if held else out


class GramCounts:
    """Distinct grams and their counts, gathered a slice at a time."""

    def __init__(self) -> None:
        self.keys, self.n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, codes: np.ndarray) -> None:
        self.waiting.append(codes)
        self.size += len(codes)
        if self.size >= SLICE_BYTES:
            self.gather()

    def gather(self) -> None:
        own, n = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *self.waiting]), return_counts=True)
        self.keys, at = np.unique(np.r_[self.keys, own], return_inverse=True)
        self.n = np.bincount(at, weights=np.r_[self.n, n], minlength=len(self.keys)).astype(np.int64)
        self.waiting, self.size = [], 0


def in_chunks(docs: DataFrame, id_col: str, text_col: str, held_out, chunk_bytes: int) -> DataFrame:  # noqa: ANN001
    """``doc_id``, ``text`` (binary), ``held_out`` and ``chunk``, written.  A longer text is a chunk of its own."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), held_out.alias("held_out"), F.spark_partition_id().cast("bigint").alias("chunk"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = total = 0
        for batch in batches:
            chunks = []
            for size, part in zip((len(x.as_py() or b"") for x in batch.column(1)), batch.column(3).to_pylist(), strict=True):
                if total and total + size > chunk_bytes:
                    full, total = full + 1, 0
                total += size + 1
                chunks.append(part << 32 | full)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(chunks, pa.int64())], names=["doc_id", "text", "held_out", "chunk"])

    return materialise(rows.mapInArrow(run, rows.schema), "ppm-chunks")


def chunk_counts(chunks: DataFrame, order: int) -> DataFrame:
    """``chunk``, ``word`` or ``gram``, ``n``: what occurs in each chunk, with its count in training texts (also 0)."""

    def counted(chunk: int, texts: list[tuple[bytes | None, bool]]) -> Iterator[pa.RecordBatch]:
        train, other = Counter(), set()
        codes = {False: GramCounts(), True: GramCounts()}
        for text, held_out in texts:
            if held_out:
                other.update(tokens(text))
            else:
                train.update(tokens(text))
            codes[held_out].add(grams(text, order))
        words = [*train, *(other - train.keys())]
        n = np.r_[np.fromiter(train.values(), dtype=np.int64, count=len(train)), np.zeros(len(words) - len(train), dtype=np.int64)]
        for part in codes.values():
            part.gather()
        own = codes[False].keys
        rest = np.setdiff1d(codes[True].keys, own, assume_unique=True)
        gram, many = np.r_[own, rest], np.r_[codes[False].n, np.zeros(len(rest), dtype=np.int64)]
        for start in range(0, len(words), 50_000):
            some = words[start : start + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), chunk)), pa.array(some, pa.binary()), pa.nulls(len(some), pa.int64()), pa.array(n[start : start + 50_000])], names=["chunk", "word", "gram", "n"]
            )
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), chunk)), pa.nulls(len(gram), pa.binary()), pa.array(gram), pa.array(many)], names=["chunk", "word", "gram", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for chunk, text, held_out in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if chunk != at:
                    if held:
                        yield from counted(at, held)
                    held, at = [], chunk
                held.append((text.as_py(), held_out))
        if held:
            yield from counted(at, held)

    return chunks.select("chunk", "text", "held_out").mapInArrow(run, "chunk bigint, word binary, gram bigint, n bigint")


def model(top: DataFrame, order: int) -> DataFrame:
    """``gram`` and ``lp``, its log10 probability, from ``gram``, ``n`` (one row each; n may be 0)."""
    levels = [top.select(F.col("gram").alias("key"), "n")]
    for k in range(order, 0, -1):
        shorter = levels[0].groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("key")).agg(F.sum("n").alias("n"))
        levels.insert(0, materialise(shorter, "ppm-counts"))

    seen = F.col("n") > 0
    base = levels[0].withColumn("ctx", F.lit(0).cast("bigint"))
    below = None
    for k, level in enumerate(levels):
        if k == 0:
            rows = base.select("key", "n", "ctx", F.lit(0).cast("bigint").alias("n1"), F.lit(0).cast("bigint").alias("t1"), F.lit(256).cast("bigint").alias("d1"), F.lit(None).cast("double").alias("b1"), F.lit(1 / 256).alias("f1"))
        else:
            suffix = F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1))
            rows = level.withColumn("s", suffix).join(below, "s").select("key", "n", F.shiftrightunsigned("key", 8).alias("ctx"), "n1", "t1", "d1", "b1", "f1")
        contexts = rows.groupBy("ctx").agg(F.sum("n").alias("t"), F.count_if(seen).alias("d"), F.sum(F.when(seen, F.col("n1")).otherwise(0)).alias("x"))
        rows = rows.join(contexts, "ctx")
        if k == 0:
            after_escape = 1.0 / F.greatest(F.lit(256) - F.col("d"), F.lit(1))
        else:
            left = F.col("t1") - F.col("x") + F.col("d1") - F.col("d")  # counts and escapes of the shorter context that are not excluded
            escape = F.when(F.col("d1") > F.col("d"), (F.col("d1") - F.col("d")) / left).otherwise(1.0)
            after_escape = F.when(F.col("n1") > 0, F.col("n1") / F.greatest(left, F.lit(1))).otherwise(escape * F.col("b1"))
        total = (F.col("t") + F.col("d")).cast("double")
        rows = rows.withColumn("b", after_escape).withColumn("f", F.when(F.col("t") == 0, F.col("f1")).when(seen, F.col("n") / F.greatest(total, F.lit(1.0))).otherwise(F.col("d") / F.greatest(total, F.lit(1.0)) * F.col("b")))
        below = rows.select(F.col("key").alias("s"), F.col("n").alias("n1"), F.col("t").alias("t1"), F.col("d").alias("d1"), F.col("b").alias("b1"), F.col("f").alias("f1"))
        if k < order:
            below = materialise(below, "ppm-level")
    return below.select(F.col("s").alias("gram"), F.log10("f1").alias("lp"))


def score(docs: DataFrame, held_out, order: int = ORDER, smoothing: float = 0.1, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:  # noqa: ANN001
    """Scores of every row under models trained on the rows for which ``held_out`` (a Column) is false.

    Returns ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``
    and ``score``.  ``score`` is the log10 probability of the whole text and its end under the
    byte model.  ``base_score`` is that of its words and end under smoothed word counts.  Null
    counts as the empty text; without training rows all bytes and words are equally likely.
    Rows that repeat, or have no id, are scored and learnt from as rows of their own; an empty
    table gives no rows.
    """
    chunks = in_chunks(docs, id_col, text_col, held_out, chunk_bytes)
    counts = materialise(chunk_counts(chunks, order), "ppm-chunk-counts")
    words = counts.where("word IS NOT NULL")
    vocabulary = materialise(words.groupBy("word").agg(F.sum("n").alias("c")), "ppm-vocabulary")
    known, total = vocabulary.agg(F.count_if(F.col("c") > 0), F.coalesce(F.sum("c"), F.lit(0))).first()
    whole = total + smoothing * (known + 1)
    coded = counts.where("gram IS NOT NULL")
    with scratch() as keep:  # the tables of the shorter contexts go
        top = materialise(coded.groupBy("gram").agg(F.sum("n").alias("n")), "ppm-grams")
        table = keep(materialise(model(top, order), "ppm-model"))
    lookups = words.select("chunk", "word").join(vocabulary, "word").select("chunk", "word", F.lit(None).cast("bigint").alias("gram"), F.col("c").cast("double").alias("value"))
    lookups = lookups.unionByName(coded.select("chunk", "gram").join(table, "gram").select("chunk", F.lit(None).cast("binary").alias("word"), "gram", F.col("lp").alias("value")))

    def scored(texts: pa.Table, entries: pa.Table) -> pa.Table:
        is_word = entries.column("word").is_valid()
        of_words = entries.filter(is_word)
        logs = np.log10((of_words.column("value").to_numpy() + smoothing) / whole)
        log_c = dict(zip(of_words.column("word").to_pylist(), logs.tolist(), strict=True))
        unknown = float(np.log10(np.float64(smoothing) / whole))  # of a word with no count; all others have more
        del of_words, logs
        of_grams = entries.filter(entries.column("gram").is_valid())
        keys, values = of_grams.column("gram").to_numpy(), of_grams.column("value").to_numpy()
        by_gram = np.argsort(keys)
        keys, values = keys[by_gram], values[by_gram]
        byte_score = gram_sums((text.as_py() for text in texts.column("text")), order, keys, values)
        n_tokens, n_known, base = [], [], []
        for text in texts.column("text"):
            raw = text.as_py()
            own = tokens(raw)
            n_tokens.append(len(own))
            each = list(map(log_c.__getitem__, own))
            n_known.append(len(own) - each.count(unknown))
            base.append(math.fsum(each))
        n = len(n_tokens)
        return pa.Table.from_arrays(
            [texts.column("doc_id"), texts.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array([total] * n, pa.int64()), pa.array(base, pa.float64()), pa.array(byte_score, pa.float64())],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    parts = max(partitions(chunks.sparkSession), 2 * chunks.agg(F.count_distinct("chunk")).first()[0])  # a task gets few chunks, however many there are
    texts, entries = (x.repartition(parts, "chunk").groupBy("chunk") for x in (chunks, lookups))
    return texts.cogroup(entries).applyInArrow(lambda texts, entries: scored(texts, entries), schema)
