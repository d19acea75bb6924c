import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ppm


def trained(rows, held, order):
    counts = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    words = collections.Counter()
    for i, t in rows:
        if held(i):
            continue
        b = b"\xfe" * order + (t or "").encode() + b"\xff"
        for p in range(order, len(b)):
            for k in range(order + 1):
                counts[k][b[p - k : p]][b[p]] += 1
        words.update((t or "").encode().lower().split())
        words["<end>"] += 1
    return counts, words


def byte_score(counts, text, order):
    b, total = b"\xfe" * order + (text or "").encode() + b"\xff", 0.0
    for p in range(order, len(b)):
        out, chance = set(), 1.0
        for k in range(order, -1, -1):
            left = {c: n for c, n in counts[k].get(b[p - k : p], {}).items() if c not in out}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if b[p] in left:
                chance *= left[b[p]] / whole
                break
            chance *= len(left) / whole
            out |= set(left)
        else:
            chance /= 256 - len(out)
        total += math.log10(chance)
    return total


def base_score(words, text):
    n, v = sum(words.values()), len(words)
    tokens = [*(text or "").encode().lower().split(), "<end>"]
    return len(tokens), sum(words[t] > 0 for t in tokens), n, sum(math.log10((words[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def column():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def check(docs, rows, order, chunk_bytes=32_000_000):
    counts, words = trained(rows, held_out, order)
    got = collections.defaultdict(list)
    for r in ppm.score(docs, column(), order=order, chunk_bytes=chunk_bytes).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, t in rows:
        n, known, total, base = base_score(words, t)
        want = byte_score(counts, t, order)
        assert any((r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, held_out(i)) and r.base_score == pytest.approx(base) and r.score == pytest.approx(want) for r in got[i])


def test_sixty_documents_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")  # the brute force is slow
    check(docs, [(r.doc_id, r.text) for r in docs.collect()], 2, chunk_bytes=20_000)


@pytest.mark.parametrize("order", [1, 4])
def test_awkward_rows(frame, awkward, order):
    rows = [(i, t if t is None or len(t) < 6000 else t[:3000]) for i, t in (r[:2] for r in awkward)]
    check(frame(rows), rows, order, chunk_bytes=500)


def test_a_long_text_uncut_at_the_production_order(frame):
    words = " ".join(f"word{i % 977} é{i % 13}" for i in range(3000))
    rows = [(1, words), (2, words[:900]), (4, "word1 word2 word9"), (7, words + " and a tail that is new: 漢字")]
    assert len(words) > 30_000
    check(frame(rows), rows, ppm.ORDER, chunk_bytes=40_000)


def test_nothing_to_learn_from(frame):
    assert ppm.score(frame([]), column()).count() == 0
    r = ppm.score(frame([(1, "ab")]), F.lit(True), order=2).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (2, 0, 0, pytest.approx(0.0))
    assert r.score == pytest.approx(3 * math.log10(1 / 256))


def test_probabilities_after_a_context_sum_to_one(spark):
    rows = [(ppm.grams(b"abracadabra", 2).tolist(), 1)]
    top = collections.Counter(rows[0][0])
    contexts = {g >> 8 for g in top}
    every = {c << 8 | b: 0 for c in contexts for b in range(256)} | dict(top)
    lp = ppm.model(spark.createDataFrame(list(every.items()), "gram long, n long"), 2).collect()
    total = collections.Counter()
    for r in lp:
        total[r.gram >> 8] += 10**r.lp
    assert all(v == pytest.approx(1.0) for v in total.values())


@pytest.mark.parametrize("order", [1, 4, 6, 7])
def test_sums_of_many_texts_at_once(monkeypatch, order):
    texts = [b"abracadabra", None, b"", b"ab" * 50, "é漢字".encode(), b"x" * 300]
    keys = np.unique(np.concatenate([ppm.grams(t, order) for t in texts]))
    values = np.random.default_rng(2).random(len(keys))
    want = [float(values[np.searchsorted(keys, ppm.grams(t, order))].sum()) for t in texts]
    for size in (4_000_000, 120, 5):
        monkeypatch.setattr(ppm, "LOOKUP_BYTES", size)
        assert ppm.gram_sums(texts, order, keys, values) == [pytest.approx(x) for x in want]
    assert ppm.gram_sums([], order, keys, values) == []
