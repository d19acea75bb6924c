import random

import numpy as np

from tidemark.llm import quality


def test_clean_and_junk_are_parted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").selectExpr("doc_id", "quality = 1 AS target")
    even = labels.where("doc_id % 2 = 0")  # learn from a half, judge by the other
    got = {r.doc_id: r.selected for r in quality.classify(docs, even).collect()}
    judged = [(got[r.doc_id], r.target) for r in labels.where("doc_id % 2 = 1").collect()]
    assert np.mean([s for s, t in judged if t]) >= 0.97
    assert np.mean([not s for s, t in judged if not t]) >= 0.9


def counts(texts):
    out = np.zeros(quality.BUCKETS)
    for t in texts:
        for found in quality.ngram_buckets(t):
            out += np.bincount(found, minlength=quality.BUCKETS)
    return out


def test_weights_equal_brute_force(spark, frame, awkward):
    rows = [r[:2] for r in awkward]
    labels = spark.createDataFrame([(1, True), (9, True), (6, False), (4, None), (99, True), (2, True), (7, True)], "doc_id long, target boolean")
    got = quality.log_weights(frame(awkward), quality.label_sample(labels)).collect()
    raw_of = [(t or "").encode() for _, t in rows]
    fitted = {r.doc_id for r in quality.label_sample(labels).where("fit AND target").collect()}
    good = counts([t for (i, _), t in zip(rows, raw_of, strict=True) if i in fitted])
    raw = counts(raw_of)
    p_raw = raw / raw.sum()
    p_good = p_raw * (good + quality.PRIOR) / (good.sum() * p_raw + quality.PRIOR)
    p_good /= p_good.sum()
    ratio = np.where(raw > 0, np.log(np.where(raw > 0, p_good, 1)) - np.log(np.where(raw > 0, p_raw, 1)), 0)
    want = []
    for (i, _), t in zip(rows, raw_of, strict=True):
        found = np.concatenate([np.zeros(0, dtype=int), *quality.ngram_buckets(t)])
        want.append((i, len(found), round(float(ratio[found].sum()), 6)))
    assert sorted(((r.doc_id, r.n_ngrams, round(r.log_weight, 6)) for r in got), key=str) == sorted(want, key=str)


def test_slices_give_the_same_ngrams(monkeypatch):
    text = " ".join(f"w{i}" for i in range(100)).encode()
    whole = sorted(np.concatenate(list(quality.ngram_buckets(text))))
    monkeypatch.setattr(quality, "SLICE", 7)
    assert sorted(np.concatenate(list(quality.ngram_buckets(text)))) == whole


def test_top_k_takes_k_in_proportion(spark):
    n = 4000
    weights = spark.range(n).selectExpr("id AS doc_id", "1L AS n_ngrams", "IF(id % 2 = 0, ln(4.0D), 0.0D) AS log_weight")
    got = quality.resample(weights, 200).collect()
    taken = [r.doc_id % 2 for r in got if r.selected]
    assert len(taken) == 200
    assert 0.7 < taken.count(0) / 200 < 0.9  # four to one


def test_no_labels_no_rows(spark, frame, awkward):
    labels = spark.createDataFrame([], "doc_id long, target boolean")
    assert quality.classify(frame(awkward), labels).where("NOT selected").count() == 0
    assert quality.classify(frame([]), labels).count() == 0
    assert quality.keep_selected(frame(awkward), labels).columns == frame(awkward).columns


def test_the_noise_decides_near_the_edge_and_k_is_given(spark):
    n = 3000
    weights = spark.range(n).selectExpr("id AS doc_id", "1L AS n_ngrams", "id / 100.0D AS log_weight")  # 0 to 30
    first, again = ({r.doc_id for r in quality.resample(weights, 1500, seed).where("selected").collect()} for seed in (1, 2))
    assert len(first) == len(again) == 1500
    swapped = first - again
    assert swapped and all(i < 2500 for i in swapped)  # far above the edge nothing depends on the draw
    assert {i for i in range(2600, n)} <= first & again


def test_k_is_a_parameter(spark, frame):
    docs = frame([(i, "good words here" if i % 2 else "bad junk there") for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2 == 1) for i in range(20)], "doc_id long, target boolean")
    for k in (0, 7, 40):
        assert quality.classify(docs, labels, k=k).where("selected").count() == k


def test_texts_are_gathered_in_parts(monkeypatch):
    texts = [b"a b c d e f g", None, b"", b"h i j"]
    whole = [np.concatenate(x) for x in zip(*quality.gathered(texts, 64), strict=True)]
    monkeypatch.setattr(quality, "GATHER", 2)
    parts = [np.concatenate(x) for x in zip(*quality.gathered(texts, 64), strict=True)]
    assert [x.tolist() for x in whole] == [x.tolist() for x in parts]


def test_threshold_lies_anywhere(spark):
    """Long texts have weights far from zero: brute force over all places, at the stated resolution."""
    rng = random.Random(4)
    for shift, scale in ((0, 5), (-90_000, 4000), (50_000, 30)):
        rows = [(i, shift + scale * (rng.gauss(2, 1) if i % 3 else rng.gauss(-2, 1)), bool(i % 3)) for i in range(400)]
        scored = spark.createDataFrame([r[:2] for r in rows], "doc_id long, log_weight double")
        labels = spark.createDataFrame([(r[0], r[2], False) for r in rows], "doc_id long, target boolean, fit boolean")
        cost = lambda at: sum(4 if target else 0 for _, w, target in rows if w < at) + sum(not target for _, w, target in rows if w >= at)  # noqa: E731, B023
        found = quality.threshold(scored, labels)
        assert cost(found) <= min(cost(w + 0.07) for _, w, _ in rows) + 1
    assert quality.threshold(scored, labels.where("doc_id < 0")) == float("-inf")
    assert quality.threshold(scored, labels.where("target")) == float("-inf")
