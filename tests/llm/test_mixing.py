import collections
import random

import pytest

from tidemark.llm import mixing


def water(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by resharing what is over, round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        x = left / sum(w[s] for s in open_)
        over = {s for s in open_ if x * w[s] > most * sizes[s] + 1e-9}
        if not over:
            out |= {s: x * w[s] for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def collected(docs):
    found, wanted = mixing.copies(docs)
    return found.collect(), {r.source: (r.source_size, r.target, r.source_no) for r in wanted.collect()}


def test_targets_and_taken_words(frame):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice([3, 10, 40, 200, rng.randrange(1, 900)])) + f" d{i}", None if i % 17 == 0 else "hot" if i % 3 else f"s{i % 5}") for i in range(2500)]
    found, wanted = collected(frame(rows))
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    target = water(sizes)
    assert {s: (n, pytest.approx(t)) for s, (n, t, _) in wanted.items()} == {s: (sizes[s], target[s]) for s in sizes}
    by_no = {no: s for s, (_, _, no) in wanted.items()}
    taken = collections.Counter()
    for r in found:
        assert 0 <= r.copies <= 2
        taken[by_no[r.source_no]] += r.rows * r.size * r.copies
    assert sum(r.rows for r in found) == len(rows)
    largest = max(len(t.split()) for _, t, _ in rows)
    assert all(abs(taken[s] - target[s]) <= largest / 2 + 1e-6 for s in target)  # the last row is a small one
    again, _ = collected(frame(rows))
    assert sorted((r.doc_id, r.copies) for r in found) == sorted((r.doc_id, r.copies) for r in again)


def test_chances_are_kept_in_the_mean(spark):
    """Each of 64 rows of unlike sizes has its own fraction, over many independent blocks."""
    trials, units = 400, []
    for trial in range(trials):
        units += [(trial * 100 + i, trial * 7919 + i, 1, 1 + i % 9 * 30, trial, 0, 0.1 + 0.8 * (i % 8) / 7) for i in range(64)]
    df = spark.createDataFrame(units, "doc_id long, h long, rows long, size long, source_no int, whole int, p double")
    got = collections.Counter()
    for r in mixing.rounded(df).collect():
        got[r.doc_id % 100] += r.copies
    for i in range(64):
        p = 0.1 + 0.8 * (i % 8) / 7
        assert abs(got[i] / trials - p) < 4.5 * (p * (1 - p) / trials) ** 0.5 + 0.02


def test_awkward_and_empty(frame, awkward):
    found, _ = collected(frame(awkward))
    assert sum(r.rows for r in found) == len(awkward)
    assert all(r.copies * r.size <= 2 * r.size for r in found)
    assert collected(frame([]))[0] == []
    docs = frame(awkward)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    want = collections.Counter()
    for r in found:
        want[r.doc_id] += r.rows * r.copies
    assert collections.Counter(r.doc_id for r in mixed.collect()) == +want


def test_no_python_in_the_plan(frame):
    found, _ = mixing.copies(frame([(i, "a b c", "s") for i in range(50)]))
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_the_only_row_of_a_source_is_drawn(spark):
    units = [(i, i * 31, 1, 10, i, 0, 0.3) for i in range(4000)]
    df = spark.createDataFrame(units, "doc_id long, h long, rows long, size long, source_no int, whole int, p double")
    taken = sum(r.copies for r in mixing.rounded(df).collect())
    assert abs(taken / 4000 - 0.3) < 4.5 * (0.3 * 0.7 / 4000) ** 0.5


def test_many_sources_have_the_targets_of_the_rounds(spark):
    rng = random.Random(9)
    sizes = {f"s{i:04}é"[: 2 + i % 5] + str(i): rng.choice([0, 1, 5, 100, 10_000]) for i in range(500)} | {None: 70}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = water(sizes)
    assert got == {s: pytest.approx(t) for s, t in want.items()}
