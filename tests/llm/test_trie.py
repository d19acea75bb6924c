import random
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from tidemark.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, c long, d long, f long, rep long, place string, n long"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "p", 5) for r in rows], SCHEMA).repartition(3)


def expected(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = (*turns.get(c - c % 5, [])[:h], *own[h:])
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, s in whole.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                children[s[: d - 1]].add(s[:d])
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[x] for x in children[s]) or 1
        saved[s] = sum(saved[x] for x in children[s]) + ((len(members[s]) - 1) * len(s[-1][1].encode()) if s else 0)
    digest = lambda s: sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children[s]), leaves[s], saved[s], digest(s)) for s, m in members.items())


def check(spark, rows, **own):
    got = sorted(tuple(r) for r in trie.prefix_trie(trie.rebuilt(conversations(spark, rows)), **own).collect())
    assert got == expected(rows)


def some(rng, n, texts=("a", "b", "é漢", "")):
    return [(c, t, rng.choice(["user", "bot"]), rng.choice(texts)) for c in rng.sample(range(3 * n), n) for t in range(rng.randrange(1, 14))]


@pytest.mark.parametrize("own", [{}, {"prime": 7, "bases": (2, 3)}])
def test_equals_brute_force(spark, own):
    """With a small modulus most groups of candidates are collisions and must be split."""
    check(spark, some(random.Random(1), 60), **own)


def test_awkward_rows(spark):
    rows = [(0, 1, None, "x"), (0, None, "user", None), (0, 1, "user", "x"), (0, 1, "user", "x"), (None, 1, "user", "lost"), (3, None, None, None), (7, 0, "a", "b"), (5, 0, "a", "bc"), (6, 0, "ab", "c"), (8, 5, "u", "w" * 70_000), (9, 5, "u", "w" * 70_000)]
    rows += [(c, t, "user", f"copy {t}") for c in range(100, 160, 5) for t in range(3)]
    check(spark, rows)


def test_long_conversation_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        check(spark, [(c, t, "user", str(t * c % 3)) for c in (10, 11, 12) for t in range(70)])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_conversations(spark):
    assert trie.prefix_trie(trie.rebuilt(conversations(spark, []))).count() == 0
    assert trie.prefix_trie(trie.rebuilt(conversations(spark, [(None, 1, "u", "x")]))).count() == 0


def test_scan_equals_the_sums_it_stands_for():
    rng = np.random.default_rng(2)
    conv = np.sort(rng.integers(0, 9, 500))
    own = rng.integers(-(2**63), 2**63 - 1, 500)
    whole = trie.Scan().batch(conv, own)
    scan, parts = trie.Scan(), []
    for at in range(0, 500, 37):
        parts.append(scan.batch(conv[at : at + 37], own[at : at + 37]))
    assert (np.concatenate([p[0] for p in parts]) == whole[0]).all()
    for k, base in enumerate(trie.BASES):
        assert (np.concatenate([p[1][k] for p in parts]) == whole[1][k]).all()
        total, was = 0, None
        for c, d, x, now, before in zip(conv.tolist(), whole[0].tolist(), own.view(np.uint64).tolist(), whole[1][k].tolist(), whole[2][k].tolist(), strict=True):
            total = 0 if c != was else total
            assert before == total
            total = (total + (x >> 31 * k) % trie.PRIME * pow(base, d, trie.PRIME) * (d > 0)) % trie.PRIME
            assert now == total
            was = c


def test_powers():
    assert [int(trie.powers(3, 97, 300)[k]) for k in (0, 1, 5, 299)] == [pow(3, k, 97) for k in (0, 1, 5, 299)]


def test_digest_of_a_long_list_comes_from_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 10)
    ends = spark.createDataFrame([(1, 2, c) for c in range(500, 0, -1)] + [(1, 3, 9), (2, 2, 8)], "rep long, d long, c long").repartition(5)
    got = {(r.rep, r.d): r.ends_sha256 for r in trie.listed_digest(ends).collect()}
    assert got == {(1, 2): sha256(",".join(map(str, range(1, 501))).encode()).hexdigest(), (1, 3): sha256(b"9").hexdigest(), (2, 2): sha256(b"8").hexdigest()}
