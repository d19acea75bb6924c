import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash
from tidemark.llm.graph import components


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


def partition(pairs):
    groups = {}
    for node, root in pairs:
        groups.setdefault(root, set()).add(node)
    return {frozenset(g) for g in groups.values()}


def test_components_of_chain_star_and_random_links(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(5000, 5000), (0, 1)]
    rows = components(spark.createDataFrame(edges, "u long, v long"), "t").collect()
    linked = [e for e in edges if e[0] != e[1]]
    nodes = {x for e in linked for x in e}
    assert partition((r.node, r.root) for r in rows) == partition(union_find(nodes, linked).items())
    assert components(spark.createDataFrame([], "u long, v long"), "t").count() == 0


def fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    features = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    counts = [0] * 64
    for f in features:
        h = xxhash.xxh64_intdigest(f, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(features))


def brute(rows, k=3):
    prints = [fingerprint(t) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= k]
    roots = union_find(range(len(rows)), edges)
    least = {}
    for i, r in roots.items():
        if rows[i][0] is not None:
            least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], prints[i], least.get(r)) for i, r in roots.items()), key=str)


def found(df):
    return sorted(((r.doc_id, r.f0 % 2**64, r.component_id) for r in df.collect()), key=str)


def test_query_equals_brute_force_on_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(simhash.near_duplicates(docs)) == brute(rows)


def test_awkward_and_empty_tables(spark, frame, awkward):
    rows = [r[:2] for r in awkward]
    assert found(simhash.near_duplicates(frame(awkward))) == brute(rows)
    assert simhash.near_duplicates(frame([])).count() == 0


def clustered(rng, sizes, most):
    values = {rng.getrandbits(64) for _ in range(200)}
    for size in sizes:
        centre = rng.getrandbits(64)
        for _ in range(size):
            x = centre
            for _ in range(rng.randrange(0, most + 1)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    return sorted(values)


def joined(spark, values, k):
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    sig = spark.createDataFrame(list(enumerate(signed)), "node long, f0 long").repartition(3)
    return [(r.u, r.v) for r in simhash.links(sig, k).collect()]


@pytest.mark.parametrize("short", [64, 4])
def test_all_links_joined_also_in_long_lists(spark, monkeypatch, short):
    monkeypatch.setattr(simhash, "SHORT", short)  # 4: lists are split down to the last depth
    values = clustered(random.Random(3), (150, 150, 150), 5)
    for k in (1, 3, 5):
        got = joined(spark, values, k)
        assert all((values[a] ^ values[b]).bit_count() <= k for a, b in got)
        want = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= k]
        assert partition(union_find(range(len(values)), got).items()) == partition(union_find(range(len(values)), want).items())


def test_each_pair_is_tallied_in_one_list(spark):
    values = clustered(random.Random(4), (20, 20), 3)  # no list is long
    got = joined(spark, values, 3)
    want = {(i, j) for j in range(len(values)) for i in range(j) if (values[i] ^ values[j]).bit_count() <= 3}
    assert sorted(got) == sorted(want)


def test_fingerprints_that_share_bytes_but_do_not_link(spark):
    rng = random.Random(5)
    high = rng.getrandbits(40) << 24  # five bytes in common, the others apart
    values = sorted({high | rng.getrandbits(24) for _ in range(600)})
    got = joined(spark, values, 3)
    want = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3]
    assert partition(union_find(range(len(values)), got).items()) == partition(union_find(range(len(values)), want).items())


def test_no_list_outgrows_its_bound():
    prints = np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64)
    key = simhash.list_key(prints, [0, 1, 2, 3, 4])
    parts = list(simhash.part_keys(prints, key, [0, 1, 2, 3, 4], 4))
    assert len(parts) == 4  # of 6 bits each: a list holds one value of 46 bits, so at most 2^18 fingerprints
    flipped = prints ^ np.uint64(1 << 40 | 1 << 50 | 1 << 63)
    again = list(simhash.part_keys(flipped, key, [0, 1, 2, 3, 4], 4))
    assert (np.sum([a == b for a, b in zip(parts, again, strict=True)], axis=0) >= 1).all()


def test_long_text_in_slices_is_the_same(monkeypatch):
    words = [f"w{i % 91}".encode() for i in range(1000)]
    whole = simhash.majority(simhash.whole_hashes(words, 3, 42, False))
    monkeypatch.setattr(simhash, "SLICE", 64)
    assert simhash.majority(simhash.whole_hashes(words, 3, 42, False)) == whole


def test_near_stage_keeps_one_of_each_group(spark, frame):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)]
    for i, t in enumerate(texts[:10]):  # two words of 300 differ: five-word similarity about 0.94
        words = t.split()
        for at in (50, 200):
            words[at] = f"new{i}{at}"
        rows.append((100 + i, " ".join(words)))
    docs = frame(rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(30))


def test_shared_positions():
    a = np.array([0, 0x0102030405060708], dtype=np.uint64)
    b = np.array([0xFF, 0x0102030405060709], dtype=np.uint64)
    assert simhash.shared_positions(a, b).tolist() == [0b11111110, 0b11111110]
    assert simhash.first_positions(3)[0b11111110] == 0b1110 and simhash.first_positions(3)[0b11] == 0


def edited(rng, words, kind, share):
    """A copy that lost, gained or has another contiguous passage of a share of its words."""
    n = round(len(words) * share)
    at = rng.randrange(len(words) - n)
    new = [f"n{rng.randrange(10**6)}" for _ in range(n)]
    return {"cut": words[:-n], "lost": words[:at] + words[at + n :], "gained": words[:at] + new + words[at:], "replaced": words[:at] + new + words[at + n :]}[kind]


def test_near_stage_equals_brute_force_on_passage_edits(spark, frame):
    rng = random.Random(8)
    texts = []
    for kind in ("cut", "lost", "gained", "replaced"):
        for share in (0.05, 0.1, 0.15, 0.18, 0.22):
            for _ in range(5):
                words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 400))]
                texts += [" ".join(words), " ".join(edited(rng, words, kind, share))]
    base = [f"b{rng.randrange(3000)}" for _ in range(300)]
    for _ in range(40):  # a large group with links of some of its pairs only
        texts.append(" ".join(edited(rng, base, "replaced", rng.choice((0.04, 0.09, 0.14)))))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = sorted(set(union_find(range(len(sets)), links).values()))
    assert len(links) > 100
    assert sorted(r.doc_id for r in simhash.keep_one(frame(list(enumerate(texts)))).collect()) == want


def test_near_stage_on_awkward_and_empty_tables(spark, frame, awkward):
    kept = simhash.keep_one(frame(awkward))
    assert kept.columns == frame(awkward).columns
    # One of 1, 2, 8, 12; of 3, 4, 5 and the null text without an id; of 6, 7; of both 9; all others stay.
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([awkward[i][:2] for i in (0, 2, 5, 8, 10, 11, 13)], key=str)
    without = [(None, "one text of its own"), (None, "another text of its own"), (None, "Another text  of its own"), (None, None)]
    assert sorted((r.text or "").lower().split()[:1] for r in simhash.keep_one(frame(without)).collect()) == [[], ["another"], ["one"]]
    assert simhash.keep_one(frame([])).count() == 0


def test_near_stage_keeps_one_row_of_a_repeated_id(spark, frame):
    rows = [(1, "a b c d e f"), (1, "A B C D E F"), (2, "a b c d e f"), (2, "some other words that stay here")]
    kept = [(r.doc_id, r.text.lower()) for r in simhash.keep_one(frame(rows)).collect()]
    assert sorted(kept) == [(1, "a b c d e f"), (2, "some other words that stay here")]


@pytest.mark.parametrize("busy", [128, 0])
def test_near_stage_in_busy_lists_and_small_chunks(spark, frame, monkeypatch, busy):
    """Texts that share a common part: their lists hold many unlike pairs, are split by further bands and dealt out in chunks."""
    monkeypatch.setattr(simhash, "BUSY", busy)
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = random.Random(11)
    common = [f"c{rng.randrange(4000)}" for _ in range(160)]
    texts = [" ".join([*common, *(f"o{rng.randrange(10**6)}" for _ in range(rng.choice((40, 90, 160))))]) for _ in range(120)]
    for i in range(0, 60, 2):
        texts.append(" ".join(edited(rng, texts[i].split(), "replaced", 0.04)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    roots = union_find(range(len(sets)), links)
    assert len(links) >= 30
    assert sorted(r.doc_id for r in simhash.keep_one(frame(list(enumerate(texts)))).collect()) == sorted(set(roots.values()))


def test_pairs_that_meet_in_busy_lists_alone_are_linked(spark, frame, monkeypatch):
    """Pairs just over 0.8 that share one to three bands, among texts alike to 0.72 that share these too."""
    monkeypatch.setattr(simhash, "BUSY", 0)
    rng = random.Random(13)
    core, texts = [f"c{i}" for i in range(252)], []

    def bands(text):
        return np.frombuffer(simhash.sketch(simhash.shingle_set(text.encode())), dtype=np.uint8).reshape(simhash.BANDS, -1)

    while len(texts) < 24:
        own = [f"o{rng.randrange(10**6)}" for _ in range(48)]
        pair = [" ".join(core + own), " ".join([*core, *own[:20], *(f"n{rng.randrange(10**6)}" for _ in range(28))])]
        if 1 <= (bands(pair[0]) == bands(pair[1])).all(axis=1).sum() <= 3:
            texts += pair
    others = [" ".join([*core, *(f"o{rng.randrange(10**6)}" for _ in range(48))]) for _ in range(100)]
    sets = [simhash.shingle_set(t.encode()) for t in texts]
    assert all(simhash.alike(*sets[i : i + 2]) for i in range(0, 24, 2)) and not simhash.alike(sets[0], sets[2])
    kept = [r.doc_id for r in simhash.keep_one(frame([*enumerate(others), *enumerate(texts, 100)])).collect()]
    assert sorted(kept) == [*range(100), *range(100, 124, 2)]


def test_rarest_shingles_lose_no_pair(spark):
    rng = random.Random(14)
    core = [f"c{i}" for i in range(200)]
    texts = []
    for share in (20, 30, 36, 40, 60):  # of own words behind a common part; or edits of one of these
        for _ in range(12):
            own = [f"o{rng.randrange(10**6)}" for _ in range(share)]
            texts.append(" ".join(core + own))
            texts.append(" ".join(edited(rng, core + own, rng.choice(["cut", "lost", "gained", "replaced"]), rng.choice([0.05, 0.1, 0.15]))))
    sets = [simhash.shingle_set(t.encode()) for t in texts]
    want = [(i, j) for i in range(len(sets)) for j in range(i) if simhash.alike(sets[i], sets[j])]
    rows = spark.createDataFrame(list(enumerate(texts)), "rid long, text string").repartition(3).selectExpr("rid", "cast(text AS binary) AS text")
    signed = simhash.shingle_sketches(rows).withColumnRenamed("rid", "node")
    got = [(r.u, r.v) for r in simhash.rare_links(rows, signed.selectExpr("node", "node AS root").limit(0), signed).collect()]
    assert all(simhash.alike(sets[i], sets[j]) for i, j in got) and 100 < len(want)
    assert partition(union_find(range(len(sets)), got).items()) == partition(union_find(range(len(sets)), want).items())
