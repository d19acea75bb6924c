import random
import zlib
from collections import Counter, defaultdict

from tidemark.llm import packing


def one_by_one(sizes, capacity):
    """Best-fit decreasing of single groups."""
    rooms, loads = [], []
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits)[1]] -= s
            loads[min(fits)[1]] += s
        else:
            rooms.append(max(capacity, s) - s)
            loads.append(s)
    return sorted(loads)


def loads_of(parts):
    loads, done = defaultdict(int), Counter()
    for part in parts:
        assert part.start == done[part.size]
        done[part.size] = part.upto
        for number in range(part.start, part.upto):
            loads[part.first_bin + (number - part.start) // part.per_bin] += part.size
    return loads, done


def test_runs_pack_as_single_groups_do():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.choice([3, 5, 8, 13, 40, rng.randrange(1, 60)]) for _ in range(rng.randrange(1, 200))]
        loads, done = loads_of(packing.pack(sorted(Counter(sizes).items(), reverse=True), 50))
        assert done == Counter(sizes)
        assert sorted(loads.values()) == one_by_one(sizes, 50)
        assert sorted(loads) == list(range(len(loads)))


def test_steps_do_not_grow_with_the_bins():
    few, many = (packing.pack([(40, n), (9, 3 * n), (4, 5 * n + 1)], 100) for n in (1000, 1_000_000))
    assert len(many) <= len(few) + 4 < 30
    assert packing.pack([(40, 1_000_000)], 100, most_bins=499_999) is None
    assert packing.pack([(40, 1_000_000)], 100, most_bins=500_000) is not None


def test_tree_finds_the_tightest_and_stays_balanced():
    rng, keys, tree = random.Random(4), set(), None
    for _ in range(2000):
        key = (rng.randrange(500), rng.randrange(10_000))
        if keys and rng.random() < 0.4:
            gone = rng.choice(sorted(keys))
            keys.remove(gone)
            tree = packing.remove(tree, gone)
        elif key not in keys:
            keys.add(key)
            tree = packing.insert(tree, key)
        size = rng.randrange(500)
        assert packing.tightest(tree, size) == min((k for k in keys if k[0] >= size), default=None)
    assert tree.height <= 1.5 * len(keys).bit_length() + 2


def check(rows, got, shards):
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    of_text = defaultdict(set)
    for r in got:
        of_text[r.text_crc32, r.size].add(r.shard)
    assert all(len(s) == 1 for s in of_text.values())
    assert {(r.size, r.text_crc32) for r in got} == {(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_equal_size(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = packing.shard(docs, shards=4).collect()
    check(rows, got, 4)
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    assert max(loads.values()) - min(loads.values()) <= 0.02 * sum(loads.values()) / 4


def test_hot_group_has_a_shard_and_the_rest_is_even(frame):
    rng = random.Random(6)
    rows = [(i, "hot " * 50) for i in range(150)] + [(1000 + i, "y" * rng.randrange(1, 80) + str(i)) for i in range(300)]
    got = packing.shard(frame(rows), shards=5).collect()
    check(rows, got, 5)
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    rest = sorted(loads.values())[:-1]
    assert len(loads) == 5 and max(rest) - min(rest) <= 90


def test_awkward_empty_and_capacity(frame, awkward):
    rows = [r[:2] for r in awkward]
    check(rows, packing.shard(frame(awkward), shards=3).collect(), 3)
    assert packing.shard(frame([]), shards=3).count() == 0
    by_capacity = packing.shard(frame(awkward), capacity=1000).collect()
    loads = Counter()
    for r in by_capacity:
        loads[r.shard] += r.size
    assert all(v <= 1000 or v > 5000 for v in loads.values())
