"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint of 8 bytes is posted under its byte at every position.  Two fingerprints that
differ in at most k bits share at least 8 - k positional bytes, so for each pair that meets
the shared bytes are tallied, a pair that reaches the guaranteed minimum is kept, and what is
kept is verified by its differing bits.  Equal fingerprints are one entry.

A posting list by itself would hold a 256th of all fingerprints.  Lists are therefore read
as their intersections: of 8 - k shared positions the first ``FIRST`` lie among the first
k + ``FIRST`` ones, so a fingerprint stands in the sub-list of every choice of ``FIRST`` of
these.  A pair is tallied in the one sub-list that belongs to its first shared positions and
in no other.  A sub-list of over ``SHORT`` entries is not compared but split by one more
position, over the cluster, until it is short or a pair in it has reached the minimum anyway;
what is still long then is split by those of k + 1 parts of the remaining bits that agree
(one of them does), which for k = 3 leaves at most 2^18 different fingerprints in a list.
There a spanning forest of the links is walked, so a list of m fingerprints gives at most
m - 1 links however many pairs it holds, and no link between components is lost.

The near-duplicate stage looks for texts whose five-word shingles are alike to 0.8, at which
8 bytes of a SimHash differ in about 10 bits and share too few bytes to be told from others.
It runs the same index (postings by position and byte, tally, minimum, verification) over a
signature of 80 bytes, one of the smallest hash of the shingles under each of 80 functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, partitions
from tidemark.llm.graph import components
from tidemark.llm.postings import SHORT, pairs_in_runs, signature_bytes, starts_of, whole_runs

SLICE = 1 << 16  # words of a text that are hashed at a time
FIRST, LAST = 3, 5  # positions of the first sub-lists, and of the last that are split by a position


# -- fingerprints ------------------------------------------------------------------------
def shingles(words: Sequence[bytes], n: int) -> Iterable[bytes]:
    """All runs of ``n`` words, joined by a space; of fewer words the whole sequence; of none nothing."""
    if len(words) < n:
        return [b" ".join(words)] if words else []
    return words if n == 1 else map(b" ".join, zip(*[words[i:] for i in range(n)], strict=False))


def hashes(features: Iterable[bytes], seed: int) -> np.ndarray:
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), features), dtype=np.uint64)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """A further 64-bit hash from a hash: the finaliser of splitmix64."""
    if k == 0:
        return h
    z = h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def majority(h: np.ndarray) -> int:
    """Bits that are set in over half of the hashes; zero for no hashes."""
    if not len(h):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), SLICE):
        part = np.ascontiguousarray(h[at : at + SLICE])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def whole_hashes(words: Sequence[bytes], n: int, seed: int, distinct: bool) -> np.ndarray:
    if len(words) <= SLICE:
        h = hashes(shingles(words, n), seed)
    else:
        h = np.concatenate([hashes(shingles(words[at : at + SLICE + n - 1], n), seed) for at in range(0, len(words) - n + 1, SLICE)])
    return np.unique(h) if distinct else h


def fingerprints(docs: DataFrame, n: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the SimHash ``f0`` (long) of each whole text.

    A-Z are lower-cased, words are split at ASCII white space, shingles have ``n`` words.  A bit
    is set if it is in over half of the shingles' XXH64 hashes, repeats included.  Null and empty
    texts have fingerprint zero.
    """
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, f0 bigint"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([majority(whole_hashes((text.as_py() or b"").lower().split(), n, seed, False)) for text in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "f0"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


# -- the index ---------------------------------------------------------------------------
BITS = (1 << np.arange(8, dtype=np.uint8)).astype(np.uint8)
TALLY = np.array([m.bit_count() for m in range(256)], dtype=np.uint8)  # of a mask of shared positions


def first_positions(depth: int) -> np.ndarray:
    """For each mask of shared positions the mask of its first ``depth``; 0 if it has fewer."""
    out = np.zeros(256, dtype=np.int64)
    for mask in range(256):
        own = [p for p in range(8) if mask >> p & 1][:depth]
        out[mask] = sum(1 << p for p in own) if len(own) == depth else 0
    return out


def shared_positions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The mask of the positions at which fingerprints have the same byte."""
    return ((a ^ b).view(np.uint8).reshape(-1, 8) == 0) @ BITS


def list_key(prints: np.ndarray, positions: Sequence[int]) -> np.ndarray:
    """The sub-list of each fingerprint: the mask of the positions, above the bytes there (at most seven)."""
    parts = prints.view(np.uint8).reshape(-1, 8)
    key = np.full(len(prints), sum(1 << p for p in positions), dtype=np.uint64)
    for p in positions:
        key = key << np.uint64(8) | parts[:, p].astype(np.uint64)
    return key.view(np.int64)


def part_keys(prints: np.ndarray, key: np.ndarray, positions: Sequence[int], parts: int) -> Iterator[np.ndarray]:
    """Keys of the lists by which a last sub-list is split: each of so many parts of the bits elsewhere."""
    own, rest = prints.view(np.uint8).reshape(-1, 8), np.zeros(len(prints), dtype=np.uint64)
    elsewhere = [p for p in range(8) if p not in positions]
    for p in elsewhere:
        rest = rest << np.uint64(8) | own[:, p].astype(np.uint64)
    for part, bits in enumerate(np.array_split(np.arange(8 * len(elsewhere)), parts)):
        if len(bits):
            value = rest >> np.uint64(bits[0]) & np.uint64((1 << len(bits)) - 1)
            yield mixed(mixed(key.view(np.uint64) ^ value * np.uint64(0x9E3779B97F4A7C15), 1) + np.uint64(part), 2).view(np.int64)


def forest(node: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest; ``linked(i, others)`` says which of the others link with i."""
    rest = np.arange(len(node))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = linked(i, rest)
            if hit.any():
                found, rest = rest[hit], rest[~hit]
                queue.extend(found.tolist())
                yield np.full(len(found), node[i]), node[found]


class Lists:
    """Reads sub-lists of one depth, sorted by key, from Arrow batches of ``key``, ``node``, ``f0``."""

    def __init__(self, max_bits: int, depth: int, last: int, short: int):
        self.max_bits, self.least, self.depth, self.last, self.short = max_bits, 8 - max_bits, depth, last, short
        self.first = first_positions(min(depth, last))

    def kept(self, key: np.ndarray, prints: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs reach the minimum of shared bytes, belong to this list, and are verified."""
        mask = shared_positions(prints[i], prints[j])
        hit = TALLY[mask] >= self.least
        if self.depth <= self.last:
            hit &= self.first[mask] == key.view(np.uint64)[i] >> np.uint64(8 * self.depth)
        hit[hit] = np.bitwise_count(prints[i[hit]] ^ prints[j[hit]]) <= self.max_bits
        return hit

    def deeper(self, key: np.ndarray, node: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Entries of long lists in the lists one position deeper."""
        masks = (key.view(np.uint64) >> np.uint64(8 * self.depth)).astype(np.int64)
        for mask in np.unique(masks):
            own = masks == mask
            positions = [p for p in range(8) if mask >> p & 1]
            some = prints[own]
            if self.depth < self.last:
                onward = range(positions[-1] + 1, 8 - max(self.least - self.depth - 1, 0))
                keys: Iterable[np.ndarray] = (list_key(some, [*positions, p]) for p in onward)
            else:
                keys = part_keys(some, key[own], positions, self.max_bits + 1)
            for k in keys:
                yield entry_batch(k, node[own], some)

    def read(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, under_way = np.zeros(0, dtype=np.int64), None  # the long list that the last batch ended in
        held = (none, none, none.astype(np.uint64))
        for batch in chain_end(batches):
            if batch is not None:
                new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                held = tuple(np.concatenate(x) for x in zip(held, (new[0], new[1], new[2].view(np.uint64)), strict=True))
            key, node, prints = held
            starts, lengths = starts_of(key)
            if not len(starts):
                continue
            splits = self.depth <= self.last
            long = lengths > self.short
            if splits and under_way is not None:
                long[0] |= key[0] == under_way
            whole = len(key)
            if batch is not None and not (splits and long[-1]):
                whole = int(starts[-1])  # the last list may go on in the next batch
            row_long = np.repeat(long, lengths)[:whole]
            if splits:
                under_way = key[-1] if long[-1] else None
                if row_long.any():
                    yield from self.deeper(key[:whole][row_long], node[:whole][row_long], prints[:whole][row_long])
            else:
                for s, n in zip(starts[long].tolist(), lengths[long].tolist(), strict=True):
                    if s + n <= whole:
                        own = prints[s : s + n]
                        for u, v in forest(node[s : s + n], lambda i, rest, own=own: np.bitwise_count(own[i] ^ own[rest]) <= self.max_bits):
                            yield link_batch(u, v)
            short = ~row_long
            k, own_node, own_prints = key[:whole][short], node[:whole][short], prints[:whole][short]
            for i, j in pairs_in_runs(k, self.short):
                hit = self.kept(k, own_prints, i, j)
                if hit.any():
                    yield link_batch(own_node[i[hit]], own_node[j[hit]])
            held = tuple(x[whole:] for x in held)


def chain_end(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches that have rows, and None for the end."""
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None


ENTRY = "key bigint, node bigint, f0 bigint, other bigint"  # a link has no key: node and other are linked


def entry_batch(key: np.ndarray, node: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(prints.view(np.int64)), pa.nulls(len(key), pa.int64())], names=["key", "node", "f0", "other"])


def link_batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(u), pa.int64())
    return pa.RecordBatch.from_arrays([none, pa.array(u), none, pa.array(v)], names=["key", "node", "f0", "other"])


def links(signatures: DataFrame, max_bits: int) -> DataFrame:
    """Links ``u``, ``v`` between the different fingerprints ``f0`` (long) of ``node`` (long) that differ in at most ``max_bits`` bits (0 to 7), enough of them to join every linked pair."""
    spark, least = signatures.sparkSession, 8 - max_bits
    first, last = min(FIRST, least), min(LAST, least)
    choices = list(combinations(range(max_bits + first), first))

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, prints = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            prints = np.ascontiguousarray(prints).view(np.uint64)
            for positions in choices:
                yield entry_batch(list_key(prints, positions), node, prints)

    entries = signatures.select("node", "f0").mapInArrow(post, ENTRY)
    found = []
    for depth in range(first, last + 2):
        runs = entries.select("key", "node", "f0").repartition(partitions(spark), "key").sortWithinPartitions("key", "node")
        lists = materialise(runs.mapInArrow(Lists(max_bits, depth, last, SHORT).read, ENTRY), "simhash-lists")
        found.append(lists.where("key IS NULL").select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")))
        entries = lists.where("key IS NOT NULL")
        if entries.isEmpty():
            break
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def groups(prints: DataFrame, max_bits: int, label: str = "simhash") -> DataFrame:
    """Rows of ``prints`` (``doc_id``, ``f0``) with ``component_id``, the smallest doc_id reachable by links; null only where no row reached has an id.

    Rows with equal fingerprints are linked.  Give ``prints`` as a written table: it is read
    several times.
    """
    signatures = materialise(prints.select("f0").distinct().withColumn("node", F.monotonically_increasing_id()), f"{label}-signatures")
    found = components(links(signatures, max_bits), label)
    rooted = signatures.join(found, "node", "left").select("f0", F.coalesce("root", "node").alias("root"))
    rows = prints.join(rooted, "f0")
    # Written, so that the join below has exchanges of its own, which Spark splits where a group is large.
    least = materialise(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), f"{label}-smallest")
    return rows.join(least, "root").drop("root")


def near_duplicates(docs: DataFrame, n: int = 3, max_bits: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``f0`` and ``component_id`` of all documents by fingerprints of ``n``-word shingles, repeats included.

    Null and empty texts have fingerprint zero and are linked with each other.  Rows that repeat
    an id are rows of their own; a null id is not the smallest of a component, and one whose rows
    all have none has a null ``component_id``.  An empty table gives no rows.
    """
    prints = materialise(fingerprints(docs, n, seed, id_col, text_col), "simhash-prints")
    return groups(prints, max_bits)


# -- near copies by exact similarity -----------------------------------------------------
BANDS, BAND_BYTES = 20, 4  # a pair alike to 0.8 shares no band with probability (1 - 0.8^4)^20 = 3e-5
WIDTH = BANDS * BAND_BYTES
LEAST_SHARED = 48  # of 80 bytes; a pair alike to 0.8 shares fewer with probability 1e-5
BUSY = 512  # of a list with more unlike pairs for each entry the texts meet by their rarest shingles instead
CHUNK = 1024  # entries of a list that one task compares with as many others
_KEYS = (np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]


def shingle_set(text: bytes | None, n: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct ``n``-word shingles of a whole text."""
    return whole_hashes((text or b"").lower().split(), n, 42, True)


def sketch(h: np.ndarray) -> bytes:
    """The lowest byte of the smallest value of the hashes under each of ``WIDTH`` hash functions."""
    least = np.full(WIDTH, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(h), 2048):
        z = h[None, at : at + 2048] + _KEYS
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        least = np.minimum(least, (z ^ (z >> np.uint64(31))).min(axis=1))
    return (least & np.uint64(255)).astype(np.uint8).tobytes()


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of hashes have a Jaccard similarity of 0.8 or more, in whole numbers."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def plausible(size_a: np.ndarray, a: np.ndarray, size_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sizes allow a similarity of 0.8 and the tally of shared bytes reaches the minimum."""
    return (5 * np.minimum(size_a, size_b) >= 4 * np.maximum(size_a, size_b)) & ((a == b).sum(axis=-1) >= LEAST_SHARED)


def first_bands(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """For each pair of signatures the mask of the first ``depth`` bands that they share; 0 if it shares fewer."""
    shared = (a == b).reshape(-1, BANDS, BAND_BYTES).all(axis=2) @ (1 << np.arange(BANDS))
    out = np.zeros(len(shared), dtype=np.int64)
    for _ in range(depth):
        least = shared & -shared
        out = np.where(least > 0, out | least, 0)
        shared = shared ^ least
    return out


def shingle_sketches(rows: DataFrame) -> DataFrame:
    """For each ``rid``, ``text``: ``digest`` and ``size`` of its shingle set and its ``sketch``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingle_set(text.as_py()) for text in batch.column(1))
            found = [(xxhash.xxh128_digest(h.tobytes()), len(h), sketch(h)) for h in sets]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["rid", "digest", "size", "sketch"])

    return rows.select("rid", F.col("text").cast("binary")).mapInArrow(run, "rid bigint, digest binary, size bigint, sketch binary")


def band(number):  # noqa: ANN001, ANN201
    return F.substring(F.col("sketch"), number * BAND_BYTES + 1, BAND_BYTES)


def posted(entries: DataFrame) -> DataFrame:
    """Entries ``key``, ``mask`` (of the one band), ``node`` in the lists of all bands: ``entries`` has ``node`` and ``sketch``."""
    own = F.array(*[F.struct(F.lit(1 << b).alias("bit"), F.substring("sketch", b * BAND_BYTES + 1, BAND_BYTES).alias("bytes")) for b in range(BANDS)])
    rows = entries.withColumn("band", F.explode(own))
    return rows.select(F.xxhash64("band.bit", "band.bytes").alias("key"), F.col("band.bit").alias("mask"), "node")


def rare_entries(texts: DataFrame) -> DataFrame:
    """Entries ``key``, ``mask``, ``node`` of texts (``rid``, ``text``) under their rarest shingles: no pair alike to 0.8 or more is without a common key.

    The distinct shingles of a text of a are put in one order for all texts, the rarest first.  Sets alike to
    0.8 have at least 0.8 a shingles in common, so the first common one has the place (``mask``, from 0) a / 5 at
    most in either.  Shingles of one text only take places and have no entries.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(some: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            sizes = [len(h) for _, h in some]
            node, size = (np.repeat(np.array(x, dtype=np.int64), sizes) for x in ([rid for rid, _ in some], sizes))
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(size), pa.array(np.concatenate([h for _, h in some]).view(np.int64))], names=["node", "size", "key"])

        for batch in batches:
            held, n = [], 0
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((rid, shingle_set(text.as_py())))
                n += len(held[-1][1])
                if n >= SLICE:
                    yield rows(held)
                    held, n = [], 0
            if held:
                yield rows(held)

    each = materialise(texts.select("rid", "text").mapInArrow(run, "node bigint, size bigint, key bigint"), "near-shingles")
    common = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ordered = each.join(common, "key").groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("x"))
    placed = ordered.select("node", "size", (F.col("size") - F.size("x")).alias("alone"), F.posexplode("x").alias("at", "x"))
    return placed.withColumn("mask", (F.col("alone") + F.col("at")).cast("int")).where("5 * mask <= size").select("x.key", "mask", "node", "size")


def rare_links(texts: DataFrame, roots: DataFrame, signatures: DataFrame) -> DataFrame:
    """Links between all of the texts (``rid``, ``text``) alike to 0.8 or more, without those within one of ``roots`` (``node``, ``root``); exact.

    Of a pair the smaller set, of a, has 8 a / 9 shingles in common at least, so a list without an entry in the
    first ninth of its set has no pair.
    """
    entries = rare_entries(texts).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    entries = materialise(entries.withColumn("early", F.expr("9 * mask <= size")).drop("size"), "near-rare")
    by_root = entries.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.max("early").alias("early"))
    met = by_root.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("top"), F.max("early").alias("early")).where("early AND n > top.c")
    census = materialise(met.select("key", F.col("top.root").alias("most"), F.col("top.c").alias("n_most"), (F.col("n") - F.col("top.c")).alias("n_rest")), "near-rare-census")
    return materialise(unlike_links(in_chunks(entries.drop("early"), census), signatures, texts, 0), "near-links")


def star_links(stars: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs ``u``, ``v`` whose shingle sets are alike to 0.8 or more: all partners of one ``u`` against it, ``CHUNK`` to a task."""
    sizes = stars.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts"))
    partners = stars.join(sizes, "u").select(F.xxhash64("u", F.pmod(F.xxhash64("v"), F.col("parts")).cast("bigint")).alias("task"), F.col("v").alias("rid"), F.lit(True).alias("partner"))
    centres = sizes.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select(F.xxhash64("u", F.col("part").cast("bigint")).alias("task"), F.col("u").alias("rid"), F.lit(False).alias("partner"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches):
            us, vs = [], []
            for partner, rid, text in zip(table.column(1).to_pylist(), table.column(2).to_pylist(), table.column(3), strict=True):
                own = shingle_set(text.as_py())
                if not partner:
                    u, centre = rid, own
                elif alike(centre, own):
                    us.append(u)
                    vs.append(rid)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    rows = partners.unionByName(centres).join(texts, "rid").select("task", "partner", "rid", "text")
    return rows.repartition(partitions(stars.sparkSession), "task").sortWithinPartitions("task", "partner", "rid").mapInArrow(run, "u bigint, v bigint")


def possible(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Those of the pairs ``u``, ``v`` that may be alike to 0.8 by sizes and shared bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain_end(batches):
            if batch is not None:
                size_a, size_b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 4))
                hit = plausible(size_a, signature_bytes(batch.column(3), WIDTH), size_b, signature_bytes(batch.column(5), WIDTH))
                yield batch.select(["u", "v"]).filter(pa.array(hit))

    sides = pairs
    for end in ("u", "v"):
        sides = sides.join(signatures.select(F.col("node").alias(end), F.col("size").alias(f"size_{end}"), F.col("sketch").alias(f"sketch_{end}")), end)
    return sides.select("u", "v", "size_u", "sketch_u", "size_v", "sketch_v").mapInArrow(run, "u bigint, v bigint")


def in_chunks(entries: DataFrame, census: DataFrame) -> DataFrame:
    """``task``, ``side``, ``node``, ``root``, ``mask``: entries dealt out so that all pairs of different roots in a list meet in some task.

    Of a list's roots the one with the most entries stands in chunks of its own; chunks of
    the others meet these and each other.  So a task holds about two chunks, however long the
    list, and a large component next to a few others is not copied.  ``census`` has ``key``,
    ``most`` (that root), ``n_most`` and ``n_rest``.
    """
    chunks = lambda c: F.greatest(F.ceil(F.col(c) / CHUNK), F.lit(1)).cast("int")
    rows = entries.join(census.select("key", "most", chunks("n_most").alias("major"), chunks("n_rest").alias("minor")), "key")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    place = lambda across, i, j, side: F.struct(F.lit(across).alias("across"), i.alias("i"), j.alias("j"), side.alias("side"))
    a = own("minor")
    as_most = F.transform(upto("minor"), lambda i: place(True, i, own("major"), F.lit(2)))
    across = F.transform(upto("major"), lambda j: place(True, a, j, F.lit(1)))
    among = F.transform(upto("minor"), lambda b: place(False, F.least(a, b), F.greatest(a, b), F.when(a == b, 3).when(a < b, 1).otherwise(2)))
    places = F.when(F.col("root") == F.col("most"), as_most).otherwise(F.concat(across, among))
    return rows.withColumn("at", F.explode(places)).select(F.xxhash64("key", "at.across", "at.i", "at.j").alias("task"), "at.side", "node", "root", "mask")


class Unlike:
    """Pairs of different ``root`` and opposite ``side`` in tasks that may be alike, each in the one list of its first shared bands.

    At a depth of 0 the lists are those of rare shingles, ``mask`` is the shingle's place, and no pair alike to 0.8 is
    left out where its first common shingle is read: what both have from there on must be enough.
    """

    def __init__(self, table: pa.Table, depth: int):
        self.task, self.side, self.node, self.root, self.mask, self.size = (table.column(k).to_numpy() for k in range(6))
        self.sketch, self.depth = signature_bytes(table.column(6), WIDTH), depth

    def meet(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the index pairs that are to be verified."""
        a, b = self.side[i], self.side[j]
        hit = ((a & 1 & b >> 1 | a >> 1 & b & 1) > 0) & (self.root[i] != self.root[j])
        i, j = i[hit], j[hit]
        if not self.depth:
            hit = 9 * np.minimum(self.size[i] - self.mask[i], self.size[j] - self.mask[j]) >= 4 * (self.size[i] + self.size[j])
            return i[hit], j[hit]
        hit = plausible(self.size[i], self.sketch[i], self.size[j], self.sketch[j])
        i, j = i[hit], j[hit]
        hit = first_bands(self.sketch[i], self.sketch[j], self.depth) == self.mask[i]
        return i[hit], j[hit]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All of them, in portions; those of one row (as i) come in one portion where a task is long."""
        for i, j in pairs_in_runs(self.task):
            yield self.meet(i, j)
        starts, lengths = starts_of(self.task)
        for s, n in zip(starts[lengths > SHORT].tolist(), lengths[lengths > SHORT].tolist(), strict=True):
            for i in range(s, s + n - 1):
                yield self.meet(np.full(s + n - i - 1, i), np.arange(i + 1, s + n))


def shared_counts(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the sorted sets has in common with ``own``."""
    flat = np.concatenate(others)
    at = np.searchsorted(own, flat)
    at[at == len(own)] = 0
    return np.add.reduceat(own[at] == flat, np.cumsum([0, *map(len, others[:-1])]), dtype=np.int64)


def unlike_links(dealt: DataFrame, signatures: DataFrame, texts: DataFrame, depth: int) -> DataFrame:
    """Links ``u``, ``v`` between entries of different ``root``, enough of them to join all that are alike to 0.8 or more.

    By their signatures first: an entry without a plausible partner in its task goes.  The
    rest come with their texts and are verified where they meet, and what has been joined in
    a task already is not compared again.  So a task gives on fewer rows than it holds.
    """
    spark, schema = dealt.sparkSession, "task bigint, side int, node bigint, root bigint, mask int"

    def partnered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches):
            keep = np.zeros(table.num_rows, dtype=bool)
            for i, j in Unlike(table, depth).pairs():
                keep[i] = keep[j] = True
            yield from table.select(range(5)).filter(pa.array(keep)).to_batches()

    def verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches):
            own = Unlike(table, depth)
            sets = [shingle_set(text.as_py()) for text in table.column(7)]
            parent: dict[tuple[int, int], tuple[int, int]] = {}

            def joined(row: int, own=own, parent=parent) -> tuple[int, int]:  # noqa: ANN001
                x = (int(own.task[row]), int(own.root[row]))
                while x in parent:
                    x = parent[x]
                return x

            us, vs = [], []
            for i, j in own.pairs():
                order = np.argsort(i, kind="stable")
                for some in np.split(order, starts_of(i[order])[0][1:]) if len(i) else []:
                    row = int(i[some[0]])
                    at = joined(row)
                    others = [k for k in j[some].tolist() if joined(k) != at]
                    if others:
                        both = shared_counts(sets[row], [sets[k] for k in others])
                        for k, n in zip(others, both.tolist(), strict=True):
                            if 9 * n >= 4 * (len(sets[row]) + len(sets[k])) and joined(k) != joined(row):
                                parent[joined(k)] = joined(row)
                                us.append(int(own.node[row]))
                                vs.append(int(own.node[k]))
            u, v = np.array(us, dtype=np.int64), np.array(vs, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    def sorted_runs(rows: DataFrame) -> DataFrame:
        return rows.repartition(partitions(spark), "task").sortWithinPartitions("task", "node")

    signed = dealt.join(signatures.select("node", "size", "sketch"), "node").select("task", "side", "node", "root", "mask", "size", "sketch")
    left = materialise(sorted_runs(signed).mapInArrow(partnered, schema), "near-partnered")
    read = left.join(signatures.select("node", "size", "sketch"), "node").join(texts.withColumnRenamed("rid", "node"), "node")
    return sorted_runs(read.select("task", "side", "node", "root", "mask", "size", "sketch", "text")).mapInArrow(verified, "u bigint, v bigint")


def near_groups(rows: DataFrame) -> DataFrame:
    """``rid``, ``root`` of each row of ``rows`` (``rid``, ``text``, written): rows joined by links of similarity 0.8 or more share a root.

    Equal shingle sets are one node.  A node is posted in the list of each of ``BANDS``
    bands of ``BAND_BYTES`` positions with its bytes there.  First each node is held against the
    least node of each of its lists; then, in lists that still hold different components,
    all pairs of different components are.  Texts of a list with over ``BUSY`` such pairs for each entry
    (many that share a common part and little else) meet by their rarest shingles instead, which
    loses no link between any of them (``rare_links``).  Every link is verified by the exact similarity.
    """
    prints = materialise(shingle_sketches(rows), "near-prints")
    nodes = materialise(prints.groupBy("digest").agg(F.min("rid").alias("node")), "near-nodes")
    signatures = materialise(prints.join(nodes, F.col("rid") == F.col("node"), "left_semi").withColumnRenamed("rid", "node").drop("digest"), "near-signatures")
    entries = posted(signatures.where("size > 0").select("node", "sketch"))
    lists = entries.groupBy("key").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = materialise(entries.join(lists, "key"), "near-entries")
    stars = materialise(possible(shared.where("node <> low").select(F.col("low").alias("u"), F.col("node").alias("v")).distinct(), signatures), "near-stars")
    text = rows.select("rid", F.col("text").cast("binary").alias("text"))  # of nodes that share a list with another: all that is compared
    texts = materialise(text.join(shared.select(F.col("node").alias("rid")).distinct(), "rid", "left_semi"), "near-texts")
    edges = materialise(star_links(stars, texts), "near-links")
    rooted = shared.join(components(edges, "near"), "node", "left").select("key", "mask", "node", F.coalesce("root", "node").alias("root"))
    rooted = materialise(rooted, "near-rooted")
    by_root = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    census = by_root.groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same"), F.max(F.struct("c", "root")).alias("top")).where("n > top.c")
    busy = (F.col("n") * F.col("n") - F.col("same")) / 2 > F.lit(BUSY) * F.col("n")
    census = materialise(census.select("key", busy.alias("busy"), F.col("top.root").alias("most"), F.col("top.c").alias("n_most"), (F.col("n") - F.col("top.c")).alias("n_rest")), "near-census")
    edges = edges.unionByName(materialise(unlike_links(in_chunks(rooted, census.where("NOT busy")), signatures, texts, 1), "near-links"))
    crowded = census.where("busy").select("key")
    found = components(edges, "near")
    if not crowded.isEmpty():
        crowd = rooted.join(crowded, "key", "left_semi").select(F.col("node").alias("rid")).distinct()
        some = materialise(texts.join(crowd, "rid", "left_semi"), "near-crowd")
        found = components(edges.unionByName(rare_links(some, found, signatures)), "near")
    rooted_nodes = nodes.join(found, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    return prints.select("rid", "digest").join(rooted_nodes, "digest").select("rid", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of documents whose five-word shingle sets are alike to 0.8 or more.

    Candidates come from the index over 80-byte signatures of the distinct five-word shingles,
    so that it does not matter whether an edit is scattered or in one passage; a link is
    verified by the exact Jaccard similarity.
    The row with the smallest id of a group stays, a null id comes last, and of rows that
    share the smallest id one stays; rows that have no words are alike.  An empty table gives
    no rows.
    """
    numbered = materialise(docs.withColumn("_tm_rid", F.monotonically_increasing_id()), "near-rows")
    rows = numbered.select(F.col("_tm_rid").alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = near_groups(rows.drop("doc_id")).join(rows.select("rid", "doc_id"), "rid")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid"))
    leaders = found.groupBy("root").agg(first.alias("first")).select(F.col("first.rid").alias("_tm_rid"))
    return numbered.join(leaders, "_tm_rid", "left_semi").select(*docs.columns)
