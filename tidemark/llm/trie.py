"""The trie of conversations' prefixes, without building a tree.

A prefix of d turns has a polynomial fingerprint, the sum of turn hashes times powers of a base,
twice modulo 2^31 - 1; a numpy scan over turns in order gives those of all prefixes.  Prefixes of one
depth and fingerprint are a group of candidates.  Each member's turn is compared with that of
the group's representative, its smallest conversation; as the fingerprint of the prefix before
must agree too, a group whose members all pass holds one sequence of turns.  Members that do
not pass are split off into a group of their own and compared again.

A node is a verified group, named by its smallest conversation and its depth.  The node above it
by any number of turns is that of the same conversation at a smaller depth, found by a join
on a unique key.  Subtrees are summed in rounds of doubling reach: what lies less than k turns
below a node, and the same of the nodes k turns below it, is what lies less than 2k below.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialise, partitions, scratch

#: The prime 2^31 - 1 and two bases.
PRIME, BASES = 2_147_483_647, (1_103_515_245, 69_069)
TABLE = 1 << 16  # powers of a base in steps of one, and in steps of so many
PIECE = 1 << 16  # characters of a list of ids that is hashed at a time
SHARED = 9  # fewer turns than this are taken from another conversation


def powers(base: int, prime: int, n: int = TABLE) -> np.ndarray:
    out = np.ones(n, dtype=np.int64)
    done = 1
    while done < n:  # by doubling: the powers so far times the next one
        step = int(pow(base, done, prime))
        out[done : 2 * done] = out[: min(done, n - done)] * step % prime
        done *= 2
    return out


class Scan:
    """Depths and prefix fingerprints of turns that come sorted by conversation and place; a conversation may span batches."""

    def __init__(self, prime: int = PRIME, bases: tuple[int, ...] = BASES):
        self.prime = prime
        self.tables = [(powers(b, prime), powers(int(pow(b, TABLE, prime)), prime)) for b in bases]
        self.conv: int | None = None
        self.depth, self.sums = 0, [0] * len(bases)

    def batch(self, conv: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Depth, fingerprint and fingerprint of the prefix before, of each row; ``own`` has a hash of each turn.  A conversation's first row has no turn and depth 0."""
        starts = np.r_[True, conv[1:] != conv[:-1]]
        first, of = np.flatnonzero(starts), np.cumsum(starts) - 1
        goes_on = self.conv is not None and int(conv[0]) == self.conv
        depth = np.arange(len(conv), dtype=np.int64) - first[of]
        depth[of == 0] += self.depth + 1 if goes_on else 0
        now, before = [], []
        for k, (fine, coarse) in enumerate(self.tables):
            place = fine[depth % TABLE] * coarse[depth // TABLE] % self.prime
            turn = (own.view(np.uint64) >> np.uint64(31 * k)) % np.uint64(self.prime)
            terms = np.where(depth > 0, turn.astype(np.int64) * place % self.prime, 0)
            total = np.cumsum(terms)
            earlier = (total[first] - terms[first])[of]
            sums = (total - earlier + np.where((of == 0) & goes_on, self.sums[k], 0)) % self.prime
            now.append(sums)
            before.append((sums - terms) % self.prime)
            self.sums[k] = int(sums[-1])
        self.conv, self.depth = int(conv[-1]), int(depth[-1])
        return depth, now, before


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the one that its number is rounded down to."""
    return F.crc32(conv.cast("string").cast("binary")) % SHARED


def rebuilt(rows: DataFrame, group: int = 5) -> DataFrame:
    """``c``, ``place`` (own or not, and a number), ``role``, ``text``: the turns of every rebuilt conversation, after a first row of each that has no turn.

    Turns are ordered by ``turn`` (null first), equal ones by role and text.  Rows without a
    ``conv_id`` belong to no conversation.  One shuffle, by the number that ``group`` conversations
    share, in which the result stays; a turn is given on to fewer than ``group`` of them.  A
    conversation's turns are sorted by one task, outside memory if need be.
    """
    block = F.col("conv_id") - F.col("conv_id") % group
    text, role = (F.coalesce(c, F.lit("")).alias(c) for c in ("text", "role"))
    turns = rows.where("conv_id IS NOT NULL").select(block.cast("bigint").alias("_b"), F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role, text).repartition("_b")
    placed = turns.withColumn("_i", F.row_number().over(Window.partitionBy("_b", "conv_id").orderBy("turn", "role", "text")) - 1)
    placed = placed.withColumn("_there", F.collect_set(F.when(F.col("_i") == 0, F.col("conv_id"))).over(Window.partitionBy("_b")))  # at most ``group``
    base, own = F.col("conv_id") == F.col("_b"), F.col("_i") >= shared_turns(F.col("conv_id"))
    none = F.array().cast("array<struct<c: bigint, place: struct<own: boolean, i: int>>>")

    def goes_to(c: Column, is_own: bool, i: Column) -> Column:
        return F.struct(c.alias("c"), F.struct(F.lit(is_own).alias("own"), i.cast("int").alias("i")).alias("place"))

    taken = F.filter("_there", lambda c: (c != F.col("conv_id")) & (shared_turns(c) > F.col("_i")))
    given = F.when(base, F.transform(taken, lambda c: goes_to(c, False, F.col("_i")))).otherwise(none)
    itself = F.when(base | own, F.array(goes_to(F.col("conv_id"), True, F.col("_i")))).otherwise(none)
    begin = F.when(F.col("_i") == 0, F.array(goes_to(F.col("conv_id"), False, F.lit(-1)))).otherwise(none)
    out = placed.select("_b", "role", "text", F.explode(F.concat(begin, given, itself)).alias("_x"))
    return out.select("_b", "_x.c", "_x.place", *[F.when(F.col("_x.place.i") < 0, "").otherwise(F.col(x)).alias(x) for x in ("role", "text")])


def prefixes(turns: DataFrame, prime: int = PRIME, bases: tuple[int, ...] = BASES) -> DataFrame:
    """``c``, ``d``, ``f``, ``pf`` (fingerprints of the prefix and of the one before), ``role``, ``text``, ``bytes`` of every prefix.

    All rows of a conversation lie in one partition of ``turns``.
    """
    kept = [c for c in ("_b", "c") if c in turns.columns]
    hashed = turns.sortWithinPartitions(*kept, "place").select("c", F.xxhash64("role", "text").alias("h"), "role", "text", F.octet_length("text").cast("bigint").alias("bytes"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan(prime, bases)
        for batch in batches:
            if batch.num_rows:
                depth, now, before = scan.batch(batch.column(0).to_numpy(), batch.column(1).to_numpy())
                f, pf = (pa.array(x[0] << 31 | x[1]) for x in (now, before))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(depth), f, pf, *batch.columns[2:]], names=["c", "d", "f", "pf", "role", "text", "bytes"])

    return hashed.mapInArrow(run, "c bigint, d bigint, f bigint, pf bigint, role string, text string, bytes bigint")


def verified(rows: DataFrame) -> DataFrame:
    """``c``, ``d``, ``rep``, ``n``, ``bytes`` of every prefix: its group's smallest conversation and size, the last turn's bytes.

    ``rows`` is the written table of ``prefixes``.  A large group is read by the joins alone,
    whose large partitions Spark splits, and by partial aggregates.
    """
    split = None  # c, d, s, ps: the part of its group that a prefix belongs to, and that of the prefix before
    while True:
        thin = rows.where("d > 0").select("c", "d", "f", "pf", "bytes")
        thin = thin.join(split, ["c", "d"]) if split is not None else thin.withColumns({"s": F.lit(-1).cast("bigint"), "ps": F.lit(-1).cast("bigint")})
        groups = materialise(thin.groupBy("d", "f", "s").agg(F.min("c").alias("rep"), F.count(F.lit(1)).alias("n")), "trie-groups")
        found = materialise(thin.join(groups, ["d", "f", "s"]), "trie-found")
        shared = rows.select("c", "d", "role", "text").join(found.where("n > 1").select("c", "d", "f", "s", "pf", "ps", "rep"), ["c", "d"])
        heads = shared.where("c = rep").select("rep", "d", "f", "s", *[F.col(x).alias(f"r_{x}") for x in ("role", "text", "pf", "ps")])
        members = shared.where("c <> rep").join(heads, ["rep", "d", "f", "s"])
        differ = materialise(members.where("role <> r_role OR text <> r_text OR pf <> r_pf OR ps <> r_ps").select("c", "d", "f", "s"), "trie-differ")
        if differ.isEmpty():
            break
        named = differ.join(differ.groupBy("d", "f", "s").agg(F.min("c").alias("_own")), ["d", "f", "s"]).select("c", "d", "_own")
        moved = found.select("c", "d", "s").join(named, ["c", "d"], "left").select("c", "d", F.coalesce("_own", "s").alias("s"))
        split = materialise(moved.withColumn("ps", F.coalesce(F.lag("s").over(Window.partitionBy("c").orderBy("d")), F.lit(-1).cast("bigint"))), "trie-split")
    roots = rows.where("d = 0").select("c", "d", "bytes")
    every = roots.crossJoin(roots.agg(F.min("c").alias("rep"), F.count(F.lit(1)).alias("n")))  # a single row
    return found.select("c", "d", "rep", "n", "bytes").unionByName(every.select("c", "d", "rep", "n", "bytes"))


def summed(values: DataFrame, members: DataFrame, deepest: int, sums: list[str]) -> DataFrame:
    """``rep``, ``d`` and the sums over each node's subtree.  ``members`` has the node of every prefix."""
    at, reach = materialise(values.select("rep", "d", *sums), "trie-sums"), 1
    while reach <= deepest:
        up = members.select(F.col("c").alias("rep"), (F.col("d") + reach).alias("d"), F.col("rep").alias("_above"))
        below = at.join(up, ["rep", "d"]).select(F.col("_above").alias("rep"), (F.col("d") - reach).alias("d"), *sums)
        more = materialise(at.unionByName(below).groupBy("rep", "d").agg(*[F.sum(s).alias(s) for s in sums]), "trie-sums")
        discard(at)
        at, reach = more, 2 * reach
    return at


def listed_digest(ends: DataFrame) -> DataFrame:
    """``rep``, ``d``, ``ends_sha256``: the SHA-256 of each node's numbers ``c``, ascending and joined by commas.

    Numbers are joined to pieces where they lie after a sort over all partitions; a node's
    pieces, a few for each 2^16 characters, then stream through one digest.
    """

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, size, out = None, [], 0, []
        for batch in batches:
            for *node, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if node != key or size > PIECE:
                    if ids:
                        out.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids, size = node, [], 0
                ids.append(c)
                size += len(str(c)) + 1
            yield table(out)
            out = []
        if ids:
            yield table([(*key, ids[0], ",".join(map(str, ids)))])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.string()])], names=["rep", "d", "first", "piece"])

    def digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for *node, piece in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if node == key:
                    state.update(b"," + piece.encode())
                    continue
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = node, sha256(piece.encode())
            yield result(out)
            out = []
        if key:
            yield result([(*key, state.hexdigest())])

    def result(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate([pa.int64(), pa.int64(), pa.string()])], names=["rep", "d", "ends_sha256"])

    order = ["rep", "d", "c"]
    runs = ends.select(*order).repartitionByRange(partitions(ends.sparkSession), *order).sortWithinPartitions(*order)
    pieces = runs.mapInArrow(joined, "rep bigint, d bigint, first bigint, piece string")
    return pieces.repartition("rep", "d").sortWithinPartitions("rep", "d", "first").mapInArrow(digested, "rep bigint, d bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, prime: int = PRIME, bases: tuple[int, ...] = BASES) -> DataFrame:
    """One row per node of the trie: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    ``turns`` has ``c``, ``place`` (by which a conversation's rows are ordered; the first one stands for
    the conversation and has no turn), ``role`` and ``text``, without nulls, a conversation's rows in one
    partition (as ``rebuilt`` gives them).  A node's subtree holds itself; what sharing its
    last text saves is (members - 1) times that text's bytes.  No conversations give no nodes.
    """
    with scratch() as keep:
        rows = materialise(prefixes(turns, prime, bases), "trie-prefixes")
        members = materialise(verified(rows), "trie-members")
        up = members.select("c", (F.col("d") + 1).alias("d"), F.col("rep").alias("parent"))
        heads = members.where("c = rep").select("rep", "d", "n", "bytes")
        nodes = materialise(heads.join(up.withColumnRenamed("c", "rep"), ["rep", "d"], "left"), "trie-nodes")
        children = nodes.where("d > 0").groupBy(F.col("parent").alias("rep"), (F.col("d") - 1).alias("d")).agg(F.count(F.lit(1)).alias("n_children"))
        full = materialise(nodes.join(children, ["rep", "d"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))), "trie-full")
        deepest = full.agg(F.max("d")).first()[0] or 0
        values = full.select("rep", "d", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"), ((F.col("n") - 1) * F.col("bytes")).alias("saved_tokens"))
        sums = summed(values, members, deepest, ["n_leaves", "saved_tokens"])
        last = members.groupBy("c").agg(F.max(F.struct("d", "rep")).alias("_x")).select("c", "_x.*")
        out = full.join(sums, ["rep", "d"]).join(listed_digest(last), ["rep", "d"], "left")
        return keep(materialise(out.select(
            F.col("rep").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
        ), "trie"))
