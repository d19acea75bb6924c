"""Shards by best-fit-decreasing bin packing.

Rows with equal texts are an indivisible group.  Groups are taken by falling size; each
enters the bin with the least remaining capacity that still holds it, found in a balanced
tree of remaining capacities; if none does, a new bin is opened.

Groups of one size class are interchangeable, so the driver packs runs (class, number of
groups) instead of groups: a bin takes as many of a run as it holds.  Bins with the same
remaining capacity that were filled alike are one range in the tree, so a run that opens a
million bins is one step.  The classes are the sizes rounded up to 12 significant bits, at
most 2^11 per power of two, so the runs sent to the driver, and the steps that packing them
takes, have a bound that does not depend on the number of groups or bins.  A group's bin
follows from its number within its class.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, numbered

CLASS_BITS = 12


@dataclass
class Node:
    key: tuple[int, int]  # remaining capacity, bin
    height: int = 1
    left: Node | None = None
    right: Node | None = None


def _height(node: Node | None) -> int:
    return node.height if node else 0


def _rotate(node: Node, to_left: bool) -> Node:
    if to_left:
        up, node.right = node.right, node.right.left
        up.left = node
    else:
        up, node.left = node.left, node.left.right
        up.right = node
    for x in (node, up):
        x.height = 1 + max(_height(x.left), _height(x.right))
    return up


def _balanced(node: Node) -> Node:
    node.height = 1 + max(_height(node.left), _height(node.right))
    lean = _height(node.left) - _height(node.right)
    if lean > 1:
        if _height(node.left.left) < _height(node.left.right):
            node.left = _rotate(node.left, True)
        return _rotate(node, False)
    if lean < -1:
        if _height(node.right.right) < _height(node.right.left):
            node.right = _rotate(node.right, False)
        return _rotate(node, True)
    return node


def insert(node: Node | None, key: tuple[int, int]) -> Node:
    if node is None:
        return Node(key)
    if key < node.key:
        node.left = insert(node.left, key)
    else:
        node.right = insert(node.right, key)
    return _balanced(node)


def remove(node: Node, key: tuple[int, int]) -> Node | None:
    if key < node.key:
        node.left = remove(node.left, key)
    elif key > node.key:
        node.right = remove(node.right, key)
    elif node.left is None or node.right is None:
        return node.left or node.right
    else:
        least = node.right
        while least.left:
            least = least.left
        node.key = least.key
        node.right = remove(node.right, least.key)
    return _balanced(node)


def tightest(node: Node | None, size: int) -> tuple[int, int] | None:
    """The bin with the least remaining capacity of at least ``size``."""
    best = None
    while node:
        if node.key[0] >= size:
            best, node = node.key, node.left
        else:
            node = node.right
    return best


@dataclass(frozen=True)
class Part:
    """Groups ``start`` to ``upto`` - 1 of a class, ``per_bin`` of them to each bin from ``first_bin`` on."""

    size: int
    start: int
    upto: int
    first_bin: int
    per_bin: int


def pack(runs: list[tuple[int, int]], capacity: int, most_bins: int | None = None) -> list[Part] | None:
    """Best-fit decreasing of runs (size, number of groups), sizes falling.

    Of bins that fit equally well the one opened first is taken.  A group over the capacity
    gets a bin of its own.  None if over ``most_bins`` bins are needed.
    """
    tree, alike, opened, out = None, {}, 0, []  # alike: the number of bins of a range in the tree

    def put(room: int, first: int, bins: int) -> None:
        nonlocal tree
        if room and bins:
            tree = insert(tree, (room, first))
            alike[room, first] = bins

    for size, count in runs:
        done = 0
        while done < count:
            found = tightest(tree, size)
            if found is None:
                room, first = max(capacity, size), opened
                bins = -(-(count - done) // (room // size))
                opened += bins
                if most_bins is not None and opened > most_bins:
                    return None
            else:
                tree = remove(tree, found)
                (room, first), bins = found, alike.pop(found)
            each = room // size
            full = min(bins, (count - done) // each)
            if full:
                out.append(Part(size, done, done + full * each, first, each))
                done += full * each
                put(room - each * size, first, full)
            if full < bins and done < count:  # fewer are left than the next bin holds
                out.append(Part(size, done, count, first + full, count - done))
                put(room - (count - done) * size, first + full, 1)
                done, full = count, full + 1
            put(room, first + full, bins - full)
    return out


def least_capacity(runs: list[tuple[int, int]], bins: int) -> int:
    """A capacity, least up to one part in 2^14, at which ``pack`` needs at most so many bins.

    The search starts at the mean size of what is left for the other bins when groups above
    that mean have a bin of their own.
    """
    rest, left = sum(s * n for s, n in runs), bins
    for size, count in runs:
        while count and left > 1 and size * left > rest:
            rest, left, count = rest - size, left - 1, count - 1
        if count:
            break
    low = max(1, math.ceil(rest / left))
    if pack(runs, low, bins) is not None:
        return low
    step = max(1, low >> 14)
    while pack(runs, low + step, bins) is None:
        step *= 2
    fail, high = step // 2, step
    while high - fail > max(1, low >> 14):
        middle = (fail + high) // 2
        fail, high = (fail, middle) if pack(runs, low + middle, bins) is not None else (middle, high)
    return low + high


def shard(docs: DataFrame, shards: int | None = None, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row.

    Give the number of shards, whose sizes come out near equal, or a capacity in bytes, of
    which as few shards as the method finds are filled.  A row's size is that of its text in
    UTF-8 plus 1; null counts as the empty text.  Equal texts share a shard; a group above the
    capacity has a shard of its own.  Slots number a shard's rows from 0 by id, null first;
    rows that repeat an id in the order in which they were written.  Groups of one class are
    placed in the order of their digests.  An empty table gives no rows.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = materialise(
        docs.select(F.col(id_col).alias("doc_id"), (F.length(raw).cast("bigint") + 1).alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("gid")), "shard-rows"
    )
    shift = f"greatest(length(bin(total)) - {CLASS_BITS}, 0)"
    groups = rows.groupBy("gid").agg(F.sum("size").alias("total")).select("gid", F.expr(f"shiftleft(shiftright(total - 1, {shift}) + 1, {shift})").alias("class"))
    groups = numbered(materialise(groups, "shard-groups"), ["class"], ["gid"], "number", "shard-classes")
    runs = sorted(((r["class"], r["n"]) for r in groups.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    parts = pack(runs, least_capacity(runs, shards) if shards else capacity) if runs else []
    by_class: dict[int, list[tuple[int, int, int, int]]] = {}
    for part in parts:
        by_class.setdefault(part.size, []).append((part.start, part.upto, part.first_bin, part.per_bin))
    places = docs.sparkSession.createDataFrame(list(by_class.items()), "class bigint, parts array<struct<start: bigint, upto: bigint, first: bigint, per: bigint>>")
    part = F.expr("filter(parts, p -> p.upto > number)[0]")
    placed = groups.join(places, "class").withColumn("part", part).select("gid", F.expr("cast(part.first + (number - part.start) div part.per as int)").alias("shard"))
    return numbered(materialise(rows.join(placed, "gid").drop("gid"), "shard-placed"), ["shard"], ["doc_id", "text_crc32"], "slot", "shard-slots")
