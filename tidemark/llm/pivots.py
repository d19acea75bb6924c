"""Near-duplicate vectors: an exact metric range join.

The metric is the angle: a cosine of at least c is an angle of at most r = arccos(c).  Within
each label, pivots (some of the vectors, more than r/2 apart) cut the space into cells; a
vector's home is the cell of its nearest pivot.  If q is at home at pivot p and v is within r
of q, the triangle inequality gives

    d(v, p) <= d(q, p) + r <= d(q, p') + r <= d(v, p') + 2r      for every pivot p',

so v is copied to every cell p with d(v, p) <= d(v, nearest) + 2r, and all partners of q are
in q's home cell.  The same holds for pivots inside a cell, so a cell with many vectors at home
is cut again, each time by at most ``PIVOTS`` pivots: what pivots cost grows as the vectors do.
A sample of the cell tells beforehand which share of its comparisons a cut would leave; where
that is over ``LEFT`` (vectors without structure are far from everything, and nearly all
would be copied everywhere) the cell stays whole.

Cells are joined independently, a block of home vectors against a block of members at a time.
Inside a block the triangle inequality works again: only vectors whose distances to the pivot
differ by at most r are compared.  In a cell whose members are all at home each pair of blocks
meets once.

Vectors of one label that are equal are one entry with a weight.  A dense group within r/2 of
its pivot (a group of near copies) needs no comparisons among its own: any two of its vectors
are within r.  Links are counted where the home vector is and given on as the links of a
spanning forest, so nothing is emitted for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, partitions
from tidemark.llm.graph import components

BLOCK_VALUES = 1 << 20  # components of a block's vectors, about: 16384 vectors of 64, 1024 of 1024
CUT = 4096  # a cell with more vectors at home may be cut
PART = 4096  # vectors of a cell that are dealt out at a time
PIVOTS = 128  # of one cut
SAMPLE = 2048  # vectors by which a cut is judged, about
LEFT = 0.25  # of a cell's comparisons, at most, if a cut is to be made
DEPTH = 12  # cuts, one in another
EDGE = 1e-6  # more than rounding may add to an angle


def unit(vectors: Iterable[np.ndarray]) -> np.ndarray:
    """Vectors of length one in double precision.  Scaled by the largest component first, so that squares neither overflow nor vanish."""
    rows = np.stack(list(vectors)).astype(np.float64)
    rows /= np.abs(rows).max(axis=1)[:, None]
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def spread_out(candidates: np.ndarray, apart: float, most: int) -> np.ndarray:
    """At most ``most`` of the unit vectors, each the farthest from those before it and farther than ``apart``."""
    chosen = [0]
    nearest = angles(candidates, candidates[:1])[:, 0]
    while len(chosen) < most and nearest.max() > apart:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, angles(candidates, candidates[chosen[-1:]])[:, 0])
    return candidates[chosen]


def copied(d: np.ndarray, r: float) -> np.ndarray:
    """Whether each vector goes to each cell, from its angles to the pivots."""
    return d <= d.min(axis=1)[:, None] + 2 * r + EDGE


def worthwhile(sample: np.ndarray, at_home: np.ndarray, pivots: np.ndarray, r: float) -> bool:
    """Whether a cut by the pivots leaves at most ``LEFT`` of the comparisons of homes with members, judged by a sample of the members."""
    if len(pivots) < 2:
        return False
    d = angles(sample, pivots)
    homes = np.bincount(d[at_home].argmin(axis=1), minlength=len(pivots)) / at_home.sum()
    return float((homes * copied(d, r).mean(axis=0)).sum()) <= LEFT


def cells(vectors: DataFrame, r: float) -> DataFrame:
    """``cell``, ``node``, ``home``, ``d`` (angle to the pivot; -1 without), ``weight``, ``v``: every vector at home in one cell and copied to all that its partners may be at home in."""
    vector = vectors.schema["v"].dataType.simpleString()
    rows = vectors.select(F.col("label").alias("cell"), "node", F.lit(True).alias("home"), F.lit(-1.0).alias("d"), "weight", "v")
    schema = f"cell string, node bigint, home boolean, d double, weight bigint, v {vector}"
    whole = []

    def choose(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values("node")
        sample, at_home = unit(some["v"]), some["home"].to_numpy()
        own = spread_out(sample[at_home], r / 2, PIVOTS) if at_home.any() else sample[:0]
        if not worthwhile(sample, at_home, own, r):
            own = own[:0]
        out = pd.DataFrame({"pivot": np.arange(len(own)), "p": pd.Series(list(own), dtype=object)})
        return out.assign(cell=some["cell"].iloc[0], parts=int(some["parts"].iloc[0]))[["cell", "parts", "pivot", "p"]]

    def place(some: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if some.empty:
            return some.reindex(columns=["cell", "node", "home", "d", "weight", "v"])
        d = angles(unit(some["v"]), np.stack(own.sort_values("pivot")["p"].to_numpy()))
        row, pivot = np.nonzero(copied(d, r))
        home = some["home"].to_numpy()[row] & (pivot == d.argmin(axis=1)[row])
        names = np.array([f"{some['cell'].iloc[0]}/{k}" for k in range(d.shape[1])], dtype=object)
        return pd.DataFrame({"cell": names[pivot], "node": some["node"].to_numpy()[row], "home": home, "d": d[row, pivot], "weight": some["weight"].to_numpy()[row], "v": some["v"].to_numpy()[row]})

    for _ in range(DEPTH):
        sizes = rows.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("members"))
        large = materialise(sizes.where(F.col("homes") > CUT).withColumn("parts", F.ceil(F.col("members") / PART).cast("int")), "pivot-large")
        if large.isEmpty():
            break
        chance = F.pmod(F.xxhash64("node", "cell"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        drawn = rows.join(large, "cell").where(chance < SAMPLE / F.col("members"))
        chosen = drawn.select("cell", "parts", "home", "node", "v").groupBy("cell").applyInPandas(lambda some: choose(some), "cell string, parts int, pivot int, p array<double>")
        pivots = materialise(chosen, "pivots")
        if pivots.isEmpty():
            break
        cut = pivots.select("cell", "parts").distinct()
        whole.append(rows.join(cut, "cell", "left_anti"))
        dealt = rows.join(cut, "cell").withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int")).drop("parts")
        sent = pivots.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
        placed = dealt.groupBy("cell", "part").cogroup(sent.groupBy("cell", "part")).applyInPandas(lambda some, own: place(some, own), schema)
        rows = materialise(placed, "pivot-cells")
    for part in whole:
        rows = rows.unionByName(part)
    return rows


def blocks(rows: DataFrame) -> DataFrame:
    """The rows of ``cells``, each in every pair of blocks that it takes part in: ``cell``, ``i``, ``j``, ``both`` and ``side``.

    ``side`` is 1 for what is joined from (its links are counted), 2 for what is joined with, 3 for
    a block that is joined with itself.  With ``both`` links are counted on either side.
    """
    n = lambda c: F.greatest(F.ceil(c * F.col("width") / BLOCK_VALUES), F.lit(1)).cast("int")
    sizes = rows.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("members"), F.max(F.size("v")).alias("width")).where("homes > 0")
    sizes = materialise(sizes.select("cell", (F.col("homes") == F.col("members")).alias("alike"), n(F.col("homes")).alias("hb"), n(F.col("members")).alias("mb")), "pivot-sizes")
    numbered = rows.join(sizes, "cell").withColumn("own_h", F.pmod(F.xxhash64("node"), F.col("hb")).cast("int")).withColumn("own_m", F.pmod(F.xxhash64("node", F.lit(1)), F.col("mb")).cast("int"))
    columns = ["cell", "i", "j", "both", "side", "node", "d", "weight", "v"]
    other = numbered.where("alike").withColumn("o", F.explode(F.expr("sequence(0, hb - 1)")))
    mutual = other.withColumn("i", F.least("own_h", "o")).withColumn("j", F.greatest("own_h", "o")).withColumn("both", F.col("i") < F.col("j"))
    mutual = mutual.withColumn("side", F.when(F.col("i") == F.col("j"), 3).when(F.col("own_h") == F.col("i"), 1).otherwise(2))
    rest = numbered.where("NOT alike").withColumn("both", F.lit(False))
    as_home = rest.where("home").withColumn("i", F.col("own_h")).withColumn("j", F.explode(F.expr("sequence(0, mb - 1)"))).withColumn("side", F.lit(1))
    as_member = rest.withColumn("j", F.col("own_m")).withColumn("i", F.explode(F.expr("sequence(0, hb - 1)"))).withColumn("side", F.lit(2))
    return mutual.select(*columns).unionByName(as_home.select(*columns)).unionByName(as_member.select(*columns))


def block_links(block: pd.DataFrame, min_cosine: float) -> pd.DataFrame:
    """Links of one pair of blocks: (u, v, -1) for the links of a spanning forest, (node, node, n) for the weight that a node links with."""
    r = math.acos(min_cosine)
    block = block.sort_values(["d", "node"])
    side, both = block["side"].to_numpy(), bool(block["both"].iloc[0])
    q, m = side & 1 > 0, side & 2 > 0
    if not q.any() or not m.any():
        return pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})
    node, d, weight, vector = block["node"].to_numpy(), block["d"].to_numpy(), block["weight"].to_numpy(), unit(block["v"])
    (qn, qd, qw, qv), (mn, md, mw, mv) = (tuple(x[own] for x in (node, d, weight, vector)) for own in (q, m))
    n, n_m = np.zeros(len(qn), dtype=np.int64), np.zeros(len(mn), dtype=np.int64)
    us, vs = [], []
    near_q, near_m = ((x >= 0) & (x <= r / 2 - EDGE) for x in (qd, md))
    if near_q.any() and near_m.any():  # within r of each other by the triangle inequality
        n[near_q] += mw[near_m].sum() - np.where(np.isin(qn[near_q], mn[near_m]), qw[near_q], 0)
        n_m[near_m] += qw[near_q].sum()
        us += [qn[near_q], mn[near_m]]
        vs += [np.full(int(near_q.sum()), mn[near_m][0]), np.full(int(near_m.sum()), qn[near_q][0])]
    for at in range(0, len(qn), 128):
        some = slice(at, min(at + 128, len(qn)))
        lo, hi = np.searchsorted(md, qd[some][0] - r - EDGE), np.searchsorted(md, qd[some][-1] + r + EDGE, side="right")
        cosine = qv[some] @ mv[lo:hi].T
        hit = cosine >= min_cosine
        for i, j in np.argwhere(np.abs(cosine - min_cosine) < 1e-12):
            hit[i, j] = math.fsum(qv[some][i] * mv[lo + j]) >= min_cosine
        hit &= (qn[some][:, None] != mn[lo:hi][None, :]) & ~(near_q[some][:, None] & near_m[lo:hi][None, :])
        n[some] += hit @ mw[lo:hi]
        n_m[lo:hi] += qw[some] @ hit
        a, b = _forest(qn[some], mn[lo:hi], hit)
        us.append(a)
        vs.append(b)
    u, v = np.concatenate(us), np.concatenate(vs)
    pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0) if len(u) else np.zeros((0, 2), dtype=np.int64)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    counted = [np.stack([ids[c > 0], ids[c > 0], c[c > 0]], axis=1) for ids, c in ((qn, n), (mn, n_m))][: 1 + both]
    out = np.concatenate([np.column_stack([pairs, np.full(len(pairs), -1)]), *counted])
    return pd.DataFrame(out, columns=["u", "v", "n"])


def links(vectors: DataFrame, min_cosine: float) -> tuple[DataFrame, DataFrame]:
    """Links between entries: ``vectors`` has ``node`` (long), ``label`` (string), ``v`` (array, finite, not zero) and ``weight``.

    Returns (``node``, ``n`` the weight of the other entries linked with it) and (``u``, ``v``
    enough links to join all linked entries).  Pivots travel to the parts of their cell;
    nothing is broadcast or brought to the driver.
    """
    dealt = blocks(cells(vectors, math.acos(min_cosine)))
    # Dealt out by number: by their few bytes, adaptive execution would compare many blocks in one task.
    dealt = dealt.repartition(partitions(vectors.sparkSession), "cell", "i", "j")
    found = dealt.groupBy("cell", "i", "j").applyInPandas(lambda block: block_links(block, min_cosine), "u bigint, v bigint, n bigint")
    found = materialise(found, "pivot-links")
    counts = found.where("n > 0").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    return counts, found.where("n < 0").select("u", "v")


def _forest(left: np.ndarray, right: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the hits: fewer than rows and columns together."""
    us, vs = [], []
    rows = np.flatnonzero(hit.any(axis=1))
    taken = np.zeros(hit.shape[1], dtype=bool)
    while len(rows):
        queue = [rows[0]]
        rows = rows[1:]
        while queue:
            i = queue.pop()
            new = np.flatnonzero(hit[i] & ~taken)
            if not len(new):
                continue
            taken[new] = True
            us.append(np.full(len(new), left[i]))
            vs.append(right[new])
            reached = hit[np.ix_(rows, new)]
            touch = reached.any(axis=1)
            us.append(left[rows[touch]])
            vs.append(right[new[reached[touch].argmax(axis=1)]])
            queue.extend(rows[touch].tolist())
            rows = rows[~touch]
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def range_join(embeddings: DataFrame, min_cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors link if their labels are equal and not null and their cosine, in double precision,
    is at least ``min_cosine`` (over -1).  A vector that is null, empty, zero or holds a null or
    non-finite component links with nothing.  Vectors of different lengths do not link.  Rows
    that repeat are vectors of their own and link with each other.  ``component_id`` is the
    smallest id of the component that is not null; ``kept`` says whether it is the row's own,
    where null equals null: so it is never null, and all rows that share the smallest id have it.
    An empty table gives no rows.
    """
    vector = F.col(vector_col) if embeddings.schema[vector_col].dataType.simpleString() == "array<float>" else F.col(vector_col).cast("array<double>")
    cast = embeddings.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), vector.alias("v"))
    fit = F.coalesce(
        F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0.0),
        F.lit(False),
    )
    rows = materialise(cast.withColumn("fit", fit).withColumn("v", F.when(F.col("fit"), F.col("v"))), "pivot-rows")
    entries = rows.where("fit").groupBy("label", "v").agg(F.count(F.lit(1)).alias("weight"))
    entries = materialise(entries.withColumn("node", F.monotonically_increasing_id()), "pivot-entries")
    flat = entries.select("node", F.to_json(F.struct("label", F.size("v").alias("size"))).alias("label"), "v", "weight")
    counts, pairs = links(flat, min_cosine)
    rooted = entries.join(components(pairs, "pivot"), "node", "left").join(counts, "node", "left")
    rooted = rooted.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    fit_rows = materialise(rows.where("fit").join(rooted, ["label", "v"]).select("vec_id", "n_links", "root"), "pivot-rooted")
    # Written, so that the join below has exchanges of its own, which Spark splits where a component is large.
    smallest = materialise(fit_rows.groupBy("root").agg(F.min("vec_id").alias("component_id")), "pivot-smallest")
    linked = fit_rows.join(smallest, "root").select("vec_id", "n_links", "component_id")
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
