import numpy as np
import pytest

from tidemark.llm import pivots

from .test_graph_simhash import union_find


def brute(rows, c):
    fit = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for a in range(len(fit)):
        for b in range(a):
            i, j = fit[a], fit[b]
            x, y = (np.array(rows[k][1], dtype=np.float32).astype(float) for k in (i, j))
            if rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= c:
                links.append((i, j))
    roots = union_find(range(len(rows)), links)
    least = {}
    for i, r in roots.items():
        known = [x for x in (least.get(r), rows[i][0]) if x is not None]
        least[r] = min(known, default=None)
    n = [0] * len(rows)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    return sorted(((rows[i][0], n[i], least[roots[i]], rows[i][0] == least[roots[i]]) for i in range(len(rows))), key=str)


def found(spark, rows, c=0.93):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS node", "2.0 AS d", "3 AS weight", "4 AS v")
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in pivots.range_join(df, c).collect()), key=str)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, None, 0), (5, [0.0, 0.0], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [1.0, None], 0), (9, [1.0, 0.0], None), (10, [], 0), (11, [1.0, 0.0, 0.0], 0), (12, [1.0, 0.1], 0), (13, [1e-30, 0.0], 0), (14, [1e30, 1e29], 0)]
    assert found(spark, rows) == brute(rows, 0.93)
    assert found(spark, []) == []


def test_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 0.0], 0), (5, [1.0, 0.01], 0), (5, [1.0, 0.01], 0), (None, [0.0, 1.0], 0), (None, [0.01, 1.0], 0), (7, [1.0, 0.0], 0), (None, None, 0), (8, None, None)]
    assert found(spark, rows) == brute(rows, 0.93)


@pytest.mark.parametrize("cosine", [0.93, 0.6])
def test_cells_blocks_and_dense_groups(spark, cosine, monkeypatch):
    monkeypatch.setattr(pivots, "CUT", 64)
    monkeypatch.setattr(pivots, "BLOCK_VALUES", 64 * 8)
    monkeypatch.setattr(pivots, "PIVOTS", 8)
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(6, 8))
    rows = [(i, (centre[i % 6] * (i % 2) + rng.normal(size=8) * 0.6).tolist(), 0) for i in range(500)]
    rows += [(1000 + i, (centre[0] + rng.normal(size=8) * 0.02).tolist(), 0) for i in range(300)]  # near copies
    rows += [(2000 + i, centre[1].tolist(), 0) for i in range(100)]  # copies
    rows += [(3000 + i, rng.normal(size=8).tolist(), 1) for i in range(40)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert found(spark, rows, cosine) == brute(rows, cosine)


def test_cells_are_cut_again_where_that_pays_and_only_there(spark, monkeypatch):
    monkeypatch.setattr(pivots, "CUT", 32)
    monkeypatch.setattr(pivots, "BLOCK_VALUES", 32 * 24)
    monkeypatch.setattr(pivots, "PIVOTS", 8)
    rng = np.random.default_rng(3)
    own = [[np.eye(24)[k] + 0.5 * x / np.linalg.norm(x) for x in rng.normal(size=(6, 24))] for k in range(8)]  # groups of groups
    grouped = [(i, (own[i % 8][i // 8 % 6] + rng.normal(size=24) * 0.01).tolist(), 0) for i in range(1200)]
    scattered = [(5000 + i, rng.normal(size=24).tolist(), 1) for i in range(300)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in grouped + scattered]
    assert found(spark, rows, 0.99) == brute(rows, 0.99)
    df = spark.createDataFrame(rows, "node long, v array<float>, l long").selectExpr("node", "v", "CAST(l AS STRING) AS label", "1L AS weight")
    placed = pivots.cells(df, float(np.arccos(0.99))).collect()
    depth = {label: max(r.cell.count("/") for r in placed if r.cell.split("/")[0] == label) for label in ("0", "1")}
    assert depth["0"] >= 2 and depth["1"] == 0
    assert sum(r.home for r in placed) == len(rows)
    assert sum(r.cell.startswith("0") for r in placed) < 2 * 1200  # copies of vectors in groups
