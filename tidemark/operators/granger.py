"""Whether one series' past moves help to foretell the other's: least squares from sums of products."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.tables import numbered

ALIKE = 1e-9  # regressors whose correlations have a smaller eigenvalue say the same
FLAT = 1e-12  # a share of the squares below which nothing varies, or nothing is left over
RESULT = "n long, f_p_leads double, gain_p_leads double, f_k_leads double, gain_k_leads double"


def left_over(s: np.ndarray, x: list[int], y: int) -> float | None:
    """Sum of squares of ``y`` that the regressors ``x`` leave, from centred sums of products; None if they cannot be told apart."""
    d = np.sqrt(np.diag(s)[x])
    r = s[np.ix_(x, x)] / np.outer(d, d)
    if np.linalg.eigvalsh(r)[0] < ALIKE:
        return None
    c = s[x, y] / d
    return float(s[y, y] - c @ np.linalg.solve(r, c))


def improvement(g: np.ndarray, own: list[int], other: list[int], y: int) -> tuple[float | None, float | None]:
    """F statistic of the other series' lags, and the share of what the own lags leave that they explain."""
    n = g[0, 0]
    free = n - 1 - len(own) - len(other)
    s = g - np.outer(g[0], g[0]) / max(n, 1)
    if free < 1 or any(s[i, i] <= FLAT * g[i, i] for i in (*own, *other, y)):
        return None, None
    short, full = left_over(s, own, y), left_over(s, own + other, y)
    if short is None or full is None or full <= FLAT * s[y, y]:
        return None, None
    return (short - full) / len(other) / (full / free), 1 - full / short


def granger(aligned: DataFrame, by: Sequence[str], t: str, p: str, k: str, lags: int = 1, size: int = 100_000) -> DataFrame:
    """An extension: per key both directions of the Granger test on the moves of ``p`` and ``k``, with ``lags`` lags of each.

    ``f_p_leads`` tests whether p's past moves help beyond k's own to foretell k's, ``gain_p_leads`` is the share of what
    is left that they explain; ``f_k_leads`` and ``gain_k_leads`` the other way round.  ``n`` counts the moves used; F has ``lags`` and n - 2 lags - 1
    degrees of freedom.  F and gain are null where those are less than one, where a series does not move, where regressors say
    the same, and where nothing is left over.

    A key is cut into chunks of ``size`` rows (more than lags + 1), each of which also gets the lags + 1 rows before it, so no task
    holds a key; the sums of products of the chunks add up, and only those (a few dozen per key) reach
    the solver.  Rows with a null key, time or price do not count.  Instants must not repeat within a key.
    """
    need = lags + 1
    if lags < 1 or size <= need:
        raise ValueError("lags must be at least 1 and size more than lags + 1")
    known = aligned.select(*by, F.col(t).alias("_t"), F.col(p).cast("double").alias("_p"), F.col(k).cast("double").alias("_k")).dropna()
    at = numbered(known, by, ["_t"], "_i", "granger").withColumn("_own", F.floor(F.col("_i") / size))
    also = F.when(F.col("_i") % size >= size - need, F.col("_own") + 1)
    chunks = at.withColumn("_chunk", F.explode(F.array_compact(F.array("_own", also))))
    order = Window.partitionBy(*by, "_chunk").orderBy("_i")
    moves = chunks.withColumns({f"_d{c}": F.col(f"_{c}") - F.lag(f"_{c}").over(order) for c in "pk"})
    past = {f"_{c}{j}": F.lag(f"_d{c}", j).over(order) for c in "kp" for j in range(1, lags + 1)}
    rows = moves.withColumns(past).where(F.col("_own") == F.col("_chunk")).where(F.col(f"_p{lags}").isNotNull())
    terms = [F.lit(1.0), *[F.col(c) for c in past], F.col("_dk"), F.col("_dp")]
    pairs = list(combinations_with_replacement(range(len(terms)), 2))
    sums = rows.groupBy(*by).agg(F.array(*[F.sum(terms[i] * terms[j]) for i, j in pairs]).alias("_sums"))
    of_k, of_p = list(range(1, lags + 1)), list(range(lags + 1, 2 * lags + 1))

    @F.pandas_udf(RESULT)
    def solved(products: pd.Series) -> pd.DataFrame:
        out = []
        for values in products:
            g = np.empty((len(terms_at), len(terms_at)))
            for (i, j), v in zip(pairs, values, strict=True):
                g[i, j] = g[j, i] = v
            out.append((int(g[0, 0]), *improvement(g, of_k, of_p, len(terms_at) - 2), *improvement(g, of_p, of_k, len(terms_at) - 1)))
        names = [x.split()[0] for x in RESULT.split(", ")]
        return pd.DataFrame(out, columns=names).astype({c: "float64" for c in names[1:]} | {"n": "int64"})

    terms_at = range(2 * lags + 3)
    return sums.select(*by, solved("_sums").alias("_r")).select(*by, "_r.*")
