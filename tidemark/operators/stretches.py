"""The divergence rule on stretches of a key's grid, as maps from entering to leaving state.

What an instant means depends on the runs before it, so the rule is a fold over a key.  A
stretch of the grid is folded without knowing what came before: from every instant of it, cold,
the rule has one way on (to the instant after a broken run, or after the window that a
confirmed run opens), so all ways are pointers to later instants, and those that meet leave the
stretch alike.  A state that enters either has a run under way, which the first instants
continue, confirm or break, or a window that ends at some time, which picks the first instant after it.
The map of a stretch is therefore a few first instants and a list of leaving states by the
time up to which they hold; entering states follow from applying the maps in order.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

LONG_AGO = -(1 << 62)


@dataclass
class State:
    """A run under way (its length, sign and first instant), or none and the end of the window in which nothing counts."""

    length: int = 0
    sign: int = 0
    t: int = 0
    p: float = 0.0
    k: float = 0.0
    until: int = LONG_AGO


@dataclass
class Stretch:
    """The map of one stretch: ``head`` are the times and signs (0: no divergence) of its first ``need`` instants, ``upto`` and ``leaving`` the states by the window's end."""

    n: int
    head_t: list[int]
    head_sign: list[int]
    upto: list[int]
    leaving: list[State]


def runs(t: np.ndarray, p: np.ndarray, k: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The sign of each instant (0 where the gap is too small) and how many in a row from it on have the same."""
    gap = k - p
    sign = np.where(np.abs(gap) >= threshold, np.sign(gap), 0).astype(np.int64)
    ends = np.flatnonzero(np.r_[sign[1:] != sign[:-1], True])
    return sign, ends[np.searchsorted(ends, np.arange(len(t)))] - np.arange(len(t)) + 1


def onward(t: np.ndarray, sign: np.ndarray, run: np.ndarray, need: int, window: int) -> np.ndarray:
    """From each instant, cold, the instant at which the rule is cold again; the number of instants if that is not in the stretch."""
    n, i = len(t), np.arange(len(t))
    after_window = np.maximum(np.searchsorted(t, t + window, side="right"), i + need)
    return np.minimum(np.where(sign == 0, i + 1, np.where(run >= need, after_window, i + run + 1)), n)


def folded(t: np.ndarray, p: np.ndarray, k: np.ndarray, threshold: float, need: int, window: int) -> Stretch:
    """The map of a stretch whose instants are in order, each once, with both sides seen."""
    n = len(t)
    sign, run = runs(t, p, k, threshold)
    to = onward(t, sign, run, need, window).tolist()
    last = list(range(n))  # the instant from which the rule leaves the stretch
    for i in range(n - 1, -1, -1):
        if to[i] < n:
            last[i] = last[to[i]]
    ends = [i for i in range(n) if i + 1 == n or last[i] != last[i + 1]]
    leaving = []
    for i in (last[e] for e in ends):
        if sign[i] and run[i] >= need:
            leaving.append(State(until=int(t[i]) + window))
        elif sign[i] and i + run[i] == n:
            leaving.append(State(int(run[i]), int(sign[i]), int(t[i]), float(p[i]), float(k[i])))
        else:
            leaving.append(State())
    return Stretch(n, t[:need].tolist(), sign[:need].tolist(), t[ends].tolist(), leaving)


def applied(stretch: Stretch, state: State, need: int, window: int) -> State:
    """The state with which a stretch is left."""
    until = state.until
    if state.length:
        seen = 0
        while seen < len(stretch.head_t) and state.length + seen < need and stretch.head_sign[seen] == state.sign:
            seen += 1
        if state.length + seen >= need:
            until = max(state.t + window, stretch.head_t[seen - 1])  # what the run has used does not count again
        elif seen == stretch.n:
            return State(state.length + seen, state.sign, state.t, state.p, state.k)
        else:
            until = stretch.head_t[seen]
    at = bisect_right(stretch.upto, until)
    return stretch.leaving[at] if at < len(stretch.upto) else State(until=until)


def groups(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """Keys and the other columns of each group of rows that come sorted by their keys; a group may span batches."""
    key, parts = None, []
    for batch in batches:
        names = list(zip(*(c.to_pylist() for c in batch.columns[:n_keys]), strict=True))
        values = [c.to_numpy(zero_copy_only=False) for c in batch.columns[n_keys:]]
        begin = 0
        while begin < len(names):
            end = begin
            while end < len(names) and names[end] == names[begin]:
                end += 1
            if names[begin] != key:
                if parts:
                    yield key, [np.concatenate(x) for x in zip(*parts, strict=True)]
                key, parts = names[begin], []
            parts.append([v[begin:end] for v in values])
            begin = end
    if parts:
        yield key, [np.concatenate(x) for x in zip(*parts, strict=True)]


MAP = "_n bigint, _head_t array<bigint>, _head_sign array<bigint>, _upto array<bigint>, _len array<bigint>, _sign array<bigint>, _t array<bigint>, _p array<double>, _k array<double>, _until array<bigint>"
STATE = "_len bigint, _sign bigint, _t bigint, _p double, _k double, _until bigint"
_LONGS, _DOUBLES = pa.list_(pa.int64()), pa.list_(pa.float64())
MAP_TYPES = [pa.int64(), *[_LONGS] * 6, *[_DOUBLES] * 2, _LONGS]
STATE_TYPES = [*[pa.int64()] * 3, *[pa.float64()] * 2, pa.int64()]


def fields(state: State) -> tuple:
    return state.length, state.sign, state.t, state.p, state.k, state.until


def rows_of(stretch: Stretch) -> tuple:
    states = list(zip(*map(fields, stretch.leaving), strict=True)) or [()] * 6
    return stretch.n, stretch.head_t, stretch.head_sign, stretch.upto, *[list(x) for x in states]


def stretch_of(row: Sequence) -> Stretch:
    n, head_t, head_sign, upto, *states = row
    return Stretch(n, head_t, head_sign, upto, [State(*x) for x in zip(*states, strict=True)])
