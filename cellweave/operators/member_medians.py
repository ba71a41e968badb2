"""Exact medians of the members of clusters by counting passes over packed points.

A pass counts the members of each cluster below a few edges, per feature, with the smallest and largest value between two
edges. The first edges lie ever closer around the old centre; the bin that holds the middle ranks is cut again until it holds
one value or few enough to be sent. Neither the values nor the groups are shuffled, and the edges do not change the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.model import check_model_size

#: Edges of a pass per cluster and feature, and of all together; values of a bin that are sent instead of cut again.
EDGES, ALL_EDGES, SENT = 240, 200_000, 512
#: The row of a pass that carries changed points and summed distances.
TOTALS = -1


def _around(centre: float, edges: int) -> np.ndarray:
    """Edges at distances that shrink from far to near, with a bin for the centre itself."""
    steps = max(abs(centre), 1.0) * np.exp2(np.linspace(-36.0, 12.0, max(1, edges // 2)))
    return np.unique(np.concatenate([centre - steps, [centre, np.nextafter(centre, np.inf)], centre + steps]))


def _between(low: float, high: float, edges: int) -> np.ndarray:
    """Edges within [low, high], of which the last parts off the largest value."""
    return np.unique(np.concatenate([[low], np.linspace(low, high, edges + 1)[1:-1], [high]]))


def _combined(parts: list[tuple], total: bool) -> tuple:
    n, low, high, values = (list(x) for x in zip(*parts))
    return (np.sum(n, axis=0), np.sum(low, axis=0) if total else np.min(low, axis=0),
            high[0] if total else np.max(high, axis=0), np.concatenate(values))


def _rows(held: dict[int, tuple]) -> pa.RecordBatch:
    slots = sorted(held)
    lists = [pa.array([held[s][i].tolist() for s in slots], pa.list_(t)) for i, t in enumerate((pa.int64(), pa.float64(), pa.float64(), pa.float64()))]
    return pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), *lists], names=["slot", "n", "low", "high", "vals"])


def _read(found: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, tuple]]:
    columns = [found.column(i).to_pylist() for i in range(5)]
    for slot, n, low, high, values in zip(*columns):
        yield slot, (np.array(n, dtype=np.int64), np.array(low), np.array(high), np.array(values))


_SCHEMA = "slot int, n array<bigint>, low array<double>, high array<double>, vals array<double>"


def _pass(blocks: DataFrame, features: int, label: Callable[[np.ndarray], tuple[np.ndarray, float, int]], cuts: dict[int, np.ndarray],
          sent: dict[int, tuple[float, float]]) -> dict[int, tuple]:
    """Per slot (cluster · features + feature): counts, least and largest values between its cuts, and the values to be sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {s: (np.zeros(len(e) + 1, dtype=np.int64), np.full(len(e) + 1, np.inf), np.full(len(e) + 1, -np.inf), np.empty(0)) for s, e in cuts.items()}
        kept: dict[int, list] = {s: [] for s in sent}
        inertia, changed = 0.0, 0
        for batch in batches:
            for raw in batch.column(0):
                x = np.frombuffer(raw.as_buffer(), dtype=float).reshape(-1, features)
                labels, low, moved = label(x)
                inertia, changed = inertia + low, changed + moved
                members = {c: x[labels == c] for c in {s // features for s in (*cuts, *sent)}}
                for s, edges in cuts.items():
                    v = np.sort(members[s // features][:, s % features])
                    at = np.concatenate([[0], np.searchsorted(v, edges, "left"), [len(v)]])
                    some = np.flatnonzero(np.diff(at))
                    n, least, largest, _ = held[s]
                    n += np.diff(at)
                    least[some] = np.minimum(least[some], v[at[some]])
                    largest[some] = np.maximum(largest[some], v[at[some + 1] - 1])
                for s, (a, b) in sent.items():
                    v = members[s // features][:, s % features]
                    kept[s].append(v[(v >= a) & (v <= b)])
        empty = np.empty(0)
        for s, values in kept.items():
            held[s] = (np.empty(0, dtype=np.int64), empty, empty, np.concatenate(values) if values else empty)
        held[TOTALS] = (np.array([changed]), np.array([inertia]), empty, empty)
        yield _rows(held)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for slot, own in _read(batch):
                held[slot] = _combined([held[slot], own], slot == TOTALS) if slot in held else own
        if held:
            yield _rows(held)

    return dict(_read(blocks.mapInArrow(run, _SCHEMA).repartition(F.col("slot")).mapInArrow(combine, _SCHEMA).toArrow()))


def _middle(lo: float, hi: float, n: int) -> float:
    return lo if lo == hi else lo + (hi - lo) * (0.5 * (n - 1) - (n - 1) // 2)


def member_medians(blocks: DataFrame, centres: np.ndarray, previous: np.ndarray | None,
                   distances: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, float, int]:
    """Medians of the points nearest to each centre (k×p, NaN without members), their summed distances, and the points that
    were nearest to another of the ``previous`` centres (all, if there are none)."""
    k, p = centres.shape
    check_model_size(k * p, "centroids")
    edges = max(4, min(EDGES, ALL_EDGES // (k * p)))

    def label(x: np.ndarray) -> tuple[np.ndarray, float, int]:
        d = distances(x, centres)
        best = d.argmin(axis=1)
        moved = len(x) if previous is None else int((distances(x, previous).argmin(axis=1) != best).sum())
        return best, float(d[np.arange(len(x)), best].sum()), moved

    out, sizes = np.full((k, p), np.nan), np.zeros(k, dtype=np.int64)
    below: dict[int, int] = {}
    cuts = {s: _around(float(centres.flat[s]), edges) for s in range(k * p)}
    sent: dict[int, tuple[float, float]] = {}
    totals = None
    while cuts or sent:
        found = _pass(blocks, p, label, cuts, sent)
        if not found:
            return out, 0.0, 0
        totals = totals or found[TOTALS]
        now, cuts, sent = (cuts, sent), {}, {}
        for s in now[1]:
            n, v = int(sizes[s // p]), np.sort(found[s][3])
            out.flat[s] = _middle(v[(n - 1) // 2 - below[s]], v[n // 2 - below[s]], n)
        for s in now[0]:
            count, low, high, _ = found[s]
            n = sizes[s // p] = int(count.sum())
            if not n:
                continue
            upto = np.cumsum(count)
            i, j = np.searchsorted(upto, [(n - 1) // 2, n // 2], "right")
            if i != j or low[i] == high[i]:
                out.flat[s] = _middle(high[i], low[j], n)
            elif count[i] <= SENT:
                sent[s], below[s] = (low[i], high[i]), int(upto[i] - count[i])
            else:
                cuts[s] = _between(low[i], high[i], edges)
    return out, float(totals[1][0]), int(totals[0][0])
