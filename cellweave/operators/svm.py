"""Linear SVMs for every pair of groups at once.

Each pair minimises λ/2·‖w‖² plus the mean squared hinge loss by Newton steps. One pass over the packed points gives loss,
gradient and Hessian of all pairs: a point takes part in the pairs of its own group only. A step that does not lower the
loss is halved. The number of jobs is that of the rounds, not of the pairs; pairs go in slices if their Hessians do not
fit in a driver-side model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.partials import PARTS, block_sums, packed_blocks
from cellweave.model import MAX_MODEL_VALUES

#: Weight of ‖w‖²; the gradient at which a pair has converged; rounds at most.
RIDGE, TOLERANCE, ROUNDS = 0.01, 1e-9, 100


@dataclass
class PairModels:
    """Weights of each pair (i, j), i < j, of group positions: w·x + b > 0 says j. The last weight is b."""

    pairs: np.ndarray
    weights: np.ndarray
    slope: np.ndarray  # largest component of the gradient
    rounds: int = 0


def all_pairs(groups: int) -> np.ndarray:
    return np.stack(np.triu_indices(groups, 1), axis=1)


def _own_pairs(code: np.ndarray, pairs: np.ndarray):
    """For each group in ``code``: its rows, its pairs and its side (−1 or 1) in each."""
    for g in np.unique(code):
        own = np.flatnonzero((pairs == g).any(axis=1))
        if len(own):
            yield np.flatnonzero(code == g), own, np.where(pairs[own, 1] == g, 1.0, -1.0)


def pair_sums(x: np.ndarray, code: np.ndarray, pairs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per pair: Σ loss, Σ gradient (q), Σ Hessian (q²) and rows, over the rows of its two groups. x ends with ones."""
    q = x.shape[1]
    out = np.zeros((len(pairs), 2 + q + q * q))
    for rows, own, side in _own_pairs(code, pairs):
        y = x[rows]
        short = 1.0 - (y @ weights[own].T) * side
        for k, m in enumerate(own):
            active = short[:, k] > 0
            a, s = y[active], short[active, k]
            out[m, 0] += s @ s
            out[m, 1:1 + q] += -2.0 * side[k] * (s @ a)
            out[m, 1 + q:-1] += 2.0 * (a.T @ a).ravel()
            out[m, -1] += len(rows)
    return out


def pair_hits(x: np.ndarray, code: np.ndarray, pairs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per pair: rows on their own side, rows."""
    out = np.zeros((len(pairs), 2))
    for rows, own, side in _own_pairs(code, pairs):
        value = x[rows] @ weights[own].T
        out[own, 0] += np.where(side > 0, value > 0, value <= 0).sum(axis=0)
        out[own, 1] += len(rows)
    return out


def _unpacked(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.hstack([block[:, 1:], np.ones((len(block), 1))]), block[:, 0].astype(np.int64)


def _packed(rows: DataFrame, code: str, vec: str) -> DataFrame:
    return packed_blocks(rows.select(F.concat(F.array(F.col(code).cast("double")), F.col(vec)).alias("x")), "x").persist(StorageLevel.MEMORY_AND_DISK)


def _slices(pairs: np.ndarray, width: int) -> list[np.ndarray]:
    step = max(1, MAX_MODEL_VALUES // (2 * width))
    return [pairs[i:i + step] for i in range(0, len(pairs), step)]


def fit_pairs(rows: DataFrame, code: str, vec: str, p: int, groups: int, ridge: float = RIDGE) -> PairModels:
    """Models of all pairs of groups 0 … groups − 1. A pair without rows keeps zero weights."""
    q = p + 1
    blocks = _packed(rows, code, vec)
    many = blocks.rdd.getNumPartitions() > PARTS
    free = np.append(np.full(p, ridge), 0.0)  # the offset is not shrunk
    done: list[PairModels] = []
    for pairs in _slices(all_pairs(groups), 2 + q + q * q):
        w = np.zeros((len(pairs), q))
        base, low = w.copy(), np.full(len(pairs), np.inf)
        slope = np.full(len(pairs), np.inf)
        live, turn = np.arange(len(pairs)), 0
        while len(live) and turn < ROUNDS:
            turn += 1
            asked, at = pairs[live], w[live]
            sums = block_sums(blocks, q, lambda b: pair_sums(*_unpacked(b), asked, at), len(live), 2 + q + q * q, many)
            n = np.maximum(sums[:, -1], 1.0)
            loss = sums[:, 0] / n + 0.5 * (free * at * at).sum(axis=1)
            going = []
            for k, m in enumerate(live):
                if loss[k] > low[m] + 1e-13 * abs(low[m]):
                    if np.abs(w[m] - base[m]).max() < 1e-14:  # rounding, not descent
                        w[m] = base[m]
                        continue
                    w[m] = (w[m] + base[m]) / 2
                    going.append(m)
                    continue
                g = sums[k, 1:1 + q] / n[k] + free * w[m]
                low[m], base[m], slope[m] = loss[k], w[m].copy(), np.abs(g).max()
                if slope[m] > TOLERANCE:
                    h = sums[k, 1 + q:-1].reshape(q, q) / n[k] + np.diag(free + 1e-10)
                    w[m] = w[m] - np.linalg.solve(h, g)
                    going.append(m)
            live = np.array(going, dtype=np.int64)
        done.append(PairModels(pairs, np.where(np.isfinite(low)[:, None], base, w), slope, turn))
    blocks.unpersist()
    if not done:
        return PairModels(all_pairs(groups), np.zeros((0, q)), np.zeros(0))
    return PairModels(np.vstack([d.pairs for d in done]), np.vstack([d.weights for d in done]), np.concatenate([d.slope for d in done]), max(d.rounds for d in done))


def count_hits(rows: DataFrame, code: str, vec: str, p: int, models: PairModels) -> np.ndarray:
    """(rows on their own side, rows) of each pair over all rows of its groups: one pass."""
    blocks = packed_blocks(rows.select(F.concat(F.array(F.col(code).cast("double")), F.col(vec)).alias("x")), "x")
    pairs, weights = models.pairs, models.weights
    return block_sums(blocks, p + 1, lambda b: pair_hits(*_unpacked(b), pairs, weights), len(pairs), 2)
