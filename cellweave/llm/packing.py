"""Packing documents into as few fixed-size sequences as possible, by bin completion on length counts.

How pieces are packed depends on their lengths alone, and a length is at most the capacity. So Spark counts pieces by
length (a table of at most ``capacity`` rows, whatever the corpus), the search runs on those counts, and its answer is a
list of fillings with multiplicities. Every piece then finds its place from its length and its rank among the pieces of
that length: no piece passes through the driver or a single task.

The search takes the longest length left, enumerates undominated fillings of the room beside it, and uses the chosen one
as often as the counts allow. Best-fit decreasing gives the first incumbent; a branch is left once its waste so far
exceeds what a better packing than the incumbent could afford.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import batch_of, id_and_text, small_batches
from cellweave.llm.tokenizing import encoder, text_list
from cellweave.session import forget, stored

#: Fillings tried per longest length, search steps per filling list, and steps over the whole search. They bound the
#: time of the search on at most ``capacity`` counts; every piece is packed whatever they are.
BRANCH, FILL_STEPS, SEARCH_STEPS = 3, 400, 5_000

Filling = tuple[int, tuple[tuple[int, int], ...]]


def _fillings(counts: np.ndarray, longest: int, capacity: int) -> list[Filling]:
    """Undominated fillings (waste, ((length, copies), ...)) with ``longest`` inside, least waste first, longest items first."""
    room = capacity - longest
    lengths = np.flatnonzero(counts[:room + 1])
    lengths = lengths[lengths > 0]
    left = {int(v): int(counts[v]) for v in lengths}
    if longest in left:
        left[longest] -= 1
    found: list[tuple[int, tuple[int, ...]]] = []
    steps = 0

    def below(limit: int):
        """Available lengths up to a limit, longest first."""
        i = int(np.searchsorted(lengths, limit, side="right")) - 1
        while i >= 0:
            v = int(lengths[i])
            if left[v] > 0:
                yield v
            i -= 1

    def grow(free: int, limit: int, items: tuple[int, ...]) -> bool:
        nonlocal steps
        steps += 1
        if left.get(free, 0) > 0 and free <= limit:
            found.append((0, items + (free,)))
            return True
        closed = True
        for v in below(min(free, limit)):
            closed = False
            left[v] -= 1
            done = grow(free - v, v, items + (v,))
            left[v] += 1
            if done or steps > FILL_STEPS:
                return done
        if closed and next(below(free), None) is None:
            found.append((free, items))
        return False

    grow(room, room, ())
    if not found:
        found.append((room, ()))
    keep = []
    for waste, items in sorted(found, key=lambda f: (f[0], -max(f[1], default=0))):
        chosen = Counter(items)
        # Dominated: one item could be replaced by a longer one that is still there and fits into the waste.
        if waste and any(left.get(v, 0) - chosen.get(v, 0) > 0 for i in chosen for v in range(i + 1, i + waste + 1)):
            continue
        keep.append((waste, tuple(sorted((chosen + Counter([longest])).items(), reverse=True))))
        if len(keep) == BRANCH:
            break
    return keep or [(found[0][0], tuple(sorted((Counter(found[0][1]) + Counter([longest])).items(), reverse=True)))]


def _best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, tuple]]:
    """Best-fit decreasing on counts: beside the longest length left, again and again the longest that fits."""
    left, plan = counts.copy(), []
    top = len(left) - 1
    while True:
        while top > 0 and left[top] == 0:
            top -= 1
        if top <= 0:
            return plan
        items, free = Counter([top]), capacity - top
        left[top] -= 1
        while free > 0:
            fit = np.flatnonzero(left[:free + 1])
            if not len(fit) or fit[-1] == 0:
                break
            v = int(fit[-1])
            n = min(int(left[v]), free // v)
            items[v] += n
            left[v] -= n
            free -= n * v
        for v, n in items.items():
            left[v] += n
        times = min(int(left[v]) // n for v, n in items.items())
        for v, n in items.items():
            left[v] -= times * n
        plan.append((times, tuple(sorted(items.items(), reverse=True))))


def least_bins(counts: np.ndarray, capacity: int) -> int:
    """Lower bound: for each k, what is longer than capacity - k stands alone, and what is shorter than k is left out."""
    v = np.arange(len(counts))
    n, s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * v)])
    half, top = capacity // 2 + 1, len(counts)
    best = 0
    for k in range(half):
        edge = min(max(capacity - k + 1, half), top)
        alone, large = n[top] - n[edge], n[edge] - n[half]
        spare = large * capacity - (s[edge] - s[half])
        best = max(best, int(alone + large + max(0, -(-(s[half] - s[k] - spare) // capacity))))
    return best


def plan_fillings(counts: np.ndarray, capacity: int) -> list[tuple[int, tuple]]:
    """Fillings with multiplicities that use up ``counts`` (pieces by length, index 0 unused) in as few bins as found."""
    counts = counts.astype(np.int64)
    total = int((counts * np.arange(len(counts))).sum())
    least = least_bins(counts, capacity)
    best = _best_fit(counts, capacity)
    best_bins = sum(t for t, _ in best)
    # Each frame: counts left, top length, fillings still to try, plan length before it, waste before it.
    plan: list[tuple[int, tuple]] = []
    stack = [(counts.copy(), len(counts) - 1, None, 0, 0)]
    steps = 0
    while stack and best_bins > least and steps < SEARCH_STEPS:
        left, top, todo, depth, waste = stack.pop()
        del plan[depth:]
        if todo is None:
            while top > 0 and left[top] == 0:
                top -= 1
            if top <= 0:
                bins = sum(t for t, _ in plan)
                if bins < best_bins:
                    best, best_bins = list(plan), bins
                continue
            todo = _fillings(left, top, capacity)
            steps += 1
        filling, rest = todo[0], todo[1:]
        if rest:
            stack.append((left, top, rest, depth, waste))
        times = min(int(left[v]) // n for v, n in filling[1])
        spent = waste + times * filling[0]
        if spent > (best_bins - 1) * capacity - total:
            continue
        after = left.copy()
        for v, n in filling[1]:
            after[v] -= times * n
        plan.append((times, filling[1]))
        stack.append((after, top, None, depth + 1, spent))
    return best


def placements(plan: list[tuple[int, tuple]]) -> np.ndarray:
    """Rows (length, first rank, end rank, first sequence, copies per sequence, offset in it) sorted by length and rank."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for times, items in plan:
        offset = 0
        for length, copies in items:
            rows.append((length, used[length], used[length] + times * copies, sequence, copies, offset))
            used[length] += times * copies
            offset += length * copies
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint"


def cut_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    """Encoded documents cut into pieces of at most ``capacity`` tokens; ``rank`` counts equal lengths within a task."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
              ("part", pa.int32()), ("rank", pa.int64())] + [("ids", pa.binary())] * keep_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ranks, own = TaskContext.get().partitionId(), Counter(), encoder(path)
        for batch in small_batches(batches):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), own.encode(text_list(batch.column("text")), end_id)):
                for k in range(0, len(ids), 4 * capacity):
                    piece = ids[k:k + 4 * capacity]
                    n = len(piece) // 4
                    rows.append((doc, k // (4 * capacity), k // 4, n, zlib.crc32(piece), part, ranks[n]) + (piece,) * keep_ids)
                    ranks[n] += 1
            if rows:
                yield batch_of(schema, *zip(*rows))

    return id_and_text(docs, id_col, text_col).mapInArrow(run, _PIECES + ", ids binary" * keep_ids)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
         keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if wanted).

    Each document is encoded, ended by ``end_id`` and, only if longer than ``capacity``, cut into pieces of that size. A
    null or empty text is a document of one token. Rows with repeated or null ids are packed like any other row; other
    columns are ignored. Sequences are filled without gaps from offset 0; an empty table gives an empty result.
    """
    pieces = stored(cut_pieces(docs, path, capacity, end_id, id_col, text_col, keep_ids), "pieces", "zstd")
    own = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in own.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    full = int(counts[capacity])
    counts[capacity] = 0
    plan = plan_fillings(counts, capacity)
    table = placements([(full, ((capacity, 1),))] * bool(full) + plan)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = stored(own.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "ranks")
    places = docs.sparkSession.sparkContext.broadcast(table)  # at most a few rows per length
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    ranked = pieces.join(base, ["part", "length"]).select(*kept, (F.col("rank") + F.col("before")).alias("rank"))
    schema = pa.schema([(c, ranked_type) for c, ranked_type in zip(kept, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                       + [("sequence_id", pa.int64()), ("offset", pa.int64())])
    types = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = places.value
        key = rows[:, 0] * (1 << 44) + rows[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = rows[np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1]
            nth = rank - at[:, 1]
            yield batch_of(schema, *(batch.column(c) for c in kept), at[:, 3] + nth // at[:, 4], at[:, 5] + nth % at[:, 4] * length)

    out = ranked.mapInArrow(place, types + ", sequence_id bigint, offset bigint")
    forget(own)
    return out


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (binary, little-endian unsigned 32 bit) from the result of ``pack(..., keep_ids=True)``.

    A sequence holds at most ``capacity`` tokens, so a group is bounded.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(
        parts, F.to_binary(F.lit(""), F.lit("utf-8")), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
