"""Periodic runs of words: stretches that repeat themselves with a period, and texts without the repeats.

A sparse dynamic program over diagonals: word i and an earlier occurrence i - q of it lie on the diagonal of lag q, and
an occurrence next to one that is active on its diagonal makes that match one word longer. A diagonal that is not carried
on has ended; with m words matched it spans m + q words of period q, and if that is long enough the run is emitted.

Occurrences are sparse because a run of three periods or more must match at least ``2 * q`` words, and 16 or more.
So a word is looked at with the W words that begin at it, W being the power of two (16 at least) with W / 2 < q <= W,
and only its latest earlier occurrence among equal W words counts. Nothing is lost: within a run of smallest period q <= W
the latest earlier occurrence lies exactly q words back, and what has a smaller period than its lag finds a nearer one, so
that every diagonal that ends long enough is a run with its smallest period, from end to end. Each level sorts what the
level before has left, so texts take n log n steps, also where one word fills a long text.

Words are compared by 64-bit hashes. Rows are taken as they come, without a shuffle; a task holds a few megabytes of text
or one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import small_batches, texts_as_words, window_hashes

#: A run holds at least so many words and so many periods.
MIN_WORDS, MIN_PERIODS = 24, 3
#: Words that begin at a place are compared at once on the lowest level.
BASE = 16
_MIX = np.uint64(0xD6E8FEB86659FD93)
_RUN = "struct<start:bigint,length:bigint,period:bigint>"


def occurrences(words: np.ndarray, ends: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> tuple[np.ndarray, ...]:
    """(place, lag, width) of the earlier occurrences that can lie in a run, of texts that stand one after another.

    ``ends`` holds the offsets of the texts. Sorted by place within each width.
    """
    n, sizes = len(words), np.diff(ends)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left = ends[1:][owner] - np.arange(n)
    base = min(BASE, max(1, min_words - min_words // min_periods))
    out: list[tuple[np.ndarray, ...]] = []
    twice = np.ones(n, dtype=bool)
    longest = int(sizes.max(initial=0))
    width = base
    while (width == base or (width // 2 + 1) * min_periods <= longest) and n >= width:
        # How many places from here on have been seen twice on the level before.
        gaps = np.flatnonzero(~twice)
        reach = np.full(n, n) if not len(gaps) else np.append(gaps, n)[np.searchsorted(gaps, np.arange(n))]
        need = 1 if width == base else width - base + 1
        at = np.flatnonzero(twice & (left >= width) & (reach - np.arange(n) >= need))
        if not len(at):
            break
        grams = window_hashes(words, width)[at] ^ (owner[at].astype(np.uint64) * _MIX)
        order = np.argsort(grams, kind="stable")
        same = grams[order][1:] == grams[order][:-1]
        now, before = at[order][1:][same], at[order][:-1][same]
        if width == base:
            twice = np.zeros(n, dtype=bool)
            twice[now] = twice[before] = True
        lag = now - before
        near = (lag <= width) & ((lag > width // 2) | (width == base))
        found = np.argsort(now[near], kind="stable")
        out.append((now[near][found], lag[near][found], np.full(len(found), width)))
        width *= 2
    if not out:
        return (np.empty(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out))


def _ended(place: int, lag: int, matched: int, min_words: int, min_periods: int) -> tuple[int, int, int] | None:
    """(start, length, period) of the run on a diagonal whose match of so many words began at ``place``; None if too short."""
    length = matched + lag
    return (place - lag, length, lag) if length >= max(min_words, min_periods * lag) else None


def runs_of(words: np.ndarray, ends: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (start, length, period) by text, in the order of start, then period; texts without a run have no entry."""
    found: list[tuple[int, int, int]] = []
    places, lags, widths = occurrences(words, ends, min_words, min_periods)
    active: dict[int, list[int]] = {}  # lag: [first place, latest place, words matched from the first on]
    for i, lag, width in zip(places.tolist(), lags.tolist(), widths.tolist()):
        on = active.get(lag)
        if on is not None and on[1] == i - 1:
            on[1] = i
            on[2] += 1
            continue
        if on is not None and (run := _ended(on[0], lag, on[2], min_words, min_periods)):
            found.append(run)
        active[lag] = [i, i, width]
    for lag, (first, _, matched) in active.items():
        if run := _ended(first, lag, matched, min_words, min_periods):
            found.append(run)
    out: dict[int, list[tuple[int, int, int]]] = {}
    for start, length, period in sorted(found, key=lambda r: (r[0], r[2])):
        text = int(np.searchsorted(ends, start, side="right")) - 1
        out.setdefault(text, []).append((start - int(ends[text]), length, period))
    return out


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds beyond its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def highest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with most periods, the earliest, then the shortest period of equals."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                  min_periods: int = MIN_PERIODS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start, then period), highest (the run with most periods,
    or null) and collapsed (the words kept, joined by one space) of every row.

    A word is a run of characters other than ASCII white space. A null text counts as empty: no words, no runs, an empty
    collapsed text. Rows that repeat an id are rows of their own; a null id stays null. Other columns are ignored; an empty
    table gives an empty result. ``min_periods`` is 3 or more.
    """
    if min_periods < 3:
        raise ValueError("runs of fewer than three periods are not looked for")
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run_type)), ("highest", run_type), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2 << 20):
            column = batch.column("text")
            words, ends = texts_as_words(column)
            runs = runs_of(words, ends, min_words, min_periods)
            sizes = np.diff(ends)
            texts = []
            for i in range(len(sizes)):
                own = column[i].as_buffer().to_pybytes().split()  # bytes split at ASCII white space only
                if i in runs:
                    keep = kept_words(len(own), runs[i])
                    own = [own[k] for k in np.flatnonzero(keep).tolist()]
                texts.append(b" ".join(own))
            lists = [[dict(zip(("start", "length", "period"), r)) for r in runs.get(i, [])] for i in range(len(sizes))]
            best = [dict(zip(("start", "length", "period"), highest(runs[i]))) if i in runs else None for i in range(len(sizes))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(run_type)), pa.array(best, run_type),
                 pa.array(texts, pa.binary()).cast(pa.string())], schema=schema)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id bigint, n_words bigint, runs array<{_RUN}>, highest {_RUN}, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with runs written into the texts whose crc32(doc_id) is divisible by ten; the rest as they are.

    From word a on such a text repeats its words a, a + 1, … with a period p, both read off the same checksum.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", h.alias("h")).withColumn("g", F.expr("h div 10"))
    w = F.when((F.col("h") % 10 == 0), F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = rows.withColumn("w", w).withColumn("n", F.size("w").cast("bigint"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.expr("g % n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    changed = F.expr("array_join(transform(sequence(0, cast(n as int) - 1), i -> get(w, cast(if(i < a, i, a + (i - a) % p) as int))), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def _line(r: Column) -> Column:
    return F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))


def digests(runs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli of the run with most periods, runs_sha256, collapsed_sha256."""
    best = F.col("highest")
    return runs.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("highest.length * 1000 div highest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", _line), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
