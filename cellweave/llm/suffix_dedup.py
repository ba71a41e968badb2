"""Repeated passages across documents by sparse suffix arrays.

Only suffixes at content-selected positions are kept: the positions of minimisers, that is, of the smallest hash of
``GRAM`` words in any window of ``WINDOW`` words. Equal passages select equal positions, and a passage of ``PASSAGE`` words
holds at least one whose next ``HEAD`` words lie within the passage. Suffixes whose head of ``HEAD`` words stands nowhere
else are dropped. The others are sorted twice, by the words after the head and, outwards, by the words before it; the
neighbour in the first array that shares most gives how far a match extends to the right, in the second to the left. A match
that runs past the ``TAIL`` words compared is carried on by the next kept position, which lies within them.

The matches of one place may be with different partners, so left and right together propose a span; it covers every passage
of PASSAGE words that also stands elsewhere (in another document or another place of the same one). Each run of PASSAGE
words within the proposed spans is then looked up by its hash, and what comes out is exactly the words of the runs that
stand elsewhere. Removed spans are the same with "elsewhere" read as "earlier": at a smaller (doc_id, position). The
earliest copy stays.

Suffixes with the same head and tail collapse before they are sorted, with a partial sum before the shuffle, so a passage
in a third of all documents is one row per task. The arrays are range-partitioned by (head, tail), and partitions compare
their rims, so a head with very many different tails spreads over many tasks. Tails are compared by 32-bit hashes of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import batch_of, small_batches, texts_as_words, window_hashes, word_spans
from cellweave.session import forget, stored

PASSAGE, GRAM, WINDOW = 50, 10, 35
HEAD = PASSAGE - (WINDOW - GRAM)
#: Between two kept positions of a document lie fewer words than a window has grams.
TAIL = WINDOW - GRAM + 1
_LAST = (1 << 63) - 1


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, tid, text): a null id sorts last, tid tells apart texts that share an id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("tid"), text.alias("text"))


def minimisers(words: np.ndarray) -> np.ndarray:
    """Positions of the smallest gram of every window, the leftmost of equals."""
    grams = window_hashes(words, GRAM)
    width = WINDOW - GRAM + 1
    if len(grams) < width:
        return np.empty(0, dtype=np.int64)
    return np.unique(_window_argmin(grams, width))


def _window_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the minimum of each window, from block-wise running minima on both sides."""
    n = len(x)
    pad = -n % width
    full = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, width)
    prefix = np.minimum.accumulate(full, axis=1).reshape(-1)
    suffix = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    low = np.minimum(suffix[:n - width + 1], prefix[width - 1:n])
    # Places ordered by (value, position): the first at or after the window's start that holds its minimum.
    values, code = np.unique(x, return_inverse=True)
    places = np.sort(code.astype(np.int64) * n + np.arange(n))
    wanted = np.searchsorted(values, low) * n + np.arange(n - width + 1)
    return places[np.searchsorted(places, wanted)] % n


def anchors(keyed: DataFrame) -> DataFrame:
    """(doc, tid, pos, head) of the kept positions and the hash of the HEAD words there, stored."""
    schema = pa.schema([("doc", pa.int64()), ("tid", pa.int64()), ("pos", pa.int32()), ("head", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4 << 20):
            words, ends = texts_as_words(batch.column("text"))
            doc, tid = batch.column("doc").to_numpy(), batch.column("tid").to_numpy()
            parts = []
            for i in range(len(doc)):
                if ends[i + 1] - ends[i] >= PASSAGE:
                    w = words[ends[i]:ends[i + 1]]
                    at = minimisers(w)
                    at = at[at <= len(w) - HEAD]
                    parts.append((np.full(len(at), doc[i]), np.full(len(at), tid[i]), at.astype(np.int32), window_hashes(w, HEAD)[at].view(np.int64)))
            if parts:
                yield batch_of(schema, *(np.concatenate(c) for c in zip(*parts)))

    return stored(keyed.mapInArrow(run, "doc bigint, tid bigint, pos int, head bigint"), "anchors")


_OCC = "side int, head bigint, tail binary, tail_key bigint, doc bigint, tid bigint, pos int"


def texts_with(keyed: DataFrame, places: DataFrame) -> DataFrame:
    """(doc, tid, text, places) of the documents that have a kept position, stored: all that later steps read of the texts.

    Rows that repeat id and text give the same rows here, which later steps count once.
    """
    return stored(keyed.join(places, ["doc", "tid"]).select("doc", "tid", "text", "places"), "texts", "zstd")


def occurrences(texts: DataFrame) -> DataFrame:
    """One row per kept position and side, stored: its head, the TAIL words after (side 0) or before it, outwards, and where it is."""
    schema = pa.schema([("side", pa.int32()), ("head", pa.int64()), ("tail", pa.binary()), ("tail_key", pa.int64()),
                        ("doc", pa.int64()), ("tid", pa.int64()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2 << 20):
            words, ends = texts_as_words(batch.column("text"))
            rows: list[tuple] = []
            for i, (doc, tid, places_) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("tid").to_pylist(),
                                                        batch.column("places").to_pylist())):
                w = words[ends[i]:ends[i + 1]]
                heads = window_hashes(w, HEAD).view(np.int64)
                short = (w >> np.uint64(32)).astype(">u4")
                right, left = short.tobytes(), short[::-1].tobytes()
                for pos in sorted(places_):
                    after, before = 4 * (pos + HEAD), 4 * (len(w) - pos)
                    for side, tail in ((0, right[after:after + 4 * TAIL]), (1, left[before:before + 4 * TAIL])):
                        rows.append((side, heads[pos], tail, xxhash.xxh64_intdigest(tail) - (1 << 63), doc, tid, pos))
                if len(rows) > 20_000:
                    yield batch_of(schema, *zip(*rows))
                    rows = []
            if rows:
                yield batch_of(schema, *zip(*rows))

    return stored(texts.mapInArrow(run, _OCC), "suffixes", "zstd")


def _common(a: bytes, b: bytes) -> int:
    """Words two tails share from their start."""
    n = min(len(a), len(b)) // 4
    if a[:4 * n] == b[:4 * n]:
        return n
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:4 * mid] == b[:4 * mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


_MATCH = "side int, head bigint, tail_key bigint, longest int, part int, tail binary"


def match_lengths(occ: DataFrame) -> DataFrame:
    """(side, head, tail_key, longest) of the distinct suffixes that share their head with another place, stored.

    longest is HEAD and the words of the tail shared with the neighbour that shares most; a suffix of several places
    matches itself over its whole tail.
    """
    distinct = occ.groupBy("side", "head", "tail_key", "tail").agg(F.count("*").alias("n"))
    parts = int(occ.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = distinct.select("side", "head", "tail", "tail_key", (F.col("n") > 1).alias("many")).repartitionByRange(
        parts, "side", "head", "tail").sortWithinPartitions("side", "head", "tail").withColumn("part", F.spark_partition_id())
    schema = pa.schema([("side", pa.int32()), ("head", pa.int64()), ("tail_key", pa.int64()), ("longest", pa.int32()), ("part", pa.int32()), ("tail", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: list | None = None  # the suffix whose next neighbour is still to come: what is emitted of it
        first = True
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("side", "head", "tail", "tail_key", "many", "part")]
            rows: list[list] = []
            for side, head, tail, tail_key, many, part in zip(*columns):
                now = [side, head, tail_key, HEAD + len(tail) // 4 if many else 0, part, tail]
                if before is not None:
                    if before[0] == side and before[1] == head:
                        shared = HEAD + _common(before[5], tail)
                        before[3], now[3] = max(before[3], shared), max(now[3], shared)
                    if not first:
                        before[5] = None
                    # The first suffix of a partition goes out with its tail, for the partition before.
                    rows.append(before)
                    first = False
                before = now
            rows = [r for r in rows if r[3] or r[5] is not None]
            if rows:
                yield batch_of(schema, *zip(*rows))
        if before is not None:
            yield batch_of(schema, *zip(before))

    found = stored(ordered.mapInArrow(run, _MATCH), "matches")
    # Rims: the first and the last suffix of each partition, two rows a task.
    rims = sorted(found.filter("tail is not null").collect(), key=lambda r: (r["side"], r["head"], r["tail"]))
    over = [(r["side"], r["head"], r["tail_key"], HEAD + _common(a["tail"], b["tail"])) for a, b in zip(rims, rims[1:])
            if a["part"] != b["part"] and (a["side"], a["head"]) == (b["side"], b["head"]) for r in (a, b)]
    inner = found.filter("longest > 0").select("side", "head", "tail_key", "longest")
    if not over:
        return inner
    rim = occ.sparkSession.createDataFrame(over, "side int, head bigint, tail_key bigint, longest int")
    # Written, so that Spark may split a suffix of very many places in the join that follows.
    return stored(inner.union(rim).groupBy("side", "head", "tail_key").agg(F.max("longest").alias("longest")), "matches-with-rims")


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans joined where they meet; those of at least PASSAGE words."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out if e - s >= PASSAGE]


def _spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, tid, repeated, removed): spans in words [from, to) of the documents that have a repeated one, stored."""
    keyed = _keyed(docs, id_col, text_col)
    proposed, texts = _proposed(keyed)
    runs = _runs(texts, proposed)
    forget(proposed)
    forget(texts)
    seen = runs.groupBy("h").agg(F.min(F.struct("doc", "tid", "pos")).alias("first"), F.max(F.struct("doc", "tid", "pos")).alias("last"))
    again = stored(seen.filter("first <> last").select("h", F.col("first.doc").alias("_doc"), F.col("first.tid").alias("_tid"), F.col("first.pos").alias("_pos")), "repeated-runs")
    placed = runs.join(again, "h").select("doc", "tid", "pos", F.expr("doc = _doc and tid = _tid and pos = _pos").alias("is_first"))
    per_doc = placed.groupBy("doc", "tid").agg(F.collect_list("pos").alias("places"), F.collect_list(F.when(~F.col("is_first"), F.col("pos"))).alias("later"))
    schema = pa.schema([("doc", pa.int64()), ("tid", pa.int64()), ("repeated", pa.list_(pa.list_(pa.int32()))), ("removed", pa.list_(pa.list_(pa.int32())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc", "tid", "places", "later")]
            rows = [(doc, tid, *([list(s) for s in _union([(p, p + PASSAGE) for p in at])] for at in both)) for doc, tid, *both in zip(*columns)]
            if rows:
                yield batch_of(schema, *zip(*rows))

    out = stored(per_doc.mapInArrow(run, "doc bigint, tid bigint, repeated array<array<int>>, removed array<array<int>>"), "spans")
    forget(runs)
    forget(again)
    return out


def _runs(texts: DataFrame, proposed: DataFrame) -> DataFrame:
    """(h, doc, tid, pos): hash and place of each run of PASSAGE words within the proposed spans, stored."""
    schema = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("tid", pa.int64()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2 << 20):
            words, ends = texts_as_words(batch.column("text"))
            doc, tid, parts = batch.column("doc").to_numpy(), batch.column("tid").to_numpy(), []
            for i, spans in enumerate(batch.column("proposed").to_pylist()):
                w = words[ends[i]:ends[i + 1]]
                for s, e in spans:
                    h = window_hashes(w[s:e], PASSAGE).view(np.int64)
                    parts.append((h, np.full(len(h), doc[i]), np.full(len(h), tid[i]), np.arange(s, s + len(h), dtype=np.int32)))
            if parts:
                yield batch_of(schema, *(np.concatenate(c) for c in zip(*parts)))

    # Rows that repeat id and text give the same places, which count as one.
    rows = texts.join(proposed, ["doc", "tid"]).select("doc", "tid", "text", "proposed")
    return stored(rows.mapInArrow(run, "h bigint, doc bigint, tid bigint, pos int"), "runs", "zstd")


def _proposed(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, tid, proposed), spans in words [from, to) in which all repeated passages lie, and the texts they lie in; stored."""
    kept = anchors(keyed)
    often = stored(kept.groupBy("head").agg(F.count("*").alias("n")).filter("n > 1").select("head"), "heads")
    places = stored(kept.join(often, "head", "left_semi").groupBy("doc", "tid").agg(F.collect_set("pos").alias("places")), "places")
    forget(kept)
    forget(often)
    texts = texts_with(keyed, places)
    forget(places)
    occ = occurrences(texts)
    found = match_lengths(occ)
    matched = occ.drop("tail").join(found.select("side", "head", "tail_key", "longest"), ["side", "head", "tail_key"]).select(
        "doc", "tid", F.struct("side", "pos", "longest").alias("m"))
    schema = pa.schema([("doc", pa.int64()), ("tid", pa.int64()), ("proposed", pa.list_(pa.list_(pa.int32())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, tid, ms in zip(*(batch.column(c).to_pylist() for c in ("doc", "tid", "ms"))):
                spans = _union([(m["pos"], m["pos"] + m["longest"]) if m["side"] == 0 else (m["pos"] + HEAD - m["longest"], m["pos"] + HEAD) for m in ms])
                if spans:
                    rows.append((doc, tid, [list(s) for s in spans]))
            if rows:
                yield batch_of(schema, *zip(*rows))

    per_doc = matched.groupBy("doc", "tid").agg(F.collect_set("m").alias("ms"))
    out = stored(per_doc.mapInArrow(run, "doc bigint, tid bigint, proposed array<array<int>>"), "proposed")
    forget(occ)
    forget(found)
    return out, texts


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_repeated, n_removed (words), repeated and removed (arrays of [from, to) in words) of documents with a repeat.

    Words are runs of characters other than ASCII white space. Null and empty texts and texts of fewer than PASSAGE words
    have no passage. Rows with the same id and text count as one document; rows that share an id but not the text are
    documents of their own, each with a row. Documents with a null id come after all others and keep a null id. Other
    columns are ignored; an empty table gives an empty result.
    """
    words = lambda c: F.aggregate(c, F.lit(0), lambda a, s: a + s[1] - s[0])
    return _spans(docs, id_col, text_col).select(
        F.when(F.col("doc") != _LAST, F.col("doc")).alias("doc_id"), words(F.col("repeated")).alias("n_repeated"),
        words(F.col("removed")).alias("n_removed"), "repeated", "removed")


def cut_spans(text: str, spans: list[list[int]]) -> str:
    """A text without the words of the spans; white space before a cut word goes with it."""
    raw = text.encode()
    starts, ends = word_spans(np.frombuffer(raw, dtype=np.uint8))
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at:starts[s]] if s == 0 else raw[at:ends[s - 1]])
        at = int(ends[e - 1])
    out.append(raw[at:])
    return b"".join(out).decode()


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with removed spans cut out of ``text`` and ``n_chars`` (if there) counted anew; rows and columns stay.

    A null text stays null, an empty one empty. Rows with the same id and text count as one document and are cut alike;
    so do rows without an id that share a text. An id of 2**63 - 1 is taken for none. Columns may have any name; an empty table stays empty.
    """
    spans = _spans(docs, "doc_id", "text").filter(F.size("removed") > 0).select(
        F.col("doc").alias("_doc"), F.col("tid").alias("_tid"), "removed")
    names = docs.columns
    counted = "n_chars" in names and docs.schema["n_chars"].dataType == T.LongType()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            columns = dict(zip(names, batch.column("row").flatten()))
            removed = batch.column("removed").to_pylist()
            hit = [r is not None for r in removed]
            if any(hit):
                texts = [cut_spans(t, r) if r is not None else t for t, r in zip(columns["text"].to_pylist(), removed)]
                columns["text"] = pa.array(texts, columns["text"].type)
                if counted:
                    columns["n_chars"] = pc.if_else(pa.array(hit), pc.cast(pc.utf8_length(columns["text"]), pa.int64()), columns["n_chars"])
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("_doc"), F.xxhash64(text).alias("_tid"))
    return rows.join(spans, ["_doc", "_tid"], "left").select("row", "removed").mapInArrow(run, docs.schema)
