"""Token ids in a compact binary form: canonical length-limited Huffman coding from global counts.

A first pass counts ids over all documents; their number is bounded by the vocabulary, so the code is made on the driver
by package-merge. Documents are then put in ascending id order by a range shuffle and written as independent blocks.

File format. A written folder holds ``code`` (one row: the code length of every id, one byte each) and ``blocks`` (one
row per block, in document order: part, number in the part, tokens before it in the part, tokens, block). Codes are
canonical: shorter codes first, equal lengths by id. A block holds, all little-endian:

    magic u32 | documents u32 | tokens u64 | checkpoints u32 | step u32
    document ids i64[documents], their token counts u32[documents]
    bit offsets u64[checkpoints], one for every ``STEP`` tokens
    code bits, most significant bit first, padded to 8 bytes

A null document id is stored as the smallest 64-bit integer. A reader needs the code and one block only, and can start
at any checkpoint.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import batch_of, id_and_text, small_batches
from cellweave.llm.tokenizing import encoder, text_list
from cellweave.session import forget, stored

MAGIC = 0x484E4B54
#: Longest code in bits, tokens between checkpoints, tokens after which a block is closed.
MAX_BITS, STEP, BLOCK_TOKENS = 16, 256, 1 << 20
NULL_ID = -(1 << 63)
_HEAD = struct.Struct("<IIQII")


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for ids with a count above 0 (package-merge); 0 for the others."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids need codes of more than {max_bits} bits")
    if len(used) == 1:
        out[used] = 1
    if len(used) < 2:
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    weight = [int(w) for w in counts[order]]
    n = len(order)
    # Level by level only the number of single ids among the cheapest 2n - 2 is needed, found from the top down.
    singles_before = []
    packages: list[int] = []
    for _ in range(max_bits):
        merged = list(heapq.merge(((w, 0) for w in weight), ((w, 1) for w in packages)))
        singles_before.append(np.concatenate([[0], np.cumsum([k == 0 for _, k in merged])]))
        packages = [merged[i][0] + merged[i + 1][0] for i in range(0, len(merged) - 1, 2)]
    take = 2 * n - 2
    for singles in reversed(singles_before):
        s = int(singles[take])
        out[order[:s]] += 1
        take = 2 * (take - s)
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code of each id: counting up, shorter codes first, equal lengths by id."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    code, before = 0, 0
    for i in sorted(np.flatnonzero(lengths), key=lambda i: (lengths[i], i)):
        code <<= int(lengths[i]) - before
        before = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


class Codec:
    """Encodes and decodes blocks under one code."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.codes = canonical_codes(lengths)
        #: Decoding table over the next MAX_BITS bits: id and length of the code they begin with.
        self.symbol = np.zeros(1 << MAX_BITS, dtype=np.uint32)
        self.size = np.zeros(1 << MAX_BITS, dtype=np.int64)
        for i in np.flatnonzero(lengths):
            at = int(self.codes[i]) << (MAX_BITS - int(lengths[i]))
            self.symbol[at:at + (1 << (MAX_BITS - int(lengths[i])))] = i
            self.size[at:at + (1 << (MAX_BITS - int(lengths[i])))] = lengths[i]

    def encode_block(self, doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
        n = len(ids)
        size = self.lengths[ids]
        ends = np.cumsum(size)
        start = ends - size
        shifted = self.codes[ids] << (np.uint64(64) - (start & 31).astype(np.uint64) - size.astype(np.uint64))
        words = (int(ends[-1]) // 32 if n else 0) + 3
        word = start >> 5
        bits = np.bincount(word, weights=(shifted >> np.uint64(32)).astype(np.float64), minlength=words)
        bits[1:] += np.bincount(word, weights=(shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words)[:-1]
        checks = start[::STEP].astype("<u8")
        return b"".join([
            _HEAD.pack(MAGIC, len(doc_ids), n, len(checks), STEP), doc_ids.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(),
            checks.tobytes(), bits.astype(">u4").tobytes()])

    def decode_block(self, block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document ids, token counts, all ids); stretches between checkpoints are decoded side by side."""
        magic, docs, n, checks, step = _HEAD.unpack_from(block)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at = _HEAD.size
        doc_ids = np.frombuffer(block, dtype="<i8", count=docs, offset=at)
        sizes = np.frombuffer(block, dtype="<u4", count=docs, offset=at + 8 * docs)
        bit = np.frombuffer(block, dtype="<u8", count=checks, offset=at + 12 * docs).astype(np.int64)
        raw = np.frombuffer(block, dtype=np.uint8, offset=at + 12 * docs + 8 * checks).astype(np.uint32)
        ahead = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]  # 24 bits from each byte on
        out = np.zeros((step, checks), dtype=np.uint32)
        last = n - (checks - 1) * step
        for i in range(min(step, n)):
            if i == last and checks:  # the last stretch may be shorter
                bit = bit[:-1]
                if not len(bit):
                    break
            window = (ahead[bit >> 3] >> (8 - (bit & 7)).astype(np.uint32)) & 0xFFFF
            out[i, :len(bit)] = self.symbol[window]
            bit = bit + self.size[window]
        return doc_ids, sizes, out.T.reshape(-1)[:n]


def encode_tokens(docs: DataFrame, path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids: little-endian unsigned 16-bit integers), stored. The vocabulary must have at most 65536 ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, "H")
        for batch in small_batches(batches):
            yield batch_of(schema, batch.column("doc_id"), own.encode(text_list(batch.column("text")), end_id))

    return stored(id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids binary"), "tokens")


def count_ids(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs over all documents; as long as the largest id, at most 65536."""
    schema = pa.schema([("id", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in small_batches(batches):
            total += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype="<u2"), minlength=1 << 16)
        used = np.flatnonzero(total)
        if len(used):
            yield batch_of(schema, used.astype(np.int32), total[used])

    rows = tokens.select("ids").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r["id"] for r in rows), default=0) + 1, dtype=np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def write_ids(docs: DataFrame, path: str, folder: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts and write them to ``folder`` in the format above, in ascending document id order.

    A null text counts as empty (only ``end_id`` remains, if any); null document ids come first; rows with equal ids
    stay side by side, in any order among themselves. Other columns are ignored. An empty table gives a code without
    ids and no block.
    """
    spark = docs.sparkSession
    tokens = encode_tokens(docs, path, end_id, id_col, text_col)
    lengths = code_lengths(count_ids(tokens))
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{folder}/code")
    shared = spark.sparkContext.broadcast(lengths)  # one byte per id of the vocabulary
    schema = pa.schema([("part", pa.int32()), ("block_no", pa.int32()), ("before", pa.int64()), ("tokens", pa.int64()),
                        ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part, no = Codec(shared.value), TaskContext.get().partitionId(), 0
        doc_ids: list[int] = []
        raw: list[bytes] = []
        held = before = 0

        def flush():
            sizes = np.array([len(r) // 2 for r in raw], dtype=np.int64)
            ids = np.frombuffer(b"".join(raw), dtype="<u2")
            block = codec.encode_block(np.array(doc_ids, dtype=np.int64), sizes, ids)
            return batch_of(schema, [part], [no], [before], [len(ids)], [block])

        for batch in small_batches(batches):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                doc_ids.append(NULL_ID if doc is None else doc)
                raw.append(ids)
                held += len(ids) // 2
                if held >= BLOCK_TOKENS:
                    yield flush()
                    no, before, held = no + 1, before + held, 0
                    doc_ids, raw = [], []
        if doc_ids:
            yield flush()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, "part int, block_no int, before bigint, tokens bigint, block binary").write.parquet(
        f"{folder}/blocks", compression="uncompressed")
    forget(tokens)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian unsigned 32 bit) from written files."""
    lengths = spark.read.parquet(f"{folder}/code").first()["lengths"]
    shared = spark.sparkContext.broadcast(np.frombuffer(bytes(lengths), dtype=np.uint8))
    blocks = spark.read.parquet(f"{folder}/blocks")
    # One row per written part, of which there are as many as shuffle partitions when the files were written.
    totals = blocks.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect()
    ends = np.cumsum([r["n"] for r in totals])
    before = {r["part"]: int(e) - r["n"] for r, e in zip(totals, ends)}
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            for part, base, block in zip(batch.column("part").to_pylist(), batch.column("before").to_pylist(), batch.column("block")):
                doc_ids, n, ids = codec.decode_block(block.as_py())
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(n.astype(np.int64))
                begin = ends - n
                for i in range(0, len(n), 2048):
                    k = slice(i, i + 2048)
                    yield batch_of(schema, pa.array(doc_ids[k], mask=doc_ids[k] == NULL_ID), before[part] + base + begin[k],
                                   [raw[4 * s:4 * e] for s, e in zip(begin[k], ends[k])])

    return blocks.select("part", "before", "block").mapInArrow(run, "doc_id bigint, start bigint, ids binary")
