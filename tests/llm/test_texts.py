"""Operators on whole texts against the tokenizer libraries, SQL and brute force, with awkward rows in every table."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

import __spark_entry__ as entry
from oracle import compare, connection

from cellweave.llm import bpe, exact_dedup, huffman, line_dedup, packing, token_counts
from cellweave.llm.tokenizing import SegmentEncoder

WORD, BYTE, PIECE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["", " ", "  ", "a  b", "x\x1cy .\x1c.", "<|endoftext|>", "ab<|endoftext|>cd, <|startoftext|>.", "É é ΣΑΣ ﬁ İstanbul ß", "\n\n\n foo  bar \t\n",
       "don't we'll I'VE 'S", "漢字かな交じり文 123456", "😀😃 a😀", "a" * 300, "ab" * 200, "́abc ́def", "loooooool !!!!????", "x\ry", "end \n",
       "  em  space", "a  b", "nul\0 x", "x\ny, z.. w.,a"]


def random_texts(n, seed=1, alphabet="ab cde\n'sTÉß12.,!😀́ \x1f\t  "):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def awkward(spark):
    """Null ids and texts, empty and very long texts, repeated rows, and columns named like the operators' own."""
    rows = [(i, t, 1, "x") for i, t in enumerate(ODD)]
    rows += [(100, "same text here", 2, None), (100, "same text here", 2, None), (101, "same\ttext  here", 3, ""), (None, None, None, None),
             (None, "no id", 1, "y"), (102, None, 1, "z"), (103, "word " * 60_000, 1, "long")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, length int, keep_id string").withColumnRenamed("length", "_h")


@pytest.fixture(scope="module")
def no_rows(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_bpe_equals_library(path):
    lib, own, cached = Tokenizer.from_file(path), bpe.WholeTextBpe(path), SegmentEncoder(path)
    for text in ODD + random_texts(1500) + random_texts(300, 2, "abcdefghijklmnopqrstuvwxyz"):
        ids = lib.encode(text, add_special_tokens=False).ids
        raw = np.array(ids, dtype="<u4").tobytes()
        assert own.encode(text) == raw and cached.encode([text])[0] == raw, repr(text)
        assert own.decode(raw) == lib.decode(ids, skip_special_tokens=False).encode(), repr(text)


def test_bpe_documents(awkward, no_rows):
    lib = Tokenizer.from_file(WORD)
    got = bpe.encode_documents(awkward, WORD).collect()
    want = [(r["doc_id"], np.array(lib.encode(r["text"] or "", add_special_tokens=False).ids, dtype="<u4").tobytes()) for r in awkward.collect()]
    assert sorted(((r["doc_id"], bytes(r["ids"])) for r in got), key=repr) == sorted(want, key=repr)
    assert bpe.encode_documents(no_rows, WORD).count() == 0


def test_op5_contract(spark, sf):
    lib = Tokenizer.from_file(WORD)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in entry.queries()["op5_bpe"](spark, sf).collect():
        ids = lib.encode(texts.pop(r["doc_id"]), add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert not texts


def test_unigram_counts_equal_library():
    vocab, fallback = token_counts.unigram_vocabulary(PIECE)
    assert fallback
    for counter, extra in ((token_counts.UnigramCounter(vocab, True), [(f"<0x{i:02X}>", 0.0) for i in range(256)]),
                           (token_counts.UnigramCounter(vocab, False), [])):
        lib = Tokenizer(models.Unigram([("<unk>", 0.0)] + vocab + extra, unk_id=0, byte_fallback=bool(extra)))
        for text in ODD + random_texts(300, 3, "ab cdeé😀\n  漢"):
            marked = token_counts.MARK + text.replace(" ", token_counts.MARK) if text else ""
            assert counter.count(text)[0] == len(lib.encode(marked, add_special_tokens=False).ids), repr(text)
            assert counter.count(text) == counter.viterbi(marked)


def test_unigram_ties_equal_library():
    vocab = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("ba", -2.0), ("▁", -1.0), ("▁a", -2.0), ("▁ab", -3.0)]
    lib, own, r = Tokenizer(models.Unigram([("<unk>", -20.0)] + vocab, unk_id=0)), token_counts.UnigramCounter(vocab, False), random.Random(4)
    for _ in range(1000):
        text = "".join(r.choice("ab cx") for _ in range(r.randint(1, 12)))
        assert own.count(text)[0] == len(lib.encode(token_counts.MARK + text.replace(" ", token_counts.MARK)).ids)


def test_token_counts_of_awkward_rows(awkward, no_rows):
    got = token_counts.count_tokens(awkward, PIECE).collect()
    assert len(got) == awkward.count() and {r["n_tokens"] for r in got if r["doc_id"] == 102} == {0}
    assert token_counts.count_tokens(no_rows, PIECE).count() == 0


def test_exact_groups(awkward, no_rows):
    got = exact_dedup.exact_groups(awkward).collect()
    assert len(got) == awkward.count()
    same = [r for r in got if r["doc_id"] in (100, 101)]
    assert {(r["keep_id"], r["group_size"]) for r in same} == {(100, 3)} and [r["kept"] for r in same if r["doc_id"] == 101] == [False]
    empty = [r for r in got if r["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert {r["keep_id"] for r in empty} == {0} and len(empty) == 3  # null id, null text, empty text
    assert exact_dedup.exact_groups(no_rows).count() == 0


def test_drop_copies_keeps_columns_and_one_row_of_each(awkward, no_rows):
    left = exact_dedup.drop_copies(awkward)
    assert left.columns == awkward.columns and left.schema == awkward.schema
    ids = [r["doc_id"] for r in left.collect()]
    assert ids.count(100) == 1 and 101 not in ids and 102 not in ids and 103 in ids
    assert exact_dedup.drop_copies(no_rows).count() == 0


def test_filter_never_misses_a_repeat():
    h = np.random.default_rng(1).integers(0, 1 << 60, 5000)
    at = exact_dedup._positions(np.concatenate([h, h[:50]]))
    assert (at[0] != at[1]).all() and at.max() < exact_dedup.BITS


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op7_line_dedup"])
def test_query_equals_sql(spark, sf, name):
    assert compare(spark, connection(sf), entry.queries()[name], entry.oracle_sql()[name], sf) is None


def test_lines_of_awkward_pages(spark):
    rows = [(1, "http://A.example/x", "<p>menu</p><p>one</p>"), (2, "http://a.example:80/y", "<p>menu</p>two<br>two"), (3, "https://u@a.EXAMPLE?q", "<div>menu"),
            (4, "http://a.example", None), (5, None, "<p>menu</p>"), (None, "nonsense", "menu"), (7, "http://b.example", "<script>x</script><p>menu &amp; more</p>"),
            (7, "http://b.example", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS host", "2 AS lines", "3 AS bad")
    got = {(r["page_id"], r["text"]) for r in line_dedup.drop_site_lines(pages).collect()}
    assert got == {(1, "one"), (2, "two\ntwo"), (3, ""), (4, ""), (5, "menu"), (None, "menu"), (7, "menu & more"), (7, "")}
    assert line_dedup.drop_site_lines(pages.limit(0)).count() == 0


def test_line_dedup_runs_without_python(spark, sf):
    plan = entry.queries()["op7_line_dedup"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- packing and files ------------------------------------------------------------------------------------------------

def test_plan_uses_every_piece_and_is_near_the_bound():
    r = np.random.default_rng(1)
    for n in (1, 50, 3000, 60_000):
        for draw in (r.integers(1, 2048, n), r.integers(1, 300, n), np.clip(r.exponential(700, n).astype(int) + 1, 1, 2047), np.full(n, 1500)):
            counts = np.bincount(draw, minlength=2049)
            plan = packing.plan_fillings(counts, 2048)
            used = np.zeros(2049, dtype=int)
            for times, items in plan:
                assert times > 0 and sum(a * b for a, b in items) <= 2048
                for v, q in items:
                    used[v] += times * q
            assert (used == counts).all()
            assert sum(t for t, _ in plan) <= 1.01 * packing.least_bins(counts, 2048) + 1
    assert packing.plan_fillings(np.zeros(2049, dtype=int), 2048) == []


def test_search_beats_best_fit():
    counts = np.zeros(101, dtype=int)
    for v in (60, 50, 30, 20, 20, 20):  # best fit: 60+30, 50+20+20, 20; optimal: 60+20+20, 50+30+20
        counts[v] += 1
    assert sum(t for t, _ in packing._best_fit(counts, 100)) == 3
    assert sum(t for t, _ in packing.plan_fillings(counts, 100)) == 2


def check_packed(rows, texts, capacity):
    lib = Tokenizer.from_file(WORD)
    by_sequence, pieces = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, text in texts.items():
        ids = np.array(lib.encode(text, add_special_tokens=False).ids + [0], dtype="<u4")
        cuts = [ids[i:i + capacity] for i in range(0, len(ids), capacity)]
        assert sorted(pieces.pop(doc)) == [(k, k * capacity, len(c), zlib.crc32(c.tobytes())) for k, c in enumerate(cuts)]
    assert not pieces


def test_op8_contract(spark, sf):
    rows = entry.queries()["op8_best_fit_packing"](spark, sf).collect()
    check_packed(rows, {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}, 2048)
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // 2048) * 1.01 + 1


def test_pack_awkward_rows(spark, awkward, no_rows):
    packed = packing.pack(awkward.filter("doc_id is not null and doc_id <> 100"), WORD, capacity=256, keep_ids=True)
    rows = packed.collect()
    check_packed(rows, {r["doc_id"]: r["text"] or "" for r in awkward.filter("doc_id is not null and doc_id <> 100").collect()}, 256)
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    assert sum(len(x) for x in whole.values()) == 4 * sum(r["length"] for r in rows)
    assert sum(r["length"] > 0 for r in packing.pack(awkward, WORD).collect()) >= awkward.count()
    assert packing.pack(no_rows, WORD).count() == 0


def test_code_is_canonical_limited_and_optimal():
    r = np.random.default_rng(2)
    for n, m in ((1, 3), (2, 5), (300, 1000), (5000, 300_000)):
        counts = np.bincount(np.minimum((r.pareto(0.5, m)).astype(np.int64), n - 1), minlength=n + 2)
        lengths = huffman.code_lengths(counts)
        assert lengths.max() <= huffman.MAX_BITS and (lengths[counts == 0] == 0).all()
        if (counts > 0).sum() > 1:
            assert sum(2.0 ** -int(v) for v in lengths if v) == 1.0
    # Without a limit that binds, the total equals that of an ordinary Huffman code.
    import heapq

    counts = np.array([50, 30, 11, 5, 3, 1])
    heap, total = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    assert int((counts * huffman.code_lengths(counts)).sum()) == total
    assert (huffman.code_lengths(counts, 3) <= 3).all()


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_block_round_trip(n):
    ids = np.random.default_rng(n).integers(0, 500, n)
    codec = huffman.Codec(huffman.code_lengths(np.bincount(ids, minlength=501)))
    sizes = np.array([0, n // 2, n - n // 2])
    docs, got_sizes, got = codec.decode_block(codec.encode_block(np.array([5, -3, huffman.NULL_ID]), sizes, ids))
    assert (got == ids).all() and (got_sizes == sizes).all() and docs.tolist() == [5, -3, huffman.NULL_ID]


def test_op10_contract(spark, sf):
    lib = Tokenizer.from_file(BYTE)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in entry.queries()["op10_token_ids"](spark, sf).collect()}
    start = 0
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        ids = np.array(lib.encode(r["text"] or "", add_special_tokens=False).ids + [2], dtype="<u4")
        assert got.pop(r["doc_id"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got


def test_files_of_awkward_rows(spark, awkward, no_rows, tmp_path):
    huffman.write_ids(awkward, BYTE, str(tmp_path / "a"), end_id=2)
    got = huffman.read_ids(spark, str(tmp_path / "a")).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i)) and len(ids) == awkward.count()
    assert all(r["start"] == sum(len(x["ids"]) // 4 for x in got[:k]) for k, r in enumerate(got))
    huffman.write_ids(no_rows, BYTE, str(tmp_path / "b"))
    assert huffman.read_ids(spark, str(tmp_path / "b")).count() == 0
