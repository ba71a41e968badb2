"""Token counts under a unigram vocabulary, without making the tokens: count-only Viterbi.

An Aho-Corasick automaton enumerates, at every position of a text, the vocabulary pieces that end there. Dynamic
programming carries two numbers per position: the best score of a segmentation up to it and that segmentation's number
of tokens. Ties follow the library's Unigram model: a candidate replaces the best one only if its score is larger, and
candidates come with their start from left to right, so of equal scores the one whose last piece starts first stays. A
character that no one-character piece covers may stand as an unknown piece at the lowest score less 10; a run of such
pieces counts as one unknown token, or as its UTF-8 bytes where the vocabulary falls back to bytes.

The text form is that of the piece vocabulary: a mark replaces each space and stands before the text. When no piece holds
a mark after another character, no piece crosses a place where a mark follows another character, so every path passes
there and the parts between such places are counted one by one, from a bounded store of parts seen before.

The vocabulary is given as (piece, score) pairs. ``unigram_vocabulary`` reads them from a sentencepiece file; the piece
file among the public tokenizers is a BPE model, whose stored scores (minus the merge rank) serve as unigram scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from cellweave.llm.common import batch_of, id_and_text, small_batches
from cellweave.llm.tokenizing import _USED_IN, HELD, free_other_stages, stage, text_list

MARK = "▁"
UNKNOWN_PENALTY = 10.0
MAX_PARTS = 500_000
_PARTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def unigram_vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """((piece, score), ...) of the ordinary pieces of a sentencepiece file, and whether it falls back to bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in plain], any(model.is_byte(i) for i in ids)


class UnigramCounter:
    """Counts the tokens of texts under one vocabulary."""

    def __init__(self, vocab: list[tuple[str, float]], byte_fallback: bool):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece and piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocab) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.separable = not any(MARK in p.lstrip(MARK) for p, _ in vocab) and MARK in self.automaton
        self.parts: dict[str, tuple[int, float, int]] = {}

    def viterbi(self, text: str) -> tuple[int, float, int]:
        """(tokens, best score, unknown characters) of one stretch of marked text."""
        n = len(text)
        if not n:
            return 0, 0.0, 0
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        single = bytearray(n)
        for end, (size, score) in self.automaton.iter(text):
            ending[end + 1].append((end + 1 - size, score))
            if size == 1:
                single[end] = 1
        best: list[float] = [0.0] * (n + 1)
        count, unknown = [0] * (n + 1), [0] * (n + 1)
        last_unknown = bytearray(n + 1)
        for end in range(1, n + 1):
            top, at, lone = float("-inf"), -1, False
            for start, score in sorted(ending[end]):  # starts from left to right; the first of equals stays
                if best[start] + score > top:
                    top, at = best[start] + score, start
            if not single[end - 1] and best[end - 1] + self.unknown > top:
                top, at, lone = best[end - 1] + self.unknown, end - 1, True
            best[end] = top
            if not lone:
                count[end], unknown[end] = count[at] + 1, unknown[at]
                continue
            unknown[end], last_unknown[end] = unknown[at] + 1, 1
            if self.byte_fallback:
                count[end] = count[at] + len(text[at].encode("utf-8", "replace"))
            else:
                count[end] = count[at] + (not last_unknown[at])
        return count[n], best[n], unknown[n]

    def count(self, text: str) -> tuple[int, float, int]:
        """The same for a whole plain text; an empty text has no tokens."""
        if not text:
            return 0, 0.0, 0
        marked = MARK + text.replace(" ", MARK)
        if not self.separable:
            return self.viterbi(marked)
        tokens, score, unknown = 0, 0.0, 0
        parts = self.parts
        for part in _PARTS.findall(marked):
            got = parts.get(part)
            if got is None:
                if len(parts) >= MAX_PARTS:
                    parts.clear()
                got = parts[part] = self.viterbi(part)
            tokens += got[0]
            score += got[1]
            unknown += got[2]
        return tokens, score, unknown


_COUNTERS: dict[str, UnigramCounter] = {}
HELD.append(_COUNTERS)


def counter(path: str) -> UnigramCounter:
    """The counter of this worker process for a sentencepiece file."""
    free_other_stages()
    _USED_IN[0] = stage()
    if path not in _COUNTERS:
        _COUNTERS[path] = UnigramCounter(*unigram_vocabulary(path))
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, score (of the best segmentation), n_unknown (characters without a piece): one row per row.

    A null text counts as empty: no tokens, score 0. Repeated and null ids stay as they are, other columns are ignored,
    an empty table gives an empty result. Scores are sums of double-precision piece scores, parts added left to right.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64()), ("n_unknown", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in small_batches(batches):
            got = [own.count(t) for t in text_list(batch.column("text"))]
            yield batch_of(schema, batch.column("doc_id"), *zip(*got))

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_tokens bigint, score double, n_unknown bigint")
