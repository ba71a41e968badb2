"""Whole-text encoding with a public tokenizer file, one tokenizer call per distinct segment.

A text is cut where a character that is no white space meets an ASCII white space; both tokenizer files here never
join tokens across such a place, so the ids of the segments one after another are the ids of the text. Segments
repeat a lot, so each worker keeps the ids of those it has seen in a bounded store.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries in the two stores of one worker process: segments, and pieces between the tokenizer's own splits.
MAX_SEGMENTS, MAX_PIECES = 500_000, 600_000
#: Longer keys are made anew each time. When a store is full, keys longer than SHORT make room.
MAX_LENGTH, SHORT = 64, 7

_SEGMENT = re.compile(r"\s*\S+|\s+")
_CONTROL = re.compile(r"[\x1c-\x1f]")


def segments(text: str) -> list[str]:
    """Cut a text into pieces that any tokenizer with white space before the word encodes one by one."""
    if not text:
        return []
    plain = text.replace("\n", " ")
    if plain.isprintable() and "  " not in plain:  # no white space but single spaces and newlines
        return text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")
    if _CONTROL.search(text):  # white space to Python, not to the tokenizer
        return [text]
    return _split_at_spaces(text)


def _split_at_spaces(text: str) -> list[str]:
    out: list[str] = []
    for piece in _SEGMENT.findall(text):
        if out and piece[0] not in " \n\t\r":
            out[-1] += piece
        else:
            out.append(piece)
    return out


def plain_split(spec: dict) -> re.Pattern | None:
    """Pattern of the pieces of text that ``PLAIN`` matches, in lower case.

    Only for files that lower-case, keep what their split pattern matches and map bytes one by one; there such text
    needs no other step. None for any other file, and for such files any other text goes through the library's steps.
    """
    normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if "Lowercase" not in normal or not set(normal) <= {"NFC", "Replace", "Lowercase"} or len(steps) != 2:
        return None
    split, level = steps
    if split.get("behavior") != "Removed" or not split.get("invert") or level.get("type") != "ByteLevel" or level.get("use_regex"):
        return None
    return re.compile(split["pattern"]["Regex"].replace(r"\p{L}", "a-zA-ZÀ-ÖØ-öø-ſ").replace(r"\p{N}", "0-9"))


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, reversed."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


UNBYTE = _byte_alphabet()
SHOW = {b: c for c, b in UNBYTE.items()}
#: Printable ASCII and the composed letters up to U+017F whose lower case is one letter: no other form, no white space.
PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]+")


class Store(dict):
    """Bounded memory of ``make(key)``: asking for an unknown key makes and keeps its value.

    When full, short keys, which are the frequent ones, stay, unless they alone would fill it. Long keys are not kept.
    """

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= MAX_LENGTH:
            if len(self) >= self.most:
                kept = {k: v for k, v in self.items() if len(k) <= SHORT}
                self.clear()
                if len(kept) < self.most // 2:
                    self.update(kept)
            self[key] = value
        return value


_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
#: A word with its space before and full stops or commas after it: three splits of the byte-level pattern at most.
_BYTE_WORD = re.compile(f"([ \n]?)([{_LETTERS}]+)([.,]*)")


class SegmentEncoder:
    """Ids of whole texts as little-endian unsigned 32- or 16-bit integers."""

    def __init__(self, path: str, code: str = "I", special_in_text: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if not special_in_text:
            self.tokenizer.encode_special_tokens = True
        spec = json.load(open(path, encoding="utf-8"))
        level = spec.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.plain = plain_split(spec)
        self.byte_words = spec.get("normalizer") is None and level.get("type") == "ByteLevel" and level.get("use_regex") and not level.get(
            "add_prefix_space")
        self.code = code
        self.pieces = Store(self._piece, MAX_PIECES)
        self.store = Store(self._byte_segment if self.byte_words else self._plain_segment if self.plain else self._whole, MAX_SEGMENTS)

    def _piece(self, piece: str) -> bytes:
        """Ids of a split in the byte alphabet."""
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(piece)]).tobytes()

    def _whole(self, segment: str) -> bytes:
        return array(self.code, self.tokenizer.encode(segment, add_special_tokens=False).ids).tobytes()

    def _byte_segment(self, segment: str) -> bytes:
        m = _BYTE_WORD.fullmatch(segment)
        if m is None:
            return self._whole(segment)
        before, word, after = m.groups()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(SHOW)
        pieces = self.pieces
        ids = pieces["Ġ" + word] if before == " " else pieces["Ċ"] + pieces[word] if before else pieces[word]
        return ids + pieces[after] if after else ids

    def _plain_segment(self, segment: str) -> bytes:
        bare = segment.strip(" \n\t\r")
        if not PLAIN.fullmatch(bare) or "<" in bare and any(s in bare for s in self.special):
            return self._whole(segment)
        pieces = self.pieces
        return b"".join([pieces[p if p.isascii() else p.encode().decode("latin-1").translate(SHOW)] for p in self.plain.findall(bare.lower())])

    def encode(self, texts: list[str], end_id: int | None = None) -> list[bytes]:
        """One byte string of ids for each text, followed by ``end_id`` if given."""
        end = array(self.code, [end_id]).tobytes() if end_id is not None else b""
        get = self.store.__getitem__
        return [b"".join(map(get, segments(t))) + end for t in texts]


_ENCODERS: dict[tuple, SegmentEncoder] = {}
#: Stage the worker's coders were last used in, and the tables that hold them.
_USED_IN: list[int] = [-1]
HELD: list[dict] = [_ENCODERS]


def stage() -> int:
    context = TaskContext.get()
    return context.stageId() if context else -1


def free_other_stages() -> None:
    """Drop this worker's coders unless they serve the current stage: workers outlive stages, their stores need not."""
    if any(HELD) and _USED_IN[0] != stage():
        for table in HELD:
            table.clear()
        gc.collect()


def encoder(path: str, code: str = "I", special_in_text: bool = True) -> SegmentEncoder:
    """The encoder of this worker process; its store outlives a task, not a stage."""
    free_other_stages()
    _USED_IN[0] = stage()
    key = (path, code, special_in_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = SegmentEncoder(*key)
    return _ENCODERS[key]


def text_list(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def id_array(raw: bytes, code: str = "I") -> np.ndarray:
    return np.frombuffer(raw, dtype="<u4" if code == "I" else "<u2")
