"""Byte-pair encoding by backtracking, and decoding by an offset table.

The merges of a vocabulary define which token sequences are reachable. An Aho-Corasick automaton over the token strings
gives, at every position, the longest token and from it the next shorter ones. The encoder takes the longest token and
keeps it if the pair with the token before is compatible, that is, if merging the two strings by rank yields exactly that
pair; otherwise it tries the next shorter token, or goes back over the last one. Every position is marked once it turns
out to be a dead end, so each is visited once and the work is linear in the length of the piece.

Normalisation and splitting into pieces follow the tokenizer file; only the merges are done here.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cellweave.llm.common import batch_of, id_and_text, small_batches
from cellweave.llm.tokenizing import _USED_IN, HELD, MAX_PIECES, MAX_SEGMENTS, PLAIN, SHOW, UNBYTE, Store, free_other_stages, plain_split, segments, stage, text_list

NO_TOKEN = -1


class MergeTable:
    """Pair compatibility: whether a token may follow another in the result of merging by rank."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.text = {i: t for t, i in vocab.items()}
        self.pairs: dict[tuple[int, int], int] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            made = vocab.get(a + b)
            if a in vocab and b in vocab and made is not None and (vocab[a], vocab[b]) not in self.rank:
                self.rank[vocab[a], vocab[b]] = r
                self.pairs[vocab[a], vocab[b]] = made
        #: First merge that makes a token, hence how it comes apart again, and when it is made.
        self.halves: dict[int, tuple[int, int]] = {}
        self.made_at: dict[int, int] = {}
        for pair, r in self.rank.items():
            made = self.pairs[pair]
            if made not in self.made_at or r < self.made_at[made]:
                self.halves[made], self.made_at[made] = pair, r
        self._known: dict[tuple[int, int], bool] = {}

    def reachable(self, token: int) -> bool:
        """Whether merging the token's own string ends in the token."""
        if token not in self.halves:
            return True
        return self._check(*self.halves[token], limit=self.made_at[token])

    def compatible(self, left: int, right: int) -> bool:
        """Undo the merges of both tokens, latest first: at no step may a merge across the border come earlier."""
        key = (left, right)
        if (known := self._known.get(key)) is not None:
            return known
        out = self._check(left, right)
        if len(self._known) > 1_000_000:
            self._known.clear()
        self._known[key] = out
        return out

    def _check(self, a: int, b: int, limit: float = float("inf")) -> bool:
        while True:
            across = self.rank.get((a, b))
            if across is not None and across < limit:
                return False
            ra, rb = self.made_at.get(a, -1), self.made_at.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # Of equal merges the leftmost goes first: one across the border ties with the right token's, not the left's.
            if ra > rb:
                limit, a = ra, self.halves[a][1]
            else:
                limit, b = rb + 1, self.halves[b][0]


class BacktrackingEncoder:
    """Exact BPE of one piece, over strings of the byte alphabet of the vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.table = MergeTable(vocab, merges)
        self.vocab, self.suffix = vocab, suffix
        self.automaton = ahocorasick.Automaton()
        reachable = {t for t in vocab if self._atom(t)} | {
            self.table.text[i] for i in self.table.halves if self.table.reachable(i)}
        #: The end-of-word mark is one symbol: with it, a token's length in symbols is shorter than in characters.
        for t in reachable:
            self.automaton.add_word(self._pack(t), vocab[t])
        self.automaton.make_automaton()
        self.symbols = {vocab[t]: len(self._pack(t)) for t in reachable}
        self._shorter: dict[int, int] = {}

    def _atom(self, token: str) -> bool:
        return len(self._pack(token)) == 1

    def _pack(self, token: str) -> str:
        """The token with its last character and the suffix as one private symbol."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[:-len(self.suffix)]
            return body[:-1] + chr(0xF0000 + ord(body[-1]))
        return token

    def _longest_from(self, packed: str) -> list[int]:
        """Longest token that starts at each position."""
        best = [NO_TOKEN] * len(packed)
        size = [0] * len(packed)
        # iter reports every token that ends at a position, longest first, so earlier starts come with longer tokens.
        for end, token in self.automaton.iter(packed):
            n = self.symbols[token]
            start = end - n + 1
            if n > size[start]:
                best[start], size[start] = token, n
        return best

    def _next_shorter(self, token: int) -> int:
        """Longest token that is a proper prefix of ``token``."""
        if (known := self._shorter.get(token)) is not None:
            return known
        packed = self._pack(self.table.text[token])
        out = NO_TOKEN
        for n in range(len(packed) - 1, 0, -1):
            found = self.automaton.get(packed[:n], NO_TOKEN)
            if found != NO_TOKEN:
                out = found
                break
        self._shorter[token] = out
        return out

    def encode(self, piece: str) -> list[int]:
        """Ids of a piece; a symbol without token is left out, as in a vocabulary without an unknown token."""
        if not piece:
            return []
        packed = self._pack(piece + self.suffix) if self.suffix else piece
        longest = self._longest_from(packed)
        if NO_TOKEN in longest:  # such symbols separate the rest
            out, part = [], []
            for i in range(len(packed) + 1):
                if i == len(packed) or longest[i] == NO_TOKEN:
                    if part:
                        out += self._search("".join(part))
                    part = []
                else:
                    part.append(packed[i])
            return out
        return self._search(packed, longest)

    def _search(self, packed: str, longest: list[int] | None = None) -> list[int]:
        longest = longest or self._longest_from(packed)
        n, at, token, out = len(packed), 0, longest[0], []
        open_ = bytearray(b"\1") * (n + 1)
        size, compatible = self.symbols, self.table.compatible
        while True:
            end = at + size[token]
            if open_[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
                continue
            token = self._next_shorter(token)
            while token == NO_TOKEN:
                open_[at] = 0
                token = out.pop()
                at -= size[token]
                token = self._next_shorter(token)


class WholeTextBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str, special_in_text: bool = True):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.tokenizer = Tokenizer.from_file(path)
        self.core = BacktrackingEncoder(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]} if special_in_text else {}
        self.special = special
        self.special_split = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.pieces = Store(lambda piece: array("I", self.core.encode(piece)).tobytes(), MAX_PIECES)
        self.store = Store(self._segment, MAX_SEGMENTS)
        self.plain = plain_split(spec)
        size = max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        strings = [""] * size
        for t, i in [*model["vocab"].items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]:
            strings[i] = t
        self.byte_level = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        added = {t["id"] for t in spec["added_tokens"]}
        raw = [self._plain(s, i in added) for i, s in enumerate(strings)]
        #: Offset table: the bytes of token i are data[offset[i]:offset[i + 1]].
        self.offset = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        self.data = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def _plain(self, token: str, added: bool) -> bytes:
        """Bytes a token stands for. Without a decoder the library joins token strings by spaces, so one follows each."""
        if not self.byte_level:
            return token.encode() + b" "
        return token.encode() if added else bytes(UNBYTE[c] for c in token)

    def _segment(self, text: str) -> bytes:
        if self.plain:
            bare = text.strip(" \n\t\r")
            if PLAIN.fullmatch(bare) and not (self.special_split and self.special_split.search(bare)):
                return b"".join([self._piece(p) for p in self.plain.findall(bare.lower())])
        out: list[bytes] = []
        for part in self.special_split.split(text) if self.special_split else [text]:
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                out += [self.pieces[piece] for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        return b"".join(out)

    def _piece(self, piece: str) -> bytes:
        return self.pieces[piece if piece.isascii() else piece.encode().decode("latin-1").translate(SHOW)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.store.__getitem__, segments(text)))

    def decode(self, raw: bytes, chunk: int = 1 << 18) -> bytes:
        """UTF-8 bytes of the decoded text; invalid bytes become U+FFFD, as in the library."""
        ids = np.frombuffer(raw, dtype="<u4")
        out = []
        for i in range(0, len(ids), chunk):
            part = ids[i:i + chunk]
            first = self.offset[part]
            n = self.offset[part.astype(np.int64) + 1] - first
            ends = np.cumsum(n)
            at = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
            out.append(self.data[at + np.repeat(first - (ends - n), n)].tobytes())
        text = b"".join(out)
        if not self.byte_level:
            return text[:-1]
        return text.decode("utf-8", "replace").encode()


_CODERS: dict[tuple[str, bool], WholeTextBpe] = {}
HELD.append(_CODERS)


def coder(path: str, special_in_text: bool = True) -> WholeTextBpe:
    """The coder of this worker process."""
    free_other_stages()
    _USED_IN[0] = stage()
    if (path, special_in_text) not in _CODERS:
        _CODERS[path, special_in_text] = WholeTextBpe(path, special_in_text)
    return _CODERS[path, special_in_text]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", special_in_text: bool = True) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32 bit), decoded (binary, UTF-8): one row per row of ``docs``.

    A null text counts as empty and gives no ids; repeated ids and null ids stay as they are; other columns are ignored.
    ``path`` must be readable on every worker. Special-token strings in a text become their ids, as the library does by
    default, unless ``special_in_text`` is false.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, special_in_text)
        for batch in small_batches(batches):
            ids = [own.encode(t) for t in text_list(batch.column("text"))]
            yield batch_of(schema, batch.column("doc_id"), ids, [own.decode(x) for x in ids])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids binary, decoded binary")
