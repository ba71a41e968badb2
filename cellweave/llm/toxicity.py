"""Toxicity scores behind disguised spelling: noisy-channel restoration, then a lexical classifier.

A writer's words pass through a channel that swaps letters for look-alikes, stretches them, or sets them apart. For each
suspicious stretch of text the possible readings form a lattice: an observed character is itself or a letter it looks
like, a repeated letter may be one or two, a separator between single characters may be nothing. Viterbi decoding finds
the reading that is likeliest under a character trigram model of the corpus (counted over all documents, per run) and
the channel's costs. Words without any suspicious sign pass as they are.

Scores come from the restored words: each word and each word beginning has a weight, the smoothed log ratio of its
document frequencies in toxic and other labelled documents; a logistic curve over the largest weights is fitted on the
same labelled rows. The classifier is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``), everything else
covers all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import batch_of, id_and_text, small_batches
from cellweave.llm.tokenizing import text_list
from cellweave.session import forget, stored

#: Labelled rows the classifier is fitted on at most: those of the smallest hash of their id.
SAMPLE_ROWS = 40_000
#: Weights kept: those of the most telling words and beginnings. Rows with fewer sightings than MIN_SEEN tell nothing.
MAX_WEIGHTS, MIN_SEEN = 60_000, 3
#: Lengths of word beginnings that carry weights of their own.
BEGINNINGS = (4, 5, 6)

#: What a character may stand for (fixed values).
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h", "%": "x", "&": "a"}
#: Costs of the channel in natural-log units: a swapped character, a letter read once that was written several times,
#: a separator between single characters that is dropped, and one that is kept as a word border.
SWAP, STRETCH, JOIN, BORDER = 1.0, 0.3, 0.2, 2.0
ALPHABET = " abcdefghijklmnopqrstuvwxyzàáâäãåæçèéêëìíîïñòóôöõœùúûüýÿßøšžčćđłńśźżğış"
OTHER = len(ALPHABET)  # one class for every other letter
SIZE = OTHER + 1

_WORDS = re.compile(r"\S+")
_LETTER = re.compile(r"[^\W\d_]")
_STRETCH = re.compile(r"([^\W\d_])\1\1|([^\W\d_])\2.*([^\W\d_])\3")
_DOUBLED = re.compile(r"(.)\1")
_LONG_RUN = re.compile(r"(.)\1{3,}", re.DOTALL)
#: What a pair of brackets holds, and a number with its sign: neither bracket nor sign stands for a letter there.
_PAIRED = re.compile(r"\(([^()]+)\)[.,;:?!\"']*")
_AMOUNT = re.compile(r"\$[0-9]+|[0-9]+%")
_ALIKE = re.compile(r"[0-9@$!|+(<€£¡*#%&]+")
_JOINTS = re.compile(r"[./\\_,;:?\"'=~\[\]{}…–—-]+")
_BETWEEN = r"[\s.,\-_*/\\]"
_SINGLE = r"(?:[^\W_]|[@$!|+€£])"
#: Single characters apart, three or more; what stands around them is anything but a letter or digit (or the rest of "don't").
_SPACED = re.compile(rf"(?<![^\W_])(?<![^\W_]['’]){_SINGLE}(?:{_BETWEEN}++{_SINGLE}){{2,}}(?![^\W_])(?!['’][^\W_])")
_GAP = re.compile(_BETWEEN + "+")
_LAST_SIGNS = re.compile(r"(?: [@$!|+€£])+$")
_INNER = re.compile(r"[0-9@$!|+(<€£¡*#%&]")
#: A look-alike next to a letter at the beginning of a token, or at its end; "!" ends sentences and is none there.
_RIM_START = re.compile(r"[\"'\[{«“„]*[!(*#%&$](?=[^\W\d_])")
_RIM_END = re.compile(r"[^\W\d_][*#%&$][.,;:?!\"')\]}»”…]*$")
_EDGE = ".,;:!?\"'()[]{}«»„“”…-–—*#%&$"
#: Characters of a token read at once, and how many of them the next reading shares.
TOKEN, TOKEN_OVERLAP = 64, 32
#: Tokens whose readings a worker keeps.
KEPT_TOKENS = 1 << 18
#: The same for a stretch of single characters, gaps included.
SPACED, SPACED_OVERLAP = 384, 128
_CODES = np.full(1 << 16, OTHER, dtype=np.int64)


def _fill_codes() -> None:
    for i, c in enumerate(ALPHABET):
        _CODES[ord(c)] = i
        if len(c.upper()) == 1:
            _CODES[ord(c.upper())] = i
    for i in range(128):
        if not chr(i).isalpha():
            _CODES[i] = 0


_fill_codes()
_CODE = {c: i for i, c in enumerate(ALPHABET)}


# --- character model --------------------------------------------------------------------------------------------------

def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each class of character follows two others, over all texts: SIZE**3 counts, whatever the corpus."""
    schema = pa.schema([("gram", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE ** 3, dtype=np.int64)
        for batch in small_batches(batches, 2 << 20):
            text = " ".join(["", *text_list(batch.column("text")), ""])
            points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
            c = _CODES[np.minimum(points, 0xFFFF)]
            c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]  # one border between words
            grams = (c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:]
            total += np.bincount(grams, minlength=SIZE ** 3)
        used = np.flatnonzero(total)
        if len(used):
            yield batch_of(schema, used.astype(np.int32), total[used])

    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "gram int, n bigint")
    out = np.zeros(SIZE ** 3, dtype=np.int64)
    for r in rows.groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r["gram"]] = r["n"]
    return out


def trigram_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of the third class given two, interpolated with shorter contexts; shape (SIZE, SIZE, SIZE)."""
    c3 = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
    c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
    p1 = (c1 + 1) / (c1.sum() + SIZE)
    p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
    p3 = (c3 + 5 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


# --- restoration ------------------------------------------------------------------------------------------------------

class Restorer:
    """Reads suspicious stretches as the likeliest letters; bounded store of readings per worker."""

    def __init__(self, model: np.ndarray):
        # A list of floats is read faster than an array, element by element.
        self.model = model.astype(np.float64).ravel().tolist()
        self.known: dict[str, tuple[str, ...]] = {}
        self.word = lru_cache(1 << 16)(self._word)
        self.spaced = lru_cache(1 << 14)(self._spaced)

    def _options(self, c: str) -> list[tuple[str, float]]:
        out = [(c, 0.0)] if c in _CODE or c.isalpha() else []
        out += [(x, SWAP) for x in LOOKALIKES.get(c, "")]
        return out or [("", JOIN)]

    def lattice(self, text: str, apart: bool) -> list[list[tuple[str, float]]]:
        """Options (letters, cost) of each position of a stretch."""
        steps: list[list[tuple[str, float]]] = []
        i = 0
        while i < len(text):
            c = text[i]
            j = i + 1
            while j < len(text) and text[j] == c:
                j += 1
            if apart and c in " .-_*" and steps:
                steps.append([("", JOIN), (" ", BORDER)])
            else:
                once = self._options(c)
                n = j - i
                if n == 1:
                    steps.append(once)
                elif n == 2:
                    steps.append([(s * 2, w * 2) for s, w in once] + [(s, w * 2 + STRETCH) for s, w in once])
                else:
                    steps.append([(s, w * 2 + STRETCH) for s, w in once] + [(s * 2, w * 2 + STRETCH) for s, w in once])
            i = j
        return steps

    def decode(self, steps: list[list[tuple[str, float]]]) -> str:
        """Cheapest path through the lattice; a state is the last two classes, ties go to the first option listed.

        What comes before the first choice and beyond two letters after the last one costs every path the same.
        """
        choices = [i for i, options in enumerate(steps) if len(options) > 1]
        if not choices:
            return "".join([options[0][0] for options in steps]).strip()
        model, code = self.model, _CODE.get
        before = "".join([options[0][0] for options in steps[:choices[0]]])
        after = "".join([options[0][0] for options in steps[choices[-1] + 1:]])
        a, b = ([0, 0] + [code(ch, OTHER) for ch in before[-2:]])[-2:]
        best: dict[tuple[int, int], tuple[float, tuple]] = {(a, b): (0.0, ())}
        for options in [*steps[choices[0]:choices[-1] + 1], [((after + " ")[:2], 0.0)]]:
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, path) in best.items():
                for s, w in options:
                    x, y, total = a, b, cost + w
                    for ch in s:
                        z = code(ch, OTHER)
                        total -= model[(x * SIZE + y) * SIZE + z]
                        x, y = y, z
                    known = new.get((x, y))
                    if known is None or total < known[0]:
                        new[x, y] = (total, (path, s))
            best = new
        path = min(best.values(), key=lambda v: v[0])[1][0]  # without the letters after it
        out = [after]
        while path:
            path, s = path
            out.append(s)
        out.append(before)
        return "".join(reversed(out)).strip()

    def _word(self, word: str) -> str:
        return self.decode(self.lattice(word, apart=False))

    def _spaced(self, text: str) -> str:
        return self.decode(self.lattice(text, apart=True))

    def apart(self, text: str) -> list[str]:
        """Words read from single characters that stand apart in a lower-case text."""
        out = []
        for m in _SPACED.finditer(text):
            stretch = _GAP.sub(" ", m[0])
            # A sign at the end may be a letter or punctuation.
            for read in {stretch, _LAST_SIGNS.sub("", stretch)}:
                # A stretch of single characters longer than any word is read in overlapping windows.
                for i in range(0, max(len(read) - SPACED_OVERLAP, 1), SPACED - SPACED_OVERLAP):
                    out += self.spaced(read[i:i + SPACED]).split()
        return out

    def forms(self, w: str) -> tuple[str, ...]:
        """The plain form of a token and, where it is suspicious, its readings; kept for the next time."""
        got = self.known.get(w)
        if got is None:
            core = w.strip(_EDGE)
            got = (core,) if core else ()
            if suspicious(w, core):
                got += tuple(self.token(w, core))
            if len(self.known) >= KEPT_TOKENS:
                self.known.clear()
            if len(w) <= TOKEN:
                self.known[w] = got
        return got

    def words(self, text: str) -> list[str]:
        """Lower-case words of a text with suspicious ones restored next to their plain form."""
        text = text.lower()
        out = self.apart(text)
        known = self.known.get
        for w in set(text.split()):
            out += known(w) or self.forms(w)
        return out

    def token(self, w: str, core: str) -> list[str]:
        """Readings of a suspicious token: as a whole, without punctuation around it, and of each part between joints."""
        tail = w.rstrip(".,;:?\"')]}")
        forms = {tail, tail.lstrip("\"'([{"), core}
        parts = [x for x in _JOINTS.split(tail) if x]
        if len(parts) > 1:
            forms.update(x for x in parts if suspicious(x, x.strip(_EDGE)))
        # A single sign is also read as each letter it looks like, whatever the corpus says.
        out = [x.replace(sign[0], v) for x in forms if len(sign := _INNER.findall(x)) == 1 for v in LOOKALIKES[sign[0]]]
        for form in sorted(forms):
            if form.isalpha() and not _DOUBLED.search(form):
                out.append(form)
                continue
            form = _LONG_RUN.sub(r"\1\1\1", form)  # the lattice reads all runs from three on alike
            for i in range(0, max(len(form) - TOKEN_OVERLAP, 1), TOKEN - TOKEN_OVERLAP):
                out.append(self.word(form[i:i + TOKEN]))
        return [x for x in out if x]


def suspicious(w: str, core: str) -> bool:
    """Look-alikes among or next to letters or at least two kinds of them alone, a letter three times, or two letters twice each."""
    if not w.isalpha() and _INNER.search(w):
        if _LETTER.search(w):
            paired = _PAIRED.fullmatch(w)
            rim = paired[1] if paired else w
            if _INNER.search(core) or len(rim) - len(rim.strip(_EDGE)) > 1 or _RIM_END.search(rim) or _RIM_START.match(rim) and not (
                    "(" in rim and ")" in rim):
                return True
        else:
            alone = w.strip(".,;:?\"')]}[{")
            if _AMOUNT.fullmatch(alone):
                return False
            if _ALIKE.fullmatch(alone) and len(set(alone)) > 1 or len(_JOINTS.split(alone)) > 1 and any(
                    _ALIKE.fullmatch(x) and len(set(x)) > 1 for x in _JOINTS.split(alone)):
                return True
    return _STRETCH.search(w) is not None


def features(words: list[str]) -> set[str]:
    """Words and word beginnings (marked by a trailing star) of one document."""
    out = set(words)
    for n in BEGINNINGS:
        out |= {w[:n] + "*" for w in words if len(w) > n}
    return out


# --- classifier -------------------------------------------------------------------------------------------------------

def is_held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most ``rows`` labelled documents that are not held out, the smallest hashes of their ids."""
    chosen = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).filter(~is_held_out()).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    small = stored(chosen, "training-ids")  # bounded by ``rows``, so it may be broadcast
    return id_and_text(docs).join(F.broadcast(small), "doc_id")


class Scorer:
    """Weights of words and beginnings, and the curve over the largest of them."""

    def __init__(self, model: np.ndarray, weights: dict[str, float], curve: np.ndarray):
        self.model, self.weights, self.curve = model, weights, curve

    def score(self, evidence: np.ndarray) -> np.ndarray:
        z = evidence @ self.curve[:-1] + self.curve[-1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Judge:
    """Evidence of texts under a scorer."""

    def __init__(self, scorer: Scorer):
        self.scorer, self.restorer = scorer, Restorer(scorer.model)

    def evidence(self, text: str) -> tuple[float, float, float]:
        """(largest weight, mean of the three largest, the smallest below zero) of a document's words and beginnings."""
        found = sorted([w for w in map(self.scorer.weights.get, features(self.restorer.words(text))) if w is not None], reverse=True)
        return (found[0], sum(found[:3]) / 3, min(found[-1], 0.0)) if found else (0.0, 0.0, 0.0)

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.scorer.score(np.array([self.evidence(t) for t in texts]).reshape(-1, 3))


def training_features(train: DataFrame, model: np.ndarray) -> DataFrame:
    """(y, f): label and distinct features of each training row, stored; at most SAMPLE_ROWS rows are read and decoded once."""
    schema = pa.schema([("y", pa.int32()), ("f", pa.list_(pa.string()))])
    shared = train.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in small_batches(batches, 1 << 20):
            ys = [int(y == 1) for y in batch.column("toxic").to_pylist()]
            yield batch_of(schema, ys, [sorted(features(restorer.words(t))) for t in text_list(batch.column("text"))])

    return stored(train.mapInArrow(run, "y int, f array<string>"), "training-features", "zstd")


def feature_counts(seen: DataFrame) -> tuple[dict[str, tuple[int, int]], int, int]:
    """Document counts (toxic, other) of the most telling words and beginnings, and the two totals."""
    schema = pa.schema([("f", pa.string()), ("t", pa.int64()), ("o", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            counts = {0: Counter(), 1: Counter()}
            for y, fs in zip(batch.column("y").to_pylist(), batch.column("f").to_pylist()):
                counts[y].update(fs)
                counts[y][""] += 1
            names = list(counts[0].keys() | counts[1].keys())
            yield batch_of(schema, names, [counts[1][f] for f in names], [counts[0][f] for f in names])

    counts = stored(seen.mapInArrow(run, "f string, t bigint, o bigint").groupBy("f").agg(
        F.sum("t").alias("t"), F.sum("o").alias("o")), "feature-counts")
    total = counts.filter("f = ''").first()
    n_toxic, n_other = (total["t"], total["o"]) if total else (0, 0)
    share_t, share_o = (F.col("t") + 0.5) / (n_toxic + 1), (F.col("o") + 0.5) / (n_other + 1)
    telling = counts.filter(f"f <> '' and t + o >= {MIN_SEEN}").orderBy(
        F.desc(F.abs(F.log(share_t / share_o)) * F.sqrt(F.col("t") + F.col("o"))), "f").limit(MAX_WEIGHTS)
    out = {r["f"]: (r["t"], r["o"]) for r in telling.collect()}
    forget(counts)
    return out, n_toxic, n_other


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Count the corpus, then learn weights and curve; without labelled rows of both kinds every score is the smoothed base rate."""
    model = trigram_model(trigram_counts(docs))
    train = stored(training_rows(docs, labels), "training")
    seen = training_features(train, model)
    forget(train)
    counts, n_toxic, n_other = feature_counts(seen)
    weights = {}
    for f, (t, o) in counts.items():
        # Half a sighting on either side, and a prior of the base rates for rare words.
        weights[f] = math.log((t + 0.3) / (n_toxic + 1)) - math.log((o + 0.3) / (n_other + 1))
    scorer = Scorer(model, weights, np.array([0.0, 0.0, 0.0, math.log((n_toxic + 0.5) / (n_other + 0.5))]))
    if n_toxic and n_other:
        # Each document is judged by weights from which its own sightings are taken out.
        rows = _left_out_evidence(seen, counts, n_toxic, n_other)
        scorer.curve = _logistic(rows[:, :3], rows[:, 3])
    forget(seen)
    return scorer


def _left_out_evidence(seen: DataFrame, counts: dict[str, tuple[int, int]], n_toxic: int, n_other: int) -> np.ndarray:
    """Rows (evidence..., label) of the training documents, at most SAMPLE_ROWS."""
    shared = seen.sparkSession.sparkContext.broadcast(counts)
    schema = pa.schema([("a", pa.float64()), ("b", pa.float64()), ("c", pa.float64()), ("y", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, both = pa.array(list(shared.value)), np.array(list(shared.value.values()), dtype=np.int64).reshape(-1, 2)
        for batch in small_batches(batches):
            lists, y = batch.column("f"), batch.column("y").to_numpy()
            row = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
            at = pc.fill_null(pc.index_in(lists.flatten(), value_set=names), -1).to_numpy()
            row, at = row[at >= 0], at[at >= 0]
            own = y[row]
            t, o = both[at, 0] - own, both[at, 1] - (1 - own)
            some = t + o >= MIN_SEEN
            row, own, t, o = row[some], own[some], t[some], o[some]
            w = np.log((t + 0.3) / (n_toxic + 1 - own)) - np.log((o + 0.3) / (n_other + own))
            order = np.lexsort((-w, row))
            row, w = row[order], w[order]
            out = np.zeros((4, len(y)))
            out[3] = y
            first, n = np.searchsorted(row, np.arange(len(y))), np.bincount(row, minlength=len(y))
            for i in np.flatnonzero(n):
                found = w[first[i]:first[i] + n[i]]
                out[:3, i] = found[0], found[:3].sum() / 3, min(found[-1], 0.0)
            yield batch_of(schema, *out)

    got = seen.mapInArrow(run, "a double, b double, c double, y double").toPandas()
    return got.to_numpy(dtype=np.float64).reshape(-1, 4)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; coefficients and intercept."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + penalty, x1.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_documents(docs: DataFrame, scorer: Scorer, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for every row; only the text enters a score.

    A null or empty text has no words and gets the score of no evidence. Null and repeated ids stay as they are, other
    columns are ignored, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in small_batches(batches):
            yield batch_of(schema, batch.column("doc_id"), judge.scores(text_list(batch.column("text"))))

    scored = id_and_text(docs).mapInArrow(run, "doc_id bigint, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def score_all(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, learned from the labels of rows that are not held out."""
    return score_documents(docs, fit(docs, labels), threshold).select(
        "doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that are predicted toxic; all columns kept, texts scored where they are scanned.

    A null or empty text has no words and gets the score of no evidence; it stays unless that is toxic. Null and repeated
    ids stay as they are, rows that repeat are judged alike, an empty table stays empty. Columns may have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in small_batches(batches):
            clean = judge.scores([t or "" for t in batch.column(at).to_pylist()]) < threshold
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
