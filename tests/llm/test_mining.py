"""Hard negatives, periodic runs and source mixing against brute force and SQL, with awkward rows in every table."""

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oracle import compare, connection

from cellweave.llm import hard_negatives, mixing, periodic_runs


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- hard negatives ---------------------------------------------------------------------------------------------------

def mined(rows, positives=5, negatives=10, every=100):
    """The same by comparing every pair, in Python integers."""
    rows = [(i, [math.floor(Fraction(x) * 256) for x in v], y) for i, v, y in rows]
    clamp = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    out = []
    for a, v, y in rows:
        if a % every:
            continue
        scored = [(-clamp(sum(p * q for p, q in zip(v, w))), b, z) for b, w, z in rows if b != a]
        for ps, p, _ in sorted(s for s in scored if s[2] == y)[:positives]:
            fit = sorted(s for s in scored if s[2] != y and 30 * -ps <= 100 * -s[0] <= 90 * -ps)[:negatives]
            out += [(a, p, r, n, -ps, -ns) for r, (ns, n, _) in enumerate(fit, 1)]
    return collections.Counter(out)


def found(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_hard_negatives_equal_sql(spark, sf):
    assert compare(spark, connection(sf), entry.queries()["op11_hard_negatives"], entry.oracle_sql()["op11_hard_negatives"], sf) is None


@pytest.mark.parametrize("block", [40, 100_000])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block):
    """Many small blocks, seeds and chunks, clustered vectors for which bounds close, copies and ties."""
    monkeypatch.setattr(hard_negatives, "CHUNK", 7)
    r = np.random.default_rng(4)
    centres = r.normal(size=(5, 6))
    rows = [(int(i), [float(x) for x in centres[i % 5] + 0.05 * r.normal(size=6)], int(i % 3)) for i in range(900)]
    rows += [(1000 + i, rows[30][1], 0) for i in range(200)] + [(2000 + i, [0.5] * 6, i % 2) for i in range(150)] + [(100, [0.1] * 6, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    want = mined(rows, every=20)
    assert found(hard_negatives.mine(df, F.col("vec_id") % 20 == 0, block=block)) == want and want


def test_bounds_skip_rows_and_lose_none():
    r = np.random.default_rng(1)
    x = np.floor(256 * np.concatenate([r.normal(size=(300, 8)) + 4, r.normal(size=(300, 8)) - 4]))
    a = np.floor(256 * (r.normal(size=(40, 8)) * 0.2 + 4))
    order, parent, edge = hard_negatives._tree(a)
    assert sorted(order) == list(range(40)) and all(parent[i] < i for i in range(1, 40))
    chunk = hard_negatives.Chunk(np.arange(40), np.arange(40), 0, a[order], parent, edge, [[] for _ in order])
    exact = a[order] @ x.T
    low = np.quantile(exact, 0.9, axis=1)
    scores, known = chunk.scores(x, np.sqrt((x * x).sum(axis=1)), low, np.full(40, np.inf))
    assert known[exact >= low[:, None]].all() and (scores[known] == exact[known]).all()
    assert known[1:].mean() < 0.6


def test_hard_negatives_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(0, None, 1), (1, [nan, 1.0], 1), (2, [inf, 1.0], 1), (3, [None, 1.0], 1), (None, [1.0, 1.0], 1), (4, [1.0, 1.0], None), (5, [], 1), (6, [1.0], 1)]
    huge = [(200, [1e300, 1.0], 0), (300, [1e300, 0.5], 0), (301, [9e299, 1.0], 1), (302, [1e9, 1e9], 1)]
    good = [(100, [1.0, 2.0], 0), (100, [1.0, 2.0], 0), (101, [1.0, 2.0], 0), (102, [0.5, 1.0], 1), (102, [0.5, 1.0], 1), (103, [0.0, 0.0], 1), (104, [-1.0, 3.0], 2)]
    schema = "vec_id bigint, embedding array<double>, label int, rank string, key int"
    df = spark.createDataFrame([(*r, "x", 1) for r in bad + good + huge], schema)
    assert found(hard_negatives.mine(df, F.col("vec_id") % 100 == 0)) == mined(good + huge)
    for rows in ([], bad[:6]):
        assert hard_negatives.mine(spark.createDataFrame([(*r, "x", 1) for r in rows], schema), F.col("vec_id") % 100 == 0).count() == 0


# --- periodic runs ----------------------------------------------------------------------------------------------------

def runs_by_hand(w, min_words=24, min_periods=3):
    """Maximal stretches of each period, those with their smallest period."""
    n, best = len(w), {}
    for q in range(1, n // min_periods + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and w[i] == w[i - q]:
                i += 1
            if i - start >= max(min_words, min_periods * q):
                best.setdefault((start, i - start), q)
    return sorted(((s, m, q) for (s, m), q in best.items()), key=lambda r: (r[0], r[2]))


def collapsed_by_hand(w, runs):
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    return [x for i, x in enumerate(w) if i not in drop]


def found_runs(texts, **kw):
    import pyarrow as pa
    w, ends = periodic_runs.texts_as_words(pa.array(texts))
    got = periodic_runs.runs_of(w, ends, **kw)
    return [got.get(i, []) for i in range(len(texts))]


@pytest.mark.parametrize("limits", [(24, 3), (6, 3), (10, 4), (1, 3)])
def test_runs_equal_brute_force(limits):
    r = random.Random(5)
    texts = []
    for _ in range(150):
        w = [r.choice("abcd") for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            unit = [r.choice("ab" if r.random() < 0.5 else "abcdefgh") for _ in range(r.choice([1, 2, 3, 5, 8, 15, 17, 33, 40]))]
            w += (unit * 9)[: int(len(unit) * r.uniform(2, 6))] + [r.choice("abcdxyz") for _ in range(r.randint(0, 20))]
        texts.append(" ".join(w))
    texts += ["a " * 200, "", "x", "a b " * 100 + "a", ("a " * 30 + "b ") * 12, ("a b " * 15 + "c ") * 6]
    got = found_runs(texts, min_words=limits[0], min_periods=limits[1])
    for text, runs in zip(texts, got):
        assert runs == runs_by_hand(text.split(), *limits), text
    assert sum(map(len, got)) > 20


def test_words_dropped_and_the_best_run():
    runs = [(2, 24, 3), (30, 30, 2), (61, 45, 3)]
    keep = periodic_runs.kept_words(110, runs)
    assert [i for i in range(110) if not keep[i]] == [*range(5, 26), *range(32, 60), *range(64, 106)]
    assert periodic_runs.highest(runs) == (30, 30, 2) and periodic_runs.highest([]) is None


def test_long_texts_take_bounded_steps():
    (many,), (deep,) = found_runs(["w " * 300_000]), found_runs([" ".join(str(i % 9_000) for i in range(40_000))])
    assert many == [(0, 300_000, 1)] and deep == [(0, 40_000, 9_000)]


def contract12(doc_id, text):
    w = words(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
            sha(" ".join(collapsed_by_hand(w, runs))))


def test_op12_contract(spark, sf):
    got = entry.queries()["op12_periodic_runs"](spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    docs = [r for r in docs if len(r["text"] or "") < 12_000]
    want = {r["doc_id"]: contract12(*r) for r in docs}
    rows = {r["doc_id"]: tuple(r) for r in got.collect()}
    assert {k: rows[k] for k in want} == want and any(w[1] for w in want.values())


def test_runs_of_awkward_tables(spark):
    rows = [(1, None, 1, "x"), (2, "", 2, None), (None, "a " * 40, 3, "y"), (3, "b\tb\n" * 20, 4, "z"), (3, "b\tb\n" * 20, 4, "z"),
            (4, "é\x1cé " * 30, 5, ""), (5, "x " * 100_000 + "y", 6, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, runs int, highest string")
    got = sorted(((r["doc_id"] or -1, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.periodic_runs(df).collect()), key=repr)
    want = [(1, 0, [], ""), (2, 0, [], ""), (-1, 40, [(0, 40, 1)], "a"), (3, 40, [(0, 40, 1)], "b"), (3, 40, [(0, 40, 1)], "b"),
            (4, 30, [(0, 30, 1)], "é\x1cé"), (5, 100_001, [(0, 100_000, 1)], "x y")]
    assert got == sorted(want, key=repr)
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0
    planted = periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_planted_runs(df)))
    by_id = collections.Counter(tuple(r) for r in planted.collect() if r["doc_id"] in (1, 2, 3, 4))
    assert by_id == collections.Counter(contract12(i, t) for i, t, _, _ in rows if i in (1, 2, 3, 4))


# --- mixing -----------------------------------------------------------------------------------------------------------

def targets_by_hand(sizes, weights, limit=3):
    """Level by giving out the excess again and again, in exact fractions."""
    left, full = Fraction(sum(sizes)), {}
    while True:
        rest = [i for i in range(len(sizes)) if i not in full]
        weight = sum(weights[i] for i in rest)
        share = {i: left * weights[i] / weight for i in rest} if weight else dict.fromkeys(rest, Fraction(0))
        over = [i for i in rest if share[i] > limit * sizes[i]]
        if not over:
            return [full.get(i, share.get(i)) for i in range(len(sizes))]
        for i in over:
            full[i] = Fraction(limit * sizes[i])
            left -= full[i]


def check_mix(docs, rows, weights):
    sources = sorted({s for _, _, s in docs if s is not None}) + ([None] if any(s is None for _, _, s in docs) else [])
    sizes = [sum(len(words(t)) for _, t, s in docs if s == x) for x in sources]
    want = targets_by_hand(sizes, [weights[i % len(weights)] for i in range(len(sources))])
    by = dict(zip(sources, zip(sizes, want)))
    assert len(rows) == len(docs)
    taken = collections.Counter()
    for r in rows:
        size, target = by[r["source"]]
        assert r["source_size"] == size and r["target"] == pytest.approx(float(target), rel=1e-12)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, (_, target) in by.items():
        assert abs(taken[s] - target) <= Fraction(1, 2) + Fraction(1, 1000)
    return taken


def test_mix_equals_sql(spark, sf):
    assert compare(spark, connection(sf), entry.queries()["op13_source_mix"], entry.oracle_sql()["op13_source_mix"], sf) is None


def test_mix_runs_without_python(spark, sf):
    plan = entry.queries()["op13_source_mix"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_of_random_sources(spark, seed):
    r = random.Random(seed)
    docs = [(i, "w " * r.choice([0, 1, 7, 40]), f"s{int(r.paretovariate(0.6))}") for i in range(400)]
    got = mixing.mix_sources(spark.createDataFrame(docs, "doc_id bigint, text string, source string"), (5, 2, 1))
    check_mix(docs, got.collect(), (5, 2, 1))


def test_mix_of_awkward_tables(spark):
    docs = [(1, None, "a"), (2, "", "a"), (None, "x y z", "a"), (None, "x y z", None), (3, "p q " * 5, None), (3, "p q " * 5, None), (3, "p\tq\n" * 5, None),
            (4, "z " * 20_000, "b"), (5, None, "empty"), (6, "é ü", ""), (7, "one", "Ä"), (8, "two three", "z")]
    df = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id bigint, text string, source string, size int, key string")
    rows = mixing.mix_sources(df, (5, 2, 1)).collect()
    check_mix(docs, rows, (5, 2, 1))
    again = mixing.mix_sources(df.repartition(5), (5, 2, 1)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert mixing.mix_sources(df.limit(0), (5, 2, 1)).count() == 0
    nothing = mixing.mix_sources(df.filter("text is null"), (5, 2, 1)).collect()
    assert [(r["target"], r["taken"]) for r in nothing] == [(0.0, 0)] * 2


def test_one_id_in_a_third_of_the_rows_spreads(spark):
    docs = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    rows = mixing.measured(docs)
    plan = mixing.mix(rows, mixing.with_targets(mixing.cycled_weights(mixing.source_sizes(rows), (5,))))
    taken = plan.groupBy(F.spark_partition_id()).count().collect()
    assert plan.agg(F.sum("taken")).first()[0] == 90_000 and max(r["count"] for r in taken) < 15_000


def test_written_copies_and_given_weights(spark):
    docs = spark.createDataFrame([(i, f"w{i} x y\tz", "ab"[i % 2]) for i in range(50)] + [(99, "only words here", "c")], "doc_id bigint, text string, source string")
    weights = spark.createDataFrame([("a", 3), ("b", 1)], "source string, weight int")
    mixed = mixing.mix_sources(docs, weights, carry=["text"])
    copies = mixing.written_copies(mixed).collect()
    per_source = collections.Counter()
    for c in copies:
        assert len(words(c["text"])) == c["words"] > 0
        per_source[c["source"]] += c["words"]
    total = 203
    assert per_source == {"a": round(total * 3 / 4), "b": round(total / 4)}
    with pytest.raises(ValueError):
        mixing.mix_sources(docs.withColumn("key", F.lit(1)), weights, carry=["key"])
