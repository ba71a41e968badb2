"""Mixing sources to target weights, in DataFrame functions only.

Every source gets a target in words: the words of all documents are shared out by weight, no source beyond ``max_epochs``
times its own words, and what a source can't take goes to the others by weight. Within a source documents are put in the
order of a hash of their id, running sums of their sizes give each its place, and the source is cut at its budget: as
many whole epochs as fit, then the words up to the cut. The one document that the cut falls into gives its first words.

Sources are ranked and filled by running sums as well, so their number is not bounded, and documents are range-partitioned
by (source, hash), so a source with a third of all rows spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.order_stats import distributed_rank, running_totals
from cellweave.session import forget, stored

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: No source is read more often than this.
MAX_EPOCHS = 3
SEED = 1


def measured(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED,
             carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size in words, key, tie) of every row, and the columns to carry along; stored."""
    taken = {"doc_id", "source", "size", "key", "tie", "row_id"} & set(carry)
    if taken:
        raise ValueError(f"rename the columns {sorted(taken)} before carrying them")
    own = F.coalesce(F.col(id_col).cast("bigint").cast("string"), F.lit(""))
    return stored(docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("bigint").alias("size"),
        F.substring(F.md5(F.concat(own, F.lit(f":{seed}"))), 1, 16).alias("key"),
        (F.xxhash64(*carry) if carry else F.lit(0).cast("bigint")).alias("tie"),
        F.monotonically_increasing_id().alias("row_id"), *carry), "sizes")


def source_sizes(rows: DataFrame) -> DataFrame:
    """(source, source_size, source_no): words of each source and its place in the order of code points, null last."""
    sizes = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    return distributed_rank(sizes, [F.col("source").isNull(), "source"], name="source_no")


def cycled_weights(sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """``sources`` with a column weight: the given weights in turn, by source_no."""
    turn = F.pmod(F.col("source_no") - 1, F.lit(len(weights))).cast("int") + 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)).cast("bigint") for w in weights]), turn))


def with_targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size, source_no, weight) with target and budget (target in whole words), stored.

    In the order of max_epochs * source_size / weight the sources that reach their limit come first. With C the limits
    before a source and W the weights from it on, (total - C) / W is the level that is left if all before it are at
    their limit; it rises up to the first source below its limit and never after, so its maximum is the common level.
    A weight of null or below 1 counts as none: the source's target is 0.
    """
    weighed = stored(sources.withColumn("weight", F.coalesce("weight", F.lit(0)).cast("bigint")), "weights")
    live = weighed.filter("weight > 0").withColumn("limit", F.col("source_size") * F.lit(max_epochs))
    ratio = F.col("limit").cast("double") / F.col("weight").cast("double")
    filled = running_totals(live, [], [ratio, "source_no"], {"limits": F.col("limit"), "weights": F.col("weight")})
    whole = weighed.agg(F.sum("source_size").alias("total")).first()["total"] or 0
    all_weights = live.agg(F.sum("weight").alias("w")).first()["w"] or 0
    level = (F.lit(whole) - (F.col("limits") - F.col("limit"))).cast("double") / (
        F.lit(all_weights) - (F.col("weights") - F.col("weight"))).cast("double")
    top = filled.agg(F.max(level).alias("level")).first()["level"] or 0.0
    target = F.least((F.col("source_size") * F.lit(max_epochs)).cast("double"), F.col("weight").cast("double") * F.lit(float(top)))
    return stored(weighed.withColumn("target", target).withColumn("budget", F.floor(F.col("target") + F.lit(0.5)).cast("bigint")), "targets")


def mix(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, size, source, source_size, target, taken and the carried columns, for every row of ``measured``.

    taken is size times the whole epochs, and in the last epoch what lies before the cut. Rows of one id and size (and
    carried columns) are interchangeable, so reruns give the same rows.
    """
    own = targets.select(F.col("source").alias("_source"), "source_no", "source_size", "target", "budget")
    placed = rows.join(own, rows["source"].eqNullSafe(own["_source"])).drop("_source")
    run = running_totals(placed, ["source_no"], ["key", "doc_id", "size", "tie", "row_id"], {"upto": F.col("size")})
    some = F.col("source_size") > 0
    epochs = F.when(some, F.expr("budget div source_size")).otherwise(F.lit(0))
    rest = F.when(some, F.expr("budget % source_size")).otherwise(F.lit(0))
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("upto") - F.col("size"))))
    carried = [c for c in rows.columns if c not in ("doc_id", "source", "size", "key", "tie", "row_id")]
    return run.select("doc_id", "size", "source", "source_size", "target", (epochs * F.col("size") + last).cast("bigint").alias("taken"), *carried)


def mix_sources(docs: DataFrame, weights: Sequence[int] | DataFrame, max_epochs: int = MAX_EPOCHS, id_col: str = "doc_id",
                source_col: str = "source", text_col: str = "text", seed: int = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """``mix`` of ``docs`` by ``weights``: numbers dealt to the sources in turn, or a table (source, weight).

    A null text has no words; a document without words is taken 0 words of. A null id counts as one more id, a null
    source as one more source, after all others. Rows that repeat an id are documents of their own. Columns other than
    id, source and text are ignored unless carried; an empty table gives an empty result.
    """
    rows = measured(docs, id_col, source_col, text_col, seed, carry)
    sources = source_sizes(rows)
    if isinstance(weights, DataFrame):
        given = weights.select(F.col("source").alias("_source"), "weight")
        sources = sources.join(given, sources["source"].eqNullSafe(given["_source"]), "left").drop("_source")
    else:
        sources = cycled_weights(sources, weights)
    return mix(rows, with_targets(sources, max_epochs))


def written_copies(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """One row for each time a document is read: doc_id, source, epoch (from 1), words, text.

    ``mixed`` carries the text. A copy that the cut falls into holds its first words, joined by one space.
    """
    copies = mixed.filter("taken > 0").select("*", F.explode(F.sequence(
        F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))).alias("epoch"))
    words = F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size"))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), F.lit(1), words.cast("int")), " ")
    return copies.select("doc_id", "source", "epoch", words.alias("words"), F.when(words == F.col("size"), F.col(text_col)).otherwise(cut).alias("text"))


#: Weights of the registered query, dealt to the sources in turn.
WEIGHTS = (5, 2, 1)

ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
  substr(md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}'), 1, 16) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM d GROUP BY source),
w AS (SELECT *, CASE (no - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * {MAX_EPOCHS} AS cap FROM s),
l AS (SELECT *, sum(cap) OVER o - cap AS caps, sum(weight) OVER () - (sum(weight) OVER o - weight) AS weights, sum(source_size) OVER () AS total
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight::DOUBLE, no ROWS UNBOUNDED PRECEDING)),
v AS (SELECT max((total - caps)::DOUBLE / weights::DOUBLE) AS level FROM l),
t AS (SELECT source, source_size, least(cap::DOUBLE, weight::DOUBLE * level) AS target FROM l, v),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM t),
r AS (SELECT d.*, source_size, target, budget, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source, source_size, target, (CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
  + greatest(0, least(size, budget % source_size - before)) END)::BIGINT AS taken FROM r
"""
