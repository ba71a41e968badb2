"""Shared Spark inputs and SQL building blocks of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave import fixtures as X
from cellweave.functions.scalars import rounded
from cellweave.operators import normalize, quality
from cellweave.session import cut_lineage

# ---- Spark inputs -----------------------------------------------------------


def coded_cells(spark: SparkSession, sf: str) -> DataFrame:
    return quality.with_cell_codes(X.cells(spark, sf), X.QC)


def qc_cells(spark: SparkSession, sf: str) -> DataFrame:
    return quality.run_quality_control(X.cells(spark, sf), X.images(spark, sf), X.QC)


def valid_cells(spark: SparkSession, sf: str) -> DataFrame:
    return qc_cells(spark, sf).filter("is_valid")


def z_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Valid cells z-scored against the valid control cells. The quality control runs once, not in each pass over them."""
    valid = cut_lineage(valid_cells(spark, sf))
    out, _ = normalize.normalise(valid, valid.filter(F.col("treatment") == X.CONTROL), X.FEATURES)
    return out


def r(name: str | Column, digits: int = 6, alias: str | None = None) -> Column:
    col = F.col(name) if isinstance(name, str) else name
    return rounded(col, digits).alias(alias or name)


# ---- SQL building blocks ----------------------------------------------------

CELLS = """cells AS (
  SELECT concat_ws('-', CAST(l_orderkey AS varchar), CAST(l_linenumber AS varchar), CAST(l_partkey AS varchar),
                   CAST(l_suppkey AS varchar),
                   CAST(year(l_shipdate)*10000 + month(l_shipdate)*100 + day(l_shipdate) AS varchar),
                   CAST(CAST(l_quantity AS int) AS varchar)) AS object_id,
         l_orderkey*48271 + l_linenumber*40692 + l_partkey*69621 AS seed_key,
         l_orderkey AS image_id, l_returnflag AS treatment, l_linestatus AS replicate,
         l_suppkey % 12 AS well, l_suppkey % 4 AS plate, l_linenumber AS line_no, l_suppkey AS supplier_id,
         l_partkey AS part_id,
         l_quantity AS f1, l_extendedprice AS f2, l_discount AS f3, l_tax AS f4
  FROM lineitem)"""

CODED = CELLS + """,
coded AS (
  SELECT *, CASE WHEN NOT (f1 > 1 AND f1 < 50) THEN 2001
                 WHEN NOT f2 > 2000 THEN 2002
                 WHEN NOT f2 < 90000 THEN 2003
                 WHEN NOT f2 > 500 * f1 THEN 2004
                 WHEN NOT f2 < 5000 * f1 THEN 2005
                 WHEN NOT f3 > 0.005 THEN 2006
                 ELSE 1 END AS qc_code
  FROM cells)"""

IMAGES = CODED + """,
per_image AS (
  SELECT o_orderkey AS image_id, count(CASE WHEN qc_code = 1 THEN 1 END) AS n_valid,
         coalesce(sum(f2), 0.0) AS cell_area
  FROM orders LEFT JOIN coded ON o_orderkey = image_id GROUP BY o_orderkey),
image_qc AS (
  SELECT *, CASE WHEN n_valid < 1 THEN 1001 WHEN n_valid > 3 THEN 1002
                 WHEN 300000 - cell_area < 50000 THEN 1003 ELSE 0 END AS image_code
  FROM per_image)"""

QC = IMAGES + """,
qc AS (
  SELECT c.*, i.image_code, (c.qc_code = 1 AND i.image_code = 0) AS is_valid
  FROM coded c JOIN image_qc i USING (image_id)),
valid AS (SELECT * FROM qc WHERE is_valid)"""

Z = QC + """,
scaling AS (
  SELECT avg(f1) m1, stddev_pop(f1) s1, avg(f2) m2, stddev_pop(f2) s2,
         avg(f3) m3, stddev_pop(f3) s3, avg(f4) m4, stddev_pop(f4) s4
  FROM valid WHERE treatment = 'N'),
z AS (
  SELECT v.*, (f1-m1)/s1 AS z1, (f2-m2)/s2 AS z2, (f3-m3)/s3 AS z3, (f4-m4)/s4 AS z4
  FROM valid v, scaling)"""


def _moments(name: str, source: str, x: str = "f1", y: str = "f2") -> str:
    """Mean and inverse 2×2 covariance of two columns."""
    return f"""{name} AS (
  SELECT mx, my, vyy/(vxx*vyy-vxy*vxy) AS ia, vxx/(vxx*vyy-vxy*vxy) AS ib, -vxy/(vxx*vyy-vxy*vxy) AS ic, n
  FROM (SELECT avg({x}) mx, avg({y}) my, var_pop({x}) vxx, var_pop({y}) vyy, covar_pop({x},{y}) vxy, count(*) n
        FROM {source}))"""


def mahal2(m: str, x: str = "f1", y: str = "f2") -> str:
    return (f"(({x}-{m}.mx)*({x}-{m}.mx)*{m}.ia + ({y}-{m}.my)*({y}-{m}.my)*{m}.ib"
            f" + 2*({x}-{m}.mx)*({y}-{m}.my)*{m}.ic)")


TRIM = QC + f""",
{_moments('m0', "valid WHERE treatment = 'N'")},
own AS (
  SELECT v.*, row_number() OVER (ORDER BY {mahal2('m0')}, object_id) AS rn, m0.n AS n_ref
  FROM valid v, m0 WHERE treatment = 'N'),
{_moments('m1', "own WHERE rn <= round_even(n_ref*0.9, 0) + 1")},
dist AS (
  SELECT q.*, CASE WHEN is_valid THEN sqrt({mahal2('m1')}) ELSE CAST('inf' AS double) END AS mahal_dist
  FROM qc q, m1)"""

# cutoff of the flagship filter: median + 1·MAD over valid control cells
FLT = TRIM + """,
med AS (SELECT quantile_cont(mahal_dist, 0.5) AS med FROM dist WHERE treatment = 'N' AND is_valid),
mad AS (SELECT quantile_cont(abs(mahal_dist - med), 0.5) AS mad FROM dist, med WHERE treatment = 'N' AND is_valid),
cut AS (SELECT med, mad, med + 1.0 * mad AS upper FROM med, mad),
flt AS (
  SELECT d.*, (is_valid AND mahal_dist > upper) AS is_non_control,
         (is_valid AND NOT mahal_dist > upper) AS is_control_like
  FROM dist d, cut)"""


def with_sql(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"
