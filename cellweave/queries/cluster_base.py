"""Fixture clustering model shared by the cluster and profile queries, in Spark and in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.assign import centroid_matrix, centroids_of
from cellweave.queries import base as B

P = 4
LABEL = "CAST(floor((f1 - 1) / 17) * 2 + CASE WHEN f3 >= 0.05 THEN 1 ELSE 0 END AS int)"
COARSE = "CAST(floor((f1 - 1) / 17) AS int)"


def z_model(spark, sf, label: str = LABEL, k: int = 6, z: DataFrame | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """z-scored valid cells (``z``, if they are there), and the centroids and sizes of a rule-based start partition."""
    z = (B.z_cells(spark, sf) if z is None else z).withColumn("cluster", F.expr(label))
    centroids, sizes = centroid_matrix(centroids_of(z, "vec", P), k, P)
    return z, centroids, sizes


def d_sql(a: str, b: str, p: float = 2, n: int = P, wa: str | None = None) -> str:
    """Minkowski distance of columns a1.. and b1..; ``wa`` prefixes weight columns."""
    w = [f"*{wa}{i}" if wa else "" for i in range(1, n + 1)]
    if p == 2:
        return "sqrt(" + "+".join(f"pow(({a}{i}-{b}{i}){w[i - 1]}, 2)" for i in range(1, n + 1)) + ")"
    if p == 1:
        return "(" + "+".join(f"abs(({a}{i}-{b}{i}){w[i - 1]})" for i in range(1, n + 1)) + ")"
    return "pow(" + "+".join(f"pow(abs(({a}{i}-{b}{i}){w[i - 1]}), {p})" for i in range(1, n + 1)) + f", {1.0 / p})"


def model_sql(base: str = B.Z, label: str = LABEL) -> str:
    return base + f""",
cent AS (SELECT {label} AS cluster, avg(z1) c1, avg(z2) c2, avg(z3) c3, avg(z4) c4, count(*) AS size FROM z GROUP BY 1),
cd AS (SELECT z.*, cluster, size, {d_sql('z', 'c')} AS d FROM z CROSS JOIN cent),
asg AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY d, cluster) AS rn FROM cd) WHERE rn = 1)"""


MODEL = model_sql()
Z_COLS = "z1, z2, z3, z4"


def seeds_sql(k: int, source: str = "z", p: float = 2) -> str:
    """CTEs fs0..fs{k-1}: farthest-first seeds (object_id, s1..s4), then ``seeds`` with their number."""
    cols = ", ".join(f"z{i} AS s{i}" for i in range(1, 5))
    out = [f"fs0 AS MATERIALIZED (SELECT object_id, {cols} FROM {source} ORDER BY object_id LIMIT 1)"]
    for j in range(1, k):
        dist = [d_sql(f"{source}.z", f"fs{i}.s", p) for i in range(j)]
        near = dist[0] if j == 1 else "least(" + ", ".join(dist) + ")"
        out.append(f"fs{j} AS MATERIALIZED (SELECT {source}.object_id, {cols} FROM {source}, "
                   + ", ".join(f"fs{i}" for i in range(j)) + f" ORDER BY {near} DESC, {source}.object_id LIMIT 1)")
    out.append("seeds AS (" + " UNION ALL ".join(f"SELECT {j} AS cluster, * FROM fs{j}" for j in range(k)) + ")")
    return ",\n".join(out)


def lloyd_sql(start: str, rounds: int, update: str = "avg({x})", distance: str | None = None,
              source: str = "z", extra: str = "") -> str:
    """Unrolled rounds. ``start`` selects (cluster, c1..c4). CTEs a1.. (assignment) and r0.. (centres)."""
    dist = distance or d_sql("z", "c")
    out = [f"r0 AS MATERIALIZED ({start})"]
    for t in range(1, rounds + 1):
        upd = ", ".join(f"{update.format(x=f'z{i}')} AS c{i}" for i in range(1, 5))
        out.append(f"""a{t} AS MATERIALIZED (SELECT object_id, {Z_COLS}, min_by(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (
  SELECT object_id, {Z_COLS}, cluster, {dist} AS d FROM {source} CROSS JOIN r{t - 1}{extra}) GROUP BY ALL)""".replace(
            "GROUP BY ALL", f"GROUP BY object_id, {Z_COLS}"))
        out.append(f"""r{t} AS MATERIALIZED (SELECT r.cluster, {", ".join(f"coalesce(n.c{i}, r.c{i}) AS c{i}" for i in range(1, 5))}
  FROM r{t - 1} r LEFT JOIN (SELECT cluster, {upd} FROM a{t} GROUP BY cluster) n ON n.cluster = r.cluster)""")
    return ",\n".join(out)


def centres_out(name: str, digits: int = 6) -> str:
    return f"SELECT cluster, " + ", ".join(
        f"round(c{i}, {digits}) + 0.0 AS c{i}" for i in range(1, 5)) + f" FROM {name}"


def centres_frame(spark, centroids: np.ndarray) -> DataFrame:
    rows = [(i, *map(float, c)) for i, c in enumerate(centroids)]
    df = spark.createDataFrame(rows, "cluster int, " + ", ".join(f"c{i} double" for i in range(1, len(centroids[0]) + 1)))
    return df.select("cluster", *[B.r(f"c{i}") for i in range(1, len(centroids[0]) + 1)])
