"""Compare registered queries with their SQL in DuckDB."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
FAMILY = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "integer": "int", "hugeint": "huge",
          "double": "double", "float": "double", "varchar": "string", "string": "string", "boolean": "boolean",
          "timestamp": "timestamp", "date": "date"}


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def frame(columns, types, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    kinds = [(columns[i], FAMILY.get(str(types[i]).lower(), str(types[i]).lower())) for i in order]
    return kinds, sorted(tuple(norm(r[i]) for i in order) for r in rows)


def spark_frame(df):
    return frame(df.columns, [t for _, t in df.dtypes], df.collect())


def sql_frame(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    return frame(cols, types, cur.fetchall())


def compare(spark, con, fn, sql, sf_dir):
    """Problem text, or None when schema and every value agree."""
    kinds, rows = spark_frame(fn(spark, sf_dir))
    want_kinds, want = sql_frame(con, sql)
    if kinds != want_kinds:
        return f"schema {kinds} != {want_kinds}"
    if len(rows) != len(want):
        return f"{len(rows)} rows != {len(want)}"
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(rows)} rows differ, e.g. {bad[:2]}"
    return None


def main() -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from cellweave.session import local_session

    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = local_session("oracle", 8)
    sf_dir = f"/root/testdata/sf{sf}"
    con = connection(sf_dir)
    sqls, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if only and not any(o == "=" + name or (o[0] != "=" and o in name) for o in only):
            continue
        t = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, fn, sqls[name], sf_dir)
            else:
                n = len(fn(spark, sf_dir).collect())
                problem = None if n else "no rows"
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        kind = "sql " if name in sqls else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {time.time() - t:6.2f}s {name} {problem or ''}", flush=True)
        bad += bool(problem)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
