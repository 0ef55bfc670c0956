"""Run registered queries next to their SQL twins and report differences.

    python tests/oracle_check.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, query, sql):
    frame = query(spark, sf_dir)
    got = rows_of(frame.columns, frame.collect())
    if sql is None:
        return None, sum(got[1].values())
    relation = con.execute(sql)
    columns = [d[0] for d in relation.description]
    want = rows_of(columns, relation.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} vs {want[0]}", 0
    extra, missing = got[1] - want[1], want[1] - got[1]
    if extra or missing:
        return (f"{sum(extra.values())} extra, {sum(missing.values())} missing of {sum(want[1].values())}\n"
                f"  extra   {list(extra)[:3]}\n  missing {list(missing)[:3]}"), sum(got[1].values())
    return None, sum(got[1].values())


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def session(cores="8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = "0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in args or queries:
        start = time.time()
        try:
            problem, n = compare(spark, con, sf_dir, queries[name], oracles.get(name))
        except Exception as error:  # report and go on to the next query
            problem, n = f"{type(error).__name__}: {str(error)[:1500]}", 0
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={n} {time.time() - start:.1f}s"
              f"{' (rows only)' if name not in oracles else ''}", problem or "", flush=True)
    print("failed:", failed)
    sys.exit(failed > 0)
