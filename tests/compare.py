"""Compare registered queries with their SQL twins in DuckDB.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
# Spark type -> DuckDB type
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when names, types, row counts and values agree."""
    cursor = con.execute(sql)
    types = {d[0]: str(d[1]) for d in cursor.description}
    expected = cursor.fetchall()
    names = sorted(types)
    problems = []
    if sorted(spark_df.columns) != names:
        return [f"columns {sorted(spark_df.columns)} != {names}"]
    for name, kind in spark_df.dtypes:
        if TYPES.get(kind) != types[name]:
            problems.append(f"type of {name}: {kind} != {types[name]}")
    order = [list(types).index(n) for n in names]
    want = Counter(tuple(row[i] for i in order) for row in expected)
    got = Counter(tuple(row[n] for n in names) for row in spark_df.collect())
    if want != got:
        problems.append(f"rows: spark {sum(got.values())}, sql {sum(want.values())}; "
                        f"only spark {list((got - want).items())[:2]}; only sql {list((want - got).items())[:2]}")
    return [p[:1500] for p in problems]


def session(cpus: str = "8") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("textlabels-tests")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    from textlabels.plans import QUERIES, SQL
    from textlabels.sources.workspace import release
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(QUERIES)
    spark, con, bad = session(), connect(sf_dir), 0
    for name in chosen:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in SQL:
                found = differences(df, con, SQL[name])
            else:
                found = [] if df.count() else ["no rows"]
        except Exception as error:
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.2f}s", *found, sep="\n     " if found else " ", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} agree")
    release(spark)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
