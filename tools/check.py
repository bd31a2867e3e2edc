"""Run registered queries next to their SQL twins and compare every value.

    python tools/check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lodestead.queries import ORACLES, QUERIES  # noqa: E402
from lodestead.queries.views import TABLES  # noqa: E402


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = args or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = []
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            cols = sorted(df.columns)
            mine = [tuple(r) for r in df.select(*cols).collect()]
        except Exception as e:  # report and go on with the next query
            print(f"{name}: SPARK FAILED {str(e)[:600]}")
            bad.append(name)
            continue
        took = time.time() - start
        if name not in ORACLES:
            print(f"{name}: {len(mine)} rows, no twin, {took:.1f}s")
            continue
        try:
            rel = duck.execute(ORACLES[name])
            got = [d[0] for d in rel.description]
            theirs = rel.fetchall()
        except Exception as e:
            print(f"{name}: TWIN FAILED {str(e)[:800]}")
            bad.append(name)
            continue
        if sorted(got) != cols:
            print(f"{name}: COLUMNS {cols} vs {sorted(got)}")
            bad.append(name)
            continue
        order = [got.index(c) for c in cols]
        theirs = [tuple(r[i] for i in order) for r in theirs]
        a, b = sorted(map(repr, mine)), sorted(map(repr, theirs))
        if a != b:
            only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
            print(f"{name}: DIFFERS rows {len(a)} vs {len(b)}\n  cols {cols}\n  spark {only_a}\n  twin  {only_b}")
            bad.append(name)
        else:
            print(f"{name}: ok {len(a)} rows, {took:.1f}s")
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
