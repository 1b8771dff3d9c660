"""Compare registered queries with their SQL: ``python tests/oracle.py SF_DIR [NAME...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'; set memory_limit='3GB'; set threads=4; set max_temp_directory_size='1GB'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p if p.is_file() else f'{p}/*.parquet'}'")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if hasattr(x, "isoformat"):
        return str(x)[:26]
    return str(x) if type(x).__name__ == "Decimal" else x


def differences(spark, con, sf_dir: str, fn, sql: str) -> str:
    """Empty where both give the same column names and the same bag of rows."""
    df = fn(spark, sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    a = Counter(tuple(_plain(r[c]) for c in order) for r in df.collect())
    at = [names.index(c) for c in order]
    b = Counter(tuple(_plain(r[i]) for i in at) for r in cur.fetchall())
    return "" if a == b else f"rows {sum(a.values())} and {sum(b.values())}; e.g. {list((a - b).items())[:2]} and {list((b - a).items())[:2]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf_dir, *names = sys.argv[1:]
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles, bad = connect(sf_dir), e.queries(), e.oracle_sql(), 0
    for n in names or queries:
        t = time.time()
        try:
            said = differences(spark, con, sf_dir, queries[n], oracles[n]) if n in oracles else f"no oracle, {queries[n](spark, sf_dir).count()} rows"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:500]}"
        bad += bool(said) and not said.startswith("no oracle")
        print(f"{'ok' if not said else said:70} {n} {time.time() - t:.1f}s", flush=True)
    os._exit(bool(bad))
