"""Runs registered queries against their DuckDB twin: ``python tests/oracle_check.py [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return int(value) if value == int(value) and abs(value) < 1e15 else round(value, 9)
    if hasattr(value, "isoformat"):
        return value.isoformat()[:26]
    return value


def canonical(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(_plain(row[i]) for i in order)) for row in rows)


def compare(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = query(spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} <> {sorted(names)}"
    left, right = canonical(df.columns, ours), canonical(names, theirs)
    if left == right:
        return None if left else "both empty"
    only = sorted(set(left) - set(right))[:2], sorted(set(right) - set(left))[:2]
    return f"rows {len(left)} <> {len(right)}\n   spark only {only[0]}\n   duck only  {only[1]}\n   columns {sorted(names)}"


def main(names: list[str]) -> int:
    import __spark_entry__ as entry
    from jobstrata.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            if name in oracles:
                result = compare(spark, con, sf_dir, queries[name], oracles[name])
            else:
                result = None if queries[name](spark, sf_dir).count() else "no rows"
        except Exception as exc:  # noqa: BLE001 - report and go on
            result = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += result is not None
        kind = "oracle" if name in oracles else "rows"
        print(f"{'ok ' if result is None else 'BAD'} {name} [{kind}] {time.time() - start:.1f}s {result or ''}", flush=True)
    print("bad", bad, "of", len(names or queries))
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
