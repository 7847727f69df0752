"""Runs queries and their SQL side by side and compares rows: `python -m tests.oracle SF_DIR [NAME...]`."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])
os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([ROOT, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return repr(float(value)) if abs(value) < 1 << 53 else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if value.__class__.__name__ == "Decimal":
        return repr(round(float(value), 9) + 0.0)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(plain(r[k]) for k in order) for r in rows], key=repr), [columns[k] for k in order]


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def compare(spark, con, sf_dir: str, name: str, query, sql: str) -> str:
    """Empty if both give the same rows, else what differs."""
    frame = query(spark, sf_dir)
    ours, columns = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    theirs, others = rows_of(names, found.fetchall())
    if columns != others:
        return f"columns {columns} and {others}"
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows; {ours[:2]} {theirs[:2]}"
    odd = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    return f"{len(odd)} of {len(ours)} rows differ: {odd[:2]}" if odd else ""


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry

    spark, con = session(), duck(sf_dir)
    queries, oracles, bad = entry.queries(), entry.oracle_sql(), 0
    for name in names or oracles:
        began = time.time()
        try:
            what = compare(spark, con, sf_dir, name, queries[name], oracles[name]) if name in oracles else f"no SQL; {queries[name](spark, sf_dir).count()} rows"
        except Exception as e:  # noqa: BLE001
            what = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(what) and not what.startswith("no SQL")
        print(f"{name}: {what or 'same'} ({time.time() - began:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
