"""Runs queries beside their DuckDB SQL, as a set of rows with columns sorted by name.

python tests/compare.py DIR [NAME...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, list):
        return tuple(map(plain, x))
    return x


def duck(directory: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(directory).glob("*.parquet")):
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{at}')")
    return db


def differences(spark, directory: str, query, sql: str) -> tuple[int, int, list, list]:
    """(rows here, rows there, some only here, some only there)."""
    df = query(spark, directory)
    names = sorted(df.columns)
    here = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    cursor = duck(directory).execute(sql)
    there_names = [c[0] for c in cursor.description]
    if sorted(there_names) != names:
        return 0, 0, [names], [sorted(there_names)]
    at = [there_names.index(n) for n in names]
    there = Counter(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
    return sum(here.values()), sum(there.values()), list((here - there))[:3], list((there - here))[:3]


def main() -> None:
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry
    from tarn.plans.session import local_session

    spark = local_session()
    directory, names = sys.argv[1], sys.argv[2:]
    sql = entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            if name in sql:
                a, b, only_here, only_there = differences(spark, directory, query, sql[name])
                print(f"{'same' if not only_here and not only_there else 'DIFFERENT'} {name} {a} {b} {time.time() - began:.1f}s", *([str(only_here)[:600], str(only_there)[:600]] if only_here or only_there else []), flush=True)
            else:
                print(f"rows {name} {query(spark, directory).count()} {time.time() - began:.1f}s", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"ERROR {name} {type(e).__name__} {str(e)[:700]}", flush=True)


if __name__ == "__main__":
    main()
