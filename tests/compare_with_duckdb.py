"""Run catalogue queries next to their SQL in DuckDB and compare the results.

    python tests/compare_with_duckdb.py [sf folder] [query names…]
"""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(str(_plain(v)) for v in value) + "]"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows), key=lambda r: [(v is None, str(v)) for v in r]
    )


def compare(con, df, sql: str) -> str:
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_names, want = rows_of([d[0] for d in result.description], result.fetchall())
    if names != want_names:
        return f"columns differ: {names} / {want_names}"
    if len(got) != len(want):
        return f"rows differ: {len(got)} / {len(want)}"
    near = 0
    kinds = {c: set() for c in names}
    for a, b in zip(got, want):
        if a != b:
            for c, x, y in zip(names, a, b):
                same = x == y or (
                    isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-6)
                )
                if not same:
                    return f"values differ in {c}: {a} / {b}"
            near += 1
        for c, x, y in zip(names, a, b):
            if type(x) is not type(y):
                kinds[c].add(f"{type(x).__name__}/{type(y).__name__}")
    odd = {c: k for c, k in kinds.items() if k}
    note = f" types {odd}" if odd else ""
    return ("exact" if not near else f"near ({near} rows)") + f" {len(got)} rows" + note


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from salespark.session import build_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = build_session("oracle", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sql = oracle_sql()
    bad = []
    for name, fn in queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in sql:
                verdict = compare(con, df, sql[name])
            else:
                verdict = f"rows only {len(df.collect())}"
        except Exception as exc:  # noqa: BLE001
            verdict = f"ERROR {str(exc)[:1500]}"
        if not verdict.startswith(("exact", "rows only")) or "types" in verdict:
            bad.append(name)
        print(f"{name:36s} {time.time() - start:6.2f}s  {verdict}", flush=True)
    print("to look at:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
