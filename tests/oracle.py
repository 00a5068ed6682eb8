"""Side-by-side check of registered queries against their SQL on the given tables.

``python -m tests.oracle [--sf DIR] [name-prefix ...]``
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def _kind(name: str) -> str:
    name = name.lower()
    return {
        "bigint": "int64", "long": "int64", "integer": "int32", "int": "int32", "double": "double", "float": "float",
        "varchar": "string", "string": "string", "boolean": "boolean", "timestamp": "timestamp", "timestamp_ntz": "timestamp",
        "date": "date",
    }.get(name, name)


def compare(spark_df, con, sql: str) -> list[str]:
    problems = []
    rel = con.sql(sql)
    theirs = dict(zip(rel.columns, [str(t) for t in rel.types], strict=True))
    ours = dict(spark_df.dtypes)
    columns = sorted(ours)
    if columns != sorted(theirs):
        return [f"columns {columns} vs {sorted(theirs)}"]
    for c in columns:
        if _kind(ours[c]) != _kind(theirs[c]):
            problems.append(f"type of {c}: {ours[c]} vs {theirs[c]}")
    a = [tuple(_cell(r[c]) for c in columns) for r in spark_df.collect()]
    order = list(theirs)
    b = [tuple(_cell(r[order.index(c)]) for c in columns) for r in rel.fetchall()]
    if len(a) != len(b):
        problems.append(f"rows {len(a)} vs {len(b)}")

    def key(row):
        return tuple((v is None, str(type(v)), v) if not isinstance(v, float) else (False, "f", v) for v in row)

    a.sort(key=key), b.sort(key=key)
    if a != b:
        from collections import Counter

        ca, cb = Counter(a), Counter(b)
        left, right = list((ca - cb).elements()), list((cb - ca).elements())
        if left or right:
            problems.append(f"columns {columns}")
            problems.append(f"only spark {len(left)}: {left[:3]}")
            problems.append(f"only sql {len(right)}: {right[:3]}")
    return problems


def main(argv: list[str]) -> int:
    sf_dir = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf_dir = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from scriptorium.session import build

    spark = build("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.driver.host": "127.0.0.1"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problems = compare(df, con, oracles[name])
                note = "ok" if not problems else "FAIL"
            else:
                rows = df.collect()
                problems, note = [], f"rows-only {len(rows)}"
        except Exception as error:  # noqa: BLE001
            problems, note = [str(error)[:1500]], "ERROR"
        print(f"{name:40s} {note:14s} {time.time()-start:6.1f}s", flush=True)
        for p in problems:
            print("    ", p[:900], flush=True)
        failed += bool(problems)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
