"""Run registered queries against their oracle SQL on DuckDB and compare.

    python tools/check_oracle.py [--dir /root/testdata/sf0.01] [name-prefix-or-module ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from rankwell.plans.catalog import load_all  # noqa: E402
from rankwell.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def plain(value):
    """One comparable form for values of both engines."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, decimal.Decimal):
        return repr(float(value))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value if isinstance(value, (str, bool)) or value is None else repr(value)


KIND = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "float": "FLOAT", "date": "DATE",
    "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]", "array<bigint>": "BIGINT[]",
    "array<double>": "DOUBLE[]", "smallint": "SMALLINT",
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--dir", default="/root/testdata/sf0.01")
    parser.add_argument("--plain", action="store_true", help="a session with default settings")
    parser.add_argument("--show", action="store_true")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args(argv)
    if args.plain:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").config(
            "spark.sql.shuffle.partitions", "8"
        ).getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = local_session(8)
    catalogue = load_all()
    chosen = [
        q for q in catalogue.values()
        if not args.names
        or any(q.name.startswith(n) or q.run.__module__.endswith(n) for n in args.names)
    ]
    bad = 0
    for q in chosen:
        start = time.time()
        try:
            frame = q.run(spark, args.dir)
            ours = [r.asDict(recursive=True) for r in frame.collect()]
        except Exception as error:  # report and go on to the next query
            bad += 1
            print(f"ERROR {q.name}: {str(error)[:1500]}", flush=True)
            continue
        took = time.time() - start
        columns = sorted(frame.columns)
        if args.show:
            for r in ours[:5]:
                print("   ", {k: (str(v)[:80]) for k, v in r.items()})
        if q.oracle is None:
            print(f"rows  {q.name}: {len(ours)} rows, {took:.2f}s (no oracle)", flush=True)
            continue
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.dir}/{t}.parquet'")
        start = time.time()
        try:
            cur = con.execute(q.oracle)
            names = [d[0] for d in cur.description]
            kinds = {d[0]: str(d[1]) for d in cur.description}
            theirs = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
        except Exception as error:
            bad += 1
            print(f"SQLERR {q.name}: {str(error)[:1500]}", flush=True)
            continue
        duck = time.time() - start
        if sorted(names) != columns:
            bad += 1
            print(f"DIFF  {q.name}: columns {columns} vs {sorted(names)}", flush=True)
            continue
        spark_kinds = dict(frame.dtypes)
        kind_diff = [
            f"{c}: {spark_kinds[c]} vs {kinds[c]}"
            for c in columns
            if KIND.get(spark_kinds[c], spark_kinds[c]).upper() != kinds[c].upper()
        ]
        key = lambda r: repr(tuple(plain(r[c]) for c in columns))
        left, right = sorted(map(key, ours)), sorted(map(key, theirs))
        if left != right:
            bad += 1
            a, b = set(left) - set(right), set(right) - set(left)
            print(f"DIFF  {q.name}: {len(ours)} vs {len(theirs)} rows, "
                  f"{len(a)} only ours, {len(b)} only SQL", flush=True)
            for side, rows in (("ours", a), ("sql ", b)):
                for r in sorted(rows)[:3]:
                    print(f"   {side} {r[:600]}", flush=True)
        else:
            note = f"  kinds: {kind_diff}" if kind_diff else ""
            print(f"ok    {q.name}: {len(ours)} rows, {took:.2f}s, duckdb {duck:.2f}s{note}",
                  flush=True)
    print(f"{len(chosen)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
