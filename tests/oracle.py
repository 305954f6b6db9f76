"""Compare registered queries with their SQL twins. Usage: oracle.py SF_DIR [name-prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=repr
    )


KINDS = {
    "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP", "int": "INTEGER",
}


def compare(spark, con, sf_dir, fn, sql):
    """None when both sides agree, else a short account of the difference."""
    df = fn(spark, sf_dir)
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    rel = con.sql(sql)
    want_names, want = rows_of(rel.columns, rel.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}"
    kinds = {c: KINDS.get(t, t) for c, t in df.dtypes}
    want_kinds = dict(zip(rel.columns, map(str, rel.types)))
    odd = {c: (kinds[c], want_kinds[c]) for c in kinds if kinds[c] != want_kinds[c]}
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w][:2]
        return f"{len(got)} rows against {len(want)}; first differences {str(diff)[:1500]}"
    if odd:
        return f"types {odd}"
    return None if got else "both empty"


def main(sf_dir: str, prefixes: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from postlens.session import build_session

    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, fn, sqls.get(name))
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        bad += problem is not None
        kind = "sql" if name in sqls else "rows"
        print(f"{'ok ' if problem is None else 'BAD'} {name} [{kind}] {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
