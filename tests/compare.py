"""Run registered queries next to their SQL in DuckDB and compare rows and types."""

import sys
import time
from decimal import Decimal

import duckdb

from registry.oracle import ORACLE
from registry.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _kind(value):
    return type(value).__name__


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(ORACLE[name])
    want = canonical([d[0] for d in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        pairs = [(g, w) for g, w in zip(got[1], want[1]) if g != w or repr(g) != repr(w)]
        return f"{len(got[1])} rows against {len(want[1])}; first difference {pairs[:1]}"
    kinds = [{_kind(r[i]) for r in got[1]} | {_kind(r[i]) for r in want[1]} for i in range(len(got[0]))]
    mixed = [c for c, k in zip(got[0], kinds) if len(k - {"NoneType"}) > 1 or Decimal.__name__ in k]
    if mixed:
        return f"types differ in {mixed}"
    return None if got[1] else "no rows"


if __name__ == "__main__":
    from tradewind.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con, failed = local_session(), connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{name:36s} {time.time() - start:6.2f}s {'ok' if problem is None else problem}", flush=True)
    print(f"{len(names) - failed} of {len(names)} equal")
