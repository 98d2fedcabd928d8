"""Compare every query with its SQL: python tests/check_oracle.py [sf_dir] [name ...]"""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as E  # noqa: E402
from tillscope.session import make_session  # noqa: E402

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(r[i] for i in order) for r in rows]
    return sorted(columns), sorted(picked, key=lambda r: tuple(map(str, r)))


def compare(con, spark, sf_dir, name):
    """None if equal, else a text; rows are compared exactly."""
    df = E.queries()[name](spark, sf_dir)
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in E.oracle_sql():
        return None
    res = con.execute(E.oracle_sql()[name])
    theirs = _rows([c[0] for c in res.description], res.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows != {len(theirs[1])}"
    kinds = [(type(a), type(b)) for a, b in zip(ours[1][0], theirs[1][0])] if ours[1] else []
    odd = [(c, k) for c, k in zip(ours[0], kinds)
           if k[0] is not k[1] and type(None) not in k]
    if odd:
        return f"types {odd}"
    bad = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    return f"{len(bad)} of {len(ours[1])} rows differ, e.g. {bad[0]}" if bad else None


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session, base = make_session(), connect(folder)
    failed = 0
    for query in sys.argv[2:] or E.queries():
        t0 = time.time()
        try:
            problem = compare(base, session, folder, query)
        except Exception as error:  # report and go on to the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        kind = "" if query in E.oracle_sql() else " (no SQL)"
        print(f"{'FAIL' if problem else 'ok'} {query}{kind} {time.time() - t0:.1f}s "
              f"{problem or ''}", flush=True)
    print("failed:", failed)
