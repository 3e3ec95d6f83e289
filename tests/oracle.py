"""Run registered queries against their oracle SQL: ``python tests/oracle.py [sf] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(d):
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{d}/{name}.parquet'")
    return con


def rows_of(frame):
    """Rows as sorted text, columns by name, numbers and missing values in one form."""
    frame = frame[sorted(frame.columns)]

    def text(value):
        if value is None or pd.isna(value):
            return "∅"
        if isinstance(value, bool):
            return str(value)
        if isinstance(value, (int, float)) or hasattr(value, "dtype"):
            number = float(value)
            return repr(int(number)) if number == int(number) and abs(number) < 2 ** 53 else repr(value)
        return str(value)

    return sorted("\x1f".join(text(v) for v in row) for row in frame.astype(object).itertuples(index=False, name=None))


def differences(spark, con, name, run, oracle, d):
    """None when equal, else what differs; and the number of rows."""
    got = run(spark, d)
    pdf = got.toPandas()
    if oracle is None:
        return (None if len(pdf) else "no rows"), len(pdf)
    want = con.execute(oracle).df()
    if sorted(pdf.columns) != sorted(want.columns):
        return f"columns {sorted(pdf.columns)} != {sorted(want.columns)}", len(pdf)
    if not len(pdf):
        return "no rows", 0
    a, b = rows_of(pdf), rows_of(want)
    if a == b:
        return None, len(pdf)
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"{len(a)} rows != {len(b)}; only Spark {only_a[:2]!r}; only oracle {only_b[:2]!r}", len(pdf)


def main():
    from tests.conftest import make_session
    import __spark_entry__ as E
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(E.queries())
    d = f"/root/testdata/sf{sf}"
    spark, con = make_session(), connect(d)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem, n = differences(spark, con, name, E.queries()[name], E.oracle_sql().get(name), d)
        except Exception as error:  # report and go on with the next query
            problem, n = f"{type(error).__name__}: {str(error)[:1500]}", -1
        bad += problem is not None
        kind = "D" if name in E.oracle_sql() else "R"
        print(f"{'ok ' if problem is None else 'BAD'} {kind} {name:28} {n:7} rows {time.time() - start:6.2f}s"
              + (f"\n      {problem[:1800]}" if problem else ""), flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
