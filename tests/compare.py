"""Run registered queries next to their SQL forms and compare the rows.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(v):
    return round(v, 9) if isinstance(v, float) else v


def _bag(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(repr([_cell(r[i]) for i in order]) for r in rows)


def compare(spark, con, name, query, sql, folder) -> tuple[bool, str]:
    df = query(spark, folder)
    got = _bag(df.columns, df.collect())
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = _bag(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}"
    if got != want:
        more, less = list((got - want).items())[:2], list((want - got).items())[:2]
        return False, f"{sum(got.values())} vs {sum(want.values())} rows; only spark {more}; only sql {less}"
    return True, f"{sum(got.values())} rows"


def main() -> int:
    from riskboard import plans
    from riskboard.session import build
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(plans.QUERIES)
    spark = build(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                  spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    for name in names:
        begin = time.time()
        try:
            ok, note = compare(spark, con, name, plans.QUERIES[name], plans.SQL[name], folder)
        except Exception as err:  # report and go on with the next query
            ok, note = False, f"{type(err).__name__}: {str(err)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:24s} {time.time() - begin:6.2f}s {note[:900]}", flush=True)
    print(f"{len(names) - bad}/{len(names)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(main())
