"""Run registered queries next to their SQL twins and report differences.

    python tools/check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from hourgrid.session import build_session  # noqa: E402
from hourgrid.workload import REGISTRY  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if hasattr(v, "isoformat"):
        return str(v)[:26]
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(norm(r[i]) for i in order) for r in rows)


def main() -> int:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.001"
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                         "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES.split():
        if not Path(f"{sf}/{t}.parquet").exists():
            continue
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name, q in REGISTRY.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t0 = time.time()
        try:
            df = q.run(spark, sf)
            got_c, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
        except Exception as e:  # report and go on
            bad += 1
            print(f"ERROR {name}: {str(e)[:700]}", flush=True)
            continue
        took = time.time() - t0
        if q.sql is None:
            print(f"rows  {name}: {len(got)} rows {took:.1f}s {dict(zip(got_c, got[0])) if got else ''}"[:220], flush=True)
            continue
        t0 = time.time()
        try:
            cur = con.execute(q.sql)
            want_c, want = rows_of([d[0] for d in cur.description], cur.fetchall())
        except Exception as e:
            bad += 1
            print(f"SQL   {name}: {str(e)[:600]}", flush=True)
            continue
        sql_took = time.time() - t0
        if got_c != want_c or got != want:
            bad += 1
            diff = [(a, b) for a, b in zip(got, want) if a != b][:2]
            print(f"DIFF  {name}: {len(got)} vs {len(want)} rows {got_c} {want_c if want_c != got_c else ''} {diff}", flush=True)
        else:
            flag = " EMPTY" if not got else (" ALLNULL" if all(all(v == "∅" for v in r) for r in got) else "")
            print(f"ok    {name}: {len(got)} rows {took:.1f}s sql {sql_took:.1f}s{flag}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
