"""Run registered queries beside their SQL on DuckDB and report differences.

usage: python tests/oracle_check.py [sf] [name-fragment ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 1 << 40 else str(v)
    return str(v)


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns {sorted(spark_cols)} != {sorted(duck_cols)}"
    order = [duck_cols.index(c) for c in spark_cols]
    a = sorted(tuple(canon(v) for v in r) for r in spark_rows)
    b = sorted(tuple(canon(r[i]) for i in order) for r in duck_rows)
    if a == b:
        return None
    sa, sb = set(a), set(b)
    only_a, only_b = sorted(sa - sb)[:3], sorted(sb - sa)[:3]
    return f"rows {len(a)} vs {len(b)}; differing {len(sa - sb)}/{len(sb - sa)}\n   spark {only_a}\n   duck  {only_b}"


def main(argv):
    import duckdb

    import __spark_entry__ as entry
    from voxtable.session import local_session

    sf = argv[0] if argv else "0.01"
    frags = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    oracles, bad = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if frags and not any(f == name or (f.endswith("*") and name.startswith(f[:-1])) for f in frags):
            continue
        try:
            t0 = time.time()
            df = fn(spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            t1 = time.time()
            if name not in oracles:
                print(f"ROWS {name} n={len(rows)} spark={t1 - t0:.1f}s", flush=True)
                continue
            cur = con.execute(oracles[name])
            cols = [d[0] for d in cur.description]
            duck = cur.fetchall()
            t2 = time.time()
            problem = compare(rows, df.columns, duck, cols)
            print(f"{'ok  ' if problem is None else 'DIFF'} {name} n={len(rows)} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s", flush=True)
            if problem:
                bad.append(name)
                print("   " + problem[:1500], flush=True)
        except Exception as exc:  # report and go on with the next query
            bad.append(name)
            print(f"FAIL {name}: {str(exc)[:900]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
