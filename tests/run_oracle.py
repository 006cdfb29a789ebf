"""Run every registered query at one scale and compare it with its oracle SQL.

Usage: python tests/run_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

import __spark_entry__ as E  # noqa: E402
from cohera.session import get_session  # noqa: E402
from oracle_check import compare, duck  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_session("local[8]", 8)
    con = duck(sf)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or list(qs):
        t = time.time()
        try:
            df = qs[name](spark, sf)
            if name in sqls:
                ok, msg = compare(df, con, sqls[name])
            else:
                n = df.count()
                ok, msg = True, f"rows only: {n} rows"
        except Exception as e:  # report and go on
            ok, msg = False, f"error: {type(e).__name__}: {str(e)[:300]}"
            traceback.print_exc(limit=2)
        bad += 0 if ok else 1
        print(f"{'OK ' if ok else 'BAD'} {name:<24} {time.time() - t:6.1f}s  {msg}", flush=True)
    print(f"{len(names or qs) - bad} ok, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
